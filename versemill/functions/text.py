"""Scalar text functions as Column expressions, all within Catalyst (C-01..C-03, C-05..C-09, C-15..C-22, C-26..C-29)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from versemill.functions import fixed

ENTITY, TAG, ANY_ENTITY, ANY_TAG = fixed.ENTITY, fixed.TAG, fixed.ANY_ENTITY, fixed.ANY_TAG
C1, CP1252 = fixed.mojibake()


def sub(text: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(to))


def has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def strip_margins(text: Column) -> Column:
    """C-01: no leading pilcrows, nothing from the first margin note on; a colon goes only if a note stood behind it."""
    bare = sub(text, r"^(?:\s*¶\s*)+")
    body = sub(sub(bare, r"(?s)\+ \d+\.\d+ .*$"), r"\s*:\s*$")
    return F.when(has(bare, r"\+ \d+\.\d+ "), body).otherwise(bare)


def normalise(text: Column) -> Column:
    """C-02: single spaces, none before closing marks."""
    one = F.trim(sub(text, r"[\s\u00a0]+", " "))
    return sub(one, r"\s+([,.;:!?%»›])", "$1")


#: White space as Unicode has it. Classes of many ranges are slow, so they are only used where a text has a suspect letter.
SPACE = r"[\s\u001C-\u001F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
ASCII_SPACE = r"[ \t\n\x0B\f\r\x1C\x1D\x1E\x1F]+"
_SUSPECT = r"[\u0080-\u00A0\u00AD\u1680\u2000-\u206F\u3000\uFEFF]"


def _suspect(text: Column) -> Column:
    """Whether a text may have white space beyond ASCII, C1 letters or marks without width; ASCII texts are told by their size."""
    return (F.octet_length(text) != F.length(text)) & has(text, _SUSPECT)


def let(value: Column, f) -> Column:
    """f(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def norm_text(text: Column) -> Column:
    """C-03: what comparison ignores: C1 letters, marks without width, kinds of white space. Null is empty."""
    t = F.coalesce(text, F.lit(""))
    full = sub(F.translate(t, C1 + fixed.ZERO_WIDTH, CP1252), SPACE, " ")
    return F.trim(F.when(_suspect(t), full).otherwise(sub(t, ASCII_SPACE, " ")))


def squash(text: Column) -> Column:
    """Without any white space."""
    return F.when(_suspect(text), sub(text, SPACE)).otherwise(sub(text, ASCII_SPACE))


def entity_pass(text: Column) -> Column:
    """C-06, one pass: each of the five entities becomes its letter, the ampersand last."""
    for name, letter in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(letter))
    return text


def unescape(text: Column) -> Column:
    """C-06: (text, n) after at most four passes, with the entities met in all passes."""
    start = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    step = lambda a, _: F.struct(entity_pass(a["text"]).alias("text"), (a["n"] + F.regexp_count(a["text"], F.lit(ENTITY))).alias("n"))
    once = F.aggregate(F.array(*[F.lit(i) for i in range(4)]), start, step)
    return F.when(F.contains(text, F.lit("&")), once).otherwise(start)


def sanitize(text: Column) -> Column:
    """C-05..C-08 with the counters of A-11: (text, c1_mojibake, entity_residue, tag_residue, replacement_char, stray_delimiters)."""
    fixed_c1 = F.translate(text, C1, CP1252)
    plain = unescape(fixed_c1)
    bare = sub(plain["text"], TAG)
    return F.struct(
        F.translate(bare, "{}~", "").alias("text"),
        (fixed_c1 != text).cast("long").alias("c1_mojibake"),
        plain["n"].alias("entity_residue"),
        F.regexp_count(plain["text"], F.lit(TAG)).cast("long").alias("tag_residue"),
        count_of(bare, "\ufffd").alias("replacement_char"),
        (F.length(bare) - F.length(F.translate(bare, "{}~", ""))).cast("long").alias("stray_delimiters"),
    )


def count_of(text: Column, letter: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, letter, ""))).cast("long")


def usfm_clean(text: Column) -> Column:
    """C-09: attributes and markers go, added words stay; null where a backslash survives, so that a caller can reject the verse."""
    t = sub(text, r"\|[^|]*?(?=\s|\z)")
    t = normalise(sub(t, r"\\[+\-a-zA-Z0-9]+\*?"))
    return F.when(~F.contains(t, F.lit("\\")), t)


def exact_double(text: Column) -> Column:
    """C-15: the middle of a text whose halves are equal, else null."""
    n = F.length(text)
    half = (n / 2).cast("int")
    return F.when((n >= 4) & (n % 2 == 0) & (F.substr(text, F.lit(1), half) == F.substr(text, half + 1)), half)


def prefix_repeat(text: Column, width: int = 40) -> Column:
    """C-15: whether the first `width` letters stand again in the text."""
    again = F.position(F.substr(text, F.lit(1), F.lit(width)), text, F.lit(2)) > 0
    return F.when(F.length(text) > width, again).otherwise(F.lit(False))


def double_kind(text: Column, head: Column | None = None) -> Column:
    """C-15: exact, half (near-equal halves), prefix40 or null; `head` is norm_text of the text where it is at hand."""

    def near(head: Column) -> Column:
        half = (F.length(head) / 2).cast("int")
        first = F.rtrim(F.substr(head, F.lit(1), half))
        second = F.rtrim(F.substr(F.trim(F.substr(head, half + 1)), F.lit(1), half))
        return F.when(half < 8, prefix_repeat(text)).otherwise(first == second)

    apart = let(squash(text), lambda s: (F.length(s) != F.length(text)) & exact_double(s).isNotNull())
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string"))
        .when(exact_double(text).isNotNull(), "exact")
        .when((let(norm_text(text), near) if head is None else near(head)) | apart, "half")
        .when(prefix_repeat(text), "prefix40")
    )


def gap_kind(text: Column) -> Column:
    """C-20: empty, marker or null."""
    t = F.coalesce(text, F.lit(""))
    marker = F.lit(False)
    for shape in fixed.GAP_SHAPES:
        marker = marker | has(t, shape)
    return F.when(F.trim(squash(t)) == "", "empty").when(marker, "marker")


def classify_pair(b: Column, s: Column, built_key: Column, source_key: Column, half_key: Column) -> Column:
    """C-16: how a built verse differs from its source, both as norm_text has them; keys are loose_key of the built text, the source
    and the built text's first half."""
    bs, ss = squash(b), squash(s)
    repeats = (F.length(ss) > 0) & (F.length(bs) > F.length(ss)) & F.endswith(bs, ss)
    repeats = repeats & F.startswith(ss, F.substr(bs, F.lit(1), F.length(bs) - F.length(ss)))
    return (
        F.when(b == s, "exact")
        .when((s == "") & gap_kind(b).isNotNull(), "filled")
        .when((b != "") & (s == ""), "erased")
        .when(b == F.concat(s, s), "doubled")
        .when((bs != "") & (bs == F.concat(ss, ss)), "doubled")
        .when(repeats, "prefix_repeat")
        .when(double_kind(b, b).isin("exact", "half") & ((source_key == half_key) | (source_key == built_key)), "doubled")
        .when(bs == ss, "ws")
        .when(built_key == source_key, "punct")
        .otherwise("text")
    )


def forbidden(text: Column) -> Column:
    """C-17: whether a delimiter, pilcrow, backslash or control letter stands in the text."""
    return has(text, "[{}~¶\\\\\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]")


def slug_problem(slug: Column) -> Column:
    """C-19: empty, ascii, unsafe or null."""
    return F.when(F.coalesce(slug, F.lit("")) == "", "empty").when(has(slug, r"[^\x00-\x7F]"), "ascii").when(has(slug, "[^A-Za-z0-9._~-]"), "unsafe")


def script_of(letter: Column) -> Column:
    """C-22: script of one letter; other letters are `other`, all else is empty."""
    code, out = F.ascii(letter), None
    for lo, hi, name in fixed.SCRIPTS:
        hit = code.between(lo, hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(has(letter, r"^\p{L}$"), "other").otherwise("")


def osis_ref(ref: Column) -> Column:
    """C-27: (book, chapter, verse) of a dotted reference; null unless all parts after the first are numbers."""
    parts = F.split(ref, r"\.")
    ok = has(ref, r"^[^.]*(?:\.[0-9]+)+$")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    return F.when(ok, F.struct(F.upper(F.get(parts, F.lit(0))).alias("book"), number(1).alias("chapter"), number(2).alias("verse")))


def is_apocryphal(osis_id: Column) -> Column:
    """C-28: a book id outside the canon, whatever its case or chapter part."""
    return F.lower(sub(osis_id, r"\.[^.]*$")).isin(*sorted(fixed.APOCRYPHA))


def escape_literal(text: Column) -> Column:
    """C-26: backslashes and double quotes escaped."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
