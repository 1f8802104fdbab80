import random
import re

import pytest
from pyspark.sql import functions as F

from versemill.functions import fixed, text as T
from versemill.functions import unicode as U


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("¶ ¶ The gate is old.", "The gate is old."),
        ("the side of the wall:+ 1.15 wall: or, fence", "the side of the wall"),
        ("he said:", "he said:"),
        ("a + 2.3 b\n+ 4.5 c", "a "),
    ],
)
def test_strip_margins(spark, given, want):
    assert one(spark, T.strip_margins, given) == want


def test_sanitize(spark):
    r = one(spark, T.sanitize, "&amp;quot;hi&amp;quot; a\u0092b &lt;b&gt;X&lt;/b&gt; {x}~ \ufffd AT&T f&ouml;")
    assert r.text == '"hi" a’b X x \ufffd AT&T f&ouml;'
    assert (r.c1_mojibake, r.entity_residue, r.tag_residue, r.replacement_char, r.stray_delimiters) == (1, 8, 2, 1, 3)
    assert one(spark, T.sanitize, "AT&T & co").entity_residue == 0


def test_clean_functions(spark):
    assert one(spark, T.normalise, " a\u00a0\t b  , c ; d ") == "a b, c; d"
    assert one(spark, T.norm_text, "\u0093a\u200b\u2003b\u0094 ") == "“a b”"
    assert one(spark, T.usfm_clean, r"Um \add mais\add* x|strong=1 \nd y\nd*") == "Um mais x y"
    assert one(spark, T.usfm_clean, "bad \\ here") is None
    assert one(spark, T.escape_literal, 'a"b\\c') == 'a\\"b\\\\c'


def brute_double(t):
    kinds = []
    half = lambda s: next((k for k in range(1, len(s)) if len(s) >= 4 and s[:k] == s[k:]), None)
    return half(t)


def test_doubles_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(200)] + ["abab", "aaaa", "ababab", "x" * 41]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.exact_double(F.col("t")).alias("k")).collect()
    assert all(r.k == brute_double(r.t) for r in rows)
    for t, want in [("Word of it. Word of it.", "half"), ("y" * 8 + "z" * 33 + " then " + "y" * 8 + "z" * 33 + "!", "prefix40"), ("plain verse here", None), ("", None), (None, None), ("가나 가나", "half")]:
        assert one(spark, T.double_kind, t) == want, t


def classify(spark, b, s):
    df = spark.createDataFrame([(b, s)], "b string, s string")
    half = F.expr("substring(b, 1, cast(length(b) / 2 as int))")
    return df.select(T.classify_pair(T.norm_text(F.col("b")), T.norm_text(F.col("s")), U.loose_key("b"), U.loose_key("s"), U.loose_key(half)).alias("c")).first().c


@pytest.mark.parametrize(
    ("b", "s", "want"),
    [
        ("A b.", "A  b.", "exact"), ("n/a", "", "filled"), ("text", "", "erased"), ("abc def abc def", "abc def", "doubled"),
        ("ab", "a b", "ws"), ("Ab c!", "áb, c", "punct"), ("one", "two", "text"), ("In the In the end", "In the end", "prefix_repeat"), ("", "", "exact"),
    ],
)
def test_classify(spark, b, s, want):
    assert classify(spark, b, s) == want


def test_probes(spark):
    for t in ["{", "}", "~", "¶", "\\", "\x07", "\x92"]:
        assert one(spark, T.forbidden, f"a{t}b")
    assert not one(spark, T.forbidden, "plain — text\n")
    assert [one(spark, T.slug_problem, x) for x in ["", "é", "a b", "a/b", "Bk_0~1.-"]] == ["empty", "ascii", "unsafe", "unsafe", None]
    assert [one(spark, T.gap_kind, x) for x in ["", " \n", "⟨missing⟩", "N/A", "—", "verse not present here", "word"]] == ["empty", "empty", *["marker"] * 4, None]
    assert [one(spark, T.script_of, c) for c in "aéж가א中ก[1😀ሀ"] == ["latin", "latin", "cyrl", "hangul", "hebr", "han", "thai", "latin", "", "", "other"]
    r = one(spark, T.osis_ref, "Gen.1.2")
    assert tuple(r) == ("GEN", 1, 2) and one(spark, T.osis_ref, "Gen.x") is None
    assert one(spark, T.is_apocryphal, "Tob.1") and not one(spark, T.is_apocryphal, "Gen.1")


def test_unicode_functions():
    assert U.py_loose_key("Straße, ÉTÉ — “x”") == "strasseetex"
    assert U.py_words("Él dijo: ¡Sí! 3") == ["el", "dijo", "si", "3"]
    assert U.py_flat_words("A-b  c") == " a b c "
    assert U.py_decomposed("e\u0301a\u0301") and not U.py_decomposed("éá") and not U.py_decomposed("e\u0301")
    assert U.py_scrub('<div type="colophon"><div type="x">a</div><hi>SECRET</hi></div>KEEP') == " KEEP"
    assert re.sub(r"\s+", " ", U.py_scrub("a <note>x <q>y</q></note> <hi>b</hi> <lb/>c")).strip() == "a b c"
    assert U.py_entities("D&amp;ois &#233; &#xe9; &zz;") == "D&ois é é &zz;"
    assert U.py_accented_letters("éa ñ1") == 2
    assert len(fixed.mojibake()[0]) == 27 and len(fixed.BOOK_IDS) == 66 == len(fixed.OSIS_IDS)
