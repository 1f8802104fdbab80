"""Editions compared, converted and read from source dialects."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versemill.catalog import query
from versemill.functions import unicode as U
from versemill.operators import align
from versemill.plans import convert
from versemill.queries.repair import HALVES
from versemill.sources import books as B
from versemill.sources import dialects
from versemill.session import table

# The build is the talks without every eleventh turn; the source changes a turn by its number.
PAIRS = """talks AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn),
built AS (SELECT conv_id AS chapter, turn AS v, text AS b FROM talks WHERE (conv_id * 7 + turn) % 11 <> 0),
source AS (SELECT conv_id AS chapter, turn AS v, CASE (conv_id * 5 + turn) % 9 WHEN 0 THEN replace(text, ' ', '  ') WHEN 1 THEN replace(text, ' ', '') WHEN 2 THEN text || ' tail' WHEN 3 THEN '' WHEN 4 THEN substr(text, 1, length(text) - 1) WHEN 5 THEN upper(text) ELSE text END AS s
    FROM talks WHERE (conv_id * 3 + turn) % 13 <> 0)"""


def talk_pair(spark, sf_dir):
    c, t, text = F.col("chapter"), F.col("v"), F.col("text")
    talks = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("chapter"), F.col("turn").alias("v")).agg(F.min("text").alias("text"))
    talks = talks.withColumns({"usfm": F.lit("GEN"), "pos": F.lit(0)})
    k = (c * 5 + t) % 9
    changed = (
        F.when(k == 0, F.replace(text, F.lit(" "), F.lit("  ")))
        .when(k == 1, F.replace(text, F.lit(" "), F.lit("")))
        .when(k == 2, F.concat(text, F.lit(" tail")))
        .when(k == 3, "")
        .when(k == 4, F.substr(text, F.lit(1), F.length(text) - 1))
        .when(k == 5, F.upper(text))
        .otherwise(text)
    )
    return talks.filter((c * 7 + t) % 11 != 0), talks.filter((c * 3 + t) % 13 != 0).withColumn("text", changed)


@query(
    "roundtrip_presence",
    rf"""WITH {PAIRS}, j AS (SELECT coalesce(b.chapter, s.chapter) AS chapter, coalesce(b.v, s.v) AS v, trim(regexp_replace(b, '\s+', ' ', 'g')) AS b, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM built b FULL JOIN source s ON b.chapter = s.chapter AND b.v = s.v)
    SELECT chapter, v, CASE WHEN b IS NULL THEN 'absent' WHEN s IS NULL THEN 'extra' WHEN b = s THEN 'exact' WHEN s = '' THEN 'erased' ELSE 'other' END AS class FROM j
    WHERE s IS NOT NULL OR chapter IN (SELECT chapter FROM source)""",
)
def roundtrip_presence(spark, sf_dir):
    classes = align.roundtrip(*talk_pair(spark, sf_dir))
    kept = F.col("class").isin("absent", "extra", "exact", "erased")
    return classes.select("chapter", "v", F.when(kept, F.col("class")).otherwise("other").alias("class"))


def _loose(x: str) -> str:
    """Letters and digits alone, without case and accents, for the letters that the tables hold."""
    return rf"regexp_replace(replace(lower(strip_accents({x})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]', '', 'g')"


CLASSES = rf"""{PAIRS}, j AS (SELECT coalesce(b.chapter, s.chapter) AS chapter, coalesce(b.v, s.v) AS v, trim(regexp_replace(b, '\s+', ' ', 'g')) AS b, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM built b FULL JOIN source s ON b.chapter = s.chapter AND b.v = s.v),
units AS (SELECT chapter AS doc_id, v AS i, b AS t FROM j WHERE b IS NOT NULL), {HALVES},
q AS (SELECT j.*, kind, replace(b, ' ', '') AS bs, replace(s, ' ', '') AS ss, {_loose('b')} AS bk, {_loose('s')} AS sk, {_loose('left(b, length(b) // 2)')} AS hk FROM j LEFT JOIN kinds ON doc_id = chapter AND i = v),
classes AS (SELECT chapter, v, CASE WHEN b IS NULL THEN 'absent' WHEN s IS NULL THEN 'extra' WHEN b = s THEN 'exact' WHEN s = '' THEN 'erased' WHEN b = s || s OR bs <> '' AND bs = ss || ss THEN 'doubled'
    WHEN length(ss) > 0 AND length(bs) > length(ss) AND ends_with(bs, ss) AND starts_with(ss, left(bs, length(bs) - length(ss))) THEN 'prefix_repeat'
    WHEN kind IN ('exact', 'half') AND (sk = hk OR sk = bk) THEN 'doubled' WHEN bs = ss THEN 'ws' WHEN bk = sk THEN 'punct' ELSE 'text' END AS class
    FROM q WHERE s IS NOT NULL OR chapter IN (SELECT chapter FROM source))"""


@query("roundtrip_classes", f"WITH {CLASSES} SELECT chapter, v, class FROM classes")
def roundtrip_classes(spark, sf_dir):
    return align.roundtrip(*talk_pair(spark, sf_dir)).select("chapter", "v", "class")


_KINDS = ["exact", "ws", "punct", "doubled", "prefix_repeat", "text", "filled", "erased", "absent", "extra"]


@query(
    "roundtrip_counts",
    f"""WITH {CLASSES} SELECT 'GEN' AS usfm, count(*) FILTER (class <> 'extra') AS source_verses, {', '.join(f"count(*) FILTER (class = '{c}') AS n_{c}" for c in _KINDS)},
    round(count(*) FILTER (class = 'exact') / count(*) FILTER (class <> 'extra'), 5) AS accuracy FROM classes""",
)
def roundtrip_counts(spark, sf_dir):
    return align.roundtrip_counts(align.roundtrip(*talk_pair(spark, sf_dir)), ["usfm"])


@query(
    "containment_owner",
    """WITH t AS (SELECT conv_id, turn AS v, lower(min(text)) AS norm FROM conversations GROUP BY conv_id, turn), a AS (SELECT conv_id, v, norm || ' ' || coalesce(lead(norm) OVER (PARTITION BY conv_id ORDER BY v), '') AS wanted FROM t)
    SELECT a.conv_id, a.v, min(t.v) AS owner FROM a JOIN t ON a.conv_id = t.conv_id AND t.v <> a.v AND t.norm <> '' AND contains(a.wanted, t.norm) GROUP BY a.conv_id, a.v""",
)
def containment_owner(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("turn").alias("v")).agg(F.lower(F.min("text")).alias("norm"))
    after = F.lead("norm").over(Window.partitionBy("conv_id").orderBy("v"))
    pairs = t.select("conv_id", "v", F.concat("norm", F.lit(" "), F.coalesce(after, F.lit(""))).alias("wanted"))
    return align.owners(pairs, t, ["conv_id"])


@query("diff_ledger")
def diff_ledger(spark, sf_dir):
    """Accentless words and sequence similarity are beyond SQL."""
    b, s = talk_pair(spark, sf_dir)
    return align.diff_ledger(b, s, ["chapter"]).select("chapter", "v", "class")


@query("realign_variants")
def realign_variants(spark, sf_dir):
    """Sequence alignment is beyond SQL."""
    b, s = talk_pair(spark, sf_dir)
    return align.realign(b, s, ["chapter"])


@query(
    "vocabulary_arbitration",
    """WITH t AS (SELECT conv_id, turn, lower(min(text)) AS text FROM conversations GROUP BY conv_id, turn), v AS (SELECT turn * 100000 + conv_id AS id, text AS l, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM t),
    w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM documents UNION SELECT unnest(string_split(text, ' ')) FROM t WHERE (conv_id + turn) % 3 <> 0),
    k AS (SELECT id, bool_and(word IN (SELECT word FROM w)) FILTER (side = 'l') AS lk, bool_and(word IN (SELECT word FROM w)) FILTER (side = 'r') AS rk
        FROM (SELECT id, 'l' AS side, unnest(string_split(l, ' ')) AS word FROM v WHERE r IS NOT NULL UNION ALL SELECT id, 'r', unnest(string_split(r, ' ')) FROM v WHERE r IS NOT NULL) GROUP BY id)
    SELECT id, CASE WHEN lk AND NOT rk THEN 'left' WHEN rk AND NOT lk THEN 'right' END AS favours FROM k""",
)
def vocabulary_arbitration(spark, sf_dir):
    """A-15: whole turns as readings of many words, each against the next one; the third text is all documents and most turns."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.lower(F.min("text")).alias("text"))
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    v = turns.select((F.col("turn") * 100000 + F.col("conv_id")).alias("id"), F.col("text").alias("left_words"), after.alias("right_words"))
    documents = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    most = turns.filter((F.col("conv_id") + F.col("turn")) % 3 != 0).select(F.explode(F.split("text", " ")).alias("word"))
    return align.arbitrate(v.filter(F.col("right_words").isNotNull()), documents.unionByName(most)).select("id", "favours")


@query(
    "fold_merges",
    r"""WITH t AS (SELECT conv_id, turn AS v, min(text) AS text FROM conversations GROUP BY conv_id, turn), e AS (SELECT conv_id, max(v) AS expected FROM t GROUP BY conv_id),
    m AS (SELECT t.conv_id, v AS source, v - 1 AS target FROM t JOIN e USING (conv_id) WHERE v = expected AND v > 0),
    j AS (SELECT t.conv_id, t.v, CASE WHEN m.source IS NULL THEN t.text ELSE trim(CASE WHEN rtrim(t.text) <> '' AND NOT regexp_matches(rtrim(t.text), '[;,:-]$') THEN rtrim(t.text) || ';' ELSE rtrim(t.text) END || ' ' || trim(s.text)) END AS text
        FROM t LEFT JOIN m ON t.conv_id = m.conv_id AND t.v = m.target LEFT JOIN t s ON s.conv_id = m.conv_id AND s.v = m.source)
    SELECT j.conv_id, j.v, text FROM j JOIN e USING (conv_id) WHERE v <= greatest(expected - 1, 0)""",
)
def fold_merges(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("turn").alias("v")).agg(F.min("text").alias("text"))
    last = t.groupBy("conv_id").agg(F.max("v").alias("last"))
    merges = last.filter("last > 0").select("conv_id", F.col("last").alias("source"), (F.col("last") - 1).alias("target"))
    return align.fold_merges(t, last.select("conv_id", F.greatest(F.col("last") - 1, F.lit(0)).alias("expected")), merges, ["conv_id"])


@query(
    "name_aliases",
    """WITH canon AS (SELECT 'T' || n_nationkey::VARCHAR AS usfm, CASE WHEN n_nationkey % 5 = 0 THEN (n_nationkey % 3 + 1)::VARCHAR || ' ' || lower(replace(n_name, '_', ' ')) ELSE n_name END AS name FROM nation),
    found AS (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN ['i', 'ii', 'iii'][n_nationkey % 3 + 1] || ' ' || upper(replace(n_name, '_', ' ')) WHEN n_nationkey % 5 = 1 THEN 'song of ' || n_name WHEN n_nationkey % 5 = 2 THEN ' ' || lower(n_name) || '!' ELSE 'other ' || n_name END AS name FROM nation)
    SELECT n_nationkey, CASE WHEN n_nationkey % 5 <= 2 THEN 'T' || n_nationkey::VARCHAR END AS usfm FROM found""",
)
def name_aliases(spark, sf_dir):
    k, name = F.col("n_nationkey"), F.col("n_name")
    nation = table(spark, sf_dir, "nation")
    plain = F.replace(name, F.lit("_"), F.lit(" "))
    canon = nation.select(F.concat(F.lit("T"), k.cast("string")).alias("usfm"), F.when(k % 5 == 0, F.concat((k % 3 + 1).cast("string"), F.lit(" "), F.lower(plain))).otherwise(name).alias("name"))
    roman = F.get(F.array(F.lit("i"), F.lit("ii"), F.lit("iii")), k % 3)
    said = (
        F.when(k % 5 == 0, F.concat(roman, F.lit(" "), F.upper(plain)))
        .when(k % 5 == 1, F.concat(F.lit("song of "), name))
        .when(k % 5 == 2, F.concat(F.lit(" "), F.lower(name), F.lit("!")))
        .otherwise(F.concat(F.lit("other "), name))
    )
    return align.match_names(nation.select("n_nationkey", said.alias("name")), canon).select("n_nationkey", "usfm")


@query(
    "edition_union",
    """SELECT lang, n, true AS same FROM (SELECT 'documents' AS lang, count(*) AS n FROM documents UNION ALL SELECT 'bench', count(*) FROM benchmark
    UNION ALL SELECT 'talks', count(*) FROM conversations)""",
)
def edition_union(spark, sf_dir):
    """K-06, U-04: tables as editions under one schema; the hash of each one's texts proves that all came through as they were."""
    parts = {e: table(spark, sf_dir, t).select("text") for e, t in (("documents", "documents"), ("bench", "benchmark"), ("talks", "conversations"))}
    after = B.text_hash(B.edition_union(parts), ["lang"])
    before = None
    for e, rows in parts.items():
        own = B.text_hash(rows.withColumn("lang", F.lit(e)), ["lang"])
        before = own if before is None else before.unionByName(own)
    was = before.select("lang", F.col("n").alias("was_n"), F.col("hash").alias("was_hash"))
    return after.join(was, "lang").select("lang", "n", ((F.col("n") == F.col("was_n")) & (F.col("hash") == F.col("was_hash"))).alias("same"))


@query(
    "book_documents",
    """SELECT conv_id, count(*) AS verses, sum(length(text))::BIGINT AS chars FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn) GROUP BY conv_id""",
)
def book_documents(spark, sf_dir):
    """K-02 and S-03: talks to JSON book documents and back to verses."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("turn").cast("int").alias("v")).agg(F.min("text").alias("text"))
    rows = turns.withColumns({"chapter": F.lit(1), "pos": F.lit(0), "segs": F.lit(None).cast("array<struct<t: string, r: boolean>>")})
    docs = B.book_documents(rows, ["conv_id"]).select("conv_id", F.from_json("json", B.BOOK).alias("doc"))
    back = docs.select("conv_id", F.explode("doc").alias("ch", "rows")).select("conv_id", F.explode("rows").alias("x"))
    return back.groupBy("conv_id").agg(F.count("*").alias("verses"), F.sum(F.length("x.text")).alias("chars"))


def _parsed(spark, sf_dir):
    """Talks as a parsed source: a book for each of the first conversations, others outside the canon."""
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    usfm = F.concat(F.lit("T"), (F.col("conv_id") % 40).cast("string"))
    chapter = (F.floor(F.col("conv_id") / 40) + 1).cast("int")
    return talks.select(usfm.alias("usfm"), chapter.alias("chapter"), (F.col("turn") + 1).cast("int").alias("v"), F.lit(0).alias("pos"), "text")


_CONVERT = """talks AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn),
parsed AS (SELECT 'T' || (conv_id % 40)::VARCHAR AS usfm, (conv_id // 40 + 1)::INT AS chapter, (turn + 1)::INT AS v, text FROM talks),
canon AS (SELECT n_nationkey + 1 AS n, 'T' || n_nationkey::VARCHAR AS usfm, n_regionkey + 1 AS chapters FROM nation), own AS (SELECT p.* FROM parsed p SEMI JOIN canon USING (usfm) WHERE v % 3 <> 0),
given AS (SELECT p.* FROM parsed p SEMI JOIN canon USING (usfm)), have AS (SELECT DISTINCT usfm, chapter FROM own), fill AS (SELECT g.* FROM given g ANTI JOIN own USING (usfm, chapter, v))"""


def converted(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    canon = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 1).alias("n"), F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("usfm"), F.col("n_name").alias("name"), F.col("n_name").alias("short"),
        (F.col("n_regionkey") + 1).alias("chapters"), F.lit(9).alias("verses"),
    )
    return convert.convert(parsed.filter("v % 3 <> 0"), canon, parsed)


@query("convert_books", f"WITH {_CONVERT}, all_ AS (SELECT * FROM own UNION ALL SELECT * FROM fill) SELECT n, canon.usfm, count(DISTINCT chapter) AS chapters, count(v) AS verses FROM canon LEFT JOIN all_ USING (usfm) GROUP BY n, canon.usfm")
def convert_books(spark, sf_dir):
    return converted(spark, sf_dir)["books"].select("n", "usfm", "chapters", "verses")


@query(
    "convert_disclosure",
    f"""WITH {_CONVERT}, c AS (SELECT usfm, count(DISTINCT chapter) AS found FROM own GROUP BY usfm), e AS (SELECT 'chapter_boundary' AS kind FROM canon JOIN c USING (usfm) WHERE found <> chapters
    UNION ALL SELECT 'chapter_filled' FROM (SELECT DISTINCT usfm, chapter FROM fill ANTI JOIN have USING (usfm, chapter)) UNION ALL SELECT 'verse_filled' FROM fill SEMI JOIN have USING (usfm, chapter)
    UNION ALL SELECT 'missing_chapter' FROM (SELECT usfm, unnest(range(1, chapters + 1)) AS chapter FROM canon) w ANTI JOIN (SELECT DISTINCT usfm, chapter FROM own UNION SELECT DISTINCT usfm, chapter FROM given) h ON w.usfm = h.usfm AND w.chapter = h.chapter)
    SELECT kind, count(*) AS count FROM e GROUP BY kind""",
)
def convert_disclosure(spark, sf_dir):
    return convert.disclosure_summary(converted(spark, sf_dir)["disclosure"])


@query("convert_skipped", f"WITH {_CONVERT} SELECT usfm, count(*) AS verses FROM parsed p ANTI JOIN canon USING (usfm) WHERE v % 3 <> 0 GROUP BY usfm")
def convert_skipped(spark, sf_dir):
    return converted(spark, sf_dir)["skipped"]


#: What stands before, between and after the verses of a file, by dialect.
FRAMES = {
    "osis": ("<osis><osisText><div type='book' osisID='Gen'><chapter osisID='Gen.1'>", "", "</chapter></div></osisText></osis>"),
    "usfx": ("<usfx><book id='GEN'><c id='1'/>", "", "</book></usfx>"),
    "zefania": ("<XMLBIBLE><BIBLEBOOK bnumber='1'><CHAPTER cnumber='1'>", "", "</CHAPTER></BIBLEBOOK></XMLBIBLE>"),
    "usfm": ("\\id GEN\n\\c 1\n", "\n", "\n"),
    "sjson": ('{"books":[{"name":"Genesis","chapters":[{"chapter":1,"verses":[', ",", "]}]}]}"),
    "uxlc": ("<Tanach><book n='GEN'><c n='1'>", "", "</c></book></Tanach>"),
}


_SPACES = "[\\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_NOT_XML = r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def _escaped(text, pairs):
    for mark, code in pairs:
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def written(text, v):
    """The verse in each dialect with that dialect's escapes."""
    xml = _escaped(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")])
    flat = F.btrim(F.regexp_replace(text, _SPACES, " "))
    words = F.replace(F.btrim(F.regexp_replace(xml, _SPACES, " ")), F.lit(" "), F.lit("</w><w>"))
    return {
        "osis": F.concat(F.lit("<verse osisID='Gen.1."), v, F.lit("'>"), xml, F.lit("<note>n</note></verse>")),
        "usfx": F.concat(F.lit("<v id='"), v, F.lit("'/>"), xml, F.lit("<ve/>")),
        "zefania": F.concat(F.lit("<VERS vnumber='"), v, F.lit("'>"), xml, F.lit("</VERS>")),
        "usfm": F.concat(F.lit("\\v "), v, F.lit(" "), _escaped(flat, [("\\", "\\\\"), ("|", "\\|")])),
        "sjson": F.to_json(F.struct(v.cast("int").alias("verse"), xml.alias("text"))),
        "uxlc": F.concat(F.lit("<v n='"), v, F.lit("'>"), F.when(words == "", "").otherwise(F.concat(F.lit("<w>"), words, F.lit("</w>"))), F.lit("</v>")),
    }


@query(
    "dialect_verses",
    rf"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(coalesce(min(text), ''), '{_NOT_XML}', ' ', 'g'), '{_SPACES}', ' ', 'g')) AS text FROM conversations GROUP BY conv_id, turn),
    k AS (SELECT conv_id, turn, regexp_replace(text, ' ([,.;:!?%»›])', '\1', 'g') AS text FROM t)
    SELECT dialect, conv_id, turn, length(text) AS chars, md5(text) AS digest FROM k, (SELECT unnest(['osis', 'usfx', 'zefania', 'usfm', 'sjson', 'uxlc']) AS dialect)""",
)
def dialect_verses(spark, sf_dir):
    return whole_verses(table(spark, sf_dir, "conversations"))


def whole_verses(conversations):
    """S-06..S-11: whole turns with all their characters, written in six dialects and read back; every dialect gives the same verses.

    Runs of spaces are one, none stands before punctuation, and characters that XML can't hold count as spaces. A file's dialect is sniffed
    from what stands before its verses, so that a turn's text can't pass for markup.
    """
    text = F.regexp_replace(F.coalesce(F.min("text"), F.lit("")), _NOT_XML, " ")
    turns = conversations.groupBy("conv_id", "turn").agg(text.alias("text"))
    verses = F.struct("turn", *[x.alias(d) for d, x in written(F.col("text"), (F.col("turn") + 1).cast("string")).items()])
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(verses)).alias("s"))
    files = F.array(*[
        F.struct(F.lit(d).alias("name"), F.lit(head).alias("head"), F.concat(F.lit(head), F.array_join(F.col(f"s.{d}"), mark), F.lit(tail)).alias("value"))
        for d, (head, mark, tail) in FRAMES.items()
    ])
    files = talks.select("conv_id", F.explode(files).alias("f"))
    files = files.select(F.concat_ws("/", "f.name", F.col("conv_id").cast("string")).alias("file"), "f.value", dialects.sniff(F.col("f.head")).alias("dialect"))
    rows = dialects.parse_sources(files).filter(F.col("problem").isNull())
    name = F.split("file", "/")
    return rows.select(
        F.get(name, F.lit(0)).alias("dialect"), F.get(name, F.lit(1)).cast("long").alias("conv_id"), (F.col("v") - 1).cast("long").alias("turn"),
        F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"),
    )


@query("similarity_ledger")
def similarity_ledger(spark, sf_dir):
    """Similarity of neighbouring turns by matching blocks, which SQL lacks."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    after = t.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter(F.col("next").isNotNull())
    return after.select("conv_id", "turn", F.round(U.ratio("text", "next"), 4).alias("ratio"))
