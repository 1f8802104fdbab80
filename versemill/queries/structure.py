"""Structure, gaps, catalogues and gates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from versemill.catalog import query
from versemill.functions import fixed
from versemill.operators import align
from versemill.plans import convert, gates, verify
from versemill.session import table


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("v"), "l_suppkey")


_STEPS = "steps AS (SELECT chapter, v, coalesce(lag(v) OVER (PARTITION BY chapter ORDER BY v), 0) AS before FROM (SELECT DISTINCT l_orderkey AS chapter, l_linenumber AS v FROM lineitem))"


@query("contiguity_gaps", f"WITH {_STEPS} SELECT chapter, (before + 1)::BIGINT AS first, (v - 1)::BIGINT AS last FROM steps WHERE v > before + 1")
def contiguity_gaps(spark, sf_dir):
    return align.gap_spans(lines(spark, sf_dir), ["chapter"], "v")


@query("contiguity_dups", "SELECT l_orderkey AS chapter, l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def contiguity_dups(spark, sf_dir):
    return verify.duplicates(lines(spark, sf_dir), ["chapter", "v"])


@query(
    "edition_gap_attribution",
    """WITH built AS (SELECT DISTINCT l_orderkey AS chapter, l_linenumber AS v FROM lineitem WHERE l_returnflag <> 'R'), source AS (SELECT DISTINCT l_orderkey AS chapter, l_linenumber AS v FROM lineitem),
    holes AS (SELECT chapter, unnest(range(1, max(v) + 1)) AS v FROM built GROUP BY chapter)
    SELECT h.chapter, h.v::BIGINT AS v, s.v IS NULL AS edition_gap FROM holes h LEFT JOIN built b ON h.chapter = b.chapter AND h.v = b.v LEFT JOIN source s ON h.chapter = s.chapter AND h.v = s.v WHERE b.v IS NULL""",
)
def edition_gap_attribution(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("v"), "l_returnflag")
    return verify.holes(rows.filter("l_returnflag <> 'R'"), ["chapter"], "v", rows)


@query(
    "catalogue_reconcile",
    """WITH found AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS chapters, count(*) AS verses FROM lineitem GROUP BY 1), declared AS (SELECT o_orderkey AS k, 4 AS want_chapters, 4 AS want_verses FROM orders)
    SELECT k, chapters, verses, want_chapters::BIGINT AS want_chapters, want_verses::BIGINT AS want_verses FROM declared FULL JOIN found USING (k)
    WHERE chapters IS DISTINCT FROM want_chapters OR verses IS DISTINCT FROM want_verses""",
)
def catalogue_reconcile(spark, sf_dir):
    found = verify.totals(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("chapter")), ["k"])
    declared = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(4).alias("chapters"), F.lit(4).alias("verses"))
    return verify.catalogue_deltas(found, declared, ["k"])


@query("edition_totals", "SELECT lang, count(DISTINCT source) AS books, count(*) AS verses FROM documents GROUP BY lang")
def edition_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.countDistinct("source").alias("books"), F.count("*").alias("verses"))


@query(
    "undisclosed_stale",
    """WITH gaps AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 4 = 0), told AS (SELECT DISTINCT doc_id FROM labels)
    SELECT coalesce(g.doc_id, t.doc_id) AS doc_id, CASE WHEN t.doc_id IS NULL THEN 'undisclosed' WHEN g.doc_id IS NULL THEN 'stale' ELSE 'disclosed' END AS state FROM gaps g FULL JOIN told t ON g.doc_id = t.doc_id""",
)
def undisclosed_stale(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise("x").alias("text"))
    return verify.gap_states(docs, table(spark, sf_dir, "labels"), ["doc_id"])


_FILL = """primary_ AS (SELECT source, lang, doc_id FROM documents WHERE doc_id % 3 <> 0 AND source <> 'src7'), donor AS (SELECT source, lang, doc_id FROM documents SEMI JOIN labels USING (doc_id)),
fill AS (SELECT * FROM donor ANTI JOIN primary_ USING (source, lang, doc_id))"""


def _sides(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    return docs.filter("doc_id % 3 <> 0 AND source <> 'src7'"), docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("source", "lang", "doc_id")


@query("donor_fill", f"WITH {_FILL} SELECT * FROM primary_ UNION ALL SELECT * FROM fill")
def donor_fill(spark, sf_dir):
    return align.donor_fill(*_sides(spark, sf_dir), ["source", "lang", "doc_id"])[0]


@query(
    "donor_disclosure",
    f"""WITH {_FILL}, have AS (SELECT DISTINCT source, lang FROM primary_), entries AS (SELECT DISTINCT source, lang, NULL AS doc_id, 'chapter_filled' AS kind FROM fill ANTI JOIN have USING (source, lang)
    UNION ALL SELECT source, lang, doc_id, 'verse_filled' FROM fill SEMI JOIN have USING (source, lang)) SELECT kind, count(*) AS count FROM entries GROUP BY kind""",
)
def donor_disclosure(spark, sf_dir):
    return convert.disclosure_summary(align.donor_fill(*_sides(spark, sf_dir), ["source", "lang", "doc_id"])[1])


@query(
    "strict_counts",
    """WITH found AS (SELECT 'T' || conv_id::VARCHAR AS usfm, count(DISTINCT role) AS chapters, count(*) AS verses FROM conversations GROUP BY conv_id), canon AS (SELECT 'T' || (n_nationkey * 2)::VARCHAR AS usfm, 2 AS c, 4 AS w FROM nation),
    b AS (SELECT coalesce(f.usfm, k.usfm) AS usfm, c, w, chapters, verses FROM canon k FULL JOIN found f ON f.usfm = k.usfm)
    SELECT usfm, CASE WHEN c IS NULL THEN 'unknown book' WHEN chapters IS NULL THEN 'missing book' WHEN chapters <> c THEN 'chapters' WHEN verses <> w THEN 'verses' END AS problem, chapters, verses FROM b
    WHERE c IS NULL OR chapters IS NULL OR chapters <> c OR verses <> w""",
)
def strict_counts(spark, sf_dir):
    verses = table(spark, sf_dir, "conversations").select(F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("usfm"), F.col("role").alias("chapter"))
    canon = table(spark, sf_dir, "nation").select(F.concat(F.lit("T"), (F.col("n_nationkey") * 2).cast("string")).alias("usfm"), F.lit(2).alias("chapters"), F.lit(4).alias("verses"))
    return convert.strict_findings(verses, canon)


@query(
    "count_assertions",
    """WITH g AS (SELECT count(DISTINCT source) AS books, count(DISTINCT (source, lang)) AS chapters, count(*) AS verses, count(*) FILTER (trim(text) = '') AS empty FROM documents),
    r AS (SELECT 'empty' AS name, 0 AS expected, empty AS found FROM g UNION ALL SELECT 'books', 21, books FROM g UNION ALL SELECT 'chapters', 80, chapters FROM g UNION ALL SELECT 'verses', 1000, verses FROM g UNION ALL SELECT 'red', 3, 0 FROM g)
    SELECT name, expected::BIGINT AS expected, found::BIGINT AS found FROM r WHERE expected <> found""",
)
def count_assertions(spark, sf_dir):
    verses = table(spark, sf_dir, "documents").select(F.col("source").alias("usfm"), F.col("lang").alias("chapter"), "text", F.lit(None).cast("array<struct<t: string, r: boolean>>").alias("segs"))
    return convert.count_assertions(verses, {"books": 21, "chapters": 80, "verses": 1000, "red": 3})


@query(
    "pair_counts",
    """WITH t AS (SELECT conv_id, CASE role WHEN 'user' THEN 'k' WHEN 'assistant' THEN 'q' ELSE 'w' END AS tag, turn * 10 + CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS seq FROM conversations),
    d AS (SELECT DISTINCT conv_id, seq, tag FROM t), n AS (SELECT *, lead(tag) OVER w AS nx, lag(tag) OVER w AS pv FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY seq))
    SELECT conv_id, count(*) FILTER (tag = 'k' AND nx = 'q') AS pairs, count(*) FILTER (tag = 'k' AND nx IS DISTINCT FROM 'q') AS lone_k, count(*) FILTER (tag = 'q' AND pv IS DISTINCT FROM 'k') AS lone_q FROM n GROUP BY conv_id""",
)
def pair_counts(spark, sf_dir):
    role = F.col("role")
    tag = F.when(role == "user", "k").when(role == "assistant", "q").otherwise("w")
    seq = F.col("turn") * 10 + F.when(role == "user", 0).when(role == "assistant", 1).otherwise(2)
    words = table(spark, sf_dir, "conversations").select("conv_id", seq.alias("seq"), tag.alias("tag")).distinct()
    return convert.ketiv_counts(words, ["conv_id"])


@query(
    "missing_ui_keys",
    """WITH ui AS (SELECT DISTINCT lang, substr(text, 1, 2) AS key FROM documents), want AS (SELECT l.lang, k.key FROM (SELECT DISTINCT lang FROM ui) l, (SELECT DISTINCT key FROM ui) k)
    SELECT w.lang, w.key FROM want w LEFT JOIN ui u ON w.lang = u.lang AND w.key = u.key WHERE u.key IS NULL""",
)
def missing_ui_keys(spark, sf_dir):
    return gates.missing_keys(table(spark, sf_dir, "documents").select("lang", F.substring("text", 1, 2).alias("key")))


@query(
    "cross_tree",
    """WITH declared AS (SELECT lang, count(*) AS chapters, 20 AS books FROM documents WHERE lang <> 'es' GROUP BY lang), emitted AS (SELECT lang, count(*) AS cases FROM documents WHERE doc_id % 100 <> 7 OR lang = 'fr' GROUP BY lang),
    files AS (SELECT lang, count(DISTINCT source) AS modules FROM documents GROUP BY lang), imported AS (SELECT unnest(['en', 'de', 'es']) AS lang),
    b AS (SELECT coalesce(d.lang, e.lang) AS lang, chapters, books, cases FROM declared d FULL JOIN emitted e ON d.lang = e.lang), c AS (SELECT coalesce(b.lang, f.lang) AS lang, chapters, books, cases, modules FROM b FULL JOIN files f ON b.lang = f.lang)
    SELECT lang, 'cases' AS problem FROM c WHERE chapters IS DISTINCT FROM cases UNION ALL SELECT lang, 'modules' FROM c WHERE books IS DISTINCT FROM modules UNION ALL SELECT lang, 'import' FROM c WHERE lang NOT IN (SELECT lang FROM imported)""",
)
def cross_tree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    declared = docs.filter("lang <> 'es'").groupBy("lang").agg(F.count("*").alias("chapters"), F.lit(20).alias("books"))
    cases = docs.filter("doc_id % 100 <> 7 OR lang = 'fr'").select("lang")
    imported = spark.sql("SELECT explode(array('en', 'de', 'es')) AS lang")
    return gates.cross_tree(declared, cases, docs.select("lang", F.col("source").alias("file")), imported)


# --- findings over a verse model of the driver's tables --------------------------------------------------------------

_IDS = ", ".join(f"'{x}'" for x in fixed.BOOK_IDS)
DOC_VERSES = f"verses AS (SELECT lang AS edition, (substr(source, 4)::INT + 1) AS n, [{_IDS}][substr(source, 4)::INT + 1] AS usfm, 1 AS chapter, doc_id AS v, 0 AS pos, text FROM documents)"


def doc_verses(spark, sf_dir):
    """Documents as verses: an edition for each language, a book for each source, one chapter."""
    n = F.substr("source", F.lit(4)).cast("int") + 1
    ids = F.array(*[F.lit(x) for x in fixed.BOOK_IDS])
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("edition"), n.alias("n"), F.get(ids, n - 1).alias("usfm"), F.lit(1).alias("chapter"), F.col("doc_id").alias("v"), F.lit(0).alias("pos"), "text"
    )


@query(
    "findings_gaps",
    f"""WITH {DOC_VERSES}, marked AS (SELECT edition, usfm, chapter, v FROM verses WHERE v % 40 = 0), told AS (SELECT edition, usfm, chapter, v FROM verses SEMI JOIN labels ON v = doc_id WHERE v % 20 = 0),
    s AS (SELECT coalesce(g.edition, t.edition) AS edition, CASE WHEN t.v IS NULL THEN 'undisclosed' WHEN g.v IS NULL THEN 'stale' ELSE 'disclosed' END AS state, coalesce(g.usfm, t.usfm) || ' 1:' || coalesce(g.v, t.v)::VARCHAR AS place
    FROM marked g FULL JOIN told t ON g.edition = t.edition AND g.usfm = t.usfm AND g.v = t.v)
    SELECT edition, CASE state WHEN 'undisclosed' THEN 'undisclosed_gap' ELSE 'gaps' END AS "check", CASE state WHEN 'undisclosed' THEN 'fail' ELSE 'warn' END AS severity,
    CASE state WHEN 'undisclosed' THEN 'gaps that nobody disclosed' WHEN 'disclosed' THEN 'disclosed gaps' ELSE 'disclosures without a gap' END AS title, count(*) AS count, array_to_string(list(place ORDER BY place)[1:200], '|') AS refs FROM s GROUP BY edition, state""",
)
def findings_gaps(spark, sf_dir):
    verses = doc_verses(spark, sf_dir).withColumn("text", F.when(F.col("v") % 40 == 0, "").otherwise("x"))
    told = verses.filter("v % 20 = 0").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("v")).distinct(), "v", "left_semi")
    found = verify.check_gaps(verses, told.select("edition", "usfm", "chapter", F.col("v").alias("verse")))
    return found.withColumn("refs", F.array_join("refs", "|"))


_PROBE = f"""WITH {DOC_VERSES}, bad AS (SELECT edition, 'forbidden_tokens' AS "check", 'fail' AS severity FROM verses WHERE contains(text, '|') UNION ALL
SELECT edition, 'short', 'warn' FROM verses WHERE length(text) < 60), f AS (SELECT edition, "check", severity, count(*) AS count FROM bad GROUP BY ALL)"""


def _two_checks(spark, sf_dir):
    v = doc_verses(spark, sf_dir)
    bars = verify.finding(v.filter(F.contains("text", F.lit("|"))), "forbidden_tokens", "fail", "bars")
    return bars.unionByName(verify.finding(v.filter(F.length("text") < 60), "short", "warn", "short verses"))


@query(
    "findings_rollup",
    f"{_PROBE} SELECT edition, max_by(severity, CASE severity WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS worst, CASE max(CASE severity WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS exit FROM f GROUP BY edition",
)
def findings_rollup(spark, sf_dir):
    return verify.verdicts(_two_checks(spark, sf_dir))


@query("findings_by_check", f"{_PROBE} SELECT edition, \"check\", max(severity) AS severity, count(*) AS findings FROM f GROUP BY edition, \"check\"")
def findings_by_check(spark, sf_dir):
    return verify.check_counts(_two_checks(spark, sf_dir))


@query("batch_exit", f"{_PROBE} SELECT CASE WHEN count(*) FILTER (severity = 'fail') > 0 THEN 1 WHEN count(*) FILTER (severity = 'warn') > 0 THEN 2 ELSE 0 END AS exit FROM f")
def batch_exit(spark, sf_dir):
    return verify.batch_exit(verify.verdicts(_two_checks(spark, sf_dir)))


@query("verify_editions")
def verify_editions(spark, sf_dir):
    """P-04 over four editions: the source is the build with every tenth verse reworded. Unicode keys are beyond SQL."""
    verses = doc_verses(spark, sf_dir)
    source = verses.withColumn("text", F.when(F.col("v") % 10 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))
    books = verify.totals(verses, ["edition", "n", "usfm"]).select("edition", "n", "usfm", F.concat(F.lit("Bk"), F.col("n").cast("string")).alias("short"), "chapters", "verses")
    canon = books.groupBy("n", "usfm", "short").agg(F.max("chapters").alias("chapters"), F.max("verses").alias("verses"))
    report = verses.groupBy("edition").agg(F.countDistinct("n", "chapter").alias("total_chapters"), F.count("*").alias("total_verses"))
    report = report.withColumns(
        {"books": F.array().cast("array<struct<n: int, chapters: int, verses: int>>"), "sanitize": F.create_map().cast("map<string, bigint>"), "source": F.lit("x.xml"), "lang": F.col("edition")}
    )
    disclosure = spark.createDataFrame([], "edition string, usfm string, chapter int, verse bigint")
    return verify.verify(verses, books, canon, disclosure, report, source, None, F.col("edition"))
