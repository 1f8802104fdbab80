"""Readers and sinks: tables written to the shared folder in the engine's own formats and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from versemill.catalog import query
from versemill.functions import fixed
from versemill.plans import gates, verify
from versemill.queries.repair import HALVES
from versemill.session import shared_dir, table
from versemill.sources import books as B
from versemill.sources import dialects


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _talks(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("int").alias("n"), F.col("turn").cast("int").alias("v"))
    return talks.agg(F.min("text").alias("text")).withColumns({"chapter": F.lit(1), "pos": F.lit(0), "segs": F.lit(None).cast("array<struct<t: string, r: boolean>>")})


@query(
    "book_files",
    "SELECT conv_id::INT AS n, turn::INT AS v, md5(min(text)) AS digest FROM conversations GROUP BY conv_id, turn",
)
def book_files(spark, sf_dir):
    """K-01, K-02, S-03 and S-05: talks written as one document a book and read back as verses."""
    at = _folder(spark, "books")
    B.write_books(_talks(spark, sf_dir), at)
    verses, _ = B.book_rows(spark, at)
    return verses.select("n", "v", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "book_errors",
    """WITH t AS (SELECT DISTINCT conv_id::INT AS n, turn::INT AS v FROM conversations), b AS (SELECT DISTINCT n FROM t)
    SELECT CASE n % 4 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'chapter x' ELSE 'verse row in chapter 1' END AS problem, count(*) AS count FROM (SELECT n FROM b WHERE n % 4 IN (0, 1) UNION ALL SELECT n FROM t WHERE n % 4 = 2) GROUP BY 1
    UNION ALL SELECT 'verses', count(*) FROM t WHERE n % 4 = 3""",
)
def book_errors(spark, sf_dir):
    """S-01 and S-04: documents that are no JSON, have a chapter without a number or verses without one are errors; the rest is read."""
    talks, at = _talks(spark, sf_dir), _folder(spark, "broken")
    json = F.regexp_replace(F.col("json"), '"v":', F.when(F.col("n") % 4 == 2, '"w":').otherwise('"v":'))
    json = F.when(F.col("n") % 4 == 0, "{broken").when(F.col("n") % 4 == 1, F.replace(json, F.lit('{"1":'), F.lit('{"x":'))).otherwise(json)
    B.book_documents(talks, ["n"]).select("n", json.alias("value")).write.partitionBy("n").text(at)
    verses, errors = B.book_rows(spark, at)
    return errors.groupBy("problem").agg(F.count("*").alias("count")).unionByName(verses.agg(F.lit("verses").alias("problem"), F.count("*").alias("count")))


@query(
    "catalogue_files",
    f"""WITH ids AS (SELECT [{', '.join(f"'{x}'" for x in fixed.BOOK_IDS)}] AS ids) SELECT n_nationkey::INT + 1 AS n, ids[n_nationkey + 1] AS usfm, n_name AS name, n_regionkey::INT AS chapters FROM nation, ids""",
)
def catalogue_files(spark, sf_dir):
    """S-02: a catalogue written as one JSON document and read back with canonical ids."""
    at, k = _folder(spark, "catalogue"), F.col("n_nationkey").cast("int")
    rows = F.struct((k + 1).alias("n"), F.lower("n_name").alias("id"), F.col("n_name").alias("name"), F.lit("Bk").alias("short"), F.col("n_regionkey").cast("int").alias("chapters"), F.lit(9).alias("verses"))
    table(spark, sf_dir, "nation").agg(F.to_json(F.array_sort(F.collect_list(rows))).alias("value")).write.text(at)  # a catalogue of books
    return B.catalogue(spark, at).select("n", "usfm", "name", "chapters")


@query("ledger_files", r"SELECT doc_id, lang, source, n_chars FROM documents")
def ledger_files(spark, sf_dir):
    """K-05: rows written as a tab-separated ledger and read back."""
    rows, at = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), _folder(spark, "ledger")
    B.write_ledger(rows, at)
    return spark.read.schema(rows.schema).csv(at, sep="\t", header=True)


@query("registry_files", "SELECT 'c' || n_nationkey::VARCHAR AS code, lower(n_name) || '.xml' AS file FROM nation WHERE n_nationkey % 4 <> 0")
def registry_files(spark, sf_dir):
    """S-16: lines of a registry with comments, comment lines and lines without a file."""
    k, at = F.col("n_nationkey"), _folder(spark, "registry")
    file = F.concat(F.lower("n_name"), F.lit(".xml"))
    line = F.when(k % 4 == 0, F.when(k % 8 == 0, F.concat(F.lit("# "), file)).otherwise(F.lit("alone"))).otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("   "), file, F.when(k % 4 == 1, " # note").otherwise("")))
    table(spark, sf_dir, "nation").select(line.alias("value")).write.text(at)
    return B.registry(spark, at)


@query(
    "literal_files",
    r"""SELECT conv_id::INT AS book, turn::INT AS number, md5(replace(replace(replace(min(text), '\', '\\'), '"', '\"'), chr(10), '{~}')) AS digest FROM conversations GROUP BY conv_id, turn""",
)
def literal_files(spark, sf_dir):
    """S-15 and K-04: modules of chapter literals written as text and read back case by case; turns that no case can hold come beside them."""
    at = _folder(spark, "modules")
    literal = F.replace(F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("{~}"))
    rows = _talks(spark, sf_dir).select("n", F.col("v").alias("chapter"), literal.alias("literal"))
    digest = F.md5(F.col("literal").cast("binary")).alias("digest")
    B.literal_modules(rows).select("n", F.col("module").alias("value")).write.partitionBy("n").text(at)
    found = B.literals(spark, at).select(F.regexp_extract("path", r"/n=(-?\d+)/[^/]*$", 1).try_cast("int").alias("book"), "number", digest)
    beside = rows.filter(F.col("chapter").isNull() | F.col("literal").isNull())  # no number or no text
    return found.unionByName(beside.select(F.col("n").alias("book"), F.col("chapter").alias("number"), digest))


@query("tree_lines", "SELECT source, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM (SELECT source, unnest(string_split_regex(text, '\r\n|\n|\r')) AS line FROM documents) WHERE line <> '' GROUP BY source")
def tree_lines(spark, sf_dir):
    """S-18: documents as text files below a tree, read line by line; files of other extensions stay out."""
    at = _folder(spark, "tree")
    docs = table(spark, sf_dir, "documents").select("source", F.col("text").alias("value"))
    docs.write.partitionBy("source").option("maxRecordsPerFile", 1000).text(at)
    docs.select("source").distinct().write.mode("append").parquet(at)
    lines = B.text_lines(spark, at, [".txt"]).filter(F.col("line") != "")
    return lines.groupBy(F.regexp_extract("file", r"source=([^/]*)/", 1).alias("source")).agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("file_digests", "SELECT n_nationkey AS key, sha256(n_name || chr(10)) AS sha256 FROM nation")
def file_digests(spark, sf_dir):
    """K-07: digests of files as they lie on disk; a text file ends its line."""
    at = _folder(spark, "digests")
    table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(at)
    found = B.file_digests(spark, f"{at}/*/*.txt")
    return found.select(F.regexp_extract("path", r"n_nationkey=(\d+)/", 1).cast("int").alias("key"), "sha256")


@query(
    "source_choice",
    """SELECT 'c' || n_nationkey::VARCHAR AS lang, CASE n_nationkey % 4 WHEN 0 THEN 'given/' || n_name WHEN 1 THEN 'raw/c' || n_nationkey::VARCHAR || '-a.xml' WHEN 2 THEN 'raw/c' || n_nationkey::VARCHAR || '-b.xml' END AS source FROM nation""",
)
def source_choice(spark, sf_dir):
    """S-14: the source named, else the reported one if it is there, else the only raw file of a language; of two none."""
    k = F.col("n_nationkey")
    lang = F.concat(F.lit("c"), k.cast("string"))
    raw = lambda end: F.concat(F.lit("raw/"), lang, F.lit(end))
    files = F.when(k % 4 == 1, F.array(raw("-a.xml"))).otherwise(F.array(raw("-a.xml"), raw("-b.xml")))
    rows = table(spark, sf_dir, "nation").select(
        lang.alias("lang"), F.when(k % 4 == 0, F.concat(F.lit("given/"), "n_name")).alias("explicit"), F.when(k % 4 == 2, F.concat(F.lit("old/"), lang, F.lit("-b.xml"))).alias("reported"), files.alias("files")
    )
    return dialects.resolve_sources(rows).select("lang", "source")


@query("unknown_codes", "SELECT code FROM (SELECT unnest(['en', 'xx', 'de', 'zz']) AS code) WHERE code NOT IN (SELECT lang FROM documents)")
def unknown_codes(spark, sf_dir):
    """F-17: codes asked for that no source has."""
    return gates.unknown_codes(spark, ["en", "xx", "de", "zz"], table(spark, sf_dir, "documents").select(F.col("lang").alias("code")).distinct())


@query("doubled_per_book", f"WITH units AS (SELECT doc_id, 0 AS i, text AS t FROM documents), {HALVES} SELECT lang AS edition, source AS usfm, kind, count(*) AS count FROM kinds JOIN documents USING (doc_id) WHERE kind IS NOT NULL GROUP BY ALL")
def doubled_per_book(spark, sf_dir):
    """A-05: verses that repeat themselves, by book and kind, most first."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("edition"), F.col("source").alias("usfm"), F.lit(1).alias("chapter"), F.col("doc_id").alias("v"), F.lit(0).alias("pos"), "text")
    return verify.doubled_per_book(verify.doubled(rows))


@query(
    "findings_order",
    """WITH f AS (SELECT p_partkey, ['info', 'warn', 'fail', 'odd'][p_size % 4 + 1] AS severity, p_type AS "check", p_name AS title FROM part)
    SELECT p_partkey, row_number() OVER (ORDER BY CASE severity WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, "check", title, p_partkey) AS place FROM f""",
)
def findings_order(spark, sf_dir):
    """W-06: findings in the order of a report: severity, then check."""
    severity = F.get(F.array(*[F.lit(x) for x in ("info", "warn", "fail", "odd")]), F.col("p_size") % 4)
    rows = table(spark, sf_dir, "part").select("p_partkey", severity.alias("severity"), F.col("p_type").alias("check"), F.col("p_name").alias("title"))
    return verify.placed(rows, "title", "p_partkey").select("p_partkey", F.col("place").cast("long").alias("place"))


@query(
    "donor_scan",
    """WITH t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(min(text), '[^A-Za-zÀ-ÿ0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM conversations GROUP BY conv_id, turn)
    SELECT ['osis', 'usfx', 'zefania', 'sjson', 'usfm'][conv_id % 5 + 1] AS dialect, conv_id, turn + 1 AS v, md5(text) AS digest FROM t""",
)
def donor_scan(spark, sf_dir):
    """S-17: donors of any dialect below one folder, each read by its own reader, under one schema."""
    from versemill.queries.editions import FRAMES, written

    at = _folder(spark, "donors")
    text = F.btrim(F.regexp_replace(F.regexp_replace(F.min("text"), "[^A-Za-zÀ-ÿ0-9 ]", " "), r"\s+", " "))
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(text.alias("text"))
    verses = F.struct("turn", *[x.alias(d) for d, x in written(F.col("text"), (F.col("turn") + 1).cast("string")).items()])
    files = talks.groupBy("conv_id").agg(F.array_sort(F.collect_list(verses)).alias("s"))
    value = F.lit(None).cast("string")
    names = ["osis", "usfx", "zefania", "sjson", "usfm"]
    for i, d in enumerate(names):
        head, mark, tail = FRAMES[d]
        value = F.when(F.col("conv_id") % 5 == i, F.concat(F.lit(head), F.array_join(F.col(f"s.{d}"), mark), F.lit(tail))).otherwise(value)
    files.select("conv_id", value.alias("value")).write.partitionBy("conv_id").text(at)
    rows = dialects.read_donors(spark, at)
    return rows.select(
        "dialect", F.regexp_extract("file", r"conv_id=(\d+)/", 1).cast("long").alias("conv_id"), F.col("v").cast("long").alias("v"), F.md5(F.col("text").cast("binary")).alias("digest")
    )
