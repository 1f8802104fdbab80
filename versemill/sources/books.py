"""Catalogues, book documents and text trees (S-01..S-05, S-15, S-16, S-18, K-01..K-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versemill.functions import fixed
from versemill.operators import render

BOOK = "map<string, array<struct<v: string, text: string, segs: array<struct<t: string, r: boolean>>>>>"
CATALOGUE = "array<struct<n: int, id: string, name: string, short: string, chapters: int, verses: int>>"


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-01: (file, path, doc) of whole-file JSON; doc is null where a file is empty or no such JSON."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.from_json("value", schema).alias("doc"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """S-02: books in order with their canonical ids."""
    rows = json_files(spark, path, CATALOGUE).select(F.posexplode("doc").alias("pos", "b"))
    ids = F.array(*[F.lit(x) for x in fixed.BOOK_IDS])
    return rows.select(F.col("pos").alias("row"), "b.n", F.get(ids, F.col("b.n") - 1).alias("usfm"), "b.id", "b.name", "b.short", "b.chapters", "b.verses")


def book_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S-03..S-05: verses (n, usfm, chapter, v, pos, text, segs) of book files and errors (file, problem).

    A file is named by its book's number, or lies in a folder n=<number> as write_books makes them. A file that can't be read, a chapter that is no number or a verse without one are errors; the rest is kept.
    """
    number = lambda pattern: F.regexp_extract("path", pattern, 1).try_cast("int")
    files = json_files(spark, path, BOOK).withColumn("n", F.coalesce(number(r"(\d+)\.json$"), number(r"/n=(\d+)/[^/]*$")))
    ids = F.array(*[F.lit(x) for x in fixed.BOOK_IDS])
    files = files.withColumn("usfm", F.get(ids, F.col("n") - 1))
    chapters = files.filter(F.col("doc").isNotNull()).select("file", "n", "usfm", F.explode("doc").alias("ch", "rows"))
    chapters = chapters.withColumn("chapter", F.col("ch").try_cast("int"))
    cells = chapters.filter(F.col("chapter").isNotNull()).select("file", "n", "usfm", "chapter", F.posexplode("rows").alias("pos", "x"))
    cells = cells.withColumn("v", F.col("x.v").try_cast("int"))
    verses = cells.filter(F.col("v").isNotNull()).select("n", "usfm", "chapter", "v", "pos", F.coalesce("x.text", F.lit("")).alias("text"), "x.segs")
    problem = lambda d, p: d.select("file", p.alias("problem"))
    errors = problem(files.filter(F.col("doc").isNull()), F.lit("unreadable"))
    errors = errors.unionByName(problem(chapters.filter(F.col("chapter").isNull()), F.concat(F.lit("chapter "), "ch")))
    errors = errors.unionByName(problem(cells.filter(F.col("v").isNull()), F.concat(F.lit("verse row in chapter "), F.col("chapter").cast("string"))))
    return verses, errors


def missing_books(verses: DataFrame, total: int = 66) -> DataFrame:
    """S-04: canonical numbers without any verse."""
    return verses.sparkSession.range(1, total + 1).select(F.col("id").cast("int").alias("n")).join(verses.select("n").distinct(), "n", "left_anti")


def book_documents(verses: DataFrame, by: list[str]) -> DataFrame:
    """K-02: one JSON document per book, chapters and verses in order of number."""
    verse = F.struct("v", "pos", "text", "segs")
    chapters = verses.groupBy(*by, "chapter").agg(F.array_sort(F.collect_list(verse)).alias("rows"))
    rows = F.transform("rows", lambda r: F.struct(r["v"].alias("v"), r["text"].alias("text"), r["segs"].alias("segs")))
    entry = F.struct("chapter", rows.alias("rows"))
    doc = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["chapter"].cast("string").alias("key"), e["rows"].alias("value")))
    return chapters.groupBy(*by).agg(F.to_json(F.map_from_entries(doc)).alias("json"))


def write_books(verses: DataFrame, path: str, by: str = "n") -> None:
    """K-02/K-01: documents partitioned by book, overwriting whole books only."""
    book_documents(verses, [by]).write.mode("overwrite").option("compression", "none").partitionBy(by).text(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """K-05: tab-separated rows with a header."""
    ledger.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """S-16/D-21: (code, file) lines; comments and short lines go."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    parts = F.split(line, r"\s+")
    return spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= 2).select(F.get("p", F.lit(0)).alias("code"), F.get("p", F.lit(1)).alias("file"))


def literals(spark: SparkSession, path: str) -> DataFrame:
    """S-15: (file, path, number, literal) of generated `case N: return s"..."` lines.

    Lines end in a line feed; a literal may hold a carriage return. Possessive loops keep no way back, so literals of any length are read.
    """
    pattern = r'^\s*case (-?\d+): return s"([^"\\]*+(?:\\[\s\S][^"\\]*+)*+)";?\s*$'
    lines = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n").select(F.input_file_name().alias("path"), "value").filter(F.regexp_like("value", F.lit(pattern)))
    return lines.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.regexp_extract("value", pattern, 1).cast("int").alias("number"), F.regexp_extract("value", pattern, 2).alias("literal"))


def literal_modules(chapters: DataFrame, book: str = "n") -> DataFrame:
    """K-04: the text of a module for each book: one case for each chapter literal, in order."""
    line = F.concat(F.lit("    case "), F.col("chapter").cast("string"), F.lit(': return s"'), F.col("literal"), F.lit('";'))
    cases = F.transform(F.array_sort(F.collect_list(F.struct("chapter", line.alias("line")))), lambda x: x["line"])
    return chapters.groupBy(book).agg(F.concat(F.lit("switch chapter {\n"), F.array_join(cases, "\n"), F.lit("\n};")).alias("module"))


def edition_union(editions: dict[str, DataFrame]) -> DataFrame:
    """K-06/U-04: editions under one schema with their language."""
    out = None
    for lang, rows in editions.items():
        own = rows.withColumn("lang", F.lit(lang))
        out = own if out is None else out.unionByName(own)
    return out


def text_hash(rows: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """K-06: an order-free hash of texts, to prove that a rewrite left them as they were."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(text)).alias("hash"))


def text_lines(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """S-18: (file, lineno, line) of text files below a path; files that aren't UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    raw = files.filter(ext.isin(*extensions)).select(F.col("path").alias("file"), F.col("content"))
    valid = raw.filter(F.expr("is_valid_utf8(cast(content as string))")).select("file", F.split(F.decode("content", "UTF-8"), r"\r\n|\n|\r").alias("lines"))
    return valid.select("file", F.posexplode("lines").alias("i", "line")).select("file", (F.col("i") + 1).alias("lineno"), "line")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """K-07: sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def report_json(report: DataFrame) -> DataFrame:
    """K-03/K-08: rows as JSON text."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("json"))


def wrapped(verses: DataFrame, width: int = render.WIDTH) -> DataFrame:
    """Verses with their marked display lines."""
    lines = render.wrap(render.coloured_runs(F.col("text"), F.col("segs")), width)
    return verses.withColumn("lines", render.marked(lines))


def pos_in(by: list[str], order: list[str]) -> Column:
    """Position of a row among those of its group."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
