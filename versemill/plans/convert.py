"""Conversion of a parsed source to an edition with its audit trail (P-01..P-03, P-05, P-06, J-04, A-12, A-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.functions import fixed
from versemill.functions import text as T
from versemill.operators import align
from versemill.plans.verify import totals
from versemill.sources.dialects import pairs_in

COUNTERS = "c1_mojibake entity_residue tag_residue replacement_char stray_delimiters".split()
DISCLOSURE = "kind string, usfm string, chapter int, verse int, detail map<string, string>"


def repair(verses: DataFrame, text: str = "text") -> DataFrame:
    """C-02 and C-05..C-08 on each verse; the counters of A-11 stay with it as `fixes`."""
    done = verses.withColumn("_s", T.sanitize(T.normalise(F.coalesce(F.col(text), F.lit("")))))
    return done.withColumn(text, F.col("_s.text")).withColumn("fixes", F.struct(*[F.col(f"_s.{c}").alias(c) for c in COUNTERS])).drop("_s")


def repair_totals(repaired: DataFrame, by: list[str]) -> DataFrame:
    """A-11: sums of the counters."""
    return repaired.groupBy(*by).agg(*[F.coalesce(F.sum(f"fixes.{c}"), F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def canon_table(spark, rows: list[tuple], canon_id: str = "canon") -> DataFrame:
    """D-01/D-06: a canon of (usfm, name, short, chapters, verses) in order; books are matched by id, never by position."""
    full = [(canon_id, i, u, dict(zip(fixed.BOOK_IDS, fixed.OSIS_IDS)).get(u), name, short, c, v) for i, (u, name, short, c, v) in enumerate(rows, 1)]
    return spark.createDataFrame(full, "canon_id string, n int, usfm string, osis string, name string, short string, chapters int, verses int")


def _entry(rows: DataFrame, kind: str, chapter: Column | None = None, verse: Column | None = None, **detail: Column) -> DataFrame:
    none = F.lit(None).cast("int")
    pairs = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(
        F.lit(kind).alias("kind"),
        "usfm",
        (none if chapter is None else chapter.cast("int")).alias("chapter"),
        (none if verse is None else verse.cast("int")).alias("verse"),
        (F.create_map(*pairs) if pairs else F.lit(None)).cast("map<string,string>").alias("detail"),
    )


def convert(parsed: DataFrame, canon: DataFrame, donor: DataFrame | None = None, gap_marker: str = "", notes: DataFrame | None = None) -> dict[str, DataFrame]:
    """P-01: verses, books, disclosure, report counters and problems of one source.

    `parsed` and `donor` have (usfm, chapter, v, pos, text). Books outside the canon are skipped and reported; chapters are compared
    with the canon's count; what the source lacks comes from the donor, and what both lack is marked and disclosed.
    """
    key = ["usfm", "chapter", "v"]
    placed = parsed.filter(F.col("usfm").isNotNull() & F.col("chapter").isNotNull() & F.col("v").isNotNull())
    inside = placed.join(canon.select("usfm"), "usfm", "left_semi")
    skipped = placed.join(canon.select("usfm"), "usfm", "left_anti").groupBy("usfm").agg(F.count("*").alias("verses"))
    own = repair(inside.select(*key, "pos", "text"))
    found = own.groupBy("usfm").agg(F.countDistinct("chapter").alias("found"))
    off = canon.select("usfm", F.col("chapters").alias("want")).join(found, "usfm").filter(F.col("found") != F.col("want"))
    entries = [_entry(off, "chapter_boundary", found=F.col("found"), canonical=F.col("want"))]
    if notes is not None:
        entries.append(_entry(notes, "editorial_note", note=F.col("note")))
    if donor is not None:
        given = repair(donor.join(canon.select("usfm"), "usfm", "left_semi").select(*key, "pos", "text"))
        chapters = canon.select("usfm", F.explode(F.sequence(F.lit(1), "chapters")).alias("chapter"))
        neither = align.donor_anomalies(own, given, chapters.withColumn("v", F.lit(None).cast("int")), key)
        own, fills = align.donor_fill(own, given, key)
        entries += [
            _entry(fills.filter("kind = 'chapter_filled'"), "chapter_filled", F.col("chapter")),
            _entry(fills.filter("kind = 'verse_filled'"), "verse_filled", F.col("chapter"), F.col("v")),
            _entry(neither, "missing_chapter", F.col("chapter")),
        ]
    empty = own.filter(T.gap_kind(F.col("text")).isNotNull())
    entries += [
        _entry(empty, "unfilled_gap", F.col("chapter"), F.col("v")),
        _entry(own.filter(F.contains("text", F.lit("�"))), "lost_character", F.col("chapter"), F.col("v"), n=F.col("fixes.replacement_char")),
    ]
    disclosure = entries[0]
    for e in entries[1:]:
        disclosure = disclosure.unionByName(e)
    verses = own.withColumn("text", F.when(F.trim("text") == "", F.lit(gap_marker)).otherwise(F.col("text")))
    counts = totals(verses, ["usfm"]).withColumnsRenamed({"chapters": "found_chapters", "verses": "found_verses"})
    books = canon.select("n", "usfm", "name", "short").join(counts, "usfm", "left").select(
        "n", "usfm", "name", "short", F.coalesce("found_chapters", F.lit(0)).alias("chapters"), F.coalesce("found_verses", F.lit(0)).alias("verses")
    )
    problems = parsed.filter(F.col("usfm").isNull() | F.col("chapter").isNull() | F.col("v").isNull()).select(F.lit("unplaced verse").alias("problem"), "usfm")
    absent = books.filter(F.col("verses") == 0).select(F.lit("missing book").alias("problem"), "usfm")
    return {
        "verses": verses.drop("fixes"),
        "books": books,
        "disclosure": disclosure,
        "report": repair_totals(own.withColumn("_all", F.lit("all")), ["_all"]).drop("_all"),
        "skipped": skipped,
        "problems": problems.unionByName(absent),
    }


def disclosure_summary(disclosure: DataFrame, by: list[str] = ()) -> DataFrame:
    """A-12: entries by kind."""
    return disclosure.groupBy(*by, "kind").agg(F.count("*").alias("count"))


def strict_findings(verses: DataFrame, canon: DataFrame) -> DataFrame:
    """P-02/P-03: books whose chapters or verses aren't exactly the canon's, all of which fail a strict conversion."""
    found = totals(verses, ["usfm"])
    both = canon.select("usfm", F.col("chapters").cast("long").alias("want_chapters"), F.col("verses").cast("long").alias("want_verses")).join(found, "usfm", "full_outer")
    kind = F.when(F.col("want_chapters").isNull(), "unknown book").when(F.col("chapters").isNull(), "missing book")
    kind = kind.when(F.col("chapters") != F.col("want_chapters"), "chapters").when(F.col("verses") != F.col("want_verses"), "verses")
    return both.withColumn("problem", kind).filter(F.col("problem").isNotNull()).select("usfm", "problem", "chapters", "verses")


def ketiv_counts(words: DataFrame, by: list[str]) -> DataFrame:
    """A-14: written-read pairs and lone ones from rows (by, seq, tag) by neighbours in their verse."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy("seq")
    tagged = words.withColumns({"_next": F.lead("tag").over(w), "_prev": F.lag("tag").over(w)})
    pair = (F.col("tag") == "k") & F.col("_next").eqNullSafe(F.lit("q"))
    lone_k = (F.col("tag") == "k") & ~F.col("_next").eqNullSafe(F.lit("q"))
    lone_q = (F.col("tag") == "q") & ~F.col("_prev").eqNullSafe(F.lit("k"))
    return tagged.groupBy(*by).agg(F.count_if(pair).alias("pairs"), F.count_if(lone_k).alias("lone_k"), F.count_if(lone_q).alias("lone_q"))


def count_assertions(verses: DataFrame, expected: dict[str, int], book: str = "usfm") -> DataFrame:
    """P-05/P-06: rows (name, expected, found) of the totals that don't hold; none is a pass."""
    red = F.count_if(F.exists(F.coalesce("segs", F.array().cast("array<struct<t: string, r: boolean>>")), lambda s: F.coalesce(s["r"], F.lit(False))))
    got = verses.agg(
        F.countDistinct(book).alias("books"), F.countDistinct(book, "chapter").alias("chapters"), F.count("*").alias("verses"), red.alias("red"),
        F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"),
    )
    want = {"empty": 0} | expected
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).cast("long").alias("expected"), F.col(k).alias("found")) for k, v in want.items()])
    return got.select(F.explode(rows).alias("x")).select("x.*").filter(F.col("expected") != F.col("found"))


__all__ = ["convert", "pairs_in", "repair", "repair_totals", "strict_findings"]
