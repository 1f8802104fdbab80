"""Editions compared: round trip, donor fill, owners of misplaced verses, realignment, ledgers (J-01, J-05, J-06, J-07, J-12, A-06, A-13, A-15, C-16, C-24, W-08, W-09)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versemill.functions import fixed
from versemill.functions import text as T
from versemill.functions import unicode as U

KEY = ["usfm", "chapter", "v"]


def last_of(rows: DataFrame, key: list[str], order: str = "pos") -> DataFrame:
    """One row per key, the last one: later duplicates win."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def roundtrip(built: DataFrame, source: DataFrame, by: list[str] = ()) -> DataFrame:
    """J-01: class of each verse of either side; what only the build has counts in chapters that the source has.

    Only pairs that aren't equal as they stand reach the Unicode keys in Python.
    """
    key = [*by, *KEY]
    side = lambda d, name: last_of(d.select(*key, "pos", F.coalesce("text", F.lit("")).alias(name)), key).drop("pos")
    b = side(built, "built").withColumn("_b", T.norm_text(F.col("built")))
    s = side(source, "source").withColumn("_s", T.norm_text(F.col("source")))
    chapters = source.select(*key[:-1]).distinct().withColumn("_chapter", F.lit(True))
    both = b.join(s, key, "full_outer").join(chapters, key[:-1], "left")
    first = F.when(F.col("built").isNull(), "absent").when(F.col("source").isNull(), F.when(F.col("_chapter"), "extra").otherwise("outside"))
    both = both.withColumn("_first", first.when(F.col("_b") == F.col("_s"), "exact"))
    open_ = lambda c: F.when(F.col("_first").isNull(), c)  # noqa: E731  texts of the others stay out of Python
    half = F.expr("substring(_b, 1, cast(length(_b) / 2 as int))")
    keyed = both.withColumns({"_bk": U.loose_key(open_(F.col("_b"))), "_sk": U.loose_key(open_(F.col("_s"))), "_hk": U.loose_key(open_(half))})
    kind = F.coalesce("_first", T.classify_pair(F.col("_b"), F.col("_s"), F.col("_bk"), F.col("_sk"), F.col("_hk")))
    return keyed.withColumn("class", kind).filter("class <> 'outside'").select(*key, "built", "source", "class")


def roundtrip_counts(classes: DataFrame, by: list[str] = ()) -> DataFrame:
    """A-06: verses by class and the share of source verses that are exact."""
    source = F.count_if(F.col("class") != "extra")
    exact = F.count_if(F.col("class") == "exact")
    counts = [F.count_if(F.col("class") == c).alias(f"n_{c}") for c in "exact ws punct doubled prefix_repeat text filled erased absent extra".split()]
    return classes.groupBy(*by).agg(source.alias("source_verses"), *counts, F.round(F.when(source > 0, exact / source).otherwise(F.lit(0.0)), 5).alias("accuracy"))


def donor_fill(primary: DataFrame, donor: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """J-05: the primary with the donor's verses where it has none, and a disclosure row for each chapter or verse filled."""
    fill = donor.join(primary.select(*key).distinct(), key, "left_anti")
    whole = fill.join(primary.select(*key[:-1]).distinct().withColumn("_has", F.lit(True)), key[:-1], "left")
    chapters = whole.filter(F.col("_has").isNull()).select(*key[:-1]).distinct().withColumns({key[-1]: F.lit(None).cast("int"), "kind": F.lit("chapter_filled")})
    verses = whole.filter(F.col("_has").isNotNull()).select(*key).withColumn("kind", F.lit("verse_filled"))
    return primary.unionByName(fill.select(primary.columns)), chapters.unionByName(verses)


def donor_anomalies(primary: DataFrame, donor: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """J-05: wanted chapters that neither side has."""
    have = primary.select(*key[:-1]).unionByName(donor.select(*key[:-1])).distinct()
    return wanted.join(have, key[:-1], "left_anti").withColumn("kind", F.lit("missing_chapter"))


def owners(pairs: DataFrame, verses: DataFrame, chapter: list[str]) -> DataFrame:
    """J-12: for pairs (chapter key, v, wanted) the first other verse of the chapter whose words equal or lie within the wanted ones."""
    other = verses.select(*chapter, F.col("v").alias("q"), F.col("norm"))
    hit = pairs.join(other, chapter).filter((F.col("q") != F.col("v")) & (F.col("norm") != "") & F.contains("wanted", "norm"))
    return hit.groupBy(*chapter, "v").agg(F.min("q").alias("owner"))


def diff_class(left_words: Column, right_words: Column, ratio: Column, owner: Column) -> Column:
    """C-24: identical, punctuation-only, orthographic, misaligned with its owner, or substantive."""
    return (
        F.when(left_words == right_words, "identical")
        .when(F.array_join(left_words, "") == F.array_join(right_words, ""), "punctuation-only")
        .when(ratio >= 0.90, "orthographic")
        .when(owner.isNotNull(), F.concat(F.lit("misaligned->"), owner.cast("string")))
        .otherwise("substantive")
    )


def diff_ledger(left: DataFrame, right: DataFrame, chapter: list[str]) -> DataFrame:
    """D-20/C-24: class of each verse pair by key; the owner is looked for only where texts differ widely."""
    l = left.select(*chapter, "v", F.col("text").alias("left_text"), U.words("text").alias("lw"))
    r = right.select(*chapter, "v", F.col("text").alias("right_text"), U.words("text").alias("rw"))
    both = l.join(r, [*chapter, "v"], "left").withColumn("rw", F.coalesce("rw", F.array().cast("array<string>")))
    same = F.array_join("lw", "") == F.array_join("rw", "")
    near = both.withColumn("ratio", F.when(same, F.lit(1.0)).otherwise(U.ratio(F.array_join("lw", ""), F.array_join("rw", ""))))
    far = near.filter(F.col("ratio") < 0.90).select(*chapter, "v", F.array_join("lw", "").alias("wanted"))
    found = owners(far, r.select(*chapter, "v", F.array_join("rw", "").alias("norm")), chapter)
    out = near.join(found, [*chapter, "v"], "left")
    cls = diff_class(F.col("lw"), F.col("rw"), F.col("ratio"), F.col("owner")).alias("class")
    return out.select(*chapter, "v", cls, "left_text", "right_text")


REALIGNED = "left_v int, right_v int, class string, left_words string, right_words string"


def _realign(left: list[tuple], right: list[tuple], vocabulary=None) -> list[tuple]:
    """W-09: rows of a chapter whose verses, matched as a sequence, differ; then by words within matched places."""
    lw, rw = [U.py_words(t) for _, t in left], [U.py_words(t) for _, t in right]
    out = []
    blocks = difflib.SequenceMatcher(None, ["".join(w) for w in lw], ["".join(w) for w in rw], autojunk=False).get_opcodes()
    for tag, a, b, c, d in blocks:
        if tag == "equal":
            continue
        for i, j in zip(range(a, b), range(c, d)):
            for op, p, q, x, y in difflib.SequenceMatcher(None, lw[i], rw[j], autojunk=False).get_opcodes():
                if op == "equal":
                    continue
                mine, theirs = lw[i][p:q], rw[j][x:y]
                kind = "insert-delete"
                if mine and theirs:
                    kind = "near-miss" if U.py_ratio("".join(mine), "".join(theirs)) >= 0.80 else "wording"
                out.append((left[i][0], right[j][0], kind, " ".join(mine), " ".join(theirs)))
        paired = min(b - a, d - c)
        out += [(left[i][0], None, "left-only", "", "") for i in range(a + paired, b)]
        out += [(None, right[j][0], "right-only", "", "") for j in range(c + paired, d)]
    return out


def realign(left: DataFrame, right: DataFrame, chapter: list[str]) -> DataFrame:
    """W-09: variants of two editions after aligning each chapter's verses; a task holds one chapter of both."""
    names = [f.split()[0] for f in REALIGNED.split(", ")]

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        # an empty side comes without columns
        sides = [[(int(v), t) for v, t in x.sort_values("v")[["v", "text"]].itertuples(index=False)] if "v" in x else [] for x in (a, b)]
        rows = _realign(*sides)
        out = pd.DataFrame(rows, columns=names).astype({"left_v": "Int32", "right_v": "Int32"})
        for i, (c, k) in enumerate(zip(chapter, key)):
            out.insert(i, c, k)
        return out

    kinds = dict(left.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in chapter) + ", " + REALIGNED
    cols = [*chapter, "v", "text"]
    return left.select(cols).groupBy(*chapter).cogroup(right.select(cols).groupBy(*chapter)).applyInPandas(run, schema)


def arbitrate(variants: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """A-15: which side's words all stand in a third text: left, right or null. `vocabulary` has a column word; variants a column id."""
    known = vocabulary.select("word").distinct().withColumn("known", F.lit(1))
    sides = [variants.select("id", F.lit(s).alias("side"), F.explode(F.split(f"{s}_words", " ")).alias("word")) for s in ("left", "right")]
    found = sides[0].unionByName(sides[1]).join(known, "word", "left").groupBy("id").pivot("side", ["left", "right"]).agg(F.min(F.coalesce("known", F.lit(0))))
    pick = F.when((F.col("left") == 1) & (F.col("right") == 0), "left").when((F.col("right") == 1) & (F.col("left") == 0), "right")
    return variants.join(found.select("id", pick.alias("favours")), "id", "left")


def fold_merges(verses: DataFrame, expected: DataFrame, merges: DataFrame, chapter: list[str]) -> DataFrame:
    """W-08: verses beyond a chapter's expected count go; before that, merged verses join their target, after a semicolon where it
    doesn't end in a mark. `merges` has (chapter key, source, target)."""
    moved = verses.join(merges.withColumnRenamed("source", "v"), [*chapter, "v"]).select(*chapter, F.col("target").alias("v"), F.struct(F.col("v").alias("at"), F.trim("text").alias("t")).alias("part"))
    parts = moved.groupBy(*chapter, "v").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    joined = verses.join(parts, [*chapter, "v"], "left")
    add = lambda a, p: F.trim(F.concat(F.when((a != "") & ~F.regexp_like(a, F.lit("[;,:-]$")), F.concat(a, F.lit(";"))).otherwise(a), F.lit(" "), p["t"]))
    text = F.when(F.col("parts").isNull(), F.col("text")).otherwise(F.aggregate("parts", F.rtrim("text"), add))
    return joined.withColumn("text", text).drop("parts").join(expected, chapter).filter(F.col("v") <= F.col("expected")).drop("expected")


def name_keys(name: Column) -> Column:
    """J-06: keys that a book name is known by: plain, roman for a leading number, without `song of`, singular psalm."""
    base = F.trim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9 ]+", ""))
    roman = F.concat(F.element_at(F.create_map(*[F.lit(x) for x in ("1", "i", "2", "ii", "3", "iii")]), F.substring(base, 1, 1)), F.substr(base, F.lit(2)))
    forms = [base, F.when(F.regexp_like(base, F.lit("^[123] ")), roman), F.trim(F.replace(base, F.lit("song of "), F.lit(""))), F.replace(base, F.lit("psalms"), F.lit("psalm"))]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def match_names(found: DataFrame, canon: DataFrame, name_col: str = "name") -> DataFrame:
    """J-06: canonical id of each found name by alias; the longest key decides, unmatched names have null."""
    keys = canon.select(F.col("usfm"), F.explode(name_keys(F.col("name"))).alias("key"))
    names = found.select(F.col(name_col).alias("_name"), F.explode(name_keys(F.col(name_col))).alias("key")).distinct()
    best = names.join(keys, "key").groupBy("_name").agg(F.max_by("usfm", F.struct(F.length("key"), F.col("key"))).alias("usfm"))
    return found.join(best.withColumnRenamed("_name", name_col), name_col, "left")


def anchors_found(first_chapters: DataFrame, anchors: DataFrame, least: int = 2) -> DataFrame:
    """J-07: rows (usfm, text) with the anchor words found whole and whether enough are; books without anchors are skipped as such."""
    flat = first_chapters.groupBy("usfm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", "text"))), lambda x: x["text"]), " ").alias("all"))
    flat = flat.withColumn("padded", U.flat_words("all")).join(anchors, "usfm", "left")
    hits = F.size(F.filter("tokens", lambda t: F.contains(F.col("padded"), F.concat(F.lit(" "), t, F.lit(" ")))))
    return flat.select("usfm", F.when(F.col("tokens").isNotNull(), hits).alias("hits"), F.when(F.col("tokens").isNotNull(), hits >= least).alias("ok"))


def anchor_check(first_chapters: DataFrame, lang: str, anchors: DataFrame | None = None) -> DataFrame:
    """J-07 for an edition: anchors_found by the anchors given or, in English, by the openings of fixed values; `skipped` says why none were sought.

    Openings in English say nothing about an edition in another language, so without anchors of its own that edition isn't checked.
    """
    own = anchors
    if own is None and lang.lower() in fixed.ENGLISH_CODES:
        own = first_chapters.sparkSession.createDataFrame(list(fixed.OPENINGS.items()), "usfm string, tokens array<string>")
    if own is None:
        reason = F.lit(f"no anchors for {lang}").alias("skipped")
        return first_chapters.select("usfm").distinct().select("usfm", F.lit(None).cast("int").alias("hits"), F.lit(None).cast("boolean").alias("ok"), reason)
    found = anchors_found(first_chapters, F.broadcast(own))  # a row for each book
    return found.withColumn("skipped", F.when(F.col("hits").isNull(), "no anchors for this book"))


def marker_counts(verses: DataFrame, by: str, markers: list[str], text: str = "text") -> DataFrame:
    """A-13: how often marker words stand in each edition."""
    count = lambda m: F.sum(F.regexp_count(F.lower(F.col(text)), F.lit(rf"(?U)\b{m}\b"))).cast("long").alias(m)
    return verses.groupBy(by).agg(*[count(m) for m in markers])


def gap_spans(keys: DataFrame, by: list[str], v: str) -> DataFrame:
    """W-04: runs of missing numbers from 1 to the largest, by neighbours, without listing numbers."""
    steps = keys.select(*by, F.col(v).cast("long").alias("at")).distinct().withColumn("before", F.coalesce(F.lag("at").over(Window.partitionBy(*by).orderBy("at")), F.lit(0)))
    return steps.filter(F.col("at") > F.col("before") + 1).select(*by, (F.col("before") + 1).alias("first"), (F.col("at") - 1).alias("last"))
