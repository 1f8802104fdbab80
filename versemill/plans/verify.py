"""Quality verification: check families, findings, verdicts (C-19, J-02..J-04, J-08, J-09, J-11, W-04, W-05, A-05..A-12, P-04).

Every check maps tables with an `edition` column to hits, so one plan verifies any number of editions; hits become findings
(edition, check, severity, title, count, refs). Tables are
those of FIXTURES.md; `pos` is the order of a verse in its file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versemill.functions import fixed
from versemill.functions import text as T
from versemill.functions import unicode as U
from versemill.operators import align
from versemill.session import materialize

RANK = {"info": 0, "warn": 1, "fail": 2}
TOP = 200


def ref(usfm: Column | str = "usfm", chapter: Column | str = "chapter", v: Column | str = "v") -> Column:
    return F.concat(F.col(usfm), F.lit(" "), F.col(chapter).cast("string"), F.lit(":"), F.col(v).cast("string"))


HIT = ["edition", "check", "severity", "title", "place"]


def tagged(rows: DataFrame, rules: list[tuple]) -> DataFrame:
    """Hits of all rules (check, severity, title, condition, place) in one pass over the rows: a row can break several."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    hit = lambda c, s, t, at: F.struct(F.lit(c).alias("check"), col(s).alias("severity"), F.lit(t).alias("title"), at.alias("place"))
    found = F.array_compact(F.array(*[F.when(when, hit(c, s, t, at)) for c, s, t, when, at in rules]))
    return rows.select("edition", F.explode(found).alias("h")).select("edition", "h.*")


def hits_of(rows: DataFrame, check: str, severity: Column | str, title: str, at: Column | None = None) -> DataFrame:
    """Every row as a hit."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select("edition", F.lit(check).alias("check"), sev.alias("severity"), F.lit(title).alias("title"), (at if at is not None else ref()).alias("place"))


def findings_of(hits: DataFrame) -> DataFrame:
    """One finding for each edition, check, severity and title that has hits, with its first places in order.

    Counts combine before the exchange; of places each task passes on at most TOP for a finding.
    """
    key = ["edition", "check", "severity", "title"]
    counts = hits.groupBy(*key).agg(F.count("*").alias("count"))
    w = Window.partitionBy(*key).orderBy("place")
    first = hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= TOP).groupBy(*key).agg(F.array_sort(F.collect_list("place")).alias("refs"))
    return counts.join(first, key).select(*key, "count", "refs")


def finding(rows: DataFrame, check: str, severity: Column | str, title: str, at: Column | None = None) -> DataFrame:
    """Findings of one rule."""
    return findings_of(hits_of(rows, check, severity, title, at))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def placed(findings: DataFrame, *ties: str) -> DataFrame:
    """W-06: findings with their place in a report, from 1: by severity (fail, warn, info), then check, then `ties`.

    Rows are numbered within a check; where a check starts comes from counts, a row for each check.
    """
    rank = F.when(F.col("severity") == "fail", 0).when(F.col("severity") == "warn", 1).when(F.col("severity") == "info", 2).otherwise(3)
    ranked = findings.withColumn("_rank", rank)
    counts = ranked.groupBy("_rank", "check").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_rank", "check").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_rank", F.col("check").alias("_check"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_rank", "check").orderBy(*ties))
    both = ranked.withColumn("_own", own).join(starts.withColumnRenamed("_rank", "_r"), (F.col("_rank") == F.col("_r")) & F.col("check").eqNullSafe(F.col("_check")))
    return both.withColumn("place", F.col("_start") + F.col("_own")).drop("_rank", "_r", "_check", "_start", "_own")


def verdicts(findings: DataFrame) -> DataFrame:
    """A-10: (edition, worst, exit): 0 clean, 2 warnings, 1 failures; a failure outranks a warning."""
    rank = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    worst = findings.groupBy("edition").agg(F.max(F.element_at(rank, F.col("severity"))).alias("r"))
    exit_code = F.when(F.col("r") == 2, 1).when(F.col("r") == 1, 2).otherwise(0)
    return worst.select("edition", F.element_at(F.array(*[F.lit(k) for k in RANK]), F.col("r") + 1).alias("worst"), exit_code.alias("exit"))


def batch_exit(verdict_rows: DataFrame) -> DataFrame:
    """A-10: one exit code for all editions: any failure is 1, else any warning is 2."""
    return verdict_rows.agg(F.when(F.max((F.col("exit") == 1).cast("int")) == 1, 1).when(F.max((F.col("exit") == 2).cast("int")) == 1, 2).otherwise(0).alias("exit"))


def check_counts(findings: DataFrame) -> DataFrame:
    """K-08: worst severity and findings of each check."""
    rank = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    return findings.groupBy("edition", "check").agg(F.max_by("severity", F.element_at(rank, F.col("severity"))).alias("severity"), F.count("*").alias("findings"))


# --- doubled text ----------------------------------------------------------------------------------------------------


def doubled(verses: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Candidates with their kind and what the source says: converter_double, edition_repeat, unknown, no_source_verse or null."""
    hits = verses.withColumn("kind", T.double_kind(F.col("text"))).filter(F.col("kind").isNotNull())
    if source is None:
        return hits.withColumn("origin", F.lit(None).cast("string"))
    classes = align.roundtrip(verses, source, ["edition"]).select("edition", *align.KEY, "class")
    out = hits.join(classes, ["edition", *align.KEY], "left")
    absent = F.col("class").isNull() | (F.col("class") == "extra")
    origin = F.when(absent, "no_source_verse").when(F.col("class").isin("doubled", "prefix_repeat"), "converter_double").when(F.col("class") == "exact", "edition_repeat")
    return out.withColumn("origin", origin.otherwise("unknown")).drop("class")


def doubled_per_book(hits: DataFrame) -> DataFrame:
    """A-05: candidates by book and kind."""
    return hits.groupBy("edition", "usfm", "kind").agg(F.count("*").alias("count"))


def hits_doubled(verses: DataFrame, source: DataFrame | None = None) -> DataFrame:
    hits = doubled(verses, source)
    odd = F.max((F.coalesce("origin", F.lit("edition_repeat")) != "edition_repeat").cast("int")).alias("_odd")
    judged = hits.join(hits.groupBy("edition").agg(odd), "edition")
    return hits_of(judged, "doubled_text", F.when(F.col("_odd") == 1, "fail").otherwise("warn"), "verses that repeat themselves")


# --- round trip ------------------------------------------------------------------------------------------------------

ROUNDTRIP = {
    "absent": ("missing_verses", "fail", "verses of the source that the build lacks"),
    "extra": ("roundtrip", "fail", "verses that the source lacks"),
    "text": ("roundtrip", "fail", "verses with another wording"),
    "erased": ("roundtrip", "fail", "verses that are empty but have a source text"),
    "doubled": ("roundtrip", "fail", "verses that are the source twice"),
    "prefix_repeat": ("roundtrip", "fail", "verses that start twice"),
    "filled": ("roundtrip", "warn", "verses with a placeholder where the source is empty"),
    "ws": ("roundtrip", "warn", "verses that differ in spacing"),
    "punct": ("roundtrip", "warn", "verses that differ in marks or case"),
}


def hits_roundtrip(verses: DataFrame, source: DataFrame | None) -> DataFrame:
    if source is None:
        none = verses.select("edition").distinct()
        return hits_of(none, "roundtrip", "fail", "no source to compare with", F.lit("source"))
    classes = align.roundtrip(verses, source, ["edition"])
    return tagged(classes, [(name, sev, title, F.col("class") == c, ref()) for c, (name, sev, title) in ROUNDTRIP.items()])


def absent_per_book(classes: DataFrame) -> DataFrame:
    """A-07: source verses that the build lacks, by book."""
    return classes.filter(F.col("class") == "absent").groupBy("edition", "usfm").agg(F.count("*").alias("absent"))


# --- forbidden letters and markup ------------------------------------------------------------------------------------


def text_rules() -> list[tuple]:
    """Rules that one verse alone can break: forbidden letters, markup, encoding."""
    text, entity, tag = F.col("text"), T.ANY_ENTITY, T.ANY_TAG
    runs = T.has(text, fixed.CJK_RUN)
    return [
        ("forbidden_tokens", "fail", "verses with a delimiter or control letter", T.forbidden(text), ref()),
        ("markup_residue", "fail", "verses with an entity", T.has(text, entity), F.concat(ref(), F.lit(" "), F.regexp_extract("text", entity, 0))),
        ("markup_residue", "fail", "verses with a tag", T.has(text, tag), F.concat(ref(), F.lit(" "), F.substring(F.regexp_extract("text", tag, 0), 1, 40))),
        ("encoding", "fail", "verses with C1 letters", T.has(text, r"[\u0080-\u009F]"), ref()),
        ("encoding", "fail", "verses that lost letters", F.contains(text, F.lit("\ufffd")), ref()),
        ("encoding", "warn", "verses with a run of one CJK letter", runs, ref()),
    ]


def hits_decomposed(verses: DataFrame, lang: Column | None = None) -> DataFrame:
    """C-21: texts in decomposed form; only those with marks reach Python."""
    suspects = verses.filter(T.has(F.col("text"), r"\p{M}")).withColumn("_d", U.decomposed("text")).filter("_d")
    severity = F.when((F.lit("") if lang is None else lang).isin(*sorted(fixed.PRECOMPOSED)), "fail").otherwise("warn")
    return hits_of(suspects, "encoding", severity, "verses in decomposed form")


def hits_text(verses: DataFrame, lang: Column | None = None) -> DataFrame:
    return tagged(verses, text_rules()).unionByName(hits_decomposed(verses, lang))


# --- structure -------------------------------------------------------------------------------------------------------


def duplicates(verses: DataFrame, key: list[str]) -> DataFrame:
    """W-04: keys that occur more than once."""
    return verses.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def holes(verses: DataFrame, by: list[str], v: str, source: DataFrame | None = None) -> DataFrame:
    """W-04/W-05: missing numbers below the largest, one row each, and whether the edition itself lacks them (the source does too)."""
    out = align.gap_spans(verses, by, v).select(*by, F.explode(F.sequence("first", "last")).alias(v))
    if source is None:
        return out.withColumn("edition_gap", F.lit(False))
    have = source.select(*by, F.col(v).cast("long").alias(v)).distinct().withColumn("_has", F.lit(True))
    return out.join(have, [*by, v], "left").select(*by, v, F.col("_has").isNull().alias("edition_gap"))


def totals(verses: DataFrame, by: list[str]) -> DataFrame:
    """A-01: chapters and verses."""
    return verses.groupBy(*by).agg(F.countDistinct("chapter").alias("chapters"), F.count("*").alias("verses"))


def catalogue_deltas(found: DataFrame, declared: DataFrame, key: list[str]) -> DataFrame:
    """J-03/J-08: keys whose declared chapters or verses differ from those found; one side may be missing."""
    d = declared.select(*key, F.col("chapters").cast("long").alias("want_chapters"), F.col("verses").cast("long").alias("want_verses"))
    both = d.join(found, key, "full_outer")
    same = F.col("chapters").eqNullSafe(F.col("want_chapters")) & F.col("verses").eqNullSafe(F.col("want_verses"))
    return both.filter(~same)


def hits_structure(verses: DataFrame, books: DataFrame, source: DataFrame | None = None, total: int = 66) -> DataFrame:
    per_book = totals(verses, ["edition", "n"])
    src_n = None if source is None else source
    chapter_rows = verses.select("edition", "usfm", "chapter").distinct()
    chapter_holes = holes(chapter_rows, ["edition", "usfm"], "chapter", None if src_n is None else src_n.select("edition", "usfm", "chapter").distinct())
    verse_holes = holes(verses, ["edition", "usfm", "chapter"], "v", src_n)
    ids = F.array(*[F.lit(x) for x in fixed.BOOK_IDS])
    in_file = F.concat(F.coalesce(F.get(ids, F.col("n") - 1), F.lit("?")), F.lit(" counts"))
    few = verses.select("edition", "n").distinct().groupBy("edition").agg(F.count("*").alias("k")).filter(F.col("k") != total)
    rows = books.groupBy("edition").agg(F.count("*").alias("k")).filter(F.col("k") != total)
    order = books.filter(F.col("usfm") != F.coalesce(F.get(ids, F.col("n") - 1), F.lit("")))
    problems = [
        duplicates(verses, ["edition", "usfm", "chapter", "v"]).select("edition", F.concat(ref(), F.lit(" twice")).alias("at")),
        chapter_holes.filter(~F.col("edition_gap")).select("edition", F.concat("usfm", F.lit(" chapter "), F.col("chapter").cast("string"), F.lit(" missing")).alias("at")),
        verse_holes.filter(~F.col("edition_gap")).select("edition", F.concat(ref(), F.lit(" missing")).alias("at")),
        catalogue_deltas(per_book, books, ["edition", "n"]).select("edition", in_file.alias("at")),
        few.select("edition", F.concat(F.col("k").cast("string"), F.lit(" books")).alias("at")),
        rows.select("edition", F.concat(F.col("k").cast("string"), F.lit(" catalogue rows")).alias("at")),
        order.select("edition", F.concat(F.lit("catalogue row "), F.col("n").cast("string")).alias("at")),
    ]
    gaps = union(
        [
            chapter_holes.filter("edition_gap").select("edition", F.concat("usfm", F.lit(" chapter "), F.col("chapter").cast("string")).alias("at")),
            verse_holes.filter("edition_gap").select("edition", ref().alias("at")),
        ]
    )
    return union(
        [
            hits_of(union(problems), "structure", "fail", "structural problems", F.col("at")),
            hits_of(gaps, "edition_versification", "warn", "numbers that the edition itself lacks", F.col("at")),
        ]
    )


def hits_versification(verses: DataFrame, canon: DataFrame) -> DataFrame:
    """J-03: books whose counts differ from the canon's; traditions differ, so this only warns."""
    found = totals(verses, ["edition", "usfm"])
    want = canon.select("usfm", F.col("chapters").cast("long").alias("c"), F.col("verses").cast("long").alias("w"))
    return hits_of(found.join(want, "usfm").filter((F.col("chapters") != F.col("c")) | (F.col("verses") != F.col("w"))), "versification", "warn", "books that count otherwise", F.col("usfm"))


# --- slugs -----------------------------------------------------------------------------------------------------------


def slug_problems(books: DataFrame, by: list[str]) -> DataFrame:
    """C-19: rows with a problem: empty, ascii, unsafe or duplicate (all but the first of equal ones)."""
    first = Window.partitionBy(*by, "short").orderBy("n")
    seen = F.row_number().over(first)
    problem = F.coalesce(T.slug_problem(F.col("short")), F.when(seen > 1, "duplicate"))
    return books.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def hits_slugs(books: DataFrame, canon: DataFrame) -> DataFrame:
    at = F.concat(F.lit("row "), F.col("n").cast("string"), F.lit(" "), F.col("problem"))
    drift = books.join(canon.select("n", F.col("short").alias("_s")), "n").filter(F.col("short") != F.col("_s"))
    return union(
        [
            hits_of(slug_problems(books, ["edition"]), "short_slug", "fail", "shorts that an address can't hold", at),
            hits_of(drift, "short_slug", "warn", "shorts that differ from the canon's", F.concat(F.lit("row "), F.col("n").cast("string"))),
        ]
    )


# --- gaps ------------------------------------------------------------------------------------------------------------


def gap_states(verses: DataFrame, disclosure: DataFrame, key: list[str]) -> DataFrame:
    """J-02: (key, state) with disclosed and undisclosed gaps and stale disclosures."""
    gaps = verses.filter(T.gap_kind(F.col("text")).isNotNull()).select(*key).distinct().withColumn("_gap", F.lit(True))
    told = disclosure.dropna(subset=key).select(*key).distinct().withColumn("_told", F.lit(True))
    state = F.when(F.col("_told").isNull(), "undisclosed").when(F.col("_gap").isNull(), "stale").otherwise("disclosed")
    return gaps.join(told, key, "full_outer").select(*key, state.alias("state"))


def hits_gaps(verses: DataFrame, disclosure: DataFrame) -> DataFrame:
    told = disclosure.select("edition", "usfm", "chapter", F.col("verse").alias("v"))
    states = gap_states(verses, told, ["edition", *align.KEY])
    state = F.col("state")
    return tagged(
        states,
        [
            ("undisclosed_gap", "fail", "gaps that nobody disclosed", state == "undisclosed", ref()),
            ("gaps", "warn", "disclosed gaps", state == "disclosed", ref()),
            ("gaps", "warn", "disclosures without a gap", state == "stale", ref()),
        ],
    )


def check_gaps(verses: DataFrame, disclosure: DataFrame) -> DataFrame:
    return findings_of(hits_gaps(verses, disclosure))


# --- script ----------------------------------------------------------------------------------------------------------


def script_counts(verses: DataFrame, by: str) -> DataFrame:
    """A-08: letters by script: what is left of a text without all letters that are not of the script.

    One row stays one row until the sums; all but the most usual script are only looked for in texts that have other letters.
    """
    ranges: dict[str, str] = {}
    for lo, hi, name in fixed.SCRIPTS:
        ranges[name] = ranges.get(name, "") + f"\\x{{{lo:X}}}-\\x{{{hi:X}}}"
    every = "".join(ranges.values())
    classes = {name: f"[^{r}]" for name, r in ranges.items()} | {"other": rf"[^\p{{L}}]|[{every}]"}
    text = F.coalesce("text", F.lit(""))
    unusual = T.has(text, rf"[^\x00-\x{{24F}}\x{{2000}}-\x{{206F}}]")
    left = {name: F.length(T.sub(text, c)) for name, c in classes.items()}
    sums = [F.sum(n if name == "latin" else F.when(unusual, n).otherwise(0)).cast("long").alias(name) for name, n in left.items()]
    wide = verses.groupBy(by).agg(*sums)
    long = F.explode(F.array(*[F.struct(F.lit(name).alias("script"), F.col(name).alias("letters")) for name in classes])).alias("x")
    return wide.select(by, long).select(by, "x.*").filter(F.col("letters") > 0)


def dominant_script(counts: DataFrame, by: str) -> DataFrame:
    best = F.max_by("script", F.struct("letters", "script"))
    return counts.groupBy(by).agg(best.alias("script"), F.sum("letters").alias("letters"), F.round(F.max("letters") / F.sum("letters"), 4).alias("ratio"))


WORDS = r"[\p{L}\p{M}]+"


def word_counts(verses: DataFrame, by: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), 0)).alias("word")
    return verses.select(by, words).groupBy(by, "word").agg(F.count("*").alias("n"))


def stopword_ratio(words: DataFrame, by: str) -> DataFrame:
    """A-09: share of English function words among all words."""
    own = F.sum(F.when(F.col("word").isin(*fixed.ENGLISH), F.col("n")).otherwise(0))
    return words.groupBy(by).agg(F.sum("n").alias("tokens"), F.round(own / F.sum("n"), 4).alias("ratio"))


def top_words(words: DataFrame, by: str, k: int, non_ascii: bool) -> DataFrame:
    """A-09: the k most frequent words (of those with a letter beyond ASCII), ties by word."""
    own = words.filter(F.regexp_like("word", F.lit(r"[^\x00-\x7F]"))) if non_ascii else words
    w = Window.partitionBy(by).orderBy(F.desc("n"), "word")
    return own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hits_script(verses: DataFrame, lang: Column) -> DataFrame:
    with_lang = verses.withColumn("_l", lang)
    codes = with_lang.groupBy("edition").agg(F.first("_l", ignorenulls=True).alias("lang"))
    scripts = dominant_script(script_counts(verses, "edition"), "edition")
    want = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(fixed.LANGUAGE_SCRIPT.items()) for x in pair]), F.coalesce("lang", F.lit("")))
    accents = verses.groupBy("edition").agg(F.sum(U.accented_letters("text")).alias("accents"))
    all_ = codes.join(scripts, "edition", "left").join(stopword_ratio(word_counts(verses, "edition"), "edition").withColumnsRenamed({"ratio": "english"}), "edition", "left")
    all_ = all_.join(accents, "edition", "left").withColumn("want", want)
    kinds = [
        ("fail", F.col("letters").isNull(), "no letters"),
        ("fail", F.col("want").isNotNull() & (F.col("script") != F.col("want")), "another script"),
        ("warn", (F.col("script") == F.col("want")) & (F.col("ratio") < 0.90), "mixed scripts"),
        ("fail", F.col("english") >= 0.30, "English function words"),
        ("warn", F.coalesce("lang", F.lit("")).isin(*sorted(fixed.ACCENTED)) & (F.col("accents") / F.col("letters") < 0.005), "no accents"),
    ]
    return tagged(all_, [("script", sev, title, when, F.coalesce("script", F.lit("-"))) for sev, when, title in kinds])


def check_script(verses: DataFrame, lang: Column) -> DataFrame:
    return findings_of(hits_script(verses, lang))


# --- reports ---------------------------------------------------------------------------------------------------------


def hits_reports(report: DataFrame, verses: DataFrame) -> DataFrame:
    """J-08: totals and book counts that a report claims, and repairs that it claims but the text still needs."""
    found = totals(verses, ["edition", "n"])
    sums = verses.groupBy("edition").agg(F.countDistinct("n", "chapter").alias("chapters"), F.count("*").alias("verses"))
    off = report.join(sums, "edition", "left").filter(
        ~(F.col("total_chapters").eqNullSafe(F.col("chapters")) & F.col("total_verses").eqNullSafe(F.col("verses")))
    )
    claimed = report.select("edition", F.explode("books").alias("b")).select("edition", "b.n", "b.chapters", "b.verses")
    c1 = verses.filter(T.has(F.col("text"), r"[\u0080-\u009F]")).select("edition").distinct()
    repaired = report.filter(F.coalesce(F.element_at("sanitize", F.lit("c1_mojibake")), F.lit(0)) > 0).join(c1, "edition", "left_semi")
    return union(
        [
            hits_of(off, "report_reconciliation", "fail", "report totals that don't hold", F.lit("totals")),
            hits_of(catalogue_deltas(found, claimed, ["edition", "n"]), "report_reconciliation", "fail", "book counts that don't hold", F.concat(F.lit("book "), F.col("n").cast("string"))),
            hits_of(repaired, "report_reconciliation", "fail", "repairs that didn't happen", F.lit("c1_mojibake")),
        ]
    )


def hits_provenance(report: DataFrame, vetted: DataFrame) -> DataFrame:
    """J-11: the source file that a report names against the registry's."""
    base = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    off = report.join(vetted.select(F.col("code").alias("lang"), base("file").alias("_f")), "lang").filter(base("source") != F.col("_f"))
    return hits_of(off, "provenance", "warn", "reports that name another source", F.col("source"))


def check_provenance(report: DataFrame, vetted: DataFrame) -> DataFrame:
    return findings_of(hits_provenance(report, vetted))


def hits_source(parsed: DataFrame) -> DataFrame:
    """Problems of a source's own reading: (edition, problem) rows of the dialect readers."""
    bad = parsed.filter(F.col("problem").isNotNull())
    at = F.concat_ws(" ", "usfm", F.col("chapter").cast("string"), F.col("v").cast("string"), "problem")
    return hits_of(bad, "source_parse", "fail", "source verses that can't be placed", at)


def verify(
    verses: DataFrame,
    books: DataFrame,
    canon: DataFrame,
    disclosure: DataFrame,
    report: DataFrame,
    source: DataFrame | None = None,
    vetted: DataFrame | None = None,
    lang: Column | None = None,
) -> DataFrame:
    """P-04: findings of all checks over all editions. The hits are written once, then counted and listed."""
    parts = [
        hits_doubled(verses, source),
        hits_roundtrip(verses, source),
        hits_text(verses, lang),
        hits_structure(verses, books, source),
        hits_versification(verses, canon),
        hits_slugs(books, canon),
        hits_gaps(verses, disclosure),
        hits_reports(report, verses),
    ]
    if lang is not None:
        parts.append(hits_script(verses, lang))
    if vetted is not None:
        parts.append(hits_provenance(report, vetted))
    if source is not None and "problem" in source.columns:
        parts.append(hits_source(source))
    return findings_of(materialize(union(parts), "verify-hits"))
