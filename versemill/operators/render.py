"""Display: wrapped lines, chapter literals, page packing (A-02, C-25, C-26, C-32, D-18, W-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versemill.functions import text as T

WIDTH, ROWS = 88, 10
VERSE_MARK, LINE_MARK, RED_OPEN, RED_CLOSE = "{|}", "{~}", "{r}", "{/r}"
RUNS = "array<struct<red: boolean, text: string>>"


def coloured_runs(text: Column, segs: Column | None = None) -> Column:
    """Runs of one colour with single spaces: of the spans where a verse has any, else its text in plain; margin notes go."""
    tidy = lambda t: F.trim(F.regexp_replace(T.strip_margins(t), r"\s+", " "))
    run = lambda red, t: F.struct(red.alias("red"), t.alias("text"))
    plain = F.array(run(F.lit(False), tidy(text))).cast(RUNS)
    if segs is None:
        return plain
    spans = F.filter(F.transform(segs, lambda s: run(F.coalesce(s["r"], F.lit(False)), tidy(s["t"]))), lambda s: s["text"] != "")

    def join(runs: Column, s: Column) -> Column:
        last = F.element_at(runs, -1)
        longer = F.array_append(F.slice(runs, F.lit(1), F.size(runs) - 1), run(s["red"], F.concat(last["text"], F.lit(" "), s["text"])))
        same = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["red"] == s["red"])
        return F.when(same, longer).otherwise(F.array_append(runs, s)).cast(RUNS)

    return F.when(F.size(F.coalesce(segs, F.array())) > 0, F.aggregate(spans, F.array().cast(RUNS), join)).otherwise(plain)


def wrap(runs: Column, width: int = WIDTH) -> Column:
    """C-25: greedy lines of one colour, at most `width` letters unless a single word is longer.

    A line is the longest stretch up to the width that ends before a space; the matcher goes on from there.
    """
    line = rf"(?s)\S.{{0,{width - 1}}}(?= |\z)|\S{{{width + 1},}}"
    of_run = lambda r: F.transform(F.regexp_extract_all(r["text"], F.lit(line), 0), lambda t: F.struct(r["red"].alias("red"), t.alias("text")))
    return F.flatten(F.transform(runs, of_run))


def marked(lines: Column) -> Column:
    """Lines as text, highlighted ones between marks."""
    return F.transform(lines, lambda x: F.when(x["red"], F.concat(F.lit(RED_OPEN), x["text"], F.lit(RED_CLOSE))).otherwise(x["text"]))


def encode_chapters(verses: DataFrame, by: list[str]) -> DataFrame:
    """C-26/D-18: one literal for each chapter from (v, lines), in the order of verses; backslashes and quotes escaped."""
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct("v", "lines"))), lambda x: F.concat(x["v"].cast("string"), F.lit(VERSE_MARK), F.array_join(x["lines"], LINE_MARK))
    )
    return verses.groupBy(*by).agg(T.escape_literal(F.array_join(parts, VERSE_MARK)).alias("literal"))


def decode_chapters(chapters: DataFrame, by: list[str]) -> DataFrame:
    """C-26: (v, lines) of chapter literals."""
    raw = F.replace(F.replace(F.col("literal"), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    cells = F.split(raw, r"\{\|\}")
    at = F.sequence(F.lit(0), (F.size(cells) / 2).cast("int") - 1)
    verse = F.transform(at, lambda i: F.struct(F.get(cells, i * 2).cast("int").alias("v"), F.split(F.get(cells, i * 2 + 1), r"\{~\}").alias("lines")))
    return chapters.select(*by, F.explode(verse).alias("x")).select(*by, "x.v", "x.lines")


def pack_pages(needs: Column, rows: int = ROWS) -> Column:
    """W-03: page of each verse from the rows it needs, in order: a page that can't take a verse ends, unless it is empty."""
    state = "struct<pages: array<int>, page: int, used: int>"
    start = F.struct(F.array().cast("array<int>").alias("pages"), F.lit(0).alias("page"), F.lit(0).alias("used")).cast(state)

    def step(a, need):
        turn = (a["used"] + need > rows) & (a["used"] > 0)
        page = a["page"] + turn.cast("int")
        return F.struct(F.array_append(a["pages"], page).alias("pages"), page.alias("page"), F.when(turn, need).otherwise(a["used"] + need).alias("used")).cast(state)

    return F.aggregate(needs, start, step, lambda a: a["pages"])


def paginate(verses: DataFrame, by: list[str], rows: int = ROWS) -> DataFrame:
    """W-03: (v, page) of each verse of (v, n_lines); a verse needs one row more than it has lines."""
    ordered = F.array_sort(F.collect_list(F.struct("v", "n_lines")))
    paged = verses.groupBy(*by).agg(ordered.alias("x")).withColumn("pages", pack_pages(F.transform("x", lambda r: (r["n_lines"] + 1).cast("int")), rows))
    return paged.select(*by, F.explode(F.arrays_zip("x", "pages")).alias("z")).select(*by, "z.x.v", F.col("z.pages").alias("page"))


def red_verses(verses: DataFrame, by: list[str]) -> DataFrame:
    """A-02/A-16: verses with a highlighted span, by edition, and whether a legend is due."""
    red = F.count_if(F.exists(F.coalesce("segs", F.array()), lambda s: F.coalesce(s["r"], F.lit(False))))
    return verses.groupBy(*by).agg(red.alias("red_verses"), (red > 0).alias("legend"))


def empty_verses(verses: DataFrame) -> DataFrame:
    """C-32: verses without text, which a build must reject."""
    return verses.filter(F.trim(T.squash(F.coalesce("text", F.lit("")))) == "")
