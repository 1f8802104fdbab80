"""Moving through books, chapters, verses and pages (F-08..F-10, F-21, W-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def steps(chapters: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """F-08/F-09: each row with the place before and after it in `order` within `by`; both ends stay where they are.

    A place is a struct of the order columns. `by` is the edition (or another shard): one catalogue is ordered in one task.
    """
    place = F.struct(*order)
    w = Window.partitionBy(*by).orderBy(*order)
    return chapters.withColumns({"prev": F.coalesce(F.lag(place).over(w), place), "next": F.coalesce(F.lead(place).over(w), place)})


def cursor(at: Column, delta: Column | int, count: Column) -> Column:
    """F-10: verse cursor kept within 1 and the number of verses."""
    return F.greatest(F.lit(1), F.least(count, at + delta))


def pages(items: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """W-02/F-21: page number, position on it, number of pages and whether links to the pages before and after exist."""
    w = Window.partitionBy(*by).orderBy(*order)
    rank = F.row_number().over(w) - 1
    total = F.count("*").over(Window.partitionBy(*by))
    page = F.floor(rank / size).cast("int")
    count = F.greatest(F.lit(1), F.ceil(total / size)).cast("int")
    return items.withColumns({"page": page, "on_page": (rank % size).cast("int"), "pages": count}).withColumns(
        {"has_prev": F.col("page") > 0, "has_next": F.col("page") + 1 < F.col("pages")}
    )


def clamp_page(wanted: Column, pages_: Column) -> Column:
    """W-02: a wanted page cut to what there is."""
    return F.greatest(F.lit(0), F.least(wanted, pages_ - 1))
