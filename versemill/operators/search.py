"""Retrieval: all-token search and term suggestion (F-02, F-03)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"'?[A-Za-z0-9]+'?"


def tokens_of(query: str) -> list[str]:
    """Lower-cased search tokens; an apostrophe stays with the token it touches."""
    return re.findall(TOKEN, query.lower())


def matches(text: Column, query: str) -> Column:
    """True where every token of `query` is a plain substring of the lower-cased text; false for no tokens."""
    low, hit = F.lower(text), None
    for t in tokens_of(query):
        hit = F.contains(low, F.lit(t)) if hit is None else hit & F.contains(low, F.lit(t))
    return F.lit(False) if hit is None else hit


def search(df: DataFrame, query: str, text: str, order: list[str], limit: int = 24) -> DataFrame:
    """F-02: the first `limit` rows in canonical order that hold every token. A top-k, so Spark never sorts the table."""
    return df.filter(matches(F.col(text), query)).orderBy(*order).limit(limit)


def terms(df: DataFrame, text: str) -> DataFrame:
    """D-07/A-03: (term, count) over all lower-cased tokens; counts combine before the shuffle."""
    t = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), 0)).alias("term")
    return df.select(t).groupBy("term").agg(F.count("*").alias("count"))


def term_prefix(term_table: DataFrame, prefix: str, limit: int = 12) -> DataFrame:
    """F-03: the most frequent terms that start with the lower-cased prefix."""
    hit = term_table.filter(F.col("term").startswith(prefix.lower()))
    return hit.orderBy(F.desc("count"), "term").limit(limit)
