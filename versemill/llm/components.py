"""Connected components of a link table by alternating large and small stars, entirely in distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.session import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One round: each node's larger neighbours move to its smallest neighbour, then each node's smaller ones do."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every component is a star around its smallest node: no node has two neighbours that are smaller, or one that has one itself."""
    ends = edges.select(F.col("u").alias("v")).distinct()
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
    return edges.join(ends, "v", "left_semi").select("u").unionByName(twice.select("u")).isEmpty()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(u, v): each node that has links, but the smallest of its component, with that smallest one.

    `edges` holds links (u, v), u != v, in any direction. Every round is written to the shared folder, so no lineage grows; the
    number of rounds grows with the logarithm of the longest chain.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    while not _settled(now):
        now = materialize(_stars(now), label)
    return now
