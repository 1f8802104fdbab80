"""Sharding by histogram sort, in DataFrame operations only.

The sort key of a document is (hash of its text, hash of its id), so equal texts lie side by side. Splitters are found
by probing: each round counts the exact bytes below candidate key boundaries and keeps, for each splitter, the interval
between two neighbouring candidates that holds its target, until a candidate meets the tolerance. A boundary cuts a group of
equal texts only if the group itself is larger than `group_tolerance` of a shard. Then rows are exchanged once.

Defined results: a null text has no bytes and hashes as the empty text; a null id sorts as id 0 of its text; repeated rows each
get a slot of their own; texts are measured whole whatever their length; an empty table gives an empty result; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versemill.session import materialize

BITS = 10  # of a key word that a round of probes resolves
SHIFTS = [54, 44, 34, 24, 14, 4, 0]
TOP = 2**63


def sort_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, h, g): all that sharding needs, without the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(0))).alias("g"),
    )


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.001, group_tolerance: float = 0.01) -> list[tuple]:
    """Splitters (h, g or None): a row belongs right of one if h > its h, or h = its h and g >= its g.

    A round brings at most (shards - 1) * 2^BITS counts to the driver, whatever the input.
    """
    total, found = None, {}
    open_: dict[int, tuple] = {i: (None, None, 0) for i in range(1, shards)}  # target -> h prefix, g prefix, bytes below
    levels = [("h", s) for s in SHIFTS] + [("g", s) for s in SHIFTS]
    for n, (word, shift) in enumerate(levels):
        if not open_:
            break
        if n == 0:
            rows, parent = keys, [F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q")]
        elif word == "h" or n == len(SHIFTS):
            last = levels[n - 1][1]
            p = F.shiftright("h", last)
            rows = keys.filter(p.isin(sorted({x[0] for x in open_.values()})))
            parent = [p.alias("p"), F.lit(0).cast("long").alias("q")]
        else:
            q = F.shiftright("g", levels[n - 1][1])
            rows = keys.filter(F.col("h").isin(sorted({x[0] for x in open_.values()})))
            rows = rows.filter(q.isin(sorted({x[1] for x in open_.values()})))
            parent = [F.col("h").alias("p"), q.alias("q")]
        counts: dict[tuple, list] = {}
        probe = rows.groupBy(*parent, F.shiftright(word, shift).alias("b")).agg(F.sum("size").alias("n"))
        for r in probe.collect():
            counts.setdefault((r.p, r.q), []).append((r.b, r.n))
        if total is None:
            total = sum(c for bins in counts.values() for _, c in bins)
            if not total:
                return []
        slack = (group_tolerance if (word, shift) == ("h", 0) else tolerance) * total / shards
        for i, (hp, gp, below) in list(open_.items()):
            target, at = total * i / shards, below
            for b, c in sorted(counts[(0 if hp is None else hp, 0 if gp is None else gp)]):
                if at + c > target:
                    break
                at += c
            edge, err = (b, target - at) if target - at <= at + c - target else (b + 1, at + c - target)
            if err <= slack or n == len(levels) - 1:
                found[i] = (edge << shift, None) if word == "h" else (hp, edge << shift)
                del open_[i]
            else:
                open_[i] = (b, None, at) if word == "h" else (hp, b, at)
    return [found[i] for i in sorted(found)]


def _right_of(splitter: tuple) -> Column:
    h, g = splitter
    if h >= TOP:
        return F.lit(False)
    if g is None:
        return F.col("h") >= F.lit(h)
    return (F.col("h") > F.lit(h)) | ((F.col("h") == F.lit(h)) & (F.lit(False) if g >= TOP else F.col("g") >= F.lit(g)))


def shard_of(splitters: list[tuple]) -> Column:
    """Index of a row's shard as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_right_of(splitters[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(splitters))


def histogram_shards(docs: DataFrame, shards: int = 24, rows_per_cell: int = 200_000, **names: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) with shards of near equal bytes and gapless slots from 0 in each.

    Slots come from row numbers in hashed cells of bounded size plus the rows in earlier cells, so that no task orders
    a whole shard, and no group of equal texts lands in one task.
    """
    keys = materialize(sort_keys(docs, **names), "shard-keys")
    splitters = find_splitters(keys, shards)
    cells = max(16, -(-keys.count() // (shards * rows_per_cell)))
    placed = keys.select(
        "doc_id", "size", "text_crc32", "h", "g", shard_of(splitters).cast("int").alias("shard"), F.pmod("g", F.lit(cells)).alias("cell")
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "cell")
        .agg(F.count("*").alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("shard", "cell").orderBy("h", "g", "doc_id", "size", "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1)
    return ranked.join(starts, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 256 << 20) -> None:
    """Move whole rows to their shards once and write one folder for each shard, of files of about `file_bytes` of text; clashing
    column names are kept.

    Rows go by shard and a hashed cell of it, as many as its bytes need, so no task writes a whole shard.
    """
    keys = materialize(sort_keys(docs, id_col, text_col), "shard-keys")
    splitters = find_splitters(keys, shards)
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cells = max(1, -(-total // (shards * file_bytes)))
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    g = F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), h.alias("h"), g.alias("g"))
    rows = rows.select("row", shard_of(splitters).cast("int").alias("shard"), F.pmod("g", F.lit(cells)).alias("cell"))
    rows.repartition(shards * cells, "shard", "cell").select("row", "shard").write.partitionBy("shard").parquet(path)
