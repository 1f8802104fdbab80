"""Links among the members of meetings of any size, each task holding a bounded part of one.

Members of a meeting are candidates for links; `find` tells which of a few members link. A meeting of up to TILE (the members' sizes added
up) is searched in one task. A larger one is dealt into tiles, with some of its members, the pivots, in all of them: what hangs together within
tiles mostly does so over all through the pivots. Members outside the largest group that was found so are then dealt into
blocks, and every block meets every tile. Two members that link are both in the largest group or meet in some task, so the links
found join exactly what all links would join. Work beyond one pass grows with the members outside the largest group only.

Defined results: members of equal key in a meeting count once; a meeting of one has no links; no members give no links.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm.common import raw_texts
from versemill.llm.components import components
from versemill.session import materialize

PIVOTS = 32  # members of a large meeting that are in all its tiles, about

Find = Callable[[list[int], list[bytes]], list[tuple[int, int]]]


def roots(edges: DataFrame, label: str) -> DataFrame:
    """(fp, root) of every node that has links."""
    found = components(edges, label)
    ends = found.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct()
    return found.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(ends)


def _searched(find: Find):
    """Rows (place, tile, block, fp, body) in order of the first three: links (u, v) within each run."""

    def run(batches):
        held: dict[int, bytes] = {}
        at = None

        def links() -> pa.RecordBatch:
            fps = list(held)
            pairs = find(fps, list(held.values())) if len(fps) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([fps[p[i]] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

        for b in batches:
            for *key, fp, body in zip(*(b.column(i).to_pylist() for i in range(4)), raw_texts(b.column(4))):
                if key != at:
                    if len(held) > 1:
                        yield links()
                    at, held = key, {}
                held[fp] = body
        yield links()

    return run


def _search(rows: DataFrame, find: Find) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["place", "tile", "block"]
    dealt = rows.select(*key, "fp", "body").repartition(n, *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(_searched(find), "u long, v long")


def _part(salt: int, parts) -> F.Column:
    return F.pmod(F.xxhash64("fp", F.lit(salt)), parts)


def _all(parts) -> F.Column:
    return F.sequence(F.lit(0).cast("long"), parts - 1)


def links(members: DataFrame, find: Find, tile: int, label: str) -> DataFrame:
    """Links (u, v) by `find` that hold together what links join, from members (place, fp, size, body) of meetings, which are read more than once.

    find(keys, bodies) gives links as places in its lists, enough to join all that link among them.
    """
    counts = members.groupBy("place").agg(F.sum("size").alias("weight"), F.count("*").alias("n")).filter("n > 1")
    counts = counts.withColumn("tiles", F.ceil(F.col("weight") / tile))
    met = members.join(counts, "place")
    own = _part(1, F.col("tiles"))
    everywhere = (F.col("tiles") > 1) & (_part(2, F.col("n")) < PIVOTS)
    first = met.withColumn("tile", F.explode(F.when(everywhere, _all(F.col("tiles"))).otherwise(F.array(own)))).withColumn("block", F.lit(0).cast("long"))
    found = _search(first, find)
    if counts.filter("tiles > 1").isEmpty():
        return found
    found = materialize(found, f"{label}-found")
    large = met.filter("tiles > 1")
    named = roots(found.join(large.select("fp").distinct(), F.col("u") == F.col("fp"), "left_semi"), f"{label}-parts")
    parts = large.join(named, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sizes = parts.groupBy("place", "root").agg(F.sum("size").alias("part"))
    main = sizes.groupBy("place").agg(F.max(F.struct("part", "root")).alias("main"))
    parts = parts.join(main, "place").withColumn("blocks", F.ceil((F.col("weight") - F.col("main.part")) / tile)).filter("blocks > 0")
    left = F.col("root") != F.col("main.root")
    tiles = parts.withColumn("tile", own).withColumn("block", F.explode(_all(F.col("blocks"))))
    blocks = parts.filter(left).withColumn("block", _part(3, F.col("blocks"))).withColumn("tile", F.explode(_all(F.col("tiles"))))
    again = tiles.unionByName(blocks)
    return found.unionByName(_search(again, find))
