"""Mixture-controlled packing by deficit round-robin.

Documents are tokenised once into a table in the shared folder; a queue holds the tokens of one source in the table's order. A
window is one sequence. Each window a queue earns credit of `length` tokens times its target share, takes the whole
tokens of its credit, and carries the rest, its deficit, to the next window; places still free go to the queues with the
largest deficits. Targets are the sources' shares of all tokens unless they are given. Where a queue runs dry, the others share its places
by their own targets from that very token on; sources without a given target make up one queue that starts when the others are
dry, so every token is packed. As the credit earned up to any window is known in closed form, so are all deficits: every partition starts
at its own tokens with the deficits that the windows before have left, and no state passes from task to task.

A source whose share is under one token a window would not fill a place in each; such sources share one queue, and if that
queue is still too small it joins the smallest of the others. So there are at most `length` queues whatever the sources. A given target under
one token a window is an error.

Defined results: a null or empty text is one token, the end id; a null source is a source; repeated rows are packed each; a very long
text is tokenised whole and cut over as many windows as it needs; an empty table gives no pieces; clashing extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versemill.llm.bpe import encoder
from versemill.llm.common import texts
from versemill.session import materialize, ship

LENGTH = 2048
END = 1
BLOCK = 256  # windows whose schedule is worked out at once
CACHE = 64 << 20  # bytes of schedule that a task keeps
SCALE = 10**9  # of given targets, which are rounded to whole numbers

TOKENS = "doc_id long, queue string, part int, before long, n long, ids binary"


def _tokenizer(path: str | None):
    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        encode = encoder(path).ids
        end = np.array([END], dtype="<u2").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), ("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            ids = [encode(t) + end for t in texts(b.column(1))]
            before, sizes = [], [len(x) // 2 for x in ids]
            queues = b.column(2).to_pylist()
            for q, n in zip(queues, sizes):
                before.append(seen.get(q, 0))
                seen[q] = before[-1] + n
            cols = [b.column(0), queues, [part] * len(ids), before, sizes, ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return run


class Schedule:
    """Tokens that each queue has given to the windows before any window, by deficit round-robin.

    Queues give in proportion to their weights, their tokens unless stated; one queue may have weight 0 and starts when those with weights are dry. A
    phase lasts from one queue's running dry to the next one's: within it, P tokens in, a queue has given weight * (P - dry) / live.
    """

    def __init__(self, totals: list[int], length: int = LENGTH, weights: list[int] | None = None):
        self.length, self.total, self.totals = length, sum(totals), totals
        self.weights = list(totals if weights is None else weights)
        self.windows = -(-self.total // length)
        self.phases: list[tuple[int, int, int]] = []  # (P at the start rounded down, tokens of dry queues, weight of live ones)
        self.ends: list[float] = []  # of the phases, in tokens for each unit of weight
        self.order = sorted((q for q, w in enumerate(self.weights) if w and totals[q]), key=lambda q: (Fraction(totals[q], self.weights[q]), q))
        at, dry, live = 0, 0, sum(self.weights[q] for q in self.order)
        for q in self.order:
            self.phases.append((at, dry, live))
            self.ends.append(totals[q] / self.weights[q])
            at = dry + live * totals[q] // self.weights[q]
            dry, live = dry + totals[q], live - self.weights[q]
        self.named = dry

    def given(self, window: np.ndarray) -> np.ndarray:
        """[window, queue] tokens given before each window; exact in integers."""
        places = np.minimum(np.asarray(window, dtype=np.int64) * self.length, self.total)
        named = np.minimum(places, self.named)
        out = np.zeros((len(places), len(self.totals)), dtype=np.int64)
        deficit = np.zeros_like(out)
        phase = np.maximum(0, np.searchsorted([at for at, _, _ in self.phases], named, side="left") - 1)
        for k in np.unique(phase).tolist() if self.phases else []:
            rows, gone, own = np.flatnonzero(phase == k), self.order[:k], self.order[k:]
            _, dry, live = self.phases[k]
            w = [self.weights[q] for q in own]
            kind = object if self.total * max(w) >= 2**62 else np.int64  # products may go beyond 64 bits
            credit = (named[rows] - dry).astype(kind)[:, None] * np.array(w, dtype=kind)[None, :]
            whole = credit // live
            out[np.ix_(rows, own)], deficit[np.ix_(rows, own)] = whole, credit - whole * live
            out[np.ix_(rows, gone)] = [self.totals[q] for q in gone]
        out[:, [q for q, w in enumerate(self.weights) if not w]] = (places - named)[:, None]
        rank = np.argsort(np.argsort(-deficit, axis=1, kind="stable"), axis=1)
        return out + (rank < (places - out.sum(axis=1))[:, None])

    def window_of(self, queue: int, at: int) -> int:
        """A window that isn't after that of a queue's token, and two before it at most, about."""
        w = self.weights[queue]
        if not w:
            return max(0, (self.named + at) // self.length - 2)
        k = min(bisect_left(self.ends, at / w), len(self.ends) - 1)
        _, dry, live = self.phases[k]
        return max(0, (dry + live * at // w) // self.length - 2)


def queue_totals(large: list[int], rest: int, length: int = LENGTH) -> list[int]:
    """Tokens of the queues: the large sources', and those of the rest in a last queue or, if too small, in the last of the others."""
    if rest and large and rest * length < sum(large) + rest:
        return [*large[:-1], large[-1] + rest]
    return [*large, rest] if rest else large


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cutter(schedule: Schedule, with_ids: bool):
    def run(batches):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        kinds = [pa.int64()] * 7 + ([pa.list_(pa.int32())] if with_ids else [])
        blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        most = max(2, CACHE // (16 * (BLOCK + 1) * len(schedule.totals)))

        def block(i: int) -> tuple[np.ndarray, np.ndarray]:
            """By queue: tokens given before each window of a block, and its place in each window."""
            if i not in blocks:
                if len(blocks) >= most:
                    blocks.pop(next(iter(blocks)))
                given = schedule.given(np.arange(i * BLOCK, i * BLOCK + BLOCK + 1))
                own = np.diff(given, axis=0)
                blocks[i] = np.ascontiguousarray(given.T), np.ascontiguousarray((np.cumsum(own, axis=1) - own).T)
            return blocks[i]

        for b in batches:
            out = []
            for doc_id, queue, at, n, raw in zip(*(b.column(k).to_pylist() for k in ("doc_id", "queue_no", "at", "n", "ids"))):
                ids = np.frombuffer(raw, dtype="<u2").astype("<u4")
                done, w = 0, schedule.window_of(queue, at)
                while done < n:
                    i = w // BLOCK
                    given, base = (x[queue] for x in block(i))
                    k, end = (int(x) for x in np.searchsorted(given, (at + done, at + n), side="right"))
                    k = max(0, k - 1)
                    for j, first, stop, place in zip(range(k, BLOCK), given[k:end].tolist(), given[k + 1 : end + 1].tolist(), base[k:end].tolist()):
                        take = min(n - done, stop - at - done)
                        if take > 0:
                            piece = ids[done : done + take]
                            row = (doc_id, done, take, zlib.crc32(piece.tobytes()), n, i * BLOCK + j, place + at + done - first)
                            out.append((*row, piece.tolist()) if with_ids else row)
                            done += take
                    w = (i + 1) * BLOCK
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names)

    return run


def _queues(sums: DataFrame, total: int, length: int, targets: Mapping[str | None, float] | None) -> tuple[list, list[int], list[int]]:
    """Sources that have queues of their own, in the order of the queues, and the queues' tokens and weights; a last queue may be the rest's."""
    by_source = sums.groupBy("queue").agg(F.sum("tokens").alias("tokens"))
    if targets is None:
        large = by_source.filter(F.col("tokens") * length >= F.lit(total)).orderBy(F.desc("tokens"), "queue").collect()  # at most `length` rows
        totals = queue_totals([r.tokens for r in large], total - sum(r.tokens for r in large), length)
        return [r.queue for r in large], totals, list(totals)
    weights = {q: round(SCALE * w / sum(targets.values())) for q, w in targets.items()}
    if not weights or min(weights.values()) * length < SCALE:
        raise ValueError("every target must be a token a window at least")
    known = F.col("queue").isin([q for q in weights if q is not None]) | (F.col("queue").isNull() if None in weights else F.lit(False))
    found = {r.queue: r.tokens for r in by_source.filter(known).collect()}  # at most `length` rows
    names = sorted(found, key=lambda q: (q is not None, q))
    rest = total - sum(found.values())
    return names, [found[q] for q in names] + [rest] * (rest > 0), [weights[q] for q in names] + [0] * (rest > 0)


def pack(
    docs: DataFrame, length: int = LENGTH, source_col: str = "source", path: str | None = None, with_ids: bool = False, targets: Mapping | None = None
) -> DataFrame:
    """One row per piece of a document in a sequence of `length` tokens; only the last sequence is short.

    `targets`: proportions of tokens by source that every window is filled to. The token table is written once; the places of a document
    come from sums by (part, queue), a table with a row for each pair, joined back without moving tokens where it is small enough for
    Spark's own broadcast limit.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col(source_col).cast("string").alias("queue"))
    tokens = materialize(src.mapInArrow(_tokenizer(path), TOKENS), "pack-tokens")
    sums = materialize(tokens.groupBy("part", "queue").agg(F.sum("n").alias("tokens")), "pack-sums")
    total = sums.agg(F.sum("tokens")).first()[0]
    if not total:
        return spark.createDataFrame([], PIECES + (", ids array<int>" if with_ids else ""))
    names, totals, weights = _queues(sums, total, length, targets)
    numbers = spark.createDataFrame([(q, i) for i, q in enumerate(names)], "name string, queue_no int")  # at most `length` rows
    numbered = sums.join(F.broadcast(numbers), F.col("queue").eqNullSafe(F.col("name")), "left")
    numbered = numbered.select("part", "queue", F.coalesce("queue_no", F.lit(len(totals) - 1)).alias("queue_no"), "tokens")
    earlier = numbered.groupBy("queue_no", "part").agg(F.sum("tokens").alias("tokens"))
    earlier = earlier.select("queue_no", "part", F.sum("tokens").over(_before("queue_no", "part")).alias("earlier"))
    inside = numbered.withColumn("inside", F.sum("tokens").over(_before("queue_no", "part", F.col("queue").asc_nulls_first())))
    base = F.coalesce("earlier", F.lit(0)) + F.coalesce("inside", F.lit(0))
    starts = inside.join(earlier, ["queue_no", "part"]).select(F.col("part").alias("p"), F.col("queue").alias("q"), "queue_no", base.alias("base"))
    starts = materialize(starts, "pack-starts")
    placed = tokens.join(starts, (F.col("part") == F.col("p")) & F.col("queue").eqNullSafe(F.col("q")))
    placed = placed.select("doc_id", "queue_no", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    return placed.mapInArrow(_cutter(Schedule(totals, length, weights), with_ids), PIECES + (", ids array<int>" if with_ids else ""))


def _before(*cols):
    """All rows before this one: by the last column, among those of equal other columns."""
    return Window.partitionBy(*cols[:-1]).orderBy(cols[-1]).rowsBetween(Window.unboundedPreceding, -1)
