"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits; two of them link at MOST or fewer differing bits. The bits are split into more blocks than MOST: a pair
that links differs in at most MOST blocks, so it agrees on all bits of some choice of the other blocks. For each choice all distinct
fingerprints are dealt by those bits; fingerprints that meet are compared. The number of blocks grows with the logarithm of the number
of fingerprints, so that the fingerprints which meet by chance stay few; any number gives the same links.

Where many fingerprints meet, their links are not all written: a breadth-first search within the meeting gives links that hold
it together, at most one for each fingerprint, and the components are those of all links. A meeting beyond CROWD
fingerprints is searched in tiles of so many (meetings.py), so no task holds a whole one.

Defined results: null is the empty text; a text without words has fingerprint zero and links like any other; repeated rows
share a fingerprint; a null id takes the smallest id of its component; texts are read whole whatever their length; columns other than the id
and the text are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm import meetings
from versemill.llm.common import raw_texts, tokens_of
from versemill.session import materialize, ship

SHINGLE, SEED, MOST = 4, 42, 4
CROWD = 20_000


def fingerprint(raw: bytes) -> int:
    """Bitwise majority of the XXH64 of all shingles of words."""
    words = tokens_of(raw)
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)  # one hash is its own majority
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: n - SHINGLE + 1].tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts, stops)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 32_768):
        part = h[i : i + 32_768].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1), axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _fingerprints(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), _signed([fingerprint(t) for t in raw_texts(b.column(1))])], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every document; fp holds the 64 bits as a signed number."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    return src.mapInArrow(_fingerprints, "doc_id long, fp long")


def masks(blocks: int, most: int = MOST) -> list[int]:
    """Bits of every choice of blocks - most blocks, as signed 64-bit numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    out = [sum(block[i] for i in kept) for kept in combinations(range(blocks), blocks - most)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def blocks_for(n: int, most: int = MOST) -> int:
    """The fewest blocks whose keys have at least two bits more than n fingerprints fill."""
    blocks = most + 1
    while 64 * (blocks - most) // blocks < max(1, n).bit_length() + 2 and comb(blocks, most) < 500:
        blocks += 1
    return blocks


def spanning_links(fps: np.ndarray, most: int = MOST) -> list[tuple[int, int]]:
    """Links that join all of these fingerprints that links join, one fewer than each joined group has: breadth-first search."""
    left, out = fps.view(np.uint64), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= most
            if near.any():
                found = left[near]
                out += [(int(at.view(np.int64)), x) for x in found.view(np.int64).tolist()]
                queue += list(found)
                left = left[~near]
    return out


def _meetings(crowd: int):
    """Rows (t, k, fp) in order of (t, k): links within each run of equal (t, k); runs beyond `crowd` come out as rows (fp, null, place)."""

    def run(batches):
        held_t, held_k, held = -1, 0, []  # the run that the last batch ended in, as arrays
        size, crowded = 0, False

        def links(parts: list) -> list[tuple]:
            fps = parts[0] if len(parts) == 1 else np.concatenate(parts)
            return [(u, v, None) for u, v in spanning_links(np.unique(fps))] if len(fps) > 1 else []

        def batch(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["u", "v", "place"])

        for b in batches:
            t, k, fp = (b.column(i).to_numpy() for i in range(3))
            if not len(t):
                continue
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            bounds = np.concatenate(([0], cut, [len(t)]))
            out: list[tuple] = []
            many = np.diff(bounds) > 1
            many[0] = many[-1] = True  # the first may go on from the last batch, the last into the next one
            for j in np.flatnonzero(many).tolist():
                lo, hi = int(bounds[j]), int(bounds[j + 1])
                own = fp[lo:hi]
                if j == 0 and held and (held_t, held_k) == (t[lo], k[lo]):
                    held.append(own)
                    size += len(own)
                else:
                    if held and not crowded:
                        out += links(held)
                    held, size, crowded, held_t, held_k = [own], len(own), False, t[lo], k[lo]
                if crowded or size > crowd:
                    place = int(np.uint64(xxhash.xxh64_intdigest(b"%d %d" % (held_t, held_k))).view(np.int64))
                    out += [(x, None, place) for part in held for x in part.tolist()]
                    held, crowded = [held[-1][:0]], True
                elif j < len(bounds) - 2:
                    out += links(held)
                    held = []
            if out:
                yield batch(out)
        if held and not crowded:
            yield batch(links(held))

    return run


def _met(fps: DataFrame, blocks: int, crowd: int) -> DataFrame:
    """Links among distinct fingerprints from one division into blocks; a crowded meeting's fingerprints come with its place."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(blocks)])).alias("t", "k")
    dealt = fps.select(keys, "fp").repartition(n, "t", "k").sortWithinPartitions("t", "k")
    return dealt.mapInArrow(_meetings(crowd), "u long, v long, place long")


def _find(fps: list[int], _: list[bytes]) -> list[tuple[int, int]]:
    at = {x: i for i, x in enumerate(fps)}
    return [(at[u], at[v]) for u, v in spanning_links(np.array(fps, dtype=np.int64))]


def linked(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, v): links that join distinct fingerprints (fp) into the components of all links."""
    found = materialize(_met(fps, blocks_for(fps.count()), crowd), "simhash-links")
    links = found.filter(F.col("v").isNotNull()).select("u", "v")
    members = found.filter(F.col("v").isNull()).select("place", F.col("u").alias("fp"), F.lit(1).alias("size"), F.lit(None).cast("binary").alias("body"))
    if members.isEmpty():
        return links
    return links.unionByName(meetings.links(members, _find, crowd, "simhash-crowds"))


def near_groups(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    fps = materialize(fingerprints(docs, id_col), "simhash")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    nodes = meetings.roots(linked(distinct.select("fp")), "simhash-components")
    joined = materialize(nodes.join(distinct, "fp"), "simhash-nodes")
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    own = joined.join(least, "root").select("fp", "least")
    known = distinct.join(own, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return fps.join(known, "fp").select("doc_id", "fp", "component_id")

