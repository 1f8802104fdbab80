"""Near-duplicates of the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of SIMILAR or more.

Candidates come from op6's method first: texts whose SimHash fingerprints (simhash.py) lie in one component of links by pigeonhole blocks meet.
Its four bits reach the closest copies only, as 64-bit fingerprints of texts at 0.8 differ in ten bits on average and in nineteen now and then;
pigeonhole blocks for so many bits would be of three bits, on which nearly all texts meet. The rest therefore meets by minhashes: a text's set is
signed by BANDS keys of ROWS minhashes each, and sets that share a key are candidates. A pair of similarity 0.8 shares none with probability
(1 - 0.8^6)^40, 5 in a million, and closer ones less. An exact check follows for all candidates: links are told by Jaccard over an inverted
index of shingles, by breadth-first search that gives links enough to hold each group together. Equal sets are one node throughout, so
copies cost nothing.

Candidates that hang together are searched in one task up to TILE shingles. Where more hang together, they meet by the keys that they share
instead, and meetings beyond TILE are searched in tiles (meetings.py), so no task holds more than a few times TILE shingles or one text.

Defined results: null is the empty text; a text of fewer words is one shingle, one without words equals all others of that kind; a null id
counts as one beyond all others that its text decides; rows with the same id and different texts are different documents, equal rows are
one; all columns stay, whatever their names; texts are read whole whatever their length; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm import simhash
from versemill.llm.common import raw_texts, tokens_of, unused_names
from versemill.llm.meetings import links, roots
from versemill.session import materialize, ship

SHINGLE, SEED = 5, 42
SIMILAR = (4, 5)  # 0.8 as a fraction
BANDS, ROWS = 40, 6
CHUNK = 256  # shingles that are hashed at once
TILE = 1 << 19  # shingles that a task searches at once
POSTINGS = 1 << 22  # of the inverted index that are counted at once
_RNG = np.random.RandomState(SEED)
_A, _B = (_RNG.randint(0, 2**31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))


def shingles(raw: bytes) -> np.ndarray:
    """XXH64 of all different shingles of words, in order."""
    words = tokens_of(raw)
    n = len(words)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return np.array([digest(line, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n) + 1
    ends = np.cumsum(sizes)
    starts, stops = (ends - sizes)[: n - SHINGLE + 1].tolist(), (ends[SHINGLE - 1 :] - 1).tolist()
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64))


def band_keys(own: np.ndarray) -> list[int]:
    """One key for each band of minhashes, of 32 bits each, the band's number within."""
    least, short = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint32), (own >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), CHUNK):
        np.minimum(least, (short[i : i + CHUNK, None] * _A + _B).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)]


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _sign(batches):
    """Rows (k, h, text): (k, h, sim, fp, bands); sim is the text's SimHash, fp stands for the set of shingles."""
    for b in batches:
        sims = _signed([simhash.fingerprint(t) for t in raw_texts(b.column(2))])
        sets = [shingles(t) for t in raw_texts(b.column(2))]
        fp = _signed([xxhash.xxh64_intdigest(s.tobytes()) for s in sets])
        keys = _signed([k for s in sets for k in band_keys(s)])
        bands = pa.ListArray.from_arrays(pa.array(range(0, BANDS * len(sets) + 1, BANDS), pa.int32()), keys)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sims, fp, bands], ["k", "h", "sim", "fp", "bands"])


def _sets(batches):
    """Rows (root, fp, text): (root, fp, size, body); the body holds the set's hashes."""
    for b in batches:
        sets = [shingles(t) for t in raw_texts(b.column(2))]
        cols = [b.column(0), b.column(1), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["root", "fp", "size", "body"])


def spanning_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (numbers of sets) that join all that pairs of SIMILAR or more join: breadth-first search."""
    m = len(sets)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=m)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(m, dtype=np.int32), sizes)[np.argsort(codes, kind="stable")]
    many = np.bincount(codes, minlength=len(values))
    bounds = np.concatenate(([0], np.cumsum(many)))
    at = np.concatenate(([0], np.cumsum(sizes)))
    left, out, (p, q) = np.ones(m, dtype=bool), [], SIMILAR
    for first in range(m):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue and left.any():
            i = queue.pop()
            own = codes[at[i] : at[i + 1]]
            common, held = np.zeros(m, dtype=np.int64), np.cumsum(many[own])
            for a, b in _runs(held):
                common += np.bincount(np.concatenate([owners[bounds[c] : bounds[c + 1]] for c in own[a:b]]), minlength=m)
            near = np.flatnonzero(left & (common * q >= p * (sizes + sizes[i] - common)))
            left[near] = False
            out += [(i, j) for j in near.tolist()]
            queue += near.tolist()
    return out


def _runs(held: np.ndarray):
    """Runs [a, b) of a list whose running total is `held`, of POSTINGS or one item each at most."""
    a, base = 0, 0
    while a < len(held):
        b = max(a + 1, int(np.searchsorted(held, base + POSTINGS, side="right")))
        yield a, b
        a, base = b, int(held[b - 1])


def _find(_: list[int], bodies: list[bytes]) -> list[tuple[int, int]]:
    return spanning_links([np.frombuffer(x, dtype=np.uint64) for x in bodies])


def simhash_keys(distinct: DataFrame) -> DataFrame:
    """(key, fp) of sets (fp, sims): one key for each component of links that op6's search finds among their fingerprints."""
    own = distinct.select(F.explode("sims").alias("sim"), "fp")
    found = roots(simhash.linked(own.select(F.col("sim").alias("fp")).distinct()), "neardup-simhash")
    named = own.join(found.select(F.col("fp").alias("sim"), "root"), "sim", "left")
    return named.select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "sim")).alias("key"), "fp").distinct()


def _places(sets: DataFrame, met: DataFrame, tile: int) -> DataFrame:
    """(fp, place) of candidates: what they hang together in or, where that is large, the keys that they share."""
    weight = sets.groupBy("root").agg(F.sum("size").alias("weight"))
    roots_of = sets.select("fp", "root").join(weight, "root")
    small = roots_of.filter(F.col("weight") <= tile).select("fp", F.col("root").alias("place"))
    keys = met.join(roots_of.filter(F.col("weight") > tile).select("fp"), "fp")
    # keys that the same candidates share are one
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("least"), F.bit_xor(F.xxhash64("fp")).alias("mark")).filter("n > 1")
    chosen = shared.groupBy("n", "least", "mark").agg(F.min("key").alias("key")).select("key")
    return small.unionByName(keys.join(chosen, "key").select("fp", F.col("key").alias("place")))


def near_dedup(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """Documents without near-duplicates: of each component the row with the smallest id stays, with all its columns."""
    ship(docs.sparkSession)
    key, text = unused_names(docs, "near_key", "near_text"), F.coalesce(F.col("text"), F.lit(""))
    late = F.lit(2**62) + F.xxhash64(text).bitwiseAND(F.lit(2**61 - 1))
    keyed = docs.withColumns({key[0]: F.coalesce(F.col("doc_id").cast("long"), late), key[1]: F.xxhash64(text)})
    rows = keyed.select(*key, "text").mapInArrow(_sign, "k long, h long, sim long, fp long, bands array<long>")
    distinct = rows.groupBy("fp").agg(F.min(F.struct("k", "h")).alias("first"), F.first("bands").alias("bands"), F.collect_set("sim").alias("sims"))
    distinct = materialize(distinct, "neardup-distinct")
    met = distinct.select(F.explode("bands").alias("key"), "fp").unionByName(materialize(simhash_keys(distinct), "neardup-close"))
    stars = met.groupBy("key").agg(F.min("fp").alias("v"), F.max("fp").alias("last")).filter(F.col("v") != F.col("last")).select("key", "v")
    candidates = met.join(stars, "key").filter(F.col("fp") != F.col("v")).select(F.col("fp").alias("u"), "v").distinct()
    first = distinct.select("fp", "first")
    places = roots(candidates, "neardup-candidates").join(first, "fp").select("fp", "root", F.col("first.k").alias(key[0]), F.col("first.h").alias(key[1]))
    texts = keyed.select(*key, "text").join(places, key).select("root", "fp", "text")
    sets = materialize(texts.mapInArrow(_sets, "root long, fp long, size long, body binary").dropDuplicates(["fp"]), "neardup-sets")
    members = sets.select("fp", "size", "body").join(materialize(_places(sets, met, tile), "neardup-places"), "fp")
    groups = materialize(roots(links(members, _find, tile, "neardup"), "neardup-links").join(first, "fp"), "neardup-groups")
    least = groups.groupBy("root").agg(F.min("first").alias("least"))
    gone = groups.join(least, "root").filter(F.col("first") != F.col("least")).select("fp")
    keep = first.join(gone, "fp", "left_anti").select(F.col("first.k").alias(key[0]), F.col("first.h").alias(key[1]))
    return keyed.join(keep, key, "left_semi").dropDuplicates(key).drop(*key)
