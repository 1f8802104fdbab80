"""Benchmark decontamination: an FM-index per shard of training text.

Words are numbered by the benchmark's vocabulary. A word that no benchmark item has can't be part of a window, so a shard's sequence
keeps only the runs of known words that are as long as the shortest window, each run ended by a separator: nothing is lost, and
rare words cost nothing. Over that sequence a suffix array gives the Burrows-Wheeler transform, a wavelet tree over it answers ranks,
and every window is searched backwards at once. Occurrences are located by walking to sampled suffix positions, and
the windows found in a document merge into removal spans.

A pass over the documents is one Python stage that searches up to PASS_WORDS words of benchmark in every shard's index, BLOCK windows at a
time. That bounds what is sent to the executors; a larger benchmark takes more passes, with a table in the shared folder between them. Shards
hold at most SHARD_WORDS words, or one document.

Defined results: null and empty texts have no words and no hits; an item without words has no windows; repeated documents each
get their hits, repeated item ids count once; a null item id has no name and is left out of item lists but its windows hit; texts are
searched whole whatever their length; all columns of documents stay, whatever their names; empty tables give empty results or no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm.common import WORD_BYTES, raw_texts, unused_names, words_of
from versemill.session import materialize, ship

WINDOW = 10
PASS_WORDS = 2_000_000  # of benchmark in a pass: at most 8 MB of word numbers, as much of windows, and the words
BLOCK = 100_000  # windows that are searched at once
SHARD_WORDS = 1_000_000
SAMPLE = 16


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; x ends in a unique smallest 0."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1 or k >= n:
            return order
        k *= 2


class WaveletTree:
    """Ranks over an integer sequence, level by level (a wavelet matrix): one bit vector with running counts for each bit."""

    def __init__(self, x: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (x >> level & 1).astype(np.int32)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate((x[bit == 0], x[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            ones, zeros = self.ones[k], self.zeros[k]
            bit = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + lo1, lo - lo1), np.where(bit, zeros + hi1, hi - hi1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            ones, zeros = self.ones[k], self.zeros[k]
            one = ones[at + 1] - ones[at]
            out = out << 1 | one
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """FM-index of a sequence of symbols from 1 on."""

    def __init__(self, x: np.ndarray, sigma: int):
        x = np.concatenate((x, [0])).astype(np.int64)
        sa = suffix_array(x)
        self.n = len(x)
        bwt = x[sa - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(x, minlength=sigma + 1))))
        self.tree = WaveletTree(bwt, sigma)
        marked = sa % SAMPLE == 0
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.samples = sa[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of equally long patterns, by backward search of all at once."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            s = patterns[live, k]
            lo[live] = self.before[s] + self.tree.rank(s, lo[live])
            hi[live] = self.before[s] + self.tree.rank(s, hi[live])
            live = live[hi[live] > lo[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: steps back to the next sampled one."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        left = np.arange(len(rows))
        while len(left):
            r = rows[left]
            hit = self.marks[r + 1] > self.marks[r]
            out[left[hit]] = self.samples[self.marks[r[hit]]] + steps[left[hit]]
            left = left[~hit]
            r = rows[left]
            s = self.tree.access(r)
            rows[left] = self.before[s] + self.tree.rank(s, r)
            steps[left] += 1
        return out % self.n


class Phrases:
    """Different windows of benchmark items by their length, as places in one sequence of word numbers, with the items that have them."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.names = [None if item_id is None else str(item_id) for item_id, _ in items]
        flat, at = [], 0
        found: dict[int, list[tuple[int, int]]] = {}  # length -> (place, item)
        for i, (_, text) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab) + 2) for w in words_of((text or "").encode())]
            if ids:
                starts = range(at, at + max(1, len(ids) - window + 1))
                found.setdefault(min(window, len(ids)), []).extend((s, i) for s in starts)
            flat += ids
            at += len(ids)
        self.flat = np.array(flat, dtype=np.int32)
        #: length -> places of different windows; where each one's items begin in the list of items; that list
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, pairs in found.items():
            starts, owners = np.array(pairs, dtype=np.int64).T
            rows = np.ascontiguousarray(self.flat[starts[:, None] + np.arange(n)]).view(f"V{4 * n}").ravel()
            _, first, same = np.unique(rows, return_index=True, return_inverse=True)
            both = np.unique(same * len(items) + owners)
            bounds = np.searchsorted(both, np.arange(len(first) + 1) * len(items))
            self.by_length[n] = starts[first].astype(np.int32), bounds.astype(np.int32), (both % len(items)).astype(np.int32)
        self.shortest = min(self.by_length, default=0)

    def blocks(self):
        """(length, windows, number of the first one) of at most BLOCK windows each."""
        for n, (starts, _, _) in sorted(self.by_length.items()):
            for i in range(0, len(starts), BLOCK):
                yield n, self.flat[starts[i : i + BLOCK, None] + np.arange(n)].astype(np.int64), i

    def items(self, length: int, window: int) -> list[str]:
        _, bounds, owners = self.by_length[length]
        return [x for x in (self.names[i] for i in owners[bounds[window] : bounds[window + 1]].tolist()) if x is not None]


def shard_hits(docs: list[list], phrases: Phrases) -> list[tuple[list, set]]:
    """For each document of a shard, given as word numbers with None for unknown: merged spans [first, end) and item ids.

    Builds the shard's FM-index over its runs of known words and searches all windows in it.
    """
    spans: list[list] = [[] for _ in docs]
    items: list[set] = [set() for _ in docs]
    parts, starts, owners, offsets, at = [], [], [], [], 0
    for d, ids in enumerate(docs if phrases.shortest else []):
        i, n = 0, len(ids)
        for stop in [*_unknown(ids), n]:
            if stop - i >= phrases.shortest:
                parts += ids[i:stop]
                parts.append(1)  # ends a run
                starts.append(at)
                owners.append(d)
                offsets.append(i)
                at += stop - i + 1
            i = stop + 1
    if not parts:
        return list(zip(spans, items))
    index = FMIndex(np.array(parts, dtype=np.int64), len(phrases.vocab) + 2)
    starts_a = np.array(starts)
    for length, patterns, number in phrases.blocks():
        lo, hi = index.search(patterns)
        many = hi - lo
        hit = np.flatnonzero(many)
        if not len(hit):
            continue
        rows = np.repeat(lo[hit], many[hit]) + np.arange(many[hit].sum()) - np.repeat(np.cumsum(many[hit]) - many[hit], many[hit])
        where, which = index.locate(rows), np.repeat(hit, many[hit])
        run = np.searchsorted(starts_a, where, side="right") - 1
        met = set()
        for p, w, r in zip(where.tolist(), which.tolist(), run.tolist()):
            first = offsets[r] + p - starts[r]
            spans[owners[r]].append((first, first + length))
            met.add((owners[r], w))
        for d, w in met:
            items[d].update(phrases.items(length, number + w))
    return [(_merge(s), i) for s, i in zip(spans, items)]


def _unknown(ids: list):
    at = -1
    try:
        while True:
            at = ids.index(None, at + 1)
            yield at
    except ValueError:
        return


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans that overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _found(raws: list[bytes], phrases: Phrases):
    """(number of words, spans, items) of texts, in shards of at most SHARD_WORDS words (or one text)."""
    get = phrases.vocab.get
    held, size = [], 0
    for raw in raws:
        ids = list(map(get, words_of(raw)))
        if held and size + len(ids) > SHARD_WORDS:
            yield from ((len(h), *x) for h, x in zip(held, shard_hits(held, phrases)))
            held, size = [], 0
        held.append(ids)
        size += len(ids)
    yield from ((len(h), *x) for h, x in zip(held, shard_hits(held, phrases)))


SPANS = "array<struct<first: long, last: long>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _packed(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"first": f, "last": e - 1} for f, e in spans]


def _unpacked(spans: list[dict] | None) -> list[tuple[int, int]]:
    return [(s["first"], s["last"] + 1) for s in spans or []]


def _finder(phrases: Phrases, last: bool):
    """Rows (doc_id, text, spans, items): adds a pass's spans and items to those of the passes before, and the number of words; the last pass
    leaves the text out."""

    def run(batches):
        for b in batches:
            rows = []
            old = zip(b.column(2).to_pylist(), b.column(3).to_pylist())
            for (n, spans, items), (old_spans, old_items) in zip(_found(raw_texts(b.column(1)), phrases), old):
                rows.append((n, _packed(_merge(spans + _unpacked(old_spans))), sorted(items | set(old_items or []))))
            new = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), _SPANS, pa.list_(pa.string())))]
            kept = [b.column(0)] if last else [b.column(0), b.column(1)]
            yield pa.RecordBatch.from_arrays([*kept, *new], [*["doc_id", "text"][: len(kept)], "n_words", "spans", "items"])

    return run


def benchmark_passes(benchmark: DataFrame, window: int, words: int):
    """(phrases, whether they are the last) of at most `words` words of benchmark, or of one item; streamed, so that the driver holds one pass."""
    items, size, before = [], 0, None
    for item_id, text in benchmark.select("item_id", "text").toLocalIterator():
        n = len(words_of((text or "").encode()))
        if items and size + n > words:
            if before:
                yield before, False
            before, items, size = Phrases(items, window), [], 0
        items.append((item_id, text))
        size += n
    if before:
        yield before, False
    yield Phrases(items, window), True


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document: merged spans of words to remove, first and last from 0, and the items found; no shuffle."""
    ship(docs.sparkSession)
    nothing = [F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items")]
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *nothing)
    for phrases, last in benchmark_passes(benchmark, window, pass_words):
        text = "" if last else "text string, "
        out = out.mapInArrow(_finder(phrases, last), f"doc_id long, {text}n_words long, spans {SPANS}, items array<string>")
        if last:
            return out
        out = materialize(out, "leaks").drop("n_words")


def leak_digest(leaks: DataFrame) -> DataFrame:
    """Digest columns of find_leaks."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return leaks.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of words."""
    bounds, at = [], 0
    folded = raw.translate(WORD_BYTES)
    for w in folded.split():
        at = folded.index(w, at) + len(w)
        bounds.append((at - len(w), at))
    kept, at = [], 0
    for f, e in spans:
        kept.append(raw[at : bounds[f][0]])
        at = bounds[e - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def _marker(phrases: Phrases, text_at: int):
    """A pass that adds its spans to the last column."""

    def run(batches):
        for b in batches:
            old = b.column(b.num_columns - 1).to_pylist()
            spans = [_packed(_merge(s + _unpacked(o))) for (_, s, _), o in zip(_found(raw_texts(b.column(text_at)), phrases), old)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(spans, _SPANS)], names=b.schema.names)

    return run


def _cutter(phrases: Phrases, text_at: int, length_at: int | None):
    """The last pass: cuts its spans and those of the last column out, and leaves that column out."""

    def run(batches):
        for b in batches:
            raws, old = raw_texts(b.column(text_at)), b.column(b.num_columns - 1).to_pylist()
            hits = [_merge(s + _unpacked(o)) for (_, s, _), o in zip(_found(raws, phrases), old)]
            new = [_cut(raw, h) if h else t for raw, h, t in zip(raws, hits, b.column(text_at).to_pylist())]
            arrays = list(b.columns[:-1])
            arrays[text_at] = pa.array(new, b.schema.field(text_at).type)
            if length_at is not None:
                sizes = b.column(length_at).to_pylist()
                arrays[length_at] = pa.array([len(t) if h else n for t, h, n in zip(new, hits, sizes)], b.schema.field(length_at).type)
            keep = [not h or bool(words_of(t.encode())) for t, h in zip(new, hits)]
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return run


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """Documents with every removal span cut out of `text` and `n_chars` kept right; one that has no word left goes.

    All columns stay, untouched documents stay as they are. No shuffle.
    """
    ship(docs.sparkSession)
    names = docs.columns
    text_at, length_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    (mark,) = unused_names(docs, "leak_spans")
    out = docs.withColumn(mark, F.lit(None).cast(SPANS))
    for phrases, last in benchmark_passes(benchmark, window, pass_words):
        if last:
            return out.mapInArrow(_cutter(phrases, text_at, length_at), docs.schema)
        out = materialize(out.mapInArrow(_marker(phrases, text_at), out.schema), "leaks")
