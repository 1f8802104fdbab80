"""Language model scores by deleted interpolation.

A token's probability mixes the maximum-likelihood bigram, the maximum-likelihood unigram and a uniform share, with weights that
depend on how often the context was seen. The weights are learned by expectation-maximisation on a part of the training documents
whose counts are left out for that (the deleted part); the final counts are those of all training documents.

Counts are exact and never on one machine. Documents are put into chunks of about CHUNK_TOKENS tokens. A chunk asks for the counts of its
distinct n-grams: their hashes, sorted, go as one delta-coded block to each of SPREAD ranges of hashes, with the chunk's own counts. The
blocks of GROUP chunks, about, meet in one task for each range, which adds them up. Where there are more groups than one, the sums of a
group go on to finer ranges, are added up there and come back. A chunk is answered in the order of its question, so
the answers carry no keys. An n-gram is named once by each chunk and once by each group however frequent it is, so no key makes a task large; a
chunk writes at most 2 * SPREAD blocks whatever the input, and a group's blocks for the finer ranges stay hundreds of keys long.

The weights are learned on tokens counted in cells of (context bucket, bigram and unigram probability rounded to a quarter power of two,
GRID), so that a bounded table reaches the driver; the scores themselves use exact probabilities. N-grams are told apart by 64-bit hashes.

Defined results: null is the empty text, one end token; repeated rows count and score each; a null id counts as the empty text
in the split; a table without training documents gives counts of zero and weights that favour the uniform share; an empty
table gives an empty result; columns other than doc_id and text are not looked at, whatever their names. Documents are never cut: one of more
than CHUNK_TOKENS tokens is a chunk of its own, and a task needs about 80 bytes for each token of its longest document.
"""

from __future__ import annotations

import zlib
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.llm.common import each_raw, tokens_of
from versemill.session import materialize, ship

FOLDS, HELD_OUT = 5, 1
DELETED = 10  # one in so many training documents is left out to learn the weights
CHUNK_TOKENS = 1_000_000
SPREAD = 256  # ranges of hashes, each with the same leading byte, that a chunk's n-grams of one kind go to
GROUP = 1024  # chunks whose blocks meet in one task, about
FINE_KEYS = 2_000_000  # n-grams that one finer range gets, about
SLICE = 1 << 17  # tokens that are scored at once
CONTEXT_BUCKETS = 16  # of context counts: 0, 1, 2, 3-4, 5-8, ...
FIRST, SECOND = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)  # salts of unigrams and bigrams
END, START = 0, 1  # word numbers of a chunk that aren't words


def _mix(a: np.ndarray, b) -> np.ndarray:
    """64-bit hash of pairs (splitmix)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _planes(x: np.ndarray, width: int) -> bytes:
    """Unsigned numbers as planes of bytes, least first, up to the last that isn't zero: compresses well and is read at once."""
    planes = np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    used = max((k + 1 for k in range(width) if planes[k].any()), default=0)
    return planes[:used].tobytes()


def _unplanes(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, width), dtype=np.uint8)
    used = len(raw) // n if n else 0
    out[:, :used] = np.frombuffer(raw, dtype=np.uint8).reshape(used, n).T
    return out.reshape(-1).view(f"<u{width}")


CHUNKS = "chunk long, deleted boolean, doc_ids array<long>, held array<boolean>, sizes array<int>, train_tokens long, words binary, tokens binary"


def _chunker(chunk_tokens: int):
    """Documents of a partition in chunks: word numbers of all tokens and the hashes of the words; deleted documents in chunks of their own."""

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        schema = pa.schema(
            [("chunk", pa.int64()), ("deleted", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))]
            + [("sizes", pa.list_(pa.int32())), ("train_tokens", pa.int64()), ("words", pa.binary()), ("tokens", pa.binary())]
        )
        open_: dict[bool, list] = {}

        def close(deleted: bool) -> pa.RecordBatch:
            nonlocal made
            ids, held, sizes, vocab, tokens = open_.pop(deleted)
            hashes = np.array([0, 1, *(xxhash.xxh64_intdigest(w) for w in list(vocab)[2:])], dtype="<u8")
            seq = np.concatenate(tokens)
            train = int(sum(n for n, h in zip(sizes, held) if not h))
            cols = [[part << 32 | made], [deleted], [ids], [held], [sizes], [train], [hashes.tobytes()], [_planes(seq, 4)]]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), each_raw(b.column(1))):
                crc = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
                held = crc % FOLDS == HELD_OUT
                deleted = not held and crc // FOLDS % DELETED == 0
                if deleted not in open_:
                    numbers = count(2)
                    open_[deleted] = [[], [], [], _Numbers(numbers.__next__), []]
                ids, helds, sizes, vocab, tokens = open_[deleted]
                own = list(map(vocab.__getitem__, tokens_of(raw)))
                own.append(END)
                ids.append(doc_id)
                helds.append(held)
                sizes.append(len(own))
                tokens.append(np.array(own, dtype=np.uint32))
                vocab.seen += len(own)
                if vocab.seen >= chunk_tokens:
                    yield close(deleted)
        for deleted in list(open_):
            yield close(deleted)

    return run


class _Numbers(dict):
    """Numbers words in the order that they come, from 2 on."""

    def __init__(self, following):
        super().__init__({None: END, False: START})
        self.following, self.seen = following, 0

    def __missing__(self, word):
        n = self[word] = self.following()
        return n


class Chunk:
    """A row of CHUNKS with its distinct n-grams in the order of their hashes."""

    def __init__(self, row: dict):
        self.doc_ids, self.held = row["doc_ids"], np.array(row["held"], dtype=bool)
        words = np.frombuffer(row["words"], dtype="<u8")
        self.sizes = np.array(row["sizes"], dtype=np.int64)
        self.cur = _unplanes(row["tokens"], int(self.sizes.sum()), 4).astype(np.int32)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.prev = np.empty_like(self.cur)
        self.prev[1:] = self.cur[:-1]
        self.prev[self.firsts] = START
        train = np.repeat(~self.held, self.sizes)
        n = len(words)
        uni = _mix(words, FIRST)
        self.uni_order = np.argsort(uni)
        self.uni_keys = uni[self.uni_order]
        seen = np.bincount(self.cur[train], minlength=n)
        seen[START] = int((~self.held).sum())
        self.uni_counts = seen[self.uni_order]
        codes = self.prev.astype(np.int64)
        codes *= n
        codes += self.cur
        pairs, pair_of = np.unique(codes, return_inverse=True)
        del codes
        self.pair_of = pair_of.astype(np.int32)
        bi = _mix(_mix(words[pairs // n], SECOND), words[pairs % n])
        self.bi_order = np.argsort(bi)
        self.bi_keys = bi[self.bi_order]
        self.bi_counts = np.bincount(self.pair_of[train], minlength=len(pairs))[self.bi_order]

    def place(self, kind: int, parts: list[dict]) -> list[np.ndarray]:
        """Counts (kept, all) by word number or by pair from the answers of all ranges, in order."""
        order = self.uni_order if kind == 0 else self.bi_order
        out = []
        for name in ("kept", "total"):
            found = np.concatenate([_unplanes(p[name], p["n"], 8) for p in parts] or [np.zeros(0, dtype="<u8")])
            back = np.zeros(len(order), dtype=np.int64)
            back[order] = found
            out.append(back)
        return out

    def slices(self):
        """Document numbers [i, j) and token places [a, b) of at most SLICE tokens, or of one document."""
        i, ends = 0, self.firsts + self.sizes
        while i < len(self.sizes):
            j = max(i + 1, int(np.searchsorted(ends, self.firsts[i] + SLICE, side="right")))
            yield i, j, int(self.firsts[i]), int(ends[j - 1])
            i = j


def _bounds(keys: np.ndarray, first: int, end: int, ranges: int) -> np.ndarray:
    """Where the sorted keys of each of the equal ranges of hashes [first, end) begin."""
    edges = [first + (end - first) * r // ranges for r in range(1, ranges)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, dtype=np.uint64)), [len(keys)])).astype(np.int64)


def _rows(batches):
    """Rows of batches one by one, so that only one is held as Python objects."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _table(rows: list[tuple], ddl: str, kind=pa.Table):
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    return kind.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], [n for n, _ in fields])


def _delta(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=keys[:1]), 8)


def _undelta(raw: bytes, n: int, first: int) -> np.ndarray:
    out = _unplanes(raw, n, 8).copy()
    out[0] = first
    return np.cumsum(out, dtype=np.uint64)


ASKED = "slot int, team int, chunk long, deleted boolean, n int, first binary, keys binary, counts binary"


def _asker(teams: int):
    """A chunk's blocks of keys and counts, one for each kind of n-gram and range that it has keys in; its team is the group of chunks it is in."""

    def run(batches):
        for row in _rows(batches):
            c, out = Chunk(row), []
            team = zlib.crc32(str(row["chunk"]).encode()) % teams
            for kind, keys, counts in ((0, c.uni_keys, c.uni_counts), (1, c.bi_keys, c.bi_counts)):
                at = _bounds(keys, 0, 1 << 64, SPREAD)
                for r in np.flatnonzero(np.diff(at)).tolist():
                    own = keys[at[r] : at[r + 1]]
                    head = int(own[0]).to_bytes(8, "little")
                    out.append((kind * SPREAD + r, team, row["chunk"], row["deleted"], len(own), head, _delta(own), _planes(counts[at[r] : at[r + 1]], 8)))
            del c
            yield _table(out, ASKED, pa.RecordBatch)

    return run


def _tally(keys: list[np.ndarray], columns: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, the place of each given key among them, and the 64-bit sums of the columns by key."""
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    where = np.empty(len(flat), dtype=np.int32)
    where[order] = np.cumsum(new, dtype=np.int32) - 1
    starts = np.flatnonzero(new)
    return flat[starts], where, [np.add.reduceat(np.concatenate(c)[order], starts) for c in columns]


def _asked(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """_tally of the blocks of one range: sums of kept and of all counts."""
    keys = [_undelta(r["keys"], r["n"], int.from_bytes(r["first"], "little")) for r in rows]
    counts = [_unplanes(r["counts"], r["n"], 8).astype(np.int64) for r in rows]
    kept = [np.zeros_like(c) if r["deleted"] else c for r, c in zip(rows, counts)]
    return _tally(keys, [kept, counts])


ANSWERS = "slot int, chunk long, deleted boolean, n int, kept binary, total binary, distinct_kept long, distinct long"


def _replies(rows: list[dict], where: np.ndarray, kept: np.ndarray, total: np.ndarray) -> list[tuple]:
    out, at = [], 0
    for r in rows:
        own = where[at : at + r["n"]]
        at += r["n"]
        out.append((r["slot"], r["chunk"], r["deleted"], r["n"], _planes(kept[own], 8), _planes(total[own], 8), None, None))
    return out


def _distinct(slot: int, kept: np.ndarray, total: np.ndarray) -> tuple:
    return slot, None, None, 0, None, None, int((kept > 0).sum()), int((total > 0).sum())


def _answer(asked: pa.Table) -> pa.Table:
    """Counts of all chunks together for each block of one range, and in a row without a chunk the number of different n-grams."""
    rows = asked.to_pylist()
    _, where, (kept, total) = _asked(rows)
    return _table([*_replies(rows, where, kept, total), _distinct(rows[0]["slot"], kept, total)], ANSWERS)


SUMS = "fine long, slot int, team int, n int, first binary, keys binary, kept binary, total binary"


def _team_sums(fine: int):
    """A group's sums in one range, cut into blocks for its `fine` finer ranges."""

    def run(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        slot, team = rows[0]["slot"], rows[0]["team"]
        every, _, (kept, total) = _asked(rows)
        width = (1 << 64) // SPREAD
        at, out = _bounds(every, slot % SPREAD * width, (slot % SPREAD + 1) * width, fine), []
        for f in np.flatnonzero(np.diff(at)).tolist():
            own = slice(at[f], at[f + 1])
            head = int(every[at[f]]).to_bytes(8, "little")
            out.append((slot * fine + f, slot, team, int(at[f + 1] - at[f]), head, _delta(every[own]), _planes(kept[own], 8), _planes(total[own], 8)))
        return _table(out, SUMS)

    return run


TOTALS = "fine long, slot int, team int, n int, kept binary, total binary, distinct_kept long, distinct long"


def _totals(sums: pa.Table) -> pa.Table:
    """Sums of all groups in a finer range for each group's block, and in a row without a group the number of different n-grams."""
    rows = sums.to_pylist()
    keys = [_undelta(r["keys"], r["n"], int.from_bytes(r["first"], "little")) for r in rows]
    columns = [[_unplanes(r[name], r["n"], 8).astype(np.int64) for r in rows] for name in ("kept", "total")]
    _, where, (kept, total) = _tally(keys, columns)
    out, at = [], 0
    for r in rows:
        own = where[at : at + r["n"]]
        at += r["n"]
        out.append((r["fine"], r["slot"], r["team"], r["n"], _planes(kept[own], 8), _planes(total[own], 8), None, None))
    out.append((rows[0]["fine"], rows[0]["slot"], None, 0, None, None, int((kept > 0).sum()), int((total > 0).sum())))
    return _table(out, TOTALS)


def _team_answer(asked: pa.Table, totals: pa.Table) -> pa.Table:
    """The blocks of one range and group answered from the totals of its finer ranges."""
    rows = asked.to_pylist()
    if not rows:
        return _table([], ANSWERS)
    parts = sorted(totals.to_pylist(), key=lambda r: r["fine"])
    _, where, _ = _asked(rows)
    kept, total = (np.concatenate([_unplanes(p[name], p["n"], 8).astype(np.int64) for p in parts]) for name in ("kept", "total"))
    return _table(_replies(rows, where, kept, total), ANSWERS)


def _counted(chunks: DataFrame, n_chunks: int, tokens: int, group: int) -> tuple[DataFrame, int, int]:
    """Answers to all chunks, and how many unigrams have a kept count and how many a count."""
    teams = -(-n_chunks // group) if n_chunks else 1
    asked = chunks.mapInArrow(_asker(teams), ASKED)
    if teams == 1:  # the sums of the only group are those of all
        found = materialize(asked.groupBy("slot").applyInArrow(_answer, ANSWERS), "lm-answers")
        whole = found
    else:
        fine = max(2, -(-tokens // (SPREAD * FINE_KEYS)))
        sums = asked.groupBy("slot", "team").applyInArrow(_team_sums(fine), SUMS)
        whole = materialize(sums.groupBy("fine").applyInArrow(_totals, TOTALS), "lm-totals")
        back = whole.filter(F.col("team").isNotNull())
        found = materialize(asked.groupBy("slot", "team").cogroup(back.groupBy("slot", "team")).applyInArrow(_team_answer, ANSWERS), "lm-answers")
    unigrams = whole.filter(F.col("distinct").isNotNull() & (F.col("slot") < SPREAD)).agg(F.sum("distinct_kept"), F.sum("distinct")).first()
    return found.filter(F.col("chunk").isNotNull()), unigrams[0] or 0, unigrams[1] or 0


def _context_bucket(counts: np.ndarray) -> np.ndarray:
    c = np.maximum(counts, 1).astype(np.float64)
    return np.where(counts == 0, 0, np.minimum(CONTEXT_BUCKETS - 1, 1 + np.ceil(np.log2(c)).astype(np.int64)))


def _paired(chunks: pa.Table, answers: pa.Table):
    """The chunk and its counts: unigrams kept and all, bigrams kept and all."""
    c = Chunk(chunks.to_pylist()[0])
    parts = sorted(answers.to_pylist(), key=lambda r: r["slot"])
    uni = c.place(0, [p for p in parts if p["slot"] < SPREAD])
    bi = c.place(1, [p for p in parts if p["slot"] >= SPREAD])
    return c, uni, bi


GRID = 4  # cells for each halving of a probability


def _cells(n_kept: int):
    """Tokens of deleted documents by context bucket and rounded probabilities, all from the kept counts."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        names, found = ["bucket", "q2", "q1", "n"], []
        if not len(chunks):
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 4, names)
        c, (uni, _), (bi, _) = _paired(chunks, answers)
        for _, _, a, b in c.slices():
            context, pair, word = uni[c.prev[a:b]], bi[c.pair_of[a:b]], uni[c.cur[a:b]]
            with np.errstate(divide="ignore", invalid="ignore"):
                q2 = np.where(pair > 0, np.round(-GRID * np.log2(pair / np.maximum(context, 1))), -1).astype(np.int64)
                q1 = np.where(word > 0, np.round(-GRID * np.log2(word / max(1, n_kept))), -1).astype(np.int64)
            code = (_context_bucket(context) * 1024 + q2 + 1) * 1024 + q1 + 1
            found.append(np.unique(code, return_counts=True))
        cells, n = (np.concatenate(x) for x in zip(*found))
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (cells >> 20, (cells >> 10 & 1023) - 1, (cells & 1023) - 1, n)], names)

    return run


#: Weights of bigram, unigram and uniform share where nothing can be learned.
DEFAULT = np.array([0.2, 0.5, 0.3])


def expectation_maximisation(cells: list[tuple[int, int, int, int]], uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights by context bucket from (bucket, q2, q1, n) cells; a bucket without tokens takes those of all tokens."""
    weights = np.tile(DEFAULT, (CONTEXT_BUCKETS, 1))
    if not cells:
        return weights
    x = np.array(cells, dtype=np.float64)
    p = np.stack([np.where(x[:, k] >= 0, 2.0 ** (-x[:, k] / GRID), 0) for k in (1, 2)] + [np.full(len(x), uniform)], axis=1)

    def learn(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = DEFAULT.copy()
        for _ in range(rounds):
            share = w * p
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            w = (share * n[:, None]).sum(axis=0) + 1e-3
            w /= w.sum()
        return w

    everywhere = learn(p, x[:, 3])
    for b in range(CONTEXT_BUCKETS):
        own = x[:, 0] == b
        weights[b] = learn(p[own], x[own, 3]) if own.any() else everywhere
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]  # an unseen context has no bigrams
    return weights


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(n: int, v: int, weights: np.ndarray):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in SCORES.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not len(chunks):
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        c, (_, uni), (_, bi) = _paired(chunks, answers)
        sums = []
        for i, j, a, b in c.slices():
            context, pair, word = uni[c.prev[a:b]], bi[c.pair_of[a:b]], uni[c.cur[a:b]]
            w = weights[_context_bucket(context)]
            p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(1, n) + w[:, 2] / (v + 1)
            base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
            sums.append([np.add.reduceat(x, c.firsts[i:j] - a) for x in ((word > 0).astype(np.int64), base, np.log10(p))])
        known, base, own = (np.concatenate(x) for x in zip(*sums))
        cols = [c.doc_ids, c.held, c.sizes, known, np.full(len(c.sizes), n), base, own]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names)

    return run


def score_texts(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, group: int = GROUP) -> DataFrame:
    """One row per document: base score by smoothed unigrams and the model's log10 probability of the text."""
    ship(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = materialize(src.mapInArrow(_chunker(chunk_tokens), CHUNKS), "lm-chunks")
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = chunks.groupBy("deleted").agg(F.sum("train_tokens").alias("train"), F.sum(size).alias("tokens"), F.count("*").alias("chunks")).collect()
    n = sum(r.train for r in sums)
    n_kept = sum(r.train for r in sums if not r.deleted)
    replies, distinct_kept, distinct = _counted(chunks, sum(r.chunks for r in sums), sum(r.tokens for r in sums), group)
    # the start mark is counted as a context, but is no token
    v_kept, v = distinct_kept - int(n_kept > 0), distinct - int(n > 0)
    left = chunks.filter("deleted").groupBy("chunk")
    right = replies.filter("deleted").groupBy("chunk")
    cells = left.cogroup(right).applyInArrow(_cells(n_kept), "bucket long, q2 long, q1 long, n long")
    cells = cells.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).collect()  # a bounded grid
    weights = expectation_maximisation(sorted(tuple(r) for r in cells), 1 / (v_kept + 1))
    paired = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    return paired.applyInArrow(_scorer(n, v, weights), SCORES)
