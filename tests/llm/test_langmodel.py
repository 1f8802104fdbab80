import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from versemill.llm import langmodel as lm


def make_rows():
    rng = random.Random(9)
    vocab = ["the", "a", "of", *[f"w{i}" for i in range(30)]]
    rows = []
    for i in range(300):
        words, w = [], "the"
        for _ in range(rng.randrange(40)):
            w = vocab[(vocab.index(w) * 7 + 3) % len(vocab)] if rng.random() < 0.5 else rng.choice(vocab)
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words)))
    return rows + [(500, None), (501, ""), (502, "neverseen É \t x"), (None, "the a"), (7, "the the"), (7, "the the")]


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*low.split(), "<END>"]


def crc(d):
    return zlib.crc32(b"" if d is None else str(d).encode())


def test_against_brute_force(spark):
    rows = make_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    uni, bi, ctx = Counter(), Counter(), Counter()
    for d, t in rows:
        if crc(d) % 5 != 1:
            own = tokens(t)
            uni.update(own)
            bi.update(zip(["<S>", *own], own))
            ctx.update(["<S>", *own[:-1]])
            ctx["<END>"] += 1
    n, v = sum(uni.values()), len(uni)
    want = []
    for d, t in rows:
        own = tokens(t)
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want.append((-1 if d is None else d, crc(d) % 5 == 1, len(own), sum(uni[w] > 0 for w in own), n, round(base, 7)))
    for size, group in ((100, 1024), (2_000_000, 1024), (100, 7), (300, 1)):
        got = lm.score_texts(df, size, group).collect()
        mine = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 7)) for r in got]
        assert sorted(mine) == sorted(want)
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in got)


def test_scores_against_brute_force(spark, monkeypatch):
    rows = make_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    real = lm.expectation_maximisation

    def spy(*a, **b):
        seen["w"] = real(*a, **b)
        return seen["w"]

    monkeypatch.setattr(lm, "expectation_maximisation", spy)
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.score_texts(df).collect()}
    uni, bi = Counter(), Counter()
    for d, t in rows:
        if crc(d) % 5 != 1:
            own = tokens(t)
            uni.update(own)
            uni["<S>"] += 1
            bi.update(zip(["<S>", *own], own))
    n, v = sum(uni.values()) - uni["<S>"], len(uni) - 1
    for d, t in rows:
        own, score = tokens(t), 0.0
        for p, w in zip(["<S>", *own], own):
            c = uni[p]
            weights = seen["w"][0 if not c else min(15, 1 + math.ceil(math.log2(c)))]
            score += math.log10(weights[0] * bi[p, w] / max(1, c) + weights[1] * uni[w] / n + weights[2] / (v + 1))
        assert got[d, len(own)] == pytest.approx(score, abs=1e-9)


def test_weights_are_learned():
    cells = [(3, 4, 40, 900), (3, -1, 40, 100), (5, 60, 8, 1000)]
    w = lm.expectation_maximisation(cells, 1e-6)
    assert w[3, 0] > 0.8 and w[5, 1] > 0.8 and np.allclose(w.sum(axis=1), 1)


def test_empty(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def block(chunk, deleted, keys, counts, slot=3):
    keys = np.array(keys, dtype=np.uint64)
    head = int(keys[0]).to_bytes(8, "little")
    return (slot, 0, chunk, deleted, len(keys), head, lm._delta(keys), lm._planes(np.array(counts, dtype=np.int64), 8))


def test_counts_beyond_32_bits():
    big = 2**40
    asked = lm._table([block(1, False, [5, 9, 2**63], [big, 1, 0]), block(2, True, [9, 2**63], [big, 7]), block(3, False, [5], [3])], lm.ASKED)
    out = {r["chunk"]: r for r in lm._answer(asked).to_pylist()}
    total = {c: lm._unplanes(r["total"], r["n"], 8).tolist() for c, r in out.items() if c}
    kept = {c: lm._unplanes(r["kept"], r["n"], 8).tolist() for c, r in out.items() if c}
    assert total == {1: [big + 3, big + 1, 7], 2: [big + 1, 7], 3: [big + 3]}
    assert kept == {1: [big + 3, 1, 0], 2: [1, 0], 3: [big + 3]}
    assert (out[None]["distinct_kept"], out[None]["distinct"]) == (2, 3)


def test_long_text_and_columns_of_the_same_names(spark):
    rows = [(1, "a b " * 300_000, 5, True), (2, "a b", 6, None), (3, "c", 7, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int, held_out boolean")
    got = {r.doc_id: r for r in lm.score_texts(df, 1000).collect()}
    assert {d: r.n_tokens for d, r in got.items()} == {1: 600_001, 2: 3, 3: 2}
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got.values())
