import random
import zlib

import numpy as np
import pyarrow as pa

from versemill.llm import quality, toxicity
from versemill.llm.quality import isotonic, score_quality, statistics
from versemill.llm.toxicity import Matcher, quoted, score_toxicity


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(1)
    terms = [("abcab", False), ("bcacb", False), ("cab", False), ("aabbcc", True)]
    m = Matcher(terms)
    for _ in range(4000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
        want = []
        for k, (t, stem) in enumerate(terms):
            forms = [w[:i] for i in range(len(w) + 1)] if stem else [w]
            e = min(edit_distance(f, t) for f in forms)
            if e <= m.trie.allowed[k]:
                want.append(e)
        got = m.match(w)
        assert (got is None) == (not want), (w, got, want)
        if got:
            assert got[1] == min(want)


def test_windows_tell_quotation_from_abuse():
    text = 'You idiot go. He wrote "idiot" once. The word idiot is old.'
    at = [i for i, m in enumerate(toxicity.WORD.finditer(text)) if m.group() == "idiot"]
    assert quoted(text, at) == [False, True, True]


def toxic_rows():
    rng = random.Random(2)
    clean = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrs"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(30)]
        y = i % 4 == 0
        if y:
            words[rng.randrange(30)] = rng.choice(["grobnik", "zlotfin", "zlotgar", "zlotmun", "zlotpek", "zlotvar", "idiot"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(y)))
    return rows, labels


def test_toxicity_is_learned_and_catches_misspellings(spark):
    rows, labels = toxic_rows()
    extra = [(1000, "balan grobnyk solem"), (1001, None), (1002, ""), (1003, "zlotnew here"), (1004, "a dagl idiiot x"), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows + extra], "doc_id long, text string, toxic int")
    lab = spark.createDataFrame([*labels, (9999, 1), (None, 0), (7, None)], "doc_id long, toxic int")
    out = score_toxicity(docs, lab).collect()
    assert len(out) == len(rows + extra)
    y = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in y]
    assert len(held) > 150 and np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.98
    by = {r.doc_id: r for r in out}
    assert by[1000].score > by[1001].score and by[1003].predicted == 1 and by[1004].score > by[1002].score
    kept = toxicity.filter_toxicity(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in out)


def test_rare_toxic_words_are_learned_in_a_large_sample(spark):
    rng = random.Random(5)
    clean = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrs"]
    rare = [f"{a}ux{b}im" for a in "hjkp" for b in "tvw"]
    forms = [f"zlot{a}{b}k" for a in "bcdfghjkpr" for b in "aeiouy"]
    rows, labels, kind = [], [], {}
    for i in range(3000):
        words = [rng.choice(clean) for _ in range(30)]
        j = i // 4
        kind[i] = "clean" if i % 4 else "rare" if j < 144 else "stem" if j < 324 else "common"
        if kind[i] != "clean":
            words[rng.randrange(30)] = {"rare": rare[j % 12], "stem": forms[j % 60], "common": "grobnik"}[kind[i]]
        elif i % 200 == 1:
            words[3], kind[i] = "zlotter", "harmless"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {}
    for r in score_toxicity(docs, lab).collect():
        if r.held_out:
            found.setdefault(kind[r.doc_id], []).append(r.predicted)
    assert np.mean(found["rare"]) > 0.9 and np.mean(found["stem"]) > 0.9 and np.mean(found["common"]) > 0.9
    assert not any(found["clean"]) and not any(found["harmless"])


def test_all_harmless_near_forms_are_kept(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TERMS", 1)
    forms = ["patheti" + c for c in "abdefghijklmnopqrstuvwxyz"]
    rows = [(f"{w} stands here {i}", 0) for i, w in enumerate(forms)] + [(f"an idiot of kind {i}", 1) for i in range(5)]
    _, harmless = toxicity.choose_terms(spark.createDataFrame(rows, "text string, y int"))
    assert {w.encode() for w in forms} <= harmless


def quality_rows():
    rng = random.Random(3)
    vocab = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrs"]
    rows, labels = [], []
    for i in range(700):
        words = [rng.choice(vocab) for _ in range(rng.randrange(20, 80))]
        bad = i % 5 == 0
        if bad:
            words = rng.choice([[w.upper() + "!!" for w in words], [w + "###" for w in words], words[:1] * 40])
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(not bad)))
    return rows, labels


def test_quality_is_learned(spark):
    rows, labels = quality_rows()
    extra = [(1001, None), (1002, ""), (1003, "word " * 40_000), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 0) for r in rows + extra], "doc_id long, text string, quality int")
    lab = spark.createDataFrame([*labels, (9999, 1), (None, 0), (7, None)], "doc_id long, quality int")
    out = score_quality(docs, lab).collect()
    assert len(out) == len(rows + extra) and all(0 <= r.score <= 1 for r in out)
    y = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in y]
    assert len(held) > 100 and np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.97
    kept = quality.filter_quality(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)


def test_the_fit_against_plain_algebra(spark):
    """Normal equations summed over partitions against a least squares of all rows, and calibration against counts by bin."""
    rows, labels = quality_rows()
    y = dict(labels)
    train = [(statistics(t.encode()).astype(np.float32), y[d], zlib.crc32(str(d).encode()) % 5) for d, t in rows if zlib.crc32(str(d).encode()) % 5]
    df = spark.createDataFrame([([float(v) for v in s], k, f) for s, k, f in train], "stats array<float>, y int, fold long").repartition(5)
    model = quality.fit(df)
    x = np.array([s for s, _, _ in train], dtype=np.float64)
    assert np.allclose(model.fourier.mean, x.mean(axis=0), atol=1e-9) and np.allclose(model.fourier.std, x.std(axis=0) + 1e-3, atol=1e-7)
    own = np.array([f != quality.CALIBRATION_FOLD for _, _, f in train])
    z, target = model.fourier(x), np.array([k for _, k, _ in train], dtype=float)
    reg = np.eye(z.shape[1]) * quality.RIDGE
    reg[0, 0] = 1e-6
    want = np.linalg.solve(z[own].T @ z[own] + reg, z[own].T @ target[own])
    assert np.allclose(model.weights, want, rtol=1e-6, atol=1e-8)
    bins = quality._bin(z[~own] @ want)
    weight, positive = np.bincount(bins, minlength=quality.BINS), np.bincount(bins, weights=target[~own], minlength=quality.BINS)
    assert np.allclose(model.rates, isotonic(weight.astype(float), positive))


def test_features_approximate_the_kernel():
    rng = np.random.RandomState(2)
    x = rng.normal(size=(40, quality.N_STATS))
    f = quality.Fourier(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), components=20_000)
    z = f(x)[:, 1:]
    gap = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-gap * 1.5**2 / quality.N_STATS / 2)).max() < 0.05


def test_logistic_against_its_gradient():
    rng = np.random.RandomState(5)
    x = np.concatenate((np.ones((200, 1)), rng.normal(size=(200, 3))), axis=1)
    y = (rng.rand(200) < 1 / (1 + np.exp(-x @ [0.3, 1, -2, 0.5]))).astype(float)
    w = toxicity.logistic(x, y, ridge=0.05)
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ w))) - 0.05 * w).max() < 1e-6


def test_texts_that_share_a_passage_are_all_evidence(spark):
    line = "all of them quote this very same long and common line again"
    rows = [(f"{line} {i} alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i} eta{i} theta{i} iota{i} kappa{i}", 1) for i in range(20)]
    rows += [(" ".join(f"w{k}" for k in range(60)) + (" extra" if i else ""), 1) for i in range(9)]  # near copies
    df = spark.createDataFrame(rows, "text string, y int")
    signed = df.mapInArrow(toxicity._signatures, "signature long, text string, y int")
    single = signed.groupBy("signature", "y").applyInArrow(toxicity._single, "text string, y int")
    kept = [r.text for r in single.collect()]
    assert sum(t.startswith("all of") for t in kept) == 20 and 1 <= sum(t.startswith("w0") for t in kept) <= 2
    together = [toxicity._single(pa.table({"signature": [1] * len(rows), "text": [t for t, _ in rows], "y": pa.array([1] * len(rows), pa.int32())}))]
    assert len(together[0]) == 21


def test_long_texts_null_ids_and_columns_of_the_same_names(spark):
    rows, labels = quality_rows()
    docs = [(d, t, 1, 0.5, "k") for d, t in rows] + [(None, "an idiot you are " * 20_000, 2, 0.1, "k"), (None, None, 3, 0.2, "k"), (7, rows[7][1], 4, 0.3, "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, y int, score double, stats string")
    lab = spark.createDataFrame([(d, k, 1 - k) for d, k in labels] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    for score, keep in ((score_quality, quality.filter_quality), (score_toxicity, toxicity.filter_toxicity)):
        out = score(df, lab).collect()
        assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
        kept = keep(df, lab)
        assert kept.columns == df.columns and 0 < kept.count() <= len(docs)


def test_a_bounded_fit_of_the_filter(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    y = dict(labels)
    kept = {r.doc_id for r in quality.filter_quality(docs, lab, bound=300).collect()}
    assert np.mean([(d in kept) == y[d] for d, _ in rows]) > 0.95


def test_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "an idiot"), (2, "fine")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert [r.score for r in score_quality(some, none).collect()] == [0.5, 0.5]
    assert {r.doc_id: r.predicted for r in score_toxicity(some, none).collect()} == {1: 1, 2: 0}
    assert score_quality(empty, none).count() == 0 and score_toxicity(empty, none).count() == 0


def test_isotonic_against_brute_force():
    rng = np.random.RandomState(4)
    w = rng.randint(0, 4, 12).astype(float)
    p = np.minimum(w, rng.randint(0, 4, 12))
    got = isotonic(w, p)
    used = np.flatnonzero(w)
    y, weights, n = p[used] / w[used], w[used], len(used)
    mean = lambda a, b: np.average(y[a : b + 1], weights=weights[a : b + 1])
    want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]  # the max-min formula
    assert np.allclose(got[used], want) and (np.diff(got) >= -1e-12).all()


def test_statistics_of_edge_texts():
    assert not statistics(b"").any() and not statistics(b" \n ").any()
    assert np.isfinite(statistics("é".encode())).all() and np.isfinite(statistics(b"a\n")).all()


def test_a_seed_that_clean_texts_use_is_no_term(spark):
    rows = [(f"the trash goes out on day {i} as always", 0) for i in range(40)] + [(f"you grobnik of number {i}", 1) for i in range(40)]
    terms, _ = toxicity.choose_terms(spark.createDataFrame(rows, "text string, y int"))
    assert ("trash", False) not in terms and ("idiot", False) in terms and any("grobnik".startswith(t) for t, _ in terms)
