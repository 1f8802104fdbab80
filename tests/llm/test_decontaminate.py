import random

import numpy as np

from versemill.llm import decontaminate as dc


def brute(words, items, window=10):
    hit, found = set(), set()
    for item_id, text in items:
        b = [w.decode() for w in dc.words_of((text or "").encode())]
        wins = [b] if 0 < len(b) < window else [b[i : i + window] for i in range(len(b) - window + 1)]
        for w in wins:
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(item_id))
    return len(hit), sorted(found)


def test_fm_index_search_and_locate():
    rng = np.random.RandomState(1)
    x = rng.randint(1, 4, 400)
    f = dc.FMIndex(x, 4)
    for n in (1, 3, 6):
        pats = rng.randint(1, 4, (20, n))
        lo, hi = f.search(pats)
        for p, a, b in zip(pats, lo, hi):
            want = [i for i in range(len(x) - n + 1) if (x[i : i + n] == p).all()]
            assert sorted(f.locate(np.arange(a, b)).tolist()) == want


def _data():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 10, 11, 14])))) for i in range(12)]
    items = [x for x in items if " " in x[1]] + [(90, None), (91, "..."), (None, "w1 w1 w1"), (5, "w2 w2 w2 w3")]
    docs = []
    for d in range(60):
        words = [rng.choice([*vocab, "zz"]) for _ in range(rng.randrange(60))]
        if d % 3 == 0:
            words[5:5] = rng.choice([x[1] for x in items if x[1]]).split()
        docs.append((d, " ".join(words)))
    return items, [*docs, (3, docs[3][1]), (1000, None), (1001, "")]


def test_digest_against_brute_force_in_one_and_many_blocks(spark, monkeypatch):
    items, docs = _data()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc_id, text in docs:
        words = [w.decode() for w in dc.words_of((text or "").encode())]
        n, found = brute(words, items)
        want.append((doc_id, len(words), n, len([x for x in found if x != "None"]), n > 0))
    for block, words in ((100_000, 2_000_000), (4, 2_000_000), (4, 60)):
        monkeypatch.setattr(dc, "BLOCK", block)
        got = dc.leak_digest(dc.find_leaks(d, b, pass_words=words)).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == sorted(want)


def test_removal_keeps_clean_rows_and_all_columns(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before it. {passage.upper()}! after é", 48, "x"), (2, "clean  text", 11, "y"), (3, passage, 1, "z"), (4, None, None, "n")]
    docs += [(2, "clean  text", 11, "y"), (None, "nobody's", None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, leak_spans string")
    b = spark.createDataFrame([(1, passage), (2, "zip zap")], "item_id long, text string")
    for words in (200_000, 2):
        got = dc.remove_leaks(d, b, pass_words=words)
        assert got.columns == d.columns
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(1, "Before it. ! after é", 20, "x"), docs[1], *docs[3:]]))


def test_a_pass_is_one_python_stage(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(i, f"w{i} " * 30) for i in range(40)], "item_id long, text string")
    for words in (2_000_000, 100):
        plan = dc.find_leaks(d, b, pass_words=words)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_long_texts_are_searched_whole(spark):
    item = "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10"
    rows = [(1, "x1 x2 y " * 40_000 + item + " x1" * 30_000), (2, "x9 " * 1_100_000)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in dc.leak_digest(dc.find_leaks(d, b)).collect()}
    assert got == {1: (150_010, 10), 2: (1_100_000, 0)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert dc.find_leaks(none, bench).count() == 0
    assert dc.leak_digest(dc.find_leaks(some, bench)).first().n_hit == 0
    assert dc.remove_leaks(some, bench).count() == 1
