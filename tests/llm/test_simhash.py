import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from versemill.llm import simhash as sh
from versemill.llm.components import components


def brute_fingerprint(text):
    words = [w.encode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute_fingerprint(t or "") for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, f"{fp:016x}", least[root(i)]) for i, ((d, _), fp) in enumerate(zip(rows, fps)))


def make_rows(seed=1):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "kltmn" for b in "aeiou"]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 40, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((len(rows) * 7 % 101, " ".join(own).title()))
    return rows + [(900, None), (901, ""), (902, " \n\t"), (903, "Üb er"), (3, rows[0][1]), (3, rows[0][1])]


def test_components_against_brute_force(spark):
    rows = make_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in sh.near_groups(df).collect())
    assert got == brute_components(rows)


def test_links_by_any_blocks_and_in_crowds(spark):
    rng = np.random.RandomState(3)
    centre = rng.randint(0, 2**63, 6, dtype=np.uint64)
    fps = {int(c) for c in centre}
    for c in centre:
        for _ in range(40):
            x = int(c)
            for j in rng.choice(64, rng.randint(1, 7), replace=False):
                x ^= 1 << int(j)
            fps.add(x)
    fps = sorted(fps)
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {}
    for x, s in zip(fps, signed):
        want.setdefault(root(x), set()).add(s)
    for crowd in (20_000, 5):
        got = {s: s for s in signed}
        for r in components(sh.linked(df, crowd)).collect():
            got[r.u] = r.v
        groups = {}
        for s, r in got.items():
            groups.setdefault(r, set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_masks_leave_no_pair_out():
    rng = random.Random(2)
    for blocks in (5, 6, 8):
        ms = sh.masks(blocks)
        for _ in range(200):
            x = sum(1 << j for j in rng.sample(range(64), 4)) & (2**64 - 1)
            assert any(x & (m & (2**64 - 1)) == 0 for m in ms)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 102), (102, 101)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


def test_long_text_and_columns_of_the_same_names(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, 5, "x"), (2, long + " tail", 6, "y"), (3, "short", 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string")
    assert {r.doc_id: r.component_id for r in sh.near_groups(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_a_large_star_is_one_component(spark):
    n = 200_000
    edges = spark.range(1, n).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    got = components(edges).agg(F.count("*"), F.max("v")).first()
    assert tuple(got) == (n - 1, 0)


def test_empty(spark):
    assert sh.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
