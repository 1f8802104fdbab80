import random

import pytest

from versemill.llm import neardup


def brute_sets(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute_kept(rows):
    """Of each component of pairs with Jaccard 0.8 or more, the smallest row."""
    sets = [brute_sets(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    return sorted(min(rows[i][0] for i in range(len(rows)) if comp[i] == c) for c in set(comp))


def make_rows():
    rng = random.Random(4)
    vocab = [f"{a}{b}{c}" for a in "kltmn" for b in "aeiou" for c in "rsd"]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 60, 250]))]
        for _ in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.randrange(len(base) // 20 + 1)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((len(rows) * 7 % 1009, " ".join(own).title()))
    return rows + [(2000, None), (2001, ""), (2002, " \n\t"), (2003, rows[0][1])]


@pytest.mark.parametrize("tile", [neardup.TILE, 200, 40])
def test_pairs_of_four_fifths_are_found(spark, tile):
    """Also where everything meets in tiles: groups of more shingles than a tile has."""
    rows = make_rows()
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string").repartition(3)
    kept = neardup.near_dedup(df, tile)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_a_large_group_and_a_passage_that_many_share(spark):
    """Copies with one word changed, in chains too, and texts that share half of their words: tiles, pivots and blocks all have work."""
    rng = random.Random(6)
    vocab = [f"{a}{b}{c}{d}" for a in "kltmn" for b in "aeiou" for c in "rsd" for d in "aeiou"]
    base, passage = ([rng.choice(vocab) for _ in range(n)] for n in (120, 60))
    rows = []
    for i in range(60):
        own = list(base)
        own[rng.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(own)))
    for i in range(60):
        base[rng.randrange(120)] = f"step{i}"
        rows.append((100 + i, " ".join(base)))
    for i in range(60):
        rows.append((200 + i, " ".join(passage + [rng.choice(vocab) for _ in range(30)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_kept(rows)
    for tile in (neardup.TILE, 2000, 300):
        assert sorted(r.doc_id for r in neardup.near_dedup(df, tile).collect()) == want


def test_rows_and_columns_stay(spark):
    """Columns with the names that the search would like, equal ids with different texts, equal rows, null ids."""
    rows = [(7, "one text of six words here", 1, "a"), (7, "quite another text that stays as well", 2, "b"), (None, "lonely text of nobody at all", 3, "c")]
    rows += [(None, "lonely text of nobody at all", 3, "c"), (9, "one text of six words here", 4, "d"), (1, None, 5, "e"), (2, "", 6, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, near_key int, Near_Text string")
    kept = neardup.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.near_key, r.Near_Text) for r in kept.collect()) == [(1, "a"), (2, "b"), (3, "c"), (5, "e")]


def test_long_texts(spark):
    long = [f"w{i % 7919}x{i % 101}" for i in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-500])), (3, " ".join(long[30_000:]))]
    assert sorted(r.doc_id for r in neardup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3]


def test_a_near_copy_that_differs_in_many_bits_goes(spark):
    import corpus_pipeline
    from versemill.llm import simhash

    words = [f"w{i}" for i in range(60)]
    other = list(words)
    other[20] = "changed"
    a, b = " ".join(words), " ".join(other)
    assert (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > simhash.MOST
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, df, "").collect()] == [1]


def test_simhash_search_brings_candidates(spark):
    """Sets meet exactly where links of four bits lead from one fingerprint to the other; copies of one set with other repeats too."""
    from versemill.llm import simhash

    rng = random.Random(9)
    sims = [rng.randrange(-(2**63), 2**63) for _ in range(40)]
    sims += [x ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for x in sims[:20]]
    sims += [x ^ 7 for x in sims[40:50]]
    rows = [(i, [x]) for i, x in enumerate(sims)] + [(100, [sims[30], sims[31]])]
    comp = list(range(len(sims))) + [30]
    sims += [sims[30]]
    links = [(i, j) for i in range(len(sims)) for j in range(i) if (sims[i] ^ sims[j]).bit_count() <= simhash.MOST] + [(len(sims) - 1, 31)]
    keys = {}
    for r in neardup.simhash_keys(spark.createDataFrame(rows, "fp long, sims array<long>")).collect():
        keys.setdefault(r.fp, set()).add(r.key)
    fps = [fp for fp, _ in rows]
    assert all(keys[fps[i]] & keys[fps[j]] for i, j in links)
    for i, j in links:
        comp = [comp[j] if c == comp[i] else c for c in comp]
    assert not any(keys[fps[i]] & keys[fps[j]] for i in range(len(fps)) for j in range(i) if comp[i] != comp[j])


def test_near_copies_meet_by_simhash_alone(spark, monkeypatch):
    """Where the bands' keys bring no two sets together, copies within four bits still do."""
    from versemill.llm import simhash

    words = [f"w{i}" for i in range(4000)]
    other = [*words[:3999], "end"]
    a, b = " ".join(words), " ".join(other)
    assert (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() <= simhash.MOST
    sign = neardup._sign

    def lone(batches):
        for x in sign(batches):
            at = x.schema.names.index("bands")
            yield x.set_column(at, "bands", neardup.pa.array([[h] for h in x.column("h").to_pylist()], neardup.pa.list_(neardup.pa.int64())))

    monkeypatch.setattr(neardup, "_sign", lone)
    df = spark.createDataFrame([(1, a), (2, b), (3, "quite another text of some words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.near_dedup(df).collect()) == [1, 3]


def test_empty(spark):
    assert neardup.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
