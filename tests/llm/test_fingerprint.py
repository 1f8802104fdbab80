import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from versemill.llm import fingerprint as fp


def test_incremental_counts_equal_counting_anew():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abé😀 ") for _ in range(rng.randrange(40)))
        follow = "".join(rng.choice("xyß") for _ in range(rng.randrange(20)))
        k = len(text) // 3
        edited = text[: len(text) - k] + follow[:k]
        sha, digest = fp.edited_pair(text, fp.bucket_counts(text.encode()), follow)
        assert sha == hashlib.sha256(edited.encode()).hexdigest() and digest == fp.fingerprint(edited)


def test_counts_against_brute_force():
    raw = bytes(np.random.RandomState(2).randint(0, 256, 50).astype(np.uint8))
    want = np.zeros(256, dtype=int)
    for i in range(len(raw)):
        for a, b in fp.PATTERNS:
            if i + b < len(raw):
                want[fp.TABLES[0][raw[i]] ^ fp.TABLES[a][raw[i + a]] ^ fp.TABLES[b][raw[i + b]]] += 1
    assert (fp.bucket_counts(raw) == want).all()


def test_likeness_is_bounded_and_orders_edits():
    rng = random.Random(3)
    words = [f"w{rng.randrange(500)}" for _ in range(400)]
    text, other = " ".join(words), " ".join(f"v{rng.randrange(500)}q" for _ in range(400))
    near = " ".join(words[:380])
    a, b, c = map(fp.fingerprint, (text, near, other))
    assert fp.likeness(a, a) == 1.0 and 0 <= fp.likeness(a, c) < fp.likeness(a, b) < 1


def brute(rows):
    signed = lambda t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).view(np.int64)
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), int(signed(r[1]))))
    out = []
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        k = len(t) // 3
        e = t[: len(t) - k] + n[:k]
        ft, fe, fn = map(fp.fingerprint, (t, e, n))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), ft, fe, fp.likeness(ft, fe), fp.likeness(ft, fn)))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i * 13 % 997, " ".join(rng.choice("ab cd éf gh".split()) for _ in range(rng.randrange(50)))) for i in range(120)]
    rows += [(2000, None), (2001, ""), (-4, "é" * 40_000)]
    same = [(500, f"text {i} of one id") for i in range(60)] + [(None, f"nobody's text {i}") for i in range(60)] + [(None, "twice"), (None, "twice")]
    for extra in ([], [(13, rows[1][1])], same):
        df = spark.createDataFrame([(*r, "x", 1) for r in rows + extra], "doc_id long, text string, fingerprint string, part int").repartition(5)
        assert sorted((tuple(r) for r in fp.fingerprint_edits(df).collect()), key=str) == brute(rows + extra)


def test_equal_ids_are_spread(spark):
    df = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    order = [F.desc("doc_id"), F.xxhash64("text").asc()]
    sizes = df.repartitionByRange(4, *order).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2000
    assert fp.fingerprint_edits(df).count() == 4000


def test_one_and_no_rows(spark):
    one = fp.fingerprint_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert [r.near_next for r in one] == [1.0] and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert fp.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
