import random
import zlib

from versemill.llm.sharding import find_splitters, histogram_shards, sort_keys, write_shards


def make(spark, n=4000, hot=0):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randrange(400) + str(i)) for i in range(n)] + [(n + i, "copied text " * 9) for i in range(hot)]
    rows += [(10**6, None), (None, "no id"), (3, "twice"), (3, "twice")]
    return rows, spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, shard string").repartition(6)


def check(rows, out, slack):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows
    )
    sizes, slots = {}, {}
    for r in out:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(24))
    mean = sum(sizes.values()) / 24
    assert max(abs(x - mean) for x in sizes.values()) < slack * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_near_equal_shards(spark):
    rows, df = make(spark)
    out = histogram_shards(df).collect()
    check(rows, out, 0.03)


def test_hot_group_is_split_and_small_groups_are_not(spark):
    rows, df = make(spark, hot=2500)
    out = histogram_shards(df).collect()
    check(rows, out, 0.03)
    rows, df = make(spark, hot=6)
    out = histogram_shards(df).collect()
    assert len({r.shard for r in out if r.text_crc32 == zlib.crc32(b"copied text " * 9)}) == 1


def test_probing_finds_exact_ranks(spark):
    _, df = make(spark, 500)
    keys = sort_keys(df)
    rows = sorted((r.h, r.g, r.size) for r in keys.collect())
    total = sum(r[2] for r in rows)
    for i, (h, g) in enumerate(find_splitters(keys, 5), 1):
        below = sum(s for a, b, s in rows if (a, b) < (h, -(2**63) if g is None else g))
        assert abs(below - total * i / 5) <= max(r[2] for r in rows)


def test_write_and_empty(spark, tmp_path):
    rows, df = make(spark, 200)
    write_shards(df.withColumnRenamed("shard", "lang"), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 4
    write_shards(df, str(tmp_path / "cells"), 4, file_bytes=3000)  # the rows have a column `shard` of their own
    cells = spark.read.parquet(str(tmp_path / "cells"))
    assert sorted(str(r.row.doc_id) for r in cells.collect()) == sorted(str(r[0]) for r in rows)
    assert len(list((tmp_path / "cells").glob("shard=0/*.parquet"))) > 1
    assert histogram_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert histogram_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count() == 1


def test_long_texts(spark):
    rows = [(1, "é" * 400_000), (2, "a"), (3, None)]
    out = {r.doc_id: r for r in histogram_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].size == 800_008 and out[3].size == 8 and out[1].text_crc32 == zlib.crc32(("é" * 400_000).encode())
