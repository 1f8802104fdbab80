import pytest
from pyspark.sql import functions as F

from versemill.operators import search, study
from versemill.streaming import incremental

EVENTS = "ref string, seq long, ts long, kind string, q int"


def test_terms_as_files_come(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i % 3} the") for i in range(40)], "i long, text string").repartition(5)
    df.write.parquet(str(tmp_path / "in"))
    stream = incremental.book_stream(spark, str(tmp_path / "in"), "i long, text string")
    q = incremental.term_stream(stream).writeStream.outputMode("complete").format("memory").queryName("terms_seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("terms_seen").collect()} == {tuple(r) for r in search.terms(df, "text").collect()}
    hits = incremental.hit_stream(stream, "word1").writeStream.outputMode("append").format("memory").queryName("hits_seen").trigger(availableNow=True).start()
    hits.awaitTermination()
    assert spark.table("hits_seen").count() == 13


def test_no_notes_yet(spark, tmp_path):
    assert incremental.current_notes(spark, str(tmp_path)).count() == 0 == incremental.current_trash(spark, str(tmp_path)).count()


def test_notes_by_batches(spark, tmp_path):
    rows = [("a", 1, 10, "put", "x"), ("b", 2, 11, "put", "y"), ("a", 3, 12, "delete", None), ("a", 4, 13, "put", "z")]
    put = incremental.note_sink(str(tmp_path / "notes"))
    for i in (0, 1, 1):  # the last batch comes twice
        put(spark.createDataFrame(rows[2 * i : 2 * i + 2], "ref string, seq long, ts long, op string, body string"), i)
    at = str(tmp_path / "notes")
    assert {(r.ref, r.body) for r in incremental.current_notes(spark, at).collect()} == {("a", "z"), ("b", "y")}
    assert {(r.ref, r.body) for r in incremental.current_trash(spark, at).collect()} == {("a", "x")}
    put(spark.createDataFrame([("b", 5, 14, "delete", None)], "ref string, seq long, ts long, op string, body string"), 2)
    assert {(r.ref, r.body) for r in incremental.current_notes(spark, at).collect()} == {("a", "z")}
    assert {(r.ref, r.body) for r in incremental.current_trash(spark, at).collect()} == {("a", "x"), ("b", "y")}


def test_deck_as_keyed_state(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    events = [("a", i, 100 * i, "add" if i == 0 else "grade", None if i == 0 else 4) for i in range(6)] + [("b", 1, 5, "add", None)]
    df = spark.createDataFrame(events, EVENTS)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        df.coalesce(1).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = incremental.deck_stream(stream).writeStream.outputMode("update").format("memory").queryName("deck_seen").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    want = {(r.ref, r.state, r.reps, round(r.interval, 6), r.due) for r in study.fold_cards(df).collect()}
    assert {(r.ref, r.state, r.reps, round(r.interval, 6), r.due) for r in spark.table("deck_seen").collect()} == want


def test_late_grades(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:05:00", 0), ("2024-01-01 00:50:00", 4), ("2024-01-01 03:00:00", 3)], "at string, q int").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = incremental.grade_windows(stream).writeStream.outputMode("append").format("memory").queryName("late_seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.grades, r.misses) for r in spark.table("late_seen").collect()] == [(2, 1)]
