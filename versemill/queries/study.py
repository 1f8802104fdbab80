"""Study store over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from versemill.catalog import query
from versemill.operators import study
from versemill.session import shared_dir, table
from versemill.streaming import incremental

NOW = 1_704_100_000  # seconds, inside the range of the events
# Our choice of grades for event types: error 0, view 3, click 4, purchase 5; a signup adds (or resets) the card.
_EVENTS = """ev AS (SELECT user_id AS ref, event_id AS seq, epoch(date_trunc('second', ts))::BIGINT AS ts, CASE event_type WHEN 'signup' THEN 'add' ELSE 'grade' END AS kind,
    CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 3 WHEN 'click' THEN 4 WHEN 'purchase' THEN 5 END AS q FROM events)"""
_GAP = "(0.1 - (5 - e.q) * (0.08 + (5 - e.q) * 0.02))"
_EASED = f"greatest(1.3::DOUBLE, least(3.5::DOUBLE, c.ease + {_GAP}))"
_SPACED = f"CASE WHEN c.reps = 0 THEN 1.0::DOUBLE WHEN c.reps = 1 THEN 6.0::DOUBLE WHEN e.q >= 4 THEN c.interval * {_EASED} ELSE c.interval * 1.2 END"
CARDS = f"""{_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY seq) AS i FROM ev),
c AS (SELECT ref, 0 AS i, false AS here, 0.0::DOUBLE AS interval, 0.0::DOUBLE AS ease, 0 AS reps, 0 AS state, 0::BIGINT AS due FROM (SELECT DISTINCT ref FROM ev)
UNION ALL SELECT c.ref, c.i + 1, c.here OR e.kind = 'add',
CASE WHEN e.kind = 'add' THEN 0.0 WHEN NOT c.here THEN c.interval WHEN c.state = 0 THEN 0.0 WHEN e.q = 0 THEN 0.0 WHEN c.state = 1 THEN 1.0 ELSE {_SPACED} END,
CASE WHEN e.kind = 'add' THEN 2.5 WHEN NOT c.here THEN c.ease WHEN c.state = 0 THEN c.ease WHEN e.q = 0 THEN greatest(1.3::DOUBLE, least(3.5::DOUBLE, c.ease - CASE WHEN c.state = 1 THEN 0.15::DOUBLE ELSE 0.2::DOUBLE END)) WHEN c.state = 1 THEN c.ease ELSE {_EASED} END,
CASE WHEN e.kind = 'add' THEN 0 WHEN NOT c.here THEN c.reps WHEN c.state = 0 THEN 0 WHEN e.q = 0 THEN c.reps ELSE c.reps + 1 END,
CASE WHEN e.kind = 'add' THEN 0 WHEN NOT c.here THEN c.state WHEN c.state = 0 OR e.q = 0 THEN 1 ELSE 2 END,
CASE WHEN e.kind = 'add' THEN e.ts + 600 WHEN NOT c.here THEN c.due WHEN c.state = 0 OR e.q = 0 THEN e.ts + 600 WHEN c.state = 1 THEN e.ts + 86400 ELSE e.ts + floor(({_SPACED}) * 86400)::BIGINT END
FROM c JOIN o e ON e.ref = c.ref AND e.i = c.i + 1),
cards AS (SELECT ref, interval, ease, reps, state, due FROM c WHERE here AND (ref, i) IN (SELECT ref, max(i) FROM c GROUP BY ref))"""


def grade_events(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "add").otherwise("grade")
    q = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 3).when(F.col("event_type") == "click", 4).when(F.col("event_type") == "purchase", 5)
    ts = F.unix_timestamp(F.date_trunc("second", "ts"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("ref"), F.col("event_id").alias("seq"), ts.alias("ts"), kind.alias("kind"), q.alias("q"))


def six(x):
    """round(x, 6) as the SQL has it: the product is rounded, which beyond 2^53 millionths isn't the nearest decimal."""
    return F.round(F.col(x) * 1e6) / 1e6


@query("memory_fold", f"WITH RECURSIVE {CARDS} SELECT ref, round(interval, 6) AS interval, round(ease, 6) AS ease, reps, state, due FROM cards")
def memory_fold(spark, sf_dir):
    cards = study.fold_cards(grade_events(spark, sf_dir))
    return cards.select("ref", six("interval").alias("interval"), six("ease").alias("ease"), "reps", "state", "due")


@query("memory_stats", f"WITH RECURSIVE {CARDS} SELECT count(*) AS total, count(*) FILTER (due <= {NOW}) AS due, count(*) FILTER (state = 1) AS learning, count(*) FILTER (state = 2) AS review FROM cards")
def memory_stats(spark, sf_dir):
    return study.memory_stats(study.fold_cards(grade_events(spark, sf_dir)), NOW)


@query("memory_due", f"WITH RECURSIVE {CARDS} SELECT ref, due FROM cards WHERE due <= {NOW} + 9999999 ORDER BY due, ref LIMIT 30")
def memory_due(spark, sf_dir):
    return study.due_queue(study.fold_cards(grade_events(spark, sf_dir)), NOW + 9_999_999).select("ref", "due")


_NOTES = """ev AS (SELECT 'Talk ' || user_id::VARCHAR || ' 1:' || (user_id % 7)::VARCHAR AS ref, event_id AS seq, epoch(date_trunc('second', ts))::BIGINT AS ts, CASE event_type WHEN 'error' THEN 'delete' ELSE 'put' END AS op, props AS body FROM events),
l AS (SELECT *, coalesce(count(*) FILTER (op = 'delete') OVER (PARTITION BY ref ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM ev),
lives AS (SELECT ref, life, arg_max(body, seq) FILTER (op = 'put') AS body, count(*) FILTER (op = 'put') AS puts, min(ts) FILTER (op = 'put') AS created, max(ts) FILTER (op = 'put') AS updated, max(ts) FILTER (op = 'delete') AS trashed_at FROM l GROUP BY ref, life)"""


def note_events(spark, sf_dir):
    ref = F.concat(F.lit("Talk "), F.col("user_id").cast("string"), F.lit(" 1:"), (F.col("user_id") % 7).cast("string"))
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    ts = F.unix_timestamp(F.date_trunc("second", "ts"))
    return table(spark, sf_dir, "events").select(ref.alias("ref"), F.col("event_id").alias("seq"), ts.alias("ts"), op.alias("op"), F.col("props").alias("body"))


@query("notes_latest", rf"WITH {_NOTES} SELECT ref, body, regexp_extract(ref, ':([0-9]+)\s*$', 1)::INT AS verse, created, updated FROM lives WHERE trashed_at IS NULL AND puts > 0")
def notes_latest(spark, sf_dir):
    return study.notes(note_events(spark, sf_dir))


@query("notes_trash", f"WITH {_NOTES} SELECT ref, body, trashed_at FROM lives WHERE trashed_at IS NOT NULL AND puts > 0")
def notes_trash(spark, sf_dir):
    return study.trash(note_events(spark, sf_dir))


@query("stream_term_index", "SELECT term, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '''?[A-Za-z0-9]+''?')) AS term FROM conversations) GROUP BY term")
def stream_term_index(spark, sf_dir):
    """ST-01: the term index of conversations as a stream of files that ends when all are read; the last state of each term stands."""


    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    talks = table(spark, sf_dir, "conversations")
    talks.select("conv_id", "turn", "text").repartition(4).write.parquet(f"{at}/in")
    stream = incremental.term_stream(incremental.book_stream(spark, f"{at}/in", "conv_id long, turn long, text string"))

    def put(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{at}/out/run={batch_id}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = spark.read.parquet(f"{at}/out")
    return seen.groupBy("term").agg(F.max_by("count", "batch").alias("count"))


