"""Study store: cards as a fold over ordered events, notes as events (M-01..M-04, A-04, W-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATE = "struct<interval: double, ease: double, reps: int, state: int, due: bigint>"
MINUTES10, DAY = 600, 86_400
# Of the spaced repetition schedule.
EASE, LEAST_EASE, MOST_EASE = 2.5, 1.3, 3.5
LEARNING_MISS, REVIEW_MISS = 0.15, 0.2  # taken off the ease
GAIN, LOSS, LOSS_GAP = 10, 8, 2  # ease after a hit, in exact hundredths: + GAIN - gap * (LOSS + gap * LOSS_GAP), the gap being 5 - q
FIRST_DAYS, SECOND_DAYS, HARD = 1.0, 6.0, 1.2


def _state(interval: Column, ease: Column, reps: Column, state: Column, due: Column) -> Column:
    return F.struct(
        interval.cast("double").alias("interval"), ease.cast("double").alias("ease"), reps.cast("int").alias("reps"), state.cast("int").alias("state"), due.cast("bigint").alias("due")
    )


def _bound(ease: Column) -> Column:
    return F.greatest(F.lit(LEAST_EASE), F.least(F.lit(MOST_EASE), ease))


def grade(card: Column, q: Column, ts: Column) -> Column:
    """M-04: a card after one grade. A new card ignores the grade; a learning one leaves or stays; a known one is spaced out."""
    miss = q == 0
    gap = 5 - q
    eased = _bound(card["ease"] + (F.lit(GAIN) - gap * (F.lit(LOSS) + gap * F.lit(LOSS_GAP))) / 100)
    spaced = F.when(card["reps"] == 0, F.lit(FIRST_DAYS)).when(card["reps"] == 1, F.lit(SECOND_DAYS)).when(q >= 4, card["interval"] * eased).otherwise(card["interval"] * F.lit(HARD))
    new = _state(F.lit(0.0), card["ease"], F.lit(0), F.lit(1), ts + MINUTES10)
    learning = F.when(miss, _state(F.lit(0.0), _bound(card["ease"] - F.lit(LEARNING_MISS)), card["reps"], F.lit(1), ts + MINUTES10)).otherwise(
        _state(F.lit(FIRST_DAYS), card["ease"], card["reps"] + 1, F.lit(2), ts + DAY)
    )
    known = F.when(miss, _state(F.lit(0.0), _bound(card["ease"] - F.lit(REVIEW_MISS)), card["reps"], F.lit(1), ts + MINUTES10)).otherwise(
        _state(spaced, eased, card["reps"] + 1, F.lit(2), ts + F.floor(spaced * DAY))
    )
    return F.when(card["state"] == 0, new).when(card["state"] == 1, learning).otherwise(known)


def fold_cards(events: DataFrame, ref: str = "ref") -> DataFrame:
    """M-03/M-04: the card of each ref after its events (ref, seq, ts, kind, q) in the order of seq; `add` makes or resets a card.

    Grades before the first add meet no card and do nothing. A null ref has no card; a null seq comes last. Events of one ref are one array: a
    card has as many as one reader makes.
    """
    history = F.array_sort(F.collect_list(F.struct(F.col("seq").isNull().alias("late"), "seq", "ts", "kind", "q")))
    fresh = lambda e: _state(F.lit(0.0), F.lit(EASE), F.lit(0), F.lit(0), e["ts"] + MINUTES10)
    step = lambda card, e: F.when(e["kind"] == "add", fresh(e)).when(card.isNotNull(), grade(card, e["q"], e["ts"])).otherwise(card)
    folded = events.filter(F.col(ref).isNotNull()).groupBy(ref).agg(F.aggregate(history, F.lit(None).cast(STATE), step).alias("card"))
    return folded.filter(F.col("card").isNotNull()).select(ref, "card.*")


def memory_stats(cards: DataFrame, now: Column | int) -> DataFrame:
    """A-04: cards in all, due, learning and in review."""
    return cards.agg(
        F.count("*").alias("total"), F.count_if(F.col("due") <= now).alias("due"), F.count_if(F.col("state") == 1).alias("learning"), F.count_if(F.col("state") == 2).alias("review")
    )


def due_queue(cards: DataFrame, now: Column | int, limit: int = 30, ref: str = "ref") -> DataFrame:
    """W-01: the cards that have been due longest."""
    return cards.filter(F.col("due") <= now).orderBy("due", ref).limit(limit)


def _lives(events: DataFrame) -> DataFrame:
    """Events of a ref between two deletions together: what the note held, since when, and when it was deleted."""
    w = Window.partitionBy("ref").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    put = F.col("op") == "put"
    lives = events.withColumn("life", F.coalesce(F.count_if(F.col("op") == "delete").over(w), F.lit(0)))
    return lives.groupBy("ref", "life").agg(
        F.max_by("body", F.when(put, F.col("seq"))).alias("body"),
        F.count_if(put).alias("puts"),
        F.min(F.when(put, F.col("ts"))).alias("created"),
        F.max(F.when(put, F.col("ts"))).alias("updated"),
        F.max(F.when(F.col("op") == "delete", F.col("ts"))).alias("trashed_at"),
    )


def notes(events: DataFrame) -> DataFrame:
    """M-01: current notes (ref, body, verse, created, updated) from events (ref, seq, ts, op, body) with ops put and delete."""
    verse = F.coalesce(F.nullif(F.regexp_extract("ref", r":(\d+)\s*$", 1), F.lit("")).cast("int"), F.lit(1))
    alive = _lives(events).filter(F.col("trashed_at").isNull() & (F.col("puts") > 0))
    return alive.select("ref", "body", verse.alias("verse"), "created", "updated")


def trash(events: DataFrame) -> DataFrame:
    """M-02: deleted notes with what they held; deleting what isn't there leaves nothing."""
    return _lives(events).filter(F.col("trashed_at").isNotNull() & (F.col("puts") > 0)).select("ref", "body", "trashed_at")
