"""Cards against their SQL to the last digit: many grades, intervals of millions of years, rows with nulls."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from versemill.queries import ORACLES, QUERIES

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def make_events():
    rng, rows = random.Random(8), []
    start = datetime(2024, 1, 1)

    def add(user, kind, at=True):
        n = len(rows)
        rows.append((n, start + timedelta(seconds=7 * n) if at else None, user, kind, 1.0, ""))

    tight = [[0, 0, q, 3, 3, 3, 0, p, 4] for q in (3, 4, 5) for p in (3, 4, 5)]  # an ease one unit off loses a second of these
    for user in range(400):
        add(user, "signup")
        grades = tight[user] if user < len(tight) else [rng.choice([0, 3, 3, 4, 5]) for _ in range(20)]
        for q in grades:
            add(user, {0: "error", 3: "view", 4: "click", 5: "purchase"}[q])
    for user in range(400, 800):
        add(user, "signup")
        for _ in range(24):
            add(user, rng.choice(["purchase", "purchase", "click"]))
    return rows, add


def differing(spark, at, name, rows):
    spark.createDataFrame(rows, EVENTS).repartition(3).write.parquet(f"{at}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS FROM '{at}/events.parquet/*.parquet'")
    want = {tuple(r) for r in duck.sql(ORACLES[name]).fetchall()}
    assert want
    return want ^ {tuple(r) for r in QUERIES[name](spark, at).collect()}


def test_fold_equals_sql(spark, tmp_path):
    assert not differing(spark, str(tmp_path), "memory_fold", make_events()[0])


def odd_events():
    rows, add = make_events()
    del rows[:]
    for user in (1, 2, 3, None):
        for kind in ("signup", "view", "click", "click", None, "click", "odd", "view"):
            add(user, kind)
    add(2, "purchase", at=False)
    rows[9] = (None, *rows[9][1:])  # of user 2: comes last
    return rows


def test_fold_of_nulls_equals_sql(spark, tmp_path):
    assert not differing(spark, str(tmp_path), "memory_fold", odd_events())


@pytest.mark.parametrize("events", [lambda: make_events()[0], odd_events])
def test_stream_equals_sql(spark, tmp_path, events):
    pytest.importorskip("google.protobuf")
    assert not differing(spark, str(tmp_path), "stream_deck", events())
