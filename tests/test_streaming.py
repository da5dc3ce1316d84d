"""The edit log."""

from __future__ import annotations

from datetime import datetime, timedelta

from prismora.streaming import edits

T0 = datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(s, T0 + timedelta(seconds=k), k, a, float(v)) for k, (s, a, v) in enumerate(rows)], "source long, ts timestamp, seq long, action string, value double")


def test_undo_drops_the_redo_branch(spark):
    rows = [(1, "purchase", 0.1), (1, "purchase", 0.2), (1, "click", 0), (1, "purchase", 0.3), (1, "view", 0), (1, "purchase", 0.3)]
    (r,) = edits.histories(log(spark, rows)).collect()
    assert (r.states, r.at, r.value) == (3, 2, 0.3)


def test_history_is_bounded(spark):
    (r,) = edits.histories(log(spark, [(1, "purchase", k / 1000) for k in range(1, 150)])).collect()
    assert (r.states, r.at, r.value) == (100, 99, 0.149)


def test_stale_results_go(spark):
    rows = [(1, "view", 0), (1, "click", 0), (1, "signup", 0), (1, "error", 0), (1, "signup", 0)]
    got = {r.seq: (r.generation, r.published) for r in edits.stale(log(spark, rows)).collect()}
    assert got == {0: (1, True), 1: (1, False), 2: (2, True), 3: (2, False), 4: (3, True)}


def test_newest_by_time_then_number(spark):
    rows = [(1, "a", 1), (2, "b", 2), (1, "c", 3)]
    assert {r.source: r.action for r in edits.newest(log(spark, rows)).collect()} == {1: "c", 2: "b"}
