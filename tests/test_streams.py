"""Stateful streams: late events, silence, latches over batches, states that go."""

import datetime as dt

import pytest

from corpusloom.streaming import events as E
from corpusloom.streaming import state as T

START = dt.datetime(2024, 1, 1)
RUN = "run_id long, seq long, event string, ts timestamp"
USAGE = "event_id long, ts timestamp, provider long, cost double"


def at(hours):
    return START + dt.timedelta(hours=hours)


class Feed:
    """A stream over files that are added one by one, run to its end after each."""

    def __init__(self, spark, tmp_path, schema, build, mode):
        self.spark, self.path, self.schema, self.build, self.mode, self.n = spark, str(tmp_path / "in"), schema, build, mode, 0
        self.state, self.out, self.late, self.held = str(tmp_path / "state"), [], 0, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        stream = self.build(self.spark.readStream.schema(self.schema).parquet(self.path))
        fresh = []
        q = stream.writeStream.outputMode(self.mode).option("checkpointLocation", self.state).trigger(availableNow=True)
        q = q.foreachBatch(lambda batch, _: fresh.extend(tuple(r) for r in batch.collect())).start()
        q.awaitTermination()
        self.late, self.held = T.late_rows(q), T.state_rows(q)
        return sorted(fresh)


def test_interrupted_runs_late_events_and_states(spark, tmp_path):
    feed = Feed(spark, tmp_path, RUN, lambda e: T.interrupted(e, "1 hour", 3600), "append")
    assert feed.add([(1, 1, "view", at(0)), (1, 2, "view", at(1)), (2, 1, "view", at(0)), (2, 2, "purchase", at(1)), (3, 1, "view", at(2))]) == []
    got = feed.add([(3, 2, "view", at(10)), (4, 1, "view", at(0.5))])  # run 4 is older than the watermark
    assert feed.late == 1
    assert got == [(1, at(1), 2)]  # run 2 ended by itself
    assert feed.held == 1  # run 3 alone
    assert feed.add([(5, 1, "click", at(20))]) == [(3, at(10), 2)]
    assert feed.held == 1


def test_status_is_that_of_the_latest_event_over_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, RUN, lambda e: T.live_status(e, "2 hours", 3600), "update")
    assert feed.add([(1, 5, "view", at(1)), (1, 9, "purchase", at(0.9)), (2, 1, "view", at(1))]) == [(1, 9, "running"), (2, 1, "running")]
    assert feed.add([(1, 6, "click", at(1)), (2, 2, "purchase", at(0.5))]) == [(1, 9, "failed"), (2, 2, "running")]
    feed.add([(3, 1, "view", at(30))])
    feed.add([(3, 2, "view", at(30.5))])
    assert feed.held == 1


def test_a_shut_latch_stays_shut(spark, tmp_path):
    feed = Feed(spark, tmp_path, USAGE, lambda u: T.latched_spend(u, 10.0, "12 hours"), "append")
    first = feed.add([(2, at(2), 1, 6.0), (1, at(1), 1, 3.0), (3, at(3), 1, None), (4, at(1), 2, 10.0)])
    assert [(r[0], r[3], r[4]) for r in first] == [(1, 3.0, False), (2, 9.0, False), (3, 9.0, False), (4, 10.0, False)]
    second = feed.add([(5, at(4), 1, 2.0), (6, at(5), 1, -8.0), (7, at(6), 1, 1.0), (8, at(6), 2, 0.0)])
    assert [(r[0], r[3], r[4]) for r in second] == [(5, 11.0, False), (6, 3.0, True), (7, 4.0, True), (8, 10.0, True)]
    feed.add([(9, at(80), 1, 1.0)])
    feed.add([(10, at(81), 1, 1.0), (11, at(7), 1, 1.0)])
    assert feed.late == 1 and feed.held == 1


@pytest.mark.parametrize("name", ["daily", "steps"])
def test_windows_go_when_the_watermark_has_passed_them(spark, tmp_path, name):
    if name == "daily":
        feed = Feed(spark, tmp_path, USAGE, lambda u: E.daily_spend(u, 5.0, "1 hour"), "update")
        rows = [[(i, at(24 * d), 1, 1.0)] for i, d in enumerate(range(4))]
    else:
        feed = Feed(spark, tmp_path, RUN, lambda e: E.step_counts(e, "1 hour"), "update")
        rows = [[(1, i, "view", at(24 * d))] for i, d in enumerate(range(4))]
    for r in rows:
        assert len(feed.add(r)) == 1
    assert feed.held <= 2
