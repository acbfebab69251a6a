"""Streaming jobs that stop and start again give the table of one run."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from shelfwise.sources import folders
from shelfwise.streaming import jobs as J
from shelfwise.streaming.state import KeyedTable

T0 = dt.datetime(2024, 1, 1)
ORDERS = "order_id long, user_id long, ts timestamp, created_at date, total_cents long, status string"
EVENTS = "event_id long, user_id long, ts timestamp, action string, value double"


def at(day, hour=0, minute=0):
    return T0 + dt.timedelta(days=day, hours=hour, minutes=minute)


def order(i, user, day, cents, status="paid"):
    return (i, user, at(day), at(day).date(), cents, status)


def event(i, user, day, hour=0, minute=0, action="view", value=1.0):
    return (i, user, at(day, hour, minute), action, value)


class Feed:
    """A folder in which files arrive one after another."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0

    def arrive(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/in/{self.n:03d}")
        self.n += 1

    def stream(self, files_per_batch=1):
        return J.stream_files(self.spark, f"{self.path}/in/*", self.spark.createDataFrame([], self.schema).schema, files_per_batch)

    def places(self, name="a"):
        return {"out": f"{self.path}/{name}/out", "checkpoint": f"{self.path}/{name}/chk"}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


THREE = [[order(1, 1, 0, 100), order(2, 2, 0, 50)], [order(3, 1, 5, 30), order(4, 3, 4, 7, "pending")], [order(5, 2, 2, 1), order(6, 1, 9, 9), order(7, 4, 9, 2)]]


def state_of(df):
    return df.select("user_id", "recency", "frequency", "monetary")


def test_three_runs_equal_one(spark, tmp_path):
    as_of = spark.range(1).select(F.lit(at(10).date()).alias("d"))
    feed = Feed(spark, tmp_path, ORDERS)
    for part in THREE:
        feed.arrive(part)
        got = rows(state_of(J.incremental_rfm(feed.stream(), as_of, **feed.places("steps"))))
    once = rows(state_of(J.incremental_rfm(feed.stream(3), as_of, **feed.places("once"))))
    assert got == once == [(1, 1, 3, 139), (2, 8, 2, 51), (4, 1, 1, 2)]
    assert rows(state_of(J.incremental_rfm(feed.stream(), as_of, **feed.places("steps")))) == got  # nothing new has come


def test_stopped_after_a_batch_was_written(spark, tmp_path, monkeypatch):
    """The job dies once a batch is on disk but not yet in the checkpoint; the batch is tried again and does not count twice."""
    as_of = spark.range(1).select(F.lit(at(10).date()).alias("d"))
    feed = Feed(spark, tmp_path, ORDERS)
    for part in THREE:
        feed.arrive(part)
    commit = KeyedTable.commit

    def dies(self, batch, batch_id):
        commit(self, batch, batch_id)
        if batch_id == 1:
            raise RuntimeError("lost")
    monkeypatch.setattr(KeyedTable, "commit", dies)
    with pytest.raises(StreamingQueryException):
        J.incremental_rfm(feed.stream(), as_of, **feed.places())
    monkeypatch.setattr(KeyedTable, "commit", commit)
    assert rows(state_of(J.incremental_rfm(feed.stream(), as_of, **feed.places()))) == [(1, 1, 3, 139), (2, 8, 2, 51), (4, 1, 1, 2)]


def test_half_written_batch_does_not_count(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, n long").schema
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], {"n": "sum"})
    table.commit(spark.createDataFrame([(1, 2), (1, 3)], schema), 0)
    table.commit(spark.createDataFrame([(1, 10)], schema), 1)
    folders.remove(spark, f"{tmp_path}/t/delta/1/_SUCCESS")
    assert rows(table.read()) == [(1, 5)]
    table.commit(spark.createDataFrame([(1, 10)], schema), 1)
    assert rows(table.read()) == [(1, 15)]


def test_compaction(spark, tmp_path):
    """Any number of batches gives the same table; old generations go, and a batch below the base is not added again."""
    schema = spark.createDataFrame([], "k long, n long, low long, seen long").schema
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], {"n": "sum", "low": "min", "seen": "last"}, compact_every=2)
    for i in range(7):
        table.commit(spark.createDataFrame([(i % 2, 1, -i, i), (9, 1, i, i)], schema), i)
    assert rows(table.read()) == [(0, 4, -6, 6), (1, 3, -5, 5), (9, 7, 0, 6)]
    base, deltas = table.state()
    assert base == 5 and deltas == [6]
    assert folders.children(spark, f"{table.out}/base") == ["3", "5"] and folders.children(spark, f"{table.out}/delta") == ["4", "5", "6"]
    table.commit(spark.createDataFrame([(9, 100, 0, 0)], schema), 4)
    assert rows(table.read())[-1] == (9, 7, 0, 6)


def test_null_keys_and_wrong_merges(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, n long").schema
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], {"n": "sum"})
    assert rows(table.read()) == []
    for i in range(2):
        table.commit(spark.createDataFrame([(None, 1), (None, None)], schema), i)
    assert rows(table.read()) == [(None, 2)]
    with pytest.raises(ValueError):
        KeyedTable(spark, "x", schema, ["k"], {"n": "median"})
    with pytest.raises(ValueError):
        KeyedTable(spark, "x", schema, ["k"], {})


@pytest.mark.parametrize("job", [J.live_sales, J.shopping_sessions, J.unique_events, J.live_funnel])
def test_empty_stream(spark, tmp_path, job):
    feed = Feed(spark, tmp_path, ORDERS if job is J.live_sales else EVENTS)
    feed.arrive([])
    assert rows(job(feed.stream(), **feed.places())) == []


def test_late_rows_and_closed_days(spark, tmp_path):
    """A day is open until the watermark of the runs before has passed its end; what comes later for it is dropped."""
    feed = Feed(spark, tmp_path, ORDERS)
    feed.arrive([order(1, 1, 0, 100), order(2, 1, 1, 10)])
    first = rows(J.live_sales(feed.stream(), "2 days", **feed.places()))
    assert first == [(at(0).date(), 100, 1), (at(1).date(), 10, 1)]
    feed.arrive([order(3, 2, 0, 5), order(4, 2, 9, 1)])  # day 0 is late, but still open: the watermark is day -1
    assert rows(J.live_sales(feed.stream(), "2 days", **feed.places()))[0] == (at(0).date(), 105, 2)
    feed.arrive([order(5, 3, 1, 5), order(6, 3, 7, 2)])  # the watermark is day 7 by now: day 1 is closed, day 7 open
    assert rows(J.live_sales(feed.stream(), "2 days", **feed.places())) == [  # in the order of their text
        (at(0).date(), 105, 2), (at(9).date(), 1, 1), (at(1).date(), 10, 1), (at(7).date(), 2, 1)]


def test_session_over_a_stop(spark, tmp_path):
    """A session that is open when the job ends goes on in the next run and comes out once."""
    feed = Feed(spark, tmp_path, EVENTS)
    feed.arrive([event(1, 1, 0, 0, 0), event(2, 1, 0, 0, 20), event(3, 2, 0, 0, 0)])
    assert rows(J.shopping_sessions(feed.stream(), **feed.places())) == []
    feed.arrive([event(4, 1, 0, 0, 45), event(5, 3, 1, 0, 0)])
    J.shopping_sessions(feed.stream(), **feed.places())
    feed.arrive([event(6, 3, 2, 0, 0)])
    got = rows(J.shopping_sessions(feed.stream(), **feed.places()).select("user_id", "start", "end", "n"))
    assert got == [(1, at(0), at(0, 1, 15), 3), (2, at(0), at(0, 0, 30), 1), (3, at(1), at(1, 0, 30), 1)]


def test_repeated_ids_over_runs(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    for _ in range(3):
        feed.arrive([event(1, 1, 0), event(2, 1, 0), event(2, 1, 0)])
        got = rows(J.unique_events(feed.stream(), **feed.places()).select("event_id"))
    assert got == [(1,), (2,)]


def test_segments_are_written_once(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    for segment in ("a", "b"):
        feed.arrive([event(1, 1, 0), event(2, 7, 0)])
        known = spark.createDataFrame([(1, segment)], "user_id long, segment string")
        got = rows(J.enriched_events(feed.stream(), known, **feed.places()).select("user_id", "segment"))
    assert got == [(1, "a"), (1, "a"), (7, None), (7, None)]


def test_both_places_or_none(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    feed.arrive([event(1, 1, 0)])
    with pytest.raises(ValueError):
        J.live_funnel(feed.stream(), out=str(tmp_path / "x"))
