"""Streaming counterparts on hand-made rows: duplicates dropped within the watermark,
gap-based sessions, a daily export overriding intraday rows, and exports of many files
in two write waves: no row is lost, whatever the files per trigger."""

import os
import uuid

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F
from rows import DAY, DAY0, ev, frame

from pathweave.plans.context import Ctx
from pathweave.plans.q_streaming import state_parts
from pathweave.schema import RAW_EVENT
from pathweave.streaming import intraday as I

MIN = 60_000_000


def name(of):
    return f"t-{of}-{uuid.uuid4().hex[:8]}"


def test_stream_dedup_and_session_windows(spark, tmp_path):
    rows = [ev("u", DAY0, "page_view", {"ga_session_id": 1}, eid=1),
            ev("u", DAY0, "page_view", {"ga_session_id": 1}, eid=1),            # exact duplicate
            ev("u", DAY0 + 10 * MIN, "purchase", {"ga_session_id": 1}, eid=2),
            ev("u", DAY0 + 90 * MIN, "page_view", {"ga_session_id": 1}, eid=3),  # > 30 min gap: new session
            ev("v", DAY0 + 5 * MIN, "page_view", {"ga_session_id": 2}, eid=4),
            ev("u", DAY0 + 600 * MIN, "page_view", {"ga_session_id": 1}, eid=5)]  # advances the watermark
    path = str(tmp_path / "export")
    frame(spark, rows).write.partitionBy("event_date").parquet(path)
    stream = I.stream_events_clean(I.read_event_stream(spark, path))
    clean = I.run_available_now(stream.select("user_pseudo_id", "event_name", "event_timestamp", "event_id", "event_ts"), name("clean"))
    assert sorted(r["event_id"] for r in clean.collect()) == [1, 2, 3, 4, 5]
    emitted = I.run_available_now(I.stream_session_rollup(stream), name("sess"))
    got = sorted((r["user_pseudo_id"], r["event_count"], r["purchases"]) for r in emitted.collect())
    # the watermark (last event - 2 h) closes all sessions but the last
    assert got == [("u", 1, 0), ("u", 2, 1), ("v", 1, 0)]
    every = emitted.unionByName(I.open_sessions(frame(spark, rows), emitted))
    whole = sorted((r["user_pseudo_id"], r["event_count"], r["purchases"]) for r in every.collect())
    assert whole == [("u", 1, 0), ("u", 1, 0), ("u", 2, 1), ("v", 1, 0)]


def test_late_rows_are_an_error(spark, tmp_path):
    path = str(tmp_path / "export")
    for n, day in enumerate((20, 20, 0)):  # the newer day first; a watermark drops rows from the batch after the next
        frame(spark, [ev("u", DAY0 + day * DAY, "page_view", None, eid=n)]).coalesce(1).write.mode("append").partitionBy("event_date").parquet(path)
    read = lambda: I.read_event_stream(spark, path, 1)
    with pytest.raises(I.LateRowsDropped):
        I.run_available_now(I.stream_events_clean(read()), name("late"))
    kept = I.run_available_now(I.stream_events_clean(read(), I.backlog_watermark(21)), name("wide"))
    assert kept.count() == 3


def test_daily_overrides_intraday(spark):
    daily = frame(spark, [ev("u", DAY0, "page_view", None, eid=1)])
    intraday = frame(spark, [ev("u", DAY0, "page_view", None, eid=9),             # same day: replaced
                             ev("u", DAY0 + 86_400_000_000, "page_view", None, eid=2)])
    got = sorted(r["event_id"] for r in I.daily_overrides_intraday(daily, intraday).collect())
    assert got == [1, 2]


@pytest.fixture(scope="module")
def waves(spark, tmp_path_factory):
    """An export of over 200 files, each day's rows in several files of two write waves, with some events delivered twice."""
    events = Ctx(spark, SF_SMALL).export("web").where("event_date <= '20240112'").cache()
    path = str(tmp_path_factory.mktemp("waves"))
    half = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    for part in (events.where(half), events.where(~half | (F.col("event_id") < 100))):
        part.repartition(12, F.xxhash64("event_id")).write.mode("append").partitionBy("event_date").parquet(path)
    n = sum(f.endswith(".parquet") for _, _, fs in os.walk(path) for f in fs)
    assert n > 120
    return events, path


@pytest.mark.parametrize("limit", [16, 64, 1000])
def test_no_row_is_lost(spark, waves, limit):
    events, path = waves
    known = events.where("user_pseudo_id is not null")
    want = {r[0] for r in known.select("event_id").collect()}
    stream = I.stream_events_clean(I.read_event_stream(spark, path, limit), I.backlog_watermark(12))
    clean = I.run_available_now(stream.select(*I.DEDUP_KEYS, "event_ts"), name("waves"), state_partitions=2)
    got = [r[0] for r in clean.select("event_id").collect()]
    assert len(got) == len(want) and set(got) == want
    appended = I.incremental_append(I.read_event_stream(spark, path, limit), name("append"))
    assert sorted(r[0] for r in appended.select("event_id").collect()) == sorted(r[0] for r in events.select("event_id").collect())


def test_a_repeated_batch_replaces_itself_only(spark, tmp_path):
    path = str(tmp_path / "table")
    day = [ev("u", DAY0 + i * MIN, "page_view", None, eid=i) for i in range(6)]
    I.append_batch(frame(spark, day[:3]), 0, path)
    I.append_batch(frame(spark, day[3:5]), 1, path)
    I.append_batch(frame(spark, day[3:5]), 1, path)   # run again after a failure
    I.append_batch(frame(spark, [day[5], day[0]]), 2, path)  # a late file for the day, with a row that was there
    assert sorted(r["event_id"] for r in I.read_appended(spark, path).collect()) == list(range(6))


def test_replay_holds_a_days_state_and_goes_on_where_it_stopped(spark, tmp_path):
    days = 6
    rows = [ev(f"u{u}", DAY0 + d * DAY + u * 60 * MIN + k * MIN, "page_view", {"ga_session_id": d}, eid=d * 1000 + u * 10 + k)
            for d in range(days) for u in range(20) for k in range(3)]
    rows += [r for r in rows if r[-1] % 7 == 0]  # delivered twice
    path = str(tmp_path / "export")
    frame(spark, rows).repartition(7).write.partitionBy("event_date").parquet(path)  # in no order of time
    export = spark.read.schema(RAW_EVENT).option("basePath", path).parquet(path).select(*I.DEDUP_KEYS, "event_date")
    names = sorted({r[0] for r in rows})
    run = lambda days, of: I.replay_days(export, days, lambda e: I.stream_session_rollup(
        I.stream_events_clean(e, I.REPLAY_WATERMARK)), of, 2)
    whole = name("replay")
    first = run(names[:4], whole)
    assert first.most_state_rows < 3 * 20 * 4  # the days within the watermark, not the days so far
    closed = first.rows.count()
    second = run(names, whole)
    assert second.rows_in == len([r for r in rows if r[0] in names[4:]])  # what was read before isn't read again
    emitted = second.rows
    assert emitted.count() > closed
    every = emitted.unionByName(I.open_sessions(export, emitted))
    got = sorted((r["user_pseudo_id"], r["start_us"], r["event_count"]) for r in every.collect())
    assert got == sorted((f"u{u}", DAY0 + d * DAY + u * 60 * MIN, 3) for d in range(days) for u in range(20))
    late = I.open_sessions(export, emitted)
    assert 0 < late.count() < 3 * 20  # the open end only, of 120 sessions


def test_state_partitions_grow_with_the_events_of_a_day():
    assert state_parts(3_000, 30) == 2  # a partition more costs a small stream time
    assert 12 <= state_parts(18_000_000, 30) < state_parts(36_000_000, 30) <= 40  # 600,000 and 1.2 million events a day


def test_touched_users_are_those_of_the_new_rows(spark):
    added = frame(spark, [ev("u", DAY0, "page_view", None, eid=1), ev(None, DAY0, "page_view", None, eid=2)])
    assert [r[0] for r in I.touched_users(added).collect()] == ["u"]
