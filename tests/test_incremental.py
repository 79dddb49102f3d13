"""The incremental game build equals the full one: after a new day, a late file, a rewritten day and a day
that leaves the window; old days aren't read."""

import datetime as dt
import shutil

import pytest
from check import compare
from conftest import SF_SMALL
from pyspark.sql import functions as F

from pathweave.operators import game as G
from pathweave.plans.context import Ctx
from pathweave.plans.incremental import GameTables, export_days
from pathweave.plans.output import canonical

TABLES = ("sessions", "attempts", "journeys", "levels")


@pytest.fixture(scope="module")
def ctx(spark):
    return Ctx(spark, SF_SMALL)


def full(ctx, events, w_end):
    """The tables as the whole build makes them."""
    sessions, ufo = G.game_sessions(events, ctx.params), G.user_first_open(events)
    attempts = G.level_attempts(events, ufo, ctx.params)
    journeys = G.game_user_journeys(sessions, attempts, ufo, w_end, ctx.params)
    return sessions, attempts, journeys, G.game_levels(attempts, journeys)


def same(ctx, tables, events, end):
    w_end = dt.datetime.strptime(end, "%Y%m%d").date()
    got = tables.sessions(), tables.attempts(), tables.journeys(w_end), tables.levels(w_end)
    for name, a, b in zip(TABLES, got, full(ctx, events, w_end), strict=True):
        a, b = canonical(a), canonical(b)
        problem = compare(a.columns, [tuple(r) for r in a.collect()], b.columns, [tuple(r) for r in b.collect()])
        assert problem is None, f"{name}: {problem}"


def append(df, path):
    df.coalesce(1).write.mode("append").partitionBy("event_date").parquet(path)


def test_updates_equal_full_builds(spark, ctx, tmp_path):
    path = str(tmp_path / "export")
    events = ctx.export("game").where("event_date between '20240101' and '20240110'").cache()
    late = (F.col("event_date") == "20240104") & (F.col("event_id") % 3 == 0)
    append(events.where("event_date <= '20240108'").where(~late), path)
    tables = GameTables(spark, str(tmp_path / "tables"), ctx.params)

    def update(start="20240101", end="20240110", check=True):
        export = ctx.spark.read.schema(events.schema).option("basePath", path).parquet(path)
        days = export_days(spark, path, start, end)
        run = tables.update(export, days)
        if check:
            same(ctx, tables, export.where(F.col("event_date").between(start, end)), max(days))
        return run

    first = update(check=False)
    assert len(first.changed) == 8 and first.read == first.changed
    append(events.where("event_date = '20240109'"), path)   # a new day
    run = update(check=False)
    assert run.changed == ["20240109"] and set(run.read) <= {"20240108", "20240109"}  # sessions last two days
    assert set(run.swapped["sessions"]) == {f"d{d}" for d in {*run.read, *run.changed}}
    append(events.where(late), path)                        # a late file
    run = update()
    assert run.changed == ["20240104"] and set(run.read) <= {"20240103", "20240104", "20240105"}
    shutil.rmtree(f"{path}/event_date=20240106")            # a day written anew without some of its rows
    append(events.where("event_date = '20240106' and event_id % 2 = 0"), path)
    assert update(check=False).changed == ["20240106"]
    append(events.where("event_date = '20240110'"), path)   # the window moves on: a day comes, a day goes
    run = update(start="20240102")
    assert run.changed == ["20240101", "20240110"] and not set(run.read) & {"20240104", "20240105", "20240106"}
    assert update(start="20240102", check=False).changed == []           # nothing new, nothing done


def test_a_failed_update_is_repeated(spark, ctx, tmp_path, monkeypatch):
    events = ctx.export("game").where("event_date between '20240101' and '20240104'").cache()
    days = {f"2024010{d}": "1" for d in (1, 2, 3, 4)}
    tables = GameTables(spark, str(tmp_path / "tables"), ctx.params)
    first = {d: s for d, s in days.items() if d != "20240104"}
    tables.update(events.where("event_date < '20240104'"), first)
    renew = GameTables._renew_users

    def fails(self, users, run):
        raise RuntimeError("an executor's last words")

    monkeypatch.setattr(GameTables, "_renew_users", fails)
    with pytest.raises(RuntimeError):
        tables.update(events, days)
    assert tables.days() == first                            # sessions are swapped, but the run doesn't count
    monkeypatch.setattr(GameTables, "_renew_users", renew)
    assert tables.update(events, days).changed == ["20240104"]
    same(ctx, tables, events, "20240104")


def test_an_update_scans_the_days_of_touched_sessions_only(spark, ctx, tmp_path):
    path = ctx.export_path("game")
    export = ctx.export("game")
    days = export_days(spark, path, "20240101", "20240130")
    tables = GameTables(spark, str(tmp_path / "tables"), ctx.params)
    names = sorted(days)
    tables.update(export, {d: days[d] for d in names[:-1]})
    scans = []
    real = G.game_session_events
    tables.update.__func__.__globals__["G"].game_session_events = lambda raw: scans.append(raw) or real(raw)
    try:
        run = tables.update(export, days)
    finally:
        G.game_session_events = real
    files = {f.split("event_date=")[1][:8] for f in scans[0].inputFiles()}
    plan = scans[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [event_date" in plan.replace("isnotnull(event_date#", "event_date#") or "event_date" in plan.split("PartitionFilters")[1][:80]
    assert set(run.read) <= set(names[-2:]) and files >= set(run.read)


def test_no_days_and_unknown_tables(spark, tmp_path):
    tables = GameTables(spark, str(tmp_path / "none"))
    assert tables.days() == {}
    with pytest.raises(ValueError, match="hasn't been built"):
        tables.sessions()
