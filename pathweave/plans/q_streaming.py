"""Registered queries: streaming and incremental counterparts (tier R); streams run over the export
files, each returns the written result."""

import hashlib
import uuid

from pyspark.sql import functions as F

from pathweave.operators import web as W
from pathweave.plans.incremental import GameTables, export_days
from pathweave.plans.registry import register
from pathweave.streaming import intraday as I


def _tag(c, name):
    return name + "-" + hashlib.sha1(c.export_path("web").encode()).hexdigest()[:10]


#: Events of a day for one more partition of a stream's state: a partition is one task of each day.
STATE_ROWS = 50_000
STREAMED = [*I.DEDUP_KEYS, "event_date"]


def _days(c, product="web"):
    return [r[0] for r in c.export(product).select("event_date").distinct().orderBy("event_date").collect()]  # one row per day


def state_parts(events: int, days: int) -> int:
    """Partitions of the state of a stream that is fed so many events in so many days."""
    return 2 + events // days // STATE_ROWS


def _replay(c, make, name):
    """The web export fed to a stream day by day, with a day's watermark."""
    events, days = c.export("web").select(*STREAMED), _days(c)
    parts = state_parts(events.count(), len(days))  # a count of a stored export reads footers only
    return I.replay_days(events, days, lambda e: make(I.stream_events_clean(e, I.REPLAY_WATERMARK)), _tag(c, name), parts)


@register("stream_events_clean")
def stream_events_clean(c):
    return _replay(c, lambda clean: clean.select(*I.DEDUP_KEYS), "clean").rows


@register("stream_session_rollup")
def stream_session_rollup(c):
    """All sessions of the export: those that the stream closed, and the open ones of its end."""
    emitted = _replay(c, I.stream_session_rollup, "sessions").rows
    out = emitted.unionByName(I.open_sessions(c.export("web").select(*STREAMED), emitted))
    return out.select("user_pseudo_id", F.col("session.start").alias("session_start"),
                      F.col("session.end").alias("session_end"), "event_count", "start_us", "end_us", "purchases")


@register("daily_overrides_intraday")
def daily_overrides_intraday(c):
    ex, days = c.export("web"), _days(c)
    late, early = days[len(days) * 2 // 3], days[len(days) // 2]
    daily = ex.where(F.col("event_date") <= late)
    intraday = ex.where(F.col("event_date") >= early)  # overlapping days: daily wins
    return I.daily_overrides_intraday(daily, intraday).select("event_id", "event_date", "user_pseudo_id")


@register("incremental_append")
def incremental_append(c):
    t = I.incremental_append(I.read_event_stream(c.spark, c.export_path("web")), _tag(c, "incremental"))
    return t.groupBy("event_date").agg(F.count(F.lit(1)).alias("events"))


@register("incremental_materialize")
def incremental_materialize(c):
    """Sessions of the export without its last third of days, brought up to date with those days."""
    events, days = c.raw_web, _days(c)
    new = F.col("event_date") >= days[len(days) * 2 // 3]
    build = lambda raw: W.web_sessions(raw, c.params, W.web_session_events(raw))
    out = I.incremental_sessions(build(events.where(~new)), events, I.touched_users(events.where(new)), build)
    return out.select("session_id", "user_pseudo_id", "event_count", "duration_seconds", "converted_this_session")


_GAME_TABLES = {}


def _game_tables(c):
    """Game tables built from two thirds of the days, but one, and then brought up to date with all of them."""
    if c.store.root not in _GAME_TABLES:
        export, days = c.export("game"), export_days(c.spark, c.export_path("game"), *c.window)
        names = sorted(days)
        first = names[:len(names) * 2 // 3]
        first.pop(len(first) // 2)
        t = GameTables(c.spark, f"{c.store.root}/incremental-{uuid.uuid4().hex}", c.params)
        t.update(export, {d: days[d] for d in first})
        t.update(export, days)  # the late day and the last third
        _GAME_TABLES[c.store.root] = t
    return _GAME_TABLES[c.store.root]


@register("incremental_game_sessions")
def incremental_game_sessions(c):
    return _game_tables(c).sessions()


@register("incremental_game_attempts")
def incremental_game_attempts(c):
    return _game_tables(c).attempts()


@register("incremental_game_journeys")
def incremental_game_journeys(c):
    return _game_tables(c).journeys(c.w_end)


@register("incremental_game_levels")
def incremental_game_levels(c):
    return _game_tables(c).levels(c.w_end)
