"""Incremental build of the game tables: only what changed days touch is built anew.

The reference rebuilds its whole window. Here a change travels down the chain:

    changed days -> touched sessions and users -> sessions, attempts -> users -> levels

* A day has changed if its files have (new, late, rewritten, or out of the window).
* ``touches`` keeps, for each day, the sessions and users that had events on it, with the
  day's share of the first-open rule. So the days that hold a touched session's events are
  known without reading events, and the export is read on those days alone.
* Sessions and attempts lie in partitions by their day; those of touched sessions are
  replaced. Users lie in partitions by a hash; the state of touched users is made
  anew from their sessions and attempts. What hangs on the window's end (churn, retention, groups)
  is no state: it is computed from the users on reading.
* Levels are kept as sums per day and as counted values (durations, items), which add up
  over days and can be taken out again with their day; the medians are exact.

A partition is swapped by one dynamic overwrite of rows that have been checkpointed. The list of
days is written last: a run that failed before is repeated from the same days, and as rows are
replaced by key, what it had swapped is swapped again to the same rows.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pathweave.config import JobParams
from pathweave.functions import scalars as S
from pathweave.functions.params import event_param
from pathweave.operators import game as G
from pathweave.operators.game import SESS, USER
from pathweave.session import checkpoint_dir
from pathweave.sources.store import _fs_status, _input_signature

#: Partitions of the tables by user.
USER_PARTS = 64
DAYS = "day string, signature string"


def _day_part(day: Column) -> Column:
    return F.date_format(day, "'d'yyyyMMdd")


def _user_part() -> Column:
    return F.format_string("u%02d", F.pmod(F.xxhash64(USER), F.lit(USER_PARTS)))


def export_days(spark: SparkSession, path: str, start: str, end: str) -> dict[str, str]:
    """The days of a stored export within a window, each with a signature of its files."""
    found = {}
    _, *files = _input_signature(spark, path)
    for name, length, time in files:
        day = name.rpartition("event_date=")[2].split("/")[0]
        if "event_date=" in name and name.endswith(".parquet") and start <= day <= end:
            found.setdefault(day, []).append((name.rsplit("/", 1)[1], length, time))
    return {d: str(sorted(f)) for d, f in found.items()}


@dataclass
class Update:
    """What a run did: the days whose files had changed, the days of the export it read, the partitions it swapped."""

    changed: list[str]
    read: list[str] = field(default_factory=list)
    swapped: dict[str, list[str]] = field(default_factory=dict)


class GameTables:
    """Stored game tables under ``root``; ``update`` brings them up to date with an export.

    DataFrames from the reading methods are valid until the next update.
    """

    def __init__(self, spark: SparkSession, root: str, params: JobParams = JobParams()):
        checkpoint_dir(spark)
        self.spark, self.root, self.params = spark, root, params

    # ------------------------------------------------------------------ storage
    def _path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def _stored(self, name: str) -> DataFrame | None:
        if _fs_status(self.spark, self._path(name)) is None:
            return None
        return self.spark.read.parquet(self._path(name))

    def table(self, name: str) -> DataFrame:
        """A stored table without its partition column."""
        t = self._stored(name)
        if t is None:
            raise ValueError(f"{name} hasn't been built")
        return t.drop("part")

    def _swap(self, name: str, parts: list[str], fresh: DataFrame, gone: DataFrame | None, keys: list[str], run: Update) -> None:
        """Partitions ``parts`` of a table become ``fresh`` and what they held, without rows of the keys ``gone`` (None: all)."""
        rows, old = fresh, self._stored(name)
        if old is not None and gone is not None:
            stay = old.where(F.col("part").isin(parts)).join(gone, keys, "left_anti")
            rows = rows.unionByName(stay.select(*fresh.columns))
        rows = rows.checkpoint()
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self._path(name))
        full = {r[0] for r in rows.select("part").distinct().collect()}  # no more than ``parts``
        for part in set(parts) - full:
            self._remove(f"{self._path(name)}/part={part}")
        run.swapped[name] = parts

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def days(self) -> dict[str, str]:
        """Days that the tables stand for, with the signatures of their files."""
        if _fs_status(self.spark, self._path("days") + "/_SUCCESS") is None:
            return {}
        return dict(self.spark.read.schema(DAYS).parquet(self._path("days")).collect())  # one row per day

    # ------------------------------------------------------------------ update
    def update(self, export: DataFrame, days: dict[str, str]) -> Update:
        """Bring the tables up to date with ``days`` of ``export`` (raw events with their event_date).

        ``days`` are all days of the window with a signature of their files each (see ``export_days``).
        """
        known = self.days()
        run = Update(sorted(d for d in {*days, *known} if days.get(d) != known.get(d)))
        if not run.changed:
            return run
        touched = self._touch(export, [d for d in run.changed if d in days], run)
        users = touched.select(USER).distinct().checkpoint()
        sessions = touched.where(F.col(SESS).isNotNull()).distinct().checkpoint()
        of_session = [USER, SESS]

        held = self.table("touches").join(sessions, of_session, "left_semi")
        run.read = sorted(r[0] for r in held.select("event_date").distinct().collect())  # days of the window at most
        raw = export.where(F.col("event_date").isin(run.read))
        parts = [f"d{d}" for d in sorted({*run.read, *run.changed})]
        events = G.game_session_events(raw).join(sessions, of_session, "left_semi").checkpoint()
        made = G.game_sessions(raw, self.params, events)
        self._swap("sessions", parts, made.withColumn("part", _day_part(F.col("session_date"))), sessions, of_session, run)
        gameplay = G.gameplay_events(raw).join(sessions, of_session, "left_semi").checkpoint()
        made = G.attempt_rollup(G.stitch_attempts(gameplay, self.params).checkpoint())
        self._swap("attempt_parts", parts, made.withColumn("part", _day_part(F.col("session_date"))), sessions, of_session, run)
        self._add_up_levels(parts, run)
        self._renew_users(users, run)
        self.spark.createDataFrame(sorted(days.items()), DAYS).coalesce(1).write.mode("overwrite").parquet(self._path("days"))
        return run

    def _touch(self, export: DataFrame, present: list[str], run: Update) -> DataFrame:
        """Swap the touches of the changed days; (user, session) with events on one of them before or after."""
        raw = export.where(F.col("event_date").isin(present) & F.col(USER).isNotNull())
        parts = [f"d{d}" for d in run.changed]
        opened = F.when(F.col("event_name") == "first_open", S.parse_event_date("event_date"))
        fresh = raw.groupBy("event_date", USER, event_param("ga_session_id").alias(SESS)).agg(
            F.min(F.nullif(F.col("user_first_touch_timestamp"), F.lit(0))).alias("first_touch"), F.min(opened).alias("first_open"))
        old = self._stored("touches")
        before = old.where(F.col("part").isin(parts)).select(USER, SESS).checkpoint() if old is not None else None
        self._swap("touches", parts, fresh.withColumn("part", F.concat(F.lit("d"), "event_date")), None, [], run)
        after = self._stored("touches").where(F.col("part").isin(parts)).select(USER, SESS)
        return (after if before is None else after.union(before)).distinct()

    def _renew_users(self, users: DataFrame, run: Update) -> None:
        parts = sorted(r[0] for r in users.select(_user_part()).distinct().collect())  # USER_PARTS at most
        opened = self.first_opens().join(users, USER, "left_semi").checkpoint()
        attempts = self.table("attempt_parts").join(users, USER, "left_semi")
        attempts = G.with_user_facts(attempts, opened).checkpoint()
        state = G.user_state(self.table("sessions").join(users, USER, "left_semi"), attempts, opened)
        self._swap("users", parts, state.withColumn("part", _user_part()), users, [USER], run)
        self._swap("level_users", parts, G.level_users(attempts).withColumn("part", _user_part()), users, [USER], run)

    def _add_up_levels(self, parts: list[str], run: Update) -> None:
        a = self._stored("attempt_parts").where(F.col("part").isin(parts)).withColumn("level_id_numeric", S.leading_int("level_id"))
        self._swap("level_days", parts, G.level_sums(a, ("level_id", "part")), None, [], run)
        timed = F.when(F.col("outcome").isin(*G.MEDIANS.values()) & F.col("duration_s").isNotNull(),
                       F.array(F.struct(F.col("outcome").alias("kind"), F.col("duration_s").cast("string").alias("value"))))
        stalled = F.when(F.col("fail_reason") == "stack_full", F.transform("stack_fail_items", lambda i: F.struct(
            F.lit("item").alias("kind"), i.alias("value"))))
        empty = F.array().cast("array<struct<kind:string,value:string>>")
        values = a.select("part", "level_id", F.explode(F.concat(F.coalesce(timed, empty), F.coalesce(stalled, empty))).alias("v"))
        self._swap("level_values", parts, values.groupBy("part", "level_id", "v.kind", "v.value").agg(F.count(F.lit(1)).alias("n")), None, [], run)

    # ------------------------------------------------------------------ reading
    def first_opens(self) -> DataFrame:
        day = F.coalesce(F.to_date(F.timestamp_micros(F.min("first_touch"))), F.min("first_open"))
        return self.table("touches").groupBy(USER).agg(day.alias("first_open_date"))

    def sessions(self) -> DataFrame:
        return self.table("sessions")

    def attempts(self) -> DataFrame:
        return G.with_user_facts(self.table("attempt_parts"), self.first_opens())

    def journeys(self, w_end: date, params: JobParams | None = None) -> DataFrame:
        return G.journey_flags(self.table("users"), w_end, params or self.params)

    def levels(self, w_end: date, params: JobParams | None = None) -> DataFrame:
        days, users = self.table("level_days"), self.table("level_users")
        more = [c for c in days.columns if c not in ("level_id", "level_id_numeric")]
        sums = days.groupBy("level_id").agg(F.max("level_id_numeric").alias("level_id_numeric"), *[F.sum(c).alias(c) for c in more])
        counted = self.table("level_values").groupBy("level_id", "kind", "value").agg(F.sum("n").alias("n"))
        retention = G.level_retention(users, self.journeys(w_end, params))
        return G.level_ratios(sums.join(self._medians(counted), "level_id", "left"), G.attempts_to_beat(users), retention, self._items(counted))

    def _medians(self, counted: DataFrame) -> DataFrame:
        """The smallest value that half of the values don't exceed; one row per distinct value, not per attempt."""
        t = counted.where("kind != 'item'").withColumn("v", F.col("value").cast("double"))
        of = Window.partitionBy("level_id", "kind")
        t = t.select("level_id", "kind", "v", F.sum("n").over(of).alias("total"), F.sum("n").over(of.orderBy("v")).alias("so_far"))
        reached = F.col("so_far") * 2 >= F.col("total")
        return t.groupBy("level_id").agg(*[F.min(F.when(reached & (F.col("kind") == o), F.col("v"))).alias(n) for n, o in G.MEDIANS.items()])

    def _items(self, counted: DataFrame, k: int = 5) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("level_id").orderBy(F.desc("n"), F.asc("value")))
        top = counted.where("kind = 'item'").select("level_id", "value", place.alias("place")).where(F.col("place") <= k)
        return top.groupBy("level_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])
                                           .alias("top_stack_stall_items"))
