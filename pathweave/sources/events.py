"""Event export sources: windowed scan, date coverage, window resolution."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathweave.schema import RAW_EVENT
from pathweave.session import prepare


def _yyyymmdd(d: date) -> str:
    return d.strftime("%Y%m%d")


def _parse(s: str) -> date:
    return date(int(s[:4]), int(s[4:6]), int(s[6:8]))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Read an export written as Parquet partitioned by ``event_date`` (yyyyMMdd)."""
    prepare(spark)
    return (spark.read.schema(RAW_EVENT)
            .option("basePath", path).parquet(path))


def scan_events_window(events: DataFrame, start: str, end: str, require_user: bool = True) -> DataFrame:
    """Rows of days ``start``..``end`` (yyyyMMdd, inclusive), by default only those
    with a known user.

    On a partitioned export the predicate on ``event_date`` prunes whole day
    folders (PartitionFilters); the null check on the user is pushed to Parquet.
    """
    cond = F.col("event_date").between(start, end)
    if require_user:
        cond = cond & F.col("user_pseudo_id").isNotNull()
    return events.where(cond)


def date_coverage(events: DataFrame) -> DataFrame:
    """One row: earliest and latest ``event_date`` present (yyyyMMdd strings)."""
    return events.agg(F.min("event_date").alias("earliest_date"),
                      F.max("event_date").alias("latest_date"))


def resolve_window(events: DataFrame, days: int = 90) -> tuple[str, str]:
    """(start, end) yyyyMMdd: end = latest day present, start = end-(days-1),
    clamped to the earliest day.  Raises when nothing is there.

    Coverage is taken from the same frame that is later scanned, so a day that
    the scan cannot see never becomes the window end.
    """
    row = date_coverage(events).first()
    if row is None or row["latest_date"] is None:
        raise ValueError("no event days found")
    w_end = _parse(row["latest_date"])
    w_start = w_end - timedelta(days=max(1, int(days)) - 1)
    earliest = _parse(row["earliest_date"])
    if w_start < earliest:
        w_start = earliest
    if w_start > w_end:
        raise ValueError(f"empty window {w_start}..{w_end}")
    return _yyyymmdd(w_start), _yyyymmdd(w_end)


def window_days(window: tuple[str, str]) -> int:
    return (_parse(window[1]) - _parse(window[0])).days + 1


def window_end_date(window: tuple[str, str]) -> date:
    return _parse(window[1])
