"""QA table: every raw event with the attempt whose time span contains it.

The span of an attempt runs from its start to the next attempt start of the same
(user, session).  Instead of an equi join with a range condition (which pairs
every event with every attempt of its session), attempt starts are unioned in as
marker rows and carried forward with the bucketed carry-forward: linear in the
number of events, and a hot session is split by time bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathweave.config import JobParams
from pathweave.functions import scalars as S
from pathweave.functions.params import event_param
from pathweave.operators.asof import carry_forward, next_value

USER, SESS = "user_pseudo_id", "ga_session_id"


def next_start(attempts: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """Each attempt with the start of the next attempt in its session (LEAD), bucketed by time.

    Attempts of one start time differ by level only; a hash of it orders them."""
    a = attempts.select(USER, SESS, "attempt_id", "attempt_start_ts", S.micros_from_timestamp("attempt_start_ts").alias("_us"),
                        F.hash("level_id").cast("long").alias("_tie"))
    out = next_value(a, [USER, SESS], "_us", ["_tie"], {"next_attempt_start_us": F.col("_us")}, params.attempt_bucket_us)
    return out.drop("_us", "_tie")


def event_attempt_qa(raw: DataFrame, attempts: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    ev = raw.where(F.col(USER).isNotNull()).select(
        USER, "event_date", "event_timestamp", "event_name", "event_params",
        "user_first_touch_timestamp", "event_id",
        event_param("ga_session_id").alias(SESS),
        F.col("geo.country").alias("country"),
        F.col("app_info.version").alias("app_version"),
        F.col("app_info.id").alias("app_bundle_id"),
        F.col("device.operating_system_version").alias("os_version"),
        F.col("device.category").alias("device_category"),
        F.col("traffic_source.source").alias("source"),
        F.col("traffic_source.medium").alias("medium"),
        F.col("traffic_source.name").alias("campaign"),
        S.normalize_platform("device.operating_system").alias("platform"),
    )
    # Only keys and times go through the carry-forward; attempt ids then join the wide
    # rows, which are shuffled once. Rows of equal keys are in one span.
    keys = [USER, SESS, "event_timestamp", "event_id"]
    narrow = raw.where(F.col(USER).isNotNull()).select(USER, event_param("ga_session_id").alias(SESS), "event_timestamp", "event_id")
    markers = attempts.select(USER, SESS, S.micros_from_timestamp("attempt_start_ts").alias("event_timestamp"), "attempt_id")
    tagged = (narrow.where(F.col(SESS).isNotNull()).distinct()
              .select("*", F.lit(1).alias("_is_event"), F.lit(None).cast("string").alias("_aid"))
              .unionByName(markers.select(USER, SESS, "event_timestamp", F.lit(None).cast("long").alias("event_id"),
                                          F.lit(0).alias("_is_event"), F.col("attempt_id").alias("_aid"))))
    # markers sort before events of the same microsecond: a span includes its start
    carried = carry_forward(tagged, [USER, SESS], "event_timestamp", ["_is_event", "_aid", "event_id"],
                            {"attempt_id": F.col("_aid")}, params.attempt_bucket_us)
    spans = carried.where((F.col("_is_event") == 1) & F.col("attempt_id").isNotNull()).select(*keys, "attempt_id")
    out = ev.join(spans, keys, "left")
    return out.select(
        USER, "event_date", "event_timestamp",
        S.timestamp_from_micros("event_timestamp").alias("event_ts"),
        "event_name", SESS, "event_params", "user_first_touch_timestamp", "attempt_id",
        "platform", "os_version", "device_category", "app_version", "app_bundle_id", "country",
        "source", "medium", "campaign", "event_id",
    )
