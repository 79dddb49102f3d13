"""Explicit schemas: the raw event export and the parameter struct."""

from pyspark.sql import types as T

PARAM_VALUE = T.StructType([
    T.StructField("string_value", T.StringType()),
    T.StructField("int_value", T.LongType()),
    T.StructField("float_value", T.DoubleType()),
    T.StructField("double_value", T.DoubleType()),
])

EVENT_PARAM = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", PARAM_VALUE),
])

RAW_EVENT = T.StructType([
    T.StructField("event_date", T.StringType()),
    T.StructField("event_timestamp", T.LongType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("user_pseudo_id", T.StringType()),
    T.StructField("user_first_touch_timestamp", T.LongType()),
    T.StructField("event_params", T.ArrayType(EVENT_PARAM)),
    T.StructField("device", T.StructType([
        T.StructField("category", T.StringType()),
        T.StructField("operating_system", T.StringType()),
        T.StructField("operating_system_version", T.StringType()),
    ])),
    T.StructField("app_info", T.StructType([
        T.StructField("version", T.StringType()),
        T.StructField("id", T.StringType()),
    ])),
    T.StructField("geo", T.StructType([T.StructField("country", T.StringType())])),
    T.StructField("traffic_source", T.StructType([
        T.StructField("source", T.StringType()),
        T.StructField("medium", T.StringType()),
        T.StructField("name", T.StringType()),
    ])),
    T.StructField("ecommerce", T.StructType([
        T.StructField("purchase_revenue", T.DoubleType()),
    ])),
    T.StructField("event_id", T.LongType()),
])

# Gameplay events read by the attempt builder (pushed to the scan as an IN list).
GAMEPLAY_EVENTS = (
    "level_start", "level_complete", "level_fail", "level_retry",
    "revive_clear_bar", "revive_extra_time",
    "fail_stack_full", "fail_time_up",
    "game_paused", "pause_quit_cancelled",
    "custom_session_start",
)
TERMINAL_EVENTS = ("level_complete", "level_fail")
REVIVE_EVENTS = ("revive_clear_bar", "revive_extra_time")
SNAPSHOT_EVENTS = ("fail_stack_full", "fail_time_up", "game_paused")
