"""Registered queries: each building block (sources, scalars, filters, joins,
aggregates, windows) checked on its own, over whole tables."""

from pyspark.sql import functions as F

from pathweave.functions import aggs as A
from pathweave.functions import scalars as S
from pathweave.functions.params import event_param, event_param_alias, event_param_any
from pathweave.operators import game as G
from pathweave.operators.asof import carry_forward
from pathweave.operators.slice import optional_in_filter
from pathweave.plans.registry import register
from pathweave.sources import tables as TB
from pathweave.sources.events import date_coverage, scan_events_window

U = "user_pseudo_id"


# ---------------------------------------------------------------- sources (S*)
@register("scan_events_window")
def scan_events_window_q(c):
    ev = scan_events_window(c.raw_web, "20240105", "20240120")
    return ev.select(U, "event_name", "event_timestamp", "event_id", "event_date")


@register("date_coverage")
def date_coverage_q(c):
    return date_coverage(c.raw_web)


@register("resolve_window")
def resolve_window_q(c):
    return TB.resolve_window_df(c.raw_web, 7)


@register("summary_profile")
def summary_profile_q(c):
    return TB.summary_profile({"game_sessions": c.game_sessions, "game_level_attempts": c.attempts,
                               "game_user_journeys": c.game_journeys, "game_levels": c.game_levels})


@register("bounded_preview")
def bounded_preview_q(c):
    return TB.bounded_preview(c.web_journeys, [U])[0]


@register("bounded_preview_meta")
def bounded_preview_meta_q(c):
    return TB.bounded_preview(c.web_journeys, [U])[1]


@register("session_filter_options")
def session_filter_options_q(c):
    return TB.session_filter_options(c.game_sessions)


@register("empty_attempts_check")
def empty_attempts_check_q(c):
    from pathweave.plans.materialize import empty_attempts_check
    return empty_attempts_check(c.attempts)


# ---------------------------------------------------------------- scalars (P*)
@register("event_param")
def event_param_q(c):
    return c.raw_game.select("event_id", event_param("ga_session_id").alias("ga_session_id"),
                             event_param("engagement_time_msec").alias("engagement_time_msec"),
                             event_param("fail_reason", "string").alias("fail_reason"),
                             event_param("attempt_number").alias("attempt_number"))


@register("event_param_any")
def event_param_any_q(c):
    return c.raw_game.select("event_id", event_param_any("level_id").alias("level_id"),
                             event_param_any("stack_item_2").alias("stack_item_2"),
                             event_param_any("stack_item_last").alias("stack_item_last"))


@register("event_param_alias")
def event_param_alias_q(c):
    return c.raw_game.select("event_id", event_param_alias(("shop_purhcase", "shop_purchase"))
                             .alias("shop_purchase_flag"))


@register("flatten_structs")
def flatten_structs_q(c):
    return c.raw_web.select("event_id", F.col("device.category").alias("device_category"),
                            F.col("device.operating_system").alias("os_name"),
                            F.col("geo.country").alias("country"), F.col("app_info.version").alias("app_version"),
                            F.col("traffic_source.source").alias("source"),
                            F.col("traffic_source.medium").alias("medium"),
                            F.col("ecommerce.purchase_revenue").alias("purchase_revenue"))


@register("parse_event_date")
def parse_event_date_q(c):
    return c.raw_web.select("event_id", "event_date", S.parse_event_date("event_date").alias("event_date_parsed"))


@register("normalize_platform")
def normalize_platform_q(c):
    return c.raw_game.select("event_id", S.normalize_platform("device.operating_system").alias("platform"))


@register("session_key")
def session_key_q(c):
    return c.web_sessions.select(U, "session_id")


@register("attempt_key")
def attempt_key_q(c):
    return c.attempts.select("attempt_id", U, "ga_session_id", "attempt_start_ts")


@register("url_path")
def url_path_q(c):
    return c.table("pages").select("page_id", S.url_path("url").alias("url_path"))


@register("parse_int_list")
def parse_int_list_q(c):
    b = S.parse_int_list(event_param("boosters_used", "string"))
    return c.raw_game.select("event_id", *[S.int_at(b, i).alias(f"b{i}") for i in range(4)])


@register("leading_int")
def leading_int_q(c):
    return c.attempts.select("attempt_id", "level_id", S.leading_int("level_id").alias("level_id_numeric"))


@register("day_part")
def day_part_q(c):
    return c.web_sessions.select("session_id", S.day_part("session_start_ts").alias("day_part"),
                                 S.is_weekend("session_start_ts").alias("is_weekend"))


@register("weekday_weekend")
def weekday_weekend_q(c):
    return c.web_journeys.select(U, "weekday_weekend")


@register("capped_engagement_s")
def capped_engagement_q(c):
    return c.game_sessions.select("session_id", "engagement_time_s")


@register("duration_seconds")
def duration_seconds_q(c):
    return c.web_sessions.select("session_id", "duration_seconds")


@register("safe_ratio")
def safe_ratio_q(c):
    return c.game_levels.select("level_id", "completion_rate", "fail_rate_stack_full", "churn_on_level_rate")


@register("user_day_number")
def user_day_number_q(c):
    return c.attempts.select("attempt_id", "first_open_date", "user_day_number")


@register("decimal_revenue")
def decimal_revenue_q(c):
    return c.web_journeys.select(U, "total_revenue")


@register("clean_items")
def clean_items_q(c):
    items = S.clean_items(*[event_param_any(k) for k in ("stack_item_1", "stack_item_2", "stack_item_3",
                                                            "stack_item_last")])
    return c.raw_game.select("event_id", items.alias("items"))


# ---------------------------------------------------------------- filters (F*)
@register("optional_in_filter")
def optional_in_filter_q(c):
    return c.game_sessions.where(optional_in_filter({"country": ["US", "IN"], "app_version": []})).select(
        "session_id", "country", "app_version")


@register("stuck_level")
def stuck_level_q(c):
    return G.stuck_levels(c.attempts)


@register("qualify_first")
def qualify_first_q(c):
    return TB.rank_first(c.web_sessions, [U], [F.desc("event_count"), F.desc("session_start_ts"),
                                                F.desc("session_id")]).select(U, "session_id")


# ---------------------------------------------------------------- joins (J*)
@register("retention_flags")
def retention_flags_q(c):
    return c.game_journeys.select(U, "d1_retained", "d7_retained", "d30_retained",
                                  "is_eligible_for_d1", "is_eligible_for_d7", "is_eligible_for_d30")


@register("first_session_depth")
def first_session_depth_q(c):
    return G.first_session_depth(c.attempts, G.game_session_agg(c.game_sessions))


@register("slice_semi_join")
def slice_semi_join_q(c):
    s = c.game_sessions.where(F.col("country") == "BR")
    return c.attempts.join(s.select("session_id"), "session_id", "left_semi").select("attempt_id", "session_id")


@register("lateral_unnest")
def lateral_unnest_q(c):
    a = c.attempts.where(F.col("fail_reason") == "stack_full")
    return a.select("attempt_id", F.posexplode("stack_fail_items").alias("pos", "item"))


# ---------------------------------------------------------------- aggregates (A*)
@register("first_row_value")
def first_row_value_q(c):
    return c.web_sessions.select("session_id", "source", "device_category", "landing_page")


@register("top1_by")
def top1_by_q(c):
    return c.game_journeys.select(U, "last_app_version", "first_touch_source", "first_session_id")


@register("top1_by_multi")
def top1_by_multi_q(c):
    return c.game_journeys.select(U, "farthest_level", "farthest_level_numeric")


@register("top1_by_ignore_nulls")
def top1_by_ignore_nulls_q(c):
    return c.game_journeys.select(U, "farthest_completed_level", "ab_test_assignment")


@register("ordered_array_limit")
def ordered_array_limit_q(c):
    ev = c.game_events
    return A.ordered_array_limit(ev, [U, "ga_session_id"], ["event_timestamp", "event_id"],
                                 {"first4": F.col("event_name")}, 4)


@register("top_value")
def top_value_q(c):
    return c.game_journeys.select(U, "primary_platform", "primary_country", "primary_app_version",
                                  "time_of_day_mode")


@register("approx_median")
def approx_median_q(c):
    return c.game_levels.select("level_id", "median_duration_complete_s", "median_duration_fail_s",
                                "median_attempts_to_beat", "p90_attempts_to_beat")


@register("array_concat_agg")
def array_concat_agg_q(c):
    return c.attempts.select("attempt_id", "stack_fail_items")


@register("topk_array")
def topk_array_q(c):
    return c.game_levels.select("level_id", "top_stack_stall_items")


@register("count_distinct_if")
def count_distinct_if_q(c):
    a = c.attempts
    return a.groupBy("level_id").agg(
        F.count_distinct(U).alias("users"),
        F.count_distinct(F.when(F.col("outcome") == "complete", F.col(U))).alias("completers"))


# ---------------------------------------------------------------- windows (W*)
@register("carry_forward")
def carry_forward_q(c):
    gp = c.gameplay
    st = G.stitch_attempts(gp, c.params)
    return st.select("event_id", "attempt_start_ts_us", "attempt_level_id", "latest_retry_streak")


@register("partition_max")
def partition_max_q(c):
    return c.attempts.select("attempt_id", "ab_test")


@register("is_first_attempt_ever")
def is_first_attempt_ever_q(c):
    return c.attempts.select("attempt_id", "is_first_attempt_ever")


@register("session_rank")
def session_rank_q(c):
    """Session rank ascending and descending per user, as bucketed running counts
    (no window holds a whole user)."""
    from pathweave.operators.asof import running_row_number
    s = c.web_sessions.select(U, "session_id", F.unix_micros("session_start_ts").alias("_ts"))
    asc = running_row_number(s, [U], "_ts", ["session_id"], 86_400_000_000, "rank_asc")
    n = s.groupBy(U).agg(F.count(F.lit(1)).alias("_n"))
    return asc.join(n, U).select("session_id", "rank_asc", (F.col("_n") - F.col("rank_asc") + 1).alias("rank_desc"))


@register("carry_forward_bucketed_small")
def carry_forward_bucketed_small_q(c):
    """Same carry with one-minute buckets: many buckets per session exercise the
    cross-bucket step; must equal the single-window result."""
    gp = c.gameplay
    name = F.col("event_name")
    st = carry_forward(gp, [U, "ga_session_id"], "event_timestamp", ["event_id"],
                       {"attempt_start_ts_us": F.when(name == "level_start", F.col("event_timestamp"))},
                       60_000_000)
    return st.select("event_id", "attempt_start_ts_us")
