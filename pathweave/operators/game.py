"""Mobile-game tables: sessions, level attempts, user journeys, levels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathweave.config import JobParams
from pathweave.functions import aggs as A
from pathweave.functions import scalars as S
from pathweave.functions.params import PARAM_ARRAYS, event_param, event_param_alias, event_param_any, split_params
from pathweave.operators.asof import carry_forward
from pathweave.schema import GAMEPLAY_EVENTS, REVIVE_EVENTS, SNAPSHOT_EVENTS, TERMINAL_EVENTS

USER, SESS = "user_pseudo_id", "ga_session_id"


# --------------------------------------------------------------------------- sessions
def game_session_events(raw: DataFrame) -> DataFrame:
    ev = raw.where(F.col(USER).isNotNull()).select(
        USER, "event_name", "event_timestamp", "event_id",
        S.parse_event_date("event_date").alias("event_date_parsed"),
        event_param("ga_session_id").alias(SESS),
        event_param("engagement_time_msec").alias("engagement_time_msec"),
        S.normalize_platform("device.operating_system").alias("platform"),
        F.col("device.operating_system_version").alias("os_version"),
        F.col("device.category").alias("device_category"),
        F.col("app_info.version").alias("app_version"),
        F.col("app_info.id").alias("app_bundle_id"),
        F.col("geo.country").alias("country"),
        F.col("traffic_source.source").alias("src"),
        F.col("traffic_source.medium").alias("med"),
        F.col("traffic_source.name").alias("cmp"),
    )
    return ev.where(F.col(SESS).isNotNull())


def game_sessions(raw: DataFrame, params: JobParams = JobParams(), events: DataFrame | None = None) -> DataFrame:
    """One row per (user, ga_session_id); same plan shape as ``web_sessions``."""
    ev = events if events is not None else game_session_events(raw)
    name = F.col("event_name")
    counters = ev.groupBy(USER, SESS).agg(
        F.min("event_date_parsed").alias("session_date"),
        F.min("event_timestamp").alias("start_us"),
        F.count(F.lit(1)).alias("event_count"),
        S.capped_engagement_s("engagement_time_msec", params.engagement_cap_ms).alias("engagement_time_s"),
        F.count_if(name == "screen_view").alias("screen_view_count"),
        F.bool_or(name == "first_open").alias("had_first_open"),
        F.bool_or(name == "app_exception").alias("had_app_exception"),
        F.count_if(name == "app_exception").alias("app_exception_count"),
    )
    first = A.first_row_value(
        F.struct("platform", "os_version", "device_category", "app_version", "app_bundle_id",
                 "country", "src", "med", "cmp"),
        "event_timestamp", "event_id").alias("first")
    seqs = A.ordered_array_limit(ev, [USER, SESS], ["event_timestamp", "event_id"],
                                 {"event_sequence": F.col("event_name")},
                                 params.game_sequence_cap, extra_aggs=[first])
    s = counters.join(seqs, [USER, SESS], "inner")
    return s.select(
        S.session_key(USER, SESS).alias("session_id"), USER, SESS, "session_date",
        S.timestamp_from_micros("start_us").alias("session_start_ts"),
        F.col("first.platform").alias("platform"),
        F.col("first.os_version").alias("os_version"),
        F.col("first.device_category").alias("device_category"),
        F.col("first.app_version").alias("app_version"),
        F.col("first.app_bundle_id").alias("app_bundle_id"),
        F.col("first.country").alias("country"),
        F.col("first.src").alias("source"),
        F.col("first.med").alias("medium"),
        F.col("first.cmp").alias("campaign"),
        "event_count", "engagement_time_s", "screen_view_count", "event_sequence",
        "had_first_open", "had_app_exception", "app_exception_count",
    )


def user_first_open(raw: DataFrame) -> DataFrame:
    """Per user: date of the earliest non-zero first-touch timestamp, else the
    earliest first_open event date.  Computed once and reused."""
    ft = F.nullif(F.col("user_first_touch_timestamp"), F.lit(0))
    agg = raw.where(F.col(USER).isNotNull()).groupBy(USER).agg(
        F.min(ft).alias("_ft"),
        F.min(F.when(F.col("event_name") == "first_open", S.parse_event_date("event_date"))).alias("_fo"),
    )
    return agg.select(USER, F.coalesce(F.to_date(F.timestamp_micros("_ft")), F.col("_fo"))
                      .alias("first_open_date"))


# --------------------------------------------------------------------------- attempts
def gameplay_events(raw: DataFrame) -> DataFrame:
    """In-session gameplay events with every parameter as a flat column.

    The event-name IN list is applied before parameter parsing and reaches the
    Parquet scan as a pushed filter."""
    raw = raw.where(F.col(USER).isNotNull() & F.col("event_name").isin(*GAMEPLAY_EVENTS))
    ev = split_params(raw).select(
        USER, "event_name", "event_timestamp", "event_id",
        S.parse_event_date("event_date").alias("event_date_parsed"),
        event_param("ga_session_id", params=PARAM_ARRAYS).alias(SESS),
        event_param_any("level_id", params=PARAM_ARRAYS).alias("level_id"),
        event_param("attempt_number", params=PARAM_ARRAYS).alias("attempt_number"),
        event_param("retry_streak_number", params=PARAM_ARRAYS).alias("retry_streak_number"),
        event_param("completion_time", params=PARAM_ARRAYS).alias("completion_time"),
        event_param("fail_time", params=PARAM_ARRAYS).alias("fail_time_val"),
        event_param("fail_reason", "string", params=PARAM_ARRAYS).alias("fail_reason"),
        event_param("stars_gained", params=PARAM_ARRAYS).alias("stars_gained"),
        event_param("items_cleared_perc", params=PARAM_ARRAYS).alias("items_cleared_perc"),
        event_param("objectives_left_perc", params=PARAM_ARRAYS).alias("objectives_left_perc"),
        event_param("time_left_perc", params=PARAM_ARRAYS).alias("time_left_perc"),
        event_param("pre_boosters_chief_level", params=PARAM_ARRAYS).alias("pre_boosters_chief_level"),
        S.parse_int_list(event_param("boosters_used", "string", params=PARAM_ARRAYS)).alias("b_arr"),
        S.parse_int_list(event_param("pre_boosters_manual_used", "string", params=PARAM_ARRAYS)).alias("pbm_arr"),
        S.parse_int_list(event_param("end_boosters_used", "string", params=PARAM_ARRAYS)).alias("eb_arr"),
        event_param_alias(("shop_purhcase", "shop_purchase"), params=PARAM_ARRAYS).alias("shop_purchase_flag"),
        event_param("from_popup", "string", params=PARAM_ARRAYS).alias("from_popup"),
        S.clean_items(event_param_any("stack_item_1", params=PARAM_ARRAYS), event_param_any("stack_item_2", params=PARAM_ARRAYS),
                      event_param_any("stack_item_3", params=PARAM_ARRAYS), event_param_any("stack_item_last", params=PARAM_ARRAYS))
        .alias("stack_items"),
        event_param("ab_test", "string", params=PARAM_ARRAYS).alias("ab_test_param"),
        event_param("current_level", params=PARAM_ARRAYS).alias("current_level"),
    )
    return ev.where(F.col(SESS).isNotNull())


def stitch_attempts(gp: DataFrame, params: JobParams = JobParams()) -> DataFrame:
    """Give every gameplay event the start time / level of the latest level_start of
    its session at or before it (order: timestamp, event_id), and the latest retry
    streak.  Start time and level are carried separately (literal semantics)."""
    name = F.col("event_name")
    return carry_forward(
        gp, [USER, SESS], "event_timestamp", ["event_id"],
        {
            "attempt_start_ts_us": F.when(name == "level_start", F.col("event_timestamp")),
            "attempt_level_id": F.when(name == "level_start", F.col("level_id")),
            "latest_retry_streak": F.when(name == "level_retry", F.col("retry_streak_number")),
        },
        params.attempt_bucket_us,
        key_max={"session_ab_test": F.when(name == "custom_session_start", F.col("ab_test_param"))},
    )


def attempt_outcome(completes: Column, fails: Column) -> Column:
    return (F.when(completes > 0, "complete").when(fails > 0, "fail").otherwise("abandoned"))


def level_attempts(raw: DataFrame, ufo: DataFrame | None = None,
                   params: JobParams = JobParams(), stitched: DataFrame | None = None) -> DataFrame:
    """One row per (user, session, level_start timestamp, level).

    ``stitched`` is the output of :func:`stitch_attempts`; pass a stored copy, as it is read twice."""
    if stitched is None:
        stitched = stitch_attempts(gameplay_events(raw), params)
    return with_user_facts(attempt_rollup(stitched), ufo if ufo is not None else user_first_open(raw))


def attempt_rollup(stitched: DataFrame) -> DataFrame:
    """Attempts with all that follows from the events of their session alone.

    Numbers and flags are one hash aggregate over all events. Fail reasons, popups and items, whose
    buffers don't fit one, are aggregated apart, from the few events that have them.
    """
    name = F.col("event_name")
    is_term, is_snap = name.isin(*TERMINAL_EVENTS), name.isin(*SNAPSHOT_EVENTS)
    akeys = [USER, SESS, "attempt_start_ts_us", "level_id"]

    def w(cond, col):
        return F.when(cond, col if isinstance(col, Column) else F.col(col))

    # (output, per-event expression, merge) -- mergeable parts of every attempt measure
    parts = [
        ("session_date", F.col("event_date_parsed"), "min"),
        ("current_level_at_start", w(name == "level_start", "current_level"), "min"),
        ("attempt_number", w(is_term, "attempt_number"), "min"),
        ("retry_streak_number", w(name == "level_start", "latest_retry_streak"), "min"),
        ("_dur_c", w(name == "level_complete", "completion_time"), "max"),
        ("_dur_f", w(name == "level_fail", "fail_time_val"), "max"),
        ("stars_gained", w(name == "level_complete", "stars_gained"), "max"),
        *[(f"_{c}_{k}", w(cond, c), "max") for c in ("items_cleared_perc", "objectives_left_perc", "time_left_perc")
          for k, cond in (("t", is_term), ("s", is_snap))],
        ("pre_boosters_chief_level", w(is_term, "pre_boosters_chief_level"), "max"),
        ("boosters_vacuum", w(is_term, S.int_at("b_arr", 0)), "max"),
        ("boosters_spring", w(is_term, S.int_at("b_arr", 1)), "max"),
        ("boosters_fan", w(is_term, S.int_at("b_arr", 2)), "max"),
        ("boosters_ice", w(is_term, S.int_at("b_arr", 3)), "max"),
        ("pre_hammer", w(is_term, S.int_at("pbm_arr", 0) > 0), "max"),
        ("pre_sandglass", w(is_term, S.int_at("pbm_arr", 1) > 0), "max"),
        ("end_clear_bar", w(is_term, S.int_at("eb_arr", 0)), "max"),
        ("end_extra_time", w(is_term, S.int_at("eb_arr", 1)), "max"),
        ("had_shop_purchase", F.coalesce(F.col("shop_purchase_flag"), F.lit(0)) > 0, "or"),
        ("pause_max_progress_perc", w(name == "game_paused", "items_cleared_perc"), "max"),
    ]
    counts = [("_n_complete", name == "level_complete"), ("_n_fail", name == "level_fail"),
              ("revive_count", name.isin(*REVIVE_EVENTS)), ("pause_count", name == "game_paused"),
              ("pause_quit_cancelled_count", name == "pause_quit_cancelled"),
              ("fail_stack_full_popup_count", name == "fail_stack_full"),
              ("fail_time_up_popup_count", name == "fail_time_up")]
    merge = {"min": F.min, "max": F.max, "or": F.bool_or}
    ours = stitched.where(F.col("attempt_start_ts_us").isNotNull() & F.col("attempt_level_id").isNotNull()).withColumn(
        "level_id", F.col("attempt_level_id"))
    # the test arm is one value for all events of a session, so it is a key (never null) of both aggregates
    ours = ours.withColumn("arm", F.coalesce(F.concat(F.lit("="), "session_ab_test"), F.lit("")))
    keys = [*akeys, "arm"]
    aa = ours.groupBy(*keys).agg(*[merge[m](e).alias(n) for n, e, m in parts], *[F.count_if(c).alias(n) for n, c in counts])
    aa = aa.join(attempt_details(ours, keys), keys, "left").select(
        *akeys, *[n for n, _, _ in parts if not n.startswith("_")], *[n for n, _ in counts],
        F.when(F.col("arm") != "", F.substring("arm", 2, 1 << 30)).alias("ab_test"), "fail_reason", "revive_from_popup_mode",
        F.coalesce("_dur_c", "_dur_f").alias("duration_s"),
        *[F.coalesce(f"_{c}_t", f"_{c}_s").alias(c) for c in ("items_cleared_perc", "objectives_left_perc", "time_left_perc")],
        F.coalesce("stack_fail_items", S.empty_string_array()).alias("stack_fail_items"))
    return aa.withColumn("attempt_id", S.attempt_key(USER, SESS, "attempt_start_ts_us")).withColumn(
        "outcome", attempt_outcome(F.col("_n_complete"), F.col("_n_fail"))).drop("_n_complete", "_n_fail")


def attempt_details(stitched: DataFrame, keys: list[str]) -> DataFrame:
    """Fail reason, most frequent popup and stack-full items (in order) of the attempts that have any of them."""
    name = F.col("event_name")
    # Documented deviation: the popup mode counts revive events only.
    popup = F.when(name.isin(*REVIVE_EVENTS), F.col("from_popup"))
    items = F.when(name == "fail_stack_full",
                   F.struct(F.col("event_timestamp").alias("o0"), F.col("event_id").alias("o1"),
                            F.col("stack_items").alias("arr")))
    few = stitched.where(name.isin(*REVIVE_EVENTS, "level_fail", "fail_stack_full"))
    g = few.groupBy(*keys, popup.alias("popup")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(name == "level_fail", F.col("fail_reason"))).alias("reason"), F.collect_list(items).alias("items"))
    votes = F.when(F.col("popup").isNotNull(), F.struct(-F.col("n"), F.col("popup")))
    g = g.groupBy(*keys).agg(F.max("reason").alias("fail_reason"), F.min_by("popup", votes).alias("revive_from_popup_mode"),
                              F.flatten(F.collect_list("items")).alias("items"))
    return g.select(*keys, "fail_reason", "revive_from_popup_mode",
                    F.flatten(F.transform(F.array_sort("items"), lambda e: e["arr"])).alias("stack_fail_items"))


def with_user_facts(aa: DataFrame, ufo: DataFrame) -> DataFrame:
    """Rows of :func:`attempt_rollup` with what hangs on the user's other events: first open and first attempt of a level."""
    # after the join the rows are together by user, so this window needs no shuffle of its own
    at = F.struct("attempt_start_ts_us", "attempt_id")
    aa = aa.join(ufo, USER, "left").withColumn("_first", F.min(at).over(Window.partitionBy(USER, "level_id")))
    return aa.select(
        "attempt_id", USER, SESS,
        S.session_key(USER, SESS).alias("session_id"),
        "session_date",
        S.timestamp_from_micros("attempt_start_ts_us").alias("attempt_start_ts"),
        "level_id",
        S.leading_int("level_id").alias("level_id_numeric"),
        "first_open_date",
        F.when(F.col("first_open_date").isNotNull(),
               S.user_day_number("session_date", "first_open_date")).alias("user_day_number"),
        "current_level_at_start", "attempt_number", "retry_streak_number",
        "outcome", "duration_s", "fail_reason", "stars_gained",
        "items_cleared_perc", "objectives_left_perc", "time_left_perc", "pre_boosters_chief_level",
        "boosters_vacuum", "boosters_spring", "boosters_fan", "boosters_ice",
        "pre_hammer", "pre_sandglass", "end_clear_bar", "end_extra_time",
        "revive_count", "revive_from_popup_mode", "had_shop_purchase",
        "pause_count", "pause_max_progress_perc", "pause_quit_cancelled_count",
        "fail_stack_full_popup_count", "fail_time_up_popup_count",
        "ab_test", "stack_fail_items",
        (F.col("_first") == at).alias("is_first_attempt_ever"),
    )


# --------------------------------------------------------------------------- journeys
def retention_flags(first_seen: Column, second_day: Column, w_end: date, n: int) -> tuple[Column, Column]:
    """(retained, eligible) for horizon ``n``: any session day in [first+1, first+n],
    NULL when first+n is after the window end."""
    eligible = F.date_add(first_seen, n) <= F.lit(w_end)
    raw_ret = F.coalesce(second_day <= F.date_add(first_seen, n), F.lit(False))
    return F.when(eligible, raw_ret), eligible


def game_session_agg(sessions: DataFrame) -> DataFrame:
    order = ("session_start_ts", "session_id")
    m = A.modes(sessions, [USER], {"primary_platform": F.col("platform"),
                                   "primary_country": F.col("country"),
                                   "primary_app_version": F.col("app_version"),
                                   "time_of_day_mode": S.day_part("session_start_ts")})
    return sessions.groupBy(USER).agg(
        F.min("session_date").alias("first_seen_date"),
        F.max("session_date").alias("last_seen_date"),
        F.count(F.lit(1)).alias("total_sessions"),
        F.sum("event_count").alias("total_events"),
        F.sum("engagement_time_s").alias("total_engagement_s"),
        F.sum("screen_view_count").alias("total_screen_views"),
        # distinct session days (<= window length, so the set is bounded)
        F.array_sort(F.collect_set("session_date")).alias("_days"),
        A.last_row_value("app_version", *order).alias("last_app_version"),
        A.first_row_value(F.struct("source", "medium", "session_id", "engagement_time_s"), *order)
        .alias("_first"),
        F.bool_or("had_first_open").alias("had_first_open"),
        F.bool_or("had_app_exception").alias("had_app_exception"),
        F.sum("app_exception_count").alias("total_app_exceptions"),
        F.count_if(S.is_weekend("session_start_ts")).alias("weekend_sessions"),
        F.count_if(~S.is_weekend("session_start_ts")).alias("weekday_sessions"),
    ).join(m, USER, "left").select(
        "*", F.size("_days").alias("days_active"), F.get("_days", 1).alias("_second_day"),
        F.col("_first.source").alias("first_touch_source"),
        F.col("_first.medium").alias("first_touch_medium"),
        F.col("_first.session_id").alias("first_session_id"),
        F.col("_first.engagement_time_s").alias("first_session_duration_s"),
    )


def user_attempt_agg(attempts: DataFrame) -> DataFrame:
    complete = F.col("outcome") == "complete"
    return attempts.groupBy(USER).agg(
        F.count(F.lit(1)).alias("total_attempts"),
        F.count_if(complete).alias("total_completes"),
        F.count_if(F.col("outcome") == "fail").alias("total_fails"),
        F.count_if(F.col("outcome") == "abandoned").alias("total_abandons"),
        F.sum(F.coalesce("revive_count", F.lit(0))).alias("total_revives"),
        # highest numeric level, non-numeric ids lowest, then lexical
        A.last_row_value("level_id", "level_id_numeric", "level_id").alias("farthest_level"),
        F.max("level_id_numeric").alias("farthest_level_numeric"),
        A.top1_by_ignore_nulls("level_id", complete, "level_id_numeric", "level_id").alias("farthest_completed_level"),
        F.max(F.when(complete, F.col("level_id_numeric"))).alias("farthest_completed_numeric"),
        A.top1_by_ignore_nulls("ab_test", F.col("ab_test").isNotNull() & (F.col("current_level_at_start") == 1),
                               "attempt_start_ts", "attempt_id", largest=False).alias("ab_test_assignment"),
    )


def stuck_levels(attempts: DataFrame) -> DataFrame:
    """Level failed most (ties: smallest level_id) among levels never completed."""
    per_level = attempts.groupBy(USER, "level_id").agg(
        F.count_if(F.col("outcome") == "fail").alias("fail_count"),
        F.count_if(F.col("outcome") == "complete").alias("complete_count"))
    return (per_level.where((F.col("complete_count") == 0) & (F.col("fail_count") > 0))
            .groupBy(USER).agg(
                F.min_by("level_id", F.struct(-F.col("fail_count"), F.col("level_id"))).alias("stuck_level"),
                F.max("fail_count").alias("stuck_level_attempts")))


def first_session_depth(attempts: DataFrame, session_agg: DataFrame) -> DataFrame:
    firsts = session_agg.select(USER, F.col("first_session_id").alias("session_id"))
    a = attempts.join(firsts, [USER, "session_id"], "left_semi")
    return a.groupBy(USER).agg(
        F.count_distinct("level_id").alias("first_session_levels_reached"),
        F.count_distinct(F.when(F.col("outcome") == "complete", F.col("level_id")))
        .alias("first_session_levels_completed"))


def game_user_group(p: JobParams, w_end: date) -> Column:
    end = F.lit(w_end)
    completes = F.coalesce("total_completes", F.lit(0))
    attempts = F.coalesce("total_attempts", F.lit(0))
    active = F.col("last_seen_date") > F.date_sub(end, p.churn_cutoff_days)
    churned = F.col("last_seen_date") <= F.date_sub(end, p.churn_cutoff_days)
    return (F.when(F.col("first_seen_date") > F.date_sub(end, p.new_cutoff_days), "new")
            .when((completes >= p.hooked_min_completes)
                  & (F.date_add("first_seen_date", 1) <= end)
                  & F.coalesce(F.col("_second_day") <= F.date_add("first_seen_date", 1), F.lit(False)),
                  "hooked")
            .when(active & (completes >= 1), "active_engaged")
            .when(active & (completes == 0) & (attempts > 0)
                  & (F.try_divide(F.col("total_fails").cast("double"), F.col("total_attempts").cast("double"))
                     >= p.stuck_fail_ratio), "active_stuck")
            .when(churned & ((F.coalesce("farthest_level_numeric", F.lit(0)) <= p.churned_early_max_level)
                             | (F.coalesce("first_session_levels_completed", F.lit(0)) == 0)),
                  "churned_early")
            .when(churned, "churned_progressed")
            .otherwise("other"))


def game_user_journeys(sessions: DataFrame, attempts: DataFrame, ufo: DataFrame,
                       w_end: date, params: JobParams = JobParams()) -> DataFrame:
    """One row per user."""
    return journey_flags(user_state(sessions, attempts, ufo), w_end, params)


def user_state(sessions: DataFrame, attempts: DataFrame, ufo: DataFrame) -> DataFrame:
    """One row per user with all that doesn't hang on the window's end.  All inputs are
    grouped by user, so the left joins line up on the same hash partitioning."""
    s = game_session_agg(sessions)
    att = user_attempt_agg(attempts)
    sl = stuck_levels(attempts)
    fsa = first_session_depth(attempts, s)
    return s.join(ufo, USER, "left").join(att, USER, "left").join(sl, USER, "left").join(fsa, USER, "left").drop("_days", "_first")


def journey_flags(j: DataFrame, w_end: date, params: JobParams = JobParams()) -> DataFrame:
    """Journeys from :func:`user_state`: retention, churn and user group as of ``w_end``."""
    end = F.lit(w_end)
    fs = F.col("first_seen_date")
    d1, e1 = retention_flags(fs, F.col("_second_day"), w_end, 1)
    d7, e7 = retention_flags(fs, F.col("_second_day"), w_end, 7)
    d30, e30 = retention_flags(fs, F.col("_second_day"), w_end, 30)
    churn_line = F.date_sub(end, params.churn_cutoff_days)
    return j.select(
        USER, "first_open_date", "first_seen_date", "last_seen_date",
        F.datediff("last_seen_date", "first_seen_date").alias("days_active_span"),
        "total_sessions", "days_active", "total_events", "total_engagement_s", "total_screen_views",
        "primary_platform", "primary_country", "primary_app_version", "last_app_version",
        "first_touch_source", "first_touch_medium", "had_first_open", "had_app_exception",
        "total_app_exceptions", "time_of_day_mode",
        S.weekday_weekend().alias("weekday_weekend"),
        d1.alias("d1_retained"), d7.alias("d7_retained"), d30.alias("d30_retained"),
        e1.alias("is_eligible_for_d1"), e7.alias("is_eligible_for_d7"), e30.alias("is_eligible_for_d30"),
        (fs <= churn_line).alias("is_eligible_for_churn"),
        ((fs <= churn_line) & (F.col("last_seen_date") <= churn_line)).alias("is_churned"),
        F.coalesce("total_attempts", F.lit(0)).alias("total_attempts"),
        F.coalesce("total_completes", F.lit(0)).alias("total_completes"),
        F.coalesce("total_fails", F.lit(0)).alias("total_fails"),
        F.coalesce("total_abandons", F.lit(0)).alias("total_abandons"),
        F.coalesce("total_revives", F.lit(0)).alias("total_revives"),
        "farthest_level", "farthest_level_numeric", "farthest_completed_level", "farthest_completed_numeric",
        F.coalesce("first_session_levels_reached", F.lit(0)).alias("first_session_levels_reached"),
        F.coalesce("first_session_levels_completed", F.lit(0)).alias("first_session_levels_completed"),
        "first_session_duration_s", "stuck_level", "stuck_level_attempts", "ab_test_assignment",
        "first_session_id",
        game_user_group(params, w_end).alias("user_group"),
    )


# --------------------------------------------------------------------------- levels
#: Outcome counts of a level, and ratios as (condition on an attempt, denominator).
OUTCOME_COUNTS = {"total_completes": "complete", "total_fails": "fail", "total_abandons": "abandoned"}
BOOSTERS = ("boosters_vacuum", "boosters_spring", "boosters_fan", "boosters_ice")
AVERAGES = {"avg_items_cleared_perc_on_fail": ("fail", "items_cleared_perc"),
            "avg_objectives_left_perc_on_fail": ("fail", "objectives_left_perc"),
            "avg_time_left_perc_on_fail": ("fail", "time_left_perc"),
            "avg_stars_on_complete": ("complete", "stars_gained")}
MEDIANS = {"median_duration_complete_s": "complete", "median_duration_fail_s": "fail"}


def attempt_ratios() -> dict[str, tuple[Column, str]]:
    failed, used = F.col("outcome") == "fail", [F.coalesce(b, F.lit(0)) for b in BOOSTERS]
    return {
        **{f"fail_rate_{reason}": (failed & (F.col("fail_reason") == reason), "total_fails")
           for reason in ("stack_full", "time_up", "pause_quit")},
        "abandon_rate": (F.col("outcome") == "abandoned", "total_attempts"),
        "booster_attempt_rate": (sum(used, F.lit(0)) > 0, "total_attempts"),
        "revive_attempt_rate": (F.col("revive_count") > 0, "total_attempts"),
    }


def level_sums(attempts: DataFrame, keys: tuple[str, ...] = ("level_id",), *more: Column) -> DataFrame:
    """Sums per level (or per level and day) that add up: counts, ``_of`` a ratio its numerator,
    ``_sum`` and ``_n`` of an average."""
    def on(outcome: str, c: str) -> Column:
        return F.when(F.col("outcome") == outcome, F.col(c))

    return attempts.groupBy(*keys).agg(
        F.max("level_id_numeric").alias("level_id_numeric"), F.count(F.lit(1)).alias("total_attempts"),
        *[F.count_if(F.col("outcome") == o).alias(n) for n, o in OUTCOME_COUNTS.items()],
        *[F.count_if(cond).alias(f"{n}_of") for n, (cond, _) in attempt_ratios().items()],
        *[f(on(*of)).alias(f"{n}_{k}") for n, of in AVERAGES.items() for k, f in (("sum", F.sum), ("n", F.count))],
        *more)


def level_users(attempts: DataFrame) -> DataFrame:
    won = F.col("outcome") == "complete"
    return attempts.groupBy("level_id", USER).agg(
        F.count_if(won).alias("user_completes"), F.count(F.lit(1)).alias("user_attempts"),
        F.bool_or(won & F.col("is_first_attempt_ever")).alias("won_first"))


def attempts_to_beat(lu: DataFrame) -> DataFrame:
    """Starters, completers and first-try winners per level, and the median / p90 of the
    completers' attempt counts (all attempts of a completer, also those after the first win)."""
    beat = F.col("user_completes") > 0
    return lu.groupBy("level_id").agg(
        F.count(F.lit(1)).alias("unique_starters"), F.count_if(beat).alias("unique_completers"),
        F.count_if("won_first").alias("first_try_wins"),
        A.approx_median(F.when(beat, F.col("user_attempts"))).alias("median_attempts_to_beat"),
        A.approx_quantile(F.when(beat, F.col("user_attempts")), 0.9).alias("p90_attempts_to_beat"))


def level_retention(lu: DataFrame, journeys: DataFrame) -> DataFrame:
    """Reachers of a level that could churn or return on day 1 / 7, and how many did."""
    flags = {"churn": ("is_eligible_for_churn", F.col("is_churned") & (F.col("farthest_level") == F.col("level_id"))),
             "d1": ("is_eligible_for_d1", F.col("d1_retained")), "d7": ("is_eligible_for_d7", F.col("d7_retained"))}
    j = journeys.select(USER, "farthest_level", "is_churned", "d1_retained", "d7_retained", *[e for e, _ in flags.values()])
    x = lu.select("level_id", USER).join(j, USER, "inner")
    return x.groupBy("level_id").agg(*[c for k, (able, did) in flags.items() for c in (
        F.count_if(able).alias(f"{k}_able"), F.count_if(F.col(able) & F.coalesce(did, F.lit(False))).alias(f"{k}_did"))])


def top_stall_items(attempts: DataFrame, k: int = 5) -> DataFrame:
    """Per level, the k items seen most often in stack-full popups of attempts that
    failed by stack_full (count desc, item asc)."""
    a = attempts.where(F.col("fail_reason") == "stack_full").select("level_id", "stack_fail_items")
    return A.topk_items(a, ["level_id"], "stack_fail_items", k, out="top_stack_stall_items")


def game_levels(attempts: DataFrame, journeys: DataFrame) -> DataFrame:
    """One row per level.  Level-grain inputs are tiny; AQE turns the joins into
    broadcasts at runtime when their measured size allows."""
    medians = [A.approx_median(F.when(F.col("outcome") == o, F.col("duration_s"))).cast("double").alias(n) for n, o in MEDIANS.items()]
    lu = level_users(attempts)
    return level_ratios(level_sums(attempts, ("level_id",), *medians), attempts_to_beat(lu), level_retention(lu, journeys),
                        top_stall_items(attempts))


def level_ratios(sums: DataFrame, beaten: DataFrame, retention: DataFrame, items: DataFrame) -> DataFrame:
    j = (sums.join(beaten, "level_id", "left").join(retention, "level_id", "left").join(items, "level_id", "left"))
    r = S.safe_ratio
    return j.select(
        "level_id", "level_id_numeric", "unique_starters", "unique_completers",
        r("unique_completers", "unique_starters").alias("completion_rate"),
        r("first_try_wins", "unique_starters").alias("first_try_win_rate"),
        "median_attempts_to_beat", "p90_attempts_to_beat",
        "total_attempts", *OUTCOME_COUNTS, *MEDIANS,
        *[r(f"{n}_of", of).alias(n) for n, (_, of) in attempt_ratios().items()],
        *[r(f"{n}_sum", f"{n}_n").alias(n) for n in AVERAGES],
        F.col("churn_able").alias("n_users_reached_churn_eligible"), F.col("churn_did").alias("n_users_who_churned_here"),
        r("churn_did", "churn_able").alias("churn_on_level_rate"),
        F.col("d1_able").alias("d1_eligible_reachers"), r("d1_did", "d1_able").alias("d1_retention_of_reachers"),
        F.col("d7_able").alias("d7_eligible_reachers"), r("d7_did", "d7_able").alias("d7_retention_of_reachers"),
        F.coalesce("top_stack_stall_items", S.empty_string_array()).alias("top_stack_stall_items"),
    )
