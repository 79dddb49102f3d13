"""Game report queries over journeys, attempts, levels and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathweave.config import SMALL_SAMPLE_USERS
from pathweave.operators.asof import carry_forward

U, G_ = "user_pseudo_id", "user_group"


FAIL_REASONS = ("stack_full", "time_up", "pause_quit")
DAY_US = 86_400_000_000


def _all() -> Window:
    return Window.partitionBy()


def level_band(num: Column) -> Column:
    """Fixed bands 1-5 / 6-15 / 16-30 / 31+; non-numeric ids -> 'unknown'."""
    return (F.when(num.between(1, 5), "1-5").when(num.between(6, 15), "6-15")
            .when(num.between(16, 30), "16-30").when(num >= 31, "31+").otherwise("unknown"))


def _rate(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def game_baseline(j: DataFrame) -> DataFrame:
    g = j.groupBy(G_).agg(
        F.count(F.lit(1)).alias("users"), F.sum("total_sessions").alias("sessions"),
        F.sum("total_attempts").alias("attempts"), F.sum("total_completes").alias("completes"),
        *[x for n in (1, 7, 30) for x in (
            F.count_if(f"is_eligible_for_d{n}").alias(f"d{n}_eligible"),
            _rate(F.count_if(F.col(f"d{n}_retained") == F.lit(True)), F.count_if(f"is_eligible_for_d{n}"))
            .alias(f"d{n}_rate"))])
    return g.select(G_, "users", (F.col("users") / F.sum("users").over(_all())).alias("share"),
                    *[c for c in g.columns if c not in (G_, "users")])


def player_groups(j: DataFrame) -> DataFrame:
    g = j.groupBy(G_).agg(
        F.count(F.lit(1)).alias("users"), F.avg("total_sessions").alias("avg_sessions"),
        (F.avg("total_engagement_s") / 60.0).alias("avg_engagement_min"),
        _rate(F.count_if(F.col("d1_retained") == F.lit(True)), F.count_if("is_eligible_for_d1")).alias("d1_rate"),
        F.count_if("is_eligible_for_d1").alias("d1_eligible"),
        _rate(F.count_if(F.col("d7_retained") == F.lit(True)), F.count_if("is_eligible_for_d7")).alias("d7_rate"),
        F.count_if("is_eligible_for_d7").alias("d7_eligible"),
        F.percentile_approx("farthest_level_numeric", 0.5).alias("median_farthest_level"))
    return g.select(G_, "users", (F.col("users") / F.sum("users").over(_all())).alias("share"),
                    *[c for c in g.columns if c not in (G_, "users")])


def retention_cliff(levels: DataFrame, floor: int = 5, top: int = 10) -> DataFrame:
    """Top levels by churn_on_level_rate with at least ``floor`` churned users (a top-k report)."""
    x = levels.where(F.col("n_users_who_churned_here") >= floor)
    return x.orderBy(F.desc("churn_on_level_rate"), F.asc("level_id")).limit(top).select(
        "level_id", "n_users_reached_churn_eligible", "n_users_who_churned_here", "churn_on_level_rate",
        "d1_retention_of_reachers", "completion_rate")


def level_bands(attempts: DataFrame) -> DataFrame:
    o = F.col("outcome")
    fail = o == "fail"
    g = attempts.groupBy(level_band(F.col("level_id_numeric")).alias("band")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_distinct("level_id").alias("levels"),
        F.count_if(o == "complete").alias("completes"), F.count_if(fail).alias("fails"),
        F.count_if(o == "abandoned").alias("abandons"),
        *[F.count_if(fail & (F.col("fail_reason") == r)).alias(f"fail_{r}") for r in FAIL_REASONS])
    dominant = F.when((F.col("fails") == 0), F.lit(None).cast("string"))
    best = F.greatest(*[F.col(f"fail_{r}") for r in FAIL_REASONS])
    for r in FAIL_REASONS:  # first reason in fixed order wins a tie
        dominant = dominant.when(F.col(f"fail_{r}") == best, F.lit(r))
    return g.select("band", "attempts", "levels",
                    _rate(F.col("completes"), F.col("attempts")).alias("completion_rate"),
                    _rate(F.col("fails"), F.col("attempts")).alias("fail_rate"),
                    _rate(F.col("abandons"), F.col("attempts")).alias("abandon_rate"),
                    *[_rate(F.col(f"fail_{r}"), F.col("fails")).alias(f"fail_share_{r}") for r in FAIL_REASONS],
                    dominant.alias("dominant_failure_mode"))


def first_session_d1(j: DataFrame) -> DataFrame:
    e = j.where(F.col("is_eligible_for_d1"))
    b = F.when(F.col("first_session_levels_completed") >= 3, "3+").otherwise(
        F.col("first_session_levels_completed").cast("string"))
    return e.groupBy(b.alias("levels_completed_bucket")).agg(
        F.count(F.lit(1)).alias("users"), F.count_if(F.col("d1_retained")).alias("d1_retained"),
        _rate(F.count_if(F.col("d1_retained")), F.count(F.lit(1))).alias("d1_rate"))


def first_session_duration_d1(j: DataFrame) -> DataFrame:
    e = j.where(F.col("is_eligible_for_d1"))
    return e.groupBy("d1_retained").agg(F.count(F.lit(1)).alias("users"),
                                        F.percentile_approx("first_session_duration_s", 0.5)
                                        .alias("median_first_session_duration_s"))


def ab_arm_contrast(j: DataFrame, attempts: DataFrame, min_eligible: int = SMALL_SAMPLE_USERS) -> DataFrame:
    l1 = attempts.where(F.col("level_id_numeric") == 1).groupBy(U).agg(
        F.bool_or(F.col("outcome") == "complete").alias("l1_complete"))
    x = j.where(F.col("ab_test_assignment").isNotNull()).join(l1, U, "left")
    g = x.groupBy(F.col("ab_test_assignment").alias("arm")).agg(
        F.count(F.lit(1)).alias("users"), F.count_if("is_eligible_for_d1").alias("d1_eligible"),
        _rate(F.count_if(F.col("d1_retained") == F.lit(True)), F.count_if("is_eligible_for_d1")).alias("d1_rate"),
        F.count_if(F.col("l1_complete").isNotNull()).alias("level1_starters"),
        _rate(F.count_if(F.col("l1_complete") == F.lit(True)), F.count_if(F.col("l1_complete").isNotNull()))
        .alias("level1_completion_rate"),
        F.avg("first_session_levels_completed").alias("avg_first_session_completed"))
    return g.select("*", (F.col("d1_eligible") < min_eligible).alias("is_small_sample"))


def fail_reason_mix(attempts: DataFrame) -> DataFrame:
    """Share of fails by reason, per band and overall (band 'all')."""
    f = attempts.where(F.col("outcome") == "fail").select(
        level_band(F.col("level_id_numeric")).alias("band"), F.coalesce("fail_reason", F.lit("(none)")).alias("fail_reason"))
    g = (f.cube("band", "fail_reason").agg(F.count(F.lit(1)).alias("fails"),
                                           F.grouping("band").alias("_gb"), F.grouping("fail_reason").alias("_gr"))
         .where(F.col("_gr") == 0))
    g = g.select(F.when(F.col("_gb") == 1, F.lit("all")).otherwise(F.col("band")).alias("band"), "fail_reason", "fails")
    return g.select("*", (F.col("fails") / F.sum("fails").over(Window.partitionBy("band"))).alias("share"))


def revive_saves_run(attempts: DataFrame, bucket_us: int = DAY_US) -> DataFrame:
    """Completion rate of attempts after an earlier revive on the same level by the
    same user, against attempts without one (bucketed scan per user and level)."""
    a = attempts.select(U, "level_id", "outcome", "attempt_id", "revive_count",
                        F.unix_micros("attempt_start_ts").alias("_ts"))
    x = carry_forward(a, [U, "level_id"], "_ts", ["attempt_id"],
                      {"_rev": F.when(F.coalesce("revive_count", F.lit(0)) > 0, F.lit(True))},
                      bucket_us, include_current=False)
    x = x.select("outcome", F.coalesce("_rev", F.lit(False)).alias("revived_before"))
    return x.groupBy("revived_before").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("outcome") == "complete").alias("completes"),
        _rate(F.count_if(F.col("outcome") == "complete"), F.count(F.lit(1))).alias("completion_rate"))


def revive_source_mode(attempts: DataFrame) -> DataFrame:
    tot = attempts.agg(F.count(F.lit(1)).alias("attempts"),
                       F.count_if(F.coalesce("revive_count", F.lit(0)) > 0).alias("revive_attempts"))
    modes = (attempts.where(F.col("revive_from_popup_mode").isNotNull())
             .groupBy("revive_from_popup_mode").agg(F.count(F.lit(1)).alias("n")))
    top = modes.agg(F.min_by("revive_from_popup_mode", F.struct(-F.col("n"), F.col("revive_from_popup_mode")))
                    .alias("dominant_mode"), F.max("n").alias("dominant_n"), F.sum("n").alias("mode_n"))
    return tot.crossJoin(top).select(  # both sides are exactly one row
        "attempts", "revive_attempts", _rate(F.col("revive_attempts"), F.col("attempts")).alias("revive_attempt_rate"),
        "dominant_mode", _rate(F.col("dominant_n"), F.col("mode_n")).alias("dominant_share"))


def retry_streaks(attempts: DataFrame, j: DataFrame,
                  groups: tuple[str, ...] = ("active_engaged", "churned_progressed")) -> DataFrame:
    x = attempts.join(j.select(U, G_).where(F.col(G_).isin(*groups)), U)
    g = x.groupBy(G_, "retry_streak_number").agg(F.count(F.lit(1)).alias("attempts"))
    return g.select("*", (F.col("attempts") / F.sum("attempts").over(Window.partitionBy(G_))).alias("share"))


def cross_session_completion(attempts: DataFrame, bucket_us: int = DAY_US) -> DataFrame:
    """Share of completes on a level where the user failed that level in an earlier session."""
    per = attempts.groupBy(U, "level_id", "session_id").agg(
        F.unix_micros(F.min("attempt_start_ts")).alias("first_start"),
        F.bool_or(F.col("outcome") == "fail").alias("has_fail"),
        F.count_if(F.col("outcome") == "complete").alias("completes"))
    x = carry_forward(per, [U, "level_id"], "first_start", ["session_id"],
                      {"_fb": F.when(F.col("has_fail"), F.lit(True))}, bucket_us, include_current=False)
    x = x.select("completes", F.coalesce("_fb", F.lit(False)).alias("failed_before"))
    return x.agg(F.sum("completes").alias("completes"),
                 F.sum(F.when(F.col("failed_before"), F.col("completes")).otherwise(0)).alias("cross_session_completes")
                 ).select("*", _rate(F.col("cross_session_completes"), F.col("completes")).alias("share"))


def stall_item_ranking(attempts: DataFrame, levels: DataFrame) -> DataFrame:
    """Stall items over levels where stack_full dominates the fails (its share is
    at least that of every other reason)."""
    lv = levels.where((F.col("fail_rate_stack_full") > 0)
                      & (F.col("fail_rate_stack_full") >= F.col("fail_rate_time_up"))
                      & (F.col("fail_rate_stack_full") >= F.col("fail_rate_pause_quit"))).select("level_id")
    a = (attempts.where(F.col("fail_reason") == "stack_full").join(lv, "level_id", "left_semi")
         .select(F.explode("stack_fail_items").alias("item")))
    return a.groupBy("item").agg(F.count(F.lit(1)).alias("appearances"))


def crash_by_platform(s: DataFrame) -> DataFrame:
    p = F.coalesce(F.col("platform"), F.lit("(unknown)"))
    return s.groupBy(p.alias("platform")).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_distinct(U).alias("users"),
        _rate(F.count_if("had_app_exception"), F.count(F.lit(1))).alias("exception_session_rate"),
        _rate(F.count_if("had_first_open"), F.count(F.lit(1))).alias("first_open_session_rate"))
