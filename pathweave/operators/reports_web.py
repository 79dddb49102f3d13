"""Web report queries over the user-journey and session tables.

Group-level outputs are tiny; shares over all groups use a window on the already
aggregated rows (a handful of rows), never on user rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pathweave.config import SMALL_SAMPLE_USERS

U, G_ = "user_pseudo_id", "user_group"
WEB_GROUPS = ("new", "active_buyer", "churned_buyer", "active_non_buyer", "churned_non_buyer")


def _all() -> Window:
    return Window.partitionBy()


def _share(col: str) -> F.Column:
    return F.col(col) / F.sum(col).over(_all())


def web_baseline(j: DataFrame) -> DataFrame:
    g = j.groupBy(G_).agg(F.count(F.lit(1)).alias("users"),
                          F.sum("total_revenue").cast("double").alias("revenue"),
                          F.count_if(F.col("total_purchases") > 0).alias("purchasers"))
    return g.select(G_, "users", _share("users").alias("share"), "revenue", "purchasers",
                    (F.col("purchasers") / F.col("users")).alias("purchase_rate"))


def group_mix(j: DataFrame, dim: str = "first_touch_source") -> DataFrame:
    g = j.groupBy(G_, F.col(dim).alias("value")).agg(F.count(F.lit(1)).alias("users"))
    w = Window.partitionBy(G_)
    return g.select(G_, F.lit(dim).alias("dimension"), "value", "users",
                    (F.col("users") / F.sum("users").over(w)).alias("share_in_group"))


def journey_length(j: DataFrame) -> DataFrame:
    return j.groupBy(G_).agg(
        F.avg("total_sessions").alias("avg_sessions"), F.avg("total_events").alias("avg_events"),
        F.avg("days_active_span").alias("avg_span_days"),
        F.percentile_approx("total_sessions", 0.5).alias("median_sessions"),
        F.percentile_approx("total_sessions", 0.9).alias("p90_sessions"))


def time_to_purchase(j: DataFrame) -> DataFrame:
    b = j.where(F.col("first_purchase_date").isNotNull())
    return b.groupBy(G_, "days_to_first_purchase").agg(F.count(F.lit(1)).alias("buyers"))


def time_to_purchase_summary(j: DataFrame) -> DataFrame:
    b = j.where(F.col("first_purchase_date").isNotNull())
    return b.groupBy(G_).agg(F.count(F.lit(1)).alias("buyers"),
                             F.percentile_approx("days_to_first_purchase", 0.5).alias("median_days"),
                             F.avg("days_to_first_purchase").alias("avg_days"))


def sequence_positions(j: DataFrame, n: int = 5) -> DataFrame:
    """Event frequency at the first ``n`` positions of each user's top sequence."""
    x = j.select(G_, F.posexplode("top_event_sequence").alias("pos", "event_name")).where(F.col("pos") < n)
    return x.groupBy(G_, "pos", "event_name").agg(F.count(F.lit(1)).alias("users"))


def friction_signals(j: DataFrame) -> DataFrame:
    return j.groupBy(G_).agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(F.col("cart_abandon_count") > 0).alias("cart_abandoners"),
        F.sum("cart_abandon_count").alias("cart_abandons"),
        F.count_if(F.col("had_search") & (F.col("total_purchases") == 0)).alias("searched_not_converted"),
        F.avg("total_pageviews").alias("avg_pageviews"))


def group_contrast(j: DataFrame) -> DataFrame:
    """Groups side by side (pivot on the fixed group list)."""
    return j.groupBy().pivot(G_, list(WEB_GROUPS)).agg(
        F.avg("total_sessions").alias("avg_sessions"),
        F.avg("total_events").alias("avg_events"),
        F.avg("total_revenue").alias("avg_revenue"),
        F.avg(F.col("had_add_to_cart").cast("int")).alias("add_to_cart_rate"))


def small_sample_flag(j: DataFrame, min_users: int = SMALL_SAMPLE_USERS) -> DataFrame:
    g = j.groupBy(G_).agg(F.count(F.lit(1)).alias("users"))
    return g.select(G_, "users", (F.col("users") < min_users).alias("is_small_sample"))


def groups_at_a_glance(j: DataFrame) -> DataFrame:
    g = j.groupBy(G_).agg(F.count(F.lit(1)).alias("users"), F.avg("total_sessions").alias("avg_sessions"),
                          F.avg("total_revenue").alias("avg_revenue"))
    return g.select(G_, "users", _share("users").alias("share"), "avg_sessions", "avg_revenue")


def conversion_lift(j: DataFrame) -> DataFrame:
    """Purchase rate with / without each signal and their ratio."""
    signals = {"had_search": F.col("had_search"), "had_product_view": F.col("had_product_view"),
               "had_add_to_cart": F.col("had_add_to_cart"), "multi_session": F.col("total_sessions") >= 2}
    x = j.select((F.col("total_purchases") > 0).alias("buyer"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("signal"), F.coalesce(v, F.lit(False)).alias("has")) for k, v in signals.items()
    ])).alias("s")).select("buyer", "s.signal", "s.has")
    g = x.groupBy("signal").agg(
        F.count_if("has").alias("users_with"),
        F.try_divide(F.count_if(F.col("has") & F.col("buyer")).cast("double"),
                     F.count_if("has").cast("double")).alias("rate_with"),
        F.try_divide(F.count_if(~F.col("has") & F.col("buyer")).cast("double"),
                     F.count_if(~F.col("has")).cast("double")).alias("rate_without"))
    return g.select("*", F.try_divide(F.col("rate_with"), F.col("rate_without")).alias("lift"))


def stall_point(s: DataFrame) -> DataFrame:
    """Session funnel product view -> add to cart -> checkout -> purchase; the step
    with the largest relative drop is flagged."""
    c = s.agg(F.count(F.lit(1)).alias("s0"), F.count_if("had_product_view").alias("s1"),
              F.count_if("had_add_to_cart").alias("s2"), F.count_if("had_begin_checkout").alias("s3"),
              F.count_if("converted_this_session").alias("s4"))
    steps = c.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("step_no"), F.lit(nm).alias("step"), F.col(f"s{i}").alias("sessions"))
        for i, nm in enumerate(["session", "product_view", "add_to_cart", "begin_checkout", "purchase"])
    ])).alias("x")).select("x.*")
    w = Window.partitionBy().orderBy("step_no")
    d = steps.select("*", F.lag("sessions").over(w).alias("prev"))
    d = d.select("step_no", "step", "sessions",
                 F.try_divide((F.col("prev") - F.col("sessions")).cast("double"), F.col("prev").cast("double"))
                 .alias("drop_rate"))
    return d.select("*", (F.col("drop_rate") == F.max("drop_rate").over(Window.partitionBy()))
                    .alias("is_stall_point"))


def underdelivering_channels(j: DataFrame) -> DataFrame:
    src = F.coalesce(F.col("first_touch_source"), F.lit("(unknown)"))
    g = j.groupBy(src.alias("channel")).agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(F.col(G_) == "churned_non_buyer").alias("churned_non_buyers"))
    share = F.col("churned_non_buyers") / F.col("users")
    base = F.sum("churned_non_buyers").over(_all()) / F.sum("users").over(_all())
    return g.select("channel", "users", "churned_non_buyers", share.alias("cnb_share"),
                    base.alias("baseline_share"), F.try_divide(share, base).alias("ratio_to_baseline"))


def lost_buyer_value(j: DataFrame) -> DataFrame:
    b = j.where(F.col(G_).isin("active_buyer", "churned_buyer"))
    g = b.groupBy(G_).agg(F.count(F.lit(1)).alias("users"),
                          F.sum("total_revenue").alias("revenue"))
    g = g.withColumn("revenue", F.col("revenue").cast("double"))
    return g.select(G_, "users", "revenue", (F.col("revenue") / F.col("users")).alias("avg_revenue"),
                    _share("revenue").alias("share_of_buyer_revenue"))


def first_session_comparison(s: DataFrame, j: DataFrame) -> DataFrame:
    """First session of each user, compared across what the user became."""
    first = (s.groupBy(U).agg(F.min_by(F.struct("event_count", "pageview_count", "duration_seconds",
                                                  "had_add_to_cart", "had_search"),
                                        F.struct("session_start_ts", "session_id")).alias("f")))
    outcome = (F.when(F.col(G_) == "new", "new")
               .when(F.col(G_).isin("active_buyer", "churned_buyer"), "buyer")
               .when(F.col(G_) == "churned_non_buyer", "churned").otherwise("other"))
    x = first.join(j.select(U, outcome.alias("outcome")), U)
    return x.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("users"), F.avg("f.event_count").alias("avg_events"),
        F.avg("f.pageview_count").alias("avg_pageviews"), F.avg("f.duration_seconds").alias("avg_duration_s"),
        F.avg(F.col("f.had_add_to_cart").cast("int")).alias("add_to_cart_rate"),
        F.avg(F.col("f.had_search").cast("int")).alias("search_rate"))
