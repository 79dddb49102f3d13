"""Catalogue analyses over time: cohorts, lags, reactivation, RFM, concentration,
period deltas, trends and anomalies, early signals, at-risk users.

Quantile rules use exact cut points (counted values and a bucketed running sum,
ending in a single row) and a broadcast of that one row, never a global sort or ``ntile``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathweave.functions import aggs as A
from pathweave.operators.asof import exact_quantiles

U = "user_pseudo_id"
# Stretches of values that one task of the cut-point search sums.
DAY_STRETCH, COUNT_STRETCH, MONEY_STRETCH = 64, 64, 1000
MONEY = "decimal(18,2)"  # order totals are cents; decimal sums do not depend on order


def _week(d) -> Column:
    return F.date_trunc("week", F.col(d) if isinstance(d, str) else d).cast("date")


def cohort_retention(sessions: DataFrame) -> DataFrame:
    """Users active per (first-seen week, week offset) and their share of the cohort."""
    first = sessions.groupBy(U).agg(F.min("session_date").alias("first_seen"))
    x = sessions.select(U, "session_date").join(first, U)
    x = x.select(U, _week("first_seen").alias("cohort_week"),
                 F.floor(F.datediff(_week("session_date"), _week("first_seen")) / 7).cast("int").alias("week_offset"))
    g = x.groupBy("cohort_week", "week_offset").agg(F.count_distinct(U).alias("active_users"))
    size = g.where(F.col("week_offset") == 0).select("cohort_week", F.col("active_users").alias("cohort_size"))
    return g.join(size, "cohort_week").select("cohort_week", "week_offset", "active_users", "cohort_size",
                                              (F.col("active_users") / F.col("cohort_size")).alias("retention"))


def cohort_ltv(sessions: DataFrame) -> DataFrame:
    """Cumulative revenue per cohort user by week offset."""
    first = sessions.groupBy(U).agg(F.min("session_date").alias("first_seen"))
    x = sessions.select(U, "session_date", "revenue").join(first, U)
    x = x.select(_week("first_seen").alias("cohort_week"),
                 F.floor(F.datediff(_week("session_date"), _week("first_seen")) / 7).cast("int").alias("week_offset"),
                 F.col("revenue"), U)
    g = x.groupBy("cohort_week", "week_offset").agg(F.sum("revenue").alias("revenue"))
    size = first.groupBy(_week("first_seen").alias("cohort_week")).agg(F.count(F.lit(1)).alias("cohort_size"))
    w = Window.partitionBy("cohort_week").orderBy("week_offset").rowsBetween(Window.unboundedPreceding, 0)
    return g.join(size, "cohort_week").select(
        "cohort_week", "week_offset", "cohort_size", "revenue",
        (F.sum("revenue").over(w).cast("double") / F.col("cohort_size")).alias("cumulative_ltv"))


def lag_distribution(sessions: DataFrame) -> DataFrame:
    """Days between consecutive session days of a user (histogram)."""
    days = sessions.select(U, "session_date").distinct()
    w = Window.partitionBy(U).orderBy("session_date")
    x = days.select(F.datediff("session_date", F.lag("session_date").over(w)).alias("gap_days"))
    return x.where(F.col("gap_days").isNotNull()).groupBy("gap_days").agg(F.count(F.lit(1)).alias("gaps"))


def reactivation(sessions: DataFrame, gap_days: int = 30) -> DataFrame:
    """Sessions that come after at least ``gap_days`` without a session, per day."""
    days = sessions.select(U, "session_date").distinct()
    w = Window.partitionBy(U).orderBy("session_date")
    x = days.select("session_date", F.datediff("session_date", F.lag("session_date").over(w)).alias("gap"))
    return (x.where(F.col("gap") >= gap_days).groupBy("session_date")
            .agg(F.count(F.lit(1)).alias("reactivated_users")))


def post_purchase_return(journeys: DataFrame, sessions: DataFrame, within_days: int = 30) -> DataFrame:
    """Buyers who came back within ``within_days`` after their first purchase day."""
    b = journeys.where(F.col("first_purchase_date").isNotNull()).select(U, "first_purchase_date", "user_group")
    s = sessions.select(U, "session_date")
    x = b.join(s, U).groupBy(U, "user_group").agg(F.bool_or(
        (F.col("session_date") > F.col("first_purchase_date"))
        & (F.col("session_date") <= F.date_add("first_purchase_date", within_days))).alias("returned"))
    return x.groupBy("user_group").agg(F.count(F.lit(1)).alias("buyers"),
                                       F.count_if("returned").alias("returned"),
                                       (F.count_if("returned") / F.count(F.lit(1))).alias("return_rate"))


def _score(value: Column, thresholds: Column) -> Column:
    """1 + number of quintile thresholds strictly below the value."""
    return 1 + F.size(F.filter(thresholds, lambda t: t < value))


def rfm_and_lifecycle(journeys: DataFrame, w_end: date) -> DataFrame:
    rec = F.datediff(F.lit(w_end), F.col("last_seen_date"))
    base = journeys.select(U, rec.alias("recency_days"), F.col("total_sessions").alias("frequency"),
                           F.col("total_revenue").cast("double").alias("monetary"))
    qs = [0.2, 0.4, 0.6, 0.8]
    th = (exact_quantiles(base, "recency_days", qs, DAY_STRETCH, out="qr")
          .crossJoin(exact_quantiles(base, "frequency", qs, COUNT_STRETCH, out="qf"))
          .crossJoin(exact_quantiles(base, "monetary", qs, MONEY_STRETCH, out="qm")))
    x = base.crossJoin(F.broadcast(th))  # exactly one row
    r = 6 - _score(F.col("recency_days"), F.col("qr"))  # recent = high score
    x = x.select(U, "recency_days", "frequency", "monetary", r.alias("r_score"),
                 _score(F.col("frequency"), F.col("qf")).alias("f_score"),
                 _score(F.col("monetary"), F.col("qm")).alias("m_score"))
    seg = (F.when((F.col("r_score") >= 4) & (F.col("f_score") >= 4), "champion")
           .when((F.col("r_score") <= 2) & (F.col("f_score") >= 4), "at_risk")
           .when((F.col("r_score") >= 4) & (F.col("f_score") <= 2), "new_or_light")
           .when(F.col("r_score") <= 2, "hibernating").otherwise("regular"))
    return x.select("*", seg.alias("segment"))


def pareto_concentration(orders: DataFrame, buckets: int = 10) -> DataFrame:
    """Revenue by customer decile (top decile = 1) with cumulative revenue share."""
    rev = orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("revenue"))
    qs = [i / buckets for i in range(1, buckets)]
    th = exact_quantiles(rev, "revenue", qs, MONEY_STRETCH)
    x = rev.crossJoin(F.broadcast(th)).select(
        "revenue", (buckets - F.size(F.filter("q", lambda t: t < F.col("revenue")))).alias("decile"))
    g = x.groupBy("decile").agg(F.count(F.lit(1)).alias("customers"), F.sum("revenue").alias("revenue"))
    w = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)  # <= buckets rows
    return g.select("decile", "customers", "revenue",
                    (F.sum("revenue").over(w).cast("double") / F.sum("revenue").over(Window.partitionBy()).cast("double"))
                    .alias("cum_revenue_share"))


def period_deltas(sessions: DataFrame) -> DataFrame:
    """Weekly sessions, users, revenue with week-over-week change."""
    g = sessions.groupBy(_week("session_date").alias("week")).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_distinct(U).alias("users"),
        F.sum("revenue").cast("double").alias("revenue"))
    w = Window.orderBy("week")  # one row per week
    return g.select("*", *[F.try_divide(F.col(c) - F.lag(c).over(w), F.lag(c).over(w).cast("double"))
                           .alias(f"{c}_wow") for c in ("sessions", "users", "revenue")])


def trend_and_anomaly(ev: DataFrame, lookback: int = 28, z: float = 2.0) -> DataFrame:
    """Daily events with the mean / stddev of the previous ``lookback`` days and a z-score flag.

    Days without events are days with 0 events (date spine), so the look-back is one of days."""
    d = ev.groupBy(F.to_date("event_date", "yyyyMMdd").alias("day")).agg(F.count(F.lit(1)).alias("events"))
    spine = d.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    d = spine.join(d, "day", "left").select("day", F.coalesce("events", F.lit(0)).alias("events"))
    w = Window.orderBy("day").rowsBetween(-lookback, -1)  # one row per day
    x = d.select("day", "events", F.avg("events").over(w).alias("mean_prev"),
                 F.stddev_samp("events").over(w).alias("sd_prev"))
    zs = F.try_divide(F.col("events") - F.col("mean_prev"), F.col("sd_prev"))
    return x.select("*", zs.alias("z_score"), (F.abs(zs) > z).alias("is_anomaly"))


def early_signal_lift(ev: DataFrame, first_n: int = 3, signal: str = "add_to_cart", horizon_days: int = 14) -> DataFrame:
    """Conversion of users whose first ``first_n`` events include ``signal`` vs the rest.

    The label is a purchase after those events and within ``horizon_days`` of the last of
    them, so no event is both feature and label. Users with fewer events have no label."""
    at = F.struct("event_timestamp", "event_id")
    firsts = A.ordered_array_limit(ev, [U], ["event_timestamp", "event_id"], {"names": F.col("event_name"), "at": at}, first_n)
    x = firsts.where(F.size("names") == first_n).select(
        U, F.array_contains("names", signal).alias("has_signal"), F.element_at("at", -1).alias("seen"))
    until = F.col("seen.event_timestamp") + horizon_days * 86_400_000_000
    bought = (ev.where(F.col("event_name") == "purchase").select(U, at.alias("bought")).join(x.select(U, "seen"), U)
              .where((F.col("bought") > F.col("seen")) & (F.col("bought.event_timestamp") <= until)).select(U).distinct())
    g = x.join(bought.withColumn("buyer", F.lit(True)), U, "left").groupBy("has_signal").agg(
        F.count(F.lit(1)).alias("users"), F.count_if("buyer").alias("buyers"))
    return g.select("*", (F.col("buyers") / F.col("users")).alias("conversion_rate"))


def at_risk_users(sessions: DataFrame, w_end: date, drop: float = 0.5) -> DataFrame:
    """Weeks in which a user's sessions fell by at least ``drop`` against the week before.

    Every week from the user's first to that of ``w_end`` counts, so a user who stops
    altogether shows up in the first week without a session."""
    wk = sessions.groupBy(U, _week("session_date").alias("week")).agg(F.count(F.lit(1)).alias("sessions"))
    spine = wk.groupBy(U).agg(F.min("week").alias("first")).select(
        U, F.explode(F.sequence(F.col("first"), _week(F.lit(w_end)), F.expr("interval 7 days"))).alias("week"))
    x = spine.join(wk, [U, "week"], "left").select(U, "week", F.coalesce("sessions", F.lit(0)).alias("sessions"))
    w = Window.partitionBy(U).orderBy("week")  # one row per week of a user
    x = x.withColumn("prev_sessions", F.lag("sessions").over(w))
    return x.where((F.col("prev_sessions") > 0) & (F.col("sessions") <= F.col("prev_sessions") * (1 - drop)))


def sessions_to_purchase(sessions: DataFrame) -> DataFrame:
    """Buyers by how many sessions they had up to and with their first purchase, and the mean days it took."""
    at = F.struct("session_start_ts", "session_id")
    buy = sessions.where("converted_this_session").groupBy(U).agg(F.min(at).alias("_buy"), F.min("session_date").alias("_day"))
    x = sessions.join(buy, U).where(at <= F.col("_buy"))
    per_user = x.groupBy(U).agg(F.count(F.lit(1)).alias("sessions"), F.datediff(F.max("_day"), F.min("session_date")).alias("days"))
    return per_user.groupBy("sessions").agg(F.count(F.lit(1)).alias("buyers"), F.avg("days").alias("avg_days"))
