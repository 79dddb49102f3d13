"""Web tables: per-session roll-up and per-user journeys with user groups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from pathweave.config import JobParams
from pathweave.functions import aggs as A
from pathweave.functions import scalars as S
from pathweave.functions.params import event_param

USER, SESS = "user_pseudo_id", "ga_session_id"


def web_session_events(raw: DataFrame) -> DataFrame:
    """Flat in-session web events (the only columns the session roll-up reads)."""
    ev = raw.where(F.col(USER).isNotNull()).select(
        USER, "event_name", "event_timestamp", "event_id",
        S.parse_event_date("event_date").alias("event_date_parsed"),
        event_param("ga_session_id").alias(SESS),
        event_param("page_location", "string").alias("page_location"),
        F.col("device.category").alias("device_category"),
        F.col("geo.country").alias("country"),
        F.col("traffic_source.source").alias("src"),
        F.col("traffic_source.medium").alias("med"),
        F.col("traffic_source.name").alias("cmp"),
        F.col("ecommerce.purchase_revenue").alias("purchase_revenue"),
    )
    return ev.where(F.col(SESS).isNotNull())


def web_sessions(raw: DataFrame, params: JobParams = JobParams(), events: DataFrame | None = None) -> DataFrame:
    """One row per (user, ga_session_id).  ``events``: stored output of
    :func:`web_session_events` (both branches then read flat columns).

    Plan: a hash aggregate with map-side combine for the counters, plus a
    first-N branch (partial WindowGroupLimit) for sequences and first-row values;
    both are hash-partitioned on (user, session) so the final join needs no shuffle.
    """
    ev = events if events is not None else web_session_events(raw)
    name = F.col("event_name")
    counters = ev.groupBy(USER, SESS).agg(
        F.min("event_date_parsed").alias("session_date"),
        F.min("event_timestamp").alias("start_us"),
        F.max("event_timestamp").alias("end_us"),
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(name == "page_view").alias("pageview_count"),
        F.bool_or(name == "view_search_results").alias("had_search"),
        F.bool_or(name.isin("view_item", "view_item_details")).alias("had_product_view"),
        F.bool_or(name == "add_to_cart").alias("had_add_to_cart"),
        F.bool_or(name == "begin_checkout").alias("had_begin_checkout"),
        F.bool_or(name == "purchase").alias("converted_this_session"),
        F.sum(F.when(name == "purchase", F.coalesce("purchase_revenue", F.lit(0.0))).otherwise(0.0))
        .alias("revenue_sum"),
    )
    first = A.first_row_value(
        F.struct("src", "med", "cmp", "device_category", "country", "page_location"),
        "event_timestamp", "event_id").alias("first")
    seqs = A.ordered_array_limit(
        ev, [USER, SESS], ["event_timestamp", "event_id"],
        {"event_sequence": F.col("event_name"), "page_sequence": S.url_path("page_location")},
        params.web_sequence_cap, extra_aggs=[first])
    s = counters.join(seqs, [USER, SESS], "inner")
    return s.select(
        S.session_key(USER, SESS).alias("session_id"),
        USER,
        "session_date",
        S.timestamp_from_micros("start_us").alias("session_start_ts"),
        F.col("first.src").alias("source"),
        F.col("first.med").alias("medium"),
        F.col("first.cmp").alias("campaign"),
        F.col("first.device_category").alias("device_category"),
        F.col("first.country").alias("country"),
        F.col("first.page_location").alias("landing_page"),
        "event_count", "pageview_count",
        S.duration_seconds("start_us", "end_us").alias("duration_seconds"),
        "event_sequence", "page_sequence",
        "had_search", "had_product_view", "had_add_to_cart", "had_begin_checkout",
        "converted_this_session",
        S.decimal_revenue("revenue_sum").alias("revenue"),
    )


def web_user_group(first_seen: Column, last_seen: Column, purchases: Column,
                   w_end: date, new_cutoff: int, churn_cutoff: int) -> Column:
    """new > active_buyer > churned_buyer > active_non_buyer > churned_non_buyer."""
    end = F.lit(w_end)
    active = last_seen > F.date_sub(end, churn_cutoff)
    return (F.when(first_seen > F.date_sub(end, new_cutoff), "new")
            .when((purchases > 0) & active, "active_buyer")
            .when(purchases > 0, "churned_buyer")
            .when(active, "active_non_buyer")
            .otherwise("churned_non_buyer"))


def web_user_journeys(sessions: DataFrame, w_end: date, params: JobParams = JobParams()) -> DataFrame:
    """One row per user from the session table (one shuffle on user, all aggregates partial)."""
    order = ("session_start_ts", "session_id")
    conv = F.col("converted_this_session")
    agg = sessions.groupBy(USER).agg(
        F.min("session_date").alias("first_seen_date"),
        F.max("session_date").alias("last_seen_date"),
        F.count(F.lit(1)).alias("total_sessions"),
        F.sum("event_count").alias("total_events"),
        F.sum("pageview_count").alias("total_pageviews"),
        F.count_if(conv).alias("total_purchases"),
        F.sum("revenue").alias("total_revenue"),
        F.min(F.when(conv, F.col("session_date"))).alias("first_purchase_date"),
        F.bool_or("had_search").alias("had_search"),
        F.bool_or("had_product_view").alias("had_product_view"),
        F.bool_or("had_add_to_cart").alias("had_add_to_cart"),
        F.count_if(F.col("had_add_to_cart") & ~conv).alias("cart_abandon_count"),
        A.first_row_value(F.struct("source", "medium", "device_category"), *order).alias("ft"),
        A.last_row_value(F.struct("source", "medium"), *order).alias("lt"),
        F.count_if(S.is_weekend("session_start_ts")).alias("weekend_sessions"),
        F.count_if(~S.is_weekend("session_start_ts")).alias("weekday_sessions"),
        A.last_row_value("event_sequence", "event_count", *order).alias("top_event_sequence"),
    )
    m = A.modes(sessions, [USER], {"primary_device": F.col("device_category"),
                                   "primary_country": F.col("country"),
                                   "time_of_day_mode": S.day_part("session_start_ts")})
    agg = agg.join(m, USER, "left")
    end = F.lit(w_end)
    return agg.select(
        USER,
        web_user_group(F.col("first_seen_date"), F.col("last_seen_date"), F.col("total_purchases"),
                       w_end, params.new_cutoff_days, params.churn_cutoff_days).alias("user_group"),
        "first_seen_date", "last_seen_date",
        F.datediff("last_seen_date", "first_seen_date").alias("days_active_span"),
        "total_sessions", "total_events", "total_pageviews", "total_purchases",
        F.col("total_revenue").cast("decimal(38,9)").alias("total_revenue"),
        "first_purchase_date",
        F.datediff("first_purchase_date", "first_seen_date").alias("days_to_first_purchase"),
        F.col("ft.source").alias("first_touch_source"),
        F.col("ft.medium").alias("first_touch_medium"),
        F.col("ft.device_category").alias("first_touch_device"),
        F.col("lt.source").alias("last_touch_source"),
        F.col("lt.medium").alias("last_touch_medium"),
        "primary_device", "primary_country", "time_of_day_mode",
        S.weekday_weekend().alias("weekday_weekend"),
        "had_search", "had_product_view", "had_add_to_cart", "cart_abandon_count",
        "top_event_sequence",
        (F.col("first_seen_date") <= F.date_sub(end, params.churn_cutoff_days)).alias("is_eligible_for_churn"),
    )
