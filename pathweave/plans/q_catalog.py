"""Registered queries: catalogue analyses (tier C)."""

from datetime import timedelta

from pyspark.sql import functions as F

from pathweave.functions import scalars as S
from pathweave.operators import catalog_channels as CH
from pathweave.operators import catalog_cohorts as CC
from pathweave.operators import catalog_commerce as CM
from pathweave.operators import catalog_paths as CP
from pathweave.operators import catalog_segments as CS
from pathweave.operators import neighbours as NB
from pathweave.plans.registry import register


def _ev(c):
    return c.web_events


register("sequence_ngrams")(lambda c: CP.sequence_ngrams(_ev(c), 3))
register("path_archetypes")(lambda c: CP.path_archetypes(c.web_sessions))
register("transition_matrix")(lambda c: CP.transition_matrix(_ev(c)))
register("hub_exit_pages")(lambda c: CP.hub_exit_pages(_ev(c)))
register("session_depth")(lambda c: CP.session_depth(c.web_sessions))
register("dwell_bands")(lambda c: CP.dwell_bands(_ev(c)))
register("funnel")(lambda c: CP.funnel(_ev(c)))
register("funnel_by_device")(lambda c: CP.funnel(_ev(c), by="device_category"))
register("funnel_user_level")(lambda c: CP.funnel(_ev(c), level="user"))
register("event_bursts")(lambda c: CP.event_bursts(_ev(c), 3600.0))
# the synthetic export repeats no event of a user at one time; within a session names do repeat
register("duplicate_events")(lambda c: CP.duplicate_events(_ev(c), ("user_pseudo_id", "ga_session_id", "event_name")))
register("cohort_retention")(lambda c: CC.cohort_retention(c.web_sessions))
register("cohort_ltv")(lambda c: CC.cohort_ltv(c.web_sessions))
register("lag_distribution")(lambda c: CC.lag_distribution(c.web_sessions))
register("reactivation")(lambda c: CC.reactivation(c.web_sessions, 3))
register("post_purchase_return")(lambda c: CC.post_purchase_return(c.web_journeys, c.web_sessions))
register("rfm_and_lifecycle")(lambda c: CC.rfm_and_lifecycle(c.web_journeys, c.w_end))
register("pareto_concentration")(lambda c: CC.pareto_concentration(c.table("orders")))
register("period_deltas")(lambda c: CC.period_deltas(c.web_sessions))
register("trend_and_anomaly")(lambda c: CC.trend_and_anomaly(c.raw_web, min(28, c.params.window_days - 1)))
register("early_signal_lift")(lambda c: CC.early_signal_lift(_ev(c)))
register("at_risk_users")(lambda c: CC.at_risk_users(c.web_sessions, c.w_end))
register("behaviour_clusters")(lambda c: CM.behaviour_clusters(c.web_journeys))
register("conversion_cube")(lambda c: CM.conversion_cube(c.web_sessions))
register("order_cube")(lambda c: CM.order_cube(c.table("orders"), c.table("customer"), c.table("nation")))
register("attribution")(lambda c: CM.attribution(c.web_sessions))
register("channel_quality")(lambda c: CM.channel_quality(c.web_sessions))
register("order_value")(lambda c: CM.order_value(c.table("orders")))
register("basket_pairs")(lambda c: CM.basket_pairs(c.table("lineitem")))
register("viewed_not_bought")(lambda c: CM.viewed_not_bought(_ev(c)))
register("hour_day_heatmap")(lambda c: CM.hour_day_heatmap(c.web_sessions))
register("bot_heuristics")(lambda c: CM.bot_heuristics(c.web_sessions, 8, 86400))
register("data_health")(lambda c: CM.data_health(c.raw_web))
register("product_performance")(lambda c: CM.product_performance(_ev(c)))
register("cross_device")(lambda c: CM.cross_device(c.web_sessions))
register("impact_ranking")(lambda c: CM.impact_ranking(c.web_sessions, c.w_end - timedelta(days=14)))
register("page_outcomes")(lambda c: CP.page_outcomes(_ev(c)))
register("order_value_percentiles")(lambda c: CM.order_value_percentiles(c.table("orders")))
register("cart_size_curve")(lambda c: CM.cart_size_curve(c.table("lineitem")))
register("source_share_drift")(lambda c: CM.source_share_drift(c.web_sessions))
register("sessions_to_purchase")(lambda c: CC.sessions_to_purchase(c.web_sessions))

# users in feature space
FEATURES = ["total_sessions", "total_events", "total_pageviews", "total_purchases", "total_revenue", "days_active_span"]
U = "user_pseudo_id"
register("similar_users")(lambda c: NB.nearest(c.web_journeys, U, FEATURES, 5))
register("user_clusters")(lambda c: NB.clusters(c.web_journeys, U, FEATURES, 4))
register("cluster_profiles")(lambda c: NB.cluster_profiles(c.web_journeys, NB.clusters(c.web_journeys, U, FEATURES, 4), U, FEATURES))

# channels
register("paid_vs_organic")(lambda c: CH.paid_vs_organic(c.web_sessions))
register("dark_direct")(lambda c: CH.dark_direct(c.web_sessions))
register("referral_ranking")(lambda c: CH.referral_ranking(c.web_sessions))
register("campaign_fatigue")(lambda c: CH.campaign_fatigue(c.web_sessions))
register("direct_halo")(lambda c: CH.direct_halo(c.web_sessions))
register("rate_breaks")(lambda c: CH.rate_breaks(c.web_sessions))
register("weekly_seasonality")(lambda c: CH.weekly_seasonality(c.web_sessions))
register("day_part_drift")(lambda c: CH.day_part_drift(c.web_sessions))


@register("spelling_audit")
def spelling_audit(c):
    """Part names as lines were sold under them: the synthetic export has four channel values only, none like another."""
    lines = c.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return CH.spelling_audit(c.table("part").join(lines, "p_partkey"), "p_name", "n")


@register("channel_spellings")
def channel_spellings(c):
    s = c.web_sessions.select(F.concat_ws("/", "source", "medium", "campaign").alias("channel"), F.lit(1).alias("n"))
    return CH.spellings(s, "channel", "n")


# users and content
register("conversion_lag")(lambda c: CS.conversion_lag(c.web_journeys))
register("return_cadence")(lambda c: CS.return_cadence(c.web_sessions, c.web_journeys))
register("stage_transitions")(lambda c: CS.stage_transitions(_ev(c)))
register("content_affinity")(lambda c: CS.content_affinity(_ev(c)))
register("content_consumers")(lambda c: CS.content_consumers(_ev(c)))
register("dwell_conversion")(lambda c: CS.dwell_conversion(_ev(c)))
register("repeat_views")(lambda c: CS.repeat_views(_ev(c)))
register("bundle_buyers")(lambda c: CS.bundle_buyers(c.table("orders"), c.table("lineitem")))
register("promo_orders")(lambda c: CS.promo_orders(c.table("orders"), c.table("lineitem")))
register("schema_drift")(lambda c: CS.schema_drift(c.raw_game))
register("cardinality_trend")(lambda c: CS.cardinality_trend(_ev(c)))
register("id_stability")(lambda c: CS.id_stability(c.web_sessions))


@register("frequent_sets")
def frequent_sets(c):
    """Page sets of sessions."""
    pages = _ev(c).where(F.col("page_location").isNotNull()).select(U, "ga_session_id", S.url_path("page_location").alias("page"))
    return CS.frequent_sets(pages, [U, "ga_session_id"], "page", 3)


@register("frequent_parts")
def frequent_parts(c):
    """Brand sets of orders."""
    lines = c.table("lineitem").join(c.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return CS.frequent_sets(lines.select("l_orderkey", "p_brand"), ["l_orderkey"], "p_brand", 30)


@register("best_segments")
def best_segments(c):
    dims = {"device": F.col("device_category"), "part": S.day_part("session_start_ts"), "country": F.col("country"),
            "source": F.col("source"), "page": CS.content_category(F.col("landing_page"))}
    return CS.best_segments(c.web_sessions, dims, 10, 5)
