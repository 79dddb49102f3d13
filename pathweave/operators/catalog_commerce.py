"""Catalogue analyses on channels, products, orders and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pathweave.functions import scalars as S
from pathweave.operators.asof import exact_quantiles, running_row_number
from pathweave.operators.catalog_cohorts import COUNT_STRETCH, MONEY, MONEY_STRETCH

U, SESS = "user_pseudo_id", "ga_session_id"
#: Order lines to a task that pairs them.
PAIR_ROWS = 250_000


def behaviour_clusters(journeys: DataFrame) -> DataFrame:
    """Rule-based behaviour segments from quantile cut points (median sessions and
    events, one global aggregate) crossed with buyer status."""
    th = (exact_quantiles(journeys, "total_sessions", [0.5], COUNT_STRETCH, out="s")
          .crossJoin(exact_quantiles(journeys, "total_events", [0.5], COUNT_STRETCH, out="e"))
          .select(F.col("s")[0].alias("med_s"), F.col("e")[0].alias("med_e")))
    x = journeys.crossJoin(F.broadcast(th))  # one row
    eng = F.when((F.col("total_sessions") > F.col("med_s")) & (F.col("total_events") > F.col("med_e")), "high") \
        .when((F.col("total_sessions") > F.col("med_s")) | (F.col("total_events") > F.col("med_e")), "mid") \
        .otherwise("low")
    buyer = F.when(F.col("total_purchases") > 0, "buyer").otherwise("browser")
    c = F.concat(eng, F.lit("_"), buyer)
    return x.groupBy(c.alias("cluster")).agg(
        F.count(F.lit(1)).alias("users"), F.avg("total_sessions").alias("avg_sessions"),
        F.avg("total_revenue").alias("avg_revenue"))


def conversion_cube(sessions: DataFrame) -> DataFrame:
    """Conversion rate over every combination of source, device and landing path
    (CUBE) with the deviation from the overall rate."""
    x = sessions.select(F.coalesce("source", F.lit("(none)")).alias("source"),
                        F.coalesce("device_category", F.lit("(none)")).alias("device_category"),
                        S.url_path("landing_page").alias("landing_path"), "converted_this_session")
    g = x.cube("source", "device_category", "landing_path").agg(
        F.grouping_id().alias("grouping_id"), F.count(F.lit(1)).alias("sessions"),
        F.count_if("converted_this_session").alias("conversions"))
    rate = F.col("conversions") / F.col("sessions")
    # one row, from a plain aggregate: the cube isn't planned twice
    total = x.agg((F.count_if("converted_this_session") / F.count(F.lit(1))).alias("_total"))
    return g.crossJoin(F.broadcast(total)).select(
        *g.columns, rate.alias("conversion_rate"), (rate - F.col("_total")).alias("deviation_from_total"))


def order_cube(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Order totals over every combination of nation, segment and priority."""
    c = customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    x = (orders.select("o_custkey", "o_totalprice", "o_orderpriority")
         .join(c, orders.o_custkey == c.c_custkey)
         .join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")))
    return x.cube("n_name", "c_mktsegment", "o_orderpriority").agg(
        F.grouping_id().alias("grouping_id"), F.count(F.lit(1)).alias("orders"),
        F.sum(F.col("o_totalprice").cast(MONEY)).alias("revenue"))


def attribution(sessions: DataFrame) -> DataFrame:
    """Per channel: conversions credited by first touch (user's first session),
    last touch (the converting session) and assists (other channels seen before)."""
    src = F.coalesce("source", F.lit("(none)"))
    conv = sessions.where("converted_this_session").groupBy(U).agg(
        F.min_by(src, F.struct("session_start_ts", "session_id")).alias("last_touch"),
        F.min("session_start_ts").alias("conv_ts"))
    s = sessions.select(U, src.alias("src"), "session_start_ts", "session_id")
    first = s.groupBy(U).agg(F.min_by("src", F.struct("session_start_ts", "session_id")).alias("first_touch"))
    before = s.join(conv.select(U, "conv_ts", "last_touch"), U).where(F.col("session_start_ts") <= F.col("conv_ts"))
    assists = (before.where(F.col("src") != F.col("last_touch")).select(U, "src").distinct()
               .groupBy(F.col("src").alias("channel")).agg(F.count(F.lit(1)).alias("assists")))
    ft = conv.join(first, U).groupBy(F.col("first_touch").alias("channel")).agg(F.count(F.lit(1)).alias("first_touch"))
    lt = conv.groupBy(F.col("last_touch").alias("channel")).agg(F.count(F.lit(1)).alias("last_touch"))
    j = ft.join(lt, "channel", "full").join(assists, "channel", "full")
    return j.select("channel", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("first_touch", "last_touch", "assists")])


def channel_quality(sessions: DataFrame) -> DataFrame:
    """Weekly conversion rate per normalised channel spelling (lower, trimmed)."""
    ch = F.coalesce(F.lower(F.trim("source")), F.lit("(none)"))
    return sessions.groupBy(ch.alias("channel"), F.date_trunc("week", "session_date").cast("date").alias("week")).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("converted_this_session").alias("conversions"),
        (F.count_if("converted_this_session") / F.count(F.lit(1))).alias("conversion_rate"))


def search_terms(ev: DataFrame, term_col: str = "search_term", results_col: str = "results") -> DataFrame:
    """Search terms by frequency with cumulative share and zero-result searches.
    (The synthetic export has no search-term field; tested on hand-made rows.)"""
    g = ev.where(F.col(term_col).isNotNull()).groupBy(F.lower(F.trim(term_col)).alias("term")).agg(
        F.count(F.lit(1)).alias("searches"), F.count_if(F.col(results_col) == 0).alias("zero_result"))
    # cumulative share in (searches desc, term) order; equal counts are split by the term's
    # first characters, so that the terms searched once don't meet in one task
    part = F.substring("term", 1, 2)
    cells = g.groupBy("searches", part.alias("_part")).agg(F.sum("searches").alias("_n"))
    before = Window.orderBy(F.desc("searches"), "_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("searches", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("searches", "_part").orderBy("term").rowsBetween(Window.unboundedPreceding, 0)
    ranked = g.withColumn("_part", part).withColumn("_in", F.sum("searches").over(inside)).join(
        cells, ["searches", "_part"]).withColumn("_cum", F.col("_in") + F.col("_before"))
    total = g.agg(F.sum("searches").alias("_total"))
    return ranked.crossJoin(F.broadcast(total)).select(
        "term", "searches", "zero_result", (F.col("_cum") / F.col("_total")).alias("cum_share"))


def order_value(orders: DataFrame, bucket_us: int = 30 * 86_400_000_000) -> DataFrame:
    """Average and (exact) median order value by the order's index in its customer's history
    (1, 2, 3+)."""
    o = orders.select("o_custkey", "o_orderkey", "o_totalprice",
                      F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("_ts"))
    x = running_row_number(o, ["o_custkey"], "_ts", ["o_orderkey"], bucket_us, out="idx")
    b = F.when(F.col("idx") >= 3, "3+").otherwise(F.col("idx").cast("string"))
    x = x.select(b.alias("order_index"), "o_totalprice")
    medians = exact_quantiles(x, "o_totalprice", [0.5], MONEY_STRETCH, ["order_index"])
    return x.groupBy("order_index").agg(
        F.count(F.lit(1)).alias("orders"), F.avg(F.col("o_totalprice").cast(MONEY)).alias("avg_value")).join(medians, "order_index").select(
        "order_index", "orders", "avg_value", F.col("q")[0].alias("median_value"))


def basket_pairs(lineitem: DataFrame, min_support: int = 2) -> DataFrame:
    """Part pairs bought in the same order, among parts bought in at least
    ``min_support`` orders (support pruning before the pair join), with lift."""
    items = lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    n_orders = items.agg(F.count_distinct("o").alias("n_orders"))  # one row
    supp = items.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    # frequent items carry their own support into the pair join (no joins afterwards)
    # and lie in parts of so many rows that the pairs of a part, counted before their shuffle, are a small table
    parts = 1 + lineitem.count() // PAIR_ROWS  # of stored lines, from the footers
    freq = items.join(supp.where(F.col("n") >= min_support), "p").repartition(parts, "o")
    a, b = freq.alias("a"), freq.alias("b")
    pairs = (a.join(b, (F.col("a.o") == F.col("b.o")) & (F.col("a.p") < F.col("b.p")))
             .groupBy(F.col("a.p").alias("part_a"), F.col("b.p").alias("part_b"),
                      F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))
             .agg(F.count(F.lit(1)).alias("orders")).where(F.col("orders") >= min_support))
    x = pairs.crossJoin(F.broadcast(n_orders))
    return x.select("part_a", "part_b", "orders",
                    (F.col("orders") * F.col("n_orders") / (F.col("n_a") * F.col("n_b"))).alias("lift"))


def viewed_not_bought(ev: DataFrame) -> DataFrame:
    """Pairs of product pages viewed in one session: in how many sessions both were viewed,
    in how many both were bought, and the sessions by which buying lags behind."""
    p = ev.select(U, SESS, S.url_path("page_location").alias("page"), "event_name").where(F.col("page") != "")
    seen = p.groupBy(U, SESS, "page").agg(F.max((F.col("event_name") == "view_item").cast("int")).alias("viewed"),
                                          F.max((F.col("event_name") == "purchase").cast("int")).alias("bought"))
    seen = seen.where((F.col("viewed") > 0) | (F.col("bought") > 0))
    a = seen.select(U, SESS, F.col("page").alias("page_a"), F.col("viewed").alias("va"), F.col("bought").alias("ba"))
    b = seen.select(U, SESS, F.col("page").alias("page_b"), F.col("viewed").alias("vb"), F.col("bought").alias("bb"))
    pairs = a.join(b, [U, SESS]).where(F.col("page_a") < F.col("page_b"))
    g = pairs.groupBy("page_a", "page_b").agg(F.sum(F.col("va") * F.col("vb")).alias("viewed_together"),
                                              F.sum(F.col("ba") * F.col("bb")).alias("bought_together"))
    return g.where(F.col("viewed_together") > F.col("bought_together")).select(
        "*", (F.col("viewed_together") - F.col("bought_together")).alias("gap"))


def hour_day_heatmap(sessions: DataFrame) -> DataFrame:
    """Sessions by hour of day (rows) and day of week 1..7 (pivot columns)."""
    x = sessions.select(F.hour("session_start_ts").alias("hour"), F.dayofweek("session_start_ts").alias("dow"))
    p = x.groupBy("hour").pivot("dow", list(range(1, 8))).agg(F.count(F.lit(1)))
    return p.select("hour", *[F.coalesce(F.col(str(d)), F.lit(0)).alias(str(d)) for d in range(1, 8)])


def bot_heuristics(sessions: DataFrame, min_events: int = 10, max_seconds: int = 60) -> DataFrame:
    """Sessions with many events in a short time, per day and country."""
    bot = (F.col("event_count") >= min_events) & (F.col("duration_seconds") <= max_seconds)
    return sessions.groupBy("session_date", F.coalesce("country", F.lit("(none)")).alias("country")).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(bot).alias("suspect_sessions"))


def data_health(ev: DataFrame) -> DataFrame:
    """Per day of the covered range (date spine, gaps included): events, users,
    event names first seen that day, and the share of events with a country."""
    d = ev.select(S.parse_event_date("event_date").alias("day"), U, "event_name",
                  F.col("geo.country").alias("country"))
    daily = d.groupBy("day").agg(F.count(F.lit(1)).alias("events"), F.count_distinct(U).alias("users"),
                                 F.avg(F.col("country").isNotNull().cast("int")).alias("country_coverage"))
    firsts = d.groupBy("event_name").agg(F.min("day").alias("day")).groupBy("day").agg(
        F.count(F.lit(1)).alias("new_event_names"))
    spine = d.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(
        F.explode(F.sequence("a", "b")).alias("day"))
    return (spine.join(daily, "day", "left").join(firsts, "day", "left")
            .select("day", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("users", F.lit(0)).alias("users"),
                    F.coalesce("new_event_names", F.lit(0)).alias("new_event_names"), "country_coverage"))


def product_performance(ev: DataFrame) -> DataFrame:
    """Per product path: views, adds, purchases, revenue, add rate, and how many
    sessions ended on it."""
    page = S.url_path("page_location")
    n = F.col("event_name")
    g = ev.groupBy(page.alias("page")).agg(
        F.count_if(n == "view_item").alias("views"), F.count_if(n == "add_to_cart").alias("adds"),
        F.count_if(n == "purchase").alias("purchases"),
        F.sum(F.when(n == "purchase", F.col("purchase_revenue").cast("decimal(28,9)"))).alias("revenue"))
    last = ev.groupBy(U, SESS).agg(F.max_by(page, F.struct("event_timestamp", "event_id")).alias("page"))
    ends = last.groupBy("page").agg(F.count(F.lit(1)).alias("session_ends"))
    return g.join(ends, "page", "left").select(
        "page", "views", "adds", "purchases", "revenue",
        F.try_divide(F.col("adds").cast("double"), F.col("views").cast("double")).alias("add_rate"),
        F.coalesce("session_ends", F.lit(0)).alias("session_ends"))


def cross_device(sessions: DataFrame) -> DataFrame:
    """Users by number of distinct devices, and buyers among them."""
    u = sessions.groupBy(U).agg(F.count_distinct("device_category").alias("devices"),
                                F.bool_or("converted_this_session").alias("buyer"))
    return u.groupBy("devices").agg(F.count(F.lit(1)).alias("users"), F.count_if("buyer").alias("buyers"))


def impact_ranking(sessions: DataFrame, split_day, dim: str = "country") -> DataFrame:
    """Contribution of each segment to the change in sessions between the days
    before ``split_day`` and from it on, ranked by absolute contribution."""
    seg = F.coalesce(F.col(dim), F.lit("(none)"))
    late = F.col("session_date") >= F.lit(split_day)
    g = sessions.groupBy(seg.alias("segment")).agg(F.count_if(~late).alias("before"), F.count_if(late).alias("after"))
    delta = F.col("after") - F.col("before")
    w = Window.orderBy(F.desc(F.abs(delta)), "segment")  # one row per segment
    return g.select("segment", "before", "after", delta.alias("delta"),
                    F.try_divide(delta.cast("double"), F.sum(delta).over(Window.partitionBy()).cast("double"))
                    .alias("share_of_delta"),
                    F.row_number().over(w).alias("rank"))


def order_value_percentiles(orders: DataFrame) -> DataFrame:
    """Exact percentiles of order values, one row each."""
    qs = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    th = exact_quantiles(orders, "o_totalprice", qs, MONEY_STRETCH)
    pairs = F.arrays_zip(F.array(*[F.lit(q) for q in qs]).alias("percentile"), F.col("q").alias("order_value"))
    return th.select(F.inline(pairs)).toDF("percentile", "order_value")


def cart_size_curve(lineitem: DataFrame) -> DataFrame:
    """Orders by number of lines, with their average value."""
    paid = F.sum(F.col("l_extendedprice").cast(MONEY))
    o = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), paid.alias("value"))
    return o.groupBy("lines").agg(F.count(F.lit(1)).alias("orders"), (F.sum("value").cast("double") / F.count(F.lit(1))).alias("avg_value"))


def source_share_drift(sessions: DataFrame) -> DataFrame:
    """Share of a week's sessions by source, and its change against the week before (0 where the source had none)."""
    src = F.coalesce("source", F.lit("(none)"))
    g = sessions.groupBy(F.date_trunc("week", "session_date").cast("date").alias("week"), src.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    t = g.groupBy("week").agg(F.sum("n").alias("_of"))
    g = g.join(t, "week").select("week", "source", "n", (F.col("n") / F.col("_of")).alias("share"))
    before = g.select(F.date_add("week", 7).alias("week"), "source", F.col("share").alias("_was"))
    return g.join(before, ["week", "source"], "left").select(
        "week", "source", F.col("n").alias("sessions"), "share", (F.col("share") - F.coalesce("_was", F.lit(0.0))).alias("drift"))
