"""Catalogue analyses of channels over time: paid and organic, dark direct, referrals, spellings of one
channel, campaign fatigue, direct halo, breaks of a rate, seasonality, drift by part of day.

Series are sums per day, combined before their shuffle; from there on a series has at most as many
rows as the window has days, so windows over it are small. Days without events count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathweave.functions import scalars as S
from pathweave.operators.graph import components

# Media that are paid for, and names of direct traffic.
PAID_MEDIA = r"^(.*cp.*|ppc|retargeting|paid.*|display|banner|affiliate|ads?)$"
DIRECT = ("(direct)", "direct", "(none)")
DAY_S = 86_400


def _rate(hits: str, of: str) -> Column:
    return S.safe_ratio(hits, of)


def channel_kind(source: Column, medium: Column) -> Column:
    m, s = F.lower(F.trim(F.coalesce(medium, F.lit("")))), F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return (F.when(m.rlike(PAID_MEDIA), "paid").when(m == "organic", "organic")
            .when((s == "") | s.isin(*DIRECT), "direct").otherwise("other"))


def _outcomes(*more: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("sessions"), F.count_if("converted_this_session").alias("conversions"), *more]


def paid_vs_organic(sessions: DataFrame) -> DataFrame:
    """Sessions and conversion of each source by kind of channel, with each kind's share of the source."""
    src = F.coalesce(F.lower(F.trim("source")), F.lit("(none)"))
    g = sessions.groupBy(src.alias("source"), channel_kind(F.col("source"), F.col("medium")).alias("kind")).agg(
        *_outcomes(F.sum("revenue").alias("revenue")))
    of = F.sum("sessions").over(Window.partitionBy("source"))  # kinds of one source
    return g.select("*", _rate("conversions", "sessions").alias("conversion_rate"),
                    (F.col("sessions") / of).alias("share_of_source"), S.safe_ratio("revenue", "sessions").alias("revenue_per_session"))


def path_depth(url: Column) -> Column:
    """Non-empty segments of a URL's path; 0 for a host alone or no URL."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), S.URL_PATH_RE, 1)
    return F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("bigint")


def dark_direct(sessions: DataFrame, deep: int = 2) -> DataFrame:
    """Direct sessions by depth of their landing page; suspect are those that start deep and never search."""
    x = sessions.where(channel_kind(F.col("source"), F.col("medium")) == "direct").select(
        path_depth(F.col("landing_page")).alias("landing_depth"), "had_search", "converted_this_session")
    suspect = (F.col("landing_depth") >= deep) & ~F.col("had_search")
    g = x.groupBy("landing_depth").agg(*_outcomes(F.count_if(suspect).alias("suspect_sessions"),
                                                  F.count_if(suspect & F.col("converted_this_session")).alias("suspect_conversions")))
    return g.select("*", (F.col("suspect_sessions") / F.sum("sessions").over(Window.partitionBy())).alias("share_of_direct"))


def referral_ranking(sessions: DataFrame) -> DataFrame:
    """Sources that aren't direct by conversion rate, with their sessions a week, engagement and revenue."""
    src = F.coalesce(F.lower(F.trim("source")), F.lit("(none)"))
    x = sessions.where(channel_kind(F.col("source"), F.col("medium")) != "direct")
    g = x.groupBy(src.alias("source")).agg(
        *_outcomes(F.avg("event_count").alias("avg_events"), F.count_if(F.col("event_count") == 1).alias("bounces"),
                   F.sum("revenue").alias("revenue"), F.min("session_date").alias("first_day"), F.max("session_date").alias("last_day")))
    weeks = (F.datediff("last_day", "first_day") + 1) / 7.0
    place = Window.orderBy(F.desc("conversion_rate"), F.desc("sessions"), "source")  # one row per source
    return g.select("source", "sessions", "conversions", _rate("conversions", "sessions").alias("conversion_rate"),
                    (F.col("sessions") / F.greatest(weeks, F.lit(1.0))).alias("sessions_a_week"), "avg_events",
                    _rate("bounces", "sessions").alias("bounce_rate"), S.safe_ratio("revenue", "sessions").alias("revenue_per_session")
                    ).withColumn("rank", F.row_number().over(place))


# --------------------------------------------------------------------------- spellings
def _without(text: Column) -> Column:
    """``text`` and all it can be less one character."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                      lambda i: F.concat(F.substring(text, 1, i - 1), F.substring(text, i + 1, n)))
    return F.array_distinct(F.concat(F.array(text), cut))


def allowed_edits(length: Column) -> Column:
    """Edits within which two spellings are one name, by the shorter of the two."""
    return F.when(length < 4, 0).when(length < 8, 1).otherwise(2)


def spellings(counts: DataFrame, value: str, n: str) -> DataFrame:
    """(value, n, cluster, canonical, cluster_n, spellings): values that are spellings of one name.

    Values link where they are equal in lower case without white space, hyphens, underscores and
    dots, or there within 1 edit (4 to 7 characters) or 2 (8 and more). Candidates share a variant with up to two characters deleted
    (of two strings within e edits each has a common variant with e deletions), so no pair of unlike values is
    made; ``levenshtein`` verifies. A cluster's canonical value is its most frequent one. Null is no value.
    """
    v = counts.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.sum(n).alias("n"))
    v = v.withColumn("norm", F.regexp_replace(F.lower("value"), r"[\s_.\-]+", ""))
    names = v.select("norm").distinct()
    edits = allowed_edits(F.length("norm"))
    once = F.when(edits >= 1, _without(F.col("norm"))).otherwise(F.array("norm"))
    one = names.select("norm", edits.alias("edits"), F.explode(once).alias("variant"))
    twice = F.when(F.col("edits") == 2, _without(F.col("variant"))).otherwise(F.array("variant"))
    variants = one.select("norm", F.explode(twice).alias("variant")).distinct()
    a, b = variants.select(F.col("norm").alias("a"), "variant"), variants.select(F.col("norm").alias("b"), "variant")
    near = F.levenshtein("a", "b") <= F.least(allowed_edits(F.length("a")), allowed_edits(F.length("b")))
    links = a.join(b, "variant").where(F.col("a") < F.col("b")).select("a", "b").distinct().where(near)
    found = components(links).select(F.col("id").alias("norm"), "component")
    v = v.join(found, "norm", "left").withColumn("cluster", F.coalesce("component", "norm"))
    c = v.groupBy("cluster").agg(F.sum("n").alias("cluster_n"), F.count(F.lit(1)).alias("spellings"),
                                 F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("canonical"))
    return v.join(c, "cluster").select("value", "n", "cluster", "canonical", "cluster_n", "spellings")


def spelling_audit(counts: DataFrame, value: str, n: str) -> DataFrame:
    """Clusters of two spellings or more: canonical value, spellings, total, and the share that other spellings hold of it."""
    s = spellings(counts, value, n).where(F.col("spellings") > 1)
    return s.groupBy("cluster").agg(
        F.first("canonical").alias("canonical"), F.array_sort(F.collect_list("value")).alias("values"),
        F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("total"),
        (F.sum(F.when(F.col("value") != F.col("canonical"), F.col("n")).otherwise(0)) / F.sum("n")).alias("consolidated_share"))


# --------------------------------------------------------------------------- days
def day_spine(sessions: DataFrame) -> DataFrame:
    """Every day from the first session to the last."""
    return sessions.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b")).where("a is not null").select(
        F.explode(F.sequence("a", "b")).alias("day"))


def campaign_fatigue(sessions: DataFrame) -> DataFrame:
    """Conversion of each campaign by week of its life, against its weeks before."""
    name = F.coalesce("campaign", F.lit("(none)"))
    daily = sessions.groupBy(name.alias("campaign"), F.col("session_date").alias("day")).agg(*_outcomes())
    born = F.min("day").over(Window.partitionBy("campaign"))
    weekly = daily.withColumn("week_of_life", F.floor(F.datediff("day", born) / 7)).groupBy("campaign", "week_of_life").agg(
        F.sum("sessions").alias("sessions"), F.sum("conversions").alias("conversions"))
    before = Window.partitionBy("campaign").orderBy("week_of_life").rowsBetween(Window.unboundedPreceding, -1)
    earlier = S.safe_ratio(F.sum("conversions").over(before), F.sum("sessions").over(before))
    return weekly.select("*", _rate("conversions", "sessions").alias("conversion_rate"), earlier.alias("rate_before")).withColumn(
        "change", F.try_divide(F.col("conversion_rate") - F.col("rate_before"), F.col("rate_before")))


def direct_halo(sessions: DataFrame, most_lag: int = 7) -> DataFrame:
    """Correlation of each campaign's sessions a day with direct sessions 0 to ``most_lag`` days later; ``best`` marks
    the highest (the least lag of equals). Sums are whole numbers, so the coefficient doesn't hang on their order."""
    kind = channel_kind(F.col("source"), F.col("medium"))
    spine = day_spine(sessions)
    direct = sessions.where(kind == "direct").groupBy(F.col("session_date").alias("day")).agg(F.count(F.lit(1)).alias("y"))
    own = sessions.where((kind != "direct") & F.col("campaign").isNotNull()).groupBy("campaign", F.col("session_date").alias("day")).agg(
        F.count(F.lit(1)).alias("x"))
    # lags and days are few and known: the product of campaigns, days and lags is the result's own size
    grid = own.select("campaign").distinct().crossJoin(F.broadcast(spine)).join(own, ["campaign", "day"], "left")
    grid = grid.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(most_lag)))).withColumn("later", F.date_add("day", F.col("lag")))
    ends = spine.select(F.col("day").alias("later")).join(direct.withColumnRenamed("day", "later"), "later", "left")
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    g = grid.join(ends, "later").groupBy("campaign", "lag").agg(
        F.count(F.lit(1)).alias("days"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"),
        F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"))
    n = F.col("days")
    spread = F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double")) * F.sqrt((n * F.col("syy") - F.col("sy") * F.col("sy")).cast("double"))
    r = F.try_divide((n * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double"), spread)
    g = g.select("campaign", "lag", "days", F.round(r, 6).alias("correlation"))
    top = F.row_number().over(Window.partitionBy("campaign").orderBy(F.desc_nulls_last("correlation"), "lag"))
    return g.withColumn("best", F.col("correlation").isNotNull() & (top == 1))


def rate_breaks(sessions: DataFrame, dims: tuple[str, ...] = ("source", "device_category", "country"), least_sessions: int = 20) -> DataFrame:
    """The day from which a rate is another one, for each value of each dimension and each of two rates: conversion, and
    bounce (sessions of one event).

    Cumulative sums of hits less the expected hits at the series' overall rate; the break follows the day on which
    their size is greatest (the first of equals). ``score`` is that size by the deviation of a stable series'
    total; above 1.36 a stable series comes in 5 of 100 cases.
    """
    hits = {"conversion": F.col("converted_this_session"), "bounce": F.col("event_count") == 1}
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("(none)")).alias("value"),
                               F.lit(m).alias("metric"), h.cast("int").alias("hit")) for d in dims for m, h in hits.items()])
    series = ["dimension", "value", "metric"]
    daily = sessions.select(F.col("session_date").alias("day"), F.explode(cells).alias("c")).select("day", "c.*").groupBy(*series, "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    whole, so_far = Window.partitionBy(*series), Window.partitionBy(*series).orderBy("day")
    s = daily.select(*series, "day", F.sum("n").over(whole).alias("total"), F.sum("hits").over(whole).alias("total_hits"),
                     F.sum("n").over(so_far).alias("before"), F.sum("hits").over(so_far).alias("hits_before"),
                     F.lead("day").over(so_far).alias("next_day"))
    # in whole numbers: total * hits_before - before * total_hits
    size = F.abs(F.col("total") * F.col("hits_before") - F.col("before") * F.col("total_hits"))
    s = s.where(F.col("next_day").isNotNull() & (F.col("total") >= least_sessions)).withColumn("size", size)
    top = s.groupBy(*series).agg(F.min_by(F.struct("next_day", "before", "hits_before", "total", "total_hits", "size"),
                                          F.struct(-F.col("size"), F.col("day"))).alias("b")).select(*series, "b.*")
    misses = F.col("total") - F.col("total_hits")
    deviation = F.sqrt(F.col("total_hits") * misses / F.col("total") * 1.0) * F.col("total")
    return top.select(*series, F.col("next_day").alias("break_day"), F.col("total").alias("sessions"),
                      S.safe_ratio("hits_before", "before").alias("rate_before"),
                      S.safe_ratio(F.col("total_hits") - F.col("hits_before"), F.col("total") - F.col("before")).alias("rate_after"),
                      F.try_divide(F.col("size").cast("double"), deviation).alias("score"))


# --------------------------------------------------------------------------- seasons
def weekly_seasonality(sessions: DataFrame, wide: float = 2.0) -> DataFrame:
    """Sessions and conversions of each day as trend x weekday factor + rest.

    The trend is the mean of the seven days around a day, so the first and last three have none. A weekday's factor is the mean of
    its days' values by their trend, scaled so that the seven have mean 1. ``anomaly``: the rest is further from
    0 than ``wide`` standard deviations of all rests.
    """
    daily = day_spine(sessions).join(sessions.groupBy(F.col("session_date").alias("day")).agg(*_outcomes()), "day", "left")
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(m, F.lit(0)).alias("value")) for m in ("sessions", "conversions")]))
    x = daily.select("day", metrics.alias("m")).select("day", "m.*")
    by_metric = Window.partitionBy("metric")  # days of the window
    around = by_metric.orderBy("day").rowsBetween(-3, 3)
    x = x.withColumn("trend", F.when(F.count("value").over(around) == 7, F.avg("value").over(around))).withColumn("weekday", F.dayofweek("day"))
    raw = x.groupBy("metric", "weekday").agg(F.avg(S.safe_ratio("value", "trend")).alias("f"))
    factors = raw.select("metric", "weekday", F.try_divide(F.col("f"), F.avg("f").over(by_metric)).alias("factor"))
    x = x.join(factors, ["metric", "weekday"], "left").withColumn("rest", F.col("value") - F.col("trend") * F.col("factor"))
    limit = wide * F.stddev_pop("rest").over(by_metric)
    return x.select("metric", "day", "weekday", "value", "trend", "factor", "rest",
                    F.coalesce(F.round(F.abs("rest"), 9) > F.round(limit, 9), F.lit(False)).alias("anomaly"))


def day_part_drift(sessions: DataFrame) -> DataFrame:
    """Sessions and conversion by part of day and week, against the part's own weeks before."""
    week = F.date_trunc("week", "session_date").cast("date")
    g = sessions.groupBy(S.day_part("session_start_ts").alias("day_part"), week.alias("week")).agg(*_outcomes())
    before = Window.partitionBy("day_part").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    return g.select("*", _rate("conversions", "sessions").alias("conversion_rate"),
                    (F.col("sessions") / F.sum("sessions").over(Window.partitionBy("week"))).alias("share_of_week"),
                    S.safe_ratio(F.sum("conversions").over(before), F.sum("sessions").over(before)).alias("rate_before")).withColumn(
        "drift", F.col("conversion_rate") - F.col("rate_before"))
