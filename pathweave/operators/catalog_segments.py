"""Catalogue analyses of users and content: lags, cadence, stage transitions, content affinity, dwell and
repeats against conversion, bundles, frequent sets, best segments, schema drift and identity."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window, functions as F

from pathweave.functions import scalars as S
from pathweave.operators.asof import exact_quantiles, next_value
from pathweave.operators.catalog_cohorts import DAY_STRETCH, MONEY
from pathweave.operators.catalog_paths import BUCKET_US, ORDER
from pathweave.session import checkpoint_dir

U, SESS = "user_pseudo_id", "ga_session_id"
DAY_US = 86_400_000_000


# --------------------------------------------------------------------------- lags and stages
def conversion_lag(journeys: DataFrame) -> DataFrame:
    """Buyers by days from first touch to first purchase, with the share that had bought by then, and the median and mode marked."""
    x = journeys.where(F.col("days_to_first_purchase").isNotNull()).groupBy(F.col("days_to_first_purchase").alias("lag_days")).agg(
        F.count(F.lit(1)).alias("buyers"))
    every, so_far = Window.partitionBy(), Window.orderBy("lag_days")  # one row per day of the window
    x = x.select("*", F.sum("buyers").over(so_far).alias("_by"), F.sum("buyers").over(every).alias("_of"), F.max("buyers").over(every).alias("_most"))
    x = x.withColumn("_half", F.min(F.when(F.col("_by") * 2 >= F.col("_of"), F.col("lag_days"))).over(every))
    x = x.withColumn("_mode", F.min(F.when(F.col("buyers") == F.col("_most"), F.col("lag_days"))).over(every))
    return x.select("lag_days", "buyers", (F.col("_by") / F.col("_of")).alias("share_by_then"),
                    (F.col("lag_days") == F.col("_half")).alias("is_median"), (F.col("lag_days") == F.col("_mode")).alias("is_mode"))


def return_cadence(sessions: DataFrame, journeys: DataFrame) -> DataFrame:
    """Days between consecutive session days of returning users, by user group: gaps, users, exact median and p90."""
    days = sessions.select(U, "session_date").distinct()
    gap = F.datediff("session_date", F.lag("session_date").over(Window.partitionBy(U).orderBy("session_date")))
    gaps = days.select(U, gap.alias("gap_days")).where(F.col("gap_days").isNotNull()).join(journeys.select(U, "user_group"), U)
    counts = gaps.groupBy("user_group", U).agg(F.count(F.lit(1)).alias("gaps")).groupBy("user_group").agg(
        F.sum("gaps").alias("gaps"), F.count(F.lit(1)).alias("users"))
    q = exact_quantiles(gaps, "gap_days", [0.5, 0.9], DAY_STRETCH, ["user_group"])
    return counts.join(q, "user_group").select("user_group", "users", "gaps", F.col("q")[0].alias("median_days"), F.col("q")[1].alias("p90_days"))


#: Stages of a user in their order, and the event that enters each; the first is entered by any event.
STAGES = {"visiting": None, "evaluating": "view_item", "intending": "add_to_cart", "deciding": "begin_checkout", "buying": "purchase"}


def stage_times(ev: DataFrame, stages: dict[str, str | None] = STAGES) -> DataFrame:
    """(user, t0, t1, ...): when each user entered each stage (null: not yet).

    An automaton over the user's events in order: in a stage it waits for the event of the next one and takes the first.
    It is folded stage by stage: the entry is the minimum over the events after the entry before it, an aggregate that
    is combined before its shuffle, so no user's events meet in one task.
    """
    at = F.struct("event_timestamp", "event_id")
    events = ev.select(U, "event_name", at.alias("at"))
    users = events.groupBy(U).agg(F.min("at").alias("t0"))
    for i, name in enumerate(list(stages.values())[1:], 1):
        after = events.where(F.col("event_name") == name).join(users.select(U, f"t{i - 1}"), U).where(F.col("at") >= F.col(f"t{i - 1}"))
        users = users.join(after.groupBy(U).agg(F.min("at").alias(f"t{i}")), U, "left")
    return users


def stage_transitions(ev: DataFrame, slow_days: int = 7, stages: dict[str, str | None] = STAGES) -> DataFrame:
    """For each stage and the next: users who entered it, who went on, their rate and exact median time, and how many of those
    who took longer than ``slow_days`` came to buy in the end."""
    names = list(stages)
    t = stage_times(ev, stages)
    spans = F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(a).alias("from_stage"), F.lit(b).alias("to_stage"), F.col(f"t{i}").isNotNull().alias("entered"),
        (F.col(f"t{i + 1}.event_timestamp") - F.col(f"t{i}.event_timestamp")).alias("us")) for i, (a, b) in enumerate(zip(names, names[1:]))]))
    x = t.select(spans.alias("s"), F.col(f"t{len(names) - 1}").isNotNull().alias("buys")).select("s.*", "buys").where("entered")
    went, slow = F.col("us").isNotNull(), F.col("us") > slow_days * DAY_US
    g = x.groupBy("i", "from_stage", "to_stage").agg(
        F.count(F.lit(1)).alias("entered"), F.count_if(went).alias("went_on"), F.count_if(slow).alias("slow"),
        F.count_if(went & ~slow & F.col("buys")).alias("_quick_buyers"), F.count_if(went & ~slow).alias("_quick"),
        F.count_if(slow & F.col("buys")).alias("_slow_buyers"))
    medians = exact_quantiles(x, "us", [0.5], DAY_US, ["i"])
    return g.join(medians, "i", "left").select(
        "from_stage", "to_stage", "entered", "went_on", (F.col("went_on") / F.col("entered")).alias("transition_rate"),
        (F.col("q")[0] / DAY_US).alias("median_days"), "slow", S.safe_ratio("_quick_buyers", "_quick").alias("buy_rate_quick"),
        S.safe_ratio("_slow_buyers", "slow").alias("buy_rate_slow"))


# --------------------------------------------------------------------------- content
def content_category(url: Column, segments: int = 2) -> Column:
    """The first path segments of a page; 'home' for the root, null without a page."""
    path = F.regexp_extract(url, S.URL_PATH_RE, 1)
    parts = F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, segments)
    return F.when(F.size(parts) == 0, F.when(url.isNotNull(), "home")).otherwise(F.array_join(parts, "/"))


def content_affinity(ev: DataFrame, segments: int = 2) -> DataFrame:
    """For each content category: users who saw it, how many of them bought then or later, and that rate by the rate of all users."""
    x = ev.select(U, "event_name", "event_timestamp", content_category(F.col("page_location"), segments).alias("category"))
    bought = x.groupBy(U).agg(F.max(F.when(F.col("event_name") == "purchase", F.col("event_timestamp"))).alias("bought"))
    seen = x.where(F.col("category").isNotNull() & (F.col("event_name") != "purchase")).groupBy(U, "category").agg(F.min("event_timestamp").alias("seen"))
    site = bought.agg((F.count("bought") / F.count(F.lit(1))).alias("site_rate"))  # one row
    g = seen.join(bought, U).groupBy("category").agg(
        F.count(F.lit(1)).alias("users"), F.count_if(F.col("bought") >= F.col("seen")).alias("converted"))
    return g.crossJoin(F.broadcast(site)).select(
        "category", "users", "converted", (F.col("converted") / F.col("users")).alias("conversion_rate"),
        F.try_divide(F.col("converted") / F.col("users"), F.col("site_rate")).alias("affinity"))


def content_consumers(ev: DataFrame, segments: int = 2) -> DataFrame:
    """Users by how many content categories they saw before their first purchase (0, 1, 2-3, 4+), and how many of them bought."""
    x = ev.select(U, "event_name", "event_timestamp", content_category(F.col("page_location"), segments).alias("category"))
    first = x.groupBy(U).agg(F.min(F.when(F.col("event_name") == "purchase", F.col("event_timestamp"))).alias("bought"))
    before = x.join(first, U).where(F.col("category").isNotNull() & (F.col("event_name") != "purchase")
                                    & (F.col("bought").isNull() | (F.col("event_timestamp") < F.col("bought"))))
    n = before.groupBy(U, "category").agg(F.lit(1).alias("one")).groupBy(U).agg(F.count(F.lit(1)).alias("n"))
    k = F.coalesce("n", F.lit(0))
    band = F.when(k <= 1, k.cast("string")).when(k <= 3, "2-3").otherwise("4+")
    g = first.join(n, U, "left").groupBy(band.alias("categories")).agg(F.count(F.lit(1)).alias("users"), F.count("bought").alias("buyers"))
    return g.select("*", (F.col("buyers") / F.col("users")).alias("conversion_rate"))


def dwell_conversion(ev: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Page stays by dwell band (time to the session's next event), and the share of them whose session buys afterwards."""
    x = ev.select(U, SESS, "event_timestamp", "event_id", content_category(F.col("page_location")).alias("category"))
    x = next_value(x, [U, SESS], *ORDER, {"next_ts": F.col("event_timestamp")}, bucket_us)
    buys = ev.where(F.col("event_name") == "purchase").groupBy(U, SESS).agg(F.max("event_timestamp").alias("bought"))
    s = (F.col("next_ts") - F.col("event_timestamp")) / 1e6
    band = F.when(s < 10, "<10s").when(s < 30, "10-30s").when(s < 120, "30-120s").when(s < 600, "2-10min").otherwise(">10min")
    x = x.where(F.col("next_ts").isNotNull() & F.col("category").isNotNull()).join(buys, [U, SESS], "left")
    g = x.groupBy("category", band.alias("band")).agg(
        F.count(F.lit(1)).alias("stays"), F.count_if(F.col("bought") > F.col("event_timestamp")).alias("converted"))
    return g.select("*", (F.col("converted") / F.col("stays")).alias("conversion_rate"))


def repeat_views(ev: DataFrame) -> DataFrame:
    """Sessions by the most events that one page has in them (1, 2, 3-4, 5+), and how many of them buy."""
    pages = ev.where(F.col("page_location").isNotNull()).groupBy(U, SESS, S.url_path("page_location").alias("page")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event_name") == "purchase").alias("bought"))
    s = pages.groupBy(U, SESS).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("pages"), F.bool_or("bought").alias("bought"))
    band = F.when(F.col("n") <= 2, F.col("n").cast("string")).when(F.col("n") <= 4, "3-4").otherwise("5+")
    g = s.groupBy(band.alias("most_repeats")).agg(F.count(F.lit(1)).alias("sessions"), F.count_if("bought").alias("conversions"),
                                                 F.avg("pages").alias("avg_pages"))
    return g.select("*", (F.col("conversions") / F.col("sessions")).alias("conversion_rate"))


# --------------------------------------------------------------------------- baskets
def bundle_buyers(orders: DataFrame, lineitem: DataFrame, days: int = 90) -> DataFrame:
    """Customers by the number of parts in their first order: how many order again, and within ``days``; with the share of discounted lines."""
    parts = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_distinct("l_partkey").alias("parts"), F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_discount") > 0).alias("discounted"))
    at = F.struct("o_orderdate", "o_orderkey")
    firsts = orders.groupBy("o_custkey").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("orders"))
    later = orders.join(firsts.select("o_custkey", "first"), "o_custkey").where(at > F.col("first")).groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("again"))
    x = firsts.join(later, "o_custkey", "left").join(parts, F.col("first.o_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("parts") == 1, "single").when(F.col("parts") == 2, "pair").otherwise("bundle")
    soon = F.datediff(F.col("again"), F.col("first.o_orderdate")) <= days
    g = x.groupBy(kind.alias("first_order")).agg(
        F.count(F.lit(1)).alias("customers"), F.count("again").alias("returned"), F.count_if(soon).alias("returned_soon"),
        F.avg("orders").alias("avg_orders"), (F.sum("discounted") / F.sum("lines")).alias("discounted_lines"))
    return g.select("*", (F.col("returned") / F.col("customers")).alias("return_rate"), (F.col("returned_soon") / F.col("customers")).alias("soon_rate"))


def promo_orders(orders: DataFrame, lineitem: DataFrame, least_discount: float = 0.05) -> DataFrame:
    """Orders by the share of their lines that are discounted (none, some, all), with value and lines."""
    promo = F.col("l_discount") >= least_discount
    lines = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(promo).alias("promo"))
    kind = F.when(F.col("promo") == 0, "none").when(F.col("promo") == F.col("lines"), "all").otherwise("some")
    x = orders.join(lines, "o_orderkey")
    return x.groupBy(kind.alias("discounted")).agg(
        F.count(F.lit(1)).alias("orders"), F.avg("lines").alias("avg_lines"), F.avg(F.col("o_totalprice").cast(MONEY)).alias("avg_value"))


def frequent_sets(baskets: DataFrame, key: list[str], item: str, least: int, most_size: int = 3) -> DataFrame:
    """Sets of 2 to ``most_size`` items that are together in ``least`` baskets or more: items (in order), size, baskets, lift.

    Items below the support go first. Spark's FP-growth then deals each basket out to its items as conditional prefixes and grows
    a prefix tree for each group of items, so no pair is made of what isn't frequent. Null items don't count.
    """
    checkpoint_dir(baskets.sparkSession)
    # baskets and their frequent parts are each read several times, and made once
    sets = baskets.where(F.col(item).isNotNull()).groupBy(*key).agg(F.collect_set(F.col(item).cast("string")).alias("items")).checkpoint()
    n = sets.count()
    items = sets.select(*key, F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    lists = items.join(often.select("item"), "item").groupBy(*key).agg(F.collect_list("item").alias("items")).where(
        F.size("items") > 1).select("items").checkpoint()
    # a share of the lists with two frequent items or more, just below ``least`` of them
    share = (least - 0.5) / max(1, lists.count())
    if share > 1:
        return often.select(F.array("item").alias("items"), F.lit(2).cast("bigint").alias("size"), "n", F.lit(0.0).alias("lift")).toDF(
            "items", "size", "baskets", "lift").where(F.lit(False))
    found = FPGrowth(itemsCol="items", minSupport=share).fit(lists).freqItemsets.where(F.size("items").between(2, most_size))
    found = found.select(F.array_sort("items").alias("items"), F.col("freq").alias("baskets")).withColumn("id", F.concat_ws("\x1f", "items"))
    single = found.select("id", F.explode("items").alias("item")).join(often, "item").groupBy("id").agg(
        F.sum(F.log(F.col("n") / F.lit(float(n)))).alias("log_chance"))
    return found.join(single, "id").select("items", F.size("items").cast("bigint").alias("size"), "baskets",
                                           (F.col("baskets") / F.lit(float(n)) / F.exp("log_chance")).alias("lift"))


# --------------------------------------------------------------------------- segments
def best_segments(sessions: DataFrame, dims: dict[str, Column], k: int = 10, least: int = 10, report: dict | None = None) -> DataFrame:
    """The ``k`` segments (values of any of ``dims``) whose conversion adds most: quality = share of sessions x (rate - overall rate).

    Level by level: segments of one dimension, then of two, and so on. However it is narrowed, a segment can keep no
    more than its conversions and lose all else, so conversions x (1 - overall rate) / sessions bounds the quality of all
    below it; segments whose bound is no better than the k-th best so far, or with fewer sessions than ``least``, are not
    narrowed. A combination is counted only on sessions all of whose smaller combinations are left. Ties go by
    size of the combination and name. ``report`` receives the cells counted per level.
    """
    checkpoint_dir(sessions.sparkSession)
    names = list(dims)
    x = sessions.select(F.col("converted_this_session").cast("int").alias("hit"), *[
        F.coalesce(c.cast("string"), F.lit("(none)")).alias(n) for n, c in dims.items()])
    total = x.agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits")).first()
    n, rate = total["n"], (total["hits"] or 0) / max(1, total["n"])
    label = lambda of: F.concat_ws("\x1e", *[F.concat(F.lit(f"{d}="), F.col(d)) for d in of])
    best, left = None, None
    for size in range(1, len(names) + 1):
        combos = list(combinations(names, size))
        cells = F.array(*[F.struct(label(c).alias("segment"), F.array(*[label(s) for s in combinations(c, size - 1)]).alias("parents")) for c in combos])
        rows = x.select("hit", F.explode(cells).alias("c")).select("hit", "c.*")
        if left is not None:
            # the segments that may be narrowed are known: candidates are joined to them before they are counted
            few = rows.groupBy("segment", "parents").agg(F.count(F.lit(1)).alias("sessions"), F.sum("hit").alias("conversions"))
            up = few.select("segment", F.explode("parents").alias("p")).join(left.select(F.col("segment").alias("p")), "p")
            fine = up.groupBy("segment").agg(F.count(F.lit(1)).alias("ok")).where(F.col("ok") == size).select("segment")
            counted = few.join(fine, "segment").select("segment", "sessions", "conversions")
        else:
            counted = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("sessions"), F.sum("hit").alias("conversions"))
        counted = counted.where(F.col("sessions") >= least).select(
            "segment", F.lit(size).cast("bigint").alias("size"), "sessions", "conversions",
            F.round((F.col("conversions") - F.col("sessions") * rate) / n, 9).alias("quality"),
            F.round(F.col("conversions") * (1 - rate) / n, 9).alias("bound")).checkpoint()
        if report is not None:
            report[size] = counted.count()
        both = counted.drop("bound") if best is None else best.unionByName(counted.drop("bound"))
        best = both.orderBy(F.desc("quality"), "size", "segment").limit(k).checkpoint()
        kth = best.orderBy(F.desc("quality"), "size", "segment").collect()
        worst = kth[-1]["quality"] if len(kth) == k else float("-inf")
        left = counted.where(F.col("bound") > worst).select("segment")
        if left.isEmpty():
            break
    place = F.row_number().over(Window.orderBy(F.desc("quality"), "size", "segment"))  # k rows
    return best.select(F.translate("segment", "\x1e", "&").alias("segment"), "size", "sessions", "conversions",
                       (F.col("conversions") / F.col("sessions")).alias("conversion_rate"), "quality", place.alias("rank"))


# --------------------------------------------------------------------------- data quality
def schema_drift(raw: DataFrame) -> DataFrame:
    """Event parameter keys by event name: first and last day seen, events with it, and days after the export's first day that it came."""
    days = raw.select("event_name", S.parse_event_date("event_date").alias("day"), F.explode(F.array_distinct("event_params.key")).alias("key"))
    g = days.groupBy("event_name", "key").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("events"))
    start = raw.agg(F.min(S.parse_event_date("event_date")).alias("start"))  # one row
    return g.crossJoin(F.broadcast(start)).select("event_name", "key", "first_day", "last_day", "events",
                                                  F.datediff("first_day", "start").cast("bigint").alias("days_after_start"))


def cardinality_trend(ev: DataFrame, within: float = 0.1) -> DataFrame:
    """Distinct users a week, from one HLL sketch a day that is merged into weeks, beside exact counts and change to the week before.

    The sketches are what an incremental run keeps: a week is the union of its days, no event is read again.
    ``estimate_holds``: the estimate is within ``within`` of the exact count."""
    day = ev.select("event_date_parsed", U)
    daily = day.groupBy("event_date_parsed").agg(F.hll_sketch_agg(U).alias("sketch"))
    week = F.date_trunc("week", "event_date_parsed").cast("date").alias("week")
    merged = daily.groupBy(week).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"), F.count(F.lit(1)).alias("days"))
    exact = day.select(week, U).distinct().groupBy("week").agg(F.count(F.lit(1)).alias("users"))
    x = merged.join(exact, "week")
    before = F.lag("users").over(Window.orderBy("week"))  # weeks of the window
    return x.select("week", "days", "users", F.try_divide((F.col("users") - before).cast("double"), before.cast("double")).alias("change"),
                    (F.abs(F.col("estimate") - F.col("users")) <= within * F.col("users")).alias("estimate_holds"))


def id_stability(sessions: DataFrame) -> DataFrame:
    """Sessions per user id and share of ids never seen before, by week."""
    week = F.date_trunc("week", "session_date").cast("date")
    per = sessions.groupBy(U, week.alias("week")).agg(F.count(F.lit(1)).alias("n"))
    born = F.min("week").over(Window.partitionBy(U))  # a user's weeks
    g = per.withColumn("_new", F.col("week") == born).groupBy("week").agg(
        F.count(F.lit(1)).alias("users"), F.sum("n").alias("sessions"), F.count_if("_new").alias("new_users"))
    r = F.col("sessions") / F.col("users")
    g = g.select("week", "users", "sessions", "new_users", r.alias("sessions_per_user"))
    return g.withColumn("change", F.try_divide(F.col("sessions_per_user"), F.lag("sessions_per_user").over(Window.orderBy("week"))) - 1)
