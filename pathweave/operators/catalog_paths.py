"""Catalogue analyses on event paths: n-grams, archetypes, transitions, exits,
depth, dwell, funnels, bursts and duplicates.

Next / previous steps come from the bucketed scans in ``operators/asof.py`` (a hot
session or user is split by time bucket); every aggregate after that is a partial
hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pathweave.functions import scalars as S
from pathweave.operators.asof import next_value, previous_value

U, SESS = "user_pseudo_id", "ga_session_id"
FUNNEL_STEPS = ("view_item", "add_to_cart", "begin_checkout", "purchase")
BUCKET_US = 3_600_000_000
ORDER = ("event_timestamp", ["event_id"])


def sequence_ngrams(ev: DataFrame, n: int = 2, bucket_us: int = BUCKET_US) -> DataFrame:
    """Consecutive event-name n-grams inside sessions (whole sessions): occurrences, sessions that
    have them, and the share of those sessions with a purchase.

    One window per (session, time bucket) looks ahead inside the bucket. A bucket's last
    events take the rest from the first n - 1 names of the buckets after it, of which n - 1 are
    enough, as each has an event. The number of shuffles does not depend on n."""
    x = ev.select(U, SESS, "event_timestamp", "event_id", "event_name", F.floor(F.col("event_timestamp") / bucket_us).alias("_bkt"))
    local = Window.partitionBy(U, SESS, "_bkt").orderBy("event_timestamp", "event_id")
    x = x.select(U, SESS, "_bkt", "event_name", F.row_number().over(local).alias("_rn"),
                 F.array_compact(F.array(*[F.lead("event_name", i).over(local) for i in range(1, n)])).alias("_next"))
    first = F.struct("_rn", "event_name")
    heads = x.groupBy(U, SESS, "_bkt").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("_rn") < n, first))), lambda s: s["event_name"]).alias("_head"),
        F.bool_or(F.col("event_name") == "purchase").alias("_bought"))
    session = Window.partitionBy(U, SESS)
    after = session.orderBy("_bkt").rowsBetween(1, n - 1)
    heads = heads.select(U, SESS, "_bkt", F.flatten(F.collect_list("_head").over(after)).alias("_after"),
                         F.max("_bought").over(session).alias("converted"))
    gram = F.concat(F.array("event_name"), F.slice(F.concat("_next", "_after"), 1, n - 1))
    g = x.join(heads, [U, SESS, "_bkt"]).select(U, SESS, "converted", gram.alias("_gram")).where(F.size("_gram") == n)
    g = g.groupBy(U, SESS, "converted", F.array_join("_gram", ">").alias("ngram")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("ngram").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("sessions"),
        (F.count_if("converted") / F.count(F.lit(1))).alias("conversion_rate"))


def page_outcomes(ev: DataFrame) -> DataFrame:
    """Per page: sessions that saw it among those with and without a purchase, and the ratio of the two shares."""
    page = S.url_path("page_location")
    s = ev.groupBy(U, SESS).agg(F.bool_or(F.col("event_name") == "purchase").alias("converted"))
    total = s.agg(F.count_if("converted").alias("_c"), F.count_if(~F.col("converted")).alias("_o"))
    seen = ev.select(U, SESS, page.alias("page")).where(F.col("page") != "").distinct().join(s, [U, SESS])
    g = seen.groupBy("page").agg(F.count_if("converted").alias("converting_sessions"), F.count_if(~F.col("converted")).alias("other_sessions"))
    share = lambda n, of: F.try_divide(F.col(n).cast("double"), F.col(of).cast("double"))
    g = g.crossJoin(F.broadcast(total))  # one row
    return g.select("page", "converting_sessions", "other_sessions",
                    F.try_divide(share("converting_sessions", "_c"), share("other_sessions", "_o")).alias("lift"))


def path_archetypes(sessions: DataFrame) -> DataFrame:
    """Session paths (capped sequence) with sessions, conversions and conversion rate."""
    p = F.array_join("event_sequence", ">")
    return sessions.groupBy(p.alias("path")).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("converted_this_session").alias("conversions"),
        (F.count_if("converted_this_session") / F.count(F.lit(1))).alias("conversion_rate"),
        F.min("event_count").alias("min_event_count"))


def transition_matrix(ev: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Page-path transitions with the share of each exit from the source page."""
    x = ev.select(U, SESS, "event_timestamp", "event_id", S.url_path("page_location").alias("from_page"))
    x = next_value(x, [U, SESS], *ORDER, {"to_page": F.col("from_page")}, bucket_us)
    g = x.where(F.col("to_page").isNotNull()).groupBy("from_page", "to_page").agg(
        F.count(F.lit(1)).alias("transitions"))
    return g.select("*", (F.col("transitions") / F.sum("transitions").over(Window.partitionBy("from_page")))
                    .alias("share_from_page"))


def hub_exit_pages(ev: DataFrame) -> DataFrame:
    """Per page path: events on it, sessions that ended on it and the exit rate."""
    last = ev.groupBy(U, SESS).agg(F.max_by(S.url_path("page_location"),
                                            F.struct("event_timestamp", "event_id")).alias("page"))
    exits = last.groupBy("page").agg(F.count(F.lit(1)).alias("exits"))
    views = ev.groupBy(S.url_path("page_location").alias("page")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(U, SESS).alias("sessions"))
    j = views.join(exits, "page", "left")
    return j.select("page", "events", "sessions", F.coalesce("exits", F.lit(0)).alias("exits"),
                    (F.coalesce("exits", F.lit(0)) / F.col("sessions")).alias("exit_rate"))


def depth_bucket(n) -> F.Column:
    c = F.col(n) if isinstance(n, str) else n
    return (F.when(c <= 1, "1").when(c == 2, "2").when(c <= 5, "3-5").when(c <= 10, "6-10").otherwise("11+"))


def session_depth(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(depth_bucket("event_count").alias("depth")).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("converted_this_session").alias("conversions"),
        (F.count_if("converted_this_session") / F.count(F.lit(1))).alias("conversion_rate"))


def dwell_bands(ev: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Time to the next event in the session, banded, per page path."""
    x = ev.select(U, SESS, "event_timestamp", "event_id", S.url_path("page_location").alias("page"))
    x = next_value(x, [U, SESS], *ORDER, {"next_ts": F.col("event_timestamp")}, bucket_us)
    x = x.select("page", ((F.col("next_ts") - F.col("event_timestamp")) / 1e6).alias("dwell_s")).where(
        F.col("dwell_s").isNotNull())
    band = (F.when(F.col("dwell_s") < 10, "<10s").when(F.col("dwell_s") < 60, "10-60s")
            .when(F.col("dwell_s") < 300, "1-5min").otherwise("5min+"))
    return x.groupBy("page", band.alias("band")).agg(F.count(F.lit(1)).alias("events"),
                                                      F.avg("dwell_s").alias("avg_dwell_s"))


def funnel(ev: DataFrame, steps: tuple[str, ...] = FUNNEL_STEPS, by: str | None = None,
           level: str = "session") -> DataFrame:
    """Ordered funnel: step k counts when its first time is at or after step k-1's.

    ``level`` = 'session' keys on (user, session), 'user' on the user alone."""
    keys = [U, SESS] if level == "session" else [U]
    dims = [by] if by else []
    first = ev.groupBy(*keys).agg(
        *[F.min(F.when(F.col("event_name") == s, F.struct("event_timestamp", "event_id"))).alias(f"t{i}")
          for i, s in enumerate(steps)],
        *([F.min_by(by, F.struct("event_timestamp", "event_id")).alias(by)] if by else []))
    reached = []
    prev = None
    for i in range(len(steps)):
        cond = F.col(f"t{i}").isNotNull() if prev is None else (prev & (F.col(f"t{i}") >= F.col(f"t{i - 1}")))
        reached.append(cond)
        prev = cond
    x = first.select(*dims, *[c.alias(f"r{i}") for i, c in enumerate(reached)])
    agg = x.groupBy(*dims).agg(F.count(F.lit(1)).alias("entities"),
                               *[F.count_if(f"r{i}").alias(f"step{i}_{s}") for i, s in enumerate(steps)])
    return agg


def event_bursts(ev: DataFrame, gap_s: float = 2.0, bucket_us: int = BUCKET_US) -> DataFrame:
    """Per user: events that follow the previous event of the user within ``gap_s``."""
    x = ev.select(U, "event_timestamp", "event_id")
    x = previous_value(x, [U], *ORDER, {"prev_ts": F.col("event_timestamp")}, bucket_us)
    burst = (F.col("event_timestamp") - F.col("prev_ts")) / 1e6 < gap_s
    return x.groupBy(U).agg(F.count(F.lit(1)).alias("events"),
                            F.count_if(F.coalesce(burst, F.lit(False))).alias("burst_events"))


def duplicate_events(ev: DataFrame, keys: tuple[str, ...] = (U, "event_name", "event_timestamp")) -> DataFrame:
    """Values of ``keys`` (user, event name, timestamp) that occur more than once."""
    return ev.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
