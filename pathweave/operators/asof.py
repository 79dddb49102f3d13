"""Ordered per-key scans in two levels: carry-forward, previous / next value,
running row number.

A single ``last(x, ignorenulls).over(partitionBy(key).orderBy(ts))`` puts a whole
key (a user, a session) into one task.  At scale one key may hold a large share
of all rows, so the scan is split by time bucket:

1. per (key, bucket): the running value inside the bucket (window, one task per bucket);
2. per (key, bucket): the bucket's summary (the value of its latest row that has one,
   or its row count), an aggregate that is combined before its shuffle;
3. per key over the (few) bucket rows: the value of all earlier buckets;
4. join 3 back on (key, bucket) and combine.

The results equal the one-window forms exactly (tests compare them on random data).
Also used as the as-of join of events to attempt spans (marker rows carry the id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def carry_forward(df: DataFrame, keys: list[str], ts: str, tie: list[str],
                  values: dict[str, Column], bucket_us: int, include_current: bool = True,
                  key_max: dict[str, Column] | None = None) -> DataFrame:
    """Add one column per ``values`` entry: the last non-null value of the expression
    over the rows of the same ``keys`` ordered by (ts, *tie), up to and including the
    row (``include_current``) or strictly before it. ``key_max`` adds columns with the
    maximum of an expression over all rows of the key."""
    names, tops = list(values), key_max or {}
    base_cols = df.columns
    bucket = F.floor(F.col(ts) / F.lit(bucket_us)).alias("_bkt")
    order = [F.col(ts), *[F.col(t) for t in tie]]
    w_local = (Window.partitionBy(*keys, "_bkt").orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow if include_current else -1))
    local = df.select("*", bucket, *[values[n].alias(f"_src_{n}") for n in names]).select(
        *base_cols, "_bkt", *[F.last(f"_src_{n}", ignorenulls=True).over(w_local).alias(f"_loc_{n}") for n in names])
    # What a bucket hands on needs no order of its rows: the value of its latest row
    # that has one, pre-aggregated before the shuffle.
    at = F.struct(*order)
    ends = df.select("*", bucket).groupBy(*keys, "_bkt").agg(
        *[F.max_by(values[n], F.when(values[n].isNotNull(), at)).alias(f"_end_{n}") for n in names],
        *[F.max(e).alias(f"_top_{n}") for n, e in tops.items()])
    by_key = Window.partitionBy(*keys)
    w_prev = by_key.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_bkt",
                          *[F.last(f"_end_{n}", ignorenulls=True).over(w_prev).alias(f"_car_{n}") for n in names],
                          *[F.max(f"_top_{n}").over(by_key).alias(f"_all_{n}") for n in tops])
    joined = local.join(carried, on=[*keys, "_bkt"], how="left")
    return joined.select(*base_cols,
                         *[F.coalesce(F.col(f"_loc_{n}"), F.col(f"_car_{n}")).alias(n) for n in names],
                         *[F.col(f"_all_{n}").alias(n) for n in tops])


def previous_value(df: DataFrame, keys: list[str], ts: str, tie: list[str],
                   values: dict[str, Column], bucket_us: int) -> DataFrame:
    """LAG for never-null expressions: the value on the previous row of the key."""
    return carry_forward(df, keys, ts, tie, values, bucket_us, include_current=False)


def next_value(df: DataFrame, keys: list[str], ts: str, tie: list[str],
               values: dict[str, Column], bucket_us: int) -> DataFrame:
    """LEAD for never-null expressions: the value on the next row of the key
    (the carry-forward in reversed order; ``ts`` and ``tie`` must be numeric)."""
    neg = {f"_neg_{c}": -F.col(c) for c in [ts, *tie]}
    x = df.select("*", *[v.alias(k) for k, v in neg.items()])
    out = carry_forward(x, keys, f"_neg_{ts}", [f"_neg_{t}" for t in tie], values, bucket_us,
                        include_current=False)
    return out.drop(*neg)


def running_row_number(df: DataFrame, keys: list[str], ts: str, tie: list[str], bucket: int,
                       out: str = "row_number") -> DataFrame:
    """ROW_NUMBER over (keys) ordered by (ts, *tie): the number inside the (key,
    bucket) plus the row counts of all earlier buckets of the key."""
    base_cols = df.columns
    x = df.select("*", F.floor(F.col(ts) / F.lit(bucket)).alias("_bkt"))
    w_local = Window.partitionBy(*keys, "_bkt").orderBy(F.col(ts), *[F.col(t) for t in tie])
    local = x.select("*", F.row_number().over(w_local).alias("_rn"))
    counts = local.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    w_prev = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "_bkt", F.coalesce(F.sum("_n").over(w_prev), F.lit(0)).alias("_before"))
    j = local.join(before, [*keys, "_bkt"], "left")
    return j.select(*base_cols, (F.col("_rn") + F.col("_before")).alias(out))


def running_sum(df: DataFrame, keys: list[str], ts: str, tie: list[str], value: str, bucket: int,
                out: str = "running_sum") -> DataFrame:
    """SUM(value) over (keys) ordered by (ts, *tie) up to the row: the running sum
    inside the (key, bucket) plus the totals of all earlier buckets.  ``keys`` may be
    empty (one global order): the work is still spread over the buckets."""
    base_cols = df.columns
    x = df.select("*", F.floor(F.col(ts) / F.lit(bucket)).alias("_bkt"))
    w_local = (Window.partitionBy(*keys, "_bkt").orderBy(F.col(ts), *[F.col(t) for t in tie])
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = x.select("*", F.sum(value).over(w_local).alias("_rs"))
    totals = local.groupBy(*keys, "_bkt").agg(F.sum(value).alias("_t"))
    w_prev = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_bkt", F.coalesce(F.sum("_t").over(w_prev), F.lit(0)).alias("_before"))
    j = local.join(before, [*keys, "_bkt"], "left")
    return j.select(*base_cols, (F.col("_rs") + F.col("_before")).alias(out))


def exact_quantiles(df: DataFrame, value: str, qs: list[float], bucket: int, keys: list[str] | None = None,
                    out: str = "q") -> DataFrame:
    """Exact discrete quantiles as an array column ``out``, per ``keys`` or for all rows (then one row).

    The quantile q of n values is the smallest one that at least q * n do not exceed. Values
    are counted first (combined before the shuffle), then summed in order with the
    bucketed running sum (``bucket``: a stretch of values for one task). Nulls don't count."""
    keys = keys or []
    h = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sum(h, keys, "_v", [], "_n", bucket, "_cum")
    total = h.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    rows = cum.join(total, keys) if keys else cum.crossJoin(F.broadcast(total))  # without keys, one row
    need = lambda q: F.greatest(F.lit(1), F.col("_total") - F.floor(F.col("_total") - q * F.col("_total")))
    return rows.groupBy(*keys).agg(F.array(*[F.min(F.when(F.col("_cum") >= need(q), F.col("_v"))) for q in qs]).alias(out))
