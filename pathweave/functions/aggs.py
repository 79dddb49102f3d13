"""Aggregate building blocks.  All of them keep Spark's partial (map-side) aggregation,
so a hot key is pre-combined in every map task before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_row_value(value, *order) -> Column:
    """Value on the first row by ``order`` (ties broken by the later order columns).
    Returns the row's value even when it is null."""
    return F.min_by(_c(value), F.struct(*[_c(o) for o in order]))


def last_row_value(value, *order) -> Column:
    return F.max_by(_c(value), F.struct(*[_c(o) for o in order]))


def top1_by_ignore_nulls(value, cond, *order, largest: bool = True) -> Column:
    """Value of the max (or min) ordering row among rows where ``cond`` holds."""
    key = F.when(_c(cond), F.struct(*[_c(o) for o in order]))
    return F.max_by(_c(value), key) if largest else F.min_by(_c(value), key)


def modes(df: DataFrame, keys: list[str], dims: dict[str, Column],
          ignore_nulls: tuple[str, ...] = ()) -> DataFrame:
    """Most frequent value of each (string) expression per key, as one DataFrame.

    NULL counts as a value unless the dimension is in ``ignore_nulls``; ties go to
    the smallest value, NULL first.  One stacked pass -> count per (key, dim, value)
    (partial aggregation) -> one pick per key.  (Spark's ``mode()`` is not used: its
    struct form returns wrong results after the sort-based aggregate fallback.)
    """
    stacked = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("d"), expr.cast("string").alias("v")) for name, expr in dims.items()
    ])).alias("_m")).select(*keys, F.col("_m.d").alias("_d"), F.col("_m.v").alias("_v"))
    if ignore_nulls:
        stacked = stacked.where(~(F.col("_d").isin(*ignore_nulls) & F.col("_v").isNull()))
    counts = stacked.groupBy(*keys, "_d", "_v").agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*keys).agg(*[
        F.min_by("_v", F.when(F.col("_d") == name, F.struct(-F.col("_c"), F.col("_v")))).alias(name)
        for name in dims])


def approx_median(x) -> Column:
    return F.percentile_approx(_c(x), 0.5)


def approx_quantile(x, q: float) -> Column:
    return F.percentile_approx(_c(x), q)


def ordered_array_limit(df: DataFrame, keys: list[str], order: list[str],
                        values: dict[str, Column], n: int,
                        extra_aggs: list[Column] | None = None) -> DataFrame:
    """Per key, the first ``n`` values in ``order`` as arrays (nulls kept).

    ``row_number() <= n`` lets Catalyst put a partial WindowGroupLimit before the
    shuffle, so each map task ships at most ``n`` rows per key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.select("*", *[v.alias(k) for k, v in values.items()],
                       F.row_number().over(w).alias("_rn")).where(F.col("_rn") <= n)
    packed = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order],
                                                  *[F.col(k) for k in values])))
    out = ranked.groupBy(*keys).agg(packed.alias("_seq"), *(extra_aggs or []))
    return out.select(*keys, *[F.transform("_seq", _field(k)).alias(k) for k in values],
                      *[c for c in out.columns if c not in keys and c != "_seq"])


def _field(name: str):
    return lambda e: e[name]


def topk_items(df: DataFrame, group: list[str], items: str, k: int,
               out: str = "top_items") -> DataFrame:
    """Per group, the ``k`` most frequent array elements (count desc, item asc)."""
    flat = df.select(*group, F.explode(items).alias("item"))
    counts = flat.groupBy(*group, "item").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy(*group).orderBy(F.desc("cnt"), F.asc("item"))
    top = counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return top.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "item"))), lambda e: e["item"]).alias(out))
