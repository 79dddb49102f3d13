"""Table-level helpers: readiness profile, bounded preview, filter options, window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from pathweave.config import PREVIEW_MAX_CELL_CHARS, PREVIEW_MAX_ROWS


def resolve_window_df(events: DataFrame, days: int = 90) -> DataFrame:
    """One row (w_start, w_end, window_days) computed on the executors: end = latest
    day, start = end-(days-1) clamped to the earliest day."""
    cov = events.agg(F.min("event_date").alias("e"), F.max("event_date").alias("l"))
    e = F.to_date("e", "yyyyMMdd")
    l = F.to_date("l", "yyyyMMdd")
    start = F.greatest(F.date_sub(l, max(1, int(days)) - 1), e)
    return cov.select(F.date_format(start, "yyyyMMdd").alias("w_start"),
                      F.col("l").alias("w_end"),
                      (F.datediff(l, start) + 1).alias("window_days"))


def summary_profile(tables: dict[str, DataFrame | None], date_col: str = "session_date") -> DataFrame:
    """Per expected table: exists, row_count, min/max of its date column.  Missing
    tables (None) stay in the list with exists = false."""
    parts = []
    for name, df in tables.items():
        if df is None:
            parts.append(None)
            continue
        has_date = date_col in df.columns
        parts.append(df.agg(
            F.count(F.lit(1)).alias("row_count"),
            (F.min(date_col) if has_date else F.lit(None).cast("date")).alias("earliest"),
            (F.max(date_col) if has_date else F.lit(None).cast("date")).alias("latest"),
        ).select(F.lit(name).alias("table_name"), F.lit(True).alias("exists"), "row_count", "earliest", "latest"))
    present = [p for p in parts if p is not None]
    if not present:
        raise ValueError("no table present")
    out = reduce(DataFrame.unionByName, present)
    missing = [n for n, df in tables.items() if df is None]
    if missing:
        spark = present[0].sparkSession
        schema = "table_name string, exists boolean, row_count long, earliest date, latest date"
        out = out.unionByName(spark.createDataFrame([(n, False, None, None, None) for n in missing], schema))
    return out


def bounded_preview(df: DataFrame, order_by: list[str], max_rows: int = PREVIEW_MAX_ROWS,
                    max_chars: int = PREVIEW_MAX_CELL_CHARS) -> tuple[DataFrame, DataFrame]:
    """(preview, meta): the first ``max_rows`` rows in ``order_by`` with every
    string / date / array cell cut to ``max_chars`` characters (numbers and booleans
    unchanged), and one row (total_rows, truncated)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType, T.ArrayType, T.StructType)):
            c = F.substring(c.cast("string"), 1, max_chars)
        cols.append(c.alias(f.name))
    preview = df.orderBy(*order_by).limit(max_rows).select(*cols)
    meta = df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", (F.col("total_rows") > max_rows).alias("truncated"))
    return preview, meta


def session_filter_options(sessions: DataFrame) -> DataFrame:
    """One row: sorted distinct non-null countries and app versions."""
    return sessions.agg(F.array_sort(F.collect_set("country")).alias("countries"),
                        F.array_sort(F.collect_set("app_version")).alias("app_versions"))


def rank_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """QUALIFY row_number() = 1 (Catalyst turns the filter into a WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
