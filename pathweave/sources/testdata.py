"""Adapter: the synthetic ``events`` table -> the raw event export frame.

The synthetic table has (event_id, ts, user_id, event_type, value, props='{"k": n}').
It becomes one export row per input row; no row is dropped.  Rules (``k`` = props.k,
``n`` = day index of ts from the first day, ``uid`` = user_id, ``eid`` = event_id):

* user lifecycles: each uid is split into consecutive pseudo users ("generations")
  of ``5 + uid % 11`` days, shifted by ``uid % 7`` days, so that users start late
  and stop early (new / churned) while every row is kept;
* ga_session_id = n div 2 (two-day sessions); engagement_time_msec = 1000 k + 500;
* dimensions from uid (country, OS, app version, traffic source) and eid (device);
* event names and gameplay params by event_type and k (see ``_web_names`` and
  ``_game_names``).

The same rules are written once more as DuckDB SQL in ``pathweave.oracle.prefix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathweave.session import prepare

# Fixed values of the mapping rule.
FIRST_DAY = "2024-01-01"
FIRST_DAY_EPOCH_S = 1704067200
APP_ID = "com.example.app"
SHOP_URL = "https://shop.example.com"


def _param(key: str, cond: Column | None, *, s: Column | None = None,
           i: Column | None = None) -> Column:
    value = F.struct(
        (s if s is not None else F.lit(None).cast("string")).alias("string_value"),
        (i.cast("long") if i is not None else F.lit(None).cast("long")).alias("int_value"),
        F.lit(None).cast("double").alias("float_value"),
        F.lit(None).cast("double").alias("double_value"),
    )
    p = F.struct(F.lit(key).alias("key"), value.alias("value"))
    return p if cond is None else F.when(cond, p)


def _pick(idx: Column, values: list) -> Column:
    out = None
    for j, v in enumerate(values):
        lit = F.lit(v) if v is not None else F.lit(None).cast("string")
        out = F.when(idx == j, lit) if out is None else out.when(idx == j, lit)
    return out


def _web_names(t: Column, k: Column) -> Column:
    return (F.when((t == "view") & (k < 50), "page_view")
            .when(t == "view", "view_item")
            .when((t == "click") & (k < 50), "add_to_cart")
            .when(t == "click", "view_search_results")
            .when(t == "signup", "begin_checkout")
            .when(t == "purchase", "purchase")
            .when(t == "error", "error"))


def _game_names(t: Column, k: Column) -> Column:
    return (F.when(t == "signup", "level_start")
            .when(t == "purchase", "level_complete")
            .when(t == "error", "level_fail")
            .when((t == "click") & (k < 25), "revive_clear_bar")
            .when((t == "click") & (k < 50), "revive_extra_time")
            .when((t == "click") & (k < 75), "fail_stack_full")
            .when((t == "click") & (k < 90), "level_retry")
            .when(t == "click", "custom_session_start")
            .when((t == "view") & (k < 50), "game_paused")
            .when((t == "view") & (k < 90), "screen_view")
            .when((t == "view") & (k < 95), "first_open")
            .when(t == "view", "app_exception"))


def ga4_events(spark: SparkSession, sf_dir: str, product: str = "game",
               window: tuple[str, str] | None = None, by_day: bool = False) -> DataFrame:
    """Raw export frame (schema ``pathweave.schema.RAW_EVENT``) for ``product``.

    ``window`` = (start, end) as yyyyMMdd restricts the scan; the bound is put on
    the source ``ts`` column so that it reaches the Parquet reader. ``by_day``: see ``raw_frame``.
    """
    prepare(spark)
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    if window is not None:
        lo = F.to_timestamp_ntz(F.lit(window[0]), F.lit("yyyyMMdd"))
        hi = F.to_timestamp_ntz(F.lit(window[1]), F.lit("yyyyMMdd"))
        src = src.where((F.col("ts") >= lo) & (F.col("ts") < F.timestamp_add("DAY", F.lit(1), hi)))
    return raw_frame(src, product, by_day)


def raw_frame(src: DataFrame, product: str = "game", by_day: bool = False) -> DataFrame:
    """Map synthetic rows (event_id, ts, user_id, event_type, value, props) to the export frame.

    ``by_day``: the rows of each partition come in order of their event_date, for a write partitioned by
    it. The narrow source rows are sorted, so that the write needn't sort the export rows, which are many
    times as wide. A row without ts has '' as its day then, which such a write stores as null.
    """
    if product not in ("web", "game"):
        raise ValueError(f"unknown product {product!r}")
    # Stage 1: parse props once and derive the per-row drivers as plain columns.  The
    # one-element ``inline`` is a Generate node, which the optimizer does not collapse
    # into the projection above it, so the JSON is parsed once per row instead of at
    # every reference to ``k``.
    k0 = F.get_json_object("props", "$.k").cast("int")
    n0 = F.datediff(F.to_date("ts"), F.lit(FIRST_DAY).cast("date"))
    names = _web_names if product == "web" else _game_names
    pre = src.select("event_id", "ts", "user_id", "event_type", "value",
                     F.inline(F.array(F.struct(k0.alias("_k"), n0.alias("_n")))))
    pre = pre.select("*", F.inline(F.array(F.struct(
        names(F.col("event_type"), F.col("_k")).alias("_name")))))
    day = F.date_format("ts", "yyyyMMdd")
    if by_day:
        # a day that may be null would be replaced in the write, which then takes its rows for unsorted
        pre = pre.withColumn("_day", F.coalesce(day, F.lit(""))).sortWithinPartitions("_day")
        day = F.col("_day")
    uid, eid, t = F.col("user_id"), F.col("event_id"), F.col("event_type")
    k, n, name = F.col("_k"), F.col("_n"), F.col("_name")
    span = F.lit(5) + uid % 11
    gen = F.floor((n + uid % 7) / span).cast("long")
    gen_start = F.greatest(F.lit(0), gen * span - uid % 7)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    first_touch = F.when(uid % 4 == 0, F.lit(0)).otherwise(
        (F.lit(FIRST_DAY_EPOCH_S) + gen_start * 86400) * 1_000_000).cast("long")

    common = [
        _param("ga_session_id", None, i=F.floor(n / 2)),
        _param("engagement_time_msec", None, i=k * 1000 + 500),
    ]
    if product == "web":
        page = (F.when(k == 0, F.lit(SHOP_URL))
                .when(k % 10 == 5, F.concat(F.lit(SHOP_URL + "/p/"), (k % 20).cast("string"), F.lit("#top")))
                .otherwise(F.concat(F.lit(SHOP_URL + "/p/"), (k % 20).cast("string"), F.lit("?x=1"))))
        params = common + [_param("page_location", k != 1, s=page)]
    else:
        level = (eid % 9 + 1)
        is_start = name == "level_start"
        term = name.isin("level_complete", "level_fail")
        comp = name == "level_complete"
        fail = name == "level_fail"
        snap = term | name.isin("fail_stack_full", "game_paused")
        stack = name == "fail_stack_full"
        revive = name.isin("revive_clear_bar", "revive_extra_time")
        params = common + [
            _param("level_id", is_start & (k % 2 == 0), s=level.cast("string")),
            _param("level_id", is_start & (k % 2 == 1), i=level),
            _param("current_level", is_start, i=level),
            _param("attempt_number", term, i=k % 3 + 1),
            _param("completion_time", comp, i=k),
            _param("stars_gained", comp, i=k % 4),
            _param("fail_time", fail, i=k),
            _param("fail_reason", fail, s=_pick(k % 3, ["stack_full", "time_up", "pause_quit"])),
            _param("items_cleared_perc", snap, i=k),
            _param("objectives_left_perc", snap, i=k),
            _param("time_left_perc", snap, i=k),
            _param("pre_boosters_chief_level", term, i=k % 6),
            _param("boosters_used", term, s=F.concat(F.lit("["), (k % 3).cast("string"), F.lit(",0, "),
                                                     (k % 2).cast("string"), F.lit(",x]"))),
            _param("pre_boosters_manual_used", term, s=F.concat(F.lit("["), (k % 2).cast("string"), F.lit(", "),
                                                                (F.floor(k / 2) % 2).cast("string"), F.lit("]"))),
            _param("end_boosters_used", term, s=F.concat(F.lit("["), (k % 4).cast("string"), F.lit(","),
                                                         (k % 3).cast("string"), F.lit("]"))),
            _param("shop_purhcase", term & (k % 3 == 0), i=k % 2),
            _param("shop_purchase", term & (k % 3 == 1), i=F.floor(k / 3) % 2),
            _param("from_popup", revive, s=_pick(k % 2, ["bar", "time"])),
            _param("stack_item_1", stack, s=F.concat(F.lit("i"), (k % 7).cast("string"))),
            _param("stack_item_2", stack, i=F.lit(0)),
            _param("stack_item_3", stack, s=F.lit("")),
            _param("stack_item_last", stack, i=k % 5),
            _param("retry_streak_number", name == "level_retry", i=k % 5),
            _param("ab_test", name == "custom_session_start", s=_pick(uid % 2, ["A", "B"])),
        ]

    traffic = F.when(uid % 4 == 3, F.lit(None).cast("struct<source:string,medium:string,name:string>")).otherwise(
        F.struct(_pick(uid % 4, ["google", "(direct)", "news"]).alias("source"),
                 _pick(uid % 4, ["organic", "(none)", "email"]).alias("medium"),
                 _pick(uid % 4, ["brand", None, "spring"]).alias("name")))
    return pre.select(
        day.alias("event_date"),
        micros.alias("event_timestamp"),
        name.alias("event_name"),
        F.concat(uid.cast("string"), F.lit("."), gen.cast("string")).alias("user_pseudo_id"),
        first_touch.alias("user_first_touch_timestamp"),
        F.array_compact(F.array(*params)).alias("event_params"),
        F.struct(_pick(eid % 3, ["mobile", "desktop", "tablet"]).alias("category"),
                 _pick(uid % 5, ["android", "iOS", "iPhone OS", "", None]).alias("operating_system"),
                 (uid % 5 + 10).cast("string").alias("operating_system_version")).alias("device"),
        F.struct(F.concat(F.lit("1."), (uid % 3).cast("string"), F.lit(".0")).alias("version"),
                 F.lit(APP_ID).alias("id")).alias("app_info"),
        F.struct(_pick(uid % 5, ["US", "DE", "BR", "IN", None]).alias("country")).alias("geo"),
        traffic.alias("traffic_source"),
        F.struct(F.when(t == "purchase", F.col("value")).alias("purchase_revenue")).alias("ecommerce"),
        eid.alias("event_id"),
    )
