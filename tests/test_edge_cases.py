"""Hand-made edge rows (ties, nulls, missing or duplicate params, odd level ids,
booster strings, rounding, URLs, modes, retention days, filters)."""

import random
from datetime import date

import pytest
from pyspark.sql import Window, functions as F

from pathweave.config import JobParams, resolve_cutoffs
from pathweave.functions import aggs as A
from pathweave.functions import scalars as S
from pathweave.functions.params import event_param, event_param_alias, event_param_any
from pathweave.operators import game as G
from pathweave.operators import web as Wb
from pathweave.operators.asof import carry_forward
from pathweave.operators.catalog_commerce import search_terms
from pathweave.operators.slice import filtered_slice, optional_in_filter
from rows import DAY0, ev, frame

P = JobParams()


def test_resolve_cutoffs_clamps():
    assert resolve_cutoffs(90) == (7, 30)
    assert resolve_cutoffs(30) == (7, 29)
    assert resolve_cutoffs(8) == (2, 7)
    assert resolve_cutoffs(2) == (1, 1)   # new is not below churn on tiny windows (literal)
    assert resolve_cutoffs(1) == (1, 1)


def test_event_param_first_match_any_and_alias(spark):
    df = frame(spark, [
        ev("u", DAY0, "level_start", [("level_id", "3"), ("level_id", "9"), ("ga_session_id", 1)], eid=1),
        ev("u", DAY0 + 1, "level_start", [("level_id", 7), ("shop_purchase", 1)], eid=2),
        ev("u", DAY0 + 2, "level_start", [("shop_purhcase", 0), ("shop_purchase", 1)], eid=3),
        ev("u", DAY0 + 3, "level_start", None, eid=4),
    ])
    got = {r["event_id"]: r for r in df.select(
        "event_id", event_param_any("level_id").alias("lv"), event_param("ga_session_id").alias("s"),
        event_param_alias(("shop_purhcase", "shop_purchase")).alias("shop")).collect()}
    assert (got[1]["lv"], got[1]["s"]) == ("3", 1)          # first match wins
    assert got[2]["lv"] == "7" and got[2]["shop"] == 1       # int level id; right spelling only
    assert got[3]["shop"] == 0                                # misspelled key read first
    assert got[4]["lv"] is None and got[4]["s"] is None


def test_int_list_and_leading_int(spark):
    df = spark.createDataFrame([("",), ("[]",), ("[1,0]",), ("[1, x, 2]",), (None,)], "s string")
    arr = S.parse_int_list("s")
    got = [tuple(r) for r in df.select(*[S.int_at(arr, i) for i in range(3)]).collect()]
    assert got == [(None, None, None), (None, None, None), (1, 0, None), (1, None, 2), (None, None, None)]
    lv = spark.createDataFrame([("12a",), ("bonus",), ("7",), (None,)], "l string")
    assert [r[0] for r in lv.select(S.leading_int("l")).collect()] == [12, None, 7, None]


def test_url_path_and_platform(spark):
    df = spark.createDataFrame([("https://a.com",), ("https://a.com/p/1?x=1",), ("http://a.com/x#f",), (None,)],
                               "u string")
    assert [r[0] for r in df.select(S.url_path("u")).collect()] == ["https://a.com", "/p/1", "/x", ""]
    os_ = spark.createDataFrame([("android",), ("ANDROID",), ("iOS",), ("iPhone OS",), ("",), (None,), ("Win",)],
                                "o string")
    assert [r[0] for r in os_.select(S.normalize_platform("o")).collect()] == [
        "Android", "Android", "iOS", "iOS", None, None, "Win"]


def test_engagement_cap_and_half_rounding(spark):
    rows = [ev("a", DAY0, "screen_view", {"ga_session_id": 1, "engagement_time_msec": 1500}, eid=1),
            ev("b", DAY0, "screen_view", {"ga_session_id": 1, "engagement_time_msec": 2500}, eid=2),
            ev("c", DAY0, "screen_view", {"ga_session_id": 1, "engagement_time_msec": 9_000_000}, eid=3),
            ev("c", DAY0 + 1, "screen_view", {"ga_session_id": 1}, eid=4)]
    got = dict(G.game_sessions(frame(spark, rows), P).select("user_pseudo_id", "engagement_time_s").collect())
    assert got == {"a": 2, "b": 3, "c": 7200}   # half away from zero, per-event 2h cap


def test_session_ties_first_row_and_sequence_cap(spark):
    rows = [ev("u", DAY0, "page_view", {"ga_session_id": 5, "page_location": "https://s.com/a"}, eid=2,
               device="desktop"),
            ev("u", DAY0, "view_item", {"ga_session_id": 5, "page_location": "https://s.com/b"}, eid=1,
               device="tablet")]
    rows += [ev("u", DAY0 + i * 1000, "add_to_cart", {"ga_session_id": 5}, eid=10 + i) for i in range(1, 6)]
    s = Wb.web_sessions(frame(spark, rows), JobParams(web_sequence_cap=4)).collect()[0]
    assert s["device_category"] == "tablet" and s["landing_page"] == "https://s.com/b"
    assert s["event_sequence"] == ["view_item", "page_view", "add_to_cart", "add_to_cart"]
    assert s["event_count"] == 7
    assert s["page_sequence"] == ["/b", "/a", "", ""]


def test_attempt_stitching_rules(spark):
    sid = {"ga_session_id": 1}
    rows = [
        ev("u", DAY0 + 0, "game_paused", {**sid, "items_cleared_perc": 5}, eid=1),          # before any start
        ev("u", DAY0 + 10, "level_start", {**sid, "level_id": "1", "current_level": 1}, eid=2),
        ev("u", DAY0 + 20, "level_fail", {**sid, "fail_reason": "stack_full", "fail_time": 30,
                                          "boosters_used": "[1, x, 2]"}, eid=3),
        ev("u", DAY0 + 30, "level_retry", {**sid, "retry_streak_number": 2}, eid=4),
        ev("u", DAY0 + 40, "level_start", {**sid, "level_id": 1}, eid=5),
        ev("u", DAY0 + 50, "level_complete", {**sid, "completion_time": 40, "stars_gained": 3}, eid=6),
        ev("u", DAY0 + 50, "level_fail", {**sid, "fail_reason": "time_up"}, eid=7),
        ev("u", DAY0 + 60, "level_start", sid, eid=8),                                       # null level id
        ev("u", DAY0 + 70, "revive_clear_bar", {**sid, "from_popup": "bar"}, eid=9),
        ev("v", DAY0, "level_start", {"ga_session_id": 2}, eid=10),                          # no level ever
    ]
    raw = frame(spark, rows)
    a = G.level_attempts(raw, G.user_first_open(raw), JobParams(attempt_bucket_us=25)).orderBy(
        "attempt_start_ts").collect()
    assert [r["user_pseudo_id"] for r in a] == ["u", "u", "u"]
    assert [r["outcome"] for r in a] == ["fail", "complete", "abandoned"]
    assert [r["level_id"] for r in a] == ["1", "1", "1"]                  # start 3 inherits level 1
    assert [r["retry_streak_number"] for r in a] == [None, 2, 2]
    assert [r["is_first_attempt_ever"] for r in a] == [True, False, False]
    assert a[0]["boosters_vacuum"] == 1 and a[0]["boosters_spring"] is None and a[0]["boosters_fan"] == 2
    assert a[1]["duration_s"] == 40 and a[1]["stars_gained"] == 3
    assert a[2]["revive_count"] == 1 and a[2]["revive_from_popup_mode"] == "bar"
    assert len({r["attempt_id"] for r in a}) == 3


def test_carry_forward_equals_single_window(spark):
    rnd = random.Random(7)
    rows = [(f"k{rnd.randrange(12)}", rnd.randrange(0, 10_000), i,
             rnd.choice([None, None, None, rnd.randrange(100)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, ts long, id long, v long")
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r["id"]: r["c"] for r in df.select("id", F.last("v", True).over(w).alias("c")).collect()}
    for bucket in (7, 100, 1_000_000):
        got = {r["id"]: r["c"] for r in carry_forward(df, ["k"], "ts", ["id"], {"c": F.col("v")}, bucket).collect()}
        assert got == want


def test_modes_null_majority_and_ties(spark):
    df = spark.createDataFrame([("u1", None), ("u1", None), ("u1", "a"), ("u2", "b"), ("u2", "a"),
                                ("u3", None), ("u3", "a"), ("u4", None)], "u string, d string")
    got = dict(A.modes(df, ["u"], {"m": F.col("d")}).collect())
    assert got == {"u1": None, "u2": "a", "u3": None, "u4": None}
    got = dict(A.modes(df, ["u"], {"m": F.col("d")}, ignore_nulls=("m",)).collect())
    assert got == {"u1": "a", "u2": "a", "u3": "a"}      # all-null key has no row (callers left-join)


def test_retention_days_and_eligibility(spark):
    end = date(2024, 3, 31)
    rows = [("d1", date(2024, 3, 1), date(2024, 3, 2)), ("d7", date(2024, 3, 1), date(2024, 3, 8)),
            ("d8", date(2024, 3, 1), date(2024, 3, 9)), ("d30", date(2024, 3, 1), date(2024, 3, 31)),
            ("one", date(2024, 3, 1), None), ("last", date(2024, 3, 31), None)]
    df = spark.createDataFrame(rows, "u string, f date, s date")
    cols = []
    for n in (1, 7, 30):
        r, e = G.retention_flags(F.col("f"), F.col("s"), end, n)
        cols += [r.alias(f"r{n}"), e.alias(f"e{n}")]
    got = {x["u"]: (x["r1"], x["r7"], x["r30"]) for x in df.select("u", *cols).collect()}
    assert got["d1"] == (True, True, True)
    assert got["d7"] == (False, True, True)
    assert got["d8"] == (False, False, True)
    assert got["d30"] == (False, False, True)
    assert got["one"] == (False, False, False)
    assert got["last"] == (None, None, None)      # first seen on the last day: not eligible


def test_web_user_group_cascade(spark):
    end = date(2024, 1, 30)
    rows = [("new", date(2024, 1, 29), date(2024, 1, 29), 0), ("ab", date(2024, 1, 1), date(2024, 1, 25), 2),
            ("cb", date(2024, 1, 1), date(2024, 1, 5), 1), ("anb", date(2024, 1, 1), date(2024, 1, 25), 0),
            ("cnb", date(2024, 1, 1), date(2024, 1, 5), 0)]
    df = spark.createDataFrame(rows, "u string, f date, l date, p long")
    g = Wb.web_user_group(F.col("f"), F.col("l"), F.col("p"), end, 3, 10)
    got = dict(df.select("u", g).collect())
    assert got == {"new": "new", "ab": "active_buyer", "cb": "churned_buyer", "anb": "active_non_buyer",
                   "cnb": "churned_non_buyer"}


def test_optional_in_filter_and_slice_needs_filter(spark):
    df = spark.createDataFrame([("US", "1.0"), ("DE", None)], "country string, app_version string")
    assert df.where(optional_in_filter({"country": [], "app_version": None})).count() == 2
    assert df.where(optional_in_filter({"country": [""]})).count() == 2
    assert df.where(optional_in_filter({"country": ["DE"], "app_version": []})).count() == 1
    with pytest.raises(ValueError):
        filtered_slice(df, df, df, date(2024, 1, 1), [], [""])


def test_search_terms_on_hand_rows(spark):
    df = spark.createDataFrame([(" Shoes", 0), ("shoes", 3), ("hat", 0), (None, 1)], "search_term string, results int")
    got = {r["term"]: (r["searches"], r["zero_result"], round(r["cum_share"], 3)) for r in search_terms(df).collect()}
    assert got == {"shoes": (2, 1, 0.667), "hat": (1, 1, 1.0)}


def test_bucketed_lag_lead_rownumber_equal_windows(spark):
    from pathweave.operators.asof import next_value, previous_value, running_row_number, running_sum
    rnd = random.Random(11)
    rows = [(f"k{rnd.randrange(9)}", rnd.randrange(0, 5_000), i, rnd.randrange(1000)) for i in range(2500)]
    df = spark.createDataFrame(rows, "k string, ts long, id long, v long")
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = {r["id"]: (r["p"], r["n"], r["rn"]) for r in df.select(
        "id", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"),
        F.row_number().over(w).alias("rn")).collect()}
    running = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    glob = Window.orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want_sum = {r["id"]: r["s"] for r in df.select("id", F.sum("v").over(running).alias("s")).collect()}
    want_global = {r["id"]: r["s"] for r in df.select("id", F.sum("v").over(glob).alias("s")).collect()}
    for bucket in (13, 400, 10_000_000):
        p = {r["id"]: r["p"] for r in previous_value(df, ["k"], "ts", ["id"], {"p": F.col("v")}, bucket).collect()}
        n = {r["id"]: r["n"] for r in next_value(df, ["k"], "ts", ["id"], {"n": F.col("v")}, bucket).collect()}
        rn = {r["id"]: r["rn"] for r in running_row_number(df, ["k"], "ts", ["id"], bucket, "rn").collect()}
        assert {i: (p[i], n[i], rn[i]) for i in want} == want
        cs = {r["id"]: r["cs"] for r in running_sum(df, ["k"], "ts", ["id"], "v", bucket, "cs").collect()}
        gs = {r["id"]: r["gs"] for r in running_sum(df, [], "ts", ["id"], "v", bucket, "gs").collect()}
        assert cs == want_sum and gs == want_global
