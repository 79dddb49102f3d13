"""Neighbours, clusters, spellings, best segments, breaks and stages on hand-made and random rows."""

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import DAY, DAY0, ev, frame

from pathweave.operators import catalog_channels as CH
from pathweave.operators import catalog_segments as CS
from pathweave.operators import graph
from pathweave.operators import neighbours as NB
from pathweave.operators import web as W

D0 = dt.date(2024, 1, 1)


def people(seed, n):
    rng = random.Random(seed)
    rows = [(f"u{i:03}", rng.choice([0, 1, 2, 50]), rng.gauss(0, 1), None if i % 9 == 0 else rng.randrange(4)) for i in range(n)]
    return rows + [(f"same{i:02}", 7, 0.5, 1) for i in range(40)]  # a third in one place


def brute_neighbours(rows, k):
    x = np.array([[float(v or 0) for v in r[1:]] for r in rows])
    s = x.std(axis=0)
    x = (x - x.mean(axis=0)) / np.where(s == 0, 1, s)
    out = set()
    for i, r in enumerate(rows):
        d = np.floor(np.sqrt(((x - x[i]) ** 2).sum(axis=1)) * 1e6 + 0.5)
        near = sorted((d[j], rows[j][0]) for j in range(len(rows)) if j != i)[:k]
        out |= {(r[0], rank, name, dist / 1e6) for rank, (dist, name) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize(("n", "cell", "most", "block"), [(90, 2048, 65536, 4096), (90, 6, 65536, 5), (90, 2, 7, 3), (1, 6, 9, 9), (0, 6, 9, 9)])
def test_nearest_by_brute_force(spark, n, cell, most, block):
    rows = people(n, n)
    df = spark.createDataFrame(rows, "u string, a int, b double, c int").repartition(3)
    got = NB.nearest(df, "u", ["a", "b", "c"], 4, cell=cell, most_pivots=most, block=block).collect()
    want = brute_neighbours(rows, 4)
    assert {(r.u, r.rank, r.neighbour, round(r.distance, 6)) for r in got} == {(u, k, v, round(d, 6)) for u, k, v, d in want}
    assert len(got) == len(want)


def test_no_member_is_nearer_than_its_cells_least_distance():
    rng = np.random.default_rng(4)
    members, queries = rng.normal(size=(60, 3)), rng.normal(size=(40, 3))
    members[0, 1] = 100.0  # one far member: the cell's radius says nothing of the others, its box does
    pivot, low, high = members[1:2], members.min(axis=0)[None], members.max(axis=0)[None]
    radii = NB._distances(members, pivot).max(axis=0)
    queries[:20, 0] += 20.0
    least = NB.least_distances(queries, NB._distances(queries, pivot), radii, low, high)[:, 0]
    nearest = NB._distances(queries, members).min(axis=1)
    assert (least <= nearest).all() and (least[:20] > 10).all()


def test_nearest_of_few(spark):
    schema = "u string, a int"
    assert NB.nearest(spark.createDataFrame([], schema), "u", ["a"], 3).count() == 0
    assert NB.nearest(spark.createDataFrame([("x", 1)], schema), "u", ["a"], 3).count() == 0
    two = NB.nearest(spark.createDataFrame([("x", 1), ("y", None)], schema), "u", ["a"], 3).collect()
    assert [(r.u, r.neighbour) for r in sorted(two)] == [("x", "y"), ("y", "x")]


def test_clusters_find_planted_groups(spark):
    rng = random.Random(3)
    centres = [(0, 0), (40, 0), (0, 40), (40, 40)]
    rows = [(f"{g}-{i}", a + rng.gauss(0, 1), b + rng.gauss(0, 1)) for g, (a, b) in enumerate(centres) for i in range(30)]
    got = NB.clusters(spark.createDataFrame(rows, "u string, a double, b double"), "u", ["a", "b"], 4).collect()
    of = defaultdict(set)
    for r in got:
        of[r.u[0]].add(r.cluster)
    assert all(len(c) == 1 for c in of.values()) and len(set.union(*of.values())) == 4
    same = spark.createDataFrame([("x", 1.0, 1.0), ("y", 1.0, 1.0)], "u string, a double, b double")
    assert {r.cluster for r in NB.clusters(same, "u", ["a", "b"], 4).collect()} == {0}
    assert NB.clusters(same.limit(0), "u", ["a", "b"], 4).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_spellings_by_all_pairs(spark):
    rng = random.Random(5)
    base = ["facebook", "newsletter", "google", "bing", "ad", "partner_x", "(direct)", "", "e-mail"]
    names = set(base)
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.randrange(2)] = rng.choice(["", "x", "E", "_", "-", " "])
        names.add("".join(w))
    rows = [(n, rng.randrange(1, 9)) for n in sorted(names)] + [(None, 5), ("google", 4)]
    norm = {n: n.lower().translate(str.maketrans("", "", " \t\n_.-")) for n in names}
    allowed = lambda s: 0 if len(s) < 4 else 1 if len(s) < 8 else 2
    group = {v: v for v in norm.values()}
    for _ in group:
        for a in group:
            for b in group:
                if group[b] < group[a] and edits(a, b) <= min(allowed(a), allowed(b)):
                    group[a] = group[b]
    got = CH.spellings(spark.createDataFrame(rows, "value string, n int"), "value", "n").collect()
    assert {(r.value, r.cluster) for r in got} == {(n, group[v]) for n, v in norm.items()}
    totals = defaultdict(int)
    for n, k in rows:
        if n is not None:
            totals[group[norm[n]]] += k
    assert all(r.cluster_n == totals[r.cluster] for r in got)
    audit = {r.cluster: r for r in CH.spelling_audit(spark.createDataFrame(rows, "value string, n int"), "value", "n").collect()}
    assert all(len(r["values"]) == r.spellings > 1 and r.total == totals[c] and 0 <= r.consolidated_share < 1 for c, r in audit.items())


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {(r.id, r.component) for r in graph.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}


def sessions(spark, rows):
    """Sessions from (day, converted, {column: value})."""
    cols = ["source", "medium", "campaign", "device_category", "country", "landing_page", "event_count", "had_search"]
    full = [(f"s{i}", f"u{i}", D0 + dt.timedelta(days=d), dt.datetime(2024, 1, 1, 9) + dt.timedelta(days=d), bool(hit), 1.0 if hit else 0.0,
             *[more.get(c, {"event_count": 2, "had_search": False}.get(c)) for c in cols]) for i, (d, hit, more) in enumerate(rows)]
    return spark.createDataFrame(full, "session_id string, user_pseudo_id string, session_date date, session_start_ts timestamp, "
                                 "converted_this_session boolean, revenue double, source string, medium string, campaign string, "
                                 "device_category string, country string, landing_page string, event_count long, had_search boolean")


def test_a_planted_break_is_found(spark):
    rng = random.Random(8)
    rows = [(d, rng.random() < (0.6 if d < 14 else 0.1), {"source": "partner_x", "device_category": "mobile"}) for d in range(28) for _ in range(20)]
    rows += [(d, rng.random() < 0.3, {"source": "stable", "device_category": "desktop"}) for d in range(28) for _ in range(20)]
    got = {(r.dimension, r.value, r.metric): r for r in CH.rate_breaks(sessions(spark, rows)).collect()}
    hit = got["source", "partner_x", "conversion"]
    assert abs((hit.break_day - D0).days - 14) <= 1 and hit.score > 1.36 and hit.rate_before > 0.45 > 0.2 > hit.rate_after
    assert got["source", "stable", "conversion"].score < hit.score / 2
    assert got["source", "stable", "bounce"].score is None  # no session bounces: nothing can break


def test_seasonality_of_a_known_week(spark):
    weekly = [30, 10, 10, 10, 10, 10, 18]
    rows = [(d, False, {}) for d in range(35) for _ in range(weekly[d % 7] + (40 if d == 17 else 0))]
    got = [r for r in CH.weekly_seasonality(sessions(spark, rows)).collect() if r.metric == "sessions"]
    assert len(got) == 35 and [r.day for r in got if r.anomaly] == [D0 + dt.timedelta(days=17)]
    assert sum(r.trend is None for r in got) == 6
    factors = {r.weekday: r.factor for r in got}
    assert max(factors, key=factors.get) == 2 and math.isclose(sum(factors.values()), 7)  # the first of January 2024 was a Monday


def test_halo_finds_the_lag(spark):
    launch = [5, 0, 0, 9, 0, 3, 0, 0, 7, 0, 1, 0, 6, 0, 0, 2, 0, 0, 4, 0]
    rows = [(d, False, {"source": "google", "medium": "cpc", "campaign": "spring"}) for d, n in enumerate(launch) for _ in range(n)]
    rows += [(d + 2, False, {"source": "(direct)", "medium": "(none)"}) for d, n in enumerate(launch) for _ in range(3 * n + 1)]
    best = CH.direct_halo(sessions(spark, rows)).where("best").collect()
    assert [(r.campaign, r.lag, r.correlation > 0.9) for r in best] == [("spring", 2, True)]


def test_channel_kinds_and_dark_direct(spark):
    kinds = [("google", "cpc", "paid"), ("google", "organic", "organic"), (None, None, "direct"), ("(direct)", "(none)", "direct"),
             ("news", "email", "other"), ("x", "Paid_Social", "paid"), ("x", " Display ", "paid"), ("road", "broadcast", "other")]
    df = spark.createDataFrame(kinds, "s string, m string, want string")
    assert df.where(CH.channel_kind(F.col("s"), F.col("m")) != F.col("want")).collect() == []
    urls = [("https://a.com", 0), ("https://a.com/", 0), ("https://a.com/p", 1), ("https://a.com/p/q/?x=/y", 2), (None, 0), ("ftp://x/y", 0)]
    assert spark.createDataFrame(urls, "u string, n int").where(CH.path_depth(F.col("u")) != F.col("n")).collect() == []
    rows = [(0, True, {"landing_page": "https://a.com/p/q"}), (0, False, {"landing_page": "https://a.com/p/q", "had_search": True}), (0, False, {"landing_page": "https://a.com/"})]
    got = {r.landing_depth: (r.sessions, r.suspect_sessions, r.suspect_conversions) for r in CH.dark_direct(sessions(spark, rows)).collect()}
    assert got == {2: (2, 1, 1), 0: (1, 0, 0)}


def test_best_segments_prune_and_still_find_all(spark):
    rng = random.Random(2)
    values = {"device_category": ["mobile", "desktop", "tablet"], "country": list("ABCDEF"), "source": ["x", "y", None], "medium": list("klmnop")}
    rows = []
    for _ in range(900):
        more = {c: rng.choice(v) for c, v in values.items()}
        good = more["device_category"] == "mobile" and more["country"] == "A"
        rows.append((0, rng.random() < (0.8 if good else 0.05), more))
    s = sessions(spark, rows).cache()
    dims = {c: F.col(c) for c in values}
    counted, every = {}, {}
    got = [(r.segment, r.sessions, r.quality) for r in CS.best_segments(s, dims, 5, 3, counted).sort("rank").collect()]
    whole = [(r.segment, r.sessions, r.quality) for r in CS.best_segments(s, dims, 10_000, 3, every).sort("rank").collect()]
    assert got == whole[:5] and "device_category=mobile&country=A" in [g[0] for g in got][:2]
    assert sum(counted.values()) < sum(every.values()) / 2
    assert CS.best_segments(s.limit(0), dims, 5, 3).count() == 0


def test_stages_go_forward_only(spark):
    names = ["purchase", "view_item", "view_item", "add_to_cart", "begin_checkout", "add_to_cart", "purchase"]
    rows = [ev("u", DAY0 + i * DAY, n, {"ga_session_id": i}, eid=i) for i, n in enumerate(names)]
    rows += [ev("v", DAY0, "add_to_cart", {"ga_session_id": 1}, eid=50), ev("w", DAY0, "view_item", {"ga_session_id": 1}, eid=60),
             ev("w", DAY0 + 9 * DAY, "add_to_cart", {"ga_session_id": 2}, eid=61)]
    events = W.web_session_events(frame(spark, rows))
    t = {r.user_pseudo_id: [x.event_id if x else None for x in (r.t0, r.t1, r.t2, r.t3, r.t4)] for r in CS.stage_times(events).collect()}
    assert t == {"u": [0, 1, 3, 4, 6], "v": [50, None, None, None, None], "w": [60, 60, 61, None, None]}
    got = {r.from_stage: r for r in CS.stage_transitions(events).collect()}
    assert (got["visiting"].entered, got["visiting"].went_on, got["evaluating"].slow, got["evaluating"].went_on) == (3, 2, 1, 2)
    assert got["evaluating"].median_days == 2.0 and got["evaluating"].buy_rate_slow == 0.0 and got["deciding"].buy_rate_quick == 1.0


def test_frequent_sets_by_brute_force(spark):
    rng = random.Random(4)
    baskets = {b: {rng.choice("abcdefg") for _ in range(rng.randrange(1, 6))} for b in range(60)}
    rows = [(b, i) for b, items in baskets.items() for i in items for _ in range(rng.randrange(1, 3))] + [(61, None)]
    df = spark.createDataFrame(rows, "b int, i string")
    want = {}
    for size in (2, 3):
        from itertools import combinations
        for c in combinations("abcdefg", size):
            n = sum(set(c) <= items for items in baskets.values())
            if n >= 5:
                want[c] = n
    got = CS.frequent_sets(df, ["b"], "i", 5).collect()
    assert {tuple(r["items"]): r.baskets for r in got} == want
    alone = {i: sum(i in items for items in baskets.values()) for i in "abcdefg"}
    for r in got:
        assert math.isclose(r.lift, r.baskets / 60 / math.prod(alone[i] / 60 for i in r["items"]))
    assert CS.frequent_sets(df, ["b"], "i", 61).count() == 0


def test_sketches_of_days_merge(spark):
    rows = [ev(f"u{u}", DAY0 + d * DAY, "page_view", {"ga_session_id": d}, eid=d * 1000 + u) for d in range(14) for u in range(0, 300, 1 + d % 3)]
    got = CS.cardinality_trend(W.web_session_events(frame(spark, rows))).collect()
    assert [(r.users, r.estimate_holds) for r in sorted(got)] == [(300, True)] * len(got)


def test_frequent_sets_reads_its_baskets_once(spark):
    """Repeated lines of a basket count once; the rows of the input are made once, however many passes follow."""
    lines = [(b, i) for b in range(30) for i in "abc"[: 1 + b % 3]] * 2 + [(99, None), (None, "a"), (None, "b")]
    read = spark.sparkContext.accumulator(0)

    def count(row):
        read.add(1)
        return row

    df = spark.createDataFrame(spark.sparkContext.parallelize(lines, 2).map(count), "basket int, item string")
    got = {(tuple(r["items"]), r["size"], r["baskets"]) for r in CS.frequent_sets(df, ["basket"], "item", 10).collect()}
    assert got == {(("a", "b"), 2, 21), (("a", "c"), 2, 10), (("b", "c"), 2, 10), (("a", "b", "c"), 3, 10)}
    assert read.value == len(lines)


def test_basket_pairs_deals_orders_out_by_their_lines(spark, monkeypatch):
    from collections import Counter
    from itertools import combinations
    from pathweave.operators import catalog_commerce as CM
    monkeypatch.setattr(CM, "PAIR_ROWS", 20)
    lines = [(o, (o * k) % 7) for o in range(30) for k in range(1, 5)] + [(0, 3), (0, 3), (None, 1), (5, None)]
    df = spark.createDataFrame(lines, "l_orderkey long, l_partkey long")
    out = CM.basket_pairs(df, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and f", {1 + len(lines) // 20}), REPARTITION_BY_NUM" in plan
    baskets = {}
    for o, p in lines:
        if o is not None and p is not None:
            baskets.setdefault(o, set()).add(p)
    pairs = Counter(pair for b in baskets.values() for pair in combinations(sorted(b), 2))
    assert {(r["part_a"], r["part_b"]): r["orders"] for r in out.collect()} == {k: n for k, n in pairs.items() if n >= 2}
