"""DuckDB oracle SQL for the analyses of channels, segments, neighbours and data quality.

Where the Spark side goes by windows, passes or pruned candidates, this side joins each day, user or
value with all others, or steps through ordered events by recursion.
"""

from pathweave.oracle.catalog import EVW, WJ, WS, r6, rate
from pathweave.oracle.prefix import ev_cte
from pathweave.oracle.web import URL_RE, day_part_sql

FEATURES = ["total_sessions", "total_events", "total_pageviews", "total_purchases", "total_revenue", "days_active_span"]
SRC = "coalesce(lower(trim(source)), '(none)')"
KIND = """CASE WHEN regexp_matches(lower(trim(coalesce(medium, ''))), '^(.*cp.*|ppc|retargeting|paid.*|display|banner|affiliate|ads?)$') THEN 'paid'
  WHEN lower(trim(coalesce(medium, ''))) = 'organic' THEN 'organic'
  WHEN lower(trim(coalesce(source, ''))) IN ('', '(direct)', 'direct', '(none)') THEN 'direct' ELSE 'other' END"""
WK = f"{WS}, wk AS (SELECT *, {KIND} AS kind, {SRC} AS src FROM ws)"
SPINE = "spine AS (SELECT CAST(unnest(generate_series(min(session_date), max(session_date), INTERVAL 1 DAY)) AS DATE) AS day FROM ws)"
BUYS = "count(*) FILTER (WHERE converted_this_session)"


def category(url: str) -> str:
    parts = f"list_filter(string_split(regexp_extract({url}, {URL_RE}, 1), '/'), lambda x: x <> '')[1:2]"
    return f"CASE WHEN {url} IS NULL THEN NULL WHEN len({parts}) = 0 THEN 'home' ELSE array_to_string({parts}, '/') END"


# --------------------------------------------------------------------------- feature space
Z = ", ".join(f"CASE WHEN stddev_pop(v{i}) OVER () = 0 THEN 0 ELSE (v{i} - avg(v{i}) OVER ()) / stddev_pop(v{i}) OVER () END AS z{i}"
              for i in range(len(FEATURES)))
VECTORS = f"""{WJ},
v AS (SELECT user_pseudo_id AS u, {', '.join(f'coalesce(CAST({f} AS DOUBLE), 0) AS v{i}' for i, f in enumerate(FEATURES))} FROM wj),
z AS (SELECT u, {Z} FROM v)"""


def square(a: str, b: str) -> str:
    return " + ".join(f"({a}.z{i} - {b}.z{i}) * ({a}.z{i} - {b}.z{i})" for i in range(len(FEATURES)))


def clusters(k: int = 4, rounds: int = 8) -> str:
    """CTEs up to ``assigned`` (u, cluster): far-apart centres one by one, then Lloyd's rounds written out."""
    dims = ", ".join(f"z{i}" for i in range(len(FEATURES)))
    zero = "(SELECT " + ", ".join(f"0.0 AS z{i}" for i in range(len(FEATURES))) + ")"
    ctes = [f"c0 AS (SELECT 0 AS i, {dims} FROM (SELECT z.*, floor(({square('z', 'o')}) * 1e6 + 0.5) AS d FROM z, {zero} o) ORDER BY d DESC, u LIMIT 1)"]
    for i in range(1, k):
        known = " UNION ALL ".join(f"FROM c{j}" for j in range(i))
        ctes.append(f"c{i} AS (SELECT {i} AS i, {dims} FROM (SELECT z.u, {', '.join(f'z.z{j}' for j in range(len(FEATURES)))}, "
                    f"floor(min({square('z', 'c')}) * 1e6 + 0.5) AS d FROM z, ({known}) c GROUP BY ALL) ORDER BY d DESC, u LIMIT 1)")
    ctes.append("m0 AS (" + " UNION ALL ".join(f"FROM c{j}" for j in range(k)) + ")")
    assign = lambda m: f"SELECT z.u, arg_min(c.i, {{'d': floor(({square('z', 'c')}) * 1e6 + 0.5), 'i': c.i}}) AS i FROM z, {m} c GROUP BY z.u"
    for r in range(rounds):
        means = ", ".join(f"coalesce(avg(z.z{j}), any_value(c.z{j})) AS z{j}" for j in range(len(FEATURES)))
        ctes.append(f"a{r} AS MATERIALIZED ({assign(f'm{r}')})")
        ctes.append(f"m{r + 1} AS MATERIALIZED (SELECT c.i, {means} FROM m{r} c LEFT JOIN a{r} a USING (i) LEFT JOIN z USING (u) GROUP BY c.i)")
    return f"{VECTORS},\n" + ",\n".join(ctes) + f",\nassigned AS (SELECT u, CAST(i AS BIGINT) AS cluster FROM ({assign(f'm{rounds}')}))"


# --------------------------------------------------------------------------- spellings
def same_name(counts: str) -> str:
    """CTEs up to ``named`` (value, n, cluster) from a relation (value, n): every pair of values by edit distance."""
    return f"""s AS (SELECT value, CAST(sum(n) AS BIGINT) AS n, regexp_replace(lower(value), '[\\s_.\\-]+', '', 'g') AS norm FROM {counts} WHERE value IS NOT NULL GROUP BY value),
m AS (SELECT DISTINCT norm, CASE WHEN length(norm) < 4 THEN 0 WHEN length(norm) < 8 THEN 1 ELSE 2 END AS edits FROM s),
near AS (SELECT a.norm AS a, b.norm AS b FROM m a, m b WHERE levenshtein(a.norm, b.norm) <= least(a.edits, b.edits)),
reach AS (SELECT a, b FROM near UNION SELECT r.a, e.b FROM reach r JOIN near e ON r.b = e.a),
named AS (SELECT s.*, c.cluster FROM s JOIN (SELECT a AS norm, min(b) AS cluster FROM reach GROUP BY a) c USING (norm))"""


SPELLED = """c AS (SELECT cluster, CAST(sum(n) AS BIGINT) AS cluster_n, count(*) AS spellings, arg_min(value, {'n': -n, 'v': value}) AS canonical FROM named GROUP BY cluster)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


# --------------------------------------------------------------------------- stages
STAGES = ["visiting", "evaluating", "intending", "deciding", "buying"]
ENTER = ["", "view_item", "add_to_cart", "begin_checkout", "purchase"]


def stages() -> str:
    """An automaton that reads a user's events one by one."""
    waits = "[" + ", ".join(f"'{e}'" for e in ENTER[1:]) + "]"
    pairs = " UNION ALL ".join(
        f"SELECT {i} AS i, '{STAGES[i]}' AS from_stage, '{STAGES[i + 1]}' AS to_stage, entries[{i + 2}] - entries[{i + 1}] AS us, len(entries) = {len(STAGES)} AS buys "
        f"FROM final WHERE len(entries) > {i}" for i in range(len(STAGES) - 1))
    slow = "us > 7 * 86400000000"
    return recursive(f"""{EVW},
o AS (SELECT user_pseudo_id AS u, event_name, event_timestamp AS ts, row_number() OVER (PARTITION BY user_pseudo_id ORDER BY event_timestamp, event_id) AS n FROM wev),
walk AS (
  SELECT u, n, CASE WHEN event_name = 'view_item' THEN [ts, ts] ELSE [ts] END AS entries FROM o WHERE n = 1
  UNION ALL
  SELECT w.u, o.n, CASE WHEN o.event_name = {waits}[len(w.entries)] THEN list_append(w.entries, o.ts) ELSE w.entries END FROM walk w JOIN o ON o.u = w.u AND o.n = w.n + 1),
final AS (SELECT u, arg_max(entries, n) AS entries FROM walk GROUP BY u),
x AS ({pairs})
SELECT from_stage, to_stage, count(*) AS entered, count(us) AS went_on, {rate('count(us)', 'count(*)')} AS transition_rate,
  round(quantile_disc(us, 0.5) / 86400000000.0, 6) AS median_days, count(*) FILTER (WHERE {slow}) AS slow,
  {rate(f'count(*) FILTER (WHERE NOT {slow} AND buys)', f'count(*) FILTER (WHERE NOT {slow})')} AS buy_rate_quick,
  {rate(f'count(*) FILTER (WHERE {slow} AND buys)', f'count(*) FILTER (WHERE {slow})')} AS buy_rate_slow
FROM x GROUP BY i, from_stage, to_stage""")


# --------------------------------------------------------------------------- sets and segments
def item_sets(baskets: str, least: int) -> str:
    """Pairs and triples of a relation (basket, item) by joining baskets with themselves."""
    return f"""b AS (SELECT DISTINCT basket, CAST(item AS VARCHAR) AS item FROM {baskets} WHERE item IS NOT NULL),
n AS (SELECT count(DISTINCT basket) AS n FROM b),
p AS (SELECT item, count(*) AS n FROM b GROUP BY item),
pairs AS (SELECT [a.item, c.item] AS l, count(*) AS baskets FROM b a JOIN b c ON a.basket = c.basket AND a.item < c.item GROUP BY ALL),
triples AS (SELECT [a.item, c.item, d.item] AS l, count(*) AS baskets FROM b a JOIN b c ON a.basket = c.basket AND a.item < c.item
  JOIN b d ON a.basket = d.basket AND c.item < d.item GROUP BY ALL),
f AS (SELECT * FROM (FROM pairs UNION ALL FROM triples) WHERE baskets >= {least})
SELECT array_to_string(l, '>') AS items, CAST(len(l) AS BIGINT) AS size, baskets,
  round(baskets / (SELECT n::DOUBLE FROM n) / (SELECT product(p.n / (SELECT n.n::DOUBLE FROM n)) FROM p WHERE list_contains(l, p.item)), 6) AS lift FROM f"""


def whole_cube(k: int = 10, least: int = 5) -> str:
    dims = {"device": "device_category", "part": day_part_sql("session_start_ts"), "country": "country", "source": "source", "page": category("landing_page")}
    values = ", ".join(f"coalesce(CAST({e} AS VARCHAR), '(none)') AS {d}" for d, e in dims.items())
    label = " , ".join(f"CASE WHEN grouping({d}) = 0 THEN '{d}=' || {d} END" for d in dims)
    size = " + ".join(f"(1 - grouping({d}))" for d in dims)
    return f"""{WS},
x AS (SELECT {values}, CASE WHEN converted_this_session THEN 1 ELSE 0 END AS hit FROM ws),
t AS (SELECT count(*) AS n, sum(hit) / count(*)::DOUBLE AS rate FROM x),
g AS (SELECT concat_ws('&', {label}) AS segment, CAST({size} AS BIGINT) AS size, count(*) AS sessions, CAST(sum(hit) AS BIGINT) AS conversions
  FROM x GROUP BY CUBE ({', '.join(dims)})),
q AS (SELECT g.*, round((conversions - sessions * rate) / n, 9) AS quality FROM g, t WHERE size > 0 AND sessions >= {least})
SELECT segment, size, sessions, conversions, {rate('conversions', 'sessions')} AS conversion_rate, round(quality, 6) AS quality,
  row_number() OVER (ORDER BY quality DESC, size, replace(segment, '&', chr(30))) AS rank FROM q
QUALIFY rank <= {k}"""


def breaks(dims: tuple[str, ...] = ("source", "device_category", "country"), least: int = 20) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, coalesce({d}, '(none)') AS value, '{m}' AS metric, session_date AS day, CASE WHEN {h} THEN 1 ELSE 0 END AS hit FROM ws"
        for d in dims for m, h in (("conversion", "converted_this_session"), ("bounce", "event_count = 1")))
    return f"""{WS},
x AS ({cells}),
d AS (SELECT dimension, value, metric, day, count(*) AS n, sum(hit) AS h FROM x GROUP BY ALL),
t AS (SELECT dimension, value, metric, sum(n) AS total, sum(h) AS hits FROM d GROUP BY ALL HAVING sum(n) >= {least}),
s AS (SELECT t.*, a.day, sum(b.n) AS n0, sum(b.h) AS h0 FROM t JOIN d a USING (dimension, value, metric) JOIN d b USING (dimension, value, metric)
  WHERE b.day <= a.day GROUP BY ALL),
r AS (SELECT s.*, (SELECT min(d.day) FROM d WHERE d.dimension = s.dimension AND d.value = s.value AND d.metric = s.metric AND d.day > s.day) AS next_day,
  abs(total * h0 - n0 * hits) AS size FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY dimension, value, metric ORDER BY size DESC, day) AS k FROM r WHERE next_day IS NOT NULL)
SELECT dimension, value, metric, CAST(next_day AS VARCHAR) AS break_day, CAST(total AS BIGINT) AS sessions, {rate('h0', 'n0')} AS rate_before,
  {rate('hits - h0', 'total - n0')} AS rate_after,
  round(size::DOUBLE / nullif(sqrt(hits * (total - hits) / total::DOUBLE) * total, 0), 6) AS score FROM b WHERE k = 1"""


GAME_KEYS = {
    "ga_session_id": "true", "engagement_time_msec": "true", "level_id": "level_id IS NOT NULL", "current_level": "current_level IS NOT NULL",
    "attempt_number": "attempt_number IS NOT NULL", "completion_time": "completion_time IS NOT NULL", "stars_gained": "stars_gained IS NOT NULL",
    "fail_time": "fail_time_val IS NOT NULL", "fail_reason": "fail_reason IS NOT NULL", "items_cleared_perc": "items_cleared_perc IS NOT NULL",
    "objectives_left_perc": "objectives_left_perc IS NOT NULL", "time_left_perc": "time_left_perc IS NOT NULL",
    "pre_boosters_chief_level": "pre_boosters_chief_level IS NOT NULL", "boosters_used": "boosters_used_str IS NOT NULL",
    "pre_boosters_manual_used": "pre_boosters_manual_used_str IS NOT NULL", "end_boosters_used": "end_boosters_used_str IS NOT NULL",
    "shop_purhcase": "shop_purchase_flag IS NOT NULL AND (engagement_time_msec // 1000) % 3 = 0",
    "shop_purchase": "shop_purchase_flag IS NOT NULL AND (engagement_time_msec // 1000) % 3 = 1",
    "from_popup": "from_popup IS NOT NULL", "stack_item_1": "stack_item_1 IS NOT NULL", "stack_item_2": "stack_item_2 IS NOT NULL",
    "stack_item_3": "stack_item_3 IS NOT NULL", "stack_item_last": "stack_item_last IS NOT NULL",
    "retry_streak_number": "retry_streak_number IS NOT NULL", "ab_test": "ab_test_param IS NOT NULL",
}
WEEK_OF = "CAST(date_trunc('week', {}) AS DATE)"

SQL = {
    "similar_users": f"""{VECTORS},
d AS (SELECT a.u AS user_pseudo_id, b.u AS neighbour, floor(sqrt({square('a', 'b')}) * 1e6 + 0.5) / 1e6 AS distance FROM z a, z b WHERE a.u <> b.u)
SELECT user_pseudo_id, row_number() OVER (PARTITION BY user_pseudo_id ORDER BY distance, neighbour) AS rank, neighbour, round(distance, 6) AS distance
FROM d QUALIFY rank <= 5""",
    "user_clusters": clusters() + " SELECT u AS user_pseudo_id, cluster FROM assigned",
    "cluster_profiles": clusters() + f""" SELECT cluster, count(*) AS users, {', '.join(f"{r6(f'avg(v{i})')} AS avg_{f}" for i, f in enumerate(FEATURES))}
FROM assigned JOIN v USING (u) GROUP BY cluster""",
    "paid_vs_organic": f"""{WK},
g AS (SELECT src AS source, kind, count(*) AS sessions, {BUYS} AS conversions, sum(revenue) AS revenue FROM wk GROUP BY ALL)
SELECT g.source, kind, sessions, conversions, {r6('revenue')} AS revenue, {rate('conversions', 'sessions')} AS conversion_rate,
  {rate('sessions', 'o.n')} AS share_of_source, {rate('revenue', 'sessions')} AS revenue_per_session
FROM g JOIN (SELECT src AS source, count(*) AS n FROM wk GROUP BY 1) o USING (source)""",
    "dark_direct": f"""{WK},
d AS (SELECT len(list_filter(string_split(regexp_extract(coalesce(landing_page, ''), {URL_RE}, 1), '/'), lambda x: x <> '')) AS depth, had_search, converted_this_session
  FROM wk WHERE kind = 'direct')
SELECT depth AS landing_depth, count(*) AS sessions, {BUYS} AS conversions, count(*) FILTER (WHERE depth >= 2 AND NOT had_search) AS suspect_sessions,
  count(*) FILTER (WHERE depth >= 2 AND NOT had_search AND converted_this_session) AS suspect_conversions,
  {rate('count(*) FILTER (WHERE depth >= 2 AND NOT had_search)', '(SELECT count(*) FROM d)')} AS share_of_direct FROM d GROUP BY depth""",
    "referral_ranking": f"""{WK},
g AS (SELECT src AS source, count(*) AS sessions, {BUYS} AS conversions, {BUYS} / count(*)::DOUBLE AS conversion_rate,
    count(*) / greatest((max(session_date) - min(session_date) + 1) / 7.0, 1.0) AS sessions_a_week, avg(event_count) AS avg_events,
    count(*) FILTER (WHERE event_count = 1) / count(*)::DOUBLE AS bounce_rate, CAST(sum(revenue) AS DOUBLE) / count(*) AS revenue_per_session
  FROM wk WHERE kind <> 'direct' GROUP BY src)
SELECT * REPLACE ({', '.join(f'{r6(c)} AS {c}' for c in ('conversion_rate', 'sessions_a_week', 'avg_events', 'bounce_rate', 'revenue_per_session'))}),
  1 + (SELECT count(*) FROM g o WHERE (-o.conversion_rate, -o.sessions, o.source) < (-g.conversion_rate, -g.sessions, g.source)) AS rank FROM g""",
    "campaign_fatigue": f"""{WS},
x AS (SELECT coalesce(campaign, '(none)') AS campaign, session_date, converted_this_session FROM ws),
w AS (SELECT campaign, (session_date - born) // 7 AS week, count(*) AS n, {BUYS} AS h
  FROM x JOIN (SELECT campaign, min(session_date) AS born FROM x GROUP BY 1) USING (campaign) GROUP BY ALL),
b AS (SELECT w.campaign, w.week, w.n, w.h, sum(o.h) / sum(o.n)::DOUBLE AS before FROM w LEFT JOIN w o ON o.campaign = w.campaign AND o.week < w.week GROUP BY ALL)
SELECT campaign, week AS week_of_life, n AS sessions, h AS conversions, {rate('h', 'n')} AS conversion_rate, {r6('before')} AS rate_before,
  {r6('(h / n::DOUBLE - before) / nullif(before, 0)')} AS change FROM b""",
    "direct_halo": f"""{WK}, {SPINE},
y AS (SELECT day, count(session_id) AS y FROM spine LEFT JOIN wk ON session_date = day AND kind = 'direct' GROUP BY day),
x AS (SELECT c.campaign, spine.day, (SELECT count(*) FROM wk s WHERE s.kind <> 'direct' AND s.campaign = c.campaign AND s.session_date = spine.day) AS x
  FROM (SELECT DISTINCT campaign FROM wk WHERE kind <> 'direct' AND campaign IS NOT NULL) c, spine),
g AS (SELECT campaign, lag, count(*) AS days, corr(x::DOUBLE, y::DOUBLE) AS r FROM x, range(8) l(lag) JOIN y ON y.day = x.day + lag::INTEGER GROUP BY ALL),
h AS (SELECT campaign, CAST(lag AS BIGINT) AS lag, days, CASE WHEN isfinite(r) THEN round(r, 6) END AS correlation FROM g)
SELECT *, correlation IS NOT NULL AND row_number() OVER (PARTITION BY campaign ORDER BY correlation DESC NULLS LAST, lag) = 1 AS best FROM h""",
    "rate_breaks": breaks(),
    "weekly_seasonality": f"""{WS}, {SPINE},
d AS (SELECT day, count(session_id) AS sessions, {BUYS} AS conversions FROM spine LEFT JOIN ws ON session_date = day GROUP BY day),
x AS (SELECT 'sessions' AS metric, day, sessions AS value FROM d UNION ALL SELECT 'conversions', day, conversions FROM d),
t AS (SELECT x.*, (SELECT CASE WHEN count(*) = 7 THEN avg(o.value) END FROM x o WHERE o.metric = x.metric AND abs(o.day - x.day) <= 3) AS trend,
  dayofweek(day) + 1 AS weekday FROM x),
f AS (SELECT metric, weekday, avg(value / nullif(trend, 0)) AS f FROM t GROUP BY ALL),
s AS (SELECT t.*, f.f / nullif(o.f, 0) AS factor FROM t JOIN f USING (metric, weekday) JOIN (SELECT metric, avg(f) AS f FROM f GROUP BY 1) o USING (metric)),
r AS (SELECT *, value - trend * factor AS rest FROM s)
SELECT metric, CAST(day AS VARCHAR) AS day, weekday, value, {r6('trend')} AS trend, {r6('factor')} AS factor, {r6('rest')} AS rest,
  coalesce(round(abs(rest), 9) > round(2 * (SELECT stddev_pop(o.rest) FROM r o WHERE o.metric = r.metric), 9), false) AS anomaly FROM r""",
    "day_part_drift": f"""{WS},
g AS (SELECT {day_part_sql('session_start_ts')} AS day_part, {WEEK_OF.format('session_date')} AS week, count(*) AS n, {BUYS} AS h FROM ws GROUP BY ALL),
b AS (SELECT g.*, (SELECT sum(o.h) / sum(o.n)::DOUBLE FROM g o WHERE o.day_part = g.day_part AND o.week < g.week) AS before,
  (SELECT sum(o.n) FROM g o WHERE o.week = g.week) AS of FROM g)
SELECT day_part, CAST(week AS VARCHAR) AS week, n AS sessions, h AS conversions, {rate('h', 'n')} AS conversion_rate, {rate('n', 'of')} AS share_of_week,
  {r6('before')} AS rate_before, {r6('h / n::DOUBLE - before')} AS drift FROM b""",
    "spelling_audit": "WITH RECURSIVE " + same_name("(SELECT p_name AS value, 1 AS n FROM lineitem JOIN part ON l_partkey = p_partkey)") + f""", {SPELLED}
SELECT cluster, canonical, array_to_string(list(value ORDER BY value), '>') AS values, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS total,
  {rate('sum(n) FILTER (WHERE value <> canonical)', 'sum(n)')} AS consolidated_share
FROM named JOIN c USING (cluster) GROUP BY cluster, canonical HAVING count(*) > 1""",
    "channel_spellings": recursive(WS) + ", " + same_name("(SELECT concat_ws('/', source, medium, campaign) AS value, 1 AS n FROM ws)") + f""", {SPELLED}
SELECT value, n, cluster, canonical, cluster_n, spellings FROM named JOIN c USING (cluster)""",
    "conversion_lag": f"""{WJ},
l AS (SELECT days_to_first_purchase AS d FROM wj WHERE days_to_first_purchase IS NOT NULL)
SELECT d AS lag_days, count(*) AS buyers, {rate('(SELECT count(*) FROM l o WHERE o.d <= l.d)', '(SELECT count(*) FROM l)')} AS share_by_then,
  d = (SELECT quantile_disc(d, 0.5) FROM l) AS is_median, d = (SELECT d FROM l GROUP BY d ORDER BY count(*) DESC, d LIMIT 1) AS is_mode FROM l GROUP BY d""",
    "return_cadence": f"""{WJ},
g AS (SELECT a.user_pseudo_id, min(b.session_date) - a.session_date AS gap FROM (SELECT DISTINCT user_pseudo_id, session_date FROM ws) a
  JOIN ws b ON a.user_pseudo_id = b.user_pseudo_id AND b.session_date > a.session_date GROUP BY a.user_pseudo_id, a.session_date)
SELECT user_group, count(DISTINCT user_pseudo_id) AS users, count(*) AS gaps, quantile_disc(gap, 0.5) AS median_days, quantile_disc(gap, 0.9) AS p90_days
FROM g JOIN wj USING (user_pseudo_id) GROUP BY user_group""",
    "stage_transitions": stages(),
    "content_affinity": f"""{EVW},
e AS (SELECT user_pseudo_id AS u, event_name, event_timestamp AS ts, {category('page_location')} AS category FROM wev),
seen AS (SELECT u, category, min(ts) AS ts FROM e WHERE category IS NOT NULL AND event_name <> 'purchase' GROUP BY ALL),
h AS (SELECT s.*, EXISTS (FROM e WHERE e.u = s.u AND event_name = 'purchase' AND e.ts >= s.ts) AS buys FROM seen s)
SELECT category, count(*) AS users, count(*) FILTER (WHERE buys) AS converted, {rate('count(*) FILTER (WHERE buys)', 'count(*)')} AS conversion_rate,
  round((count(*) FILTER (WHERE buys) / count(*)::DOUBLE) / nullif((SELECT count(DISTINCT u) FILTER (WHERE event_name = 'purchase') / count(DISTINCT u)::DOUBLE FROM e), 0), 6) AS affinity
FROM h GROUP BY category""",
    "content_consumers": f"""{EVW},
e AS (SELECT user_pseudo_id AS u, event_name, event_timestamp AS ts, {category('page_location')} AS category FROM wev),
b AS (SELECT u, min(ts) FILTER (WHERE event_name = 'purchase') AS bought FROM e GROUP BY u),
n AS (SELECT b.u, b.bought, count(DISTINCT category) FILTER (WHERE event_name <> 'purchase' AND (bought IS NULL OR ts < bought)) AS n FROM b JOIN e USING (u) GROUP BY ALL)
SELECT CASE WHEN n <= 1 THEN CAST(n AS VARCHAR) WHEN n <= 3 THEN '2-3' ELSE '4+' END AS categories, count(*) AS users, count(bought) AS buyers,
  {rate('count(bought)', 'count(*)')} AS conversion_rate FROM n GROUP BY 1""",
    "dwell_conversion": f"""{EVW},
l AS (SELECT user_pseudo_id, ga_session_id, list({{'ts': event_timestamp, 'c': {category('page_location')}, 'p': event_name = 'purchase'}} ORDER BY event_timestamp, event_id) AS e
  FROM wev GROUP BY ALL),
x AS (SELECT unnest([{{'c': e[i].c, 's': (e[i + 1].ts - e[i].ts) / 1e6, 'b': len([z.ts for z in e if z.p AND z.ts > e[i].ts]) > 0}} for i in range(1, len(e))], recursive := true) FROM l)
SELECT c AS category, CASE WHEN s < 10 THEN '<10s' WHEN s < 30 THEN '10-30s' WHEN s < 120 THEN '30-120s' WHEN s < 600 THEN '2-10min' ELSE '>10min' END AS band,
  count(*) AS stays, count(*) FILTER (WHERE b) AS converted, {rate('count(*) FILTER (WHERE b)', 'count(*)')} AS conversion_rate FROM x WHERE c IS NOT NULL GROUP BY 1, 2""",
    "repeat_views": f"""{EVW},
l AS (SELECT user_pseudo_id, ga_session_id, list(page) AS p, bool_or(event_name = 'purchase') AS bought FROM wev WHERE page_location IS NOT NULL GROUP BY ALL),
s AS (SELECT bought, len(list_distinct(p)) AS pages, list_max([len([y for y in p if y = x]) for x in p]) AS n FROM l)
SELECT CASE WHEN n <= 2 THEN CAST(n AS VARCHAR) WHEN n <= 4 THEN '3-4' ELSE '5+' END AS most_repeats, count(*) AS sessions,
  count(*) FILTER (WHERE bought) AS conversions, {r6('avg(pages)')} AS avg_pages, {rate('count(*) FILTER (WHERE bought)', 'count(*)')} AS conversion_rate FROM s GROUP BY 1""",
    "bundle_buyers": f"""WITH
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
l AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS parts, count(*) AS lines, count(*) FILTER (WHERE l_discount > 0) AS cheap FROM lineitem GROUP BY 1),
x AS (SELECT a.n, b.o_orderkey AS again, date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE)) <= 90 AS soon, l.*
  FROM o a JOIN l ON l.l_orderkey = a.o_orderkey LEFT JOIN o b ON b.o_custkey = a.o_custkey AND b.k = 2 WHERE a.k = 1)
SELECT CASE parts WHEN 1 THEN 'single' WHEN 2 THEN 'pair' ELSE 'bundle' END AS first_order, count(*) AS customers, count(again) AS returned,
  count(*) FILTER (WHERE soon) AS returned_soon, {r6('avg(n)')} AS avg_orders, {rate('sum(cheap)', 'sum(lines)')} AS discounted_lines,
  {rate('count(again)', 'count(*)')} AS return_rate, {rate('count(*) FILTER (WHERE soon)', 'count(*)')} AS soon_rate FROM x GROUP BY 1""",
    "promo_orders": f"""WITH
l AS (SELECT l_orderkey AS o_orderkey, count(*) AS lines, bool_and(l_discount >= 0.05) AS every, bool_or(l_discount >= 0.05) AS one FROM lineitem GROUP BY 1)
SELECT CASE WHEN every THEN 'all' WHEN one THEN 'some' ELSE 'none' END AS discounted, count(*) AS orders, {r6('avg(lines)')} AS avg_lines,
  {r6('avg(CAST(o_totalprice AS DECIMAL(18, 2)))')} AS avg_value FROM orders JOIN l USING (o_orderkey) GROUP BY 1""",
    "schema_drift": f"""WITH {ev_cte('game')},
k AS ({' UNION ALL '.join(f"SELECT event_name, '{k}' AS key, event_date_parsed AS day FROM ev WHERE {c}" for k, c in GAME_KEYS.items())})
SELECT event_name, key, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS events,
  min(day) - (SELECT min(event_date_parsed) FROM ev) AS days_after_start FROM k GROUP BY event_name, key""",
    "cardinality_trend": f"""{EVW},
w AS (SELECT {WEEK_OF.format('event_date_parsed')} AS week, count(DISTINCT event_date_parsed) AS days, count(DISTINCT user_pseudo_id) AS users FROM wev GROUP BY 1)
SELECT CAST(w.week AS VARCHAR) AS week, w.days, w.users, round((w.users - p.users)::DOUBLE / p.users, 6) AS change, true AS estimate_holds
FROM w ASOF LEFT JOIN w p ON w.week > p.week""",
    "id_stability": f"""{WS},
w AS (SELECT {WEEK_OF.format('session_date')} AS week, count(DISTINCT user_pseudo_id) AS users, count(*) AS sessions FROM ws GROUP BY 1),
b AS (SELECT week, count(*) AS new_users FROM (SELECT {WEEK_OF.format('min(session_date)')} AS week FROM ws GROUP BY user_pseudo_id) GROUP BY week)
SELECT CAST(w.week AS VARCHAR) AS week, w.users, w.sessions, coalesce(new_users, 0) AS new_users, {rate('w.sessions', 'w.users')} AS sessions_per_user,
  round((w.sessions / w.users::DOUBLE) / (p.sessions / p.users::DOUBLE) - 1, 6) AS change FROM w LEFT JOIN b USING (week) ASOF LEFT JOIN w p ON w.week > p.week""",
    "frequent_sets": EVW + ", " + item_sets("(SELECT {'u': user_pseudo_id, 's': ga_session_id} AS basket, page AS item FROM wev WHERE page_location IS NOT NULL)", 3),
    "frequent_parts": "WITH " + item_sets("(SELECT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)", 30),
    "best_segments": whole_cube(),
}
