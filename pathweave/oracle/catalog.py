"""DuckDB oracle SQL for the catalogue analyses."""

from pathweave.oracle.prefix import ev_cte
from pathweave.oracle.web import W_END, url_path_sql, web_journeys_cte, web_sessions_cte

WJ = f"WITH {web_journeys_cte()}"
WS = f"WITH {web_sessions_cte()}"
EVW = f"""WITH {ev_cte('web')},
wev AS (SELECT *, {url_path_sql('page_location')} AS page FROM ev
  WHERE user_pseudo_id IS NOT NULL AND ga_session_id IS NOT NULL)"""
SW = "PARTITION BY user_pseudo_id, ga_session_id ORDER BY event_timestamp, event_id"
WEEK = "CAST(date_trunc('week', {}) AS DATE)"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def rate(num: str, den: str) -> str:
    return f"round(CAST({num} AS DOUBLE) / nullif({den}, 0), 6)"


STEPS = ("view_item", "add_to_cart", "begin_checkout", "purchase")


def funnel_sql(level: str = "session", by: str | None = None) -> str:
    keys = "user_pseudo_id, ga_session_id" if level == "session" else "user_pseudo_id"
    ts = "{'ts': event_timestamp, 'id': event_id}"
    firsts = ", ".join(f"min({ts}) FILTER (WHERE event_name = '{s}') AS t{i}" for i, s in enumerate(STEPS))
    dim = (f", arg_min({by}, {ts}) AS {by}") if by else ""
    conds, prev = [], None
    for i in range(len(STEPS)):
        c = f"t{i} IS NOT NULL" if prev is None else f"({prev}) AND t{i} >= t{i - 1}"
        conds.append(c)
        prev = c
    reached = ", ".join(f"count(*) FILTER (WHERE {c}) AS step{i}_{s}" for i, (c, s) in enumerate(zip(conds, STEPS)))
    group = f" GROUP BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""{EVW},
f AS (SELECT {keys}{dim}, {firsts} FROM wev GROUP BY {keys})
SELECT {sel}count(*) AS entities, {reached} FROM f{group}"""


SQL = {
    "sequence_ngrams": f"""{EVW},
l AS (SELECT user_pseudo_id, ga_session_id, list(event_name ORDER BY event_timestamp, event_id) AS e FROM wev GROUP BY ALL),
g AS (SELECT user_pseudo_id, ga_session_id, list_contains(e, 'purchase') AS buys,
  unnest([array_to_string(e[i:i + 2], '>') for i in range(1, len(e) - 1)]) AS ngram FROM l WHERE len(e) > 2),
s AS (SELECT ngram, buys, count(*) AS n FROM g GROUP BY user_pseudo_id, ga_session_id, ngram, buys)
SELECT ngram, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS sessions,
  {rate('count(*) FILTER (WHERE buys)', 'count(*)')} AS conversion_rate FROM s GROUP BY ngram""",
    "path_archetypes": f"""{WS}
SELECT array_to_string(event_sequence, '>') AS path, count(*) AS sessions,
  count(*) FILTER (WHERE converted_this_session) AS conversions,
  {rate('count(*) FILTER (WHERE converted_this_session)', 'count(*)')} AS conversion_rate,
  min(event_count) AS min_event_count FROM ws GROUP BY 1""",
    "transition_matrix": f"""{EVW},
x AS (SELECT page AS from_page, lead(page) OVER ({SW}) AS to_page FROM wev),
g AS (SELECT from_page, to_page, count(*) AS transitions FROM x WHERE to_page IS NOT NULL GROUP BY 1, 2)
SELECT from_page, to_page, transitions, {r6('transitions / sum(transitions) OVER (PARTITION BY from_page)')} AS share_from_page
FROM g""",
    "hub_exit_pages": f"""{EVW},
last AS (SELECT page FROM (SELECT page, row_number() OVER (PARTITION BY user_pseudo_id, ga_session_id
  ORDER BY event_timestamp DESC, event_id DESC) AS rn FROM wev) WHERE rn = 1),
ex AS (SELECT page, count(*) AS exits FROM last GROUP BY page),
vw AS (SELECT page, count(*) AS events, count(DISTINCT user_pseudo_id || '|' || CAST(ga_session_id AS VARCHAR)) AS sessions
  FROM wev GROUP BY page)
SELECT v.page, v.events, v.sessions, coalesce(e.exits, 0) AS exits, {rate('coalesce(e.exits, 0)', 'v.sessions')} AS exit_rate
FROM vw v LEFT JOIN ex e ON v.page = e.page""",
    "session_depth": f"""{WS}
SELECT CASE WHEN event_count <= 1 THEN '1' WHEN event_count = 2 THEN '2' WHEN event_count <= 5 THEN '3-5'
  WHEN event_count <= 10 THEN '6-10' ELSE '11+' END AS depth, count(*) AS sessions,
  count(*) FILTER (WHERE converted_this_session) AS conversions,
  {rate('count(*) FILTER (WHERE converted_this_session)', 'count(*)')} AS conversion_rate FROM ws GROUP BY 1""",
    "dwell_bands": f"""{EVW},
x AS (SELECT page, (lead(event_timestamp) OVER ({SW}) - event_timestamp) / 1e6 AS dwell_s FROM wev)
SELECT page, CASE WHEN dwell_s < 10 THEN '<10s' WHEN dwell_s < 60 THEN '10-60s' WHEN dwell_s < 300 THEN '1-5min'
  ELSE '5min+' END AS band, count(*) AS events, {r6('avg(dwell_s)')} AS avg_dwell_s
FROM x WHERE dwell_s IS NOT NULL GROUP BY 1, 2""",
    "funnel": funnel_sql(),
    "funnel_by_device": funnel_sql(by="device_category"),
    "funnel_user_level": funnel_sql(level="user"),
    "event_bursts": f"""{EVW},
x AS (SELECT user_pseudo_id, (event_timestamp - lag(event_timestamp) OVER (PARTITION BY user_pseudo_id
  ORDER BY event_timestamp, event_id)) / 1e6 < 3600 AS burst FROM wev)
SELECT user_pseudo_id, count(*) AS events, count(*) FILTER (WHERE coalesce(burst, false)) AS burst_events
FROM x GROUP BY user_pseudo_id""",
    "duplicate_events": f"""{EVW}
SELECT DISTINCT user_pseudo_id, ga_session_id, event_name, copies FROM (
  SELECT *, count(*) OVER (PARTITION BY user_pseudo_id, ga_session_id, event_name) AS copies FROM wev) WHERE copies > 1""",
    "cohort_retention": f"""{WS},
fs AS (SELECT user_pseudo_id, min(session_date) AS first_seen FROM ws GROUP BY 1),
x AS (SELECT s.user_pseudo_id, {WEEK.format('f.first_seen')} AS cohort_week,
  CAST(floor(date_diff('day', {WEEK.format('f.first_seen')}, {WEEK.format('s.session_date')}) / 7) AS INTEGER) AS week_offset
  FROM ws s JOIN fs f ON s.user_pseudo_id = f.user_pseudo_id),
g AS (SELECT cohort_week, week_offset, count(DISTINCT user_pseudo_id) AS active_users FROM x GROUP BY 1, 2),
sz AS (SELECT cohort_week, active_users AS cohort_size FROM g WHERE week_offset = 0)
SELECT CAST(g.cohort_week AS VARCHAR) AS cohort_week, CAST(g.week_offset AS BIGINT) AS week_offset, g.active_users,
  sz.cohort_size, {rate('g.active_users', 'sz.cohort_size')} AS retention
FROM g JOIN sz ON g.cohort_week = sz.cohort_week""",
    "cohort_ltv": f"""{WS},
fs AS (SELECT user_pseudo_id, min(session_date) AS first_seen FROM ws GROUP BY 1),
x AS (SELECT {WEEK.format('f.first_seen')} AS cohort_week,
  CAST(floor(date_diff('day', {WEEK.format('f.first_seen')}, {WEEK.format('s.session_date')}) / 7) AS INTEGER) AS week_offset,
  s.revenue AS revenue FROM ws s JOIN fs f ON s.user_pseudo_id = f.user_pseudo_id),
g AS (SELECT cohort_week, week_offset, sum(revenue) AS revenue FROM x GROUP BY 1, 2),
sz AS (SELECT {WEEK.format('first_seen')} AS cohort_week, count(*) AS cohort_size FROM fs GROUP BY 1)
SELECT CAST(g.cohort_week AS VARCHAR) AS cohort_week, CAST(g.week_offset AS BIGINT) AS week_offset, sz.cohort_size,
  {r6('g.revenue')} AS revenue,
  {r6('sum(g.revenue) OVER (PARTITION BY g.cohort_week ORDER BY g.week_offset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sz.cohort_size')} AS cumulative_ltv
FROM g JOIN sz ON g.cohort_week = sz.cohort_week""",
    "lag_distribution": f"""{WS},
d AS (SELECT DISTINCT user_pseudo_id, session_date FROM ws),
x AS (SELECT date_diff('day', lag(session_date) OVER (PARTITION BY user_pseudo_id ORDER BY session_date), session_date) AS gap_days FROM d)
SELECT gap_days, count(*) AS gaps FROM x WHERE gap_days IS NOT NULL GROUP BY 1""",
    "reactivation": f"""{WS},
d AS (SELECT DISTINCT user_pseudo_id, session_date FROM ws),
x AS (SELECT session_date, date_diff('day', lag(session_date) OVER (PARTITION BY user_pseudo_id ORDER BY session_date), session_date) AS gap FROM d)
SELECT CAST(session_date AS VARCHAR) AS session_date, count(*) AS reactivated_users FROM x WHERE gap >= 3 GROUP BY 1""",
    "post_purchase_return": f"""{WJ},
x AS (SELECT j.user_pseudo_id, j.user_group, bool_or(s.session_date > j.first_purchase_date
  AND s.session_date <= j.first_purchase_date + 30) AS returned
  FROM wj j JOIN ws s ON j.user_pseudo_id = s.user_pseudo_id WHERE j.first_purchase_date IS NOT NULL GROUP BY 1, 2)
SELECT user_group, count(*) AS buyers, count(*) FILTER (WHERE returned) AS returned,
  {rate('count(*) FILTER (WHERE returned)', 'count(*)')} AS return_rate FROM x GROUP BY 1""",
    "rfm_and_lifecycle": f"""{WJ},
b AS (SELECT user_pseudo_id, date_diff('day', last_seen_date, {W_END}) AS recency_days, total_sessions AS frequency,
  CAST(total_revenue AS DOUBLE) AS monetary FROM wj),
th AS (SELECT quantile_disc(recency_days, [0.2, 0.4, 0.6, 0.8]) AS qr, quantile_disc(frequency, [0.2, 0.4, 0.6, 0.8]) AS qf,
  quantile_disc(monetary, [0.2, 0.4, 0.6, 0.8]) AS qm FROM b),
x AS (SELECT b.*, 6 - (1 + len(list_filter(qr, lambda t: t < recency_days))) AS r_score,
  1 + len(list_filter(qf, lambda t: t < frequency)) AS f_score, 1 + len(list_filter(qm, lambda t: t < monetary)) AS m_score
  FROM b, th)
SELECT user_pseudo_id, recency_days, frequency, {r6('monetary')} AS monetary, CAST(r_score AS BIGINT) AS r_score,
  CAST(f_score AS BIGINT) AS f_score, CAST(m_score AS BIGINT) AS m_score,
  CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'champion' WHEN r_score <= 2 AND f_score >= 4 THEN 'at_risk'
    WHEN r_score >= 4 AND f_score <= 2 THEN 'new_or_light' WHEN r_score <= 2 THEN 'hibernating' ELSE 'regular' END AS segment
FROM x""",
    "pareto_concentration": """WITH rev AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS revenue FROM orders GROUP BY 1),
th AS (SELECT quantile_disc(revenue, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM rev),
x AS (SELECT revenue, 10 - len(list_filter(q, lambda t: t < revenue)) AS decile FROM rev, th),
g AS (SELECT decile, count(*) AS customers, sum(revenue) AS revenue FROM x GROUP BY 1)
SELECT CAST(decile AS BIGINT) AS decile, customers, round(CAST(revenue AS DOUBLE), 6) AS revenue,
  round(CAST(sum(revenue) OVER (ORDER BY decile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(sum(revenue) OVER () AS DOUBLE), 6)
  AS cum_revenue_share FROM g""",
    "period_deltas": f"""{WS},
g AS (SELECT {WEEK.format('session_date')} AS week, count(*) AS sessions, count(DISTINCT user_pseudo_id) AS users,
  CAST(sum(revenue) AS DOUBLE) AS revenue FROM ws GROUP BY 1)
SELECT CAST(week AS VARCHAR) AS week, sessions, users, round(revenue, 6) AS revenue,
  round((sessions - lag(sessions) OVER w) / nullif(CAST(lag(sessions) OVER w AS DOUBLE), 0), 6) AS sessions_wow,
  round((users - lag(users) OVER w) / nullif(CAST(lag(users) OVER w AS DOUBLE), 0), 6) AS users_wow,
  round((revenue - lag(revenue) OVER w) / nullif(lag(revenue) OVER w, 0), 6) AS revenue_wow
FROM g WINDOW w AS (ORDER BY week)""",
    "trend_and_anomaly": f"""WITH {ev_cte('web')},
s AS (SELECT CAST(unnest(generate_series(min(event_date_parsed), max(event_date_parsed), INTERVAL 1 DAY)) AS DATE) AS day FROM ev),
d AS (SELECT day, (SELECT count(*) FROM ev WHERE event_date_parsed = day) AS events FROM s),
x AS (SELECT d.day, d.events, avg(p.events) AS mean_prev, stddev_samp(p.events) AS sd_prev
  FROM d LEFT JOIN d p ON p.day < d.day AND p.day >= d.day - 28 GROUP BY ALL)
SELECT CAST(day AS VARCHAR) AS day, events, round(mean_prev, 6) AS mean_prev, round(sd_prev, 6) AS sd_prev,
  round((events - mean_prev) / nullif(sd_prev, 0), 6) AS z_score, abs((events - mean_prev) / nullif(sd_prev, 0)) > 2 AS is_anomaly
FROM x""",
    "early_signal_lift": f"""{EVW},
u AS (SELECT user_pseudo_id, list({{'t': event_timestamp, 'n': event_name}} ORDER BY event_timestamp, event_id) AS l FROM wev GROUP BY 1),
x AS (SELECT list_contains([e.n for e in l[1:3]], 'add_to_cart') AS has_signal,
  len([1 for e in l[4:] if e.n = 'purchase' AND e.t <= l[3].t + 14 * 86400000000]) > 0 AS buyer FROM u WHERE len(l) >= 3)
SELECT has_signal, count(*) AS users, count(*) FILTER (WHERE buyer) AS buyers,
  {rate('count(*) FILTER (WHERE buyer)', 'count(*)')} AS conversion_rate FROM x GROUP BY 1""",
    "at_risk_users": f"""{WS},
b AS (SELECT user_pseudo_id, {WEEK.format('min(session_date)')} AS first FROM ws GROUP BY 1),
s AS (SELECT user_pseudo_id, CAST(unnest(generate_series(first, {WEEK.format(W_END)}, INTERVAL 7 DAY)) AS DATE) AS week FROM b),
x AS (SELECT s.user_pseudo_id, s.week, count(*) FILTER (WHERE session_date BETWEEN s.week AND s.week + 6) AS sessions,
  count(*) FILTER (WHERE session_date BETWEEN s.week - 7 AND s.week - 1) AS prev_sessions
  FROM s JOIN ws ON s.user_pseudo_id = ws.user_pseudo_id GROUP BY 1, 2)
SELECT user_pseudo_id, CAST(week AS VARCHAR) AS week, sessions, prev_sessions FROM x
WHERE prev_sessions > 0 AND sessions <= prev_sessions * 0.5""",
    "behaviour_clusters": f"""{WJ},
th AS (SELECT quantile_disc(total_sessions, 0.5) AS med_s, quantile_disc(total_events, 0.5) AS med_e FROM wj),
x AS (SELECT wj.*, CASE WHEN total_sessions > med_s AND total_events > med_e THEN 'high'
  WHEN total_sessions > med_s OR total_events > med_e THEN 'mid' ELSE 'low' END || '_' ||
  CASE WHEN total_purchases > 0 THEN 'buyer' ELSE 'browser' END AS cluster FROM wj, th)
SELECT cluster, count(*) AS users, {r6('avg(total_sessions)')} AS avg_sessions,
  {r6('avg(total_revenue)')} AS avg_revenue FROM x GROUP BY 1""",
    "conversion_cube": f"""{WS},
x AS (SELECT coalesce(source, '(none)') AS source, coalesce(device_category, '(none)') AS device_category,
  {url_path_sql('landing_page')} AS landing_path, converted_this_session FROM ws),
g AS (SELECT source, device_category, landing_path, grouping(source, device_category, landing_path) AS grouping_id,
  count(*) AS sessions, count(*) FILTER (WHERE converted_this_session) AS conversions
  FROM x GROUP BY CUBE (source, device_category, landing_path))
SELECT source, device_category, landing_path, CAST(grouping_id AS BIGINT) AS grouping_id, sessions, conversions,
  {rate('conversions', 'sessions')} AS conversion_rate,
  round(CAST(conversions AS DOUBLE) / sessions - max(CASE WHEN grouping_id = 7 THEN CAST(conversions AS DOUBLE) / sessions END) OVER (), 6)
  AS deviation_from_total FROM g""",
    "order_cube": """SELECT n_name, c_mktsegment, o_orderpriority,
  CAST(grouping(n_name, c_mktsegment, o_orderpriority) AS BIGINT) AS grouping_id, count(*) AS orders,
  round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE), 6) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY CUBE (n_name, c_mktsegment, o_orderpriority)""",
    "attribution": f"""{WS},
s AS (SELECT user_pseudo_id, coalesce(source, '(none)') AS src, start_us, session_id, converted_this_session FROM ws),
conv AS (SELECT user_pseudo_id, arg_min(src, {{'t': start_us, 'i': session_id}}) AS last_touch, min(start_us) AS conv_ts
  FROM s WHERE converted_this_session GROUP BY 1),
fst AS (SELECT user_pseudo_id, arg_min(src, {{'t': start_us, 'i': session_id}}) AS first_touch FROM s GROUP BY 1),
asst AS (SELECT src AS channel, count(*) AS assists FROM (SELECT DISTINCT s.user_pseudo_id, s.src FROM s
  JOIN conv c ON s.user_pseudo_id = c.user_pseudo_id WHERE s.start_us <= c.conv_ts AND s.src <> c.last_touch) GROUP BY 1),
ft AS (SELECT f.first_touch AS channel, count(*) AS first_touch FROM conv c JOIN fst f ON c.user_pseudo_id = f.user_pseudo_id GROUP BY 1),
lt AS (SELECT last_touch AS channel, count(*) AS last_touch FROM conv GROUP BY 1),
ch AS (SELECT channel FROM ft UNION SELECT channel FROM lt UNION SELECT channel FROM asst)
SELECT ch.channel, coalesce(ft.first_touch, 0) AS first_touch, coalesce(lt.last_touch, 0) AS last_touch,
  coalesce(asst.assists, 0) AS assists
FROM ch LEFT JOIN ft ON ch.channel = ft.channel LEFT JOIN lt ON ch.channel = lt.channel
LEFT JOIN asst ON ch.channel = asst.channel""",
    "channel_quality": f"""{WS}
SELECT coalesce(lower(trim(source)), '(none)') AS channel, CAST({WEEK.format('session_date')} AS VARCHAR) AS week,
  count(*) AS sessions, count(*) FILTER (WHERE converted_this_session) AS conversions,
  {rate('count(*) FILTER (WHERE converted_this_session)', 'count(*)')} AS conversion_rate FROM ws GROUP BY 1, 2""",
    "order_value": """WITH x AS (SELECT o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS idx
  FROM orders)
SELECT CASE WHEN idx >= 3 THEN '3+' ELSE CAST(idx AS VARCHAR) END AS order_index, count(*) AS orders,
  round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 6) AS avg_value, round(quantile_disc(o_totalprice, 0.5), 6) AS median_value FROM x GROUP BY 1""",
    "basket_pairs": """WITH items AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
n AS (SELECT count(DISTINCT o) AS n_orders FROM items),
supp AS (SELECT p, count(*) AS n FROM items GROUP BY p),
freq AS (SELECT * FROM items WHERE p IN (SELECT p FROM supp WHERE n >= 2)),
pairs AS (SELECT a.p AS part_a, b.p AS part_b, count(*) AS orders FROM freq a JOIN freq b ON a.o = b.o AND a.p < b.p
  GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT part_a, part_b, orders, round(CAST(orders AS DOUBLE) * n.n_orders / (sa.n * sb.n), 6) AS lift
FROM pairs JOIN supp sa ON part_a = sa.p JOIN supp sb ON part_b = sb.p, n""",
    "viewed_not_bought": f"""{EVW},
s AS (SELECT list_distinct(list(page) FILTER (WHERE event_name = 'view_item' AND page <> '')) AS v,
  list_distinct(list(page) FILTER (WHERE event_name = 'purchase' AND page <> '')) AS b FROM wev GROUP BY user_pseudo_id, ga_session_id),
p AS (SELECT 'v' AS kind, x, y FROM s, unnest(v) AS a(x), unnest(v) AS b(y) WHERE x < y
  UNION ALL SELECT 'b', x, y FROM s, unnest(b) AS a(x), unnest(b) AS c(y) WHERE x < y),
g AS (SELECT x AS page_a, y AS page_b, count(*) FILTER (WHERE kind = 'v') AS viewed_together,
  count(*) FILTER (WHERE kind = 'b') AS bought_together FROM p GROUP BY x, y)
SELECT *, viewed_together - bought_together AS gap FROM g WHERE viewed_together > bought_together""",
    "hour_day_heatmap": f"""{WS}
SELECT CAST(hour(session_start_ts) AS BIGINT) AS hour,
  {", ".join(f'count(*) FILTER (WHERE dayofweek(session_start_ts) + 1 = {d}) AS "{d}"' for d in range(1, 8))}
FROM ws GROUP BY 1""",
    "bot_heuristics": f"""{WS}
SELECT CAST(session_date AS VARCHAR) AS session_date, coalesce(country, '(none)') AS country, count(*) AS sessions,
  count(*) FILTER (WHERE event_count >= 8 AND duration_seconds <= 86400) AS suspect_sessions FROM ws GROUP BY 1, 2""",
    "data_health": f"""WITH {ev_cte('web')},
d AS (SELECT event_date_parsed AS day, user_pseudo_id, event_name, country FROM ev),
daily AS (SELECT day, count(*) AS events, count(DISTINCT user_pseudo_id) AS users,
  avg(CAST(country IS NOT NULL AS INTEGER)) AS country_coverage FROM d GROUP BY 1),
firsts AS (SELECT day, count(*) AS new_event_names FROM (SELECT event_name, min(day) AS day FROM d GROUP BY 1) GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
SELECT CAST(s.day AS VARCHAR) AS day, coalesce(dl.events, 0) AS events, coalesce(dl.users, 0) AS users,
  coalesce(f.new_event_names, 0) AS new_event_names, round(dl.country_coverage, 6) AS country_coverage
FROM spine s LEFT JOIN daily dl ON s.day = dl.day LEFT JOIN firsts f ON s.day = f.day""",
    "product_performance": f"""{EVW},
g AS (SELECT page, count(*) FILTER (WHERE event_name = 'view_item') AS views,
  count(*) FILTER (WHERE event_name = 'add_to_cart') AS adds, count(*) FILTER (WHERE event_name = 'purchase') AS purchases,
  sum(CAST(purchase_revenue AS DECIMAL(28, 9))) FILTER (WHERE event_name = 'purchase') AS revenue FROM wev GROUP BY 1),
last AS (SELECT page FROM (SELECT page, row_number() OVER (PARTITION BY user_pseudo_id, ga_session_id
  ORDER BY event_timestamp DESC, event_id DESC) AS rn FROM wev) WHERE rn = 1),
ends AS (SELECT page, count(*) AS session_ends FROM last GROUP BY 1)
SELECT g.page, views, adds, purchases, {r6('revenue')} AS revenue, {rate('adds', 'views')} AS add_rate,
  coalesce(session_ends, 0) AS session_ends FROM g LEFT JOIN ends e ON g.page = e.page""",
    "cross_device": f"""{WS},
u AS (SELECT user_pseudo_id, count(DISTINCT device_category) AS devices, bool_or(converted_this_session) AS buyer FROM ws GROUP BY 1)
SELECT devices, count(*) AS users, count(*) FILTER (WHERE buyer) AS buyers FROM u GROUP BY 1""",
    "impact_ranking": f"""{WS},
g AS (SELECT coalesce(country, '(none)') AS segment, count(*) FILTER (WHERE session_date < {W_END} - 14) AS before,
  count(*) FILTER (WHERE session_date >= {W_END} - 14) AS after FROM ws GROUP BY 1)
SELECT segment, before, after, after - before AS delta,
  round(CAST(after - before AS DOUBLE) / nullif(sum(after - before) OVER (), 0), 6) AS share_of_delta,
  row_number() OVER (ORDER BY abs(after - before) DESC, segment) AS rank FROM g""",
}

_EV = f"WITH {ev_cte('web')}"
SQL.update({
    "stream_events_clean": f"""{_EV}
SELECT user_pseudo_id, event_name, event_timestamp, event_id FROM ev WHERE user_pseudo_id IS NOT NULL""",
    "stream_session_rollup": f"""{_EV},
x AS (SELECT *, CASE WHEN event_timestamp - lag(event_timestamp) OVER (PARTITION BY user_pseudo_id
  ORDER BY event_timestamp, event_id) < 1800000000 THEN 0 ELSE 1 END AS brk FROM ev WHERE user_pseudo_id IS NOT NULL),
y AS (SELECT *, sum(brk) OVER (PARTITION BY user_pseudo_id ORDER BY event_timestamp, event_id) AS sid FROM x),
s AS (SELECT user_pseudo_id, min(event_timestamp) AS start_us, max(event_timestamp) AS end_us, count(*) AS event_count,
  count(*) FILTER (WHERE event_name = 'purchase') AS purchases FROM y GROUP BY user_pseudo_id, sid)
SELECT user_pseudo_id, start_us AS session_start, end_us + 1800000000 AS session_end, event_count, start_us, end_us,
  purchases FROM s""",
    "incremental_materialize": f"""{WS}
SELECT session_id, user_pseudo_id, event_count, duration_seconds, converted_this_session FROM ws""",
    "daily_overrides_intraday": f"""{_EV}
SELECT event_id, event_date, user_pseudo_id FROM ev""",
    "incremental_append": f"""{_EV}
SELECT event_date, count(*) AS events FROM ev GROUP BY event_date""",
})

SQL.update({
    "page_outcomes": f"""{EVW},
s AS (SELECT list_contains(list(event_name), 'purchase') AS buys, list_distinct(list(page) FILTER (WHERE page <> '')) AS pages FROM wev
  GROUP BY user_pseudo_id, ga_session_id),
t AS (SELECT count(*) FILTER (WHERE buys) AS c, count(*) FILTER (WHERE NOT buys) AS o FROM s),
g AS (SELECT page, count(*) FILTER (WHERE buys) AS c, count(*) FILTER (WHERE NOT buys) AS o
  FROM (SELECT buys, unnest(pages) AS page FROM s) GROUP BY page)
SELECT page, g.c AS converting_sessions, g.o AS other_sessions,
  round((CAST(g.c AS DOUBLE) / nullif(t.c, 0)) / nullif(CAST(g.o AS DOUBLE) / nullif(t.o, 0), 0), 6) AS lift FROM g, t""",
    "order_value_percentiles": """SELECT CAST(p AS DOUBLE) AS percentile, round((SELECT min(v.o_totalprice) FROM (
    SELECT o_totalprice, cume_dist() OVER (ORDER BY o_totalprice) AS c FROM orders) v WHERE v.c >= p - 1e-12), 6) AS order_value
FROM (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.99]) AS p)""",
    "cart_size_curve": """WITH o AS (SELECT count(*) AS lines, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS value FROM lineitem GROUP BY l_orderkey)
SELECT lines, count(*) AS orders, round(CAST(sum(value) AS DOUBLE) / count(*), 6) AS avg_value FROM o GROUP BY lines""",
    "source_share_drift": f"""{WS},
g AS (SELECT {WEEK.format('session_date')} AS week, coalesce(source, '(none)') AS source, count(*) AS n FROM ws GROUP BY ALL),
x AS (SELECT *, n / sum(n) OVER (PARTITION BY week) AS share FROM g)
SELECT CAST(x.week AS VARCHAR) AS week, x.source, x.n AS sessions, round(x.share, 6) AS share,
  round(x.share - coalesce(y.share, 0), 6) AS drift FROM x LEFT JOIN x y ON x.source = y.source AND y.week = x.week - 7""",
    "sessions_to_purchase": f"""{WS},
u AS (SELECT list({{'b': converted_this_session, 'd': session_date}} ORDER BY start_us, session_id) AS l FROM ws GROUP BY user_pseudo_id),
x AS (SELECT l, list_position([e.b for e in l], true) AS k FROM u)
SELECT CAST(k AS BIGINT) AS sessions, count(*) AS buyers,
  round(avg(list_min([e.d for e in l if e.b]) - list_min([e.d for e in l[1:k]])), 6) AS avg_days FROM x WHERE k > 0 GROUP BY k""",
})
