"""DuckDB oracle SQL for the web (Q*) and game (G*) report queries."""

from pathweave.oracle.game import game_levels_cte
from pathweave.oracle.web import web_journeys_cte

WJ = f"WITH {web_journeys_cte()}"
GL = f"WITH {game_levels_cte()}"
GROUPS = ("new", "active_buyer", "churned_buyer", "active_non_buyer", "churned_non_buyer")
REASONS = ("stack_full", "time_up", "pause_quit")


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def rate(num: str, den: str) -> str:
    return f"round(CAST({num} AS DOUBLE) / nullif({den}, 0), 6)"


BAND = """CASE WHEN level_id_numeric BETWEEN 1 AND 5 THEN '1-5' WHEN level_id_numeric BETWEEN 6 AND 15 THEN '6-15'
  WHEN level_id_numeric BETWEEN 16 AND 30 THEN '16-30' WHEN level_id_numeric >= 31 THEN '31+' ELSE 'unknown' END"""

_contrast = ",\n  ".join(
    f"{r6(f'avg(total_sessions) FILTER (WHERE user_group = {chr(39)}{g}{chr(39)})')} AS {g}_avg_sessions, "
    f"{r6(f'avg(total_events) FILTER (WHERE user_group = {chr(39)}{g}{chr(39)})')} AS {g}_avg_events, "
    f"{r6(f'avg(total_revenue) FILTER (WHERE user_group = {chr(39)}{g}{chr(39)})')} AS {g}_avg_revenue, "
    f"{r6(f'avg(CAST(had_add_to_cart AS INTEGER)) FILTER (WHERE user_group = {chr(39)}{g}{chr(39)})')} AS {g}_add_to_cart_rate"
    for g in GROUPS)

_signals = " UNION ALL ".join(
    f"SELECT '{n}' AS signal, coalesce({e}, false) AS has, total_purchases > 0 AS buyer FROM wj"
    for n, e in (("had_search", "had_search"), ("had_product_view", "had_product_view"),
                 ("had_add_to_cart", "had_add_to_cart"), ("multi_session", "total_sessions >= 2")))

_dominant = "CASE WHEN fails = 0 THEN NULL " + " ".join(
    f"WHEN fail_{r} = greatest(fail_stack_full, fail_time_up, fail_pause_quit) THEN '{r}'" for r in REASONS) + " END"

SQL = {
    "web_baseline": f"""{WJ}
SELECT user_group, users, {r6('users / sum(users) OVER ()')} AS share, {r6('revenue')} AS revenue, purchasers,
  {rate('purchasers', 'users')} AS purchase_rate
FROM (SELECT user_group, count(*) AS users, CAST(sum(total_revenue) AS DOUBLE) AS revenue,
  count(*) FILTER (WHERE total_purchases > 0) AS purchasers FROM wj GROUP BY user_group)""",
    "group_mix": f"""{WJ}
SELECT user_group, 'first_touch_source' AS dimension, value, users,
  {r6('users / sum(users) OVER (PARTITION BY user_group)')} AS share_in_group
FROM (SELECT user_group, first_touch_source AS value, count(*) AS users FROM wj GROUP BY user_group, first_touch_source)""",
    "group_mix_device": f"""{WJ},
t AS (SELECT user_group, count(*) AS of_all FROM wj GROUP BY user_group)
SELECT user_group, 'primary_device' AS dimension, primary_device AS value, count(*) AS users, {rate('count(*)', 'any_value(of_all)')} AS share_in_group
FROM wj JOIN t USING (user_group) GROUP BY user_group, primary_device""",
    "journey_length": f"""{WJ}
SELECT user_group, {r6('avg(total_sessions)')} AS avg_sessions, {r6('avg(total_events)')} AS avg_events,
  {r6('avg(days_active_span)')} AS avg_span_days, quantile_disc(total_sessions, 0.5) AS median_sessions,
  quantile_disc(total_sessions, 0.9) AS p90_sessions FROM wj GROUP BY user_group""",
    "time_to_purchase": f"""{WJ}
SELECT user_group, days_to_first_purchase, count(*) AS buyers FROM wj WHERE first_purchase_date IS NOT NULL
GROUP BY user_group, days_to_first_purchase""",
    "time_to_purchase_summary": f"""{WJ}
SELECT user_group, count(*) AS buyers, quantile_disc(days_to_first_purchase, 0.5) AS median_days,
  {r6('avg(days_to_first_purchase)')} AS avg_days FROM wj WHERE first_purchase_date IS NOT NULL GROUP BY user_group""",
    "sequence_positions": f"""{WJ}
, x AS (SELECT user_group, unnest(seq) AS event_name, unnest(generate_series(0, len(seq) - 1)) AS pos
  FROM (SELECT user_group, string_split(top_event_sequence, '>') AS seq FROM wj))
SELECT user_group, CAST(pos AS BIGINT) AS pos, event_name, count(*) AS users FROM x WHERE pos < 5
GROUP BY user_group, pos, event_name""",
    "friction_signals": f"""{WJ}
SELECT user_group, count(*) AS users, count(*) FILTER (WHERE cart_abandon_count > 0) AS cart_abandoners,
  CAST(sum(cart_abandon_count) AS BIGINT) AS cart_abandons,
  count(*) FILTER (WHERE had_search AND total_purchases = 0) AS searched_not_converted,
  {r6('avg(total_pageviews)')} AS avg_pageviews FROM wj GROUP BY user_group""",
    "group_contrast": f"""{WJ}
SELECT {_contrast} FROM wj""",
    "small_sample_flag": f"""{WJ}
SELECT user_group, count(*) AS users, count(*) < 30 AS is_small_sample FROM wj GROUP BY user_group""",
    "groups_at_a_glance": f"""{WJ}
SELECT user_group, users, {r6('users / sum(users) OVER ()')} AS share, {r6('avg_sessions')} AS avg_sessions,
  {r6('avg_revenue')} AS avg_revenue
FROM (SELECT user_group, count(*) AS users, avg(total_sessions) AS avg_sessions,
  avg(total_revenue) AS avg_revenue FROM wj GROUP BY user_group)""",
    "conversion_lift": f"""{WJ}
, s AS ({_signals}),
g AS (SELECT signal, count(*) FILTER (WHERE has) AS users_with,
  CAST(count(*) FILTER (WHERE has AND buyer) AS DOUBLE) / nullif(count(*) FILTER (WHERE has), 0) AS rate_with,
  CAST(count(*) FILTER (WHERE NOT has AND buyer) AS DOUBLE) / nullif(count(*) FILTER (WHERE NOT has), 0) AS rate_without
  FROM s GROUP BY signal)
SELECT signal, users_with, round(rate_with, 6) AS rate_with, round(rate_without, 6) AS rate_without,
  round(rate_with / nullif(rate_without, 0), 6) AS lift FROM g""",
    "stall_point": f"""{WJ}
, c AS (SELECT count(*) AS s0, count(*) FILTER (WHERE had_product_view) AS s1,
  count(*) FILTER (WHERE had_add_to_cart) AS s2, count(*) FILTER (WHERE had_begin_checkout) AS s3,
  count(*) FILTER (WHERE converted_this_session) AS s4 FROM ws),
st AS (SELECT 0 AS step_no, 'session' AS step, s0 AS sessions FROM c UNION ALL SELECT 1, 'product_view', s1 FROM c
  UNION ALL SELECT 2, 'add_to_cart', s2 FROM c UNION ALL SELECT 3, 'begin_checkout', s3 FROM c
  UNION ALL SELECT 4, 'purchase', s4 FROM c),
d AS (SELECT step_no, step, sessions, CAST(lag(sessions) OVER (ORDER BY step_no) - sessions AS DOUBLE)
  / nullif(lag(sessions) OVER (ORDER BY step_no), 0) AS drop_rate FROM st)
SELECT CAST(step_no AS BIGINT) AS step_no, step, sessions, round(drop_rate, 6) AS drop_rate,
  drop_rate = max(drop_rate) OVER () AS is_stall_point FROM d""",
    "underdelivering_channels": f"""{WJ}
, g AS (SELECT coalesce(first_touch_source, '(unknown)') AS channel, count(*) AS users,
  count(*) FILTER (WHERE user_group = 'churned_non_buyer') AS churned_non_buyers FROM wj GROUP BY 1),
b AS (SELECT *, CAST(churned_non_buyers AS DOUBLE) / users AS cnb_share,
  CAST(sum(churned_non_buyers) OVER () AS DOUBLE) / sum(users) OVER () AS baseline_share FROM g)
SELECT channel, users, churned_non_buyers, round(cnb_share, 6) AS cnb_share, round(baseline_share, 6) AS baseline_share,
  round(cnb_share / nullif(baseline_share, 0), 6) AS ratio_to_baseline FROM b""",
    "lost_buyer_value": f"""{WJ}
, g AS (SELECT user_group, count(*) AS users, CAST(sum(total_revenue) AS DOUBLE) AS revenue FROM wj
  WHERE user_group IN ('active_buyer', 'churned_buyer') GROUP BY user_group)
SELECT user_group, users, round(revenue, 6) AS revenue, round(revenue / users, 6) AS avg_revenue,
  round(revenue / sum(revenue) OVER (), 6) AS share_of_buyer_revenue FROM g""",
    "first_session_comparison": f"""{WJ}
, f AS (SELECT s.*, CASE WHEN j.user_group = 'new' THEN 'new'
    WHEN j.user_group IN ('active_buyer', 'churned_buyer') THEN 'buyer'
    WHEN j.user_group = 'churned_non_buyer' THEN 'churned' ELSE 'other' END AS outcome
  FROM ws s JOIN wj j ON s.user_pseudo_id = j.user_pseudo_id
  WHERE s.session_id = (SELECT arg_min(w.session_id, {{'t': w.start_us, 'id': w.session_id}}) FROM ws w WHERE w.user_pseudo_id = j.user_pseudo_id))
SELECT outcome, count(*) AS users, {r6('avg(event_count)')} AS avg_events, {r6('avg(pageview_count)')} AS avg_pageviews,
  {r6('avg(duration_seconds)')} AS avg_duration_s, {r6('avg(CAST(had_add_to_cart AS INTEGER))')} AS add_to_cart_rate,
  {r6('avg(CAST(had_search AS INTEGER))')} AS search_rate FROM f GROUP BY outcome""",
    # ------------------------------------------------------------------ game
    "game_baseline": f"""{GL}
SELECT user_group, users, {r6('users / sum(users) OVER ()')} AS share, sessions, attempts, completes,
  d1_eligible, {rate('d1_ret', 'd1_eligible')} AS d1_rate, d7_eligible, {rate('d7_ret', 'd7_eligible')} AS d7_rate,
  d30_eligible, {rate('d30_ret', 'd30_eligible')} AS d30_rate
FROM (SELECT user_group, count(*) AS users, CAST(sum(total_sessions) AS BIGINT) AS sessions,
  CAST(sum(total_attempts) AS BIGINT) AS attempts, CAST(sum(total_completes) AS BIGINT) AS completes,
  count(*) FILTER (WHERE is_eligible_for_d1) AS d1_eligible, count(*) FILTER (WHERE d1_retained) AS d1_ret,
  count(*) FILTER (WHERE is_eligible_for_d7) AS d7_eligible, count(*) FILTER (WHERE d7_retained) AS d7_ret,
  count(*) FILTER (WHERE is_eligible_for_d30) AS d30_eligible, count(*) FILTER (WHERE d30_retained) AS d30_ret
  FROM gj GROUP BY user_group)""",
    "player_groups": f"""{GL}
SELECT user_group, users, {r6('users / sum(users) OVER ()')} AS share, {r6('avg_sessions')} AS avg_sessions,
  {r6('avg_eng')} AS avg_engagement_min, {rate('d1_ret', 'd1_eligible')} AS d1_rate, d1_eligible,
  {rate('d7_ret', 'd7_eligible')} AS d7_rate, d7_eligible, median_farthest_level
FROM (SELECT user_group, count(*) AS users, avg(total_sessions) AS avg_sessions,
  avg(total_engagement_s) / 60.0 AS avg_eng,
  count(*) FILTER (WHERE is_eligible_for_d1) AS d1_eligible, count(*) FILTER (WHERE d1_retained) AS d1_ret,
  count(*) FILTER (WHERE is_eligible_for_d7) AS d7_eligible, count(*) FILTER (WHERE d7_retained) AS d7_ret,
  quantile_disc(farthest_level_numeric, 0.5) AS median_farthest_level FROM gj GROUP BY user_group)""",
    "retention_cliff": f"""{GL}
SELECT level_id, n_users_reached_churn_eligible, n_users_who_churned_here, {r6('churn_on_level_rate')} AS churn_on_level_rate,
  {r6('d1_retention_of_reachers')} AS d1_retention_of_reachers, {r6('completion_rate')} AS completion_rate
FROM gl WHERE n_users_who_churned_here >= 5 ORDER BY churn_on_level_rate DESC, level_id LIMIT 10""",
    "level_bands": f"""{GL}
, g AS (SELECT {BAND} AS band, count(*) AS attempts, count(DISTINCT level_id) AS levels,
  count(*) FILTER (WHERE outcome = 'complete') AS completes, count(*) FILTER (WHERE outcome = 'fail') AS fails,
  count(*) FILTER (WHERE outcome = 'abandoned') AS abandons,
  {", ".join(f"count(*) FILTER (WHERE outcome = 'fail' AND fail_reason = '{r}') AS fail_{r}" for r in REASONS)}
  FROM ga GROUP BY 1)
SELECT band, attempts, levels, {rate('completes', 'attempts')} AS completion_rate, {rate('fails', 'attempts')} AS fail_rate,
  {rate('abandons', 'attempts')} AS abandon_rate,
  {", ".join(f"{rate(f'fail_{r}', 'fails')} AS fail_share_{r}" for r in REASONS)},
  {_dominant} AS dominant_failure_mode FROM g""",
    "first_session_d1": f"""{GL}
SELECT CASE WHEN first_session_levels_completed >= 3 THEN '3+' ELSE CAST(first_session_levels_completed AS VARCHAR) END
  AS levels_completed_bucket, count(*) AS users, count(*) FILTER (WHERE d1_retained) AS d1_retained,
  {rate('count(*) FILTER (WHERE d1_retained)', 'count(*)')} AS d1_rate
FROM gj WHERE is_eligible_for_d1 GROUP BY 1""",
    "first_session_duration_d1": f"""{GL}
SELECT d1_retained, count(*) AS users, quantile_disc(first_session_duration_s, 0.5) AS median_first_session_duration_s
FROM gj WHERE is_eligible_for_d1 GROUP BY d1_retained""",
    "ab_arm_contrast": f"""{GL}
, l1 AS (SELECT user_pseudo_id, bool_or(outcome = 'complete') AS l1_complete FROM ga WHERE level_id_numeric = 1
  GROUP BY user_pseudo_id),
x AS (SELECT j.*, l1.l1_complete FROM gj j LEFT JOIN l1 ON j.user_pseudo_id = l1.user_pseudo_id
  WHERE j.ab_test_assignment IS NOT NULL)
SELECT ab_test_assignment AS arm, count(*) AS users, count(*) FILTER (WHERE is_eligible_for_d1) AS d1_eligible,
  {rate('count(*) FILTER (WHERE d1_retained)', 'count(*) FILTER (WHERE is_eligible_for_d1)')} AS d1_rate,
  count(*) FILTER (WHERE l1_complete IS NOT NULL) AS level1_starters,
  {rate('count(*) FILTER (WHERE l1_complete)', 'count(*) FILTER (WHERE l1_complete IS NOT NULL)')} AS level1_completion_rate,
  {r6('avg(first_session_levels_completed)')} AS avg_first_session_completed,
  count(*) FILTER (WHERE is_eligible_for_d1) < 30 AS is_small_sample
FROM x GROUP BY ab_test_assignment""",
    "fail_reason_mix": f"""{GL}
, f AS (SELECT {BAND} AS band, coalesce(fail_reason, '(none)') AS fail_reason FROM ga WHERE outcome = 'fail'),
c AS (SELECT band, fail_reason, count(*) AS fails FROM f GROUP BY band, fail_reason
  UNION ALL SELECT 'all', fail_reason, count(*) FROM f GROUP BY fail_reason)
SELECT band, fail_reason, fails, {r6('fails / sum(fails) OVER (PARTITION BY band)')} AS share FROM c""",
    "revive_saves_run": f"""{GL}
, x AS (SELECT outcome, coalesce(bool_or(coalesce(revive_count, 0) > 0) OVER (PARTITION BY user_pseudo_id, level_id
  ORDER BY attempt_start_ts_us, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS revived_before
  FROM ga)
SELECT revived_before, count(*) AS attempts, count(*) FILTER (WHERE outcome = 'complete') AS completes,
  {rate("count(*) FILTER (WHERE outcome = 'complete')", 'count(*)')} AS completion_rate FROM x GROUP BY revived_before""",
    "revive_source_mode": f"""{GL}
, t AS (SELECT count(*) AS attempts, count(*) FILTER (WHERE coalesce(revive_count, 0) > 0) AS revive_attempts FROM ga),
m AS (SELECT revive_from_popup_mode AS v, count(*) AS n FROM ga WHERE revive_from_popup_mode IS NOT NULL GROUP BY 1),
top AS (SELECT (SELECT v FROM m ORDER BY n DESC, v LIMIT 1) AS dominant_mode, (SELECT max(n) FROM m) AS dominant_n,
  (SELECT sum(n) FROM m) AS mode_n)
SELECT attempts, revive_attempts, {rate('revive_attempts', 'attempts')} AS revive_attempt_rate, dominant_mode,
  {rate('dominant_n', 'mode_n')} AS dominant_share FROM t, top""",
    "retry_streaks": f"""{GL}
, g AS (SELECT j.user_group, a.retry_streak_number, count(*) AS attempts FROM ga a JOIN gj j
  ON a.user_pseudo_id = j.user_pseudo_id WHERE j.user_group IN ('active_engaged', 'churned_progressed')
  GROUP BY j.user_group, a.retry_streak_number)
SELECT user_group, retry_streak_number, attempts, {r6('attempts / sum(attempts) OVER (PARTITION BY user_group)')} AS share
FROM g""",
    "cross_session_completion": f"""{GL}
, per AS (SELECT user_pseudo_id, level_id, session_id, min(attempt_start_ts_us) AS first_start,
  bool_or(outcome = 'fail') AS has_fail, count(*) FILTER (WHERE outcome = 'complete') AS completes
  FROM ga GROUP BY user_pseudo_id, level_id, session_id),
x AS (SELECT completes, coalesce(bool_or(has_fail) OVER (PARTITION BY user_pseudo_id, level_id
  ORDER BY first_start, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS failed_before FROM per)
SELECT CAST(sum(completes) AS BIGINT) AS completes,
  CAST(sum(CASE WHEN failed_before THEN completes ELSE 0 END) AS BIGINT) AS cross_session_completes,
  {rate('sum(CASE WHEN failed_before THEN completes ELSE 0 END)', 'sum(completes)')} AS share FROM x""",
    "stall_item_ranking": f"""{GL}
, lv AS (SELECT level_id FROM gl WHERE fail_rate_stack_full > 0 AND fail_rate_stack_full >= fail_rate_time_up
  AND fail_rate_stack_full >= fail_rate_pause_quit)
SELECT item, count(*) AS appearances FROM (SELECT unnest(stack_fail_items) AS item FROM ga
  WHERE fail_reason = 'stack_full' AND level_id IN (SELECT level_id FROM lv)) GROUP BY item""",
    "crash_by_platform": f"""{GL}
SELECT coalesce(platform, '(unknown)') AS platform, count(*) AS sessions, count(DISTINCT user_pseudo_id) AS users,
  {rate('count(*) FILTER (WHERE had_app_exception)', 'count(*)')} AS exception_session_rate,
  {rate('count(*) FILTER (WHERE had_first_open)', 'count(*)')} AS first_open_session_rate FROM gs GROUP BY 1""",
}
