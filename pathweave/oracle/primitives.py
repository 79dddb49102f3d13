"""DuckDB oracle SQL for the building-block queries."""

from pathweave.oracle.game import (game_attempts_cte, game_journeys_cte, game_levels_cte,
                                   game_sessions_cte, int_list, r6)
from pathweave.oracle.prefix import ev_cte
from pathweave.oracle.web import day_part_sql, url_path_sql, web_journeys_cte, web_sessions_cte, weekend_sql

GJ = f"WITH {game_journeys_cte()} "
GL = f"WITH {game_levels_cte()} "
GA = f"WITH {game_attempts_cte()} "
WS = f"WITH {web_sessions_cte()} "
WJ = f"WITH {web_journeys_cte()} "
EVW = f"WITH {ev_cte('web')} "
EVG = f"WITH {ev_cte('game')} "

SQL = {
    # sources
    "scan_events_window": EVW + """SELECT user_pseudo_id, event_name, event_timestamp, event_id, event_date
FROM ev WHERE event_date BETWEEN '20240105' AND '20240120' AND user_pseudo_id IS NOT NULL""",
    "date_coverage": EVW + "SELECT min(event_date) AS earliest_date, max(event_date) AS latest_date FROM ev",
    "resolve_window": EVW + """, cov AS (SELECT strptime(min(event_date), '%Y%m%d')::DATE AS e,
  strptime(max(event_date), '%Y%m%d')::DATE AS l, max(event_date) AS lraw FROM ev)
SELECT strftime(greatest(l - 6, e), '%Y%m%d') AS w_start, lraw AS w_end,
  date_diff('day', greatest(l - 6, e), l) + 1 AS window_days FROM cov""",
    "summary_profile": GL + """
SELECT 'game_sessions' AS table_name, true AS exists, count(*) AS row_count,
  CAST(min(session_date) AS VARCHAR) AS earliest, CAST(max(session_date) AS VARCHAR) AS latest FROM gs
UNION ALL SELECT 'game_level_attempts', true, count(*), CAST(min(session_date) AS VARCHAR),
  CAST(max(session_date) AS VARCHAR) FROM ga
UNION ALL SELECT 'game_user_journeys', true, count(*), NULL, NULL FROM gj
UNION ALL SELECT 'game_levels', true, count(*), NULL, NULL FROM gl""",
    "bounded_preview": WJ + """SELECT substring(user_pseudo_id, 1, 120) AS user_pseudo_id,
  substring(user_group, 1, 120) AS user_group,
  substring(CAST(first_seen_date AS VARCHAR), 1, 120) AS first_seen_date,
  substring(CAST(last_seen_date AS VARCHAR), 1, 120) AS last_seen_date, days_active_span, total_sessions,
  CAST(total_events AS BIGINT) AS total_events, CAST(total_pageviews AS BIGINT) AS total_pageviews,
  total_purchases, round(CAST(total_revenue AS DOUBLE), 6) AS total_revenue,
  substring(CAST(first_purchase_date AS VARCHAR), 1, 120) AS first_purchase_date, days_to_first_purchase,
  substring(first_touch_source, 1, 120) AS first_touch_source, substring(first_touch_medium, 1, 120) AS first_touch_medium,
  substring(first_touch_device, 1, 120) AS first_touch_device, substring(last_touch_source, 1, 120) AS last_touch_source,
  substring(last_touch_medium, 1, 120) AS last_touch_medium, substring(primary_device, 1, 120) AS primary_device,
  substring(primary_country, 1, 120) AS primary_country, substring(time_of_day_mode, 1, 120) AS time_of_day_mode,
  substring(weekday_weekend, 1, 120) AS weekday_weekend, had_search, had_product_view, had_add_to_cart,
  cart_abandon_count, substring('[' || replace(top_event_sequence, '>', ', ') || ']', 1, 120) AS top_event_sequence,
  is_eligible_for_churn
FROM wj ORDER BY user_pseudo_id LIMIT 50""",
    "bounded_preview_meta": WJ + "SELECT count(*) AS total_rows, count(*) > 50 AS truncated FROM wj",
    "session_filter_options": f"WITH {game_sessions_cte()} " + """SELECT
  array_to_string(list(DISTINCT country ORDER BY country) FILTER (WHERE country IS NOT NULL), '>') AS countries,
  array_to_string(list(DISTINCT app_version ORDER BY app_version) FILTER (WHERE app_version IS NOT NULL), '>') AS app_versions
FROM gs""",
    "empty_attempts_check": GA + """SELECT count(*) AS attempt_rows,
  CASE WHEN count(*) = 0 THEN 'game_level_attempts has 0 rows' END AS warning FROM ga""",
    # scalars
    "event_param": EVG + """SELECT event_id, ga_session_id, engagement_time_msec, fail_reason, attempt_number FROM ev""",
    "event_param_any": EVG + """SELECT event_id, level_id, stack_item_2, stack_item_last FROM ev""",
    "event_param_alias": EVG + "SELECT event_id, shop_purchase_flag FROM ev",
    "flatten_structs": EVW + """SELECT event_id, device_category, os_name, country, app_version, src AS source,
  med AS medium, round(purchase_revenue, 6) AS purchase_revenue FROM ev""",
    "parse_event_date": EVW + "SELECT event_id, event_date, CAST(event_date_parsed AS VARCHAR) AS event_date_parsed FROM ev",
    "normalize_platform": EVG + "SELECT event_id, platform FROM ev",
    "session_key": WS + "SELECT user_pseudo_id, session_id FROM ws",
    "attempt_key": GA + "SELECT attempt_id, user_pseudo_id, ga_session_id, attempt_start_ts_us AS attempt_start_ts FROM ga",
    "url_path": f"SELECT page_id, {url_path_sql('url')} AS url_path FROM pages",
    "parse_int_list": EVG + f""", b AS (SELECT event_id, {int_list('boosters_used_str')} AS arr FROM ev)
SELECT event_id, TRY_CAST(arr[1] AS BIGINT) AS b0, TRY_CAST(arr[2] AS BIGINT) AS b1,
  TRY_CAST(arr[3] AS BIGINT) AS b2, TRY_CAST(arr[4] AS BIGINT) AS b3 FROM b""",
    "leading_int": GA + "SELECT attempt_id, level_id, level_id_numeric FROM ga",
    "day_part": WS + f"""SELECT session_id, {day_part_sql('session_start_ts')} AS day_part,
  {weekend_sql('session_start_ts')} AS is_weekend FROM ws""",
    "weekday_weekend": WJ + "SELECT user_pseudo_id, weekday_weekend FROM wj",
    "capped_engagement_s": f"WITH {game_sessions_cte()} SELECT session_id, engagement_time_s FROM gs",
    "duration_seconds": WS + "SELECT session_id, duration_seconds FROM ws",
    "safe_ratio": GL + f"""SELECT level_id, {r6('completion_rate')} AS completion_rate,
  {r6('fail_rate_stack_full')} AS fail_rate_stack_full, {r6('churn_on_level_rate')} AS churn_on_level_rate FROM gl""",
    "user_day_number": GA + "SELECT attempt_id, CAST(first_open_date AS VARCHAR) AS first_open_date, user_day_number FROM ga",
    "decimal_revenue": WJ + "SELECT user_pseudo_id, round(CAST(total_revenue AS DOUBLE), 6) AS total_revenue FROM wj",
    "clean_items": EVG + """SELECT event_id, array_to_string(list_filter([stack_item_1, stack_item_2, stack_item_3,
  stack_item_last], lambda x: x IS NOT NULL AND x <> '' AND x <> '0'), '>') AS items
FROM ev""",
    # filters
    "optional_in_filter": f"WITH {game_sessions_cte()} " + """SELECT session_id, country, app_version FROM gs
WHERE country IN ('US', 'IN')""",
    "stuck_level": GJ + "SELECT user_pseudo_id, stuck_level, stuck_level_attempts FROM gj WHERE stuck_level IS NOT NULL",
    "qualify_first": WS + """SELECT user_pseudo_id, session_id FROM (SELECT *, row_number() OVER (
  PARTITION BY user_pseudo_id ORDER BY event_count DESC, start_us DESC, session_id DESC) AS rn FROM ws) WHERE rn = 1""",
    # joins
    "retention_flags": GJ + """SELECT user_pseudo_id, d1_retained, d7_retained, d30_retained, is_eligible_for_d1,
  is_eligible_for_d7, is_eligible_for_d30 FROM gj""",
    "first_session_depth": GJ + """SELECT user_pseudo_id, first_session_levels_reached,
  first_session_levels_completed FROM gj WHERE first_session_levels_reached > 0""",
    "slice_semi_join": GA + """SELECT attempt_id, session_id FROM ga
WHERE session_id IN (SELECT session_id FROM gs WHERE country = 'BR')""",
    "lateral_unnest": GA + """SELECT attempt_id, CAST(pos - 1 AS BIGINT) AS pos, item FROM (
  SELECT attempt_id, unnest(stack_fail_items) AS item, unnest(generate_series(1, len(stack_fail_items))) AS pos
  FROM ga WHERE fail_reason = 'stack_full')""",
    # aggregates
    "first_row_value": WS + "SELECT session_id, source, device_category, landing_page FROM ws",
    "top1_by": GJ + "SELECT user_pseudo_id, last_app_version, first_touch_source, first_session_id FROM gj",
    "top1_by_multi": GJ + "SELECT user_pseudo_id, farthest_level, farthest_level_numeric FROM gj",
    "top1_by_ignore_nulls": GJ + "SELECT user_pseudo_id, farthest_completed_level, ab_test_assignment FROM gj",
    "ordered_array_limit": f"WITH {game_sessions_cte(4)} " + """SELECT user_pseudo_id, ga_session_id,
  array_to_string(event_sequence, '>') AS first4 FROM gs""",
    "top_value": GJ + """SELECT user_pseudo_id, primary_platform, primary_country, primary_app_version,
  time_of_day_mode FROM gj""",
    "approx_median": GL + f"""SELECT level_id, {r6('median_duration_complete_s')} AS median_duration_complete_s,
  {r6('median_duration_fail_s')} AS median_duration_fail_s, median_attempts_to_beat, p90_attempts_to_beat FROM gl""",
    "array_concat_agg": GA + """SELECT attempt_id, coalesce(array_to_string(stack_fail_items, '>'), '') AS stack_fail_items
FROM ga""",
    "topk_array": GL + "SELECT level_id, array_to_string(top_stack_stall_items, '>') AS top_stack_stall_items FROM gl",
    "count_distinct_if": GA + """SELECT level_id, COUNT(DISTINCT user_pseudo_id) AS users,
  COUNT(DISTINCT CASE WHEN outcome = 'complete' THEN user_pseudo_id END) AS completers FROM ga GROUP BY level_id""",
    # windows
    "carry_forward": GA + """SELECT event_id, attempt_start_ts_us, attempt_level_id, latest_retry_streak FROM stitched""",
    "carry_forward_bucketed_small": GA + "SELECT event_id, attempt_start_ts_us FROM stitched",
    "partition_max": GA + "SELECT attempt_id, ab_test FROM ga",
    "is_first_attempt_ever": GA + "SELECT attempt_id, is_first_attempt_ever FROM ga",
    "session_rank": WS + """SELECT session_id,
  row_number() OVER (PARTITION BY user_pseudo_id ORDER BY start_us, session_id) AS rank_asc,
  row_number() OVER (PARTITION BY user_pseudo_id ORDER BY start_us DESC, session_id DESC) AS rank_desc FROM ws""",
}
