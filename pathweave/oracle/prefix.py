"""DuckDB twin of ``pathweave.sources.testdata``: the same mapping rule as flat SQL.

``ev_cte(product)`` yields CTEs ``ev_src`` and ``ev`` (one row per input event,
every parameter as its own nullable column).  Oracle queries start with
``WITH {ev_cte('game')}, ...``.
"""


def ev_cte(product: str) -> str:
    base = """
ev_src AS (
  SELECT event_id AS eid, ts, user_id AS uid, event_type AS t, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS n
  FROM events
),
ev_gen AS (
  SELECT *, (n + uid % 7) // (5 + uid % 11) AS gen,
         greatest(0, ((n + uid % 7) // (5 + uid % 11)) * (5 + uid % 11) - uid % 7) AS gen_start
  FROM ev_src
),
ev_named AS (
  SELECT *, {name} AS event_name FROM ev_gen
)"""
    if product == "web":
        name = """CASE
      WHEN t = 'view' AND k < 50 THEN 'page_view' WHEN t = 'view' THEN 'view_item'
      WHEN t = 'click' AND k < 50 THEN 'add_to_cart' WHEN t = 'click' THEN 'view_search_results'
      WHEN t = 'signup' THEN 'begin_checkout' WHEN t = 'purchase' THEN 'purchase'
      WHEN t = 'error' THEN 'error' END"""
        extra = """,
    CASE WHEN k = 1 THEN NULL
         WHEN k = 0 THEN 'https://shop.example.com'
         WHEN k % 10 = 5 THEN 'https://shop.example.com/p/' || CAST(k % 20 AS VARCHAR) || '#top'
         ELSE 'https://shop.example.com/p/' || CAST(k % 20 AS VARCHAR) || '?x=1' END AS page_location"""
    else:
        name = """CASE
      WHEN t = 'signup' THEN 'level_start' WHEN t = 'purchase' THEN 'level_complete'
      WHEN t = 'error' THEN 'level_fail'
      WHEN t = 'click' AND k < 25 THEN 'revive_clear_bar' WHEN t = 'click' AND k < 50 THEN 'revive_extra_time'
      WHEN t = 'click' AND k < 75 THEN 'fail_stack_full' WHEN t = 'click' AND k < 90 THEN 'level_retry'
      WHEN t = 'click' THEN 'custom_session_start'
      WHEN t = 'view' AND k < 50 THEN 'game_paused' WHEN t = 'view' AND k < 90 THEN 'screen_view'
      WHEN t = 'view' AND k < 95 THEN 'first_open' WHEN t = 'view' THEN 'app_exception' END"""
        term = "event_name IN ('level_complete', 'level_fail')"
        snap = "event_name IN ('level_complete', 'level_fail', 'fail_stack_full', 'game_paused')"
        extra = f""",
    CASE WHEN event_name = 'level_start' THEN CAST(eid % 9 + 1 AS VARCHAR) END AS level_id,
    CASE WHEN event_name = 'level_start' THEN eid % 9 + 1 END AS current_level,
    CASE WHEN {term} THEN k % 3 + 1 END AS attempt_number,
    CASE WHEN event_name = 'level_complete' THEN k END AS completion_time,
    CASE WHEN event_name = 'level_complete' THEN k % 4 END AS stars_gained,
    CASE WHEN event_name = 'level_fail' THEN k END AS fail_time_val,
    CASE WHEN event_name = 'level_fail' THEN
      CASE k % 3 WHEN 0 THEN 'stack_full' WHEN 1 THEN 'time_up' ELSE 'pause_quit' END END AS fail_reason,
    CASE WHEN {snap} THEN k END AS items_cleared_perc,
    CASE WHEN {snap} THEN k END AS objectives_left_perc,
    CASE WHEN {snap} THEN k END AS time_left_perc,
    CASE WHEN {term} THEN k % 6 END AS pre_boosters_chief_level,
    CASE WHEN {term} THEN '[' || CAST(k % 3 AS VARCHAR) || ',0, ' || CAST(k % 2 AS VARCHAR) || ',x]' END AS boosters_used_str,
    CASE WHEN {term} THEN '[' || CAST(k % 2 AS VARCHAR) || ', ' || CAST((k // 2) % 2 AS VARCHAR) || ']' END AS pre_boosters_manual_used_str,
    CASE WHEN {term} THEN '[' || CAST(k % 4 AS VARCHAR) || ',' || CAST(k % 3 AS VARCHAR) || ']' END AS end_boosters_used_str,
    CASE WHEN {term} AND k % 3 = 0 THEN k % 2 WHEN {term} AND k % 3 = 1 THEN (k // 3) % 2 END AS shop_purchase_flag,
    CASE WHEN event_name IN ('revive_clear_bar', 'revive_extra_time') THEN
      CASE k % 2 WHEN 0 THEN 'bar' ELSE 'time' END END AS from_popup,
    CASE WHEN event_name = 'fail_stack_full' THEN 'i' || CAST(k % 7 AS VARCHAR) END AS stack_item_1,
    CASE WHEN event_name = 'fail_stack_full' THEN '0' END AS stack_item_2,
    CASE WHEN event_name = 'fail_stack_full' THEN '' END AS stack_item_3,
    CASE WHEN event_name = 'fail_stack_full' THEN CAST(k % 5 AS VARCHAR) END AS stack_item_last,
    CASE WHEN event_name = 'level_retry' THEN k % 5 END AS retry_streak_number,
    CASE WHEN event_name = 'custom_session_start' THEN CASE uid % 2 WHEN 0 THEN 'A' ELSE 'B' END END AS ab_test_param"""
    return base.replace("{name}", name) + f""",
ev AS (
  SELECT
    eid AS event_id,
    CAST(uid AS VARCHAR) || '.' || CAST(gen AS VARCHAR) AS user_pseudo_id,
    event_name,
    epoch_us(ts) AS event_timestamp,
    strftime(ts, '%Y%m%d') AS event_date,
    CAST(ts AS DATE) AS event_date_parsed,
    CASE WHEN uid % 4 = 0 THEN 0 ELSE (1704067200 + gen_start * 86400) * 1000000 END AS user_first_touch_timestamp,
    n // 2 AS ga_session_id,
    k * 1000 + 500 AS engagement_time_msec,
    CASE eid % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device_category,
    CASE uid % 5 WHEN 0 THEN 'android' WHEN 1 THEN 'iOS' WHEN 2 THEN 'iPhone OS' WHEN 3 THEN '' END AS os_name,
    CAST(uid % 5 + 10 AS VARCHAR) AS os_version,
    '1.' || CAST(uid % 3 AS VARCHAR) || '.0' AS app_version,
    'com.example.app' AS app_bundle_id,
    CASE uid % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'BR' WHEN 3 THEN 'IN' END AS country,
    CASE uid % 4 WHEN 0 THEN 'google' WHEN 1 THEN '(direct)' WHEN 2 THEN 'news' END AS src,
    CASE uid % 4 WHEN 0 THEN 'organic' WHEN 1 THEN '(none)' WHEN 2 THEN 'email' END AS med,
    CASE uid % 4 WHEN 0 THEN 'brand' WHEN 2 THEN 'spring' END AS cmp,
    CASE WHEN t = 'purchase' THEN value END AS purchase_revenue,
    CASE
      WHEN lower(coalesce(CASE uid % 5 WHEN 0 THEN 'android' WHEN 1 THEN 'iOS' WHEN 2 THEN 'iPhone OS' WHEN 3 THEN '' END, '')) = 'android' THEN 'Android'
      WHEN lower(coalesce(CASE uid % 5 WHEN 0 THEN 'android' WHEN 1 THEN 'iOS' WHEN 2 THEN 'iPhone OS' WHEN 3 THEN '' END, '')) IN ('ios', 'iphone os') THEN 'iOS'
      ELSE NULL END AS platform{extra}
  FROM ev_named
)"""
