"""DuckDB oracle SQL for the game tables, written from their definitions.

Events are stitched to attempts by ASOF joins with the level starts (and retries)
of the session. Each attempt, session and user is then an ordered list of structs,
and columns are read off the list; measures of attempts and levels come from the
tables below. The Spark side uses a bucketed carry-forward and conditional sums.
"""

from pathweave.config import TESTDATA_PARAMS as P
from pathweave.oracle.prefix import ev_cte
from pathweave.oracle.web import (W_END, day_part_sql, entries, first_rule, how_many, most_frequent, names, struct, table_counts,
                                  week_part, weekend_sql)

START, DONE, FAIL = ["level_start"], ["level_complete"], ["level_fail"]
TERMINAL = [*DONE, *FAIL]
SNAPSHOT = ["fail_stack_full", "fail_time_up", "game_paused"]
REVIVE = ["revive_clear_bar", "revive_extra_time"]
GAMEPLAY = [*START, *TERMINAL, *SNAPSHOT, *REVIVE, "level_retry", "pause_quit_cancelled", "custom_session_start"]

#: Attempt column -> how the values of a field at some events make it; further event lists are fallbacks.
ATTEMPT_MEASURES = {
    "current_level_at_start": ("min", "cur", START), "retry_streak_number": ("min", "streak", START),
    "attempt_number": ("min", "num", TERMINAL), "duration_s": ("max", "secs", DONE, FAIL),
    "fail_reason": ("max", "why", FAIL), "stars_gained": ("max", "stars", DONE),
    "items_cleared_perc": ("max", "items", TERMINAL, SNAPSHOT), "objectives_left_perc": ("max", "goals", TERMINAL, SNAPSHOT),
    "time_left_perc": ("max", "time", TERMINAL, SNAPSHOT), "pause_max_progress_perc": ("max", "items", ["game_paused"]),
    "pre_boosters_chief_level": ("max", "chief", TERMINAL),
    **{f"boosters_{b}": ("max", f"b{i}", TERMINAL) for i, b in enumerate(("vacuum", "spring", "fan", "ice"), 1)},
    **{f"pre_{b}": ("bool_or", f"pre{i}", TERMINAL) for i, b in enumerate(("hammer", "sandglass"), 1)},
    **{f"end_{b}": ("max", f"end{i}", TERMINAL) for i, b in enumerate(("clear_bar", "extra_time"), 1)},
}
#: Attempt column -> events that it counts.
ATTEMPT_COUNTS = {
    "revive_count": REVIVE, "pause_count": ["game_paused"], "pause_quit_cancelled_count": ["pause_quit_cancelled"],
    "fail_stack_full_popup_count": ["fail_stack_full"], "fail_time_up_popup_count": ["fail_time_up"],
}
OUTCOMES = {"complete": "total_completes", "fail": "total_fails", "abandoned": "total_abandons"}
REASONS = ("stack_full", "time_up", "pause_quit")


def int_list(c: str) -> str:
    return f"string_split(translate(coalesce({c}, ''), '[] ' || chr(9), ''), ',')"


def nth_int(c: str, n: int) -> str:
    return f"TRY_CAST({int_list(c)}[{n}] AS BIGINT)"


def game_sessions_cte(cap: int = P.game_sequence_cap) -> str:
    entry = struct(n="event_name", t="event_timestamp", d="event_date_parsed", plat="platform", os="os_version", dev="device_category",
                   ver="app_version", app="app_bundle_id", cty="country", src="src", med="med", cmp="cmp",
                   ms=f"least(coalesce(engagement_time_msec, 0), {P.engagement_cap_ms})")
    return f"""{ev_cte('game')},
plays AS (
  SELECT user_pseudo_id, ga_session_id, list({entry} ORDER BY event_timestamp, event_id) AS l
  FROM ev WHERE user_pseudo_id IS NOT NULL AND ga_session_id IS NOT NULL GROUP BY ALL
),
gs AS (
  SELECT md5(concat_ws('-', user_pseudo_id, ga_session_id)) AS session_id, user_pseudo_id, ga_session_id,
    list_min({entries('d')}) AS session_date, l[1].t AS start_us, make_timestamp(l[1].t) AS session_start_ts,
    l[1].plat AS platform, l[1].os AS os_version, l[1].dev AS device_category, l[1].ver AS app_version, l[1].app AS app_bundle_id,
    l[1].cty AS country, l[1].src AS source, l[1].med AS medium, l[1].cmp AS campaign, len(l) AS event_count,
    CAST(round(list_sum({entries('ms')}) / 1000.0) AS BIGINT) AS engagement_time_s,
    {how_many('l', "e.n = 'screen_view'")} AS screen_view_count, {entries('n', f'l[1:{cap}]')} AS event_sequence,
    list_contains({entries('n')}, 'first_open') AS had_first_open, list_contains({entries('n')}, 'app_exception') AS had_app_exception,
    {how_many('l', "e.n = 'app_exception'")} AS app_exception_count
  FROM plays
),
ufo AS (
  SELECT user_pseudo_id, coalesce(CAST(make_timestamp(min(user_first_touch_timestamp) FILTER (WHERE user_first_touch_timestamp <> 0)) AS DATE),
    min(event_date_parsed) FILTER (WHERE event_name = 'first_open')) AS first_open_date
  FROM ev WHERE user_pseudo_id IS NOT NULL GROUP BY user_pseudo_id
)"""


def _asof(side: str, event: str, value: str, alias: str) -> str:
    """The last non-null ``value`` of an event up to each gameplay event."""
    return f"""{alias} AS (
  SELECT g.event_id, h.{value} AS v FROM gameplay g ASOF JOIN (
    SELECT user_pseudo_id, ga_session_id, o, {value} FROM gameplay WHERE event_name = '{event}' AND {value} IS NOT NULL) h
  ON g.user_pseudo_id = h.user_pseudo_id AND g.ga_session_id = h.ga_session_id AND g.o >= h.o
)"""


def _measure(how: str, field: str, *events: list[str]) -> str:
    at = [f"list_aggregate({entries(field, 'l', f'e.n IN ({names(e)})')}, '{how}')" for e in events]
    return at[0] if len(at) == 1 else f"coalesce({', '.join(at)})"


def game_attempts_cte() -> str:
    fields = {"n": "event_name", "d": "event_date_parsed", "cur": "current_level", "streak": "latest_retry_streak", "num": "attempt_number",
              "secs": "CASE event_name WHEN 'level_complete' THEN completion_time ELSE fail_time_val END", "why": "fail_reason",
              "stars": "stars_gained", "items": "items_cleared_perc", "goals": "objectives_left_perc", "time": "time_left_perc",
              "chief": "pre_boosters_chief_level", "shop": "coalesce(shop_purchase_flag, 0) > 0",
              "stack": "[x for x in [stack_item_1, stack_item_2, stack_item_3, stack_item_last] if coalesce(x, '0') NOT IN ('', '0')]"}
    fields |= {f"b{i}": nth_int("boosters_used_str", i) for i in (1, 2, 3, 4)}
    fields |= {f"pre{i}": f"{nth_int('pre_boosters_manual_used_str', i)} > 0" for i in (1, 2)}
    fields |= {f"end{i}": nth_int("end_boosters_used_str", i) for i in (1, 2)}
    counts = ", ".join(f"{how_many('l', f'e.n IN ({names(e)})')} AS {c}" for c, e in ATTEMPT_COUNTS.items())
    measures = ",\n    ".join(f"{_measure(*m)} AS {c}" for c, m in ATTEMPT_MEASURES.items())
    number = "TRY_CAST(nullif(regexp_extract(attempt_level_id, '^[0-9]+'), '') AS BIGINT)"
    key = "user_pseudo_id, ga_session_id, attempt_start_ts_us, attempt_level_id"
    return f"""{game_sessions_cte()},
gameplay AS (
  SELECT *, event_timestamp::HUGEINT * 1000000000000 + event_id AS o FROM ev
  WHERE user_pseudo_id IS NOT NULL AND ga_session_id IS NOT NULL AND event_name IN ({names(GAMEPLAY)})
),
{_asof('g', 'level_start', 'event_timestamp', 'at_start')},
{_asof('g', 'level_start', 'level_id', 'at_level')},
{_asof('g', 'level_retry', 'retry_streak_number', 'at_retry')},
stitched AS (
  SELECT g.*, s.v AS attempt_start_ts_us, l.v AS attempt_level_id, r.v AS latest_retry_streak FROM gameplay g
  LEFT JOIN at_start s USING (event_id) LEFT JOIN at_level l USING (event_id) LEFT JOIN at_retry r USING (event_id)
),
variants AS (
  SELECT user_pseudo_id, ga_session_id, max(ab_test_param) AS ab_test FROM gameplay
  WHERE event_name = 'custom_session_start' GROUP BY ALL
),
{most_frequent('popups', f"(SELECT * FROM stitched WHERE event_name IN ({names(REVIVE)}) AND from_popup IS NOT NULL)", key, 'from_popup', 'revive_from_popup_mode')},
tries AS (
  SELECT {key}, list({struct(**fields)} ORDER BY o) AS l FROM stitched
  WHERE attempt_start_ts_us IS NOT NULL AND attempt_level_id IS NOT NULL GROUP BY ALL
),
measured AS (
  SELECT md5(concat_ws('-', user_pseudo_id, ga_session_id, attempt_start_ts_us)) AS attempt_id,
    md5(concat_ws('-', user_pseudo_id, ga_session_id)) AS session_id, *, list_min({entries('d')}) AS session_date,
    [x for x in ['complete', 'fail', 'abandoned'] if x = 'abandoned' OR list_contains({entries('n')}, 'level_' || x)][1] AS outcome,
    {measures},
    {counts},
    list_contains({entries('shop')}, true) AS had_shop_purchase,
    flatten({entries('stack', 'l', "e.n = 'fail_stack_full'")}) AS stack_fail_items
  FROM tries
),
earliest AS (
  SELECT user_pseudo_id, attempt_level_id, min({struct(t='attempt_start_ts_us', id='attempt_id')}).id AS first_id FROM measured GROUP BY ALL
),
ga AS (
  SELECT m.* EXCLUDE (l, attempt_level_id), m.attempt_level_id AS level_id, {number} AS level_id_numeric, first_open_date,
    1 + (session_date - first_open_date) AS user_day_number, ab_test, revive_from_popup_mode, attempt_id = first_id AS is_first_attempt_ever
  FROM measured m LEFT JOIN ufo USING (user_pseudo_id) LEFT JOIN variants USING (user_pseudo_id, ga_session_id)
  LEFT JOIN popups USING ({key}) LEFT JOIN earliest USING (user_pseudo_id, attempt_level_id)
)"""


def journeys_body(new: int = P.new_cutoff_days, churn: int = P.churn_cutoff_days, of: str = "") -> str:
    """CTEs up to gj{of}, from gs{of} and ga{of}."""
    day = f"{W_END} - INTERVAL {churn} DAY"
    seen = struct(d="session_date", id="session_id", ver="app_version", src="source", med="medium", n="event_count", secs="engagement_time_s",
                  views="screen_view_count", opened="had_first_open", crashed="had_app_exception", crashes="app_exception_count",
                  weekend=weekend_sql("session_start_ts"))
    tried = struct(out="outcome", lvl="level_id", num="level_id_numeric", revs="revive_count", sid="session_id", ab="ab_test",
                   cur="current_level_at_start", rank=struct(known="level_id_numeric IS NOT NULL", num="coalesce(level_id_numeric, 0)", lvl="level_id"))
    groups = first_rule([
        ("new", f"first_seen_date > {W_END} - INTERVAL {new} DAY"),
        ("hooked", f"total_completes >= {P.hooked_min_completes} AND d1_retained"),
        ("active_engaged", "NOT gone AND total_completes > 0"),
        ("active_stuck", f"NOT gone AND total_attempts > 0 AND CAST(total_fails AS DOUBLE) / total_attempts >= {P.stuck_fail_ratio}"),
        ("churned_early", f"gone AND least(coalesce(farthest_level_numeric, 0) - {P.churned_early_max_level}, first_session_levels_completed) <= 0"),
        ("churned_progressed", "gone")], "other")
    kept = ", ".join(f"CASE WHEN first_seen_date + {d} <= {W_END} THEN coalesce(days[2] <= first_seen_date + {d}, false) END AS d{d}_retained, "
                     f"first_seen_date + {d} <= {W_END} AS is_eligible_for_d{d}" for d in (1, 7, 30))
    totals = ", ".join(f"{how_many('t', f'e.out = {chr(39)}{o}{chr(39)}')} AS {c}" for o, c in OUTCOMES.items())
    first = f"[e for e in t if e.sid = s[1].id]"
    return f"""{most_frequent(f'usual_platform{of}', f'gs{of}', 'user_pseudo_id', 'platform', 'primary_platform')},
{most_frequent(f'usual_country{of}', f'gs{of}', 'user_pseudo_id', 'country', 'primary_country')},
{most_frequent(f'usual_version{of}', f'gs{of}', 'user_pseudo_id', 'app_version', 'primary_app_version')},
{most_frequent(f'usual_time{of}', f'gs{of}', 'user_pseudo_id', day_part_sql('session_start_ts'), 'time_of_day_mode')},
players{of} AS (
  SELECT user_pseudo_id, list({seen} ORDER BY start_us, session_id) AS s, list_sort(list(DISTINCT session_date)) AS days
  FROM gs{of} GROUP BY user_pseudo_id
),
trials{of} AS (
  SELECT user_pseudo_id, list({tried} ORDER BY attempt_start_ts_us, attempt_id) AS t FROM ga{of} GROUP BY user_pseudo_id
),
blocked{of} AS (
  SELECT user_pseudo_id, min({struct(few='-fails', lvl='level_id')}).lvl AS stuck_level, max(fails) AS stuck_level_attempts
  FROM (SELECT user_pseudo_id, level_id, histogram(outcome) AS h, coalesce(h['fail'], 0)::BIGINT AS fails FROM ga{of} GROUP BY ALL)
  WHERE fails > 0 AND NOT list_contains(map_keys(h), 'complete') GROUP BY user_pseudo_id
),
told{of} AS (
  SELECT * EXCLUDE (t), days[1] AS first_seen_date, days[-1] AS last_seen_date, days[-1] <= {day} AS gone,
    coalesce(t, []) AS t FROM players{of} LEFT JOIN trials{of} USING (user_pseudo_id)
),
counted{of} AS (
  SELECT *, len(t) AS total_attempts, {totals}, {kept},
    coalesce(list_sum({entries('revs', 't')}), 0) AS total_revives,
    list_max({entries('rank', 't')}).lvl AS farthest_level, list_max({entries('num', 't')}) AS farthest_level_numeric,
    list_max({entries('rank', 't', "e.out = 'complete'")}).lvl AS farthest_completed_level,
    list_max({entries('num', 't', "e.out = 'complete'")}) AS farthest_completed_numeric,
    list_unique([e.lvl for e in {first}])::BIGINT AS first_session_levels_reached,
    list_unique([e.lvl for e in {first} if e.out = 'complete'])::BIGINT AS first_session_levels_completed,
    {entries('ab', 't', 'e.ab IS NOT NULL AND e.cur = 1')}[1] AS ab_test_assignment
  FROM told{of}
),
gj{of} AS (
  SELECT * EXCLUDE (s, t, days, gone), last_seen_date - first_seen_date AS days_active_span, len(s) AS total_sessions, len(days) AS days_active,
    list_sum({entries('n', 's')}) AS total_events, list_sum({entries('secs', 's')}) AS total_engagement_s,
    list_sum({entries('views', 's')}) AS total_screen_views, s[-1].ver AS last_app_version, s[1].src AS first_touch_source,
    s[1].med AS first_touch_medium, list_contains({entries('opened', 's')}, true) AS had_first_open,
    list_contains({entries('crashed', 's')}, true) AS had_app_exception, list_sum({entries('crashes', 's')}) AS total_app_exceptions,
    {week_part(how_many('s', 'e.weekend'), 'len(s)')} AS weekday_weekend, first_seen_date <= {day} AS is_eligible_for_churn,
    gone AND first_seen_date <= {day} AS is_churned, s[1].secs AS first_session_duration_s, s[1].id AS first_session_id,
    {groups} AS user_group
  FROM counted{of} LEFT JOIN ufo USING (user_pseudo_id) LEFT JOIN blocked{of} USING (user_pseudo_id)
  NATURAL JOIN usual_platform{of} NATURAL JOIN usual_country{of} NATURAL JOIN usual_version{of} NATURAL JOIN usual_time{of}
)"""


def game_journeys_cte(new: int = P.new_cutoff_days, churn: int = P.churn_cutoff_days) -> str:
    return f"{game_attempts_cte()},\n{journeys_body(new, churn)}"


def quantile_at(values: str, q: float) -> str:
    """The smallest entry that at least the share q of entries does not exceed."""
    return f"list_sort({values})[greatest(1, CAST(ceil({q} * len({values})) AS BIGINT))]"


def levels_body(of: str = "") -> str:
    """CTEs level_try{of}, level_users{of}, level_stays{of} and gl{of}, from ga{of} and gj{of}."""
    entry = struct(u="user_pseudo_id", out="outcome", why="fail_reason", first="is_first_attempt_ever", secs="duration_s", items="items_cleared_perc",
                   goals="objectives_left_perc", time="time_left_perc", stars="stars_gained", revs="coalesce(revive_count, 0)",
                   boosts="coalesce(boosters_vacuum, 0) + coalesce(boosters_spring, 0) + coalesce(boosters_fan, 0) + coalesce(boosters_ice, 0)")
    done, fail = "e.out = 'complete'", "e.out = 'fail'"
    outcomes = ", ".join(f"{how_many('l', f'e.out = {chr(39)}{o}{chr(39)}')} AS {c}" for o, c in OUTCOMES.items())
    reasons = ", ".join(f"{how_many('l', f'{fail} AND e.why = {chr(39)}{r}{chr(39)}')} AS fail_{r}_count" for r in REASONS)
    means = ", ".join(f"list_avg({entries(f, 'l', w)}) AS {c}" for c, f, w in (
        ("avg_items_cleared_perc_on_fail", "items", fail), ("avg_objectives_left_perc_on_fail", "goals", fail),
        ("avg_time_left_perc_on_fail", "time", fail), ("avg_stars_on_complete", "stars", done)))
    medians = ", ".join(f"CAST({quantile_at(entries('secs', 'l', f'{w} AND e.secs IS NOT NULL'), 0.5)} AS DOUBLE) AS median_duration_{n}_s"
                        for n, w in (("complete", done), ("fail", fail)))
    stays = ", ".join(f"count(*) FILTER (WHERE is_eligible_for_d{d}) AS d{d}_eligible_reachers, "
                      f"count(*) FILTER (WHERE d{d}_retained) AS d{d}_retained_reachers" for d in (1, 7))
    shares = {"completion_rate": ("unique_completers", "unique_starters"), "first_try_win_rate": ("first_try_wins", "unique_starters"),
              **{f"fail_rate_{r}": (f"fail_{r}_count", "total_fails") for r in REASONS}, "abandon_rate": ("total_abandons", "total_attempts"),
              "booster_attempt_rate": ("attempts_with_ingame_booster", "total_attempts"),
              "revive_attempt_rate": ("attempts_with_revive", "total_attempts"),
              "churn_on_level_rate": ("churned_here_count", "churn_eligible_reachers"),
              **{f"d{d}_retention_of_reachers": (f"d{d}_retained_reachers", f"d{d}_eligible_reachers") for d in (1, 7)}}
    rates = ", ".join(f"CAST({a} AS DOUBLE) / nullif({b}, 0) AS {c}" for c, (a, b) in shares.items())
    return f"""level_lists{of} AS (SELECT level_id, level_id_numeric, list({entry}) AS l FROM ga{of} GROUP BY ALL),
level_try{of} AS (
  SELECT level_id, level_id_numeric, len(l) AS total_attempts, list_unique({entries('u')})::BIGINT AS unique_starters, {outcomes},
    {how_many('l', f'{done} AND e.first')} AS first_try_wins, {medians}, {reasons},
    {how_many('l', 'e.boosts > 0')} AS attempts_with_ingame_booster, {how_many('l', 'e.revs > 0')} AS attempts_with_revive, {means}
  FROM level_lists{of}
),
level_user{of} AS (SELECT level_id, user_pseudo_id, list(outcome) AS o FROM ga{of} GROUP BY ALL),
beaten{of} AS (SELECT level_id, list(len(o)) AS n FROM level_user{of} WHERE list_contains(o, 'complete') GROUP BY level_id),
level_users{of} AS (
  SELECT DISTINCT level_id, coalesce(len(n), 0) AS unique_completers, {quantile_at('n', 0.5)} AS median_attempts_to_beat,
    {quantile_at('n', 0.9)} AS p90_attempts_to_beat FROM level_user{of} LEFT JOIN beaten{of} USING (level_id)
),
level_stays{of} AS (
  SELECT level_id, count(*) FILTER (WHERE is_eligible_for_churn) AS churn_eligible_reachers,
    count(*) FILTER (WHERE is_churned AND farthest_level = level_id) AS churned_here_count, {stays}
  FROM level_user{of} JOIN gj{of} USING (user_pseudo_id) GROUP BY level_id
),
stalls{of} AS (
  SELECT level_id, item, count(*) AS n FROM (SELECT level_id, unnest(stack_fail_items) AS item FROM ga{of} WHERE fail_reason = 'stack_full')
  GROUP BY ALL
),
top_stalls{of} AS (SELECT level_id, list(item ORDER BY n DESC, item)[1:5] AS top_stack_stall_items FROM stalls{of} GROUP BY level_id),
gl{of} AS (
  SELECT * REPLACE (coalesce(top_stack_stall_items, []) AS top_stack_stall_items), {rates},
    churn_eligible_reachers AS n_users_reached_churn_eligible, churned_here_count AS n_users_who_churned_here
  FROM level_try{of} LEFT JOIN level_users{of} USING (level_id) LEFT JOIN level_stays{of} USING (level_id)
  LEFT JOIN top_stalls{of} USING (level_id)
)"""


def game_levels_cte() -> str:
    return f"{game_journeys_cte()},\n{levels_body()}"


def sliced_levels_cte(countries: list[str], app_versions: list[str]) -> str:
    """Journeys and levels rebuilt from the sessions of a slice (names end in _f)."""
    tests = [f"{c} IN ({names(v)})" for c, v in (("country", countries), ("app_version", app_versions)) if v]
    return f"""{game_attempts_cte()},
gs_f AS (SELECT * FROM gs WHERE {' AND '.join(tests) or 'true'}),
ga_f AS (SELECT * FROM ga SEMI JOIN gs_f USING (session_id)),
{journeys_body(of='_f')},
{levels_body('_f')}"""


def r6(c: str) -> str:
    return f"round(CAST({c} AS DOUBLE), 6)"


GAME_SESSIONS_OUT = """session_id, user_pseudo_id, ga_session_id, CAST(session_date AS VARCHAR) AS session_date,
  start_us AS session_start_ts, platform, os_version, device_category, app_version, app_bundle_id, country,
  source, medium, campaign, event_count, engagement_time_s, screen_view_count,
  coalesce(array_to_string(event_sequence, '>'), '') AS event_sequence,
  had_first_open, had_app_exception, app_exception_count"""

ATTEMPTS_OUT = """attempt_id, user_pseudo_id, ga_session_id, session_id, CAST(session_date AS VARCHAR) AS session_date,
  attempt_start_ts_us AS attempt_start_ts, level_id, level_id_numeric, CAST(first_open_date AS VARCHAR) AS first_open_date,
  user_day_number, current_level_at_start, attempt_number, retry_streak_number, outcome, duration_s, fail_reason,
  stars_gained, items_cleared_perc, objectives_left_perc, time_left_perc, pre_boosters_chief_level,
  boosters_vacuum, boosters_spring, boosters_fan, boosters_ice, pre_hammer, pre_sandglass, end_clear_bar,
  end_extra_time, revive_count, revive_from_popup_mode, had_shop_purchase, pause_count, pause_max_progress_perc,
  pause_quit_cancelled_count, fail_stack_full_popup_count, fail_time_up_popup_count, ab_test,
  coalesce(array_to_string(stack_fail_items, '>'), '') AS stack_fail_items, is_first_attempt_ever"""

JOURNEYS_OUT = """user_pseudo_id, CAST(first_open_date AS VARCHAR) AS first_open_date,
  CAST(first_seen_date AS VARCHAR) AS first_seen_date, CAST(last_seen_date AS VARCHAR) AS last_seen_date,
  days_active_span, total_sessions, days_active, CAST(total_events AS BIGINT) AS total_events,
  CAST(total_engagement_s AS BIGINT) AS total_engagement_s, CAST(total_screen_views AS BIGINT) AS total_screen_views,
  primary_platform, primary_country, primary_app_version, last_app_version, first_touch_source, first_touch_medium,
  had_first_open, had_app_exception, CAST(total_app_exceptions AS BIGINT) AS total_app_exceptions, time_of_day_mode,
  weekday_weekend, d1_retained, d7_retained, d30_retained, is_eligible_for_d1, is_eligible_for_d7,
  is_eligible_for_d30, is_eligible_for_churn, is_churned, total_attempts, total_completes, total_fails,
  total_abandons, CAST(total_revives AS BIGINT) AS total_revives, farthest_level, farthest_level_numeric,
  farthest_completed_level, farthest_completed_numeric, first_session_levels_reached,
  first_session_levels_completed, first_session_duration_s, stuck_level, stuck_level_attempts,
  ab_test_assignment, first_session_id, user_group"""

LEVELS_OUT = f"""level_id, level_id_numeric, unique_starters, unique_completers, {r6('completion_rate')} AS completion_rate,
  {r6('first_try_win_rate')} AS first_try_win_rate, median_attempts_to_beat, p90_attempts_to_beat,
  total_attempts, total_completes, total_fails, total_abandons,
  {r6('median_duration_complete_s')} AS median_duration_complete_s, {r6('median_duration_fail_s')} AS median_duration_fail_s,
  {r6('fail_rate_stack_full')} AS fail_rate_stack_full, {r6('fail_rate_time_up')} AS fail_rate_time_up,
  {r6('fail_rate_pause_quit')} AS fail_rate_pause_quit, {r6('abandon_rate')} AS abandon_rate,
  {r6('booster_attempt_rate')} AS booster_attempt_rate, {r6('revive_attempt_rate')} AS revive_attempt_rate,
  {r6('avg_items_cleared_perc_on_fail')} AS avg_items_cleared_perc_on_fail,
  {r6('avg_objectives_left_perc_on_fail')} AS avg_objectives_left_perc_on_fail,
  {r6('avg_time_left_perc_on_fail')} AS avg_time_left_perc_on_fail,
  {r6('avg_stars_on_complete')} AS avg_stars_on_complete,
  n_users_reached_churn_eligible, n_users_who_churned_here, {r6('churn_on_level_rate')} AS churn_on_level_rate,
  d1_eligible_reachers, {r6('d1_retention_of_reachers')} AS d1_retention_of_reachers,
  d7_eligible_reachers, {r6('d7_retention_of_reachers')} AS d7_retention_of_reachers,
  array_to_string(top_stack_stall_items, '>') AS top_stack_stall_items"""

SQL = {
    "game_sessions": f"WITH {game_sessions_cte()} SELECT {GAME_SESSIONS_OUT} FROM gs",
    "user_first_open": f"""WITH {game_sessions_cte()}
SELECT user_pseudo_id, CAST(first_open_date AS VARCHAR) AS first_open_date FROM ufo""",
    "level_attempts": f"WITH {game_attempts_cte()} SELECT {ATTEMPTS_OUT} FROM ga",
    "game_user_journeys": f"WITH {game_journeys_cte()} SELECT {JOURNEYS_OUT} FROM gj",
    "game_levels": f"WITH {game_levels_cte()} SELECT {LEVELS_OUT} FROM gl",
    "filtered_slice": f"WITH {sliced_levels_cte(['US', 'DE'], [])} SELECT {LEVELS_OUT} FROM gl_f",
    "filtered_slice_journeys": f"WITH {sliced_levels_cte(['US', 'BR'], ['1.0.0', '1.2.0'])} SELECT {JOURNEYS_OUT} FROM gj_f",
    "event_attempt_qa": f"""WITH {game_attempts_cte()},
att AS (
  SELECT user_pseudo_id, ga_session_id, attempt_id, attempt_start_ts_us,
    lead(attempt_start_ts_us) OVER (PARTITION BY user_pseudo_id, ga_session_id
                                    ORDER BY attempt_start_ts_us, attempt_id) AS next_us
  FROM ga
)
SELECT e.user_pseudo_id, e.event_date, e.event_timestamp, e.event_timestamp AS event_ts, e.event_name,
  e.ga_session_id, e.user_first_touch_timestamp, a.attempt_id, e.platform, e.os_version, e.device_category,
  e.app_version, e.app_bundle_id, e.country, e.src AS source, e.med AS medium, e.cmp AS campaign, e.event_id
FROM ev e LEFT JOIN att a ON e.user_pseudo_id = a.user_pseudo_id AND e.ga_session_id = a.ga_session_id
  AND e.event_timestamp >= a.attempt_start_ts_us AND (a.next_us IS NULL OR e.event_timestamp < a.next_us)
WHERE e.user_pseudo_id IS NOT NULL""",
    "next_start": f"""WITH {game_attempts_cte()}
SELECT user_pseudo_id, ga_session_id, attempt_id, attempt_start_ts_us AS attempt_start_ts,
  lead(attempt_start_ts_us) OVER (PARTITION BY user_pseudo_id, ga_session_id
                                  ORDER BY attempt_start_ts_us, attempt_id) AS next_attempt_start_us
FROM ga""",
    "materialize_game": f"WITH {game_levels_cte()} " + table_counts({
        "game_sessions": ("gs", "session_id"), "game_level_attempts": ("ga", "attempt_id"), "game_user_journeys": ("gj", "user_pseudo_id"),
        "game_levels": ("gl", "level_id"), "game_events_test": ("(SELECT * FROM ev WHERE user_pseudo_id IS NOT NULL)", "event_id")}),
    "attempt_outcome": f"WITH {game_attempts_cte()} SELECT attempt_id, outcome, duration_s, fail_reason, stars_gained FROM ga",
    "snapshot_fallback": f"""WITH {game_attempts_cte()} SELECT attempt_id, items_cleared_perc, objectives_left_perc,
  time_left_perc, pause_max_progress_perc FROM ga""",
    "booster_usage": f"""WITH {game_attempts_cte()} SELECT attempt_id, boosters_vacuum, boosters_spring, boosters_fan,
  boosters_ice, pre_hammer, pre_sandglass, end_clear_bar, end_extra_time, had_shop_purchase FROM ga""",
    "churn_flags": f"WITH {game_journeys_cte()} SELECT user_pseudo_id, is_eligible_for_churn, is_churned FROM gj",
    "attempt_totals": f"""WITH {game_journeys_cte()} SELECT user_pseudo_id, total_attempts, total_completes, total_fails,
  total_abandons, CAST(total_revives AS BIGINT) AS total_revives, farthest_level, farthest_completed_level FROM gj""",
    "game_user_group": f"WITH {game_journeys_cte()} SELECT user_pseudo_id, user_group FROM gj",
    "level_difficulty": f"""WITH {game_levels_cte()} SELECT level_id, level_id_numeric, total_attempts, unique_starters,
  total_completes, total_fails, total_abandons, first_try_wins, {r6('median_duration_complete_s')} AS median_duration_complete_s,
  {r6('median_duration_fail_s')} AS median_duration_fail_s, fail_stack_full_count, fail_time_up_count,
  fail_pause_quit_count, attempts_with_ingame_booster, attempts_with_revive,
  {r6('avg_items_cleared_perc_on_fail')} AS avg_items_cleared_perc_on_fail,
  {r6('avg_objectives_left_perc_on_fail')} AS avg_objectives_left_perc_on_fail,
  {r6('avg_time_left_perc_on_fail')} AS avg_time_left_perc_on_fail, {r6('avg_stars_on_complete')} AS avg_stars_on_complete
FROM level_try""",
    "attempts_to_beat": f"""WITH {game_levels_cte()} SELECT level_id, unique_completers, median_attempts_to_beat,
  p90_attempts_to_beat FROM level_users""",
    "level_retention": f"""WITH {game_levels_cte()} SELECT level_id, churn_eligible_reachers, churned_here_count,
  d1_eligible_reachers, d1_retained_reachers, d7_eligible_reachers, d7_retained_reachers FROM level_stays""",
}

# An incremental build has the rows of a full one.
SQL |= {f"incremental_{to}": SQL[of] for to, of in (("game_sessions", "game_sessions"), ("game_attempts", "level_attempts"),
                                                   ("game_journeys", "game_user_journeys"), ("game_levels", "game_levels"))}
