"""DuckDB oracle SQL for the web tables, written from their definitions.

Where the Spark side aggregates events by conditional sums, this side gathers the
ordered list of a session's events (and of a user's sessions) as structs and reads
every column off that list: the first entry, the last one, counts of filtered
entries. Groups come from an ordered table of rules, the first that holds.
"""

from pathweave.config import TESTDATA_PARAMS as P
from pathweave.oracle.prefix import ev_cte

URL_RE = "'^https?://[^/]+(/[^?#]*)'"
W_END = "(SELECT max(CAST(ts AS DATE)) FROM events)"

#: Session flag -> events of which one must be in the session.
WEB_FLAGS = {
    "had_search": ["view_search_results"],
    "had_product_view": ["view_item", "view_item_details"],
    "had_add_to_cart": ["add_to_cart"],
    "had_begin_checkout": ["begin_checkout"],
    "converted_this_session": ["purchase"],
}


def url_path_sql(c: str) -> str:
    return f"coalesce(nullif(regexp_extract({c}, {URL_RE}, 1), ''), {c}, '')"


def struct(**fields: str) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


def names(events: list[str]) -> str:
    return ", ".join(f"'{e}'" for e in events)


def entries(field: str, among: str = "l", where: str = "true") -> str:
    """The values of a field in the entries of a list that meet a condition (entry: e)."""
    return f"[e.{field} for e in {among} if {where}]"


def how_many(among: str, where: str) -> str:
    return f"len([1 for e in {among} if {where}])"


def has_event(events: list[str]) -> str:
    return f"list_has_any({entries('n')}, [{names(events)}])"


def first_rule(rules: list[tuple[str, str]], otherwise: str) -> str:
    """The name of the first rule that holds."""
    table = ", ".join(struct(g=f"'{g}'", holds=f"coalesce({c}, false)") for g, c in rules)
    return f"coalesce([r.g for r in [{table}] if r.holds][1], '{otherwise}')"


def most_frequent(name: str, src: str, key: str, value: str, out: str) -> str:
    """Most frequent value per key; NULL is a value, ties go to the smallest with NULL first."""
    return f"""{name} AS (
  SELECT {key}, min({struct(few='-n', known='v IS NOT NULL', v='v')}).v AS {out}
  FROM (SELECT {key}, {value} AS v, count(*) AS n FROM {src} GROUP BY ALL) GROUP BY {key})"""


def day_part_sql(ts: str) -> str:
    parts = {"night": "0, 1, 2, 3, 4, 23", "morning": "5, 6, 7, 8, 9, 10, 11", "afternoon": "12, 13, 14, 15, 16, 17",
             "evening": "18, 19, 20, 21, 22"}
    return "CASE " + " ".join(f"WHEN hour({ts}) IN ({h}) THEN '{p}'" for p, h in parts.items()) + " END"


def weekend_sql(ts: str) -> str:
    return f"(isodow({ts}) > 5)"


def week_part(weekends: str, sessions: str) -> str:
    return f"CASE {weekends} WHEN 0 THEN 'weekday' WHEN {sessions} THEN 'weekend' ELSE 'mixed' END"


def web_sessions_cte(cap: int = P.web_sequence_cap) -> str:
    entry = struct(n="event_name", t="event_timestamp", d="event_date_parsed", src="src", med="med", cmp="cmp", dev="device_category",
                   cty="country", page="page_location", path=url_path_sql("page_location"), paid="coalesce(purchase_revenue, 0)")
    flags = ",\n    ".join(f"{has_event(e)} AS {f}" for f, e in WEB_FLAGS.items())
    return f"""{ev_cte('web')},
visits AS (
  SELECT user_pseudo_id, ga_session_id, list({entry} ORDER BY event_timestamp, event_id) AS l
  FROM ev WHERE user_pseudo_id IS NOT NULL AND ga_session_id IS NOT NULL GROUP BY ALL
),
ws AS (
  SELECT md5(concat_ws('-', user_pseudo_id, ga_session_id)) AS session_id, user_pseudo_id, ga_session_id,
    list_min({entries('d')}) AS session_date, l[1].t AS start_us, make_timestamp(l[1].t) AS session_start_ts,
    l[1].src AS source, l[1].med AS medium, l[1].cmp AS campaign, l[1].dev AS device_category, l[1].cty AS country,
    l[1].page AS landing_page, len(l) AS event_count, {how_many('l', "e.n = 'page_view'")} AS pageview_count,
    CAST(round((l[-1].t - l[1].t) / 1e6) AS BIGINT) AS duration_seconds,
    {entries('n', f'l[1:{cap}]')} AS event_sequence, {entries('path', f'l[1:{cap}]')} AS page_sequence,
    {flags},
    CAST(coalesce(list_sum({entries('paid', 'l', "e.n = 'purchase'")}), 0) AS DECIMAL(38, 9)) AS revenue
  FROM visits
)"""


def web_journeys_cte(new: int = P.new_cutoff_days, churn: int = P.churn_cutoff_days) -> str:
    entry = struct(d="session_date", src="source", med="medium", dev="device_category", n="event_count", pages="pageview_count",
                   bought="converted_this_session", cart="had_add_to_cart", search="had_search", product="had_product_view", paid="revenue",
                   weekend=f"{weekend_sql('session_start_ts')}")
    fullest = struct(n="event_count", t="start_us", id="session_id", q="array_to_string(event_sequence, '>')")
    recent = f"last_seen_date > {W_END} - INTERVAL {churn} DAY"
    group = first_rule([("new", f"first_seen_date > {W_END} - INTERVAL {new} DAY"),
                        ("active_buyer", f"buys > 0 AND {recent}"), ("churned_buyer", "buys > 0"),
                        ("active_non_buyer", recent)], "churned_non_buyer")
    return f"""{web_sessions_cte()},
{most_frequent('usual_device', 'ws', 'user_pseudo_id', 'device_category', 'primary_device')},
{most_frequent('usual_country', 'ws', 'user_pseudo_id', 'country', 'primary_country')},
{most_frequent('usual_time', 'ws', 'user_pseudo_id', day_part_sql('session_start_ts'), 'time_of_day_mode')},
visitors AS (
  SELECT user_pseudo_id, list({entry} ORDER BY start_us, session_id) AS l, max({fullest}).q AS top_event_sequence
  FROM ws GROUP BY user_pseudo_id
),
dated AS (
  SELECT *, list_min({entries('d')}) AS first_seen_date, list_max({entries('d')}) AS last_seen_date,
    list_min({entries('d', 'l', 'e.bought')}) AS first_purchase_date, {how_many('l', 'e.bought')} AS buys FROM visitors
),
wj AS (
  SELECT user_pseudo_id, {group} AS user_group, first_seen_date, last_seen_date,
    last_seen_date - first_seen_date AS days_active_span, len(l) AS total_sessions,
    CAST(list_sum({entries('n')}) AS BIGINT) AS total_events, CAST(list_sum({entries('pages')}) AS BIGINT) AS total_pageviews,
    buys AS total_purchases, list_sum({entries('paid')}) AS total_revenue, first_purchase_date,
    first_purchase_date - first_seen_date AS days_to_first_purchase,
    l[1].src AS first_touch_source, l[1].med AS first_touch_medium, l[1].dev AS first_touch_device,
    l[-1].src AS last_touch_source, l[-1].med AS last_touch_medium, primary_device, primary_country, time_of_day_mode,
    {week_part(how_many('l', 'e.weekend'), 'len(l)')} AS weekday_weekend,
    list_contains({entries('search')}, true) AS had_search, list_contains({entries('product')}, true) AS had_product_view,
    list_contains({entries('cart')}, true) AS had_add_to_cart, {how_many('l', 'e.cart AND NOT e.bought')} AS cart_abandon_count,
    top_event_sequence, NOT first_seen_date > {W_END} - INTERVAL {churn} DAY AS is_eligible_for_churn
  FROM dated NATURAL JOIN usual_device NATURAL JOIN usual_country NATURAL JOIN usual_time
)"""


def key_checksum(key: str) -> str:
    """Sum over a table of the first 32 bits of its keys' MD5."""
    return f"CAST(coalesce(sum(CAST('0x' || left(md5(CAST({key} AS VARCHAR)), 8) AS BIGINT)), 0) AS BIGINT)"


def table_counts(tables: dict[str, tuple[str, str]]) -> str:
    """Row count and key checksum of tables: name -> (relation, key)."""
    return "\nUNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count, {key_checksum(k)} AS key_checksum FROM {r}"
                               for n, (r, k) in tables.items())


SQL = {
    "web_sessions": f"""WITH {web_sessions_cte()}
SELECT session_id, user_pseudo_id, CAST(session_date AS VARCHAR) AS session_date, start_us AS session_start_ts,
  source, medium, campaign, device_category, country, landing_page, event_count, pageview_count,
  duration_seconds, coalesce(array_to_string(event_sequence, '>'), '') AS event_sequence,
  coalesce(array_to_string(page_sequence, '>'), '') AS page_sequence,
  {', '.join(WEB_FLAGS)}, round(CAST(revenue AS DOUBLE), 6) AS revenue
FROM ws""",
    "web_user_journeys": f"""WITH {web_journeys_cte()}
SELECT * REPLACE (CAST(first_seen_date AS VARCHAR) AS first_seen_date, CAST(last_seen_date AS VARCHAR) AS last_seen_date,
  CAST(first_purchase_date AS VARCHAR) AS first_purchase_date, round(CAST(total_revenue AS DOUBLE), 6) AS total_revenue) FROM wj""",
    "web_user_group": f"WITH {web_journeys_cte()} SELECT user_pseudo_id, user_group FROM wj",
    "materialize_web": f"WITH {web_journeys_cte()} " + table_counts(
        {"site_sessions": ("ws", "session_id"), "site_user_journeys": ("wj", "user_pseudo_id")}),
}
