"""Row-level expressions (all JVM built-ins, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# URL path pattern, day-part hour bounds, weekend days.
URL_PATH_RE = r"^https?://[^/]+(/[^?#]*)"
INT_LIST_STRIP_RE = r"[\[\]\s]"
LEADING_INT_RE = r"^\d+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_event_date(c="event_date") -> Column:
    """yyyyMMdd string -> DATE (null when malformed)."""
    return F.to_date(F.try_to_timestamp(_c(c), F.lit("yyyyMMdd")))


def normalize_platform(os_col="device.operating_system") -> Column:
    os_ = _c(os_col)
    low = F.lower(F.coalesce(os_, F.lit("")))
    return (F.when(low == "android", F.lit("Android"))
            .when(low.isin("ios", "iphone os"), F.lit("iOS"))
            .when(os_.isNull() | (os_ == ""), F.lit(None).cast("string"))
            .otherwise(os_))


def session_key(user="user_pseudo_id", session="ga_session_id") -> Column:
    """Hex MD5 of user-session; null if a part is null."""
    return F.md5(F.concat(_c(user), F.lit("-"), _c(session).cast("string")))


def attempt_key(user="user_pseudo_id", session="ga_session_id", start_us="attempt_start_ts_us") -> Column:
    return F.md5(F.concat(_c(user), F.lit("-"), _c(session).cast("string"), F.lit("-"),
                          _c(start_us).cast("string")))


def url_path(url="page_location") -> Column:
    """Path part of an http(s) URL; the URL itself when it has none; '' for null."""
    u = _c(url)
    return F.coalesce(F.nullif(F.regexp_extract(u, URL_PATH_RE, 1), F.lit("")), u, F.lit(""))


def parse_int_list(s) -> Column:
    """'[1, 0,2]' -> ['1','0','2'] (brackets and whitespace stripped, split on comma)."""
    return F.split(F.regexp_replace(F.coalesce(_c(s), F.lit("")), INT_LIST_STRIP_RE, ""), ",")


def int_at(arr, i: int) -> Column:
    """Safe positional integer: null when out of range or not a number."""
    return F.get(_c(arr), i).try_cast("bigint")


def leading_int(s="level_id") -> Column:
    """Leading digits as BIGINT; null when the string does not start with a digit."""
    return F.regexp_substr(_c(s), F.lit(LEADING_INT_RE)).try_cast("bigint")


def day_part(ts="session_start_ts") -> Column:
    h = F.hour(_c(ts))
    return (F.when(h.between(5, 11), "morning").when(h.between(12, 17), "afternoon")
            .when(h.between(18, 22), "evening").otherwise("night"))


def is_weekend(ts="session_start_ts") -> Column:
    return F.dayofweek(_c(ts)).isin(1, 7)


def weekday_weekend(weekend_n="weekend_sessions", weekday_n="weekday_sessions") -> Column:
    return (F.when(_c(weekend_n) == 0, "weekday").when(_c(weekday_n) == 0, "weekend")
            .otherwise("mixed"))


def capped_engagement_s(ms="engagement_time_msec", cap_ms: int = 7_200_000) -> Column:
    """Aggregate: per-event cap, sum, milliseconds -> seconds rounded half away from zero."""
    return F.round(F.sum(F.least(F.coalesce(_c(ms), F.lit(0)), F.lit(cap_ms))) / 1000.0).cast("long")


def duration_seconds(min_us="start_us", max_us="end_us") -> Column:
    return F.round((_c(max_us) - _c(min_us)) / 1e6).cast("long")


def safe_ratio(a, b) -> Column:
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def user_day_number(day="session_date", first="first_open_date") -> Column:
    return F.datediff(_c(day), _c(first)) + 1


def decimal_revenue(revenue_sum) -> Column:
    return _c(revenue_sum).cast("decimal(38,9)")


def clean_items(*cols) -> Column:
    """Array of the given string columns without null, '' and '0'."""
    return F.filter(F.array(*[_c(c) for c in cols]),
                    lambda x: x.isNotNull() & (x != "") & (x != "0"))


def empty_string_array() -> Column:
    return F.array().cast("array<string>")


def timestamp_from_micros(us) -> Column:
    return F.timestamp_micros(_c(us))


def micros_from_timestamp(ts) -> Column:
    return F.unix_micros(_c(ts))
