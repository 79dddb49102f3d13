"""Hand-made raw export rows for edge-case tests."""

from datetime import datetime, timezone

from pathweave.schema import RAW_EVENT

DAY0 = int(datetime(2024, 3, 1, tzinfo=timezone.utc).timestamp()) * 1_000_000
HOUR = 3_600_000_000
DAY = 24 * HOUR


def ev(user, ts, name, params=None, eid=0, os_="android", country="US", version="1.0.0",
       device="mobile", source="google", medium="organic", revenue=None, first_touch=0):
    """One export row; ``params`` maps key -> str | int (str -> string_value, int -> int_value),
    or a list of (key, value) pairs to allow duplicate keys."""
    items = params.items() if isinstance(params, dict) else (params or [])
    ep = [(k, (v, None, None, None) if isinstance(v, str) or v is None else (None, int(v), None, None))
          for k, v in items]
    day = datetime.fromtimestamp(ts / 1e6, tz=timezone.utc).strftime("%Y%m%d")
    return (day, ts, name, user, first_touch, ep, (device, os_, "14"), (version, "app"), (country,),
            (source, medium, "c"), (revenue,), eid)


def frame(spark, rows):
    return spark.createDataFrame(rows, RAW_EVENT)
