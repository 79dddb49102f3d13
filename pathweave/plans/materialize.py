"""Build runs: write the summary tables in dependency order (create-or-replace).

Each table is written as Parquet and read back before the next one is built, as
the reference's CREATE TABLE AS chain does: journeys read sessions, not raw events.
A failure stops the run at that table; an empty attempts table is a warning only.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pathweave.plans.context import Ctx

GAME_TABLES = ("game_sessions", "game_level_attempts", "game_user_journeys", "game_levels", "game_events_test")
WEB_TABLES = ("site_sessions", "site_user_journeys")

_CTX_ATTR = {
    "game_sessions": "game_sessions", "game_level_attempts": "attempts",
    "game_user_journeys": "game_journeys", "game_levels": "game_levels", "game_events_test": "qa",
    "site_sessions": "web_sessions", "site_user_journeys": "web_journeys",
}


_KEYS = {
    "game_sessions": "session_id", "game_level_attempts": "attempt_id", "game_user_journeys": "user_pseudo_id",
    "game_levels": "level_id", "game_events_test": "event_id", "site_sessions": "session_id", "site_user_journeys": "user_pseudo_id",
}


def materialize(c: Ctx, product: str = "game") -> dict:
    """Write every table of ``product`` anew, replacing what is there.

    Returns {ok, window, tables: {name: DataFrame}, stats: {name: WriteStats}, elapsed_ms,
    warnings}, and error with the table's name if one failed; later tables are then not built.
    """
    c = c.rebuilding()
    names = GAME_TABLES if product == "game" else WEB_TABLES
    began = time.monotonic()
    out: dict = {"ok": True, "window": c.window, "tables": {}, "stats": {}, "warnings": []}
    for name in names:
        try:
            out["tables"][name] = getattr(c, _CTX_ATTR[name])
        except Exception as exc:  # noqa: BLE001 - stop at the first failing table
            out.update(ok=False, error=f"{name} could not be built: {exc}")
            break
        out["stats"][name] = c.store.stats[_CTX_ATTR[name]]
    out["elapsed_ms"] = int((time.monotonic() - began) * 1000)
    if out["ok"] and product == "game" and not out["stats"]["game_level_attempts"].row_count:
        out["warnings"].append("game_level_attempts has 0 rows")
    return out


def build_summary_counts(c: Ctx, product: str = "game") -> DataFrame:
    """For each table of a build its rows, counted while it was written, and a checksum of its keys, as read back."""
    res = materialize(c, product)
    if not res["ok"]:
        raise RuntimeError(res["error"])
    first_bits = F.conv(F.substring(F.md5(F.col("key")), 1, 8), 16, 10).cast("bigint")
    parts = [df.select(F.col(_KEYS[name]).cast("string").alias("key")).agg(F.coalesce(F.sum(first_bits), F.lit(0)).alias("key_checksum"))
             .select(F.lit(name).alias("table_name"), F.lit(res["stats"][name].row_count).cast("bigint").alias("row_count"), "key_checksum")
             for name, df in res["tables"].items()]
    return reduce(DataFrame.unionByName, parts)


def empty_attempts_check(attempts: DataFrame) -> DataFrame:
    """One row: attempt count and a warning text when there are none."""
    return attempts.agg(F.count(F.lit(1)).alias("attempt_rows")).select(
        "attempt_rows",
        F.when(F.col("attempt_rows") == 0, F.lit("game_level_attempts has 0 rows")).alias("warning"))
