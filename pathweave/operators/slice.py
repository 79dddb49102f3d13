"""Filtered slice: the game tables recomputed for sessions of chosen countries /
app versions.  Lazy DataFrames replace the temporary tables (nothing to drop)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from pathweave.config import JobParams
from pathweave.operators import game as G


def optional_in_filter(filters: dict[str, list]) -> Column:
    """AND over dimensions of ``col IN list``; an empty or missing list means no
    restriction (blank entries are dropped first)."""
    cond = F.lit(True)
    for col, values in filters.items():
        vals = [v for v in (values or []) if v]
        if vals:
            cond = cond & F.col(col).isin(*vals)
    return cond


def filtered_slice(sessions: DataFrame, attempts: DataFrame, ufo: DataFrame, w_end: date,
                   countries: list[str] | None = None, app_versions: list[str] | None = None,
                   params: JobParams = JobParams()) -> dict[str, DataFrame]:
    """Sessions matching the filter, their attempts (semi join on session_id), and
    journeys / levels rebuilt from that subset with the same operators.

    ``is_first_attempt_ever`` keeps the value computed before filtering (literal)."""
    if not [c for c in (countries or []) if c] and not [v for v in (app_versions or []) if v]:
        raise ValueError("at least one country or app_version filter is required")
    s = sessions.where(optional_in_filter({"country": countries, "app_version": app_versions}))
    a = attempts.join(s.select("session_id"), "session_id", "left_semi")
    j = G.game_user_journeys(s, a, ufo, w_end, params)
    lv = G.game_levels(a, j)
    return {"game_sessions": s, "game_level_attempts": a, "game_user_journeys": j, "game_levels": lv}
