"""Job parameters shared by the table builders."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values that must equal the reference's for the same results.
DEFAULT_WINDOW_DAYS = 90
DEFAULT_NEW_CUTOFF_DAYS = 7
DEFAULT_CHURN_CUTOFF_DAYS = 30
WEB_SEQUENCE_CAP = 15
GAME_SEQUENCE_CAP = 20
ENGAGEMENT_CAP_MS = 7_200_000
HOOKED_MIN_COMPLETES = 3
STUCK_FAIL_RATIO = 0.7
CHURNED_EARLY_MAX_LEVEL = 3
PREVIEW_MAX_ROWS = 50
PREVIEW_MAX_CELL_CHARS = 120
SMALL_SAMPLE_USERS = 30


def resolve_cutoffs(window_days: int, new_cutoff: int = DEFAULT_NEW_CUTOFF_DAYS,
                    churn_cutoff: int = DEFAULT_CHURN_CUTOFF_DAYS) -> tuple[int, int]:
    """Clamp (new, churn) cutoffs to the window: churn <= window-1 (at least 1);
    when new >= churn, new becomes max(1, churn // 3)."""
    max_churn = max(1, window_days - 1)
    churn = min(churn_cutoff, max_churn)
    new = new_cutoff
    if new >= churn:
        new = max(1, churn // 3)
    return new, churn


@dataclass(frozen=True)
class JobParams:
    """Everything a build needs besides the data.

    ``window_days`` is the requested length; the effective window comes from
    :func:`pathweave.sources.events.resolve_window` on the data itself.
    ``attempt_bucket_us`` is the time bucket of the two-level carry-forward
    used for attempt stitching (see ``operators/asof.py``).
    """

    window_days: int = DEFAULT_WINDOW_DAYS
    new_cutoff_days: int = DEFAULT_NEW_CUTOFF_DAYS
    churn_cutoff_days: int = DEFAULT_CHURN_CUTOFF_DAYS
    web_sequence_cap: int = WEB_SEQUENCE_CAP
    game_sequence_cap: int = GAME_SEQUENCE_CAP
    engagement_cap_ms: int = ENGAGEMENT_CAP_MS
    hooked_min_completes: int = HOOKED_MIN_COMPLETES
    stuck_fail_ratio: float = STUCK_FAIL_RATIO
    churned_early_max_level: int = CHURNED_EARLY_MAX_LEVEL
    attempt_bucket_us: int = 3_600_000_000

    def with_window(self, window_days_effective: int) -> "JobParams":
        """Return params whose cutoffs are clamped to an effective window length."""
        new, churn = resolve_cutoffs(window_days_effective, self.new_cutoff_days,
                                     self.churn_cutoff_days)
        return replace(self, new_cutoff_days=new, churn_cutoff_days=churn)


# Parameters used for the synthetic test tables (30-day window, short cutoffs so
# that every user group appears).
TESTDATA_PARAMS = JobParams(new_cutoff_days=3, churn_cutoff_days=10)
