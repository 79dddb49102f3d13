"""Registered queries: the summary tables themselves (tier I)."""

from pyspark.sql import functions as F

from pathweave.plans.registry import register


@register("web_sessions")
def web_sessions(c):
    return c.web_sessions


@register("web_user_journeys")
def web_user_journeys(c):
    return c.web_journeys


@register("web_user_group")
def web_user_group(c):
    return c.web_journeys.select("user_pseudo_id", "user_group")


@register("game_sessions")
def game_sessions(c):
    return c.game_sessions


@register("user_first_open")
def user_first_open(c):
    return c.ufo


@register("level_attempts")
def level_attempts(c):
    return c.attempts


@register("game_user_journeys")
def game_user_journeys(c):
    return c.game_journeys


@register("game_levels")
def game_levels(c):
    return c.game_levels


@register("filtered_slice")
def filtered_slice(c):
    from pathweave.operators.slice import filtered_slice as fs
    return fs(c.game_sessions, c.attempts, c.ufo, c.w_end, ["US", "DE"], [], c.params)["game_levels"]


@register("filtered_slice_journeys")
def filtered_slice_journeys(c):
    from pathweave.operators.slice import filtered_slice as fs
    return fs(c.game_sessions, c.attempts, c.ufo, c.w_end, ["US", "BR"], ["1.0.0", "1.2.0"],
              c.params)["game_user_journeys"]


@register("event_attempt_qa")
def event_attempt_qa(c):
    return c.qa.drop("event_params")


@register("next_start")
def next_start(c):
    from pathweave.operators.qa import next_start as ns
    return ns(c.attempts)


@register("materialize_game")
def materialize_game(c):
    from pathweave.plans.materialize import build_summary_counts
    return build_summary_counts(c, "game")


@register("materialize_web")
def materialize_web(c):
    from pathweave.plans.materialize import build_summary_counts
    return build_summary_counts(c, "web")


# Component operators of the tables, each checked on its own.
@register("attempt_outcome")
def attempt_outcome(c):
    return c.attempts.select("attempt_id", "outcome", "duration_s", "fail_reason", "stars_gained")


@register("snapshot_fallback")
def snapshot_fallback(c):
    return c.attempts.select("attempt_id", "items_cleared_perc", "objectives_left_perc", "time_left_perc",
                             "pause_max_progress_perc")


@register("booster_usage")
def booster_usage(c):
    return c.attempts.select("attempt_id", "boosters_vacuum", "boosters_spring", "boosters_fan", "boosters_ice",
                             "pre_hammer", "pre_sandglass", "end_clear_bar", "end_extra_time", "had_shop_purchase")


@register("churn_flags")
def churn_flags(c):
    return c.game_journeys.select("user_pseudo_id", "is_eligible_for_churn", "is_churned")


@register("attempt_totals")
def attempt_totals(c):
    return c.game_journeys.select("user_pseudo_id", "total_attempts", "total_completes", "total_fails",
                                  "total_abandons", "total_revives", "farthest_level", "farthest_completed_level")


@register("game_user_group")
def game_user_group(c):
    return c.game_journeys.select("user_pseudo_id", "user_group")


@register("level_difficulty")
def level_difficulty(c):
    from pathweave.operators import game as G
    counts = {"fail_stack_full_count": "fail_rate_stack_full", "fail_time_up_count": "fail_rate_time_up",
              "fail_pause_quit_count": "fail_rate_pause_quit", "attempts_with_ingame_booster": "booster_attempt_rate",
              "attempts_with_revive": "revive_attempt_rate"}
    levels = G.game_levels(c.attempts, c.game_journeys)
    sums = G.level_sums(c.attempts).select("level_id", *[F.col(f"{n}_of").alias(out) for out, n in counts.items()])
    first = G.attempts_to_beat(G.level_users(c.attempts)).select("level_id", "first_try_wins")
    return levels.join(sums, "level_id").join(first, "level_id").select(
        "level_id", "level_id_numeric", "total_attempts", "unique_starters", *G.OUTCOME_COUNTS, "first_try_wins", *G.MEDIANS, *counts, *G.AVERAGES)


@register("attempts_to_beat")
def attempts_to_beat(c):
    from pathweave.operators import game as G
    return G.attempts_to_beat(G.level_users(c.attempts)).drop("unique_starters", "first_try_wins")


@register("level_retention")
def level_retention(c):
    from pathweave.operators import game as G
    names = {"churn_able": "churn_eligible_reachers", "churn_did": "churned_here_count", "d1_able": "d1_eligible_reachers",
             "d1_did": "d1_retained_reachers", "d7_able": "d7_eligible_reachers", "d7_did": "d7_retained_reachers"}
    return G.level_retention(G.level_users(c.attempts), c.game_journeys).withColumnsRenamed(names)
