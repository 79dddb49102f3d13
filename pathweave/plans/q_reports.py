"""Registered queries: web (Q*) and game (G*) reports over the summary tables."""

from pathweave.operators import reports_game as RG
from pathweave.operators import reports_web as RW
from pathweave.plans.registry import register

# web
register("web_baseline")(lambda c: RW.web_baseline(c.web_journeys))
register("group_mix")(lambda c: RW.group_mix(c.web_journeys))
register("group_mix_device")(lambda c: RW.group_mix(c.web_journeys, "primary_device"))
register("journey_length")(lambda c: RW.journey_length(c.web_journeys))
register("time_to_purchase")(lambda c: RW.time_to_purchase(c.web_journeys))
register("time_to_purchase_summary")(lambda c: RW.time_to_purchase_summary(c.web_journeys))
register("sequence_positions")(lambda c: RW.sequence_positions(c.web_journeys))
register("friction_signals")(lambda c: RW.friction_signals(c.web_journeys))
register("group_contrast")(lambda c: RW.group_contrast(c.web_journeys))
register("small_sample_flag")(lambda c: RW.small_sample_flag(c.web_journeys))
register("groups_at_a_glance")(lambda c: RW.groups_at_a_glance(c.web_journeys))
register("conversion_lift")(lambda c: RW.conversion_lift(c.web_journeys))
register("stall_point")(lambda c: RW.stall_point(c.web_sessions))
register("underdelivering_channels")(lambda c: RW.underdelivering_channels(c.web_journeys))
register("lost_buyer_value")(lambda c: RW.lost_buyer_value(c.web_journeys))
register("first_session_comparison")(lambda c: RW.first_session_comparison(c.web_sessions, c.web_journeys))
# game
register("game_baseline")(lambda c: RG.game_baseline(c.game_journeys))
register("player_groups")(lambda c: RG.player_groups(c.game_journeys))
register("retention_cliff")(lambda c: RG.retention_cliff(c.game_levels))
register("level_bands")(lambda c: RG.level_bands(c.attempts))
register("first_session_d1")(lambda c: RG.first_session_d1(c.game_journeys))
register("first_session_duration_d1")(lambda c: RG.first_session_duration_d1(c.game_journeys))
register("ab_arm_contrast")(lambda c: RG.ab_arm_contrast(c.game_journeys, c.attempts))
register("fail_reason_mix")(lambda c: RG.fail_reason_mix(c.attempts))
register("revive_saves_run")(lambda c: RG.revive_saves_run(c.attempts))
register("revive_source_mode")(lambda c: RG.revive_source_mode(c.attempts))
register("retry_streaks")(lambda c: RG.retry_streaks(c.attempts, c.game_journeys))
register("cross_session_completion")(lambda c: RG.cross_session_completion(c.attempts))
register("stall_item_ranking")(lambda c: RG.stall_item_ranking(c.attempts, c.game_levels))
register("crash_by_platform")(lambda c: RG.crash_by_platform(c.game_sessions))
