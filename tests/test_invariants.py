"""Invariants of the built tables on the small synthetic data."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pathweave.operators.qa import event_attempt_qa
from pathweave.operators.slice import filtered_slice
from pathweave.operators.web import web_session_events
from pathweave.plans.context import Ctx


@pytest.fixture(scope="module")
def c(spark):
    return Ctx(spark, SF_SMALL)


def test_session_counts_add_up(c):
    n_events = web_session_events(c.raw_web).count()
    assert c.web_sessions.agg(F.sum("event_count")).first()[0] == n_events
    assert c.web_sessions.select("session_id").distinct().count() == c.web_sessions.count()


def test_attempt_outcomes_partition_attempts(c):
    a = c.attempts
    n = a.count()
    by = dict(a.groupBy("outcome").count().collect())
    assert sum(by.values()) == n and set(by) <= {"complete", "fail", "abandoned"}
    assert a.select("attempt_id").distinct().count() == n


def test_each_event_in_at_most_one_attempt(c):
    qa = event_attempt_qa(c.raw_game, c.attempts, c.params)
    assert qa.count() == c.raw_game.count()
    assert qa.select("event_id").distinct().count() == qa.count()
    # every attempt gets at least its own level_start event
    got = qa.where(F.col("attempt_id").isNotNull()).select("attempt_id").distinct().count()
    assert got == c.attempts.count()


def test_retention_gates_and_groups(c):
    j = c.game_journeys
    assert j.where(F.col("d1_retained").isNotNull() & ~F.col("is_eligible_for_d1")).count() == 0
    assert j.where(F.col("is_eligible_for_d1") & F.col("d1_retained").isNull()).count() == 0
    assert j.where(F.col("is_churned") & ~F.col("is_eligible_for_churn")).count() == 0
    assert j.groupBy("user_group").count().agg(F.sum("count")).first()[0] == j.count()
    assert c.web_journeys.groupBy("user_group").count().agg(F.sum("count")).first()[0] == c.web_journeys.count()


def test_slice_with_every_version_equals_full(c):
    versions = [r[0] for r in c.game_sessions.select("app_version").distinct().collect() if r[0]]
    s = filtered_slice(c.game_sessions, c.attempts, c.ufo, c.w_end, [], versions, c.params)
    cols = [x for x in c.game_journeys.columns]
    assert s["game_user_journeys"].select(*cols).exceptAll(c.game_journeys.select(*cols)).count() == 0
    assert s["game_level_attempts"].count() == c.attempts.count()
