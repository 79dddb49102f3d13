"""Physical-plan checks: pruning and pushdown reach the scan, the first-N branch
gets a partial WindowGroupLimit, and no table build has a Cartesian product."""

import re

import pytest

from conftest import SF_SMALL
from pyspark.sql import functions as F
from rows import DAY0, ev, frame

from pathweave.operators import game as G
from pathweave.operators import web as Wb
from pathweave.plans.context import Ctx


def formatted(spark, df) -> str:
    return spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def ctx(spark):
    return Ctx(spark, SF_SMALL)


def test_gameplay_scan_prunes_days_pushes_names_and_nested_fields(spark, ctx):
    plan = formatted(spark, G.gameplay_events(ctx.raw_game))
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "In(event_name, [custom_session_start" in plan          # IN list pushed to Parquet
    assert "IsNotNull(user_pseudo_id)" in plan
    read = plan[plan.index("ReadSchema:"):].splitlines()[0]
    assert "float_value" not in read and "double_value" not in read   # nested column pruning
    assert "device" not in read and "traffic_source" not in read


def test_gameplay_parameters_are_taken_apart_once_a_row(spark):
    raw = frame(spark, [ev("u", DAY0, "level_start", [("ga_session_id", 1), ("level_id", "3"), ("level_id", 4), ("current_level", 2)]),
                        ev("u", DAY0 + 1, "level_fail", {"ga_session_id": 1, "level_id": 5, "fail_reason": None, "boosters_used": "[1, 2]"}),
                        ev("u", DAY0 + 2, "level_fail", {"fail_reason": "no session"}), ev("u", DAY0 + 3, "level_fail", [])])
    raw = raw.union(raw.limit(1).withColumn("event_params", F.lit(None).cast(raw.schema["event_params"].dataType)))
    got = G.gameplay_events(raw)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"event_params#\d+\.key", plan)) == 1
    rows = got.orderBy("event_timestamp").select("level_id", "current_level", "fail_reason", "b_arr").collect()
    assert [tuple(r) for r in rows] == [("3", 2, None, [""]), ("5", None, None, ["1", "2"])]


def test_session_scan_reads_only_needed_struct_fields(spark, ctx):
    plan = formatted(spark, Wb.web_sessions(ctx.raw_web))
    read = plan[plan.index("ReadSchema:"):].splitlines()[0]
    assert "operating_system" not in read and "app_info" not in read
    assert "WindowGroupLimit" in plan                                # first-N pruned before the shuffle


def test_no_cartesian_products_in_table_builds(spark):
    c = Ctx(spark, SF_SMALL, materialize=False)
    for df in (c.web_sessions, c.web_journeys, c.game_sessions, c.attempts, c.game_journeys, c.game_levels):
        plan = formatted(spark, df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_attempt_stitch_is_bucketed(spark, ctx):
    plan = formatted(spark, G.stitch_attempts(G.gameplay_events(ctx.raw_game), ctx.params))
    assert "_bkt" in plan      # windows partition by (user, session, time bucket)


def test_attempt_build_reads_and_shuffles_little(spark, ctx):
    """The stitched events are read twice and the users once; few shuffles even without broadcasts; numbers by hash."""
    ctx.stitched, ctx.ufo
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = G.level_attempts(ctx.raw_game, ctx.ufo, ctx.params, ctx.stitched)._jdf.queryExecution().executedPlan().toString()
        stitch = G.stitch_attempts(ctx.gameplay, ctx.params)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("FileScan") <= 3 and plan.count("Exchange hashpartitioning") <= 5
    assert stitch.count("FileScan") <= 2 and plan.count("Exchange hashpartitioning") + stitch.count("Exchange hashpartitioning") <= 9
    measures = [line for line in plan.splitlines() if "boosters_vacuum" in line and "Aggregate(" in line]
    assert measures and all(" HashAggregate(" in line or "- HashAggregate(" in line for line in measures)
    assert not any("collect_list" in line for line in measures)


def test_qa_carries_narrow_rows(spark, ctx):
    from pathweave.operators.qa import event_attempt_qa
    plan = formatted(spark, event_attempt_qa(ctx.raw_game, ctx.attempts, ctx.params))
    windows = [b for b in plan.split("\n\n") if ") Window" in b.split("\n")[0]]
    assert windows and not any("event_params" in b or "campaign" in b for b in windows)


def test_materialize_replaces_tables_and_sees_new_days(spark, tmp_path):
    from pathweave.plans.materialize import materialize
    events = Ctx(spark, SF_SMALL).export("web").cache()
    path = str(tmp_path / "export")
    early = events.where("event_date < '20240120'")
    early.write.partitionBy("event_date").parquet(path)
    build = lambda: materialize(Ctx(spark, "unused", export_paths={"web": path}), "web")
    first = build()
    assert first["ok"] and set(first["stats"]) == set(first["tables"]) and first["window"][1] <= "20240119"
    events.where("event_date = '20240120'").write.mode("append").partitionBy("event_date").parquet(path)
    second = build()
    assert second["window"][1] == "20240120" and second["elapsed_ms"] > 0
    rows = [r["stats"]["site_sessions"].row_count for r in (first, second)]
    assert rows[1] > rows[0] and second["tables"]["site_sessions"].count() == rows[1]
    third = build()   # the same input: every table is written again
    assert third["stats"]["site_sessions"].row_count == rows[1] and third["tables"]["site_user_journeys"].count() > 0


def test_ngrams_shuffle_the_same_for_every_length(spark, ctx):
    from pathweave.operators.catalog_paths import sequence_ngrams
    plans = [formatted(spark, sequence_ngrams(ctx.web_events, n)) for n in (2, 4)]
    counts = [p.count(") Exchange\n") for p in plans]
    assert counts[0] == counts[1] <= 8


def test_export_rows_come_by_day_so_that_the_write_sorts_no_wide_rows(spark):
    """The narrow source rows are sorted before they are mapped; the write takes the order as its own, and a row without ts stays."""
    from datetime import datetime, timedelta
    from pathweave.sources.testdata import raw_frame
    types = ["view", "click", "signup", "purchase", "error"]
    rows = [(i, datetime(2024, 1, 1 + i * 7 % 9) + timedelta(minutes=i), i % 4, types[i % 5], 1.5, f'{{"k": {i}}}') for i in range(60)]
    src = spark.createDataFrame([*rows, (60, None, 1, "view", None, None)],
                                "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1)
    for product in ("web", "game"):
        plain, df = raw_frame(src, product), raw_frame(src, product, by_day=True)
        order = df._jdf.queryExecution().optimizedPlan().outputOrdering()
        assert order.size() == 1 and order.head().toString().startswith(("event_date", "_day"))
        assert not df.schema["event_date"].nullable      # else the write replaces the column and sorts again
        days = [r[0] for r in df.select("event_date").collect()]
        assert days == sorted(days) and len(set(days)) == 10
        assert sorted(map(str, df.replace("", None, "event_date").collect())) == sorted(map(str, plain.collect()))


def test_export_without_ts_is_stored_with_a_null_day(spark, tmp_path):
    from pathweave.schema import RAW_EVENT
    from pathweave.sources.store import write_table
    from pathweave.sources.testdata import raw_frame
    src = spark.createDataFrame([(1, None, 1, "view", None, '{"k": 3}')],
                                "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    write_table(raw_frame(src, "game", by_day=True), str(tmp_path / "export"), ["event_date"])
    back = spark.read.schema(RAW_EVENT).parquet(str(tmp_path / "export")).select(*RAW_EVENT.fieldNames())
    assert back.collect() == raw_frame(src, "game").collect()
