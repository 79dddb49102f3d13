"""Benchmark: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS].  Prints one JSON line.

Builds write every summary table from the raw export, as a real run does, and are timed
table by table; the attempt stitch and the event-to-attempt join are also timed on their
own, from the flat events and the export. Reports then read the written tables. Mapping the synthetic
events to an export is preparation: reported apart and within total_with_prepare.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

REPORTS = [
    "filtered_slice",         # journeys + levels recomputed for a country slice
    "web_baseline", "conversion_lift", "stall_point", "first_session_comparison",
    "game_baseline", "player_groups", "retention_cliff", "level_bands",
    "revive_saves_run", "cross_session_completion",
    "funnel", "cohort_retention", "conversion_cube", "transition_matrix", "basket_pairs",
    "trend_and_anomaly", "pareto_concentration",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    # every bench run builds its tables from scratch (no reuse of stored tables)
    os.environ["PATHWEAVE_STORE_TAG"] = f"bench-{os.getpid()}-{time.time_ns()}"
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pathweave.session import get_spark
    spark = get_spark(app="pathweave-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    from pathweave.operators.game import stitch_attempts
    from pathweave.operators.qa import event_attempt_qa
    from pathweave.plans.context import Ctx
    from pathweave.plans.materialize import materialize
    from pathweave.plans.registry import all_queries
    qs = all_queries()
    times: dict[str, float] = {}
    rows: dict[str, int] = {}

    def timed(name: str, run) -> None:
        t0 = time.perf_counter()
        rows[name] = run()
        times[name] = round(time.perf_counter() - t0, 3)

    def write_nowhere(df) -> int:
        df.write.format("noop").mode("overwrite").save()
        return -1

    t0 = time.perf_counter()
    spark.range(1000).selectExpr("sum(id)").collect()
    ctx = Ctx(spark, sf_dir)
    ctx.export("web"), ctx.export("game"), ctx.window
    prepare = round(time.perf_counter() - t0, 3)
    tables: dict[str, float] = {}
    for product in ("web", "game"):
        def build(product=product) -> int:
            done = materialize(ctx, product)
            if not done["ok"]:
                raise RuntimeError(done["error"])
            tables.update({n: s.elapsed_ms / 1000 for n, s in done["stats"].items()})
            return sum(s.row_count for s in done["stats"].values())
        timed(f"materialize_{product}", build)
    alone = {"attempt_stitch": lambda: write_nowhere(stitch_attempts(ctx.gameplay, ctx.params)),
             "event_attempt_qa": lambda: write_nowhere(event_attempt_qa(ctx.raw_game, ctx.attempts, ctx.params))}
    for name, run in alone.items():
        timed(name, run)
    for name in REPORTS:
        timed(name, lambda: len(qs[name](spark, sf_dir).collect()))
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "tables": tables, "rows": rows,
                      "prepare_sec": prepare, "total_with_prepare": round(total + prepare, 3), "sf": sf}))


if __name__ == "__main__":
    main()
