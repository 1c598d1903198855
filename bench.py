"""Time the headline queries on $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from recurra.plans.registry import QUERIES  # noqa: E402
from recurra.session import local_session  # noqa: E402

HEADLINE = [
    "stage_counts", "episodes", "person_weeks", "wave", "followup_by_year", "crude_irr_robust",
    "piecewise_rates", "baseline_continuous_iqr", "baseline_categorical", "kruskal_h", "reason_pivot",
    "monthly_spine", "scenario_person_time", "bound_chain_join", "order_price_quantiles",
    "gee_main", "irr_table", "rate_difference",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    # One small run starts the JVM's and the Python workers' machinery.
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
