"""Benchmark: the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, as one JSON line.

Each query is planned and run twice into a sink that discards rows; ``queries`` holds the second (warm)
time and ``cold`` the first. Names given as arguments replace the headline list; ``all`` runs everything.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from floorledger.catalogue.queries import QUERIES  # noqa: E402
from floorledger.session import local_session  # noqa: E402


# One query per kind of plan.
HEADLINE = [
    "monthly_summary", "hourly_ops", "attendant_record", "attendant_month_ops", "annual_ops", "qa_metrics",
    "monthly_summary_prizes", "attendant_record_prizes", "op_count_prizes", "annual_prizes", "mda_month", "mda_total",
    "mda_grouping_sets", "attendant_filter", "attendant_filter_table", "stored_ops", "history_prizes",
    "latest_upload_wins", "parse_dates", "header_detect", "canonical_ops", "rollup_machines", "chart_hour",
    "sheet_reports", "canonical_prizes", "header_names", "report_manifest_prizes",
]


def timed(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")}
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, **shared)
    names = sys.argv[1:] or HEADLINE
    names = list(QUERIES) if names == ["all"] else names
    spark.range(1000).selectExpr("sum(id)").collect()
    cold, warm = {}, {}
    for name in names:
        cold[name] = timed(QUERIES[name], spark, sf_dir)
        warm[name] = timed(QUERIES[name], spark, sf_dir)
        print(f"{name} cold {cold[name]} warm {warm[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total warm seconds of the benchmark queries",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
