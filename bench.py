"""Time the headline queries; prints one JSON line.

``load_tables`` derives and stages the ticket tables from the source files; the views then
scan the staged tables, as they would after a nightly load. Each query is timed on its second
run, so that JVM warm-up is not counted.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from ticketlens import catalog
from ticketlens.plans import training
from ticketlens.plans.desk import testdata_desk
from ticketlens.session import local_session

EXTRA = [
    "kpi_summary",
    "customer_week",
    "extract_fact_ticket",
    "compliance_heatmap",
    "dashboard_kpis",
    "ranking_metrics",
    "reliability_table",
    "breach_by_dimension",
]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = local_session(cpus, memory="12g", partitions=int(cpus), shared=f"file://{shared}")
    desk = testdata_desk(spark, sf_dir)
    seconds: dict[str, float] = {}
    seconds["load_tables"] = timed(lambda: (desk.tickets, desk.history, desk.first_creation))
    for name in [*catalog.VIEW_QUERIES, *EXTRA]:
        query = catalog.QUERIES[name]
        consume(query(spark, sf_dir))
        seconds[name] = timed(lambda: consume(query(spark, sf_dir)))
    train, valid, _ = catalog._parts(desk)
    # A whole fit with validation metrics, as the published table has it.
    spec = training.Spec(params={"C": 10.0})
    seconds["train_lr"] = timed(lambda: training.fit_and_evaluate(train, valid, spec))
    for name in ("bootstrap_intervals", "feature_permutations"):
        seconds[name] = timed(lambda name=name: consume(catalog.QUERIES[name](spark, sf_dir)))
    print(
        json.dumps(
            {
                "metric": "total seconds of load, views, reports and one full model fit",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "tickets": desk.tickets.count(),
            }
        )
    )
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)


if __name__ == "__main__":
    main()
