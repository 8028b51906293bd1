"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], after one warm-up query, timed into
a noop sink with the cache cleared before each; the median of $BENCH_REPEATS runs counts, and their
quartiles and the environment are given beside. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import numpy as np  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from candela.plans import catalog  # noqa: E402
from candela.sources.lineage import runtime_info  # noqa: E402

NAMES = ("case_contract_audit", "lopo_true_rank", "lopo_topk", "mahalanobis_flags", "cohort_summary", "per_query_auc", "fixed_config_summary", "crossfit_selection_audit")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every, took = catalog.queries(), {}
    every["case_contract_audit"](spark, sf).write.format("noop").mode("overwrite").save()
    spread = {}
    for name in NAMES:
        runs = []
        for _ in range(int(os.environ.get("BENCH_REPEATS", "3"))):
            spark.catalog.clearCache()
            start = time.perf_counter()
            every[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        q1, took[name], q3 = (round(float(x), 3) for x in np.quantile(runs, [0.25, 0.5, 0.75]))
        spread[name] = [q1, q3]
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "quartiles": spread, "sf": sf, "environment": runtime_info(spark)}))


if __name__ == "__main__":
    main()
