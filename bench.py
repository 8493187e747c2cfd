"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the local cores. Every
query runs three times and the shortest time counts; its whole result is computed and
discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from logistra.catalog import QUERIES  # noqa: E402

HEADLINES = [
    "newton_train",
    "newton_train_wide",
    "newton_train_products",
    "newton_train_events",
    "newton_train_orders",
    "newton_train_documents",
    "newton_train_embeddings",
    "newton_by_key",
    "newton_by_key_wide",
    "newton_by_key_products",
    "newton_by_part",
    "gradient",
    "gradient_binned",
    "hessian",
    "hessian_embeddings",
    "hessian_by_key_products",
    "gradient_by_key_products",
    "vector_sum",
    "load_labelled",
    "score_prob",
    "row_gradient",
    "row_hessian_coo",
    "inverse",
    "inverse_wide",
    "adjugate_wide",
    "upper_triangle_wide",
    "matvec",
]
RUNS = 3


def run(spark: SparkSession, query: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[query](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("logistra-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {q: round(min(run(spark, q, folder) for _ in range(RUNS)), 3) for q in HEADLINES}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total of the shortest of three runs",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
                "cores": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
