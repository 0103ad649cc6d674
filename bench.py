"""Times the headline queries and prints one JSON line.

The raw train/test table is staged once, as its own entry; a short query on the smallest data warms
the engine up first. A calibration run, the same on any data, is printed beside, so that runs on machines of
different speed can be compared. Every result is computed in full (``noop`` sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from ordstack.catalog import REGISTRY
from ordstack.plans import fixture

HEADLINE = (
    "b15_pairwise",
    "d1_overlap_flag",
    "d4_combine",
    "d4_combine_sparse",
    "e2_target_encode_folds",
    "e3_target_encode_oof",
    "e8_qwk_by_fold",
    "f2_assign_by_shares",
    "h1_label_encode",
    "h2_minmax_train",
    "h4_one_hot",
    "h8_learned",
    "i2_j0",
    "i3_j1",
    "i5_j3",
    "i6_j4_folds",
    "i8_j6",
    "i9_j7",
    "i10_j8",
    "i10_j8_folds",
    "i11_n1",
    "i12_n2",
    "i14_stack_esb8",
    "j1_boosted_regression",
    "j7_ordered_statistics",
    "i17_linear_chain",
    "j8_randomised_trees",
    "j9_linear_regression",
    "j10_linear_on_stack_pr",
    "j11_blend",
    "k1_fit_cutoffs",
    "k5_assign_by_shares",
)


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ordstack-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(run) -> float:
    start = time.perf_counter()
    df = run()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def calibration(spark: SparkSession):
    """A fixed aggregation over generated numbers; part of no total."""
    return spark.range(20_000_000).selectExpr("id % 100003 AS k", "sqrt(id) AS v").groupBy("k").agg({"v": "sum"})


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session()
    timed(lambda: REGISTRY["flagship_oof_kappa"].run(spark, "/root/testdata/sf0.001"))
    # the same work on any data: rounds and machines can be compared by it
    print(f"calibration {timed(lambda: calibration(spark))}", file=sys.stderr, flush=True)
    seconds = {"stage_base": timed(lambda: fixture.staged(spark, sf_dir))}
    for name in names:
        seconds[name] = timed(lambda: REGISTRY[name].run(spark, sf_dir))
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
