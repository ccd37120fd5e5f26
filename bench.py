"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON. One warm-up, median of three."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "a1_image_failures", "j4_p22_match_failure", "r1_sample_failure_keys", "r2_mix_groups", "c3_a17_w3_abstract_factors",
    "p5_p10_p11_p12_f21_convert", "a15_multilabel_metrics", "a18_numeric_profile", "flagship_j4_a1_r1_j5_w1",
)


def main() -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    os.environ["PYTHONPATH"] = os.pathsep.join([here, os.environ.get("PYTHONPATH", "")])  # for Python workers
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sys.path.insert(0, here)
    from faultline.plans import catalog

    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        each = []
        for _ in range(4):
            began = time.time()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            each.append(time.time() - began)
        took[name] = round(statistics.median(each[1:]), 3)
    print(json.dumps({"metric": "headline queries, median of three", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
