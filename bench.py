"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

``q_scan_*`` scan some 20 MB of program text made from the part table (each program repeated within its row) and count
segments by tag; ``mb_per_s`` in the line has the resulting throughput of each. The other queries run as registered.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftscan import queries as core
from weftscan.functions.tags import defaults
from weftscan.operators import filters
from weftscan.operators.extract import exploded, scan

SCAN = ["go", "java", "c-cpp", "python", "rust", "typescript", "ruby", "php", "csharp", "tree-typescript"]
QUERIES = ["segments_by_tag", "tag_rollup", "gap_fill", "coverage_check", "bundle_extract", "decode_entities_pages", "script_strings_pages", "issues_sorted"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rate = {}, {}

    def timed(name: str, run) -> None:
        run()  # once to compile and to start workers
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 3)

    for scanner in SCAN:
        made = core.programs(spark, sf_dir, scanner).withColumn("content", F.repeat(F.concat("content", F.lit("\n")), 20)).repartition(int(cpus) * 2).cache()
        chars = made.agg(F.sum(F.octet_length("content"))).first()[0]
        family = "syntax-tree" if scanner.startswith("tree-") else scanner
        kept = filters.filter_segments(scan(F.col("content"), scanner), None, defaults(family))
        count = lambda made=made, kept=kept: exploded(made, kept, ["file_id"]).groupBy(F.element_at("tags", -1).alias("tag")).count().collect()
        timed(f"q_scan_{scanner}", count)
        rate[scanner] = round(chars / 1e6 / seconds[f"q_scan_{scanner}"], 1)
        made.unpersist()
    for name in QUERIES:
        timed(name, lambda f=core.queries()[name]: f(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "mb_per_s": rate, "sf": sf_dir.rsplit("sf", 1)[-1].strip("/")}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
