"""Timings of the headline queries; prints one JSON line.

BENCH_SF_DIR: scale folder; BENCH_CPUS: local threads; BENCH_QUERIES: comma list, or ``all``.
Each query is timed over building, planning and running, with its result reduced to a hash in Spark.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import session
from evalspark.catalog import REGISTRY

HEADLINE = [
    "mcq_accuracy_report", "circular_score", "circular_expand", "yesno_hallucination_report", "yesno_pair_report", "vqa_consensus", "vqa_anls",
    "doc_report", "table_denotation", "math_task_skill_report", "multilabel_report", "duration_cube", "shard_merge", "subtitle_interval_join",
    "caption_bleu", "caption_cider", "covered_text", "concat_datasets", "prompt_mcq",
]


def run(df: DataFrame) -> None:
    """Compute every column of every row without moving the rows to the driver."""
    columns = [F.col(f"`{c}`").cast("string") for c in df.columns]
    df.select(F.xxhash64(*columns).alias("h")).agg(F.bit_xor("h")).collect()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    spark: SparkSession = (
        session.builder("bench").master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(REGISTRY["mcq_accuracy_report"](spark, folder))
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        run(REGISTRY[name](spark, folder))
        times[name] = round(time.perf_counter() - start, 3)
        # Each time as it is taken, so that one slow query does not lose the others; the one JSON line goes to the standard output.
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
