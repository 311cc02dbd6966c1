"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. Each query is run once to warm up, then three times; the
median counts. All rows are computed (noop sink), none are fetched.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from siftline import get_session
from siftline.plans import archives, candidates, files, ledgers, records, screens, streams  # noqa: F401 - register
from siftline.plans.registry import QUERIES

HEADLINE = (
    "audit_filter",
    "evidence_flags",
    "rank_designs",
    "seq_stats",
    "multiset_sig",
    "permute_shards",
    "topk_merge",
)
# the table whose rows a query's throughput is counted in
READS = {
    "audit_filter": "lineitem",
    "evidence_flags": "lineitem",
    "rank_designs": "lineitem",
    "seq_stats": "documents",
    "multiset_sig": "documents",
    "permute_shards": "documents",
    "topk_merge": "events",
}
RUNS = 3


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rates = {}, {}
    for name in names:
        run(spark, name, folder)
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(RUNS)), 3)
        if name in READS:
            rows = spark.read.parquet(f"{folder}/{READS[name]}.parquet").count()
            rates[name] = round(rows / seconds[name])
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows_per_sec": rates,
        "sf": folder.rsplit("/sf", 1)[-1],
    }
    spark.stop()
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
