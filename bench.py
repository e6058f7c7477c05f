"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed runs per query
(after one warm-up run); the median counts. A run covers the whole query, with the result written to
the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.plans.catalog import QUERIES  # noqa: E402
from barloom.session import get_session  # noqa: E402

HEADLINE = [
    "daily_bars",
    "daily_bars_long",
    "ingest_new_bars",
    "moving_averages",
    "macd",
    "indicators",
    "indicators_chunked",
    "score",
    "return_correlation",
    "select_top",
    "sector_prompt_batches",
    "news_recency",
    "lexicon_sentiment",
    "order_ledger",
    "market_session",
    "daily_pipeline",
]


def timed(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "barloom-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__ui__enabled="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        timed(spark, QUERIES[name], sf_dir)
        samples = [timed(spark, QUERIES[name], sf_dir) for _ in range(runs)]
        times[name] = round(statistics.median(samples), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    result = {
        "metric": "headline query time, sum of medians",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
