"""Benchmark the headline operators.

Renders the log tables once from the driver tables at ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1) into parquet under the session's checkpoint
folder (setup, not timed), then times each operator over the whole table
with a ``noop`` write (every row computed, nothing collected). Runs on
``local[$BENCH_CPUS]`` and prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from logweft.functions import entities, formats, timestamps  # noqa: E402
from logweft.operators import merge, search  # noqa: E402
from logweft.session import get_session, shared_dir  # noqa: E402
from logweft.sources import render  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "3"))


def sf_of(path: str) -> str:
    base = os.path.basename(path.rstrip("/"))
    return base[2:] if base.startswith("sf") else base


def timed(fn):
    best = None
    for _ in range(REPEAT):
        t0 = time.perf_counter()
        fn()
        dt = time.perf_counter() - t0
        best = dt if best is None else min(best, dt)
    return best


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = get_session(f"local[{CPUS}]", app_name="logweft-bench",
                        shuffle_partitions=int(CPUS) * 2)
    scratch = shared_dir(spark, "bench")

    # ---- setup (not timed): log tables as parquet, as a log store holds them
    tables = {
        "access": render.access_log(spark, SF_DIR),
        "app": render.app_log(spark, SF_DIR),
        "docs": render.document_log(spark, SF_DIR),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{scratch}/{name}")
    access = spark.read.parquet(f"{scratch}/access")
    app = spark.read.parquet(f"{scratch}/app")
    docs = spark.read.parquet(f"{scratch}/docs")
    n_access, n_app, n_docs = access.count(), app.count(), docs.count()
    app_timed = timestamps.extract_timestamp(app)

    queries = {
        "extract_timestamp": (lambda: noop(timestamps.extract_timestamp(app)), n_app),
        "classify_parse_access": (lambda: noop(formats.parse_access_log(access)), n_access),
        "status_class_counts": (lambda: formats.status_class_counts(
            formats.parse_access_log(access)).collect(), n_access),
        "merge_logs_4_files": (lambda: noop(merge.merged_positions(app_timed, timed=True)), n_app),
        "search_regex": (lambda: noop(search.search_regex(docs, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")),
                         n_docs),
        "extract_entities": (lambda: noop(entities.extract_entities(docs)), n_docs),
        "token_counts": (lambda: noop(search.token_counts(docs)), n_docs),
        "flagship_end_to_end": (lambda: formats.status_class_counts(formats.parse_access_log(
            render.access_log(spark, SF_DIR, numbered=False))).collect(), n_access),
    }
    # warm the JVM once (JIT, class loading) on a small query
    formats.parse_access_log(access.limit(1000)).write.format("noop").mode("overwrite").save()

    secs, rates = {}, {}
    for name, (fn, rows) in queries.items():
        s = timed(fn)
        secs[name] = round(s, 3)
        rates[name] = round(rows / s) if s > 0 else None
    total = round(sum(secs.values()), 3)
    print(json.dumps({"metric": "total_seconds_headline_operators", "value": total, "unit": "sec",
                      "queries": secs, "lines_per_sec": rates, "sf": sf_of(SF_DIR),
                      "rows": {"access": n_access, "app": n_app, "doc_lines": n_docs},
                      "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
