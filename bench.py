"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local threads.
Every result row is produced, by a sink that keeps nothing. With BENCH_BUILD set, the whole batch
build with model training is timed too.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from acuity import schemas  # noqa: E402
from acuity.plans import adapters, build  # noqa: E402
from acuity.plans.catalog import CATALOG, HEADLINE  # noqa: E402
from acuity.session import session  # noqa: E402
from acuity.sources import storage  # noqa: E402


def full_build(spark, folder: str) -> float:
    """Seconds from gzip CSV files of all six tables to serving tables and a trained model."""
    raw, out = storage.scratch_path(spark, "raw"), storage.scratch_path(spark, "build")
    for name, make in adapters.RAW.items():
        rows = make(spark, folder)
        absent = [c for c in schemas.RAW_COLUMNS[name] if c not in rows.columns]
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in absent})
        rows.write.option("header", True).option("compression", "gzip").csv(
            f"{raw}/{schemas.RAW_FILES[name]}"
        )
    start = time.perf_counter()
    build.run(spark, raw, out)
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench",
        spark__master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        CATALOG[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("unit_breakdown")  # start the executor threads and load classes
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    seconds = {name: run(name) for name in names}
    if os.environ.get("BENCH_BUILD"):
        seconds["full_build"] = full_build(spark, folder)
    storage.drop_scratch(spark)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
