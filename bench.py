"""Times every query and prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the local cores.
``prepare_tickets`` is the one-off write of the deduplicated tickets which the
other queries read; queries of the raw tables do not use it. Under ``computed``
some queries are timed without that table, each from the source for itself; they
are no part of ``value``.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from curbside import REGISTRY, TicketStages
from curbside.shared import PreparedStages, ticket_reader

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# One of each kind of plan; every query for itself would take minutes.
COMPUTED = (
    "hour_distribution",
    "top5_violation_code",
    "top10_codes_by_precinct",
    "union_by_year",
)


def seconds(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("curbside-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()

    def timed(stages: TicketStages, names: Iterable[str]) -> dict[str, float]:
        timings = {}
        for name in names:
            start = time.perf_counter()
            df = REGISTRY[name].build(stages)
            timings[name] = time.perf_counter() - start + seconds(df)
        return timings

    raw, read = ticket_reader(spark, SF_DIR)
    with tempfile.TemporaryDirectory() as folder:
        size = sum(f.stat().st_size for f in Path(SF_DIR).glob("*.parquet"))
        start = time.perf_counter()
        stages = PreparedStages(raw, folder, size, read).prepare()
        timings = {"prepare_tickets": time.perf_counter() - start, **timed(stages, REGISTRY)}
        computed = timed(TicketStages(raw, stages.years, read), COMPUTED)
    spark.stop()

    scale = re.search(r"sf([\d.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": {name: round(t, 3) for name, t in timings.items()},
                "computed": {name: round(t, 3) for name, t in computed.items()},
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
