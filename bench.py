"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds per query.

Each query runs once cold and then warm, twice or until it has had WARM_S seconds; `queries` has the medians of the warm
runs, `cold` the first ones. Each catalogue stage also runs over `part`, tiled to at least a million rows, into a noop
sink: rows_per_second.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession, functions as F

from tessella.operators import delivery, enrich, review, validate
from tessella.plans.queries import QUERIES
from tessella.plans.views import VIEWS

HEADLINE = ["match_manufacturer", "enrich_batch", "validate_batch", "route_rows", "classify", "delivery_record", "extract_facts", "link_documents", "version_diff", "latency_percentiles", "field_metrics"]
#: Seconds of a query's runs after which it isn't run again.
WARM_S = 15
TILED_ROWS = int(os.environ.get("BENCH_ROWS", 1_000_000))


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds: dict[str, float] = {}
    cold: dict[str, float] = {}

    def timed(name: str, df, again: int = 2) -> float:
        runs: list[float] = []
        while len(runs) <= 1 or len(runs) <= again and sum(runs) < WARM_S:
            start = time.perf_counter()
            df().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            if sum(runs) > 4 * WARM_S:
                break
        cold[name], seconds[name] = round(runs[0], 3), round(statistics.median(runs[1:] or runs), 3)
        return seconds[name]

    todo = {n: QUERIES[n] for n in HEADLINE}
    try:
        from tessella.llm.queries import QUERIES as llm

        import corpus_pipeline

        todo |= llm | {"pipeline": corpus_pipeline.run}
    except ModuleNotFoundError:
        pass
    for name, query in todo.items():
        timed(name, lambda q=query: q(spark, sf))

    part = spark.read.parquet(f"{sf}/part.parquet")
    copies = max(1, -(-TILED_ROWS // max(1, part.count())))
    tiles = part.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("p_partkey", F.col("p_partkey") + F.col("tile") * 10_000_000).drop("tile").repartition(int(cpus) * 4)
    rows = spark.sql(VIEWS["catalogue_v"], part=tiles).cache()
    n = rows.count()
    rate = {}
    for name, stage in (("enrich", enrich.enrich_batch), ("validate", lambda d: validate.validate_batch(enrich.enrich_batch(d))), ("route", lambda d: review.route_rows(validate.validate_batch(enrich.enrich_batch(d)))), ("deliver", delivery.delivery_record)):
        rate[name] = round(n / timed(f"tiled_{name}", lambda s=stage: s(rows)))
    print(json.dumps({"metric": "total query time", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds, "cold": cold, "cold_total": round(sum(cold.values()), 2), "sf": sf, "rows": n, "rows_per_second": rate, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
