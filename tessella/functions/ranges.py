"""Rows dealt over tasks, tables written once, and running values over the rows of a key, however many rows it has."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session shares (spark.checkpoint.dir); in a local one on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again. For what is dear and used more than once, or filtered by what it works out: Spark
    would work it out for each use, and push the filter below it with a copy of it for each mention."""
    df.write.option("compression", "zstd").parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt evenly over tasks. For work that is dear by the row: a file is read by one task for each of its row
    groups, which may be few and are of unlike length."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def running(df: DataFrame, key: str | list[str], order: list[Column | str], path: str, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with a running "sum" or "xor" of each value over the rows of a key in order, the row itself included.

    Rows are dealt by ranges of (key, order), so that a key of very many rows is split over tasks; what runs over a
    whole key is one total for each range that it reaches. The ranges are written to `path`, a new one in a folder that
    all executors share, since sampled bounds may differ when drawn again.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ranged = df.withColumns({c: v for c, (_, v) in values.items()}).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranged.write.option("compression", "zstd").parquet(path)
    ranged = df.sparkSession.read.schema(ranged.schema).parquet(path)
    total = {c: F.bit_xor if how == "xor" else F.sum for c, (how, _) in values.items()}
    plus = {c: Column.bitwiseXOR if how == "xor" else Column.__add__ for c, (how, _) in values.items()}
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    offsets = ranged.groupBy(*keys, "_range").agg(*(total[c](c).alias(c) for c in values))
    offsets = offsets.select(*keys, "_range", *(F.coalesce(total[c](c).over(earlier), F.lit(0)).alias(f"_{c}") for c in values))
    joined = ranged.join(offsets, [*keys, "_range"])
    return joined.withColumns({c: plus[c](F.col(f"_{c}"), total[c](c).over(inside)) for c in values}).drop("_range", *(f"_{c}" for c in values))
