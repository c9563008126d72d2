"""Stored batches: partitioned tables, pages, search, and the removal of one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEYS = ["organization_id", "batch_id"]


def store_batch(df: DataFrame, root: str, organization: str, batch: str) -> None:
    """Write a batch over its own partition only; other batches and decisions stay."""
    out = df.withColumn("organization_id", F.lit(organization)).withColumn("batch_id", F.lit(batch))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(root)


def read_batch(spark: SparkSession, root: str, organization: str, batch: str) -> DataFrame:
    return spark.read.parquet(root).where((F.col("organization_id") == organization) & (F.col("batch_id") == batch))


def drop_batch(spark: SparkSession, root: str, organization: str, batch: str) -> int:
    """Delete one named batch of an organisation, folder and files, and say how many rows it had; 0 for an unknown one."""
    n = read_batch(spark, root, organization, batch).count()
    if n:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/organization_id={organization}/batch_id={batch}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stored_batches(spark: SparkSession, root: str) -> DataFrame:
    """organization_id, batch_id and rows of all stored batches; a dropped one isn't among them."""
    return spark.read.parquet(root).groupBy(*KEYS).agg(F.count("*").alias("rows"))


def merge_products(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing with the rows of incoming, which replace rows of the same keys."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def search_rows(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows of which a value holds the term in either case; no character of the term is special."""
    text = F.array(*(F.lower(F.col(c).cast("string")) for c in columns))
    return df.where(F.exists(text, lambda v: F.coalesce(F.contains(v, F.lower(F.lit(term))), F.lit(False))))


def row_lookup(df: DataFrame, row_number: int) -> DataFrame:
    return df.where(F.col("row_number") == row_number)


def page_rows(df: DataFrame, limit: int, offset: int = 0, after: int | None = None) -> DataFrame:
    """A page by row number; for deep pages give the last row number seen instead of an offset."""
    if after is not None:
        return df.where(F.col("row_number") > after).orderBy("row_number").limit(limit)
    return df.orderBy("row_number").offset(offset).limit(limit)


def list_batches(batches: DataFrame) -> DataFrame:
    return batches.orderBy(F.desc("created_at"), F.desc("batch_id"))


def latest_batch(batches: DataFrame, *by: str) -> DataFrame:
    return batches.groupBy(*by).agg(F.max_by("batch_id", F.struct("created_at", "batch_id")).alias("batch_id"))


def fingerprint(columns: list[str]) -> Column:
    """A hash of the cells as JSON with sorted keys, nulls included."""
    return F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)
