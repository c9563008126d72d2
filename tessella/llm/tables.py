"""Tables written in the shared folder that the session names, so that later steps don't compute them again."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset on a local master, as in tests, a new one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = folder or f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Bytes and rows of a batch that goes to Python workers at once.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 512


def small_batches(spark: SparkSession) -> None:
    """Keep the batches of Arrow functions small, and so the workers, whatever the length of texts and sets."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it again: lineage ends there, and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_fields(spark: SparkSession, ddl: str) -> list[pa.Field]:
    """The Arrow fields of a schema in Spark's notation."""
    return list(to_arrow_schema(T.StructType.fromDDL(ddl)))
