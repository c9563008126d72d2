"""Streams: files of rows, pages and visits as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.cells import summarise_agent
from ..operators import documents, enrich, store, validate


def stream_ingest(spark: SparkSession, in_dir: str, schema: str, out_dir: str, checkpoint: str, reader: Callable[[DataFrame], DataFrame] | None = None, *, source: str = "parquet") -> StreamingQuery:
    """Enrich and validate catalogue files as they arrive, each once: the file source and checkpoint remember files, and
    an epoch overwrites its own partition, so one that is run again leaves nothing twice."""
    stream = spark.readStream.schema(schema).format(source).load(in_dir)

    def write(batch: DataFrame, epoch: int) -> None:
        done = validate.validate_batch(enrich.enrich_batch(reader(batch) if reader else batch))
        done.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(out_dir)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedupe(stream: DataFrame, time_col: str, watermark: str | None = "1 day", columns: list[str] | None = None) -> DataFrame:
    """A stream without rows of equal cells that come within the watermark; state older than that is dropped.

    Without a watermark (None) a fingerprint is remembered for good: a row is let through once, however late its repeat
    comes and however often the query is started again from its checkpoint. That state grows with the distinct rows, 64
    bytes each; it is dealt over the shuffle partitions, and with the RocksDB provider (see permanent_state) it
    lies on disk and a checkpoint writes only what has changed.
    """
    cells = [c for c in (columns or stream.columns) if c != time_col]
    marked = stream.withColumn("fingerprint", store.fingerprint(cells))
    return marked.dropDuplicates(["fingerprint"]) if watermark is None else marked.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(["fingerprint"])


def permanent_state(spark: SparkSession) -> None:
    """Keep the state of streams that are started from now on in RocksDB, with changelogs as checkpoints."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def stream_intake(stream: DataFrame, time_col: str, out_dir: str, checkpoint: str, columns: list[str] | None = None) -> StreamingQuery:
    """Write each distinct row of a stream once and for good, in out_dir; an epoch that is run again overwrites itself."""
    permanent_state(stream.sparkSession)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(out_dir)

    return stream_dedupe(stream, time_col, None, columns).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_document_facts(pages: DataFrame, rows: DataFrame, keys: list[str], out_dir: str, checkpoint: str) -> StreamingQuery:
    """Facts of pages as they arrive, and their links to catalogue rows, in out_dir/facts and out_dir/links."""

    def write(batch: DataFrame, epoch: int) -> None:
        facts = documents.extract_facts(batch)
        for name, table in (("facts", facts), ("links", documents.link_documents(facts, rows, keys))):
            table.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{out_dir}/{name}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def visits_by_hour(visits: DataFrame, width: str = "1 hour") -> DataFrame:
    """hour, browser, is_bot, visits: for a table, or for a stream with a watermark on occurred_at."""
    seen = visits.withColumn("browser", summarise_agent("user_agent"))
    out = seen.groupBy(F.window("occurred_at", width).alias("w"), "browser", F.endswith("browser", F.lit("(bot)")).alias("is_bot")).agg(F.count("*").alias("visits"))
    return out.select(F.col("w.start").alias("hour"), "browser", "is_bot", "visits")


def stream_visits(stream: DataFrame, watermark: str = "2 hours", width: str = "1 hour") -> DataFrame:
    return visits_by_hour(stream.withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).withWatermark("occurred_at", watermark), width)
