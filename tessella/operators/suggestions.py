"""Suggested classes from outside as tables: request batches, acceptance, attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..resources import values as V
from .taxonomy import is_unresolved


def allowed_paths() -> list[str]:
    """All class paths that the rules can give, and the generic one."""
    paths = [f"{path} > {leaf}" for _, path, leaves, default, *_ in V.TAXONOMY for leaf in [*(x[2] for x in leaves), default]]
    return [*dict.fromkeys(paths), V.GENERIC_PATH]


def llm_batches(residue: DataFrame, size: int = 25, order: str = "row_number") -> DataFrame:
    """residue with request: rows in order, `size` to a request. Rows are numbered within ranges of the order and the
    ranges' sizes summed, so no task sees all rows."""
    ranged = residue.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).select("*", F.row_number().over(Window.partitionBy("_part").orderBy(order)).alias("_n"))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    out = ranged.join(before, "_part")
    return out.withColumn("request", F.floor((F.col("_n") - 1 + F.col("_before")) / size)).drop("_part", "_n", "_size", "_before")


def accept_suggestions(responses: DataFrame, allowed: list[str] | None = None, order: str = "confidence") -> DataFrame:
    """row_number, classpath, confidence (0 to 1): suggestions of a known and not generic path, the last of each row."""
    paths = [p for p in (allowed or allowed_paths()) if p != V.GENERIC_PATH]
    good = responses.where(F.col("row_number").isNotNull() & F.col("classpath").isin(paths))
    good = good.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)))))
    return good.groupBy("row_number").agg(F.max_by(F.struct("classpath", "confidence"), F.struct(order, "classpath")).alias("s")).select("row_number", "s.*")


def parse_responses(raw: DataFrame, column: str = "response") -> DataFrame:
    """Suggestions of JSON answers; answers that can't be read give none. Reasons are cut to 120 characters."""
    schema = "struct<classifications:array<struct<id:long,classpath:string,confidence:double,reasoning:string>>>"
    one = raw.select(F.explode(F.from_json(column, schema)["classifications"]).alias("c"))
    return one.select(F.col("c.id").alias("row_number"), "c.classpath", "c.confidence", F.substring("c.reasoning", 1, 120).alias("reasoning"))


def attach_suggestions(df: DataFrame, suggestions: DataFrame) -> DataFrame:
    """df (classpath) with category and category_source: the rules' class, else the suggested one, else unresolved."""
    s = suggestions.select("row_number", F.col("classpath").alias("_suggested"))
    out = df.join(s, "row_number", "left")
    open_ = is_unresolved("classpath")
    source = F.when(~open_, "deterministic").when(F.col("_suggested").isNotNull(), "ai_inferred").otherwise("unresolved")
    return out.withColumn("category_source", source).withColumn("category", F.when(open_, F.coalesce("_suggested", "classpath")).otherwise(F.col("classpath"))).drop("_suggested")
