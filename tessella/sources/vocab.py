"""Controlled vocabularies: built-in ones, files, and their exploded forms."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.cells import form
from ..resources import values as V

SCHEMA = "vocab string, ord long, canonical string, aliases array<string>, source string"
#: Beginnings of the names of vocabulary files, and the vocabulary they hold.
FILE_KINDS = [("manufacturer", "manufacturer"), ("brand", "brand"), ("categor", "category"), ("distributor", "distributor")]


def seed_entries() -> list[tuple[str, int, str, list[str], str]]:
    tables = [("manufacturer", V.MANUFACTURERS), ("brand", [x[:2] for x in V.BRANDS]), ("category", V.CATEGORIES), ("distributor", V.DISTRIBUTORS)]
    return [(kind, i, name, list(forms), "seed") for kind, table in tables for i, (name, forms) in enumerate(table)]


def seed_vocab(spark: SparkSession) -> DataFrame:
    """The built-in entries: vocab, ord (load order), canonical, aliases, source."""
    return spark.createDataFrame(seed_entries(), SCHEMA)


def forms(vocab: DataFrame) -> DataFrame:
    """A row for each written form of each entry, in its comparison form: vocab, ord, canonical, canon_form, form."""
    rows = vocab.select("vocab", "ord", "canonical", form("canonical").alias("canon_form"), F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("f"))
    return rows.select("vocab", "ord", "canonical", "canon_form", form("f").alias("form")).where("form <> ''").distinct()


def latest_forms(vocab: DataFrame) -> DataFrame:
    """One entry for each form: of entries that share a form the one loaded last."""
    return forms(vocab).groupBy("vocab", "form").agg(F.max_by(F.struct("canonical", "canon_form"), "ord").alias("e")).select("vocab", "form", "e.canonical", "e.canon_form")


def vocab_overlay(seed: DataFrame, *overrides: DataFrame) -> DataFrame:
    """All entries, later tables after earlier ones."""
    out = seed.withColumn("layer", F.lit(0))
    for k, more in enumerate(overrides, 1):
        out = out.unionByName(more.withColumn("layer", F.lit(k)))
    order = F.row_number().over(Window.partitionBy("vocab").orderBy("layer", "ord")) - 1
    return out.select("vocab", order.cast("long").alias("ord"), "canonical", "aliases", "source")


def load_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the CSV files (canonical, aliases split at |, source) and JSON files ({type, entries}) of a folder.

    A CSV's vocabulary is told by the beginning of its name; files of other names are ignored. Files count in the
    order of their names, lines in the order of the file.
    """
    name = F.lower(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1))
    kind = F.coalesce(*(F.when(name.startswith(start), F.lit(k)) for start, k in FILE_KINDS))
    parts = []
    csv = spark.read.option("header", True).option("multiLine", True).schema("canonical string, aliases string, source string").option("pathGlobFilter", "*.csv")
    rows = csv.csv(folder).select(kind.alias("vocab"), name.alias("file"), F.monotonically_increasing_id().alias("line"), F.trim("canonical").alias("canonical"), F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "").alias("aliases"), F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("file")).alias("source"))
    parts.append(rows)
    entry = "struct<type:string,entries:array<struct<canonical:string,aliases:array<string>,source:string>>>"
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    parsed = texts.select(name.alias("file"), F.from_json("value", entry).alias("j")).select(F.lower("j.type").alias("type"), "file", F.posexplode("j.entries").alias("line", "e"))
    json_kind = F.coalesce(*(F.when(F.col("type").startswith(start), F.lit(k)) for start, k in FILE_KINDS))
    parts.append(parsed.select(json_kind.alias("vocab"), "file", F.col("line").cast("long").alias("line"), "e.canonical", F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("e.source", F.lit("file")).alias("source")))
    found = parts[0].unionByName(parts[1]).where("vocab is not null and canonical <> ''")
    order = F.row_number().over(Window.partitionBy("vocab").orderBy("file", "line")) - 1
    return found.select("vocab", order.cast("long").alias("ord"), "canonical", "aliases", "source")


def reference_counts(vocab: DataFrame) -> DataFrame:
    """Entries of each vocabulary."""
    return vocab.groupBy("vocab").agg(F.count("*").alias("entries"))


def reference_usage(vocab: DataFrame, names: DataFrame) -> DataFrame:
    """vocab, canonical, forms and rows: how many rows of names (name) carry a form of each entry, for all entries.

    Rows are counted by form before they meet the vocabulary, so it is distinct forms that move."""
    counted = names.select(form("name").alias("form")).where("form <> ''").groupBy("form").agg(F.count("*").alias("n"))
    used = latest_forms(vocab).join(counted, "form", "left")
    return used.groupBy("vocab", "canonical").agg(F.count("*").alias("forms"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
