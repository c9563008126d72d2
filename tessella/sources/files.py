"""Feeds: delimited text, JSON, XML and plain documents; what kind a file is."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.cells import canonical_header, clean_cell
from ..resources import values as V
from . import delimited, nested

_SEPARATORS = [",", ";", "\t", "|"]
#: Lines that a header may have.
HEADER_LINES = 1_000


def route_files(files: DataFrame) -> DataFrame:
    """files (path) with extension, kind (catalogue, document, unsupported) and advice for what is refused."""
    ext = F.lower(F.regexp_extract("path", r"[^/.](\.[^./]+)$", 1))
    refused = F.coalesce(*(F.when(F.col("extension") == e, F.lit(why)) for e, why in V.REFUSED_FILES), F.when(F.col("extension") == "", "The file has no extension."), F.lit("This format isn't supported."))
    kind = F.when(F.col("extension").isin(V.CATALOGUE_FILES), "catalogue").when(F.col("extension").isin(V.DOCUMENT_FILES), "document").otherwise("unsupported")
    out = files.withColumn("extension", ext).withColumn("kind", kind)
    return out.withColumn("reason", F.when(F.col("kind") == "unsupported", refused))


def header_separator(line: str, suffix: str = ".csv") -> str:
    """The separator that gives a header most columns outside quotes; ties go to the comma. Tabs for .tsv."""
    if suffix == ".tsv":
        return "\t"
    bare, quoted = [], False
    for c in line:
        quoted ^= c == '"'
        bare.append(" " if quoted else c)
    counts = [bare.count(x) for x in _SEPARATORS]
    return _SEPARATORS[counts.index(max(counts))]


def canonicalise(df: DataFrame) -> DataFrame:
    """Columns under their canonical names; unnamed ones go, and of equal names the right-most stays."""
    last = {canonical_header(c): k for k, c in enumerate(df.columns) if canonical_header(c)}
    numbered = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return numbered.select(*(F.col(f"c{k}").alias(n) for n, k in sorted(last.items(), key=lambda x: x[1])))


def normalise(df: DataFrame, source: str, lineage: tuple[str, ...] = ("row_number",)) -> DataFrame:
    """Clean cells, drop rows without any, and add source_name; row numbers stay as they were read."""
    cells = [c for c in df.columns if c not in lineage]
    out = df.select(*lineage, F.lit(source).alias("source_name"), *(clean_cell(F.col(c).cast("string")).alias(c) for c in cells))
    return out.where(reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in cells))) if cells else out.limit(0)


def file_encodings(spark: SparkSession, path: str) -> dict[str, str]:
    """The encoding of each file with any line: UTF-8 if all its bytes are, else cp1252 if that has them all, else
    ISO-8859-1. One pass over lines, which no character crosses; a row for each file comes to the driver."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    odd = F.decode(F.col("value").cast("binary"), "ISO-8859-1").rlike("[\u0081\u008D\u008F\u0090\u009D]")
    found = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(odd).alias("odd"))
    return {r.file: "UTF-8" if r.utf8 else "ISO-8859-1" if r.odd else "cp1252" for r in found.collect()}


def _header(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """Separator and canonical names by the first record of the first file."""
    suffix = ".tsv" if path.lower().endswith(".tsv") else ".csv"
    lines = [bytes(r.b) for r in spark.read.text(path).select(F.col("value").cast("binary").alias("b")).limit(HEADER_LINES).collect()]
    if not lines:
        return ",", []
    try:
        text = [x.decode() for x in lines]
    except UnicodeDecodeError:
        text = [x.decode("ISO-8859-1").translate(str.maketrans(delimited.C1, delimited.CP1252)) for x in lines]
    text[0] = text[0].lstrip("\ufeff")
    sep = header_separator(text[0], suffix)
    return sep, [canonical_header(x) for x in next(csv.reader((x + "\n" for x in text), delimiter=sep), [])]


def read_catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or TSV feed: separator by its first line, all cells text, quoted newlines kept, short rows filled with
    nulls, cells past the header dropped. All bytes of each file tell its encoding: UTF-8, else cp1252, else ISO-8859-1.
    Files of any size are read in splits, and rows are numbered from 2 on in each file, without a shuffle of rows."""
    sep, names = _header(spark, path)
    columns = [f"c{k}" for k in range(max(len(names), 1))]
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    rows = delimited.records(spark, path, sep).where("number > 0")
    cells = rows.select((F.col("number") + 1).cast("int").alias("row_number"), F.from_csv("record", ", ".join(f"{c} string" for c in columns), options).alias("r"))
    last = {n: k for k, n in enumerate(names) if n}
    named = [F.col(f"r.c{k}").alias(n) for n, k in sorted(last.items(), key=lambda x: x[1])]
    return normalise(cells.select("row_number", *named), path.rsplit("/", 1)[-1])


def _numbered(df: DataFrame) -> DataFrame:
    """df, whose __id is monotonically_increasing_id(), with row_number from 2 on in its place. Only a count for each
    partition is brought together; rows stay where they are read."""
    part, place = F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND((1 << 33) - 1)
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = df.groupBy(part).count().select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    placed = df.withColumn("__part", F.shiftright("__id", 33)).join(F.broadcast(starts), "__part")
    return placed.withColumn("row_number", (F.col("__start") + place + 2).cast("int")).drop("__part", "__start", "__id")


MAX_JSON_COLUMNS = 10_000



def read_catalogue_json(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The named columns of a JSON feed, or all that any record has, by name: an array of objects; an object with a list
    of them under a known name, else under its first list of objects; else one object. Nested cells stay JSON text; what
    isn't an object is left out, and so is a record that can't be parsed. Rows are numbered from 2 by their place in the list.
    Files of any size are read in splits. Without names, a job finds them first; only distinct names come to the driver, and
    more than MAX_JSON_COLUMNS of them are refused."""
    one = nested.records(spark, path).select("pos", F.try_parse_json("record").alias("r")).where(F.startswith(F.schema_of_variant("r"), F.lit("OBJECT")))
    if columns is None:
        found = one.select(F.explode(F.map_keys(F.try_variant_get("r", "$", "map<string,variant>"))).alias("c")).distinct()
        columns = sorted(r.c for r in found.limit(MAX_JSON_COLUMNS + 1).collect())
        if len(columns) > MAX_JSON_COLUMNS:
            raise ValueError(f"a feed with more than {MAX_JSON_COLUMNS} columns")
    names = {canonical_header(c): c for c in columns}
    cells = [F.try_variant_get("r", f"$['{c}']", "string").alias(n) for n, c in names.items() if n]
    return normalise(one.select((F.col("pos") + 2).cast("int").alias("row_number"), *cells), path.rsplit("/", 1)[-1])


def read_catalogue_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Records of an XML feed: attributes and child text as columns, all of them text as written. A file that declares a document type or entities is
    refused before it is parsed."""
    if spark.read.text(path).where(F.lower("value").rlike("<!(doctype|entity)")).head(1):
        raise ValueError("a feed with a document type or entities is refused")
    raw = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "").option("inferSchema", False).load(path)
    cells = raw.select(F.monotonically_increasing_id().alias("__id"), *(F.col(f"`{c}`").cast("string").alias(canonical_header(c)) for c in raw.columns))
    return normalise(_numbered(cells), path.rsplit("/", 1)[-1])


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """document_id, page 1 and text of plain text files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("document_id"), F.lit(1).alias("page"), F.col("value").alias("text"))


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth: row_number and expected columns, size_uom as uom, blanks null."""
    raw = canonicalise(spark.read.option("header", True).csv(path))
    names = {"size_uom": "uom"}
    return raw.select(F.col("row_number").cast("int"), *(F.nullif(F.trim(c), F.lit("")).alias(names.get(c, c)) for c in raw.columns if c != "row_number"))
