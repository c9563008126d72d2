"""Datasheet text: facts, conflicts, links to catalogue rows, proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import cells as C, extract as X
from ..functions.ranges import spread, stored

#: Attributes that a document of a category must state.
SCHEMAS = {"generic": ["material", "size"], "valve": ["material", "pressure_rating", "size"], "pump": ["material", "size"], "fitting": ["connection_type", "material", "size"]}
_NOISE = ["page", "copyright", "phone", "fax", "email", "website", "note", "notes"]


def extract_facts(pages: DataFrame) -> DataFrame:
    """document_id, page, name, value, evidence, normalised value and unit, confidence; the first of each name per page."""
    # The outer form and a filter after it, so that no filter on the list, which would read the facts again, is inferred.
    found = spread(pages).select("document_id", "page", F.explode_outer(X.facts_of("text")).alias("f")).where("f is not null").select("document_id", "page", "f.*")
    n = X.normalise_fact("name", "value")
    return found.select("document_id", "page", "name", "value", "evidence", n["value"].alias("normalized_value"), n["unit"].alias("normalized_unit"), F.lit("inferred").alias("status"), F.lit(0.85).alias("confidence"))


def conflicting_facts(facts: DataFrame) -> DataFrame:
    """document_id, name, number of distinct folded values, pages of all facts of that name (sorted) and their number, where
    there is more than one value. Pages are gathered for each value first and combined before each shuffle, so a list is as long as its
    document's facts and nothing is joined. Facts are read from the pages once and stored."""
    keys = ["document_id", "name"]
    facts = stored(facts.select(*keys, "page", F.lower("value").alias("value")), "facts")
    values = facts.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.collect_list("page").alias("pages"))
    found = values.groupBy(*keys).agg(F.count("value").alias("n_values"), F.sort_array(F.flatten(F.collect_list("pages"))).alias("pages"), F.sum("n").alias("n_facts"))
    return found.where("n_values > 1")


def conflict_values(facts: DataFrame) -> DataFrame:
    """document_id, name, value (folded), first_page and n_pages of each value of a conflicting fact: rows, not lists."""
    keys = ["document_id", "name"]
    values = facts.groupBy(*keys, F.lower("value").alias("value")).agg(F.min("page").alias("first_page"), F.count("*").alias("n_pages"))
    often = values.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return values.join(often.select(*keys), keys).select(*keys, "value", "first_page", "n_pages")


def validate_facts(facts: DataFrame, required: list[str] | None = None, categories: DataFrame | None = None) -> DataFrame:
    """document_id, code, attribute: empty values, conflicts and required attributes that are missing.

    categories (document_id, category) gives each document the schema of its own category, if there is one of that name, else the
    generic one; without that table all documents need `required`, or what a valve needs.
    """
    empty = facts.where(F.trim("value") == "").select("document_id", F.lit("EMPTY_VALUE").alias("code"), F.col("name").alias("attribute"))
    values = facts.groupBy("document_id", "name").agg(F.count_distinct(F.lower("value")).alias("n"))
    conflict = values.where("n > 1").select("document_id", F.lit("SOURCE_CONFLICT").alias("code"), F.col("name").alias("attribute"))
    # Names of facts are few, so a document's set of them is bounded.
    have = facts.groupBy("document_id").agg(F.collect_set("name").alias("have"))
    if categories is None:
        need = F.array(*map(F.lit, SCHEMAS["valve"] if required is None else required))
    else:
        have = have.join(categories.groupBy("document_id").agg(F.min("category").alias("category")), "document_id", "left")
        table = F.create_map(*(x for k, v in SCHEMAS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        need = F.coalesce(F.try_element_at(table, F.coalesce("category", F.lit("generic"))), F.array(*map(F.lit, SCHEMAS["generic"])))
    missing = have.select("document_id", F.lit("MISSING_REQUIRED").alias("code"), F.explode(F.array_except(need, "have")).alias("attribute"))
    return empty.union(conflict).union(missing)


def link_documents(facts: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """document_id, keys, part_number, match_type: rows whose part number equals one that a document states, apart from
    case and separators. The first fact of a key gives the text compared; a row is linked once per document."""
    stated = facts.where((F.col("name") == "part_number") & (F.trim("value") != "")).select("document_id", "page", F.trim("value").alias("stated"), C.part_key("value").alias("key"))
    stated = stated.groupBy("document_id", "key").agg(F.min_by("stated", F.struct("page", "stated")).alias("stated"))
    own = rows.select(*keys, F.trim("part_number").alias("part_number"), C.part_key("part_number").alias("key")).where("part_number <> ''").dropDuplicates(keys)
    kind = F.when(F.lower("part_number") == F.lower("stated"), "exact").otherwise("normalized")
    return stated.join(own, "key").select("document_id", *keys, "part_number", kind.alias("match_type"))


def proposals(facts: DataFrame) -> DataFrame:
    """All facts but part numbers, for a person to decide."""
    return facts.where("name <> 'part_number'").withColumn("state", F.lit("proposed"))


def documents_for_part(links: DataFrame, facts: DataFrame, artifacts: DataFrame, part: str, n: int = 200) -> DataFrame:
    """The newest n documents that name a part, each with its proposals."""
    named = links.where(C.part_key("part_number") == C.part_key(F.lit(part))).select("document_id").distinct()
    newest = artifacts.join(named, "document_id").orderBy(F.desc("created_at"), "document_id").limit(n)
    # Only what the n documents state is grouped.
    theirs = proposals(facts).join(newest.select("document_id").distinct(), "document_id", "left_semi")
    found = theirs.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page", "name", "value"))).alias("proposals"))
    return newest.join(found, "document_id", "left")


def label_value_lines(pages: DataFrame, max_attributes: int = 20) -> DataFrame:
    """document_id, position, label, value of the lines of a document that read `Title Case Label: value`: short, the
    first of each label, at most max_attributes a document in order of page and line."""
    lines = pages.select("document_id", "page", F.posexplode(F.split("text", r"\r?\n")).alias("line", "l")).withColumn("l", F.trim("l")).where("length(l) between 1 and 120")
    pattern = r"^([A-Z][A-Za-z0-9/()]*(?:[ -][A-Z][A-Za-z0-9/()]*){0,3}):\s+(.{1,60})$"
    found = lines.withColumn("label", F.trim(X.first("l", pattern, 1))).withColumn("value", F.trim(X.first("l", pattern, 2))).where("label is not null and value <> ''").withColumn("k", F.lower("label"))
    v = F.col("value")
    found = found.where(~F.col("k").isin(_NOISE) & ~F.contains(F.lower(v), F.lit("http")) & (F.size(F.split(v, r"\s+")) <= 8) & ~v.rlike("[.,;]$") & ~v.rlike("^[a-z]"))
    once = F.row_number().over(Window.partitionBy("document_id", "k").orderBy("page", "line"))
    found = found.withColumn("once", once).where("once = 1")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "line"))
    return found.withColumn("position", place).where(F.col("position") <= max_attributes).select("document_id", "position", "label", "value")


def latest_artifact(artifacts: DataFrame, *by: str) -> DataFrame:
    """The newest artifact of each key, ties to the larger id; a maximum that is combined before the shuffle."""
    rest = [c for c in artifacts.columns if c not in by]
    return artifacts.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("created_at", "artifact_id")).alias("a")).select(*by, "a.*")
