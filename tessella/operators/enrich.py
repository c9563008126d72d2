"""Enrichment: what each cell of a catalogue row means, how sure that is, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cells as C, extract as X
from ..functions.ranges import spread
from ..resources import values as V
from . import match
from .validate import LINEAGE

_FIELD = "struct<column:string,raw_value:string,canonical_value:string,confidence:double,status:string,role:string,transformation:string>"
STATUS_ORDER = ["missing", "review_required", "inferred", "verified"]


def role_map(columns: list[str]) -> list[tuple[str, str]]:
    """(column, role) in the order of the columns, worked out once per batch."""
    return [(c, C.role_of(c)) for c in columns if c not in LINEAGE]


def _field(name: str, role: str, raw: Column, canonical: Column, confidence, status, how) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(name).alias("column"), raw.alias("raw_value"), lit(canonical).cast("string").alias("canonical_value"), lit(confidence).cast("double").alias("confidence"), lit(status).alias("status"), F.lit(role).alias("role"), lit(how).alias("transformation")).cast(_FIELD)


def _listed(name: str, role: str, raw: Column, found: Column) -> Column:
    """The field of a cell matched with a vocabulary."""
    status = lambda f: F.when(f["confidence"] >= 0.95, "verified").when(f["confidence"] > 0, "inferred").otherwise("review_required")
    how = lambda f: F.when(f["match_type"] == "exact", "exact_match").when(f["match_type"] == "alias", "alias_match").when(f["confidence"] > 0, "normalized").otherwise("passthrough")
    return C.let(found, lambda f: _field(name, role, raw, F.when(f["confidence"] > 0, f["canonical"]).otherwise(raw), f["confidence"], status(f), how(f)))


def _from_text(role: str, text: Column) -> Column | None:
    readers = {
        "manufacturer": lambda t: match.text_vocab_expression(t, V.MANUFACTURERS), "brand": lambda t: match.text_vocab_expression(t, V.BRANDS),
        "material": X.extract_material, "pressure": X.extract_pressure, "pressure_uom": X.extract_pressure_uom, "connection_type": X.extract_connection,
        "temperature_range": X.extract_temperature, "size": X.extract_size, "uom": X.extract_size_uom,
    }
    return readers[role](text) if role in readers else None


def _filled(name: str, role: str, raw: Column) -> Column:
    """The field of a cell that holds something, as its role has it."""
    if role == "manufacturer":
        seller = lambda clean: match.vocab_expression(clean, V.DISTRIBUTORS)["confidence"] >= 0.95
        is_seller = _field(name, role, raw, raw, 0.0, "review_required", "distributor_not_manufacturer")
        judge = lambda clean, m: F.when((m["confidence"] == 0) & seller(clean), is_seller).otherwise(_listed(name, role, raw, m))
        return C.let(C.strip_distributor_code(raw), lambda clean: C.let(match.vocab_expression(clean, V.MANUFACTURERS), lambda m: judge(clean, m)))
    if role == "brand":
        maker = lambda b: C.let(match.vocab_expression(raw, V.MANUFACTURERS), lambda m: F.when(m["confidence"] >= 0.95, m).otherwise(b))
        best = C.let(match.vocab_expression(raw, [b[:2] for b in V.BRANDS]), lambda b: F.when(b["confidence"] >= 0.95, b).otherwise(maker(b)))
        return _listed(name, role, raw, best)
    if role == "category":
        return _listed(name, role, raw, match.vocab_expression(raw, V.CATEGORIES))
    if role in ("material", "uom"):
        found = match.material_expression(raw) if role == "material" else match.unit_expression(raw)
        sure = 0.9 if role == "material" else 0.0001
        status = lambda f: F.when(f["confidence"] >= sure, "verified").when(f["confidence"] > 0, "inferred").otherwise("review_required")
        how = lambda f: F.when(f["confidence"] >= sure, "exact_match").when(f["confidence"] > 0, "normalized").otherwise("passthrough")
        return C.let(found, lambda f: _field(name, role, raw, F.when(f["confidence"] > 0, f["canonical"]).otherwise(raw), f["confidence"], status(f), how(f)))
    if role in ("part_number", "description"):
        return _field(name, role, raw, raw, 1.0, "verified", "passthrough")
    if role in ("size", "pressure", "connection_type"):
        return _field(name, role, raw, raw, 0.9, "verified", "passthrough")
    return _field(name, role, raw, raw, 0.5, "review_required", "passthrough")


def _blank(name: str, role: str, text: Column, part: Column) -> Column:
    """The field of an empty cell: what the part number or the description tells, else missing."""
    nothing = F.lit(None).cast("string")
    told = lambda v, how, other: F.when(v.isNotNull(), _field(name, role, nothing, v, 0.85, "inferred", how)).otherwise(other)
    missing = _field(name, role, nothing, nothing, 0.0, "missing", "missing")
    read = _from_text(role, text)
    out = missing if read is None else C.let(read, lambda v: told(v, "extracted_from_description", missing))
    return C.let(match.prefix_manufacturer(part), lambda v: told(v, "extracted_from_part_number", out)) if role == "manufacturer" else out


def enrich_field(name: str, role: str, text: Column | None, part: Column | None) -> Column:
    """The field of one column: blank cells are inferred from the part number or the description, placeholders are
    missing, and other cells are looked up or passed on as their role has it."""
    none = F.lit(None).cast("string")
    cell = F.struct(F.col(name).cast("string").alias("raw"), (none if text is None else text).alias("text"), (none if part is None else part).alias("part"))
    place_holder = lambda v: _field(name, role, v["raw"], none, 0.0, "missing", "placeholder")
    return C.let(cell, lambda v: F.when(C.is_missing(v["raw"]), _blank(name, role, v["text"], v["part"])).when(C.is_placeholder(v["raw"]), place_holder(v)).otherwise(_filled(name, role, v["raw"])))


def row_confidence(fields: Column | str) -> Column:
    """Mean confidence of the fields that aren't missing, 4 places; 0 if all are."""
    there = F.filter(C.col(fields), lambda f: f["status"] != "missing")
    total = F.aggregate(there, F.lit(0.0), lambda a, f: a + f["confidence"])
    return F.when(F.size(there) > 0, F.round(total / F.size(there), 4)).otherwise(0.0)


def worst_status(fields: Column | str) -> Column:
    """The status of the field of which least is known; missing if there are no fields."""
    rank = F.array_min(F.transform(C.col(fields), lambda f: F.array_position(F.array(*map(F.lit, STATUS_ORDER)), f["status"]).cast("int")))
    return F.element_at(F.array(*map(F.lit, STATUS_ORDER)), F.coalesce(rank, F.lit(1)))


def enrich_batch(df: DataFrame, roles: list[tuple[str, str]] | None = None) -> DataFrame:
    """df with fields (one per column with a role, in column order), overall_confidence and overall_status.

    Descriptions and part numbers are read from the last column of that role. One projection, over rows that are spread
    evenly first: the vocabularies stand in the plan.
    """
    roles = role_map(df.columns) if roles is None else roles
    last = dict((role, c) for c, role in roles)
    text = F.col(last["description"]) if "description" in last else None
    part = F.col(last["part_number"]) if "part_number" in last else None
    out = spread(df).withColumn("fields", F.array(*(enrich_field(c, role, text, part) for c, role in roles)) if roles else F.array().cast(f"array<{_FIELD}>"))
    return out.withColumn("overall_confidence", row_confidence("fields")).withColumn("overall_status", worst_status("fields"))


def verified_rate(enriched: DataFrame, *by: str) -> DataFrame:
    """Fields, verified fields and their share, and rows with a field to review."""
    n = F.sum(F.size("fields")).alias("fields")
    verified = F.sum(F.size(F.filter("fields", lambda f: f["status"] == "verified"))).alias("verified")
    review = F.count_if(F.exists("fields", lambda f: f["status"] == "review_required")).alias("rows_to_review")
    return enriched.groupBy(*by).agg(n, verified, review).withColumn("verified_rate", F.round(F.col("verified") / F.col("fields"), 4))


def exploded_fields(enriched: DataFrame, *keep: str) -> DataFrame:
    """A row for each field. The outer form gives a row to an empty list too, which is then left out: the plain one would have
    Spark ask first whether the list is empty, by enriching each row once more where it is read."""
    return enriched.select(*keep, F.posexplode_outer("fields").alias("position", "f")).where("position is not null").select(*keep, "position", "f.*")
