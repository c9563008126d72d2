"""Specifications read from text: each expression gives the first match or null."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..resources import values as V
from .cells import col, first_where, let, pick


def first(c: Column | str, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def word(text: str) -> str:
    """A pattern for a whole word or phrase in either case."""
    return r"(?i)\b" + re.sub(r"([^A-Za-z0-9 ])", r"\\\1", text) + r"\b"


def first_word(c: Column | str, rows: list[tuple[str, str]]) -> Column:
    """The value of the first (written forms, value) of which a form stands in a text as a whole word. Forms are
    patterns without case; one pattern of all of them tells texts without any."""
    any_ = "(?i)" + "|".join(p for p, _ in rows)
    return let(col(c), lambda t: F.when(t.rlike(any_), first_where([("(?i)" + p, v) for p, v in rows], lambda r: F.rlike(t, r["v0"]))["v1"]))


def extract_material(c: Column | str) -> Column:
    """The material of the longest written form that stands as a whole word."""
    forms = sorted(V.MATERIALS.items(), key=lambda x: -len(x[0]))
    return first_word(c, [(word(k)[4:], v) for k, v in forms])


#: Pressure and length units as written in small letters, and their names.
UNIT_NAMES = [(form, unit) for unit, dimension, forms in V.UNITS for form in forms if dimension in ("pressure", "length")]


def extract_pressure(c: Column | str) -> Column:
    return first(c, V.PRESSURE_PATTERN, 1)


def extract_pressure_uom(c: Column | str) -> Column:
    return pick(UNIT_NAMES, F.lower(first(c, V.PRESSURE_PATTERN, 2)))


def extract_connection(c: Column | str) -> Column:
    return first_word(c, [(word(x)[4:], x) for x in V.CONNECTIONS])


def extract_temperature(c: Column | str) -> Column:
    return first(c, V.TEMPERATURE_PATTERN)


def extract_size(c: Column | str) -> Column:
    return first(c, V.SIZE_PATTERN)


def extract_size_uom(c: Column | str) -> Column:
    return pick(UNIT_NAMES, F.lower(first(c, V.SIZE_UNIT_PATTERN)))


def extract_dimensions(c: Column | str) -> Column:
    """A struct of weight, weight_uom, width and length (in inches)."""
    return F.struct(first(c, V.WEIGHT_PATTERN, 1).alias("weight"), F.upper(first(c, V.WEIGHT_PATTERN, 2)).alias("weight_uom"), first(c, V.SIDES_PATTERN, 1).alias("width"), first(c, V.SIDES_PATTERN, 2).alias("length"))


def strip_part_number(text: Column | str, part: Column | str) -> Column:
    """A text with its part number, as a whole word, replaced by a space. Texts without it aren't searched."""
    t, p = col(text), col(part)
    pattern = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), p, F.lit(r"\E(?![A-Za-z0-9])"))
    return F.when((F.coalesce(p, F.lit("")) != "") & F.contains(F.lower(t), F.lower(p)), F.regexp_replace(t, pattern, F.lit(" "))).otherwise(t)


def extract_attributes(text: Column | str, part: Column | str) -> Column:
    """label, value and uom of the specifications that a description states."""
    t = strip_part_number(text, part)
    d = extract_dimensions(text)
    one = lambda label, value, uom=None: F.when(value.isNotNull(), F.struct(F.lit(label).alias("label"), value.alias("value"), (F.lit(uom) if not isinstance(uom, Column) else uom).cast("string").alias("uom")))
    grit = F.coalesce(*(first(t, p) for p in V.GRIT_PATTERNS))
    size = F.concat(d["width"], F.lit(" in x "), d["length"], F.lit(" in"))
    return F.array_compact(F.array(
        one("Grit", grit), one("Voltage Rating", first(t, V.VOLT_PATTERN), "V"), one("Amperage Rating", first(t, V.AMPERE_PATTERN), "A"),
        one("Horsepower", first(t, V.HORSEPOWER_PATTERN), "HP"), one("Size", size), one("Weight", d["weight"], d["weight_uom"]),
    ))


def feature_bullets(attributes: Column | str) -> Column:
    valued = F.filter(col(attributes), lambda a: F.coalesce(a["value"], F.lit("")) != "")
    return F.transform(valued, lambda a: F.concat(a["label"], F.lit(": "), a["value"], F.coalesce(F.concat(F.lit(" "), a["uom"]), F.lit(""))))


def facts_of(text: Column | str) -> Column:
    """name, value and evidence of each labelled specification of a page, the first of each name."""
    t = col(text)
    found = []
    for name, pattern, groups in V.FACT_PATTERNS:
        value = F.trim(F.concat(*(F.regexp_extract(t, pattern, g) for g in groups)))
        whole = F.regexp_extract(t, pattern, 0)
        start = F.instr(t, whole)
        begin = F.greatest(start - 30, F.lit(1))
        evidence = F.trim(F.substring(t, begin, start + F.length(whole) + 30 - begin))
        found.append(F.when(value != "", F.struct(F.lit(name).alias("name"), value.alias("value"), evidence.alias("evidence"))))
    return F.array_compact(F.array(*found))


def normalise_fact(name: Column | str, value: Column | str) -> Column:
    """A struct of the comparable value and unit of a fact."""
    n, v = col(name), F.lower(F.trim(F.regexp_replace(col(value), r"\s+", " ")))
    pressure, size = V.PRESSURE_FACT_PATTERN, V.SIZE_FACT_PATTERN
    squeeze = lambda x: F.regexp_replace(x, r"\s+", "")
    unit = first(v, size, 2)
    return F.struct(
        F.when(n == "pressure_rating", squeeze(first(v, pressure))).when(n == "size", squeeze(first(v, size))).when(n == "material", v).alias("value"),
        F.when(n == "pressure_rating", first(v, pressure, 2)).when(n == "size", F.when(unit.isin("inch", "inches"), "in").otherwise(unit)).alias("unit"),
    )
