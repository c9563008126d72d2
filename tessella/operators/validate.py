"""Validation rules: each gives the issues of a row; none moves rows but the search for repeated part numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import col, is_missing, is_placeholder, pick, role_of
from ..functions.ranges import running, scratch
from ..resources import values as V

#: Columns that carry lineage and have no role.
LINEAGE = ["row_number", "source_name", "source_fingerprint", "organization_id", "batch_id"]
#: Other rows of a part number that a row names.
SHOWN_ROWS = 10
_ISSUE = "struct<code:string,severity:string,field:string>"


def _issue(code: str, severity: str, field) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (field if isinstance(field, Column) else F.lit(field)).alias("field"))


def _one(condition: Column, code: str, severity: str, field: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(_issue(code, severity, field))).otherwise(F.array().cast(f"array<{_ISSUE}>"))


def _each(fields: Column | str, condition, code: str, severity: str) -> Column:
    return F.transform(F.filter(col(fields), lambda f: F.coalesce(condition(f), F.lit(False))), lambda f: _issue(code, severity, f["column"]))


def of_role(fields: Column | str, role: str) -> Column:
    """The first field of a role, or null."""
    return F.get(F.filter(col(fields), lambda f: f["role"] == role), 0)


def value_of(fields: Column | str, role: str) -> Column:
    return of_role(fields, role)["canonical_value"]


def required_roles(category: Column) -> Column:
    table = F.create_map(*(x for k, v in V.REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.element_at(table, category), F.array(*map(F.lit, V.DEFAULT_REQUIRED)))


def v_required(fields: Column | str, required: Column) -> Column:
    """Required roles without a column, and required roles without a value."""
    roles = F.transform(col(fields), lambda f: f["role"])
    first = lambda r: F.get(F.filter(col(fields), lambda f: f["role"] == r), 0)
    absent = F.transform(F.array_except(required, roles), lambda r: _issue("MISSING_REQUIRED_COLUMN", "error", r))
    empty = F.filter(F.array_intersect(required, roles), lambda r: (first(r)["status"] == "missing") | first(r)["canonical_value"].isNull())
    return F.concat(absent, F.transform(empty, lambda r: _issue("MISSING_REQUIRED_VALUE", "error", r)))


def v_description(fields: Column | str) -> Column:
    """No description beside a part number, or one that adds fewer than three letters and digits to it."""
    d, p = (F.coalesce(value_of(fields, r), F.lit("")) for r in ("description", "part_number"))
    bare = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    rest = F.when(bare(p) != "", F.replace(bare(d), bare(p), F.lit(""))).otherwise(bare(d))
    return F.concat(_one((F.trim(d) == "") & (F.trim(p) != ""), "MISSING_DESCRIPTION", "warning", "description"), _one((F.trim(d) != "") & (bare(p) != "") & (F.length(rest) < 3), "UNINFORMATIVE_DESCRIPTION", "warning", "description"))


def v_lov(fields: Column | str) -> Column:
    return _each(fields, lambda f: f["role"].isin("manufacturer", "brand", "category", "material", "uom") & (f["status"] == "review_required") & (F.coalesce(f["raw_value"], F.lit("")) != ""), "LOV_UNMATCHED", "warning")


def v_low_confidence(fields: Column | str) -> Column:
    return _each(fields, lambda f: (F.coalesce(f["raw_value"], F.lit("")) != "") & (f["confidence"] > 0) & (f["confidence"] < V.APPROVAL_CONFIDENCE), "LOW_CONFIDENCE", "warning")


def v_char_limit(fields: Column | str) -> Column:
    return _each(fields, lambda f: F.length(f["canonical_value"]) > pick(list(V.CHARACTER_LIMITS.items()), f["role"]), "CHAR_LIMIT_EXCEEDED", "error")


def v_material_pressure(fields: Column | str) -> Column:
    pressure = F.get(F.split(F.trim(value_of(fields, "pressure")), r"\s+"), 0).try_cast("double")
    return _one(value_of(fields, "material").isin(V.SOFT_MATERIALS) & (pressure > 600), "MATERIAL_PRESSURE_MISMATCH", "warning", "material")


def v_size_without_uom(fields: Column | str) -> Column:
    return _one((F.coalesce(value_of(fields, "size"), F.lit("")) != "") & ~F.exists(col(fields), lambda f: f["role"] == "uom"), "SIZE_WITHOUT_UOM", "info", "size")


def completeness(fields: Column | str, required: Column) -> Column:
    """The share of required roles with a value; of all fields where nothing is required."""
    filled = F.size(F.filter(required, lambda r: F.get(F.filter(col(fields), lambda f: f["role"] == r), 0)["canonical_value"].isNotNull()))
    own = F.size(F.filter(col(fields), lambda f: f["canonical_value"].isNotNull())) / F.size(col(fields))
    return F.when(F.size(required) > 0, filled / F.size(required)).otherwise(F.coalesce(own, F.lit(0.0)))


def auto_approve(fields: Column | str, confidence: Column | str, issues: Column | str) -> Column:
    """No error, no blocking issue, confidence enough, and no filled field left to review."""
    bad = F.exists(col(issues), lambda i: (i["severity"] == "error") | i["code"].isin(V.BLOCKING_ISSUES))
    open_ = F.exists(col(fields), lambda f: (f["status"] == "review_required") & (F.coalesce(f["raw_value"], F.lit("")) != ""))
    return ~bad & (col(confidence) >= V.APPROVAL_CONFIDENCE) & ~open_


def duplicate_part_numbers(df: DataFrame, part: Column | str = "part_number", *by: str) -> DataFrame:
    """by, row_number, part_key and how many rows have that part number, for part numbers on more than one row.

    Counts are combined before the shuffle and joined back, so a part number that a third of all rows has is split
    by the join and never stands in one window or list."""
    keyed = df.select(*by, "row_number", F.lower(F.trim(col(part))).alias("part_key")).where("part_key <> ''")
    often = keyed.groupBy(*by, "part_key").agg(F.count("*").alias("rows")).where("rows > 1")
    return keyed.join(often, [*by, "part_key"]).select(*by, "row_number", "part_key", "rows")


def other_rows(df: DataFrame, part: Column | str = "part_number", *by: str, shown: int = SHOWN_ROWS) -> DataFrame:
    """What duplicate_part_numbers gives, with other_rows (the first `shown` other rows of that number, ascending), next_row (the
    next row of it, null at the last) and message.

    Pointers make the whole list reachable from any row, though no row carries it: with lists, a number on n rows would make
    n * n entries. Rows are counted within their number by ranges, and a pointer is a join on (number, place), so a
    number that a third of all rows has stands in no single task.
    """
    keyed = df.select(*by, "row_number", F.lower(F.trim(col(part))).alias("part_key")).where("part_key <> ''")
    often = keyed.groupBy(*by, "part_key").agg(F.count("*").alias("rows")).where("rows > 1")
    keys = [*by, "part_key"]
    placed = running(keyed.join(often, keys), keys, ["row_number"], scratch(df.sparkSession, "places"), {"place": ("sum", F.lit(1).cast("long"))})
    following = placed.select(*keys, (F.col("place") - 1).alias("place"), F.col("row_number").alias("next_row"))
    first = placed.where(F.col("place") <= shown + 1).groupBy(*keys).agg(F.sort_array(F.collect_list("row_number")).alias("first"))
    out = placed.join(following, [*keys, "place"], "left").join(first, keys)
    # A row that is itself among the first is left out once; rows of equal number and place in the batch stay each.
    own = F.array_position("first", F.col("row_number")).cast("int")
    others = F.slice(F.when(own > 0, F.concat(F.slice("first", F.lit(1), own - 1), F.slice("first", own + 1, F.lit(shown + 1)))).otherwise(F.col("first")), 1, shown)
    listed = F.array_join(F.transform(others, lambda x: x.cast("string")), ", ")
    more = F.when(F.col("rows") - 1 > shown, F.concat(F.lit(", and "), (F.col("rows") - 1 - shown).cast("string"), F.lit(" more"))).otherwise("")
    message = F.concat(F.lit("Part number appears in "), F.col("rows").cast("string"), F.lit(" rows: "), listed, more)
    return out.select(*by, "row_number", "part_key", "rows", others.alias("other_rows"), "next_row", message.alias("message"))


def _part_number(enriched: DataFrame) -> Column:
    """The canonical part number. It is the cell itself, so that reading it there spares a second enrichment."""
    for name in enriched.columns:
        if name not in LINEAGE and name != "fields" and role_of(name) == "part_number":
            return F.when(~is_missing(name) & ~is_placeholder(name), F.col(name))
    return value_of("fields", "part_number")


def validate_batch(enriched: DataFrame, *by: str) -> DataFrame:
    """enriched with issues, completeness and can_auto_approve. by: columns that make a batch. Rows of one number in a batch
    stay as many as they are, and share the issue of a repeated part number."""
    required = required_roles(value_of("fields", "category"))
    rules = [v_required("fields", F.col("_required")), v_description("fields"), v_lov("fields"), v_low_confidence("fields"), v_char_limit("fields"), v_material_pressure("fields"), v_size_without_uom("fields")]
    own = enriched.withColumn("_required", required).withColumn("_own", F.concat(*rules)).withColumn("completeness", completeness("fields", F.col("_required"))).withColumn("can_auto_approve", auto_approve("fields", "overall_confidence", "_own"))
    again = duplicate_part_numbers(enriched, _part_number(enriched), *by).select(*by, "row_number").distinct().withColumn("_again", F.lit(True))
    joined = own.join(again, [*by, "row_number"], "left")
    issues = F.when(F.col("_again"), F.concat("_own", F.array(_issue("DUPLICATE_PART_NUMBER", "warning", "part_number")))).otherwise(F.col("_own"))
    return joined.withColumn("issues", issues).drop("_required", "_own", "_again")


def exploded_issues(validated: DataFrame, *keep: str) -> DataFrame:
    return validated.select(*keep, F.explode("issues").alias("i")).select(*keep, "i.*")


def batch_validation_summary(validated: DataFrame, *by: str) -> DataFrame:
    """Rows, rows that can be approved or need review, issues, and the share approved (4 places), for each batch."""
    out = validated.groupBy(*by).agg(F.count("*").alias("total_rows"), F.count_if("can_auto_approve").alias("auto_approved"), F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("total_issues"))
    rate = F.when(F.col("total_rows") > 0, F.round(F.col("auto_approved") / F.col("total_rows"), 4)).otherwise(0.0)
    return out.withColumn("review_required", F.col("total_rows") - F.col("auto_approved")).withColumn("auto_approve_rate", rate)


def issue_histogram(validated: DataFrame) -> DataFrame:
    """How many issues there are of each code and severity."""
    return exploded_issues(validated).groupBy("code", "severity").agg(F.count("*").alias("n"))
