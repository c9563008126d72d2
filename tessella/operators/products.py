"""Products with versions: the latest, differences, rules, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_versions(versions: DataFrame, n: int = 1) -> DataFrame:
    """The rows of each product's n latest versions, with age (1 the latest), by creation and then version id. A version
    that is written more than once counts as of its last time."""
    heads = versions.groupBy("product_id", "version_id").agg(F.max("created_at").alias("created_at"))
    age = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("created_at"), F.desc("version_id")))
    newest = heads.withColumn("age", age).where(F.col("age") <= n).select("product_id", "version_id", "age")
    return versions.join(newest, ["product_id", "version_id"])


def version_diff(versions: DataFrame) -> DataFrame:
    """product_id, name, change (added, removed, changed) and both values and units of the two latest versions."""
    two = latest_versions(versions, 2)
    both = two.groupBy("product_id").agg(F.max("age").alias("n")).where("n = 2").select("product_id")
    side = lambda age, x: two.where(F.col("age") == age).join(both, "product_id", "left_semi").select("product_id", "name", F.col("value").alias(f"{x}_value"), F.col("unit").alias(f"{x}_unit"), F.lit(True).alias(f"_{x}"))
    met = side(2, "previous").join(side(1, "current"), ["product_id", "name"], "full")
    change = F.when(F.col("_previous").isNull(), "added").when(F.col("_current").isNull(), "removed").when(~F.col("previous_value").eqNullSafe(F.col("current_value")) | ~F.col("previous_unit").eqNullSafe(F.col("current_unit")), "changed")
    return met.withColumn("change", change).where("change is not null").select("product_id", "name", "change", "previous_value", "current_value", "previous_unit", "current_unit")


def version_attr_union(versions: DataFrame) -> DataFrame:
    """The attribute names of each product's two latest versions."""
    return latest_versions(versions, 2).select("product_id", "name").distinct()


def required_minus_present(have: Column, need: list[str]) -> Column:
    """What is needed and not there, sorted."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, need)), have))


def validate_version(versions: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """product_id, version_id, code, severity, attribute."""
    keys = ["product_id", "version_id"]
    rules = [("EMPTY_VALUE", "error", F.col("value").isNull() | (F.trim("value") == "")), ("INFERRED_VALUE", "warning", F.col("status") == "inferred"), ("CONFLICTING_VALUE", "error", F.col("status") == "conflict"), ("LOW_CONFIDENCE", "warning", F.col("confidence") < 0.7)]
    hits = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, c in rules)))
    own = versions.select(*keys, F.col("name").alias("attribute"), F.explode(hits).alias("h")).select(*keys, "h.code", "h.severity", "attribute")
    if not required:
        return own
    have = versions.groupBy(*keys).agg(F.collect_set("name").alias("have"))
    missing = have.select(*keys, F.lit("MISSING_REQUIRED").alias("code"), F.lit("error").alias("severity"), F.explode(required_minus_present(F.col("have"), list(required))).alias("attribute"))
    return own.unionByName(missing)


def product_summary(versions: DataFrame) -> DataFrame:
    """product_id, versions, the latest version and how many attributes it has."""
    n = versions.groupBy("product_id").agg(F.count_distinct("version_id").alias("versions"))
    last = latest_versions(versions, 1).groupBy("product_id").agg(F.max("version_id").alias("latest_version"), F.count("*").alias("attributes"))
    return n.join(last, "product_id")


def product_hash(versions: DataFrame) -> DataFrame:
    """product_id and a hash of all its attributes, in any order, without the time when they were captured.

    Attributes are hashed first; their number and the sums of two hashes are combined before the shuffle, so a product
    with any number of attributes moves as one row a task."""
    row = F.to_json(F.struct("version_id", "name", "value", "unit", "status"), {"ignoreNullFields": "false"})
    sums = (F.sum(F.xxhash64(F.lit(k), row).cast("decimal(38,0)")).cast("string") for k in (1, 2))
    return versions.groupBy("product_id").agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256).alias("content_hash"))


def dedupe_import(products: DataFrame, processed: DataFrame) -> DataFrame:
    """product_id, content_hash, decision: the first product of each hash that wasn't processed is new; others are
    skipped and count as done."""
    first = products.groupBy("content_hash").agg(F.min("product_id").alias("_first"))
    done = processed.select("content_hash").distinct().withColumn("_done", F.lit(True))
    out = products.join(first, "content_hash").join(done, "content_hash", "left")
    return out.select("product_id", "content_hash", F.when(F.col("_done") | (F.col("product_id") != F.col("_first")), "skipped").otherwise("new").alias("decision"))


def run_import(versions: DataFrame, processed: DataFrame) -> DataFrame:
    """product_id and state (completed, needs_review, failed) by the issues of each new product's latest version;
    skipped ones are completed. A bad record only affects itself."""
    decided = dedupe_import(product_hash(versions), processed)
    issues = validate_version(latest_versions(versions, 1)).groupBy("product_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count("*").alias("issues"))
    state = F.when(F.col("decision") == "skipped", "completed").when(F.coalesce("errors", F.lit(0)) > 0, "failed").when(F.coalesce("issues", F.lit(0)) > 0, "needs_review").otherwise("completed")
    return decided.join(issues, "product_id", "left").select("product_id", "decision", state.alias("state"))


def job_counts(items: DataFrame, *by: str) -> DataFrame:
    """completed, failed and needs_review items per job, progress and the job's final state."""
    names = ["completed", "failed", "needs_review"]
    out = items.groupBy(*by).agg(F.count("*").alias("items"), *(F.count_if(F.col("state") == s).alias(s) for s in names))
    final = F.when((F.col("failed") > 0) | (F.col("needs_review") > 0), "completed_with_errors").otherwise("completed")
    return out.withColumn("progress", F.round((F.col("completed") + F.col("failed") + F.col("needs_review")) / F.col("items"), 4)).withColumn("final_state", final)


def model_constraints(versions: DataFrame) -> DataFrame:
    """product_id, version_id, name, violation: empty ids, confidence out of 0 to 1, repeated attribute names."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rules = [("EMPTY_ID", blank("product_id") | blank("version_id")), ("EMPTY_NAME", blank("name")), ("CONFIDENCE_RANGE", (F.col("confidence") < 0) | (F.col("confidence") > 1))]
    hits = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(v)) for v, c in rules)))
    own = versions.select("product_id", "version_id", "name", F.explode(hits).alias("violation"))
    again = versions.groupBy("product_id", "version_id", "name").count().where("count > 1").select("product_id", "version_id", "name", F.lit("REPEATED_NAME").alias("violation"))
    return own.union(again)


def nested_constraints(versions: DataFrame) -> DataFrame:
    """product_id, version_id, name, violation of versions with nested attributes, checked where they stand.

    versions: product_id, version_id, attributes (name, confidence, evidence: array of source_name, source_type, page). A
    version without attributes breaks no rule of attributes; null arrays are empty; name is null for rules of a version.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    anywhere = lambda a, test: F.exists(F.coalesce(a["evidence"], F.array().cast(kind)), test)
    kind = versions.schema["attributes"].dataType.elementType["evidence"].dataType
    rules = {
        "EMPTY_NAME": lambda a: blank(a["name"]),
        "NO_EVIDENCE": lambda a: F.coalesce(F.size(a["evidence"]), F.lit(0)) <= 0,
        "CONFIDENCE_RANGE": lambda a: (a["confidence"] < 0) | (a["confidence"] > 1),
        "EMPTY_SOURCE_NAME": lambda a: anywhere(a, lambda e: blank(e["source_name"])),
        "EMPTY_SOURCE_TYPE": lambda a: anywhere(a, lambda e: blank(e["source_type"])),
        "PAGE_RANGE": lambda a: anywhere(a, lambda e: F.coalesce(e["page"] < 1, F.lit(False))),
    }
    struct = lambda name, violation: F.struct(name.alias("name"), violation.alias("violation"))
    none, all_ = F.lit(None).cast("string"), F.coalesce("attributes", F.array().cast(versions.schema["attributes"].dataType))
    broken = lambda a: F.array_compact(F.array(*(F.when(F.coalesce(test(a), F.lit(False)), struct(a["name"], F.lit(rule))) for rule, test in rules.items())))
    names = F.transform(all_, lambda a: a["name"])
    again = F.transform(F.filter(F.array_distinct(names), lambda n: F.size(F.filter(names, lambda m: m == n)) > 1), lambda n: struct(n, F.lit("REPEATED_NAME")))
    own = F.when(blank("product_id") | blank("version_id"), F.array(struct(none, F.lit("EMPTY_ID")))).otherwise(F.array().cast("array<struct<name:string,violation:string>>"))
    hits = F.concat(own, F.flatten(F.transform(all_, broken)), again)
    return versions.select("product_id", "version_id", F.explode(hits).alias("x")).select("product_id", "version_id", "x.*")


def product_constraints(products: DataFrame, versions: DataFrame) -> DataFrame:
    """product_id, version_id, violation: products with an empty id, sku, name or category, products without a version, and
    versions of no product. Membership is two anti-joins; nothing is gathered."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    none = F.lit(None).cast("string")
    empty = products.where(blank("product_id") | blank("sku") | blank("name") | blank("category")).select("product_id", none.alias("version_id"), F.lit("EMPTY_FIELD").alias("violation"))
    bare = products.join(versions.select("product_id").distinct(), "product_id", "left_anti").select("product_id", none, F.lit("NO_VERSION"))
    foreign = versions.join(products.select("product_id").distinct(), "product_id", "left_anti").select("product_id", "version_id", F.lit("FOREIGN_VERSION"))
    return empty.union(bare).union(foreign)
