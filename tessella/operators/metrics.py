"""Scores against ground truth, and figures about runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.cells import form

_OUTCOMES = ["exact", "normalised", "missing_correct", "missing_incorrect", "false_positive"]


def scored_fields(fields: DataFrame, truth: DataFrame) -> DataFrame:
    """row_number, column, role, predicted, expected, outcome. fields: row_number, column, role, canonical_value; truth:
    a column per expected field and row_number. Fields are held against the truth of their column, else their role. Values
    are exact where they agree but for case and outer spaces, and normalised where their comparison forms (words of
    letters and digits, at least one) do. A null on both sides is rightly missing."""
    names = [c for c in truth.columns if c != "row_number"]
    known = truth.select("row_number", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(c).cast("string") for c in names))).alias("_truth"))
    f = fields.join(known, "row_number")
    key = F.when(F.array_contains(F.map_keys("_truth"), F.col("column")), F.col("column")).when(F.array_contains(F.map_keys("_truth"), F.col("role")), F.col("role"))
    f = f.withColumn("_key", key).withColumn("expected", F.col("_truth")[F.col("_key")]).withColumn("predicted", F.col("canonical_value"))
    folded = lambda c: F.lower(F.trim(c))
    p, e = F.col("predicted"), F.col("expected")
    outcome = F.when(F.col("_key").isNull(), "not_evaluated").when(p.isNull() & e.isNull(), "missing_correct").when(p.isNull(), "missing_incorrect").when(e.isNull(), "false_positive").when(folded(p) == folded(e), "exact").when((form(p) == form(e)) & (form(p) != ""), "normalised").otherwise("false_positive")
    return f.select("row_number", F.coalesce("_key", "column").alias("column"), "role", "predicted", "expected", outcome.alias("outcome"))


def _metrics(scored: DataFrame, by: str) -> DataFrame:
    out = scored.groupBy(by).agg(F.count_if(F.col("outcome") != "not_evaluated").alias("total"), *(F.count_if(F.col("outcome") == o).alias(o) for o in [*_OUTCOMES, "not_evaluated"]))
    share = lambda n, d: F.when(d > 0, F.round(n / d, 4)).otherwise(0.0)
    out = out.withColumn("exact_accuracy", share(F.col("exact"), F.col("total"))).withColumn("normalised_accuracy", share(F.col("exact") + F.col("normalised"), F.col("total")))
    return out.withColumn("precision", share(F.col("exact") + F.col("normalised"), F.col("exact") + F.col("normalised") + F.col("false_positive")))


def field_metrics(scored: DataFrame) -> DataFrame:
    """Outcomes and accuracy of each column."""
    return _metrics(scored, "column")


def role_metrics(scored: DataFrame) -> DataFrame:
    """Outcomes and accuracy of each role."""
    return _metrics(scored, "role")


def row_metrics(scored: DataFrame, *outcomes: str) -> DataFrame:
    """row_number, fields, exact (a missing value rightly left out counts), normalised, complete, accuracy; and n_... for each
    of the outcomes asked for."""
    seen = scored.where("outcome <> 'not_evaluated'")
    out = seen.groupBy("row_number").agg(F.count("*").alias("fields"), F.count_if(F.col("outcome").isin("exact", "missing_correct")).alias("exact"), F.count_if(F.col("outcome") == "normalised").alias("normalised"), *(F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in outcomes))
    return out.withColumn("complete", F.col("exact") + F.col("normalised") == F.col("fields")).withColumn("accuracy", F.round((F.col("exact") + F.col("normalised")) / F.col("fields"), 4))


def evaluation_summary(scored: DataFrame) -> DataFrame:
    """One row: fields, exact and normalised rates, missing values rightly left out, and complete rows."""
    # Rows are put together first and fields summed over them, so that the scores are worked out once.
    tally = row_metrics(scored, "exact", "missing_correct", "missing_incorrect")
    n = lambda *names: sum((F.coalesce(F.sum(c), F.lit(0)) for c in names[1:]), F.coalesce(F.sum(names[0]), F.lit(0)))
    return tally.agg(
        n("fields").alias("fields"), F.round(n("n_exact") / n("fields"), 4).alias("exact_rate"), F.round(n("n_exact", "normalised") / n("fields"), 4).alias("normalised_rate"),
        F.round(n("n_missing_correct") / F.greatest(n("n_missing_correct", "n_missing_incorrect"), F.lit(1)), 4).alias("missing_detection_rate"),
        F.count("*").alias("rows"), F.round(F.count_if("complete") / F.count("*"), 4).alias("complete_row_rate"), F.round(F.avg("accuracy"), 4).alias("average_row_accuracy"),
    )


def mismatches(scored: DataFrame) -> DataFrame:
    """row_number, column, expected, predicted, kind: the fields that count against a row (a value where none is expected, none
    where one is, or another one)."""
    kind = F.when(F.col("predicted").isNull(), "missing_incorrect").when(F.col("expected").isNull(), "false_positive").otherwise("mismatch")
    return scored.where(F.col("outcome").isin("missing_incorrect", "false_positive")).select("row_number", "column", "expected", "predicted", kind.alias("kind"))


def eval_join(fields: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: predicted rows, rows with truth and rows without. Truth for absent rows is ignored."""
    p = fields.select("row_number").distinct().join(truth.select("row_number", F.lit(True).alias("_t")).distinct(), "row_number", "left")
    return p.agg(F.count("*").alias("predicted_rows"), F.count_if("_t").alias("matched_rows")).withColumn("unmatched_rows", F.col("predicted_rows") - F.col("matched_rows"))


def latency_percentiles(df: DataFrame, by: str, value: str, ps: tuple[int, ...] = (50, 95, 99), exact: bool = True) -> DataFrame:
    """by and p50, p95, ...: the value at place min(floor(n p / 100), n - 1) of the sorted values.

    Exact: values are counted first, so a group's window holds distinct values, not rows; those stand in one task a
    group. With exact=False, percentile_approx combines before the shuffle, for groups with many distinct values."""
    if not exact:
        return df.groupBy(by).agg(*(F.percentile_approx(value, p / 100, 10000).alias(f"p{p}") for p in ps))
    counted = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(Window.partitionBy(by)))
    place = lambda p: F.least(F.floor(F.col("_all") * p / 100), F.col("_all") - 1)
    return ranked.groupBy(by).agg(*(F.min(F.when(F.col("_upto") > place(p), F.col(value))).alias(f"p{p}") for p in ps))


def throughput_failure(df: DataFrame, by: str, seconds: str = "latency_ms", failed: str = "failed") -> DataFrame:
    out = df.groupBy(by).agg(F.count("*").alias("rows"), F.sum(failed).alias("failures"), F.sum(seconds).alias("_ms"))
    out = out.withColumn("failure_rate", F.round(F.col("failures") / F.col("rows"), 4)).withColumn("success_rate", F.round(1 - F.col("failures") / F.col("rows"), 4))
    return out.withColumn("rows_per_second", F.round(F.col("rows") * 1000 / F.col("_ms"), 2)).drop("_ms")


def cost_summary(df: DataFrame, lookups: str, calls: str, lookup_rate: float = 0.001, llm_rate: float = 0.005) -> DataFrame:
    """One row: rows, total and average cost, and what 150,000 and 750,000 rows would cost."""
    out = df.agg(F.count("*").alias("rows"), F.round(F.sum(F.col(lookups)) * lookup_rate + F.sum(F.col(calls)) * llm_rate, 4).alias("total_cost"))
    out = out.withColumn("average_cost", F.round(F.col("total_cost") / F.col("rows"), 6))
    return out.withColumn("cost_150k", F.round(F.col("total_cost") / F.col("rows") * 150000, 2)).withColumn("cost_750k", F.round(F.col("total_cost") / F.col("rows") * 750000, 2))


def cache_stats(df: DataFrame, *keys: str) -> DataFrame:
    """One row: how many lookups of (trimmed, folded) keys would find one made before."""
    folded = [F.lower(F.trim(F.coalesce(F.col(k), F.lit("")))).alias(k) for k in keys]
    per = df.select(*folded).groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("lookups"), F.count("*").alias("misses")).withColumn("hits", F.col("lookups") - F.col("misses")).withColumn("hit_rate", F.round((F.col("lookups") - F.col("misses")) / F.col("lookups"), 4))


def llm_usage(calls: DataFrame, in_rate: float, out_rate: float) -> DataFrame:
    """One row: calls, rows, resolved rows, tokens and cost at the rates per million tokens."""
    out = calls.agg(F.count("*").alias("calls"), F.sum("rows").alias("rows"), F.sum("resolved").alias("resolved"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return out.withColumn("cost", F.round((F.col("prompt_tokens") * in_rate + F.col("completion_tokens") * out_rate) / 1e6, 6)).withColumn("cost_per_row", F.round((F.col("prompt_tokens") * in_rate + F.col("completion_tokens") * out_rate) / 1e6 / F.col("rows"), 8))


def category_histogram(df: DataFrame, path: str = "classpath") -> DataFrame:
    """classpath (null for none or the generic one), its leaf and rows."""
    from .taxonomy import is_unresolved

    p = F.when(~is_unresolved(path), F.col(path))
    return df.groupBy(p.alias("classpath")).agg(F.count("*").alias("rows")).withColumn("leaf", F.trim(F.element_at(F.split(F.col("classpath"), ">"), -1)))
