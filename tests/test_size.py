"""Work that is dear by the row is spread over tasks and done once, whatever the files and the filters are."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.operators import delivery, documents, enrich, match, review
from tessella.plans.queries import QUERIES
from tessella.plans.views import view

#: What stands once in the enrichment of a batch, and what only the reading of facts has.
ENRICHED, FACTS = "distributor_not_manufacturer", "regexp_extract("


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["overlay_review", "review_summary", "current_review_state", "refused_decisions", "queue_audit_count", "replay_audit", "export_audit", "export_json_document"])
def test_routed_rows_are_stored(spark, sf, name):
    assert ENRICHED not in plan(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["enrich_fields", "field_metrics", "role_metrics", "row_metrics", "mismatches", "evaluation_summary"])
def test_fields_are_worked_out_once(spark, sf, name):
    assert plan(QUERIES[name](spark, sf)).count(ENRICHED) == 1


@pytest.mark.parametrize("name", ["conflicting_facts", "documents_for_part"])
def test_facts_are_stored(spark, sf, name):
    assert FACTS not in plan(QUERIES[name](spark, sf))


def test_facts_are_read_once(spark, sf):
    steps = plan(QUERIES["extract_facts"](spark, sf)).split("\n")
    assert not [x for x in steps if "Filter" in x and FACTS in x]


@pytest.mark.parametrize("work", [enrich.enrich_batch, delivery.delivery_record, lambda rows: match.infer_from_text_vocab(rows, "part_desc")])
def test_rows_of_one_split_are_spread(spark, sf, work):
    one = view(spark, sf, "catalogue_v").coalesce(1)
    assert work(one).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_pages_of_one_split_are_spread(spark, sf):
    facts = documents.extract_facts(view(spark, sf, "doc_pages_v").coalesce(1))
    assert facts.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_fields_of_rows_without_any(spark):
    none = enrich.enrich_batch(spark.createDataFrame([(1, "x")], "row_number int, source_name string"))
    assert enrich.exploded_fields(none, "row_number").count() == 0


def test_repeated_rows_keep_their_states(spark):
    routed = spark.createDataFrame([(1, "a", "pending_review"), (1, "b", "pending_review"), (2, "c", "auto_approved")], "row_number int, event_id string, state string")
    decisions = spark.createDataFrame([], "row_number int, event_id string, action string, reviewer string, decided_at timestamp, corrections string")
    state, audit, refused = review.apply_decisions(routed, decisions, ["row_number"])
    assert (state.count(), audit.count(), refused.count()) == (3, 3, 0)
