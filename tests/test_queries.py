"""Every catalogue query with SQL against DuckDB."""

from __future__ import annotations

import pytest
from compare import duck, rows
from pyspark.sql import functions as F

from tessella.plans.oracles import ORACLES
from tessella.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf, con, name):
    found = QUERIES[name](spark, sf).toPandas()
    wanted = con.execute(ORACLES[name]).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_a_conflict_of_very_many_pages_gives_the_rows_of_its_sql(spark, sf, tmp_path):
    parts = spark.read.parquet(f"{sf}/part.parquet").withColumn("p_partkey", F.when(F.col("p_partkey") % 2 == 0, 4).otherwise(F.col("p_partkey")).cast("long"))
    parts.toPandas().to_parquet(tmp_path / "part.parquet")
    found = QUERIES["conflicting_facts"](spark, str(tmp_path)).toPandas()
    assert found["pages"].str.count(",").max() >= 100
    assert rows(found) == rows(duck(str(tmp_path)).execute(ORACLES["conflicting_facts"]).fetchdf())


@pytest.mark.parametrize("name", ["enrich_fields", "validate_batch", "route_rows", "current_review_state", "delivery_wide", "export_jsonld"])
def test_rows_are_kept(spark, sf, name):
    df = QUERIES[name](spark, sf)
    n = QUERIES["clean_cells"](spark, sf).count()
    assert df.count() == n * (8 if name == "enrich_fields" else 1)


def test_no_python_in_catalogue_plans(spark, sf):
    for name in ("route_rows", "delivery_record", "match_manufacturer"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan
