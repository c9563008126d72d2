"""Streams, stored batches and vocabulary files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import ledger, store
from tessella.plans.views import view
from tessella.sources import files, vocab
from tessella.streaming import streams


def test_files_are_enriched_once(spark, sf, tmp_path):
    rows = view(spark, sf, "catalogue_v").limit(6)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = streams.stream_ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_pages_give_facts_and_links(spark, sf, tmp_path):
    pages = view(spark, sf, "doc_pages_v").limit(8)
    pages.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = view(spark, sf, "catalogue_v").select("row_number", F.col("mfg_part_num").alias("part_number"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    streams.stream_document_facts(stream, rows, ["row_number"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/facts")).count() > 0


def test_visit_stream_gives_the_batch_rows(spark, sf, tmp_path):
    visits = view(spark, sf, "visits_v").withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    visits.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(visits.schema).parquet(str(tmp_path / "in"))
    q = streams.stream_visits(stream).writeStream.outputMode("complete").format("memory").queryName("visits_seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("visits_seen").collect())) == sorted(map(tuple, streams.visits_by_hour(visits).collect()))


def test_equal_rows_of_a_stream_come_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "v string, t int").withColumn("at", F.timestamp_seconds("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.stream_dedupe(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "at")
    q = stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.v for r in spark.table("once").collect()) == ["a", "b"]


def test_a_late_repeat_after_a_restart_is_still_a_repeat(spark, tmp_path):
    providers = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
    add = lambda rows: spark.createDataFrame(rows, "v string, t long").withColumn("at", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    steps = [[("a", 1), ("a", 2), ("b", 3)], [("c", 4_000_000), ("a", 4_000_001)], [("b", 90_000_000), ("d", 5), (None, 6), (None, 7)], []]
    seen = []
    try:
        for rows in steps:
            if rows:
                add(rows)
            stream = spark.readStream.schema("v string, at timestamp").parquet(str(tmp_path / "in"))
            streams.stream_intake(stream, "at", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
            seen.append(sorted((r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr))
    finally:
        for p in providers:
            spark.conf.unset(p)
    assert seen == [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d", None], ["a", "b", "c", "d", None]]


def test_batches_are_written_and_dropped_alone(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(2, "a"), (3, "b")], "row_number int, v string")
    for org, batch in (("o", "x"), ("o", "y"), ("p", "x")):
        store.store_batch(df, root, org, batch)
    store.store_batch(df.limit(1), root, "o", "x")
    assert store.read_batch(spark, root, "o", "x").count() == 1
    assert store.drop_batch(spark, root, "o", "y") == 2 and store.drop_batch(spark, root, "o", "zz") == 0
    assert spark.read.parquet(root).count() == 3
    assert not (tmp_path / "t/organization_id=o/batch_id=y").exists()
    assert sorted(map(tuple, store.stored_batches(spark, root).collect())) == [("o", "x", 1), ("p", "x", 2)]


def test_products_are_replaced_with_their_evidence_in_one_commit(spark, tmp_path):
    root, keys = str(tmp_path / "p"), ["product_id", "version_id"]
    schema = "product_id string, version_id string, name string, evidence array<struct<source:string,page:int>>"
    make = lambda rows: spark.createDataFrame(rows, schema)
    read = lambda: sorted(((r.product_id, r.version_id, r.name, tuple(map(tuple, r.evidence or []))) for r in ledger.read_products(spark, root).collect()), key=repr)
    assert ledger.read_products(spark, root) is None and ledger.drop_products(make([]), root, keys) == 0
    first = [(f"p{k}", "v1", n, [("a", k), ("b", 1)]) for k in range(200) for n in ("size", "material")] + [(None, "v1", "size", None)]
    assert ledger.store_products(make(first), root, keys) == 1 and len(read()) == 401
    assert ledger.store_products(make([("p7", "v1", "size", [("new", 9)]), ("p7", "v2", "size", [])]), root, keys) == 2
    assert [x for x in read() if x[0] == "p7"] == [("p7", "v1", "size", (("new", 9),)), ("p7", "v2", "size", ())] and len(read()) == 401
    touched = len([*(tmp_path / "p/data").glob("*/_bucket=*")])
    assert touched <= 64 + 2  # only two buckets were written again
    before = read()
    with pytest.raises(Exception):  # a task that fails leaves the table as it was
        ledger.store_products(make([("p9", "v1", "size", [])]).withColumn("name", F.raise_error(F.lit("lost")).cast("string")), root, keys)
    assert read() == before and ledger.store_products(make([]), root, keys) == 2
    assert ledger.drop_products(make([("p7", "v1", "", []), ("zz", "v1", "", [])]).select(*keys), root, keys) == 3
    assert [x for x in read() if x[0] == "p7"] == [("p7", "v2", "size", ())]
    assert ledger.vacuum(spark, root) > 0 and len(read()) == 400
    folders = [*(tmp_path / "p/data").glob("*/_bucket=*")]
    assert len(folders) == len(ledger._manifest(spark, root)[1]) and all([*f.glob("*.parquet")] for f in folders)
    assert ledger.drop_products(spark.createDataFrame([(f"p{k}", v) for k in range(200) for v in ("v1", "v2")] + [(None, "v1")], "product_id string, version_id string"), root, keys) == 4
    assert [x[0] for x in read()] == [None]  # null keys are equal to nothing


def test_vocabulary_files_follow_the_seed(spark, tmp_path):
    (tmp_path / "manufacturers_own.csv").write_text("canonical,aliases,source\nNew Valve,Milwaukee|NV,own\n")
    (tmp_path / "brands.json").write_text(json.dumps({"type": "brand", "entries": [{"canonical": "Zed", "aliases": ["Zee"]}]}))
    (tmp_path / "notes.csv").write_text("canonical,aliases,source\nNobody,,x\n")
    both = vocab.vocab_overlay(vocab.seed_vocab(spark), vocab.load_vocab(spark, str(tmp_path)))
    got = {(r.vocab, r.form): r.canonical for r in vocab.latest_forms(both).where("form in ('milwaukee', 'zee', 'nobody')").collect()}
    assert got == {("manufacturer", "milwaukee"): "New Valve", ("brand", "milwaukee"): "Milwaukee", ("brand", "zee"): "Zed"}


def test_truth_files(spark, tmp_path):
    path = tmp_path / "truth.csv"
    path.write_text("row_number,Material,size_uom\n2,Brass,in\n3, ,mm\n")
    assert [tuple(r) for r in files.load_truth(spark, str(path)).orderBy("row_number").collect()] == [(2, "Brass", "in"), (3, None, "mm")]
