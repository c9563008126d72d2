"""Queries of this part against SQL, and the pipeline against a plain one."""

from __future__ import annotations

import re

import pytest
from compare import duck, rows

import corpus_pipeline
from tessella.llm import pii, queries, tokens
from test_operators import _components


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(duck(sf).execute(queries.SQL[name]).fetchdf())


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = docs
        assert name == "packing" or docs.columns == columns
    texts = {r.doc_id: r.text for r in kept["pii"].collect()}
    assert all(re.search("[^\\W\\d_]", t) for t in texts.values())
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) for t in texts.values())
    ids = {r.doc_id for r in kept["packing"].collect()}
    assert ids == set(texts)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == ids


def _without_items(t, items):
    """t without the words of any window of an item, and what stands between them; words as plain runs."""
    low = lambda x: x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = lambda x: [*re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(x))]
    windows = {}
    for item in items:
        w = [m[0] for m in found(item or "")]
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(k, set()).add(tuple(w[a : a + k]))
    words, hit = found(t), set()
    for k, known in windows.items():
        for a in range(len(words) - k + 1):
            if tuple(m[0] for m in words[a : a + k]) in known:
                hit.update(range(a, a + k))
    out, at = [], 0
    for a in sorted(hit):
        if a - 1 not in hit:
            out.append(t[at : words[a].start()])
        at = words[a].end()
    return "".join([*out, t[at:]])


def test_pipeline_does_what_a_plain_one_does(spark, sf):
    """All stages in plain Python, on the test table and short near copies."""
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    extra = [(10**6 + 3 * k + j, " ".join([f"{w}{k}" for w in base[: 7 + j]])) for k in range(12) for j in (0, 1)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(i, t) for i, t in extra], "doc_id long, text string").selectExpr(*(c if c in ("doc_id", "text") else f"cast(null as {docs.schema[c].dataType.simpleString()}) as {c}" for c in docs.columns))
    more = more.select(*(more[c].cast(docs.schema[c].dataType) for c in docs.columns))
    whole = docs.unionByName(more)
    plain = [(r.doc_id, r.text) for r in whole.select("doc_id", "text").collect() if r.text and re.search("[^\\W\\d_]", r.text)]
    kept = _components(plain)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {i: pii.redact_text(_without_items(t, items)) for i, t in plain if kept[i][1] == i}
    assert len([i for i in want if i >= 10**6]) == 12
    df = whole
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
    assert {r.doc_id: r.text for r in df.select("doc_id", "text").collect()} == want
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, df, sf).select("doc_id", "length").collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert pieces == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in want.items()}
