"""Rules on hand-written rows."""

from __future__ import annotations

import csv
import io
import json
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.functions import cells as C, extract as X, ranges
from tessella.operators import delivery, documents, enrich, match, metrics, products, review, taxonomy, validate, web
from tessella.plans.views import view
from tessella.resources import values as V
from tessella.sources import files, nested, vocab


def _one(spark, expression, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expression(*names).alias("x")).first().x


def test_role_order():
    assert C.role_of("temp_rating") == "pressure"
    assert C.role_of("brand_manufacturer") == "brand"
    assert C.role_of("valid") == "other"
    assert C.role_of("productid") == "part_number"


def test_roles_on_driver_and_in_sql_agree(spark):
    names = ["SKU", "Item Description", "Vendor", "list_price", "size_uom", "pressure_uom", "liquid", "x_id", "end_conn", "temp"]
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", C.detect_role("n").alias("r")).collect()
    assert {r.n: r.r for r in found} == {n: C.role_of(n) for n in names}


def test_names_match_in_steps(spark):
    expression = lambda c: match.vocab_expression(c, V.MANUFACTURERS)
    assert _one(spark, expression, "Parker-Hannifin").asDict() == {"canonical": "Parker Hannifin", "confidence": 1.0, "match_type": "exact"}
    assert _one(spark, expression, "milwaukee")["canonical"] == "Milwaukee Tool"
    assert _one(spark, expression, "Emerson Electric Company Intl")["match_type"] == "normalized"
    assert _one(spark, expression, "\u3042\u3044")["confidence"] == 0.0
    assert _one(spark, expression, None)["match_type"] == "none"


def test_join_and_expression_agree(spark):
    df = spark.createDataFrame([("Apollo",), ("Watts Water Technologies Inc",), ("nobody",), (None,), ("--",)], "name string")
    joined = match.match_vocab_contains(df, "name", vocab.seed_vocab(spark), "manufacturer").collect()
    direct = df.select("name", match.vocab_expression("name", V.MANUFACTURERS).alias("m")).select("name", "m.*").collect()
    key = lambda r: str(r.name)
    assert sorted(joined, key=key) == sorted(direct, key=key)


def test_large_vocabularies_meet_cells_without_a_product(spark):
    rnd = random.Random(2)
    name = lambda: "".join(rnd.choice("abc d") for _ in range(rnd.choice([1, 2, 3, 5, 9, 14])))
    names = {k: name() for k in range(300)}
    vocab_rows = spark.createDataFrame([("manufacturer", k, n, [name() for _ in range(k % 3)], "x") for k, n in names.items()], "vocab string, ord long, canonical string, aliases array<string>, source string")
    cells = [name() + rnd.choice(["", " zz", "x"]) for _ in range(300)] + ["", None, "ä", "abc", "abc"]
    df = spark.createDataFrame(list(enumerate(cells)), "id int, name string")
    found = match.match_vocab_contains(df, "name", vocab_rows, "manufacturer")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    exact = {r.id: r for r in match.match_vocab_exact(df, "name", vocab_rows, "manufacturer").collect()}
    seen = set()
    for r in found.collect():
        key = match.plain_form(r.name or "")
        want = (exact[r.id].canonical, exact[r.id].match_type)
        if want[1] == "none" and key:
            near = [n for _, n in sorted(names.items()) if match.plain_form(n) and (key in match.plain_form(n) or match.plain_form(n) in key)]
            want = (near[0], "normalized") if near else ("", "none")
        assert (r.canonical, r.match_type) == want, r
        seen.add(r.match_type)
    assert len(seen) >= 3


def test_pairs_of_substrings(spark):
    texts, patterns = ["abcabc", "ab", "a", "xyz é", "zzzz"], ["bca", "ab", "a", "zzz", "é", "abcabcabc", "cab", "q"]
    one = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {tuple(r) for r in match.substring_pairs(one(texts, "text"), one(patterns, "pattern")).collect()}
    assert got == {(p, t) for p in patterns for t in texts if p in t}


def test_units_and_materials(spark):
    assert _one(spark, match.unit_expression, "Inches").asDict() == {"canonical": "in", "dimension": "length", "confidence": 1.0}
    assert _one(spark, match.unit_expression, "mm.")["confidence"] == 0.9
    assert _one(spark, match.unit_expression, "furlong").asDict() == {"canonical": "furlong", "dimension": "none", "confidence": 0.0}
    assert _one(spark, match.material_expression, "303 stainless steel alloy")["confidence"] == 0.8
    assert _one(spark, match.material_expression, None).asDict() == {"canonical": "", "confidence": 0.0}


def test_keywords_are_whole_words(spark):
    assert _one(spark, lambda c: taxonomy.classification(c, F.lit(None)), "hose clamp")["classpath"] == V.GENERIC_PATH
    assert _one(spark, lambda c: taxonomy.classification(c, F.lit(None)), "wide-range driver")["classpath"] == V.GENERIC_PATH
    assert _one(spark, lambda c: taxonomy.classification(c, F.lit(None)), "stud 2x4")["classpath"] == V.GENERIC_PATH
    assert _one(spark, lambda c: taxonomy.classification(c, F.lit(None)), "R-Sheathing")["fine"] == "Panels & Sheathing"
    assert _one(spark, taxonomy.classification, "widget", "Mirka USA")["dept"] == "Abrasives & Cutting Tools"


def test_the_dictionary_finds_what_the_patterns_of_the_rules_find(spark):
    rnd = random.Random(5)
    words = [w for x in V.TAXONOMY for w in x[0]]

    def text():
        parts = []
        for _ in range(rnd.randint(0, 6)):
            w = rnd.choice(words) if rnd.random() < 0.5 else rnd.choice(["hose", "clamp", "wide", "safety", "x9"])
            w = w.upper() if rnd.random() < 0.3 else w[: rnd.randint(1, len(w))] if rnd.random() < 0.2 else w
            parts.append(w + rnd.choice(["", "", "s", "es", "ing", "ed", "er"]) + rnd.choice([" ", "-", "  ", "/", "", ", ", "é", "1"]))
        return None if rnd.random() < 0.05 else "".join(parts)

    def rule(t):
        t = (t or "").lower()
        for k, (words, *_) in enumerate(V.TAXONOMY):
            for w in words:
                if re.search(f"(?<![{V.KEYWORD_BORDERS.get(w, 'A-Za-z0-9')}]){re.escape(w)}(?:s|es|ing|ed)?(?![A-Za-z0-9])", t):
                    return k
        return None

    def path(d, m):
        k = rule(d)
        return rule(m) if k is None else k

    rows = [(text(), text()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "d string, m string").repartition(4)
    starts = [x[1] for x in V.TAXONOMY]
    for r in df.select("d", "m", taxonomy.classification("d", "m").alias("c")).collect():
        k = path(r.d, r.m)
        assert r.c["classpath"] == V.GENERIC_PATH if k is None else r.c["classpath"].startswith(starts[k] + " > "), (r, k)


def test_rows_of_a_number_that_a_third_of_all_rows_has(spark):
    df = spark.range(600).selectExpr("cast(id as int) as row_number", "case when id % 3 = 0 then ' Hot ' when id % 3 = 1 then 'n' || cast(id div 6 as string) when id % 7 = 0 then null else '' end as part_number")
    out = {r.row_number: r for r in validate.other_rows(df.repartition(5), "part_number", shown=4).collect()}
    hot = [k for k in range(600) if k % 3 == 0]
    for k, nxt in zip(hot, [*hot[1:], None]):
        assert (out[k].part_key, out[k].rows, out[k].next_row, out[k].other_rows) == ("hot", 200, nxt, [x for x in hot[:5] if x != k][:4])
        assert out[k].message.endswith(", and 195 more")
    assert set(out) == {*hot, *(k for k in range(600) if k % 3 == 1)} and validate.other_rows(df.limit(0), "part_number").count() == 0


def test_a_conflict_names_all_of_its_pages(spark):
    facts = [("a", k, "size", "5 IN" if k == 9 else "4 in" if k % 2 else "4 IN") for k in range(300, 0, -1)] + [("a", 9, "size", "4 in"), ("a", 1, "material", "Brass"), ("a", 2, "material", "brass")]
    facts += [(None, k, "size", f"{k} in") for k in (2, 1)] + [("b", 1, "size", None), ("b", 2, "size", "1 in")]
    found = documents.conflicting_facts(spark.createDataFrame(facts, "document_id string, page int, name string, value string").repartition(5)).collect()
    assert {(r.document_id, r.name): (r.n_values, r.n_facts, r.pages) for r in found} == {("a", "size"): (2, 301, sorted([*range(1, 301), 9])), (None, "size"): (2, 2, [1, 2])}


def test_an_audit_export_names_all_events_of_a_row(spark):
    field = "struct<column: string, raw_value: string, canonical_value: string, transformation: string>"
    rows = spark.createDataFrame([(k, [("material", "ss", "Steel", "vocab")]) for k in (1, 2, 3)], f"row_number int, fields array<{field}>")
    events = [(1, f"e{k:03}", f"2024-01-01 00:0{k // 100}:{k // 2 % 50:02}", "correct", "corrected", f"by{k}") for k in range(299, -1, -1)] + [(1, "s1", None, "submit_for_review", "pending_review", None), (2, "s2", None, "auto_approve", "auto_approved", None)]
    audit = spark.createDataFrame(events, "row_number int, event_id string, decided_at string, action string, new_state string, reviewer string").withColumn("decided_at", F.col("decided_at").cast("timestamp"))
    out = {r.row_number: r for r in delivery.export_audit(rows, audit.repartition(5), ["row_number"]).collect()}
    assert {k: r.n_events for k, r in out.items()} == {1: 301, 2: 1, 3: None} and out[3].events is None
    assert [(e.place, e.reviewer) for e in out[1].events] == [(1, None), *((k + 2, f"by{k}") for k in range(300))]
    assert [(e.place, e.action, e.new_state, e.decided_at) for e in out[2].events] == [(1, "auto_approve", "auto_approved", None)]


def test_restored_decisions_are_events(spark):
    routed = spark.createDataFrame([(k, "auto_approved" if k == 4 else "pending_review", f"s{k}") for k in range(1, 7)], "row_number int, state string, event_id string")
    stored = spark.createDataFrame([(1, "approved", "ann", "2024-01-02"), (2, "rejected", None, None), (3, "pending_review", "bo", None), (4, "auto_approved", None, None), (5, "corrected", "cy", "2024-03-01"), (99, "approved", "ann", None)], "row_number int, review_state string, reviewer string, decided_at string")
    known = spark.createDataFrame([(5, "e5", "correct", "pending_review", "corrected", "cy", None)], "row_number int, event_id string, action string, previous_state string, new_state string, reviewer string, decided_at timestamp")
    state, audit = review.replay_events(routed, stored, ["row_number"], known)
    assert sorted((r.row_number, r.state, r.reviewer, r.n_events) for r in state.collect()) == [(1, "approved", "ann", 2), (2, "rejected", None, 2), (3, "pending_review", None, 1), (4, "auto_approved", None, 1), (5, "corrected", "cy", 2), (6, "pending_review", None, 1)]
    told = {r.row_number: r for r in audit.where("place = 2").collect()}
    assert set(told) == {1, 2, 5} and told[5].event_id == "e5" and told[5].comment is None
    assert (told[1].action, told[1].previous_state, told[1].new_state) == ("approve", "pending_review", "approved") and "from storage" in told[1].comment and "not recorded" in told[2].comment
    assert audit.select("event_id").distinct().count() == audit.count()


def test_prose_states_no_facts(spark):
    assert _one(spark, X.facts_of, "Saves on materials and installation time") == []
    assert [f.name for f in _one(spark, X.facts_of, "Catalog Number: see table below")] == []
    assert [(f.name, f.value) for f in _one(spark, X.facts_of, "Body Material: Brass\nPart No.: AB-12")] == [("material", "Brass"), ("part_number", "AB-12")]


def test_part_number_with_pattern_characters_is_stripped(spark):
    assert _one(spark, X.strip_part_number, "A.B+C 15A lamp", "A.B+C").strip() == "15A lamp"


def test_distributor_is_not_a_manufacturer(spark):
    df = spark.createDataFrame([(2, "Boise Cascade (BOISE)", "board"), (3, None, "Nibco valve"), (4, "-- none --", "Nibco valve")], "row_number int, part_manuf string, part_desc string")
    got = {r.row_number: r.fields[0] for r in enrich.enrich_batch(df).collect()}
    assert (got[2].transformation, got[2].canonical_value, got[2].status) == ("distributor_not_manufacturer", "Boise Cascade (BOISE)", "review_required")
    assert (got[3].canonical_value, got[3].status) == ("Nibco", "inferred")
    assert (got[4].canonical_value, got[4].transformation) == (None, "placeholder")


def test_all_null_rows_pass_through(spark):
    df = spark.createDataFrame([(2, None, None)], "row_number int, mfg_part_num string, part_desc string")
    v = validate.validate_batch(enrich.enrich_batch(df)).first()
    assert not v.can_auto_approve and {i.code for i in v.issues} == {"MISSING_REQUIRED_COLUMN", "MISSING_REQUIRED_VALUE"}
    assert delivery.wide_record(delivery.delivery_record(df)).first()["Product Name"] == ""


def test_only_the_first_sound_decision_holds(spark):
    routed = spark.createDataFrame([(2, "pending_review", "e"), (3, "auto_approved", "f")], "row_number int, state string, event_id string")
    decided = spark.createDataFrame([("1", 2, "correct", "a", 1, None), ("2", 2, "reject", "a", 2, None), ("3", 2, "approve", "b", 3, None), ("4", 3, "approve", "b", 1, None), ("5", 9, "approve", "b", 1, None)], "event_id string, row_number int, action string, reviewer string, t int, corrections string")
    decided = decided.withColumn("decided_at", F.timestamp_seconds("t")).drop("t")
    state, audit, refused = review.apply_decisions(routed, decided, ["row_number"])
    assert {r.row_number: r.state for r in state.collect()} == {2: "rejected", 3: "auto_approved"}
    assert {r.event_id: r.refusal for r in refused.collect()} == {"1": "no_corrections", "3": "not_pending", "4": "not_pending", "5": "unknown_row"}
    assert audit.count() == 3


def test_hosts_and_snippets(spark):
    assert _one(spark, web.url_host, "https://WWW.Parker.com/p?q=1") == "parker.com"
    assert _one(spark, web.url_host, "no address") == ""
    assert _one(spark, lambda c: web.match_snippet(c, C.part_variants(F.lit("AB 1"))), "<p>The AB-1 valve</p><script>AB 1</script>") == "The AB-1 valve"
    assert _one(spark, lambda c: web.match_snippet(c, C.part_variants(F.lit("ZZ9"))), "<script>ZZ9</script>") is None


def test_percentiles_of_ties_and_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 5.0), ("b", 2.0)], "g string, v double")
    got = {r.g: (r.p50, r.p99) for r in metrics.latency_percentiles(df, "g", "v").collect()}
    assert got == {"a": (1.0, 5.0), "b": (2.0, 2.0)}


def test_header_rules():
    assert files.header_separator('"a;b";c,d') == ","
    assert files.header_separator("a;b;c,d") == ";"
    assert files.header_separator("a,b", ".tsv") == "\t"


def test_csv_feed(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text('SKU;Item Description;;sku\nA1;"two; parts"; x ;B1\n;;;\nn/a;short\n')
    got = files.read_catalogue_csv(spark, str(path)).orderBy("row_number").collect()
    assert [(r.row_number, r.sku, r.item_description) for r in got] == [(2, "B1", "two; parts"), (4, None, "short")]


def test_json_and_xml_feeds(spark, tmp_path):
    a = tmp_path / "a.json"
    a.write_text('{"items": [{"SKU": "A", "n": {"x": 1}}, 5, {"SKU": "B"}]}')
    assert [r.sku for r in files.read_catalogue_json(spark, str(a), ["SKU", "n"]).orderBy("row_number").collect()] == ["A", "B"]
    whole = files.read_catalogue_json(spark, str(a))
    assert {"n", "sku"} < set(whole.columns) and [(r.sku, r.n) for r in whole.orderBy("row_number").collect()] == [("A", '{"x":1}'), ("B", None)]
    x = tmp_path / "a.xml"
    x.write_text('<feed><item id="7"><SKU>A</SKU></item><item id="8"><SKU>B</SKU></item></feed>')
    assert sorted((r.id, r.sku) for r in files.read_catalogue_xml(spark, str(x), "item").collect()) == [("7", "A"), ("8", "B")]


def test_pages_are_searched_to_their_end(spark):
    pages = spark.createDataFrame([("https://a.com/1", "x" * 299_998 + " part PN-4711"), ("https://a.com/2", "PN-4711")], "url string, html string")
    candidates = spark.createDataFrame([("PN-4711", 1, "https://a.com/1"), ("PN-4711", 2, "https://a.com/2")], "part_number string, rank int, url string")
    got = [tuple(r) for r in web.verify_on_pages(candidates, pages).collect()]
    assert got == [("PN-4711", 1, "https://a.com/1", "verified", 0.9)]


def test_pages_of_a_host_by_part_number(spark):
    pages = spark.createDataFrame([("https://www.a.com/1", "x PN 4711 y"), ("https://a.com/search?q=ab", "AB-CD zz77"), ("http://a.com/2", "xab-cdx ü q9"), ("http://a.com/3", "pn-4711"), ("http://b.com/1", "pn4711 PN-4711"), (None, "pn4711"), ("http://a.com/4", None)], "url string, html string")
    rows = [("PN 4711", 1, "https://a.com/x"), ("PN 4711", 2, "https://b.com"), ("AB-CD", 1, "https://b.com/x"), ("AB-CD", 2, "http://www.A.com/"), ("zz77", 1, "https://a.com"), ("Q9", 1, "http://a.com"), ("none", 1, "http://a.com"), ("none", 2, "https://www.amazon.com/x"), ("none", 3, None), ("none", 4, "http://c.com"), ("Ü", 5, "http://a.com")]
    got = {(r.part_number, r.rank): (r.status, r.confidence, r.page, r.n_pages) for r in web.verify_by_host(spark.createDataFrame(rows, "part_number string, rank int, url string"), pages).collect()}
    assert got == {
        ("PN 4711", 1): ("verified", 0.9, "http://a.com/3", 2), ("AB-CD", 1): ("fetched", 0.1, None, 0), ("AB-CD", 2): ("verified", 0.9, "http://a.com/2", 1), ("zz77", 1): ("fetched", 0.2, None, 0), ("Q9", 1): ("verified", 0.9, "http://a.com/2", 1),
        ("none", 1): ("fetched", 0.1, None, 0), ("none", 2): ("blocked", 0.0, None, 0), ("none", 3): ("unreached", 0.0, None, 0), ("none", 4): ("unreached", 0.0, None, 0), ("Ü", 5): ("verified", 0.9, "http://a.com/2", 1),
    }


def test_feeds_are_decoded_by_all_their_bytes(spark, tmp_path):
    (tmp_path / "a b.csv").write_bytes("name,note\nplain,x\nCafé “big” €5™,naïve\n".encode("cp1252"))
    (tmp_path / "latin.csv").write_bytes(b"name,note\nCaf\xe9 \x81,y\n")
    (tmp_path / "utf8.csv").write_bytes("name,note\nplain,z\nCafé €,中\n".encode())
    read = lambda p: sorted((r.row_number, r.name, r.note) for r in files.read_catalogue_csv(spark, str(p)).collect())
    cp1252, latin, utf8 = [(2, "plain", "x"), (3, "Café “big” €5™", "naïve")], [(2, "Café \x81", "y")], [(2, "plain", "z"), (3, "Café €", "中")]
    assert files.file_encodings(spark, str(tmp_path / "latin.csv")).popitem()[1] == "ISO-8859-1"
    assert read(tmp_path / "a b.csv") == cp1252 and read(tmp_path / "utf8.csv") == utf8
    assert [r[2] for r in read(tmp_path / "latin.csv")] == ["y"]
    assert [r for r in read(tmp_path) if r[2] != "y"] == sorted(cp1252 + utf8)


def test_xml_values_stay_as_written_and_rows_are_numbered(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<c>" + "".join(f'<item id="0{k:04d}"><price>{k}.50</price></item>' for k in range(40)) + "</c>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        got = files.read_catalogue_xml(spark, str(tmp_path / "a.xml"), "item").orderBy("row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.row_number for r in got] == list(range(2, 42))
    assert [(r.id, r.price) for r in got] == [(f"0{k:04d}", f"{k}.50") for k in range(40)]


def test_class_paths_are_trimmed_at_their_parts(spark):
    assert _one(spark, taxonomy.delivery_classpath, " A > B  >C ") == "A>B>C"
    family = next(iter(V.ATTRIBUTE_LABELS))
    found = F.array(F.struct(F.lit("Grit").alias("label"), F.lit("P80").alias("value"), F.lit(None).cast("string").alias("uom")))
    laid = _one(spark, lambda c: taxonomy.attribute_template(found, c), f"Top > {family} > Leaf")
    assert [x.label for x in laid][: len(V.ATTRIBUTE_LABELS[family])] == V.ATTRIBUTE_LABELS[family]


def test_standards_and_warranty_are_fixed_texts(spark):
    df = spark.createDataFrame([("P1", "hose clamp", None), (None, None, None)], "mfg_part_num string, part_desc string, part_manuf string")
    got = delivery.wide_record(delivery.delivery_record(df)).select("`Standard/Approvals`", "Warranty").collect()
    assert [tuple(r) for r in got] == [(V.STANDARDS, V.WARRANTY)] * 2


def test_export_delivery_writes_all_columns(spark, tmp_path):
    df = spark.createDataFrame([("P1", 'a "quoted", part', "Apollo")], "mfg_part_num string, part_desc string, part_manuf string")
    delivery.export_delivery(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.columns == V.delivery_columns() and back.first()["Part_Desc"] == 'a "quoted", part'


@pytest.mark.parametrize("most", [64, 150, 1 << 20])
def test_quoted_feeds_in_many_splits_give_the_rows_of_a_plain_reader(spark, tmp_path, most):
    """Line breaks and separators in quotes, doubled quotes, inch marks in plain cells, cells longer than many splits,
    empty lines, short and long rows, line breaks of two characters, several files of different encodings."""
    rnd = random.Random(most)
    pieces = ["a", "b c", "5\" pipe", "é€", ",", ";", '"', "\n", "\n\n", "x", "", "12", " "]
    want = []
    for name, encoding, end, rows in (("a.csv", "utf-8", "\n", 150), ("b.csv", "cp1252", "\r\n", 60), ("c.csv", "utf-8", "\n", 0), ("d.csv", "utf-8", "\n", 1)):
        out = ["sku,note,size"]
        for k in range(rows):
            cells = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 5))) for _ in range(rnd.choice([1, 3, 3, 3, 4]))]
            cells = [c * 60 if rnd.random() < 0.03 else c for c in cells]
            cells[0] = f"{name}{k}" + cells[0]
            out.append(",".join('"' + c.replace('"', '""') + '"' if rnd.random() < 0.3 or re.search('[,\n]|^"', c) else c for c in cells))
            out += [""] * rnd.choice([0, 0, 0, 1])
        text = end.join(x.replace("\n", end) for x in out) + rnd.choice(["", end])
        (tmp_path / name).write_bytes(text.encode(encoding))
        plain = [r for r in csv.reader(io.StringIO(text, newline=""), strict=False) if r][1:]
        clean = lambda c: None if re.sub(r"\s+", " ", c).strip().lower() in C.BLANK else re.sub(r"\s+", " ", c).strip()
        want += [(k + 2, *(clean(c) for c in (r + [""] * 3)[:3])) for k, r in enumerate(plain)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(most))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = files.read_catalogue_csv(spark, str(tmp_path))
        got = [tuple(r) for r in df.select("row_number", "sku", "note", "size").collect()]
        assert most > 1000 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_quote_that_is_never_closed_and_an_empty_feed(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\ny,z\n2,q\n')
    assert [tuple(r) for r in files.read_catalogue_csv(spark, str(tmp_path / "open.csv")).select("row_number", "a", "b").collect()] == [(2, "1", "x y,z 2,q")]
    (tmp_path / "none.csv").write_text("")
    assert files.read_catalogue_csv(spark, str(tmp_path / "none.csv")).count() == 0


def test_a_batch_is_written_as_one_json_document_in_parts(spark, sf, tmp_path):
    routed = review.route_rows(validate.validate_batch(enrich.enrich_batch(view(spark, sf, "catalogue_v").limit(40)))).cache()
    delivery.write_json_document(delivery.json_document(routed, "source_name"), str(tmp_path / "out"), "source_name")
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    got = json.loads(text)
    assert got["batch"]["source_file"] == "part_feed" and got["batch"]["row_count"] == 40
    assert [r["row_number"] for r in got["rows"]] == sorted(r.row_number for r in routed.collect())
    states = {r.row_number: r.state for r in routed.collect()}
    assert all(r["review_state"] == states[r["row_number"]] and r["fields"]["material"]["evidence"]["source_row"] == r["row_number"] for r in got["rows"])
    assert got["validation"]["auto_approve_count"] + got["validation"]["review_required_count"] == 40


def test_rules_of_nested_versions(spark):
    good = ("size", 0.5, [("s", "t", 1), ("s", "t", None)])
    rows = [
        ("p", "v", [good]), ("p", " ", [("size", None, [("s", "t", None)])]), ("p", "v2", [("", 2.0, None), ("a", 0.1, []), ("a", 0.1, [(" ", None, 0)])]), ("p", "v3", None), (None, "v4", []),
    ]
    df = spark.createDataFrame(rows, "product_id string, version_id string, attributes array<struct<name:string,confidence:double,evidence:array<struct<source_name:string,source_type:string,page:int>>>>")
    got = sorted((r.version_id, r.name, r.violation) for r in products.nested_constraints(df).collect() if r.name is not None)
    assert got == [("v2", "", "CONFIDENCE_RANGE"), ("v2", "", "EMPTY_NAME"), ("v2", "", "NO_EVIDENCE"), ("v2", "a", "EMPTY_SOURCE_NAME"), ("v2", "a", "EMPTY_SOURCE_TYPE"), ("v2", "a", "NO_EVIDENCE"), ("v2", "a", "PAGE_RANGE"), ("v2", "a", "REPEATED_NAME")]
    assert sorted((r.version_id, r.violation) for r in products.nested_constraints(df).where("name is null").collect()) == [(" ", "EMPTY_ID"), ("v4", "EMPTY_ID")]


def test_running_totals_over_a_key_in_many_ranges(spark, tmp_path):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, id, 1) as k", "id as o").repartition(7)
    out = ranges.running(df, "k", ["o"], str(tmp_path / "t"), {"n": ("sum", F.lit(1)), "z": ("xor", F.col("o"))}).collect()
    seen = defaultdict(lambda: [0, 0])
    for r in sorted(out, key=lambda r: r.o):
        seen[r.k][0] += 1
        seen[r.k][1] ^= r.o
        assert [r.n, r.z] == seen[r.k]


def _json_rows(doc):
    """The objects of a feed with their places, as a plain reader finds them."""
    if isinstance(doc, dict):
        named = [doc[k] for k in nested.LISTS if isinstance(doc.get(k), list)]
        filled = [v for v in doc.values() if isinstance(v, list) and v and isinstance(v[0], dict)]
        doc = (named or filled or [[doc]])[0]
    return [(k + 2, x) for k, x in enumerate(doc) if isinstance(x, dict)]


@pytest.mark.parametrize("most", [60, 1 << 20])
def test_json_feeds_in_many_splits_give_the_rows_of_a_plain_reader(spark, tmp_path, most):
    """Braces, brackets, quotes and backslashes in strings, nested values, items that are no objects, records longer than
    many splits, lists under known and other names, other lists before them, one object, minified and indented."""
    rnd = random.Random(most)
    text = lambda: "".join(rnd.choice(['a', '"', "\\", "{", "}", "[", "]", ",", ":", "é", "\n", "x" * 9]) for _ in range(rnd.randint(0, 9)))

    def item(k):
        x = {"SKU": f"s{k}", "note": text() or "n", "n": rnd.choice([1, None, True, {"a": [text(), {"b": 1}]}, [{"c": text()}], "z" * 400 if rnd.random() < 0.1 else "y"])}
        return rnd.choice([5, text(), [x], None]) if rnd.random() < 0.1 else x

    lists = lambda n: [item(k) for k in range(n)]
    docs = {
        "a.json": lists(30), "b.json": {"meta": {"items": [1, {"SKU": "no"}], "t": text()}, "other": [{"SKU": "no"}], "tags": ["x"], "items": lists(12), "last": text()}, "c.json": {"k": 1, "list": [{"SKU": "first"}, *lists(5)], "more": [{"SKU": "no"}]},
        "d.json": {"SKU": "single", "n": [1, 2], "o": {"p": [{"q": 1}]}}, "e.json": [], "f.json": {"rows": [], "z": [{"SKU": "no"}]}, "g.json": [1, "}", [{"SKU": "no"}]],
    }
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(most))
    spark.conf.set("spark.sql.files.openCostInBytes", "8")
    try:
        for k, (name, doc) in enumerate(docs.items()):
            raw = json.dumps(doc, ensure_ascii=k % 2 == 0, indent=2 if k % 3 == 1 else None, separators=(",", ":") if k % 3 == 0 else None)
            (tmp_path / name).write_text(("\ufeff" if k == 2 else "") + raw + ("\n" if k % 2 else ""), encoding="utf-8")
            got = {r.pos + 2: json.loads(r.record) for r in nested.records(spark, str(tmp_path / name)).collect()}
            assert got == dict(_json_rows(doc)), name
        got = sorted((r.file.rsplit("/", 1)[1], r.pos + 2, json.dumps(json.loads(r.record))) for r in nested.records(spark, str(tmp_path)).collect())
        assert got == sorted((name, k, json.dumps(x)) for name, doc in docs.items() for k, x in _json_rows(doc))
        rows = files.read_catalogue_json(spark, str(tmp_path / "a.json"), ["SKU", "note"]).collect()
        assert sorted(r.row_number for r in rows) == [k for k, _ in _json_rows(docs["a.json"])]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
