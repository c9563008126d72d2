"""One query per catalogue operator, over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cells as C, extract as X, ranges
from ..operators import delivery, documents, enrich, match, metrics, products, review, store, suggestions, taxonomy, validate, web
from ..sources import files, vocab
from ..streaming import streams
from .views import view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _catalogue(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "catalogue_v")


def _enriched(s: SparkSession, d: str) -> DataFrame:
    return enrich.enrich_batch(_catalogue(s, d))


def _validated(s: SparkSession, d: str) -> DataFrame:
    return validate.validate_batch(_enriched(s, d))


def _routed(s: SparkSession, d: str) -> DataFrame:
    return review.route_rows(_validated(s, d))


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    """What decisions need of routed rows."""
    return _routed(s, d).select("row_number", "event_id", "state")


def _facts(s: SparkSession, d: str) -> DataFrame:
    return documents.extract_facts(view(s, d, "doc_pages_v"))


def _decisions(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "decisions_v").withColumn("corrections", F.col("corrected_material"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    fields = enrich.exploded_fields(_enriched(s, d), "row_number")
    return metrics.scored_fields(fields, view(s, d, "truth_v"))


# Feeds


def _feed(s: SparkSession, d: str) -> DataFrame:
    """Parts as a feed's rows, with quotes, separators and line breaks in their cells."""
    note = F.concat("p_name", F.lit('\n5" pipe; "'), "p_type", F.lit('",\n\n'), F.col("p_size").cast("string"))
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("SKU"), note.alias("Item Description"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise("N/A").alias("Vendor"))


@query
def scan_delimited(s, d):
    _feed(s, d).write.csv(path := ranges.scratch(s, "feed"), header=True, quoteAll=True, escape='"', lineSep="\n")
    return files.read_catalogue_csv(s, path).select("sku", "item_description", "vendor")


def _arrays(lines: DataFrame) -> DataFrame:
    """Lines of each partition as the items of one JSON array."""

    def wrap(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": ["["]})
        first = True
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [("" if first and k == 0 else ",") + x for k, x in enumerate(texts)]})
            first = first and not texts
        yield pa.RecordBatch.from_pydict({"value": ["]"]})

    return lines.mapInArrow(wrap, "value string")


@query
def scan_json(s, d):
    _arrays(_feed(s, d).select(F.to_json(F.struct("*")).alias("value"))).write.text(path := ranges.scratch(s, "feed"))
    return files.read_catalogue_json(s, path).select("sku", "item_description", "vendor")


@query
def scan_xml(s, d):
    _feed(s, d).toDF("sku", "item_description", "vendor").write.format("xml").option("rowTag", "item").save(path := ranges.scratch(s, "feed"))
    return files.read_catalogue_xml(s, path, "item").select("sku", "item_description", "vendor")


# Cells and roles


@query
def clean_cells(s, d):
    c = _catalogue(s, d)
    return c.select("row_number", *(C.clean_cell(x).alias(x) for x in ("mfg_part_num", "part_manuf", "part_desc", "material")))


@query
def strip_distributor_code(s, d):
    return _catalogue(s, d).select("row_number", C.strip_distributor_code("part_manuf").alias("manufacturer"))


@query
def is_placeholder(s, d):
    return _catalogue(s, d).select("row_number", C.is_placeholder("part_manuf").alias("placeholder"))


@query
def row_fingerprint(s, d):
    return _catalogue(s, d).select("row_number", store.fingerprint(["mfg_part_num", "part_manuf", "part_desc", "material"]).alias("fingerprint"))


@query
def detect_roles(s, d):
    """Roles of the names that events and their types give, with endings that columns have."""
    names = view(s, d, "events").select("event_type").distinct().withColumn("ending", F.explode(F.array(*map(F.lit, ["_id", "_uom", "_desc", "_brand", "mfr", "_material", " rating", "_category", "_temp_range", "id", "_title"]))))
    return names.select(F.concat("event_type", "ending").alias("column_name")).select("column_name", C.detect_role("column_name").alias("role"))


@query
def search_rows(s, d):
    return store.search_rows(_catalogue(s, d), "ball_valve".replace("_", " "), ["part_manuf", "part_desc", "material"]).select("row_number")


@query
def route_files(s, d):
    urls = view(s, d, "pages").select(F.col("page_id"), F.concat(F.lit("file-"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, [".csv", ".PDF", ".xls", ".zip", "", ".weird"])), (F.col("page_id") % 6 + 1).cast("int"))).alias("path"))
    return files.route_files(urls).select("page_id", "path", "extension", "kind")


# Vocabularies


@query
def match_vocab_exact(s, d):
    c = _catalogue(s, d).withColumn("name", C.strip_distributor_code("part_manuf"))
    return match.match_vocab_exact(c, "name", vocab.seed_vocab(s), "manufacturer").select("row_number", "canonical", "confidence", "match_type")


@query
def match_manufacturer(s, d):
    c = _catalogue(s, d).withColumn("name", C.strip_distributor_code("part_manuf"))
    return match.match_vocab_contains(c, "name", vocab.seed_vocab(s), "manufacturer").select("row_number", "canonical", "confidence", "match_type")


@query
def match_brand(s, d):
    c = _catalogue(s, d).withColumn("name", C.strip_distributor_code("part_manuf"))
    return match.match_brand(c, "name", vocab.seed_vocab(s)).select("row_number", "canonical", "confidence", "match_type")


@query
def match_distributor(s, d):
    c = _catalogue(s, d).withColumn("name", C.strip_distributor_code("part_manuf"))
    return match.match_distributor(c, "name", vocab.seed_vocab(s)).select("row_number", "canonical", "confidence", "match_type")


@query
def match_category(s, d):
    return match.match_category(_catalogue(s, d), "part_desc", vocab.seed_vocab(s)).select("row_number", "canonical", "confidence", "match_type")


@query
def normalise_uom(s, d):
    return match.normalise_uom(_catalogue(s, d).select("row_number", "uom"), "uom").select("row_number", "canonical", "dimension", "confidence")


@query
def normalise_material(s, d):
    return match.normalise_material(_catalogue(s, d).select("row_number", "material"), "material").select("row_number", "canonical", "confidence")


@query
def infer_mfr_from_part(s, d):
    return match.infer_mfr_from_part(_catalogue(s, d), "mfg_part_num").select("row_number", "inferred", "confidence")


@query
def infer_from_text_vocab(s, d):
    c = _catalogue(s, d).withColumn("text", F.concat_ws(" for ", "part_desc", "part_manuf"))
    return match.infer_from_text_vocab(c, "text").select("row_number", "inferred")


# Extraction


@query
def extract_specs(s, d):
    t = "part_desc"
    return _catalogue(s, d).select("row_number", X.extract_material(t).alias("material"), X.extract_pressure(t).alias("pressure"), X.extract_pressure_uom(t).alias("pressure_uom"), X.extract_size(t).alias("size"), X.extract_size_uom(t).alias("size_uom"), X.extract_connection(t).alias("connection_type"), X.extract_temperature(t).alias("temperature_range"))


@query
def extract_dimensions(s, d):
    c = _catalogue(s, d).withColumn("text", F.concat("part_desc", F.lit(" "), "size", F.lit(" in x 3-1/2 in, .5 lb")))
    return c.select("row_number", X.extract_dimensions("text").alias("x")).select("row_number", "x.*")


@query
def extract_attributes(s, d):
    a = _catalogue(s, d).select("row_number", F.explode(X.extract_attributes("part_desc", "mfg_part_num")).alias("a"))
    return a.select("row_number", "a.label", "a.value", "a.uom")


@query
def extract_facts(s, d):
    return _facts(s, d).select("document_id", "page", "name", "value", "normalized_value", "normalized_unit")


@query
def conflicting_facts(s, d):
    return documents.conflicting_facts(_facts(s, d)).select("document_id", "name", "n_values", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query
def validate_facts(s, d):
    return documents.validate_facts(_facts(s, d))


@query
def validate_facts_by_category(s, d):
    kind = F.when(F.col("part_desc").like("%Valve%"), "valve").when(F.col("part_desc").like("%hose%"), "fitting").when(F.col("part_desc").like("%sanding%"), "abrasive")
    return documents.validate_facts(_facts(s, d), categories=_catalogue(s, d).select(F.concat(F.lit("doc-"), F.col("row_number").cast("string")).alias("document_id"), kind.alias("category")))


@query
def conflict_values(s, d):
    return documents.conflict_values(_facts(s, d))


@query
def link_documents(s, d):
    rows = _catalogue(s, d).select("row_number", F.col("mfg_part_num").alias("part_number"))
    return documents.link_documents(_facts(s, d), rows, ["row_number"])


@query
def proposals(s, d):
    return documents.proposals(_facts(s, d)).select("document_id", "page", "name", "value", "state")


@query
def label_value_lines(s, d):
    return documents.label_value_lines(view(s, d, "doc_pages_v"))


# Enrichment, classes, validation, review


@query
def enrich_fields(s, d):
    e = enrich.exploded_fields(_enriched(s, d), "row_number")
    return e.select("row_number", "column", "canonical_value", "confidence", "status", "role", "transformation")


@query
def enrich_batch(s, d):
    return _enriched(s, d).select("row_number", "overall_confidence", "overall_status")


@query
def verified_rate(s, d):
    return enrich.verified_rate(_enriched(s, d), "source_name")


@query
def classify(s, d):
    return taxonomy.classify(_catalogue(s, d), "part_desc", "part_manuf").select("row_number", "dept", "class_name", "fine", "classpath")


@query
def category_histogram(s, d):
    return metrics.category_histogram(taxonomy.classify(_catalogue(s, d), "part_desc", "part_manuf"))


@query
def validate_batch(s, d):
    return _validated(s, d).select("row_number", F.array_join(F.array_sort(F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["field"]))), ",").alias("issues"), F.round("completeness", 4).alias("completeness"), "can_auto_approve")


@query
def batch_validation_summary(s, d):
    return validate.batch_validation_summary(_validated(s, d), "source_name")


@query
def issue_histogram(s, d):
    return validate.issue_histogram(_validated(s, d))


@query
def duplicate_part_numbers(s, d):
    return validate.duplicate_part_numbers(_catalogue(s, d), "mfg_part_num")


@query
def repeated_part_numbers(s, d):
    return validate.other_rows(_catalogue(s, d), "mfg_part_num", shown=5).withColumn("other_rows", F.array_join(F.transform("other_rows", lambda x: x.cast("string")), ","))


@query
def route_rows(s, d):
    return _routed(s, d).select("row_number", "errors", "warnings", "priority", "state")


@query
def pending_queue(s, d):
    return review.pending_queue(_routed(s, d), 50).select("row_number", "priority")


@query
def review_summary(s, d):
    routed = _routed(s, d).select("row_number", "source_name", "event_id", "state")
    return review.review_summary(review.apply_decisions(routed, _decisions(s, d), ["row_number"])[0], "source_name")


@query
def current_review_state(s, d):
    return review.current_review_state(_verdicts(s, d), _decisions(s, d), ["row_number"])


@query
def refused_decisions(s, d):
    return review.apply_decisions(_verdicts(s, d), _decisions(s, d), ["row_number"])[2].select("event_id", "row_number", "refusal")


@query
def queue_audit_count(s, d):
    audit = review.apply_decisions(_verdicts(s, d), _decisions(s, d), ["row_number"])[1]
    return review.queue_audit_count(audit, "action", actor="human")


@query
def bulk_approve(s, d):
    return review.bulk_approve(_routed(s, d), 0.6).select("row_number", "action")


@query
def artifact_review(s, d):
    e = view(s, d, "decisions_v").select(F.col("row_number").alias("artifact_id"), "decided_at", "event_id", F.when(F.col("action") == "reject", "rejected").otherwise("approved").alias("state"))
    return review.artifact_review(e).select("artifact_id", "event_id", "previous_state", "state")


# Delivery


@query
def delivery_record(s, d):
    r = delivery.delivery_record(_catalogue(s, d))
    return r.select("row_number", "part_number_out", "manufacturer_name", "brand_name", "dept", "fine", "delivery_path", "product_name", F.col("tiers.invoice").alias("invoice"), F.array_join("features", "|").alias("features"), F.size("attributes").alias("n_attributes"), "domain", F.col("assets.image").alias("image"))


@query
def delivery_wide(s, d):
    return delivery.wide_record(delivery.delivery_record(_catalogue(s, d)))


@query
def export_wide(s, d):
    return delivery.export_wide(_enriched(s, d).select("row_number", "material", "uom", F.filter("fields", lambda f: f["role"].isin("material", "uom")).alias("fields")))


@query
def export_commerce(s, d):
    return delivery.export_commerce(_enriched(s, d))


@query
def commerce_synthesise(s, d):
    bare = _catalogue(s, d).drop("material", "size", "uom", "pressure_rating")
    return delivery.export_commerce(enrich.enrich_batch(bare), synthesise=True)


@query
def export_json(s, d):
    return delivery.export_json(_enriched(s, d))


@query
def export_json_document(s, d):
    lines = delivery.json_document(_routed(s, d), "source_name")
    row = F.ltrim("line", F.lit(","))
    got = lambda path: F.when(F.col("part") == 1, F.get_json_object(row, path))
    whole = F.when(F.col("part") != 1, F.col("line"))
    return lines.select("source_name", "part", "row_number", F.startswith("line", F.lit(",")).alias("comma"), got("$.overall_status").alias("status"), got("$.review_state").alias("review_state"), got("$.fields.material.evidence.source_row").alias("source_row"), got("$.fields.material.canonical_value").alias("material"), whole.alias("line"))


@query
def export_jsonld(s, d):
    return delivery.export_jsonld(_enriched(s, d))


# Web evidence


@query
def url_profile(s, d):
    p = view(s, d, "pages_v")
    return p.select("page_id", web.url_host("url").alias("host"), web.is_blocked_url("url").alias("blocked"), web.classify_url("url").alias("source_type"))


@query
def hit_profile(s, d):
    h = view(s, d, "hits_v")
    return h.select("row_number", web.url_host("url").alias("host"), web.is_blocked_url("url").alias("blocked"), web.classify_url("url").alias("source_type"))


@query
def page_title(s, d):
    return view(s, d, "pages_v").select("page_id", web.page_title("html").alias("title"))


@query
def resolve_from_hits(s, d):
    return web.resolve_from_hits(view(s, d, "hits_v"), web.domains(s))


@query
def is_manufacturer_url(s, d):
    h = view(s, d, "hits_v").withColumn("manufacturer", F.when(F.col("row_number") % 2 == 0, "Parker Hannifin").otherwise("Apollo Valves"))
    return web.is_manufacturer_url(h, "url", "manufacturer", web.domains(s)).select("row_number", "on_domain")


@query
def verify_on_pages(s, d):
    p = view(s, d, "pages_v")
    candidates = p.select(F.concat(F.lit("p"), F.expr("page_id div 8").cast("string")).alias("part_number"), F.col("page_id").alias("rank"), "url")
    return web.verify_on_pages(candidates, p)


@query
def verify_by_host(s, d):
    p = view(s, d, "pages_v")
    i, host = F.col("page_id"), web.url_host("url")
    number = F.concat(F.lit("Track("), (i - i % 2).cast("string"), F.lit(")"))
    url = F.when(i % 7 == 0, F.concat(F.lit("https://www.amazon.com/dp/"), i.cast("string"))).when(i % 5 == 0, F.lit("https://nowhere.example/x")).otherwise(F.concat(F.lit("https://www."), host, F.lit("/product/"), i.cast("string")))
    return web.verify_by_host(p.select(number.alias("part_number"), (i % 2).alias("rank"), url.alias("url")), p)


@query
def candidate_sources(s, d):
    c = _catalogue(s, d).where("mfg_part_num is not null").withColumn("domain", F.when(F.col("row_number") % 2 == 0, "parker.com"))
    one = c.select("row_number", F.explode(web.candidate_sources(F.lit("Parker Hannifin"), "mfg_part_num", "domain")).alias("x"))
    return one.select("row_number", "x.url", "x.confidence", "x.content_hash")


# Products


@query
def latest_versions(s, d):
    return products.latest_versions(view(s, d, "versions_v"), 1).select("product_id", "version_id")


@query
def version_diff(s, d):
    return products.version_diff(view(s, d, "versions_v"))


@query
def validate_version(s, d):
    return products.validate_version(view(s, d, "versions_v"), ("size", "material"))


@query
def product_summary(s, d):
    return products.product_summary(view(s, d, "versions_v"))


@query
def run_import(s, d):
    v = view(s, d, "versions_v")
    done = products.product_hash(v).where("product_id like '%7'")
    return products.run_import(v, done)


@query
def job_counts(s, d):
    return products.job_counts(run_import(s, d), "decision")


@query
def model_constraints(s, d):
    return products.model_constraints(view(s, d, "versions_v").withColumn("confidence", F.col("confidence") * 2 - 0.1))


def _nested(s: SparkSession, d: str) -> DataFrame:
    """Versions with their attributes in one array; what a name, a source and a page are follows from the values."""
    v = view(s, d, "versions_v")
    source = F.struct(F.when(F.col("value") == "3", F.lit(" ")).otherwise(F.col("status")).alias("source_name"), F.when(F.col("unit").isNotNull(), F.lit("datasheet")).alias("source_type"), (F.col("value").cast("int") - 1).alias("page"))
    one = F.struct(F.when(F.col("value") == "4", F.lit("size")).otherwise(F.col("name")).alias("name"), (F.col("confidence") * 2 - 0.1).alias("confidence"), F.when(F.col("value") != "2", F.array(source)).otherwise(F.array().cast("array<struct<source_name:string,source_type:string,page:int>>")).alias("evidence"))
    return v.groupBy("product_id", "version_id").agg(F.collect_list(one).alias("attributes"))


@query
def nested_constraints(s, d):
    return products.nested_constraints(_nested(s, d))


@query
def product_constraints(s, d):
    p = s.read.parquet(f"{d}/part.parquet").where("p_partkey % 9 > 0")
    known = p.select(F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("product_id"), F.col("p_brand").alias("sku"), F.when(F.col("p_size") != 7, F.col("p_name")).otherwise("  ").alias("name"), F.col("p_type").alias("category"))
    return products.product_constraints(known, view(s, d, "versions_v").where("version_id <> 'V-1995'").select("product_id", "version_id").distinct())


# Evaluation and figures


@query
def field_metrics(s, d):
    return metrics.field_metrics(_scored(s, d))


@query
def role_metrics(s, d):
    return metrics.role_metrics(_scored(s, d))


@query
def row_metrics(s, d):
    return metrics.row_metrics(_scored(s, d))


@query
def evaluation_summary(s, d):
    return metrics.evaluation_summary(_scored(s, d))


@query
def mismatches(s, d):
    return metrics.mismatches(_scored(s, d))


@query
def eval_join(s, d):
    return metrics.eval_join(_catalogue(s, d), view(s, d, "truth_v"))


@query
def latency_percentiles(s, d):
    return metrics.latency_percentiles(view(s, d, "latency_v"), "batch_id", "latency_ms")


@query
def throughput_failure(s, d):
    return metrics.throughput_failure(view(s, d, "latency_v"), "batch_id")


@query
def cost_summary(s, d):
    e = view(s, d, "latency_v").select(F.lit(1).alias("lookups"), F.col("failed").alias("calls"))
    return metrics.cost_summary(e, "lookups", "calls")


@query
def cache_stats(s, d):
    return metrics.cache_stats(_catalogue(s, d), "part_manuf", "mfg_part_num")


@query
def reference_counts(s, d):
    return vocab.reference_counts(vocab.seed_vocab(s)).join(_catalogue(s, d).agg(F.count("*").alias("catalogue_rows")))


@query
def reference_usage(s, d):
    return vocab.reference_usage(vocab.seed_vocab(s), _catalogue(s, d).select(C.strip_distributor_code("part_manuf").alias("name")))


# Suggestions, paging, visits


@query
def llm_batches(s, d):
    rest = taxonomy.residue(taxonomy.classify(_catalogue(s, d), "part_desc", "part_manuf"))
    return suggestions.llm_batches(rest, 25).select("row_number", "request")


@query
def accept_suggestions(s, d):
    return suggestions.accept_suggestions(view(s, d, "suggestions_v"))


@query
def attach_suggestions(s, d):
    c = taxonomy.classify(_catalogue(s, d), "part_desc", "part_manuf")
    return suggestions.attach_suggestions(c, suggestions.accept_suggestions(view(s, d, "suggestions_v"))).select("row_number", "category", "category_source")


@query
def page_rows(s, d):
    return store.page_rows(_catalogue(s, d), 50, 100).select("row_number", "mfg_part_num")


@query
def first_per_key(s, d):
    c = _catalogue(s, d).select(F.coalesce("part_manuf", F.lit("")).alias("part_manuf"), "row_number", "mfg_part_num")
    return web.first_per_key(c, ["part_manuf"], "row_number").select("part_manuf", "row_number", "mfg_part_num")


@query
def summarise_agent(s, d):
    return view(s, d, "visits_v").select("event_id", C.summarise_agent("user_agent").alias("browser"))


@query
def stream_visits_batch(s, d):
    return streams.visits_by_hour(view(s, d, "visits_v"))




@query
def overlay_review(s, d):
    routed = ranges.stored(_routed(s, d).select("row_number", "state", "overall_confidence"), "routed")
    fresh = routed.where("state = 'auto_approved'").select("row_number", F.lit("approved").alias("state"), "overall_confidence")
    stored = _catalogue(s, d).select("row_number", F.lit("pending_review").alias("state"), F.lit(0.0).alias("overall_confidence"))
    return review.overlay_review(stored, fresh, ["row_number"])


@query
def replay_decisions(s, d):
    stored = view(s, d, "decisions_v").groupBy("row_number").agg(F.min_by(F.struct("action", "reviewer", "decided_at"), F.struct("decided_at", "event_id")).alias("x"))
    stored = stored.select("row_number", F.element_at(F.create_map(*(F.lit(v) for p in review.STATES for v in p)), F.col("x.action")).alias("review_state"), "x.reviewer", "x.decided_at")
    return review.replay_decisions(_routed(s, d), stored, ["row_number"]).select("row_number", "state", "reviewer", "reconstructed")


def _replayed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A rebuilt queue: each row's last decision is stored as its state, some without a time; of some the event is there."""
    d_ = view(s, d, "decisions_v").groupBy("row_number").agg(F.max_by(F.struct("action", "reviewer", "decided_at", "event_id"), F.struct("decided_at", "event_id")).alias("x"))
    state = F.element_at(F.create_map(*(F.lit(v) for p in review.STATES for v in p)), F.col("x.action"))
    at = F.when(F.col("row_number") % 11 > 0, F.col("x.decided_at").cast("timestamp"))
    stored = d_.select("row_number", state.alias("review_state"), "x.reviewer", at.alias("decided_at"))
    known = d_.where("row_number % 13 = 0").select("row_number", F.col("x.event_id").alias("event_id"), "x.action", F.lit("pending_review").alias("previous_state"), state.alias("new_state"), "x.reviewer", F.col("x.decided_at").cast("timestamp").alias("decided_at"))
    return review.replay_events(_routed(s, d), stored, ["row_number"], known)


@query
def replay_audit(s, d):
    return _replayed(s, d)[1].where("reviewer is not null").select("row_number", "action", "previous_state", "new_state", "reviewer", F.date_format("decided_at", "yyyy-MM-dd").alias("decided_on"), "comment", "place")


@query
def replay_state(s, d):
    return _replayed(s, d)[0].select("row_number", "state", "reviewer", "n_events")


@query
def audit_page(s, d):
    audit = review.apply_decisions(_verdicts(s, d), _decisions(s, d), ["row_number"])[1]
    return review.audit_page(audit, 50, "human").select("event_id", "action", "reviewer")


@query
def export_audit(s, d):
    routed = ranges.stored(_routed(s, d).select("row_number", "fields", "event_id", "state"), "routed")
    audit = review.apply_decisions(routed.drop("fields"), _decisions(s, d), ["row_number"])[1]
    return delivery.export_audit(routed, audit, ["row_number"]).select("row_number", F.size("transformations").alias("n_fields"), F.col("n_events").cast("int").alias("n_events"))


@query
def repeat_intake(s, d):
    p = view(s, d, "doc_pages_v").where("page = 1").select("document_id", F.sha2("text", 256).alias("content_hash"))
    known = p.where("document_id like '%7'").select("content_hash", F.when(F.col("document_id").like("%17"), "pending").otherwise("approved").alias("state"), F.lit(0).alias("n_facts"), F.lit(1).alias("created_at"))
    return review.repeat_intake(p, known)


@query
def latest_artifact(s, d):
    a = view(s, d, "decisions_v").select(F.concat(F.lit("doc-"), F.col("row_number").cast("string")).alias("document_id"), F.col("event_id").alias("artifact_id"), F.col("decided_at").alias("created_at"), "action")
    return documents.latest_artifact(a, "document_id").select("document_id", "artifact_id", "action")


@query
def documents_for_part(s, d):
    facts = ranges.stored(_facts(s, d).select("document_id", "page", "name", "value"), "facts")
    rows = _catalogue(s, d).select("row_number", F.col("mfg_part_num").alias("part_number"))
    artifacts = view(s, d, "doc_pages_v").where("page = 1").select("document_id", F.length("text").alias("created_at"))
    found = documents.documents_for_part(documents.link_documents(facts, rows, ["row_number"]), facts, artifacts, "apo-105")
    return found.select("document_id", F.size("proposals").alias("n_proposals"))


@query
def dedupe_import(s, d):
    h = products.product_hash(view(s, d, "versions_v"))
    return products.dedupe_import(h, h.where("product_id like '%7'")).select("product_id", "decision")


@query
def version_attr_union(s, d):
    return products.version_attr_union(view(s, d, "versions_v"))


@query
def domain_lookup(s, d):
    names = _catalogue(s, d).select("row_number", C.strip_distributor_code("part_manuf").alias("manufacturer"))
    return web.domain_lookup(names, "manufacturer", web.domains(s)).select("row_number", "domain")


@query
def resolve_domain(s, d):
    c = _catalogue(s, d).withColumn("manufacturer", F.when(F.col("row_number") % 3 == 0, "Freud").when(F.col("row_number") % 3 == 1, "Apollo Valves").otherwise("Appliance Dealers Cooperative"))
    text = F.concat("part_desc", F.when(F.col("row_number") % 2 == 0, " Diablo Whirlpool").otherwise(""))
    return c.withColumn("text", text).select("row_number", web.resolve_domain("manufacturer", "text", [F.col("brand")]).alias("domain"))


@query
def candidate_urls(s, d):
    c = _catalogue(s, d).where("mfg_part_num is not null")
    urls = web.prioritise_candidates(web.candidate_urls(F.array(F.lit("parker.com"), F.lit("apollovalves.com")), "mfg_part_num"))
    return c.select("row_number", F.posexplode(urls).alias("rank", "url"))


@query
def search_queries(s, d):
    c = _catalogue(s, d).where("mfg_part_num is not null and part_manuf is not null")
    return c.select("row_number", F.explode(web.search_queries("part_manuf", "mfg_part_num", F.lit("parker.com"))).alias("query"))


@query
def part_variants(s, d):
    return _catalogue(s, d).select("row_number", F.explode(C.part_variants(F.concat("mfg_part_num", F.lit(" x")))).alias("variant"))


@query
def match_snippet(s, d):
    """Text around the first word of each page's title."""
    p = view(s, d, "pages_v").withColumn("word", F.lower(F.element_at(F.split(web.page_title("html"), " +"), 1)))
    return p.select("page_id", web.match_snippet("html", F.array("word"), 40).alias("snippet"))


@query
def best_datasheet(s, d):
    """Pages with a datasheet link put before them, since the crawl has none."""
    p = view(s, d, "pages_v").withColumn("html", F.concat(F.lit('<a class="x" href="/files/'), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "-spec.pdf").otherwise("-photo.pdf"), F.lit('">file</a>'), F.col("html")))
    return p.select("page_id", web.best_datasheet("html", "url").alias("datasheet"))


@query
def source_summary(s, d):
    return web.source_summary(verify_on_pages(s, d).withColumn("source_type", web.classify_url("url")), "part_number")


@query
def source_summary_by_host(s, d):
    return web.source_summary(verify_by_host(s, d).withColumn("source_type", web.classify_url("url")), "part_number")


@query
def llm_usage(s, d):
    calls = llm_batches(s, d).groupBy("request").agg(F.count("*").alias("rows"), F.count_if(F.col("row_number") % 2 == 0).alias("resolved")).select("rows", "resolved", (F.col("rows") * 120).alias("prompt_tokens"), (F.col("rows") * 20).alias("completion_tokens"))
    return metrics.llm_usage(calls, 0.15, 0.6)


@query
def merge_products(s, d):
    v = view(s, d, "versions_v").select("product_id", "version_id", "name", "value")
    changed = v.where("version_id >= 'V-1995'").withColumn("value", F.lit("new"))
    return store.merge_products(v, changed, ["product_id", "version_id"])


@query
def latest_batch(s, d):
    b = view(s, d, "orders").select(F.col("o_custkey").alias("organization_id"), F.col("o_orderkey").alias("batch_id"), F.col("o_orderdate").alias("created_at"))
    return store.latest_batch(b, "organization_id")


@query
def description_tiers(s, d):
    c = _catalogue(s, d).where("mfg_part_num is not null")
    return c.select("row_number", delivery.description_tiers(F.col("brand"), F.col("mfg_part_num"), F.col("part_desc")).alias("t")).select("row_number", "t.*")


@query
def product_noun(s, d):
    return taxonomy.classify(_catalogue(s, d), "part_desc", "part_manuf").select("row_number", taxonomy.product_noun("fine").alias("noun"), taxonomy.delivery_classpath("classpath").alias("path"))
