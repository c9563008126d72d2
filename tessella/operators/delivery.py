"""Delivery formats: the wide record, the commerce file, JSON, JSON-LD and the audit export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cells as C, extract as X
from ..functions.cells import col
from ..functions.ranges import spread, stored
from ..resources import values as V
from . import taxonomy, web
from .validate import of_role

_BRAND_SLOTS = ["e1_brand", "unilog_brand", "dib_brand"]
_FIRST = {"part_number": ["mfg_part_num", "part_number"], "description": ["part_desc", "description"], "manufacturer": ["part_manuf", "manufacturer"]}


def _filled(name: str) -> Column:
    return F.nullif(F.col(name).cast("string"), F.lit(""))


def resolve_by_role(columns: list[str], role: str) -> Column:
    """A row's value for a role: the well-known columns first, then the first filled column of that role; for part
    numbers a column that names one before a bare identifier."""
    import re

    known = [c for c in _FIRST.get(role, []) if c in columns]
    others = [c for c in columns if c not in known and C.role_of(c) == role]
    if role == "part_number":
        others.sort(key=lambda c: bool(re.match(V.IDENTIFIER_PATTERN, c.lower())))
    return F.coalesce(*(_filled(c) for c in known + others), F.lit(None).cast("string"))


def resolve_brand_slots(columns: list[str]) -> list[Column]:
    """The three brand slots; empty ones take the other brand columns in their order."""
    spare = F.array_compact(F.array(*(_filled(c) for c in columns if c not in _BRAND_SLOTS and C.role_of(c) == "brand"), F.lit(None).cast("string")))
    out, empty = [], F.lit(0)
    for slot in _BRAND_SLOTS:
        own = _filled(slot) if slot in columns else F.lit(None).cast("string")
        out.append(F.coalesce(own, F.get(spare, empty)))
        empty = empty + own.isNull().cast("int")
    return out


def brand_choice(mfr: Column, first: Column, second: Column) -> Column:
    """The second slot unless it says that there is none, else the first, else the manufacturer."""
    return F.when((F.coalesce(second, F.lit("")) != "") & ~F.contains(second, F.lit("-- No Unilog Brand --")), second).when((F.coalesce(first, F.lit("")) != "") & ~F.contains(first, F.lit("-- Unbranded --")), first).otherwise(mfr)


def description_tiers(brand: Column, part: Column, text: Column) -> Column:
    """mobile, invoice, short, long and retail texts; the part number is put before a description that lacks it."""
    leads = F.startswith(F.lower(text), F.lower(part))
    sp, dash = F.lit(" "), F.lit(" - ")
    mobile = F.when(leads, F.concat(brand, sp, text)).otherwise(F.concat(brand, sp, part, sp, text))
    long = F.when(leads, F.concat(brand, dash, text)).otherwise(F.concat(brand, sp, part, dash, text))
    return F.struct(F.substring(mobile, 1, 120).alias("mobile"), F.substring(F.upper(text), 1, 60).alias("invoice"), F.substring(text, 1, 100).alias("short"), long.alias("long"), text.alias("retail"))


def asset_names(brand: Column, part: Column) -> Column:
    stem = F.concat(F.regexp_replace(F.upper(brand), "[^A-Z0-9]+", ""), F.lit("_"), F.regexp_replace(F.upper(part), "[^A-Z0-9_-]+", "_"))
    return F.struct(F.concat(stem, F.lit(".jpg")).alias("image"), F.concat(stem, F.lit("_Specification_Sheet.pdf")).alias("sheet"))


def delivery_record(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df with part_number_out, manufacturer_name, brand_name, classification, descriptions, bullets, triplets, size,
    addresses and asset names, kept as structs and arrays; wide_record() makes the 252 columns of it at the sink.

    Standards and warranty are the format's fixed texts, which every row gets, those without a class too: they tell
    nothing of the product."""
    columns = df.columns if columns is None else columns
    slots = resolve_brand_slots(columns)
    out = spread(df).select("*", *(s.alias(f"_slot{k}") for k, s in enumerate(slots)))
    out = out.withColumn("part_number_out", F.trim(F.coalesce(resolve_by_role(columns, "part_number"), F.lit(""))))
    out = out.withColumn("_mfr", resolve_by_role(columns, "manufacturer")).withColumn("_text", resolve_by_role(columns, "description"))
    out = out.withColumn("manufacturer_name", F.coalesce(C.strip_distributor_code(F.col("_mfr")), F.lit("")))
    out = out.withColumn("description_out", F.coalesce(F.trim("_text"), F.concat("manufacturer_name", F.lit(" "), "part_number_out")))
    out = out.withColumn("brand_name", brand_choice(F.col("manufacturer_name"), F.col("_slot0"), F.col("_slot1")))
    out = out.withColumn("_class", taxonomy.classification("description_out", "manufacturer_name")).withColumn("unresolved", taxonomy.is_unresolved("_class.classpath"))
    out = out.withColumn("tiers", description_tiers(F.col("brand_name"), F.col("part_number_out"), F.col("description_out")))
    out = out.withColumn("stated", X.extract_attributes("description_out", "part_number_out")).withColumn("features", F.slice(X.feature_bullets("stated"), 1, 20))
    out = out.withColumn("attributes", F.slice(taxonomy.attribute_template("stated", "_class.classpath"), 1, 50)).withColumn("dimensions", X.extract_dimensions("description_out"))
    out = out.withColumn("domain", web.resolve_domain("manufacturer_name", "description_out", [F.col(f"_slot{k}") for k in range(3)]))
    out = out.withColumn("sources", web.candidate_sources("manufacturer_name", "part_number_out", "domain")).withColumn("assets", asset_names(F.col("brand_name"), F.col("part_number_out")))
    standards = F.when(F.contains("_class.dept", F.lit("Appliances")), V.APPLIANCE_STANDARDS).otherwise(V.STANDARDS)
    out = out.withColumn("standards", standards).withColumn("warranty", F.lit(V.WARRANTY))
    none = lambda c: F.when(F.col("unresolved"), "").otherwise(c)
    out = out.select("*", none(F.col("_class.dept")).alias("dept"), none(F.col("_class.class_name")).alias("class_name"), none(F.col("_class.fine")).alias("fine"), none(taxonomy.delivery_classpath("_class.classpath")).alias("delivery_path"), none(taxonomy.product_noun("_class.fine")).alias("product_name"))
    return out


def wide_record(record: DataFrame) -> DataFrame:
    """The 252 columns of a delivery record, all strings, empty where there is no value. For the sink only."""
    item = lambda c, k, f=None: F.get(F.col(c), k)[f] if f else F.get(F.col(c), k)
    made: dict[str, Column] = {
        "MFR URL": item("sources", 0, "url"), "Ref URL 1": item("sources", 1, "url"), "PART_NUMBER": F.col("part_number_out"), "Dept": F.col("dept"), "Class": F.col("class_name"), "Fine": F.col("fine"),
        "SKU - MY_PART_NUMBER": F.col("part_number_out"), "Mfg_Part_Num": F.col("part_number_out"), "Part_Desc": F.col("_text"),
        "E1_Brand": F.coalesce("_slot0", F.lit("-- Unbranded --")), "Unilog_Brand": F.coalesce("_slot1", F.lit("-- No Unilog Brand --")), "DIB_Brand": F.coalesce("_slot2", F.lit("-- No DIB Brand --")),
        "Part_Manuf": F.coalesce("_mfr", "manufacturer_name"), "MANUFACTURER_NAME": F.col("manufacturer_name"), "BRAND_NAME": F.col("brand_name"), "TRADE_NAME": F.concat("brand_name", F.lit("®")),
        "MANUFACTURER_PART_NUMBER": F.col("part_number_out"), "Classpath": F.col("delivery_path"), "MOBILE_DESC": F.col("tiers.mobile"), "INVOICE_DESC": F.col("tiers.invoice"),
        "SHORT_DESC": F.col("tiers.short"), "LONG_DESC1": F.col("tiers.long"), "RETAIL_DESC": F.col("tiers.retail"), "Product Name": F.col("product_name"),
        "LENGTH": F.col("dimensions.length"), "LENGTH_UOM": F.when(F.col("dimensions.length").isNotNull(), "in"), "WIDTH": F.col("dimensions.width"), "WIDTH_UOM": F.when(F.col("dimensions.width").isNotNull(), "in"),
        "WEIGHT": F.col("dimensions.weight"), "WEIGHT_UOM": F.col("dimensions.weight_uom"), "Product Image": F.col("assets.image"), "Specification Sheet": F.col("assets.sheet"), "Actual Image (Yes/No)": F.lit("Yes"),
        "Standard/Approvals": F.col("standards"), "Warranty": F.col("warranty"),
    }
    made |= {f"ITEM_FEATURES_{k}": item("features", k - 1) for k in range(1, 21)}
    made |= {f"ATTRIBUTE_{x} {k}": item("attributes", k - 1, x.lower()) for k in range(1, 51) for x in ("LABEL", "VALUE", "UOM")}
    return record.select(*(F.coalesce(made.get(c, F.lit(None)).cast("string"), F.lit("")).alias(c) for c in V.delivery_columns()))


def export_delivery(df: DataFrame, path: str) -> None:
    """Write the 252 columns of the delivery format as CSV files with a header."""
    wide_record(delivery_record(df)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_wide(enriched: DataFrame, raw: bool = True, confidence: bool = True, status: bool = True) -> DataFrame:
    """row_number and, for each field, its raw and canonical value, confidence (2 places) and status as text."""
    names = [f for f in enriched.columns if f not in ("fields", "overall_confidence", "overall_status", "row_number", "source_name", "source_fingerprint", "organization_id", "batch_id")]
    out = [F.col("row_number")]
    for k, name in enumerate(names):
        f = F.get("fields", k)
        out += [F.coalesce(f["raw_value"], F.lit("")).alias(f"{name}_raw")] if raw else []
        out.append(F.coalesce(f["canonical_value"], F.lit("")).alias(f"{name}_canonical"))
        out += [F.format_string("%.2f", f["confidence"]).alias(f"{name}_confidence")] if confidence else []
        out += [f["status"].alias(f"{name}_status")] if status else []
    return enriched.select(*out)


def export_commerce(enriched: DataFrame, synthesise: bool = False) -> DataFrame:
    """The 12 columns of the commerce format: a role's canonical value, else what the cell holds; a brand that says that
    there is none gives way to the manufacturer. Nothing is made up for empty cells unless `synthesise` asks for it."""
    def value(role: str) -> Column:
        f = of_role("fields", role)
        return F.coalesce(F.nullif(f["canonical_value"], F.lit("")), f["raw_value"], F.lit(""))

    mfr = F.coalesce(C.strip_distributor_code(value("manufacturer")), F.lit(""))
    brand = value("brand")
    no_brand = (brand == "") | F.startswith(brand, F.lit("--")) | F.contains(brand, F.lit("Unbranded"))
    category = F.coalesce(of_role("fields", "category")["canonical_value"], F.lit(""))
    own = {"manufacturer": mfr, "brand": F.when(no_brand, mfr).otherwise(brand), "category": category, "pressure_rating": value("pressure")}
    cell = of_role("fields", "manufacturer")["raw_value"].alias("_cell")
    out = enriched.select("row_number", *(own.get(c, value(c)).alias(c) for c in V.COMMERCE_COLUMNS[1:]), *([cell] if synthesise else []))
    return commerce_synthesise(out, F.coalesce(F.nullif("_cell", F.lit("")), "manufacturer")).drop("_cell") if synthesise else out


def _ruled(rules: list[tuple[str, list[str], str]], places: dict[str, Column]) -> Column:
    """The value of the first rule (place, parts, value) of which a part is in the text of its place."""
    out = None
    for where, parts, value in rules:
        hit = F.contains(places[where], F.lit(parts[0]))
        for p in parts[1:]:
            hit = hit | F.contains(places[where], F.lit(p))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def commerce_synthesise(commerce: DataFrame, mfr: Column | str | None = None) -> DataFrame:
    """The commerce columns with the format's stock values in the empty cells of sparse rows.

    A row is sparse that has a part number and a description, but neither material nor size. What it gets is read from the
    description where that states it, and is else a stock value of its kind of product, which nothing proves: callers ask for this,
    and evidence exports never have it. All of it is one projection over rule tables. mfr: the supplier's cell, by which classes
    are told where the description has none; by default the manufacturer.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    sparse = ~empty("description") & ~empty("part_number") & empty("material") & empty("size")
    out = commerce.withColumn("_class", taxonomy.classification("description", "manufacturer" if mfr is None else mfr)).withColumn("_sparse", sparse)
    kind = F.when(taxonomy.is_unresolved("_class.classpath"), F.lit("")).otherwise(F.col("_class.class_name"))
    fill = lambda df, c, value: df.withColumn(c, F.when(F.col("_sparse") & empty(c), value).otherwise(F.col(c)))
    out = fill(out, "brand", F.col("manufacturer"))
    out = fill(out, "category", F.coalesce(F.nullif(kind, F.lit("")), F.lit(V.SYNTHESISED_CATEGORY)))
    stated = F.get(F.filter(X.extract_attributes("description", "part_number"), lambda a: a["label"] == "Size"), 0)["value"]
    out = fill(out, "size", F.coalesce(stated, F.trim(X.first("description", V.SYNTHESISED_SIZE_PATTERN, 0)), F.lit(V.SYNTHESISED_SIZE)))
    d = F.lower("description")
    places = {"description": d, "category": F.lower("category"), "size": F.lower("size"), "raw size": F.col("size")}
    pressed, volts, amperes = (X.first(d, p, 1) for p in (V.SYNTHESISED_PRESSURE_PATTERN, V.SYNTHESISED_VOLT_PATTERN, V.SYNTHESISED_AMPERE_PATTERN))
    rated = F.concat(pressed, F.lit(" "), F.upper(X.first(d, V.SYNTHESISED_PRESSURE_PATTERN, 2)))
    powered = F.concat(volts, F.lit("V"), F.coalesce(F.concat(F.lit(" / "), amperes, F.lit("A")), F.lit("")))
    out = fill(out, "material", _ruled(V.SYNTHESISED_MATERIAL, places))
    out = fill(out, "uom", _ruled(V.SYNTHESISED_UNIT, places))
    out = fill(out, "pressure_rating", F.coalesce(rated, powered, _ruled(V.SYNTHESISED_PRESSURE, places)))
    out = fill(out, "temperature_range", _ruled(V.SYNTHESISED_TEMPERATURE, places))
    out = fill(out, "connection_type", _ruled(V.SYNTHESISED_CONNECTION, places))
    return out.select(*commerce.columns)


def export_json(enriched: DataFrame, evidence: bool = True) -> DataFrame:
    """row_number and one JSON object per row: status, confidence and a map of its fields."""
    keep = lambda f: F.struct(f["canonical_value"].alias("value"), f["confidence"].alias("confidence"), f["status"].alias("status"), *([f["raw_value"].alias("raw"), f["transformation"].alias("how")] if evidence else []))
    fields = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["column"], keep(f))))
    return enriched.select("row_number", F.to_json(F.struct("row_number", F.col("overall_status").alias("status"), F.col("overall_confidence").alias("confidence"), fields.alias("fields")), {"ignoreNullFields": "false"}).alias("json"))


def json_document(routed: DataFrame, *by: str, evidence: bool = True) -> DataFrame:
    """One JSON document for each batch, in lines: by, part (0 the head, 1 a row, 2 the foot), row_number, line.

    Head: source file, row count, share of verified fields. Rows: status, confidence, fields with their evidence, and review
    state. Foot: validation counts. Lines of a batch in order of (part, row_number) are the document; head, foot and the one
    row that takes no comma come from one aggregate, so no task holds all rows. by is one column, the batch's source. What is
    used of routed is stored, since head and foot read it before the rows do.
    """
    source = by[0]
    routed = stored(routed.select(*by, "row_number", "overall_status", "overall_confidence", "fields", "state", "can_auto_approve", "issues"), "routed")
    fields = lambda f: F.struct(
        f["raw_value"].alias("raw_value"), f["canonical_value"].alias("canonical_value"), f["confidence"].alias("confidence"), f["status"].alias("status"), f["role"].alias("role"),
        *([F.struct(F.col(source).alias("source_file"), F.col("row_number").alias("source_row"), f["column"].alias("source_column"), f["raw_value"].alias("raw_value")).alias("evidence")] if evidence else []),
    )
    named = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["column"], fields(f))))
    plain = {"ignoreNullFields": "false"}
    row = F.to_json(F.struct("row_number", "overall_status", F.round("overall_confidence", 4).alias("overall_confidence"), named.alias("fields"), F.col("state").alias("review_state")), plain)
    n_fields, verified = F.sum(F.size("fields")), F.sum(F.size(F.filter("fields", lambda f: f["status"] == "verified")))
    batch = routed.groupBy(*by).agg(
        F.count("*").alias("row_count"), F.min("row_number").alias("_first"), F.coalesce(F.round(verified / F.nullif(n_fields, F.lit(0)), 4), F.lit(0.0)).alias("verified_rate"),
        F.count_if("can_auto_approve").alias("auto_approve_count"), F.count_if(~F.col("can_auto_approve")).alias("review_required_count"), F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("total_issues"),
    )
    none = F.lit(None).cast(routed.schema["row_number"].dataType).alias("row_number")
    head = F.concat(F.lit('{"batch":'), F.to_json(F.struct(F.col(source).alias("source_file"), "row_count", "verified_rate"), plain), F.lit(',"rows":['))
    foot = F.concat(F.lit('],"validation":'), F.to_json(F.struct("auto_approve_count", "review_required_count", "total_issues")), F.lit("}"))
    ends = batch.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("part"), head.alias("line")), F.struct(F.lit(2).alias("part"), foot.alias("line")))).alias("x")).select(*by, "x.part", none, "x.line")
    rows = routed.select(*by, "row_number", row.alias("line")).join(batch.select(*by, "_first"), list(by))
    rows = rows.select(*by, F.lit(1).alias("part"), "row_number", F.when(F.col("row_number") == F.col("_first"), F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("line"))
    return rows.unionByName(ends)


def write_json_document(lines: DataFrame, path: str, *by: str) -> None:
    """The lines of json_document as text files; read in the order of their names they are the documents, one after another."""
    lines.repartitionByRange(*by, "part", "row_number").sortWithinPartitions(*by, "part", "row_number").select("line").write.mode("overwrite").text(path)


def export_jsonld(enriched: DataFrame) -> DataFrame:
    """row_number and a schema.org Product; what isn't known is left out."""
    value = lambda role: F.nullif(F.coalesce(of_role("fields", role)["canonical_value"], F.lit("")), F.lit(""))
    thing = lambda kind, v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("@type"), v.alias("name")))
    pairs = [("Material", "material"), ("Size", "size"), ("Pressure Rating", "pressure"), ("Temperature Range", "temperature_range"), ("Connection Type", "connection_type")]
    props = F.array_compact(F.array(*(F.when(value(r).isNotNull(), F.struct(F.lit("PropertyValue").alias("@type"), F.lit(n).alias("name"), value(r).alias("value"), (value("uom") if r == "size" else F.lit(None).cast("string")).alias("unitText"))) for n, r in pairs)))
    product = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"), value("description").alias("name"), value("part_number").alias("sku"), value("part_number").alias("mpn"), value("category").alias("category"), thing("Brand", value("brand")).alias("brand"), thing("Organization", value("manufacturer")).alias("manufacturer"), F.when(F.size(props) > 0, props).alias("additionalProperty"))
    return enriched.select("row_number", F.to_json(product).alias("json"))


def export_audit(enriched: DataFrame, audit: DataFrame, keys: list[str]) -> DataFrame:
    """keys, what became of each supplier value, the number of the row's events and all of them in order of time, ties by id.

    A list is as long as its row's events; one trail stands in one record, as in the export that it is.
    """
    listed = F.sort_array(F.collect_list(F.struct("decided_at", "event_id", "action", "new_state", "reviewer")))
    event = lambda e, k: F.struct((k + 1).cast("long").alias("place"), *(e[c].alias(c) for c in ("decided_at", "action", "new_state", "reviewer")))
    trail = audit.groupBy(*keys).agg(listed.alias("events")).select(*keys, F.size("events").cast("long").alias("n_events"), F.transform("events", event).alias("events"))
    changes = F.transform("fields", lambda f: F.struct(f["column"].alias("column"), f["raw_value"].alias("supplier_value"), f["canonical_value"].alias("canonical_value"), (~f["raw_value"].eqNullSafe(f["canonical_value"])).alias("was_transformed"), f["transformation"].alias("how")))
    return enriched.select(*keys, changes.alias("transformations")).join(trail, keys, "left")
