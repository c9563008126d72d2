"""DuckDB SQL for the catalogue queries, written from the rules and the fixed values, not from the plans."""

from __future__ import annotations

import re

from ..resources import values as V
from .views import duck


def _q(x: object) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x)


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)}) AS t({names})"


def _form(x: str) -> str:
    return f"trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', ' ', 'g'))"


def _clean(x: str) -> str:
    y = f"trim(regexp_replace(replace({x}, chr(160), ' '), '\\s+', ' ', 'g'))"
    return f"CASE WHEN lower({y}) NOT IN ('', '-', '--', 'n/a', 'na', 'none', 'null', 'unknown') THEN {y} END"


def _code(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(trim({x}), '\\s*\\([A-Z0-9_-]+\\)\\s*$', '')), ''), {x})"


def _placeholder(x: str) -> str:
    return f"coalesce(lower(trim({x})) IN ({', '.join(map(_q, V.PLACEHOLDERS))}) OR regexp_matches(trim({x}), '^--.*--$'), false)"


def _entries(kind: str) -> str:
    table = {"manufacturer": V.MANUFACTURERS, "brand": [b[:2] for b in V.BRANDS], "category": V.CATEGORIES, "distributor": V.DISTRIBUTORS}[kind]
    return _values([(k, n, f) for k, (n, forms) in enumerate(table) for f in (n, *forms)], "ord, canonical, form")


def _matched(kind: str, source: str, column: str, near: bool = True, name: str = "") -> dict[str, str]:
    """CTEs that end in {name}_m (name: the kind, if not given): row_number, canonical, confidence, match_type."""
    name = name or kind
    known = f"SELECT {_form('form')} AS f, max_by(canonical, ord) AS canonical FROM ({_entries(kind)}) GROUP BY 1 HAVING {_form('form')} <> ''"
    names = f"SELECT DISTINCT ord, canonical, {_form('canonical')} AS c FROM ({_entries(kind)})"
    cells = f"SELECT row_number, {_form(column)} AS f FROM {{{source}}}"
    close = f"SELECT x.f, min_by(e.canonical, e.ord) AS canonical FROM (SELECT DISTINCT f FROM {{{name}_x}} WHERE f <> '') x JOIN {{{name}_n}} e ON contains(x.f, e.c) OR contains(e.c, x.f) GROUP BY 1"
    second = "n.canonical" if near else "NULL"
    body = f"""SELECT x.row_number, coalesce(k.canonical, {second}, '') AS canonical,
 CAST(CASE WHEN k.f IS NOT NULL AND {_form('k.canonical')} = x.f THEN 1.0 WHEN k.f IS NOT NULL THEN 0.95 WHEN {second} IS NOT NULL THEN 0.8 ELSE 0.0 END AS DOUBLE) AS confidence,
 CASE WHEN k.f IS NOT NULL AND {_form('k.canonical')} = x.f THEN 'exact' WHEN k.f IS NOT NULL THEN 'alias' WHEN {second} IS NOT NULL THEN 'normalized' ELSE 'none' END AS match_type
 FROM {{{name}_x}} x LEFT JOIN {{{name}_k}} k ON k.f = x.f LEFT JOIN {{{name}_c}} n ON n.f = x.f"""
    return {f"{name}_k": known, f"{name}_n": names, f"{name}_x": cells, f"{name}_c": close, f"{name}_m": body}


_NAMED = f"SELECT *, {_code('part_manuf')} AS name FROM {{catalogue_v}}"
_UNITS = [(f.lower().strip(), u, d) for u, d, forms in V.UNITS for f in forms]


def _match_sql(kind: str, source: str, column: str, near: bool = True) -> str:
    return duck(f"SELECT * FROM {{{kind}_m}}", named=_NAMED, **_matched(kind, source, column, near))


def _cases(x: str, rules: list[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test.format(x=x)} THEN {_q(v)}" for test, v in rules) + f" ELSE {default} END"


def _words(text: str, words: list[str]) -> str:
    import re

    one = (f"(?:^|[^{V.KEYWORD_BORDERS.get(w, 'A-Za-z0-9')}])" + re.escape(w).replace("\\ ", " ") for w in words)
    return f"regexp_matches({text}, {_q('(?:' + '|'.join(one) + ')(?:s|es|ing|ed)?(?:[^A-Za-z0-9]|$)')})"


def _look(where: str, text: str) -> str:
    return "d" if where == "description" else text


def _taxonomy() -> str:
    rows = []
    for text in ("d", "m"):
        for words, path, leaves, default, dept, cls, own in V.TAXONOMY:
            leaf = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({_look(where, text)}, {_q(p)})' for p in parts)} THEN {_q(name)}" for where, parts, name in leaves) + f" ELSE {_q(default)} END" if leaves else _q(default)
            rows.append((_words(text, words), _q(dept), _q(cls), _q(own) if own else leaf, f"{_q(path + ' > ')} || {leaf}"))
    g = V.GENERIC_CLASS
    pick = lambda k, default: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[k]}" for r in rows) + f" ELSE {_q(default)} END"
    return f"SELECT row_number, {pick(1, g[0])} AS dept, {pick(2, g[1])} AS class_name, {pick(3, g[2])} AS fine, {pick(4, V.GENERIC_PATH)} AS classpath FROM (SELECT row_number, lower(coalesce(part_desc, '')) AS d, lower(coalesce(part_manuf, '')) AS m FROM {{catalogue_v}})"


_FACTS = """
SELECT document_id, page, 'pressure_rating' AS name, trim(regexp_extract(text, '(?:pressure\\s*(?:rating|class)?|class)\\s*[:=]\\s*([0-9]+(?:\\s*[-/]\\s*[0-9]+)?\\s*(?:psi|bar|wog|class)?\\b)', 1, 'i')) AS value FROM {doc_pages_v}
UNION ALL SELECT document_id, page, 'size', trim(regexp_extract(text, '(?:size|diameter|dia\\.?|dn)\\s*[:=]\\s*(?:dn\\s*)?([0-9]+(?:\\s*[x/]\\s*[0-9]+)?\\s*(?:mm|in|inch|inches)?\\b)', 1, 'i')) FROM {doc_pages_v}
UNION ALL SELECT document_id, page, 'material', trim(regexp_extract(text, '(?:body\\s*material|material|construction)\\s*[:=]\\s*([A-Za-z][A-Za-z0-9 ./-]{2,58})[ \\t]*(?:\\n|$)', 1, 'i')) FROM {doc_pages_v}
UNION ALL SELECT document_id, page, 'voltage', trim(regexp_extract(text, '(?:voltage(?:\\s*rating)?|volts?)\\s*[:=]\\s*([0-9]+(?:\\.[0-9]+)?\\s*(?:v|volt|volts)\\b)', 1, 'i')) FROM {doc_pages_v}
UNION ALL SELECT document_id, page, 'part_number', trim(regexp_extract(text, '(?:part|catalog(?:ue)?|model|item)\\s*(?:number|no\\.?|#)\\s*[:=]\\s*([A-Za-z0-9][A-Za-z0-9._/-]{2,40})', 1, 'i')) FROM {doc_pages_v}"""
_FOUND = "SELECT * FROM {facts_all} WHERE value <> ''"
_TWO = "SELECT *, dense_rank() OVER (PARTITION BY product_id ORDER BY last_time DESC, version_id DESC) AS age FROM (SELECT *, max(created_at) OVER (PARTITION BY product_id, version_id) AS last_time FROM {versions_v})"
_LATENCY = "SELECT batch_id, latency_ms, row_number() OVER (PARTITION BY batch_id ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY batch_id) AS n FROM {latency_v}"


def _percentile(p: int) -> str:
    return f"max(CASE WHEN i = least(CAST(floor(n * {p} / 100.0) AS BIGINT), n - 1) THEN latency_ms END) AS p{p}"


_AGENT = "CASE WHEN trim(coalesce(user_agent, '')) = '' THEN 'unknown browser' WHEN regexp_matches(user_agent, '{bot}', 'i') THEN trim(split_part(split_part(trim(user_agent), '/', 1), '(', 1)) || ' (bot)' ELSE {browser} || {platform} END".format(
    bot=V.BOT_PATTERN,
    browser="CASE " + " ".join(f"WHEN contains(user_agent, {_q(t)}) THEN {_q(n)}" for t, n in V.BROWSERS) + " ELSE 'unknown browser' END",
    platform="CASE " + " ".join(f"WHEN contains(user_agent, {_q(t)}) THEN {_q(' on ' + n)}" for t, n in V.PLATFORMS) + " ELSE '' END",
)
_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')"
_PATH = "lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)', 1))"
_BLOCKED = f"({_HOST} IN ({', '.join(map(_q, V.BLOCKED_HOSTS))}) OR regexp_matches(url, {_q(V.SHOPPING_PATTERN)}, 'i'))"
_KIND = f"CASE WHEN {_PATH} LIKE '%.pdf' THEN CASE WHEN regexp_matches({_PATH}, 'datasheet|data-sheet|spec') THEN 'specification_sheet' WHEN regexp_matches({_PATH}, 'manual|guide|instruction') THEN 'technical_manual' ELSE 'pdf_datasheet' END WHEN regexp_matches({_PATH}, '\\.mp4|\\.webm|\\.avi|video') OR contains(lower(url), 'youtube') THEN 'video' WHEN regexp_matches({_PATH}, 'catalogue|catalog|brochure') THEN 'catalogue_page' ELSE 'product_page' END"
_DOMAINS = _values([(m, d) for m, ds in V.MANUFACTURER_DOMAINS.items() for d in ds], "manufacturer, domain")
_ROLE_TESTS = []
for _role, _whole, _parts, _ends in V.ROLE_RULES:
    _tests = [f"regexp_matches(k, {_q(V.IDENTIFIER_PATTERN)})"] if _role == "identifier" else [f"k IN ({', '.join(map(_q, _whole))})"] * bool(_whole) + [f"contains(k, {_q(p)})" for p in _parts] + [f"suffix(k, {_q(e)})" for e in _ends]
    _ROLE_TESTS.append(f"WHEN {' OR '.join(_tests)} THEN {_q('part_number' if _role == 'identifier' else _role)}")

_UNIT_PARTS = {"units": _values(_UNITS, "f, unit, dimension"), "uom_m": "SELECT c.row_number, coalesce(a.unit, b.unit, trim(c.uom), '') AS canonical, coalesce(a.dimension, b.dimension, 'none') AS dimension, CAST(CASE WHEN a.f IS NOT NULL THEN 1.0 WHEN b.f IS NOT NULL THEN 0.9 ELSE 0.0 END AS DOUBLE) AS confidence FROM {catalogue_v} c LEFT JOIN {units} a ON a.f = lower(trim(c.uom)) LEFT JOIN {units} b ON b.f = regexp_replace(regexp_replace(lower(trim(c.uom)), '\\.+$', ''), 's+$', '')"}
_MATERIAL_PARTS = {"known": _values([(k, f, n) for k, (f, n) in enumerate(V.MATERIALS.items())], "ord, f, name"), "cells": "SELECT row_number, material, lower(trim(material)) AS k, trim(regexp_replace(regexp_replace(lower(trim(material)), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS s FROM {catalogue_v}", "near": "SELECT c.s, min_by(m.name, m.ord) AS name FROM (SELECT DISTINCT s FROM {cells} WHERE s <> '') c JOIN {known} m ON contains(c.s, m.f) OR contains(m.f, c.s) GROUP BY 1", "material_m": "SELECT c.row_number, coalesce(a.name, b.name, n.name, trim(c.material), '') AS canonical, CAST(CASE WHEN a.name IS NOT NULL THEN 1.0 WHEN b.name IS NOT NULL THEN 0.9 WHEN n.name IS NOT NULL THEN 0.8 ELSE 0.0 END AS DOUBLE) AS confidence FROM {cells} c LEFT JOIN {known} a ON a.f = c.k LEFT JOIN {known} b ON b.f = c.s LEFT JOIN {near} n ON n.s = c.s"}

ORACLES: dict[str, str] = {
    "clean_cells": duck(f"SELECT row_number, {', '.join(f'{_clean(c)} AS {c}' for c in ('mfg_part_num', 'part_manuf', 'part_desc', 'material'))} FROM {{catalogue_v}}"),
    "strip_distributor_code": duck(f"SELECT row_number, {_code('part_manuf')} AS manufacturer FROM {{catalogue_v}}"),
    "is_placeholder": duck(f"SELECT row_number, {_placeholder('part_manuf')} AS placeholder FROM {{catalogue_v}}"),
    "row_fingerprint": duck("SELECT row_number, sha256(to_json({{'material': material, 'mfg_part_num': mfg_part_num, 'part_desc': part_desc, 'part_manuf': part_manuf}})::VARCHAR) AS fingerprint FROM {catalogue_v}").replace("{{", "{").replace("}}", "}"),
    "detect_roles": duck(f"SELECT column_name, CASE {' '.join(_ROLE_TESTS)} ELSE 'other' END AS role FROM (SELECT column_name, lower(trim(column_name)) AS k FROM (SELECT event_type || ending AS column_name FROM (SELECT DISTINCT event_type FROM events), (VALUES ('_id'), ('_uom'), ('_desc'), ('_brand'), ('mfr'), ('_material'), (' rating'), ('_category'), ('_temp_range'), ('id'), ('_title')) AS e(ending)))"),
    "search_rows": duck("SELECT row_number FROM {catalogue_v} WHERE contains(lower(coalesce(part_manuf, '')), 'ball valve') OR contains(lower(part_desc), 'ball valve') OR contains(lower(coalesce(material, '')), 'ball valve')"),
    "route_files": "SELECT page_id, path, lower(regexp_extract(path, '[^/.](\\.[^./]+)$', 1)) AS extension, CASE WHEN page_id % 6 = 0 THEN 'catalogue' WHEN page_id % 6 = 1 THEN 'document' ELSE 'unsupported' END AS kind FROM (SELECT page_id, 'file-' || CAST(page_id AS VARCHAR) || CASE page_id % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.PDF' WHEN 2 THEN '.xls' WHEN 3 THEN '.zip' WHEN 4 THEN '' ELSE '.weird' END AS path FROM pages)",
    "match_vocab_exact": _match_sql("manufacturer", "named", "name", near=False),
    "match_manufacturer": _match_sql("manufacturer", "named", "name"),
    "match_distributor": _match_sql("distributor", "named", "name"),
    "match_category": _match_sql("category", "catalogue_v", "part_desc"),
    "match_brand": duck("SELECT b.row_number, CASE WHEN b.confidence < 0.95 AND m.confidence >= 0.95 THEN m.canonical ELSE b.canonical END AS canonical, CASE WHEN b.confidence < 0.95 AND m.confidence >= 0.95 THEN m.confidence ELSE b.confidence END AS confidence, CASE WHEN b.confidence < 0.95 AND m.confidence >= 0.95 THEN m.match_type ELSE b.match_type END AS match_type FROM {brand_m} b JOIN {manufacturer_m} m ON b.row_number = m.row_number", named=_NAMED, **_matched("brand", "named", "name"), **_matched("manufacturer", "named", "name")),
    "normalise_uom": duck("SELECT * FROM {uom_m}", **_UNIT_PARTS),
    "normalise_material": duck("SELECT * FROM {material_m}", **_MATERIAL_PARTS),
    "infer_mfr_from_part": duck("SELECT c.row_number, p.name AS inferred, CAST(CASE WHEN p.name IS NOT NULL THEN 0.85 ELSE 0.0 END AS DOUBLE) AS confidence FROM {catalogue_v} c LEFT JOIN {prefixes} p ON p.prefix = upper(substr(trim(c.mfg_part_num), 1, 3))", prefixes=_values(list(V.PART_PREFIXES.items()), "prefix, name")),
    "extract_facts": duck("SELECT document_id, page, name, value, CASE name WHEN 'pressure_rating' THEN regexp_extract(lower(value), '^([0-9]+)', 1) WHEN 'size' THEN regexp_extract(lower(value), '^([0-9]+)', 1) WHEN 'material' THEN lower(value) END AS normalized_value, CASE name WHEN 'pressure_rating' THEN nullif(regexp_extract(lower(value), '(psi|bar|wog|class)$', 1), '') WHEN 'size' THEN nullif(regexp_extract(lower(value), '(mm|in)$', 1), '') END AS normalized_unit FROM {facts}", facts_all=_FACTS, facts=_FOUND),
    "proposals": duck("SELECT document_id, page, name, value, 'proposed' AS state FROM {facts} WHERE name <> 'part_number'", facts_all=_FACTS, facts=_FOUND),
    "conflicting_facts": duck("SELECT document_id, name, count(DISTINCT lower(value)) AS n_values, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM {facts} GROUP BY 1, 2 HAVING count(DISTINCT lower(value)) > 1", facts_all=_FACTS, facts=_FOUND),
    "conflict_values": duck("SELECT document_id, name, lower(value) AS value, min(page) AS first_page, count(*) AS n_pages FROM {facts} WHERE (document_id, name) IN (SELECT (document_id, name) FROM {facts} GROUP BY document_id, name HAVING count(DISTINCT lower(value)) > 1) GROUP BY 1, 2, 3", facts_all=_FACTS, facts=_FOUND),
    "validate_facts": duck("SELECT document_id, 'SOURCE_CONFLICT' AS code, name AS attribute FROM {facts} GROUP BY document_id, name HAVING count(DISTINCT lower(value)) > 1 UNION ALL SELECT d.document_id, 'MISSING_REQUIRED', r.a FROM (SELECT DISTINCT document_id FROM {facts}) d CROSS JOIN (VALUES ('material'), ('pressure_rating'), ('size')) AS r(a) WHERE NOT EXISTS (SELECT 1 FROM {facts} f WHERE f.document_id = d.document_id AND f.name = r.a)", facts_all=_FACTS, facts=_FOUND),
    "link_documents": duck("SELECT s.document_id, c.row_number, trim(c.mfg_part_num) AS part_number, CASE WHEN lower(trim(c.mfg_part_num)) = lower(s.stated) THEN 'exact' ELSE 'normalized' END AS match_type FROM (SELECT document_id, lower(regexp_replace(value, '[^A-Za-z0-9]', '', 'g')) AS k, min_by(value, page) AS stated FROM {facts} WHERE name = 'part_number' GROUP BY 1, 2) s JOIN {catalogue_v} c ON lower(regexp_replace(c.mfg_part_num, '[^A-Za-z0-9]', '', 'g')) = s.k", facts_all=_FACTS, facts=_FOUND),
    "classify": duck(_taxonomy()),
    "category_histogram": duck("SELECT p AS classpath, count(*) AS rows, trim(split_part(p, '>', -1)) AS leaf FROM (SELECT nullif(classpath, " + _q(V.GENERIC_PATH) + ") AS p FROM {classes}) GROUP BY 1", classes=_taxonomy()),
    "duplicate_part_numbers": duck("SELECT c.row_number, d.k AS part_key, d.n AS rows FROM {catalogue_v} c JOIN (SELECT lower(trim(mfg_part_num)) AS k, count(*) AS n FROM {catalogue_v} WHERE trim(mfg_part_num) <> '' GROUP BY 1 HAVING count(*) > 1) d ON d.k = lower(trim(c.mfg_part_num))"),
    "artifact_review": duck("SELECT artifact_id, event_id, previous_state, state FROM (SELECT row_number AS artifact_id, event_id, CASE action WHEN 'reject' THEN 'rejected' ELSE 'approved' END AS state, coalesce(lag(CASE action WHEN 'reject' THEN 'rejected' ELSE 'approved' END) OVER (PARTITION BY row_number ORDER BY decided_at, event_id), 'pending') AS previous_state FROM {decisions_v}) WHERE previous_state <> state"),
    "url_profile": duck(f"SELECT page_id, {_HOST} AS host, {_BLOCKED} AS blocked, {_KIND} AS source_type FROM {{pages_v}}"),
    "hit_profile": duck(f"SELECT row_number, {_HOST} AS host, {_BLOCKED} AS blocked, {_KIND} AS source_type FROM {{hits_v}}"),
    "page_title": duck("SELECT page_id, substr(trim(regexp_replace(nullif(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), ''), '<[^>]+>', ' ', 'g')), 1, 200) AS title FROM {pages_v}"),
    "resolve_from_hits": duck(f"SELECT part_number, min_by(manufacturer, (rank, url, manufacturer)) AS manufacturer, min_by(url, (rank, url, manufacturer)) AS url FROM (SELECT h.part_number, h.rank, h.url, d.manufacturer FROM {{hits_v}} h JOIN (SELECT domain, min(manufacturer) AS manufacturer FROM {{domains}} GROUP BY 1) d ON {_HOST.replace('url', 'h.url')} = d.domain OR suffix({_HOST.replace('url', 'h.url')}, '.' || d.domain) WHERE NOT {_BLOCKED.replace('(url', '(h.url')}) GROUP BY 1", domains=_DOMAINS),
    "is_manufacturer_url": duck(f"SELECT h.row_number, EXISTS (SELECT 1 FROM {{domains}} d WHERE d.manufacturer = CASE WHEN h.row_number % 2 = 0 THEN 'Parker Hannifin' ELSE 'Apollo Valves' END AND ({_HOST.replace('url', 'h.url')} = d.domain OR suffix({_HOST.replace('url', 'h.url')}, '.' || d.domain))) AS on_domain FROM {{hits_v}} h", domains=_DOMAINS),
    "candidate_sources": duck("SELECT row_number, 'https://www.parker.com/search?q=' || mfg_part_num AS url, CAST(0.85 AS DOUBLE) AS confidence, substr(sha256('Product page for Parker Hannifin ' || mfg_part_num), 1, 16) AS content_hash FROM {catalogue_v} WHERE mfg_part_num IS NOT NULL AND row_number % 2 = 0 UNION ALL SELECT row_number, 'https://www.parker.com/documents/' || lower(mfg_part_num) || '-datasheet.pdf', CAST(0.80 AS DOUBLE), substr(sha256('https://www.parker.com/documents/' || lower(mfg_part_num) || '-datasheet.pdf'), 1, 16) FROM {catalogue_v} WHERE mfg_part_num IS NOT NULL AND row_number % 2 = 0"),
    "latest_versions": duck("SELECT product_id, version_id FROM {aged} WHERE age = 1", aged=_TWO),
    "version_diff": duck("SELECT product_id, name, CASE WHEN max(age) = 1 THEN 'added' WHEN min(age) = 2 THEN 'removed' ELSE 'changed' END AS change, max(CASE WHEN age = 2 THEN value END) AS previous_value, max(CASE WHEN age = 1 THEN value END) AS current_value, max(CASE WHEN age = 2 THEN unit END) AS previous_unit, max(CASE WHEN age = 1 THEN unit END) AS current_unit FROM (SELECT *, max(age) OVER (PARTITION BY product_id) AS versions FROM {aged} WHERE age <= 2) WHERE versions = 2 GROUP BY product_id, name HAVING count(*) = 1 OR max(CASE WHEN age = 2 THEN value END) IS DISTINCT FROM max(CASE WHEN age = 1 THEN value END) OR max(CASE WHEN age = 2 THEN unit END) IS DISTINCT FROM max(CASE WHEN age = 1 THEN unit END)", aged=_TWO),
    "validate_version": duck("SELECT product_id, version_id, 'INFERRED_VALUE' AS code, 'warning' AS severity, name AS attribute FROM {versions_v} WHERE status = 'inferred' UNION ALL SELECT product_id, version_id, 'LOW_CONFIDENCE', 'warning', name FROM {versions_v} WHERE confidence < 0.7 UNION ALL SELECT v.product_id, v.version_id, 'MISSING_REQUIRED', 'error', r.a FROM (SELECT DISTINCT product_id, version_id FROM {versions_v}) v CROSS JOIN (VALUES ('size'), ('material')) AS r(a) WHERE NOT EXISTS (SELECT 1 FROM {versions_v} x WHERE x.product_id = v.product_id AND x.version_id = v.version_id AND x.name = r.a)"),
    "product_summary": duck("SELECT product_id, count(DISTINCT version_id) AS versions, max(CASE WHEN age = 1 THEN version_id END) AS latest_version, count(CASE WHEN age = 1 THEN 1 END) AS attributes FROM {aged} GROUP BY 1", aged=_TWO),
    "eval_join": duck("SELECT count(*) AS predicted_rows, count(t.row_number) AS matched_rows, count(*) - count(t.row_number) AS unmatched_rows FROM {catalogue_v} c LEFT JOIN {truth_v} t ON t.row_number = c.row_number"),
    "latency_percentiles": duck(f"SELECT batch_id, {_percentile(50)}, {_percentile(95)}, {_percentile(99)} FROM {{ranked}} GROUP BY 1", ranked=_LATENCY),
    "throughput_failure": duck("SELECT batch_id, count(*) AS rows, sum(failed) AS failures, round(sum(failed) / count(*), 4) AS failure_rate, round(1 - sum(failed) / count(*), 4) AS success_rate, round(count(*) * 1000 / sum(latency_ms), 2) AS rows_per_second FROM {latency_v} GROUP BY 1"),
    "cost_summary": duck("SELECT n AS rows, round(c, 4) AS total_cost, round(round(c, 4) / n, 6) AS average_cost, round(round(c, 4) / n * 150000, 2) AS cost_150k, round(round(c, 4) / n * 750000, 2) AS cost_750k FROM (SELECT count(*) AS n, count(*) * 0.001::DOUBLE + sum(failed) * 0.005::DOUBLE AS c FROM {latency_v})"),
    "cache_stats": duck("SELECT sum(n) AS lookups, count(*) AS misses, sum(n) - count(*) AS hits, round((sum(n) - count(*)) / sum(n), 4) AS hit_rate FROM (SELECT count(*) AS n FROM {catalogue_v} GROUP BY lower(trim(coalesce(part_manuf, ''))), lower(trim(coalesce(mfg_part_num, ''))))"),
    "reference_counts": duck("SELECT vocab, entries, (SELECT count(*) FROM {catalogue_v}) AS catalogue_rows FROM (VALUES " + ", ".join(f"('{k}', {len(t)})" for k, t in (("manufacturer", V.MANUFACTURERS), ("brand", V.BRANDS), ("category", V.CATEGORIES), ("distributor", V.DISTRIBUTORS))) + ") AS t(vocab, entries)"),
    "llm_batches": duck("SELECT row_number, (row_number() OVER (ORDER BY row_number) - 1) // 25 AS request FROM {classes} WHERE classpath = " + _q(V.GENERIC_PATH), classes=_taxonomy()),
    "accept_suggestions": duck("SELECT row_number, classpath, greatest(0.0, least(1.0, confidence)) AS confidence FROM {suggestions_v} WHERE classpath LIKE 'Tools%' OR classpath LIKE 'Safety%'"),
    "attach_suggestions": duck("SELECT c.row_number, CASE WHEN c.classpath <> " + _q(V.GENERIC_PATH) + " THEN c.classpath ELSE coalesce(s.classpath, c.classpath) END AS category, CASE WHEN c.classpath <> " + _q(V.GENERIC_PATH) + " THEN 'deterministic' WHEN s.classpath IS NOT NULL THEN 'ai_inferred' ELSE 'unresolved' END AS category_source FROM {classes} c LEFT JOIN (SELECT * FROM {suggestions_v} WHERE classpath LIKE 'Tools%' OR classpath LIKE 'Safety%') s ON s.row_number = c.row_number", classes=_taxonomy()),
    "page_rows": duck("SELECT row_number, mfg_part_num FROM {catalogue_v} ORDER BY row_number LIMIT 50 OFFSET 100"),
    "first_per_key": duck("SELECT coalesce(c.part_manuf, '') AS part_manuf, c.row_number, f.mfg_part_num FROM {catalogue_v} c JOIN (SELECT k, x.mfg_part_num FROM (SELECT coalesce(part_manuf, '') AS k, min(row_number) AS r FROM {catalogue_v} GROUP BY 1) m JOIN {catalogue_v} x ON x.row_number = m.r) f ON f.k = coalesce(c.part_manuf, '')"),
    "summarise_agent": duck(f"SELECT event_id, {_AGENT} AS browser FROM {{visits_v}}"),
    "stream_visits_batch": duck(f"SELECT hour, browser, suffix(browser, '(bot)') AS is_bot, count(*) AS visits FROM (SELECT date_trunc('hour', occurred_at) AS hour, {_AGENT} AS browser FROM {{visits_v}}) GROUP BY 1, 2"),
}

ORACLES |= {
    "latest_artifact": duck("SELECT 'doc-' || CAST(row_number AS VARCHAR) AS document_id, arg_max(event_id, (decided_at, event_id)) AS artifact_id, arg_max(action, (decided_at, event_id)) AS action FROM {decisions_v} GROUP BY 1"),
    "version_attr_union": duck("SELECT DISTINCT product_id, name FROM {aged} WHERE age <= 2", aged=_TWO),
    "domain_lookup": duck(f"SELECT c.row_number, d.domain FROM (SELECT row_number, {_code('part_manuf')} AS m FROM {{catalogue_v}}) c LEFT JOIN {{domains}} d ON d.manufacturer = c.m", domains=_DOMAINS),
    "search_queries": duck("SELECT row_number, CASE k WHEN 0 THEN trim(part_manuf) || ' ' || mfg_part_num || ' product page' WHEN 1 THEN trim(part_manuf) || ' ' || mfg_part_num || ' datasheet' WHEN 2 THEN trim(part_manuf) || ' ' || mfg_part_num || ' specification' ELSE 'site:parker.com ' || mfg_part_num END AS query FROM {catalogue_v}, (VALUES (0), (1), (2), (3)) AS q(k) WHERE mfg_part_num IS NOT NULL AND part_manuf IS NOT NULL"),
    "part_variants": duck("SELECT DISTINCT row_number, v AS variant FROM (SELECT row_number, unnest([lower(mfg_part_num) || ' x', lower(mfg_part_num) || 'x', lower(mfg_part_num) || '-x', replace(lower(mfg_part_num), '-', '') || ' x']) AS v FROM {catalogue_v} WHERE mfg_part_num IS NOT NULL)"),
    "best_datasheet": duck("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^([a-zA-Z]+://[^/]+)', 1) || '/files/' || CAST(page_id AS VARCHAR) || '-spec.pdf' END AS datasheet FROM {pages_v}"),
    "merge_products": duck("SELECT product_id, version_id, name, CASE WHEN version_id >= 'V-1995' THEN 'new' ELSE value END AS value FROM {versions_v}"),
    "latest_batch": "SELECT o_custkey AS organization_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS batch_id FROM orders GROUP BY 1",
    "description_tiers": duck("SELECT row_number, substr(brand || ' ' || mfg_part_num || ' ' || part_desc, 1, 120) AS mobile, substr(upper(part_desc), 1, 60) AS invoice, substr(part_desc, 1, 100) AS short, brand || ' ' || mfg_part_num || ' - ' || part_desc AS long, part_desc AS retail FROM {catalogue_v} WHERE mfg_part_num IS NOT NULL"),
    "repeat_intake": duck("SELECT p.document_id, p.content_hash, CASE WHEN k.h IS NULL OR k.state = 'pending' THEN 'reprocess' ELSE 'already_extracted' END AS decision FROM (SELECT document_id, sha256(text) AS content_hash FROM {doc_pages_v} WHERE page = 1) p LEFT JOIN (SELECT sha256(text) AS h, max(CASE WHEN document_id LIKE '%17' THEN 'pending' ELSE 'approved' END) AS state FROM {doc_pages_v} WHERE page = 1 AND document_id LIKE '%7' GROUP BY 1) k ON k.h = p.content_hash"),
}

#: A product's attributes as one text; equal products have equal texts.
_CONTENTS = "SELECT product_id, string_agg(concat(version_id, '|', name, '|', coalesce(value, '~'), '|', coalesce(unit, '~'), '|', status), ';' ORDER BY version_id, name) AS h FROM {versions_v} GROUP BY 1"
_IMPORTED = "SELECT product_id, CASE WHEN h IN (SELECT h FROM {contents} WHERE product_id LIKE '%7') OR product_id <> min(product_id) OVER (PARTITION BY h) THEN 'skipped' ELSE 'new' END AS decision FROM {contents}"
_RUN = "SELECT i.product_id, i.decision, CASE WHEN i.decision = 'skipped' THEN 'completed' WHEN coalesce(x.errors, 0) > 0 THEN 'failed' WHEN coalesce(x.issues, 0) > 0 THEN 'needs_review' ELSE 'completed' END AS state FROM {imported} i LEFT JOIN (SELECT product_id, count(CASE WHEN value IS NULL OR trim(value) = '' THEN 1 END) + count(CASE WHEN status = 'conflict' THEN 1 END) AS errors, count(CASE WHEN value IS NULL OR trim(value) = '' THEN 1 END) + count(CASE WHEN status IN ('conflict', 'inferred') THEN 1 END) + count(CASE WHEN confidence < 0.7 THEN 1 END) AS issues FROM {aged} WHERE age = 1 GROUP BY 1) x ON x.product_id = i.product_id"
_LLM_BATCHES = "SELECT row_number, (row_number() OVER (ORDER BY row_number) - 1) // 25 AS request FROM {classes} WHERE classpath = " + _q(V.GENERIC_PATH)

ORACLES |= {
    "model_constraints": duck("SELECT product_id, version_id, name, 'CONFIDENCE_RANGE' AS violation FROM {versions_v} WHERE confidence * 2 - 0.1 < 0 OR confidence * 2 - 0.1 > 1 UNION ALL SELECT product_id, version_id, name, 'REPEATED_NAME' FROM {versions_v} GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    "dedupe_import": duck(_IMPORTED, contents=_CONTENTS),
    "run_import": duck(_RUN, contents=_CONTENTS, imported=_IMPORTED, aged=_TWO),
    "job_counts": duck("SELECT decision, count(*) AS items, count(CASE WHEN state = 'completed' THEN 1 END) AS completed, count(CASE WHEN state = 'failed' THEN 1 END) AS failed, count(CASE WHEN state = 'needs_review' THEN 1 END) AS needs_review, CAST(1.0 AS DOUBLE) AS progress, CASE WHEN count(CASE WHEN state <> 'completed' THEN 1 END) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS final_state FROM {run} GROUP BY 1", contents=_CONTENTS, imported=_IMPORTED, aged=_TWO, run=_RUN),
    "llm_usage": duck("SELECT count(*) AS calls, sum(n) AS rows, sum(r) AS resolved, sum(n) * 120 AS prompt_tokens, sum(n) * 20 AS completion_tokens, round((sum(n) * 120 * 0.15::DOUBLE + sum(n) * 20 * 0.6::DOUBLE) / 1e6, 6) AS cost, round((sum(n) * 120 * 0.15::DOUBLE + sum(n) * 20 * 0.6::DOUBLE) / 1e6 / sum(n), 8) AS cost_per_row FROM (SELECT request, count(*) AS n, count(CASE WHEN row_number % 2 = 0 THEN 1 END) AS r FROM {requests} GROUP BY 1)", classes=_taxonomy(), requests=_LLM_BATCHES),
}


def _stands(text: str, forms: list[str]) -> str:
    """Whether one of the forms stands in a text as a whole word."""
    import re

    one = (re.sub(r"([^A-Za-z0-9 ])", r"\\\1", f) for f in forms)
    return f"regexp_matches({text}, {_q('|'.join(rf'\b{x}\b' for x in one))}, 'i')"


def _first_named(text: str, rows: list[tuple[str, list[str]]]) -> str:
    return "CASE " + " ".join(f"WHEN {_stands(text, forms)} THEN {_q(name)}" for name, forms in rows) + " END"


def _field(position: int, column: str, role: str, found: str = "", joins: str = "", told: str = "NULL", how: str = "NULL") -> str:
    """A field of each row before blanks and placeholders are told. found: canonical c, confidence s, status t, how h."""
    found = found or {"part_number": "r.x AS c, 1.0 AS s, 'verified' AS t, 'passthrough' AS h", "description": "r.x AS c, 1.0 AS s, 'verified' AS t, 'passthrough' AS h"}.get(role, "r.x AS c, 0.9 AS s, 'verified' AS t, 'passthrough' AS h")
    return f"SELECT r.row_number, {position} AS position, '{column}' AS \"column\", '{role}' AS role, r.x AS raw_value, {found}, {told} AS told, {how} AS told_how FROM (SELECT *, CAST({column} AS VARCHAR) AS x FROM {{catalogue_v}}) r {joins}"


def _listed(m: str) -> str:
    return f"CASE WHEN {m}.confidence > 0 THEN {m}.canonical ELSE r.x END AS c, {m}.confidence AS s, CASE WHEN {m}.confidence >= 0.95 THEN 'verified' WHEN {m}.confidence > 0 THEN 'inferred' ELSE 'review_required' END AS t, CASE WHEN {m}.match_type = 'exact' THEN 'exact_match' WHEN {m}.match_type = 'alias' THEN 'alias_match' WHEN {m}.confidence > 0 THEN 'normalized' ELSE 'passthrough' END AS h"


def _sure(m: str, least: float) -> str:
    return f"CASE WHEN {m}.confidence > 0 THEN {m}.canonical ELSE r.x END AS c, {m}.confidence AS s, CASE WHEN {m}.confidence >= {least} THEN 'verified' WHEN {m}.confidence > 0 THEN 'inferred' ELSE 'review_required' END AS t, CASE WHEN {m}.confidence >= {least} THEN 'exact_match' WHEN {m}.confidence > 0 THEN 'normalized' ELSE 'passthrough' END AS h"


_MAKER = _first_named("r.part_desc", [(n, [n, *(a for a in forms if len(a) >= 3)]) for n, forms in V.MANUFACTURERS])
_METAL = _first_named("r.part_desc", [(n, [f]) for f, n in sorted(V.MATERIALS.items(), key=lambda x: -len(x[0]))])
_PREFIX = _cases("upper(substr(trim(r.mfg_part_num), 1, 3))", [("{x} = " + _q(p), n) for p, n in V.PART_PREFIXES.items()])
_SELLER = "m.confidence = 0 AND d.confidence >= 0.95"
_BRANDED = "SELECT b.row_number, CASE WHEN b.confidence < 0.95 AND m.confidence >= 0.95 THEN m.canonical ELSE b.canonical END AS canonical, CASE WHEN b.confidence < 0.95 AND m.confidence >= 0.95 THEN m.confidence ELSE b.confidence END AS confidence, CASE WHEN b.confidence < 0.95 AND m.confidence >= 0.95 THEN m.match_type ELSE b.match_type END AS match_type FROM {own_m} b JOIN {maker_m} m ON m.row_number = b.row_number"
_FOUND_FIELDS = " UNION ALL ".join([
    _field(0, "mfg_part_num", "part_number"),
    _field(1, "part_manuf", "manufacturer", f"CASE WHEN {_SELLER} THEN r.x WHEN m.confidence > 0 THEN m.canonical ELSE r.x END AS c, m.confidence AS s, CASE WHEN m.confidence >= 0.95 THEN 'verified' WHEN m.confidence > 0 THEN 'inferred' ELSE 'review_required' END AS t, CASE WHEN {_SELLER} THEN 'distributor_not_manufacturer' WHEN m.match_type = 'exact' THEN 'exact_match' WHEN m.match_type = 'alias' THEN 'alias_match' WHEN m.confidence > 0 THEN 'normalized' ELSE 'passthrough' END AS h", "JOIN {manufacturer_m} m ON m.row_number = r.row_number JOIN {distributor_m} d ON d.row_number = r.row_number", f"coalesce({_PREFIX}, {_MAKER})", f"CASE WHEN {_PREFIX} IS NOT NULL THEN 'extracted_from_part_number' ELSE 'extracted_from_description' END"),
    _field(2, "part_desc", "description"),
    _field(3, "material", "material", _sure("m", 0.9), "JOIN {material_m} m ON m.row_number = r.row_number", _METAL, "'extracted_from_description'"),
    _field(4, "size", "size"),
    _field(5, "uom", "uom", _sure("m", 0.0001), "JOIN {uom_m} m ON m.row_number = r.row_number"),
    _field(6, "pressure_rating", "pressure"),
    _field(7, "brand", "brand", _listed("m"), "JOIN {branded} m ON m.row_number = r.row_number"),
])
_BLANK, _SAID = "trim(coalesce(raw_value, '')) = ''", _placeholder("raw_value")
_FIELDS = f"""SELECT row_number, position, "column", role, raw_value,
 CASE WHEN {_BLANK} THEN told WHEN {_SAID} THEN NULL ELSE c END AS canonical_value,
 CAST(CASE WHEN {_BLANK} THEN CASE WHEN told IS NULL THEN 0.0 ELSE 0.85 END WHEN {_SAID} THEN 0.0 ELSE s END AS DOUBLE) AS confidence,
 CASE WHEN {_BLANK} THEN CASE WHEN told IS NULL THEN 'missing' ELSE 'inferred' END WHEN {_SAID} THEN 'missing' ELSE t END AS status,
 CASE WHEN {_BLANK} THEN CASE WHEN told IS NULL THEN 'missing' ELSE told_how END WHEN {_SAID} THEN 'placeholder' ELSE h END AS transformation
FROM {{found_fields}}"""
_RANK = "CASE status WHEN 'missing' THEN 1 WHEN 'review_required' THEN 2 WHEN 'inferred' THEN 3 ELSE 4 END"
_ENRICHED = f"SELECT row_number, coalesce(round(sum(confidence ORDER BY position) FILTER (status <> 'missing') / nullif(count(*) FILTER (status <> 'missing'), 0), 4), 0.0) AS overall_confidence, CASE min({_RANK}) WHEN 1 THEN 'missing' WHEN 2 THEN 'review_required' WHEN 3 THEN 'inferred' ELSE 'verified' END AS overall_status FROM {{fields}} GROUP BY row_number"
_WIDE = "SELECT row_number, " + ", ".join(f"max(canonical_value) FILTER (role = '{r}') AS {r}, max(raw_value) FILTER (role = '{r}') AS {r}_raw" for r in ("part_number", "manufacturer", "description", "material", "size", "uom", "pressure", "brand")) + " FROM {fields} GROUP BY row_number"
_LIMITS = "CASE role " + " ".join(f"WHEN {_q(r)} THEN {n}" for r, n in V.CHARACTER_LIMITS.items()) + " END"
_BARE_D, _BARE_P = ("regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]', '', 'g')".format(c) for c in ("description", "part_number"))
_NEED = ", ".join(map(_q, V.DEFAULT_REQUIRED))
_OWN_ISSUES = f"""
SELECT row_number, 'MISSING_REQUIRED_VALUE' AS code, 'error' AS severity, role AS field FROM {{fields}} WHERE role IN ({_NEED}) AND (status = 'missing' OR canonical_value IS NULL)
UNION ALL SELECT row_number, 'MISSING_DESCRIPTION', 'warning', 'description' FROM {{wide}} WHERE trim(coalesce(description, '')) = '' AND trim(coalesce(part_number, '')) <> ''
UNION ALL SELECT row_number, 'UNINFORMATIVE_DESCRIPTION', 'warning', 'description' FROM {{wide}} WHERE trim(coalesce(description, '')) <> '' AND {_BARE_P} <> '' AND length(replace({_BARE_D}, {_BARE_P}, '')) < 3
UNION ALL SELECT row_number, 'LOV_UNMATCHED', 'warning', "column" FROM {{fields}} WHERE role IN ('manufacturer', 'brand', 'category', 'material', 'uom') AND status = 'review_required' AND coalesce(raw_value, '') <> ''
UNION ALL SELECT row_number, 'LOW_CONFIDENCE', 'warning', "column" FROM {{fields}} WHERE coalesce(raw_value, '') <> '' AND confidence > 0 AND confidence < {V.APPROVAL_CONFIDENCE}
UNION ALL SELECT row_number, 'CHAR_LIMIT_EXCEEDED', 'error', "column" FROM {{fields}} WHERE length(canonical_value) > {_LIMITS}
UNION ALL SELECT row_number, 'MATERIAL_PRESSURE_MISMATCH', 'warning', 'material' FROM {{wide}} WHERE material IN ({', '.join(map(_q, V.SOFT_MATERIALS))}) AND TRY_CAST(split_part(trim(pressure), ' ', 1) AS DOUBLE) > 600"""
_ISSUES = "SELECT * FROM {own_issues} UNION ALL SELECT row_number, 'DUPLICATE_PART_NUMBER', 'warning', 'part_number' FROM (SELECT row_number, count(*) OVER (PARTITION BY lower(trim(part_number))) AS n FROM {wide} WHERE trim(part_number) <> '') WHERE n > 1"
_VALIDATED = f"""SELECT e.row_number, e.overall_confidence, e.overall_status, coalesce(i.issues, '') AS issues, coalesce(i.errors, 0) AS errors, coalesce(i.warnings, 0) AS warnings, coalesce(i.n, 0) AS n_issues, f.completeness,
 e.overall_confidence >= {V.APPROVAL_CONFIDENCE} AND NOT f.open AND NOT coalesce(o.bad, false) AS can_auto_approve
FROM {{enriched}} e
JOIN (SELECT row_number, count(*) FILTER (role IN ({_NEED}) AND canonical_value IS NOT NULL) / {len(V.DEFAULT_REQUIRED)}.0::DOUBLE AS completeness, bool_or(status = 'review_required' AND coalesce(raw_value, '') <> '') AS open FROM {{fields}} GROUP BY 1) f ON f.row_number = e.row_number
LEFT JOIN (SELECT row_number, string_agg(code || ':' || field, ',' ORDER BY code || ':' || field) AS issues, count(*) AS n, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM {{issues}} GROUP BY 1) i ON i.row_number = e.row_number
LEFT JOIN (SELECT row_number, bool_or(severity = 'error' OR code IN ({', '.join(map(_q, V.BLOCKING_ISSUES))})) AS bad FROM {{own_issues}} GROUP BY 1) o ON o.row_number = e.row_number"""
_ROUTED = "SELECT *, round(errors * 10.0::DOUBLE + warnings * 3.0::DOUBLE + (1.0::DOUBLE - overall_confidence) * 5.0::DOUBLE + (1.0::DOUBLE - completeness) * 2.0::DOUBLE, 4) AS priority, CASE WHEN can_auto_approve THEN 'auto_approved' ELSE 'pending_review' END AS state FROM {validated}"
_BECOMES = "CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'correct' THEN 'corrected' END"
_JUDGED = f"SELECT *, coalesce(sound, CASE WHEN count(*) FILTER (sound IS NULL) OVER (PARTITION BY row_number ORDER BY decided_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'not_pending' END) AS refusal FROM (SELECT d.*, {_BECOMES} AS new_state, CASE WHEN r.state IS NULL THEN 'unknown_row' WHEN {_BECOMES} IS NULL THEN 'unknown_action' WHEN r.state <> 'pending_review' THEN 'not_pending' WHEN action = 'correct' AND corrected_material IS NULL THEN 'no_corrections' END AS sound FROM {{decisions_v}} d LEFT JOIN {{routed}} r ON r.row_number = d.row_number)"
_STATE = "SELECT r.row_number, coalesce(h.new_state, r.state) AS state, h.reviewer FROM {routed} r LEFT JOIN (SELECT * FROM {judged} WHERE refusal IS NULL) h ON h.row_number = r.row_number"
_TRUE_FOLD, _GUESS_FOLD = _form("expected"), _form("predicted")
_SCORED = f"""SELECT row_number, coalesce(k, "column") AS "column", role, predicted, expected, CASE WHEN k IS NULL THEN 'not_evaluated' WHEN predicted IS NULL AND expected IS NULL THEN 'missing_correct' WHEN predicted IS NULL THEN 'missing_incorrect' WHEN expected IS NULL THEN 'false_positive' WHEN lower(trim(predicted)) = lower(trim(expected)) THEN 'exact' WHEN {_GUESS_FOLD} = {_TRUE_FOLD} AND {_GUESS_FOLD} <> '' THEN 'normalised' ELSE 'false_positive' END AS outcome
FROM (SELECT f.row_number, f."column", f.role, f.canonical_value AS predicted, CASE f.role WHEN 'manufacturer' THEN t.manufacturer WHEN 'material' THEN t.material WHEN 'uom' THEN t.uom END AS expected, CASE WHEN f.role IN ('manufacturer', 'material', 'uom') THEN f.role END AS k FROM {{fields}} f JOIN {{truth_v}} t ON t.row_number = f.row_number)"""
_OUTCOMES = ["exact", "normalised", "missing_correct", "missing_incorrect", "false_positive"]
_ROW_SCORES = "SELECT row_number, count(*) AS fields, count(*) FILTER (outcome IN ('exact', 'missing_correct')) AS exact, count(*) FILTER (outcome = 'normalised') AS normalised, count(*) FILTER (outcome IN ('exact', 'missing_correct', 'normalised')) = count(*) AS complete, round(count(*) FILTER (outcome IN ('exact', 'missing_correct', 'normalised')) / count(*), 4) AS accuracy FROM {scored} WHERE outcome <> 'not_evaluated' GROUP BY 1"
_STEPS = {
    "named": _NAMED, **_matched("manufacturer", "named", "name"), **_matched("distributor", "named", "name"), **_matched("brand", "catalogue_v", "brand", name="own"), **_matched("manufacturer", "catalogue_v", "brand", name="maker"),
    "branded": _BRANDED, **_UNIT_PARTS, **_MATERIAL_PARTS, "found_fields": _FOUND_FIELDS, "fields": _FIELDS, "enriched": _ENRICHED, "wide": _WIDE, "own_issues": _OWN_ISSUES, "issues": _ISSUES, "validated": _VALIDATED, "routed": _ROUTED,
    "judged": _JUDGED, "current": _STATE, "scored": _SCORED, "row_scores": _ROW_SCORES,
}


def _on(body: str) -> str:
    return duck(body, **_STEPS)


def _scores(by: str) -> str:
    n = {o: f"count(*) FILTER (outcome = '{o}')" for o in [*_OUTCOMES, "not_evaluated"]}
    hits, total = f"({n['exact']} + {n['normalised']})", "count(*) FILTER (outcome <> 'not_evaluated')"
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN round({a} / {b}, 4) ELSE 0.0 END"
    return _on(f"SELECT {by}, {total} AS total, {', '.join(f'{x} AS {o}' for o, x in n.items())}, {share(n['exact'], total)} AS exact_accuracy, {share(hits, total)} AS normalised_accuracy, {share(hits, '(' + hits + ' + ' + n['false_positive'] + ')')} AS precision FROM {{scored}} GROUP BY 1")


_ANY = lambda role: f"coalesce(nullif({role}, ''), {role}_raw, '')"
_NO_BRAND = f"({_ANY('brand')} = '' OR starts_with({_ANY('brand')}, '--') OR contains({_ANY('brand')}, 'Unbranded'))"
_MFR = f"coalesce({_code(_ANY('manufacturer'))}, '')"

ORACLES |= {
    "enrich_fields": _on('SELECT row_number, "column", canonical_value, confidence, status, role, transformation FROM {fields}'),
    "enrich_batch": _on("SELECT * FROM {enriched}"),
    "verified_rate": _on("SELECT 'part_feed' AS source_name, sum(n) AS fields, sum(v) AS verified, count(*) FILTER (r) AS rows_to_review, round(sum(v) / sum(n), 4) AS verified_rate FROM (SELECT row_number, count(*) AS n, count(*) FILTER (status = 'verified') AS v, bool_or(status = 'review_required') AS r FROM {fields} GROUP BY 1)"),
    "validate_batch": _on("SELECT row_number, issues, round(completeness, 4) AS completeness, can_auto_approve FROM {validated}"),
    "batch_validation_summary": _on("SELECT 'part_feed' AS source_name, count(*) AS total_rows, count(*) FILTER (can_auto_approve) AS auto_approved, sum(n_issues) AS total_issues, count(*) FILTER (NOT can_auto_approve) AS review_required, round(count(*) FILTER (can_auto_approve) / count(*), 4) AS auto_approve_rate FROM {validated}"),
    "issue_histogram": _on("SELECT code, severity, count(*) AS n FROM {issues} GROUP BY 1, 2"),
    "route_rows": _on("SELECT row_number, errors, warnings, priority, state FROM {routed}"),
    "pending_queue": _on("SELECT row_number, priority FROM {routed} WHERE state = 'pending_review' ORDER BY priority, row_number LIMIT 50"),
    "bulk_approve": _on("SELECT row_number, 'approve' AS action FROM {routed} WHERE state = 'pending_review' AND overall_confidence >= 0.6"),
    "current_review_state": _on("SELECT * FROM {current}"),
    "review_summary": _on("SELECT 'part_feed' AS source_name, count(*) AS rows, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("pending_review", "auto_approved", "approved", "rejected", "corrected")) + ", count(*) FILTER (state IN ('approved', 'auto_approved', 'corrected')) AS approved_overall FROM {current}"),
    "refused_decisions": _on("SELECT event_id, row_number, refusal FROM {judged} WHERE refusal IS NOT NULL"),
    "queue_audit_count": _on("SELECT action, count(*) AS events FROM {judged} WHERE refusal IS NULL GROUP BY 1"),
    "audit_page": _on("SELECT event_id, action, reviewer FROM {judged} WHERE refusal IS NULL ORDER BY decided_at DESC, event_id LIMIT 50"),
    "replay_decisions": _on(f"SELECT r.row_number, coalesce(s.state, r.state) AS state, s.reviewer, s.state IS NOT NULL AS reconstructed FROM {{routed}} r LEFT JOIN (SELECT row_number, arg_min({_BECOMES}, (decided_at, event_id)) AS state, arg_min(reviewer, (decided_at, event_id)) AS reviewer FROM {{decisions_v}} GROUP BY 1) s ON s.row_number = r.row_number"),
    "overlay_review": _on("SELECT row_number, CASE WHEN can_auto_approve THEN 'approved' ELSE 'pending_review' END AS state, CASE WHEN can_auto_approve THEN overall_confidence ELSE 0.0 END AS overall_confidence FROM {routed}"),
    "export_wide": _on("SELECT row_number, " + ", ".join(f"coalesce(max(raw_value) FILTER (role = '{r}'), '') AS {r}_raw, coalesce(max(canonical_value) FILTER (role = '{r}'), '') AS {r}_canonical, printf('%.2f', max(confidence) FILTER (role = '{r}')) AS {r}_confidence, max(status) FILTER (role = '{r}') AS {r}_status" for r in ("material", "uom")) + " FROM {fields} GROUP BY 1"),
    "export_commerce": _on(f"SELECT row_number, {_MFR} AS manufacturer, CASE WHEN {_NO_BRAND} THEN {_MFR} ELSE {_ANY('brand')} END AS brand, {_ANY('part_number')} AS part_number, '' AS category, {_ANY('description')} AS description, {_ANY('material')} AS material, {_ANY('size')} AS size, {_ANY('uom')} AS uom, {_ANY('pressure')} AS pressure_rating, '' AS temperature_range, '' AS connection_type FROM {{wide}}"),
    "export_audit": _on("SELECT r.row_number, 8 AS n_fields, 1 + (h.row_number IS NOT NULL)::INT AS n_events FROM {routed} r LEFT JOIN (SELECT DISTINCT row_number FROM {judged} WHERE refusal IS NULL) h ON h.row_number = r.row_number"),
    "field_metrics": _scores('"column"'),
    "role_metrics": _scores("role"),
    "row_metrics": _on("SELECT * FROM {row_scores}"),
    "mismatches": _on("SELECT row_number, \"column\", expected, predicted, CASE WHEN predicted IS NULL THEN 'missing_incorrect' WHEN expected IS NULL THEN 'false_positive' ELSE 'mismatch' END AS kind FROM {scored} WHERE outcome IN ('missing_incorrect', 'false_positive')"),
    "evaluation_summary": _on("SELECT * FROM (SELECT count(*) AS fields, round(count(*) FILTER (outcome = 'exact') / count(*), 4) AS exact_rate, round(count(*) FILTER (outcome IN ('exact', 'normalised')) / count(*), 4) AS normalised_rate, round(count(*) FILTER (outcome = 'missing_correct') / greatest(count(*) FILTER (outcome IN ('missing_correct', 'missing_incorrect')), 1), 4) AS missing_detection_rate FROM {scored} WHERE outcome <> 'not_evaluated'), (SELECT count(*) AS rows, round(count(*) FILTER (complete) / count(*), 4) AS complete_row_rate, round(avg(accuracy), 4) AS average_row_accuracy FROM {row_scores})"),
    "infer_from_text_vocab": duck(f"SELECT r.row_number, {_MAKER.replace('r.part_desc', 'r.text')} AS inferred FROM (SELECT row_number, concat_ws(' for ', part_desc, part_manuf) AS text FROM {{catalogue_v}}) r"),
}


def _got(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {_q(pattern)}, {group}), '')"


def _unit(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {_q(f)} THEN {_q(u)}" for u, d, forms in V.UNITS if d in ("pressure", "length") for f in forms) + " END"


def _whole_word(text: str, rows: list[tuple[str, str]]) -> str:
    """The name of the first form that stands in the text as a word."""
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_q('(?i)' + chr(92) + 'b' + re.escape(f) + chr(92) + 'b')}) THEN {_q(n)}" for f, n in rows) + " END"


_PRESSED, _MEASURED = r"(?i)\b(\d+)\s*(psi|bar|wog|cwp|swp|kpa|mpa)\b", r"(?i)\b(\d+(?:[-/]\d+)?|\d+\.\d+)\s*(?:in|inch|inches|mm|cm)\b"
_MEASURE = r"(?i)\b\d+(?:[-/]\d+)?\s*(in|inch|inches|mm|cm)\b"
_WEIGHED = r"(?i)\b(\d+(?:\.\d+)?)\s*(lbs?|pounds?|kg|ounces?|oz)\b"
_LENGTH = r"(\d+(?:[-/]\d+|\.\d+)?|\.\d+)"
_SIDED = rf'(?i){_LENGTH}\s*(?:in|inch|")\s*x\s*{_LENGTH}\s*(?:in|inch|")'
_NO_PART = "SELECT row_number, part_desc AS d, CASE WHEN coalesce(mfg_part_num, '') = '' THEN part_desc ELSE regexp_replace(part_desc, '(?i)(^|[^A-Za-z0-9])' || mfg_part_num || '($|[^A-Za-z0-9])', '\\1 \\2', 'g') END AS t FROM {catalogue_v}"
_STATED = [
    ("Grit", "coalesce(" + ", ".join(_got("t", p) for p in (r"(?i)\b(P\d{2,4})\b", r"(?i)\b(\d{2,4})\s*-?\s*Grit\b", r"(?i)\bGrit\s*-?\s*(\d{2,4})\b")) + ")", "NULL"),
    ("Voltage Rating", _got("t", r"(?i)\b(\d+)\s*V\b"), "'V'"), ("Amperage Rating", _got("t", r"(?i)\b(\d{1,4})\s*A\b"), "'A'"),
    ("Horsepower", _got("t", r"(?i)\b(\d+(?:\.\d+)?)\s*HP\b"), "'HP'"), ("Size", f"{_got('d', _SIDED)} || ' in x ' || {_got('d', _SIDED, 2)} || ' in'", "NULL"),
    ("Weight", _got("d", _WEIGHED), f"upper({_got('d', _WEIGHED, 2)})"),
]
_LABEL = r"^([A-Z][A-Za-z0-9/()]*(?:[ -][A-Z][A-Za-z0-9/()]*){0,3}):\s+(.{1,60})$"
_LINES = "SELECT document_id, page, unnest(range(len(l))) AS line, trim(unnest(l)) AS l FROM (SELECT document_id, page, string_split_regex(text, '\\r?\\n') AS l FROM {doc_pages_v})"
_LABELLED = f"""SELECT *, row_number() OVER (PARTITION BY document_id, lower(label) ORDER BY page, line) AS once
FROM (SELECT document_id, page, line, trim({_got('l', _LABEL)}) AS label, trim({_got('l', _LABEL, 2)}) AS value FROM {{lines}} WHERE length(l) BETWEEN 1 AND 120)
WHERE label IS NOT NULL AND value <> '' AND lower(label) NOT IN ('page', 'copyright', 'phone', 'fax', 'email', 'website', 'note', 'notes') AND NOT contains(lower(value), 'http')
AND len(string_split_regex(value, '\\s+')) <= 8 AND NOT regexp_matches(value, '[.,;]$|^[a-z]')"""
_OFFERED = "SELECT 'p' || CAST(page_id // 8 AS VARCHAR) AS part_number, page_id AS rank, url FROM {pages_v}"
_SEARCHED = "(contains(lower(c.url), '/search') OR contains(lower(c.url), 'q=') OR contains(lower(c.url), 'query='))"
_HELD = f"SELECT c.part_number, c.rank, c.url, contains(lower(p.html), c.part_number) AS held, contains(lower(p.html), c.part_number) AND NOT {_SEARCHED} AS found FROM {{offered}} c JOIN {{pages_v}} p ON p.url = c.url WHERE NOT {_BLOCKED.replace('(url', '(c.url')}"
_CHECKED = "SELECT part_number, rank, url, CASE WHEN found THEN 'verified' ELSE 'fetched' END AS status, CASE WHEN found THEN 0.9::DOUBLE WHEN held THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS confidence FROM (SELECT *, min(rank) FILTER (found) OVER (PARTITION BY part_number) AS first_found FROM {held}) WHERE first_found IS NULL OR rank <= first_found"
_SHOWN = r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t,
lower(string_split_regex(substr(trim(regexp_replace(nullif(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), ''), '<[^>]+>', ' ', 'g')), 1, 200), ' +')[1]) AS w FROM {pages_v}"""
_AROUND = "SELECT page_id, t, greatest(strpos(lower(t), w) - 40, 1) AS b, least(strpos(lower(t), w) - 1 + length(w) + 40, length(t)) AS e FROM {shown} WHERE contains(lower(t), w)"
#: Parts of names that begin one another, for the choice between a manufacturer's domains.
_ASKED = f"SELECT row_number, CASE row_number % 3 WHEN 0 THEN 'Freud' WHEN 1 THEN 'Apollo Valves' ELSE 'Appliance Dealers Cooperative' END AS manufacturer, part_desc || CASE WHEN row_number % 2 = 0 THEN ' Diablo Whirlpool' ELSE '' END || CASE WHEN brand IS NULL OR {_placeholder('brand')} THEN '' ELSE ' ' || brand END AS text FROM {{catalogue_v}}"
_OWN = _values([(m, k, d, x) for m, ds in V.MANUFACTURER_DOMAINS.items() for k, d in enumerate(ds) for x in d.lower().split(".") if x not in ("com", "net", "org", "co", "de", "jp", "www")], "manufacturer, k, domain, label")
_ASKED_WORDS = "SELECT DISTINCT row_number, manufacturer, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM {asked}"
_MEETS = "length(w.w) >= 4 AND (starts_with(o.label, w.w) OR starts_with(w.w, o.label))"
_NAMED_DOMAINS = f"SELECT w.row_number, count(DISTINCT o.domain) AS n, min(o.domain) AS domain FROM {{asked_words}} w JOIN {{own}} o ON o.manufacturer = w.manufacturer AND {_MEETS} GROUP BY 1"
_SAME_NAME = f"SELECT manufacturer, count(DISTINCT domain) AS n FROM {{own}} o JOIN (SELECT DISTINCT manufacturer AS m, unnest(string_split_regex(lower(manufacturer), '[^a-z0-9]+')) AS w FROM {{own}}) w ON w.m = o.manufacturer AND {_MEETS} GROUP BY 1"
_LISTED = _values([(m, len(ds), ds[0]) for m, ds in V.MANUFACTURER_DOMAINS.items() if ds], "manufacturer, n, domain")
_NOUN = "trim(string_split(coalesce(fine, ''), '&')[1])"
_LAST = f"string_split_regex({_NOUN}, ' +')[-1]"
_RESOLVED = "SELECT a.row_number, CASE WHEN l.n = 1 THEN l.domain WHEN d.n = 1 THEN d.domain WHEN s.n = l.n THEN l.domain END AS domain FROM {asked} a LEFT JOIN {listed} l ON l.manufacturer = a.manufacturer LEFT JOIN {named_domains} d ON d.row_number = a.row_number LEFT JOIN {same_name} s ON s.manufacturer = a.manufacturer"
_NOUNS = f"SELECT row_number, CASE WHEN regexp_matches({_LAST}, '..ies$') THEN regexp_replace({_NOUN}, 'ies$', 'y') WHEN regexp_matches({_LAST}, '(ses|xes|ches|shes)$') THEN regexp_replace({_NOUN}, 'es$', '') WHEN regexp_matches({_LAST}, '[^s]s$') THEN regexp_replace({_NOUN}, 's$', '') ELSE {_NOUN} END AS noun, regexp_replace(trim(classpath), ' *> *', '>', 'g') AS path FROM {{classes}}"

ORACLES |= {
    "extract_specs": duck(f"SELECT row_number, {_whole_word('part_desc', sorted(V.MATERIALS.items(), key=lambda x: -len(x[0])))} AS material, {_got('part_desc', _PRESSED)} AS pressure, {_unit(f'lower({_got("part_desc", _PRESSED, 2)})')} AS pressure_uom, {_got('part_desc', _MEASURED)} AS size, {_unit(f'lower({_got("part_desc", _MEASURE)})')} AS size_uom, {_whole_word('part_desc', [(x, x) for x in V.CONNECTIONS])} AS connection_type, {_got('part_desc', '(?i)(-?[0-9]+°[FC][ ]*to[ ]*-?[0-9]+°[FC])')} AS temperature_range FROM {{catalogue_v}}"),
    "extract_dimensions": duck(f"SELECT row_number, {_got('x', _WEIGHED)} AS weight, upper({_got('x', _WEIGHED, 2)}) AS weight_uom, {_got('x', _SIDED)} AS width, {_got('x', _SIDED, 2)} AS length FROM (SELECT row_number, part_desc || ' ' || size || ' in x 3-1/2 in, .5 lb' AS x FROM {{catalogue_v}})"),
    "extract_attributes": duck("SELECT * FROM (" + " UNION ALL ".join(f"SELECT row_number, {_q(n)} AS label, {v} AS value, {u} AS uom FROM {{no_part}}" for n, v, u in _STATED) + ") WHERE value IS NOT NULL", no_part=_NO_PART),
    "label_value_lines": duck("SELECT document_id, CAST(position AS INTEGER) AS position, label, value FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, line) AS position FROM {labelled} WHERE once = 1) WHERE position <= 20", lines=_LINES, labelled=_LABELLED),
    "documents_for_part": duck("SELECT a.document_id, p.n AS n_proposals FROM (SELECT document_id, length(text) AS created_at FROM {doc_pages_v} WHERE page = 1 AND document_id IN (SELECT document_id FROM {facts} WHERE name = 'part_number' AND lower(regexp_replace(value, '[^A-Za-z0-9]', '', 'g')) = 'apo105') AND EXISTS (SELECT 1 FROM {catalogue_v} WHERE lower(regexp_replace(mfg_part_num, '[^A-Za-z0-9]', '', 'g')) = 'apo105') ORDER BY created_at DESC, document_id LIMIT 200) a LEFT JOIN (SELECT document_id, CAST(count(*) AS INTEGER) AS n FROM {facts} WHERE name <> 'part_number' GROUP BY 1) p ON p.document_id = a.document_id", facts_all=_FACTS, facts=_FOUND),
    "candidate_urls": duck("SELECT row_number, CAST(rank AS INTEGER) AS rank, head || CASE WHEN head LIKE '%q=' THEN trim(mfg_part_num) ELSE replace(lower(trim(mfg_part_num)), ' ', '-') END AS url FROM {catalogue_v}, {heads} WHERE mfg_part_num IS NOT NULL", heads=_values([(k, f"https://www.{d}/{x}") for k, (x, d) in enumerate([(x, d) for d in ("parker.com", "apollovalves.com") for x in ("product/", "products/", "us/en/product/")] + [("search?q=", d) for d in ("parker.com", "apollovalves.com")])], "rank, head")),
    "match_snippet": duck("SELECT s.page_id, CASE WHEN trim(substr(a.t, a.b, a.e - a.b + 1)) <> '' THEN CASE WHEN b > 1 THEN '…' ELSE '' END || trim(substr(a.t, a.b, a.e - a.b + 1)) || CASE WHEN e < length(a.t) THEN '…' ELSE '' END END AS snippet FROM {shown} s LEFT JOIN {around} a ON a.page_id = s.page_id", shown=_SHOWN, around=_AROUND),
    "verify_on_pages": duck(_CHECKED, offered=_OFFERED, held=_HELD),
    "source_summary": duck("SELECT part_number, count(*) AS sources, count(*) FILTER (status = 'verified') AS verified, bool_or(kind = 'product_page') AS has_product_page, bool_or(kind IN ('pdf_datasheet', 'specification_sheet')) AS has_datasheet, CAST(0 AS BIGINT) AS blocked, CASE WHEN bool_or(status = 'verified') THEN 'verified' ELSE 'fetched' END AS evidence_status, 'live' AS discovery_mode FROM (SELECT *, " + _KIND + " AS kind FROM {checked}) GROUP BY 1", offered=_OFFERED, held=_HELD, checked=_CHECKED),
    "resolve_domain": duck(_RESOLVED, asked=_ASKED, own=_OWN, listed=_LISTED, asked_words=_ASKED_WORDS, named_domains=_NAMED_DOMAINS, same_name=_SAME_NAME),
    "product_noun": duck(_NOUNS, classes=_taxonomy()),
}


def _json(x: str) -> str:
    return f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"


def _member(name: str, x: str, before: str = "", after: str = "") -> str:
    ""","name":value, or nothing where there is no value."""
    return f"""coalesce(',"{name}":{before}' || CAST(to_json({x}) AS VARCHAR) || '{after}', '')"""


def _property(name: str, role: str, more: str = "''") -> str:
    return f"""CASE WHEN {role} IS NOT NULL THEN '{{"@type":"PropertyValue","name":"{name}","value":' || CAST(to_json({role}) AS VARCHAR) || {more} || '}}' END"""


_EMPTIED = "SELECT row_number, " + ", ".join(f"nullif({r}, '') AS {r}" for r in ("description", "part_number", "manufacturer", "brand", "material", "size", "uom", "pressure")) + " FROM {wide}"
_PROPERTIES = f"concat_ws(',', {_property('Material', 'material')}, {_property('Size', 'size', _member('unitText', 'uom'))}, {_property('Pressure Rating', 'pressure')})"
_PRODUCT = " || ".join([
    """'{"@context":"https://schema.org","@type":"Product"'""", _member("name", "description"), _member("sku", "part_number"), _member("mpn", "part_number"),
    _member("brand", "brand", '{"@type":"Brand","name":', "}"), _member("manufacturer", "manufacturer", '{"@type":"Organization","name":', "}"),
    f"""coalesce(',"additionalProperty":[' || nullif({_PROPERTIES}, '') || ']', '')""", "'}'",
])
_FIELD = f"""to_json("column") || ':{{"value":' || {_json('canonical_value')} || ',"confidence":' || CAST(CAST(confidence AS DOUBLE) AS VARCHAR) || ',"status":' || {_json('status')} || ',"raw":' || {_json('raw_value')} || ',"how":' || {_json('transformation')} || '}}'"""

ORACLES |= {
    "export_json": _on(f"""SELECT e.row_number, '{{"row_number":' || e.row_number || ',"status":' || {_json('e.overall_status')} || ',"confidence":' || CAST(CAST(e.overall_confidence AS DOUBLE) AS VARCHAR) || ',"fields":{{' || f.f || '}}}}' AS json FROM {{enriched}} e JOIN (SELECT row_number, string_agg({_FIELD}, ',' ORDER BY position) AS f FROM {{fields}} GROUP BY 1) f ON f.row_number = e.row_number"""),
    "export_jsonld": duck(f"SELECT row_number, {_PRODUCT} AS json FROM {{emptied}}", **_STEPS, emptied=_EMPTIED),
}

_SUPPLIED = f"SELECT c.row_number, trim(coalesce(c.mfg_part_num, '')) AS part, coalesce({_code('c.part_manuf')}, '') AS maker, c.part_desc AS text, c.brand, k.dept, k.class_name, k.fine, k.classpath, k.classpath = {_q(V.GENERIC_PATH)} AS open FROM {{catalogue_v}} c JOIN {{classes}} k ON k.row_number = c.row_number"
_STATED_ROWS = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT row_number, {k} AS k, {_q(n)} AS label, {v} AS value, {u} AS uom FROM {{no_part}}" for k, (n, v, u) in enumerate(_STATED)) + ") WHERE value IS NOT NULL"
_FAMILIES = _values([(f, x) for f, labels in V.ATTRIBUTE_LABELS.items() for x in labels], "family, label")
#: The family of a path is its last part that is one.
_FAMILY = "SELECT row_number, arg_max(s, i) AS family FROM (SELECT row_number, trim(unnest(string_split(classpath, '>'))) AS s, unnest(range(len(string_split(classpath, '>')))) AS i FROM {supplied}) WHERE s IN (SELECT family FROM {families}) GROUP BY 1"
_LAID = "SELECT row_number, label FROM {stated_rows} UNION SELECT f.row_number, l.label FROM {family} f JOIN {families} l ON l.family = f.family"
_PATHED = f"""SELECT s.row_number, s.part AS part_number_out, s.maker AS manufacturer_name, s.brand AS brand_name, CASE WHEN s.open THEN '' ELSE s.dept END AS dept, CASE WHEN s.open THEN '' ELSE s.fine END AS fine,
CASE WHEN s.open THEN '' ELSE regexp_replace(trim(s.classpath), ' *> *', '>', 'g') END AS delivery_path, CASE WHEN s.open THEN '' ELSE w.noun END AS product_name, substr(upper(s.text), 1, 60) AS invoice, coalesce(b.features, '') AS features,
CAST(least(50, coalesce(a.n, 0)) AS INTEGER) AS n_attributes, d.domain, regexp_replace(upper(s.brand), '[^A-Z0-9]+', '', 'g') || '_' || regexp_replace(upper(s.part), '[^A-Z0-9_-]+', '_', 'g') || '.jpg' AS image
FROM {{supplied}} s JOIN {{nouns}} w ON w.row_number = s.row_number LEFT JOIN (SELECT row_number, string_agg(label || ': ' || value || coalesce(' ' || uom, ''), '|' ORDER BY k) AS features FROM {{stated_rows}} GROUP BY 1) b ON b.row_number = s.row_number
LEFT JOIN (SELECT row_number, count(*) AS n FROM {{laid}} GROUP BY 1) a ON a.row_number = s.row_number LEFT JOIN {{resolved}} d ON d.row_number = s.row_number"""

ORACLES |= {
    "delivery_record": duck(_PATHED, classes=_taxonomy(), supplied=_SUPPLIED, no_part=_NO_PART, stated_rows=_STATED_ROWS, families=_FAMILIES, family=_FAMILY, laid=_LAID, nouns=_NOUNS, resolved=_RESOLVED, own=_OWN, listed=_LISTED, asked_words=_ASKED_WORDS, named_domains=_NAMED_DOMAINS, same_name=_SAME_NAME, asked="SELECT row_number, maker AS manufacturer, text || ' ' || brand AS text FROM {supplied}"),
}

#: Attributes in their order: the labels of the family, then what else is stated.
_ORDERED = """SELECT row_number, label, value, uom, row_number() OVER (PARTITION BY row_number ORDER BY place) AS n FROM (
 SELECT f.row_number, l.label, coalesce(t.value, '') AS value, t.uom, l.place FROM {family} f JOIN {labels} l ON l.family = f.family LEFT JOIN {stated_rows} t ON t.row_number = f.row_number AND t.label = l.label
 UNION ALL SELECT t.row_number, t.label, t.value, t.uom, 1000 + t.k FROM {stated_rows} t LEFT JOIN {family} f ON f.row_number = t.row_number WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.family = f.family AND l.label = t.label))"""
_LABELS = _values([(f, x, k) for f, labels in V.ATTRIBUTE_LABELS.items() for k, x in enumerate(labels)], "family, label, place")
_BASE = f"""SELECT p.*, s.text, s.class_name, s.open, s.dept AS whole_dept, c.part_manuf, starts_with(lower(s.text), lower(s.part)) AS leads, a.attributes, string_split(p.features, '|') AS listed,
 {_got('s.text', _WEIGHED)} AS weight, upper({_got('s.text', _WEIGHED, 2)}) AS weight_uom, {_got('s.text', _SIDED)} AS width, {_got('s.text', _SIDED, 2)} AS length, replace(lower(s.part), ' ', '-') AS slug
 FROM {{pathed}} p JOIN {{supplied}} s ON s.row_number = p.row_number JOIN {{catalogue_v}} c ON c.row_number = p.row_number
 LEFT JOIN (SELECT row_number, list({{{{'label': label, 'value': value, 'uom': uom}}}} ORDER BY n) AS attributes FROM {{ordered}} WHERE n <= 50 GROUP BY 1) a ON a.row_number = p.row_number""".replace("{{", "{").replace("}}", "}")
_MADE_COLUMNS = {
    "MFR URL": "'https://www.' || domain || '/search?q=' || url_encode(part_number_out)", "Ref URL 1": "'https://www.' || domain || '/documents/' || slug || '-datasheet.pdf'", "PART_NUMBER": "part_number_out", "Dept": "dept", "Class": "CASE WHEN NOT open THEN class_name END", "Fine": "fine",
    "SKU - MY_PART_NUMBER": "part_number_out", "Mfg_Part_Num": "part_number_out", "Part_Desc": "text", "E1_Brand": "coalesce(brand_name, '-- Unbranded --')", "Unilog_Brand": "'-- No Unilog Brand --'", "DIB_Brand": "'-- No DIB Brand --'",
    "Part_Manuf": "coalesce(part_manuf, manufacturer_name)", "MANUFACTURER_NAME": "manufacturer_name", "BRAND_NAME": "brand_name", "TRADE_NAME": "brand_name || '®'", "MANUFACTURER_PART_NUMBER": "part_number_out", "Classpath": "delivery_path",
    "MOBILE_DESC": "substr(CASE WHEN leads THEN brand_name || ' ' || text ELSE brand_name || ' ' || part_number_out || ' ' || text END, 1, 120)", "INVOICE_DESC": "invoice", "SHORT_DESC": "substr(text, 1, 100)",
    "LONG_DESC1": "CASE WHEN leads THEN brand_name || ' - ' || text ELSE brand_name || ' ' || part_number_out || ' - ' || text END", "RETAIL_DESC": "text", "Product Name": "product_name", "LENGTH": "length", "LENGTH_UOM": "CASE WHEN length IS NOT NULL THEN 'in' END", "WIDTH": "width",
    "WIDTH_UOM": "CASE WHEN width IS NOT NULL THEN 'in' END", "WEIGHT": "weight", "WEIGHT_UOM": "weight_uom", "Product Image": "image", "Specification Sheet": "replace(image, '.jpg', '_Specification_Sheet.pdf')", "Actual Image (Yes/No)": "'Yes'",
    "Standard/Approvals": f"CASE WHEN contains(whole_dept, 'Appliances') THEN {_q(V.APPLIANCE_STANDARDS)} ELSE {_q(V.STANDARDS)} END", "Warranty": _q(V.WARRANTY),
    **{f"ITEM_FEATURES_{k}": f"listed[{k}]" for k in range(1, 21)}, **{f"ATTRIBUTE_{x} {k}": f"attributes[{k}].{x.lower()}" for k in range(1, 51) for x in ("LABEL", "VALUE", "UOM")},
}
ORACLES["delivery_wide"] = duck(
    "SELECT " + ", ".join(f"""coalesce({_MADE_COLUMNS.get(c, 'NULL')}, '') AS "{c}\"""" for c in V.delivery_columns()) + " FROM {base}",
    classes=_taxonomy(), supplied=_SUPPLIED, no_part=_NO_PART, stated_rows=_STATED_ROWS, families=_FAMILIES, family=_FAMILY, laid=_LAID, nouns=_NOUNS, resolved=_RESOLVED, own=_OWN, listed=_LISTED, asked_words=_ASKED_WORDS, named_domains=_NAMED_DOMAINS, same_name=_SAME_NAME,
    asked="SELECT row_number, maker AS manufacturer, text || ' ' || brand AS text FROM {supplied}", pathed=_PATHED, labels=_LABELS, ordered=_ORDERED, base=_BASE,
)

_FEED = f"""SELECT CAST(p_partkey AS VARCHAR) AS sku, {_clean("p_name || chr(10) || '5\" pipe; \"' || p_type || '\",' || chr(10) || chr(10) || p_size")} AS item_description,
 CASE WHEN p_size % 3 > 0 THEN p_brand END AS vendor FROM part"""
ORACLES |= {"scan_delimited": _FEED, "scan_json": _FEED, "scan_xml": _FEED}

_KEYED = "SELECT row_number, lower(trim(mfg_part_num)) AS k FROM {catalogue_v} WHERE trim(mfg_part_num) <> ''"
ORACLES["repeated_part_numbers"] = duck(
    "SELECT a.row_number, a.k AS part_key, a.n AS rows, array_to_string(a.o, ',') AS other_rows, a.nxt AS next_row, 'Part number appears in ' || a.n || ' rows: ' || array_to_string(a.o, ', ') || CASE WHEN a.n > 6 THEN ', and ' || (a.n - 6) || ' more' ELSE '' END AS message"
    " FROM (SELECT row_number, k, n, nxt, list_slice(list_filter(l, lambda x: x <> row_number), 1, 5) AS o FROM (SELECT row_number, k, count(*) OVER (PARTITION BY k) AS n, lead(row_number) OVER (PARTITION BY k ORDER BY row_number) AS nxt, list(row_number) OVER (PARTITION BY k ORDER BY row_number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM {keyed})) a WHERE a.n > 1",
    keyed=_KEYED,
)
_SAYS = V.RESTORED_COMMENT.replace("'", "''")
_STORED = f"SELECT row_number, arg_max(action, (decided_at, event_id)) AS action, arg_max({_BECOMES}, (decided_at, event_id)) AS new_state, arg_max(reviewer, (decided_at, event_id)) AS reviewer, max(decided_at) AS at FROM {{decisions_v}} GROUP BY 1"
_RESTORED = f"""SELECT s.row_number, s.action, CASE WHEN s.row_number % 13 = 0 THEN 'pending_review' ELSE r.state END AS previous_state, s.new_state, s.reviewer,
 CASE WHEN s.row_number % 13 = 0 OR s.row_number % 11 > 0 THEN strftime(s.at, '%Y-%m-%d') END AS decided_on,
 CASE WHEN s.row_number % 13 = 0 THEN NULL WHEN s.row_number % 11 = 0 THEN '{_SAYS.format(when=V.RESTORED_UNTIMED)}' ELSE '{_SAYS.format(when=V.RESTORED_TIMED)}' END AS comment, 2 AS place
 FROM ({_STORED}) s LEFT JOIN {{routed}} r ON r.row_number = s.row_number WHERE r.row_number IS NOT NULL"""
ORACLES["replay_audit"] = _on(f"SELECT * FROM ({_RESTORED}) x")
ORACLES["replay_state"] = _on(f"SELECT r.row_number, coalesce(x.new_state, r.state) AS state, x.reviewer, CAST(CASE WHEN x.row_number IS NULL THEN 1 ELSE 2 END AS BIGINT) AS n_events FROM {{routed}} r LEFT JOIN ({_RESTORED}) x ON x.row_number = r.row_number")

_HOST = "regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\\.', '')"
_NEAR = f"""SELECT page_id % 2 AS rank, 'Track(' || (page_id - page_id % 2) || ')' AS part_number,
 CASE WHEN page_id % 7 = 0 THEN 'https://www.amazon.com/dp/' || page_id WHEN page_id % 5 = 0 THEN 'https://nowhere.example/x' ELSE 'https://www.' || {_HOST} || '/product/' || page_id END AS url FROM {{pages_v}}"""
_MET = f"""SELECT c.k, c.part_number, c.rank, c.url, CASE WHEN c.url LIKE '%amazon%' THEN 'blocked' WHEN count(p.url) FILTER (contains(p.low, lower(c.part_number)) AND NOT p.search) > 0 THEN 'verified' WHEN count(p.url) > 0 THEN 'fetched' ELSE 'unreached' END AS status,
 min(p.url) FILTER (contains(p.low, lower(c.part_number)) AND NOT p.search) AS page, count(DISTINCT p.url) FILTER (contains(p.low, lower(c.part_number)) AND NOT p.search) AS n, count(p.url) FILTER (contains(p.low, lower(c.part_number))) AS any_
 FROM (SELECT *, {_HOST} AS host, row_number() OVER () AS k FROM {{near_}}) c LEFT JOIN (SELECT url, {_HOST} AS host, lower(html) AS low, contains(lower(url), '/search') OR contains(lower(url), 'q=') OR contains(lower(url), 'query=') AS search FROM {{pages_v}}) p ON p.host = c.host GROUP BY c.k, c.part_number, c.rank, c.url"""
ORACLES["verify_by_host"] = duck(
    "SELECT m.part_number, m.rank, m.url, m.status, CAST(CASE WHEN m.status = 'verified' THEN 0.9 WHEN m.status <> 'fetched' THEN 0.0 WHEN m.any_ > 0 THEN 0.2 ELSE 0.1 END AS DOUBLE) AS confidence, CASE WHEN m.status = 'verified' THEN m.page END AS page, CASE WHEN m.status = 'verified' THEN m.n ELSE 0 END AS n_pages"
    " FROM {met} m LEFT JOIN (SELECT part_number, min(rank) AS f FROM {met} WHERE status = 'verified' GROUP BY 1) v ON v.part_number = m.part_number WHERE v.f IS NULL OR m.rank <= v.f",
    near_=_NEAR, met=_MET,
)

_ATTRIBUTES = "SELECT product_id, version_id, CASE WHEN value = '4' THEN 'size' ELSE name END AS name, confidence * 2 - 0.1 AS confidence, value, unit, CASE WHEN value = '3' THEN ' ' ELSE status END AS source_name, CAST(value AS INT) - 1 AS page FROM {versions_v}"
_BROKEN = {"CONFIDENCE_RANGE": "confidence < 0 OR confidence > 1", "NO_EVIDENCE": "value = '2'", "EMPTY_SOURCE_NAME": "value <> '2' AND trim(source_name) = ''", "EMPTY_SOURCE_TYPE": "value <> '2' AND unit IS NULL", "PAGE_RANGE": "value <> '2' AND page < 1"}
ORACLES["nested_constraints"] = duck(
    " UNION ALL ".join(f"SELECT product_id, version_id, name, '{k}' AS violation FROM {{attributes}} WHERE {test}" for k, test in _BROKEN.items())
    + " UNION ALL SELECT product_id, version_id, name, 'REPEATED_NAME' FROM {attributes} GROUP BY 1, 2, 3 HAVING count(*) > 1", attributes=_ATTRIBUTES,
)
_KNOWN = "SELECT 'P-' || p_partkey AS product_id, p_size FROM part WHERE p_partkey % 9 > 0"
_HELD_VERSIONS = "SELECT DISTINCT product_id, version_id FROM {versions_v} WHERE version_id <> 'V-1995'"
ORACLES["product_constraints"] = duck(
    "SELECT product_id, NULL AS version_id, 'EMPTY_FIELD' AS violation FROM {known} WHERE p_size = 7 UNION ALL SELECT product_id, NULL, 'NO_VERSION' FROM {known} WHERE product_id NOT IN (SELECT product_id FROM {held_versions})"
    " UNION ALL SELECT product_id, version_id, 'FOREIGN_VERSION' FROM {held_versions} WHERE product_id NOT IN (SELECT product_id FROM {known})", known=_KNOWN, held_versions=_HELD_VERSIONS,
)
_BATCH = "SELECT r.source_name, count(*) AS n, count(*) FILTER (can_auto_approve) AS ok, sum(n_issues) AS issues, min(r.row_number) AS first FROM (SELECT r.*, c.source_name FROM {routed} r JOIN {catalogue_v} c ON c.row_number = r.row_number) r GROUP BY 1"
_RATE = "SELECT round(count(*) FILTER (status = 'verified') / count(*), 4) AS rate FROM {fields}"
ORACLES["export_json_document"] = _on(
    "SELECT 'part_feed' AS source_name, 1 AS part, r.row_number, r.row_number > b.first AS comma, r.overall_status AS status, r.state AS review_state, CAST(r.row_number AS VARCHAR) AS source_row, f.canonical_value AS material, NULL AS line"
    f' FROM {{routed}} r LEFT JOIN (SELECT row_number, any_value(canonical_value) AS canonical_value FROM {{fields}} WHERE "column" = \'material\' GROUP BY 1) f ON f.row_number = r.row_number, ({_BATCH}) b'
    f""" UNION ALL SELECT source_name, 0, NULL, false, NULL, NULL, NULL, NULL, '{{"batch":{{"source_file":"' || source_name || '","row_count":' || n || ',"verified_rate":' || rate || '}},"rows":[' FROM ({_BATCH}), ({_RATE})"""
    f""" UNION ALL SELECT source_name, 2, NULL, false, NULL, NULL, NULL, NULL, '],"validation":{{"auto_approve_count":' || ok || ',"review_required_count":' || (n - ok) || ',"total_issues":' || issues || '}}}}' FROM ({_BATCH})"""
)

_CATEGORY = "SELECT 'doc-' || row_number AS document_id, CASE WHEN part_desc LIKE '%Valve%' THEN 'valve' WHEN part_desc LIKE '%hose%' THEN 'fitting' WHEN part_desc LIKE '%sanding%' THEN 'abrasive' END AS category FROM {catalogue_v}"
ORACLES["validate_facts_by_category"] = duck(
    "SELECT document_id, 'SOURCE_CONFLICT' AS code, name AS attribute FROM {facts} GROUP BY document_id, name HAVING count(DISTINCT lower(value)) > 1 UNION ALL SELECT d.document_id, 'MISSING_REQUIRED', r.a FROM (SELECT DISTINCT document_id FROM {facts}) d LEFT JOIN {category} c ON c.document_id = d.document_id"
    " JOIN (VALUES ('valve', 'material'), ('valve', 'pressure_rating'), ('valve', 'size'), ('fitting', 'connection_type'), ('fitting', 'material'), ('fitting', 'size'), ('generic', 'material'), ('generic', 'size')) AS r(k, a) ON r.k = CASE WHEN c.category IN ('valve', 'fitting') THEN c.category ELSE 'generic' END"
    " WHERE NOT EXISTS (SELECT 1 FROM {facts} f WHERE f.document_id = d.document_id AND f.name = r.a)", facts_all=_FACTS, facts=_FOUND, category=_CATEGORY,
)
ORACLES["source_summary_by_host"] = duck(
    "SELECT part_number, count(*) FILTER (status <> 'blocked') AS sources, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status <> 'blocked') > 0 AS has_product_page, false AS has_datasheet, count(*) FILTER (status = 'blocked') AS blocked,"
    " CASE WHEN bool_or(status = 'verified') THEN 'verified' WHEN bool_or(status = 'fetched') THEN 'fetched' ELSE 'discovered' END AS evidence_status, CASE WHEN bool_or(status IN ('verified', 'fetched')) THEN 'live' ELSE 'simulated' END AS discovery_mode"
    " FROM (SELECT m.* FROM {met} m LEFT JOIN (SELECT part_number, min(rank) AS f FROM {met} WHERE status = 'verified' GROUP BY 1) v ON v.part_number = m.part_number WHERE v.f IS NULL OR m.rank <= v.f) GROUP BY 1", near_=_NEAR, met=_MET,
)
_FORMS = " UNION ALL ".join(f"SELECT '{k}' AS vocab, ord, canonical, {_form('form')} AS form FROM ({_entries(k)})" for k in ("manufacturer", "brand", "category", "distributor"))
ORACLES["reference_usage"] = duck(
    f"SELECT vocab, canonical, count(*) AS forms, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT vocab, form, arg_max(canonical, ord) AS canonical FROM ({_FORMS}) WHERE form <> '' GROUP BY 1, 2) f LEFT JOIN (SELECT {_form(_code('part_manuf'))} AS form, count(*) AS n FROM {{catalogue_v}} GROUP BY 1) c ON c.form = f.form GROUP BY 1, 2"
)


def _chosen(rules: list[tuple], places: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({places[w]}, {_q(p)})' for p in parts)} THEN {_q(v)}" for w, parts, v in rules) + " END"


_LOW = "lower(description)"
_TEXTS = {"description": _LOW, "category": "lower(category)", "size": "lower(size)", "raw size": "size"}
_SIZED_ROWS = f"""SELECT *, coalesce(CASE WHEN {_got('description', _SIDED)} IS NOT NULL THEN {_got('description', _SIDED)} || ' in x ' || {_got('description', _SIDED, 2)} || ' in' END, trim(nullif(regexp_extract(description, {_q(V.SYNTHESISED_SIZE_PATTERN)}, 0), '')), 'Standard') AS size FROM {{sparse_base}}"""
_PSI, _VOLTS, _AMPS = (f"nullif(regexp_extract({_LOW}, {_q(p)}, 1), '')" for p in (V.SYNTHESISED_PRESSURE_PATTERN, V.SYNTHESISED_VOLT_PATTERN, V.SYNTHESISED_AMPERE_PATTERN))
_MADE = f"""SELECT row_number, manufacturer, brand, part_number, category, description, {_chosen(V.SYNTHESISED_MATERIAL, _TEXTS)} AS material, size, {_chosen(V.SYNTHESISED_UNIT, _TEXTS)} AS uom,
 coalesce({_PSI} || ' ' || upper(regexp_extract({_LOW}, {_q(V.SYNTHESISED_PRESSURE_PATTERN)}, 2)), {_VOLTS} || 'V' || coalesce(' / ' || {_AMPS} || 'A', ''), {_chosen(V.SYNTHESISED_PRESSURE, _TEXTS)}) AS pressure_rating,
 {_chosen(V.SYNTHESISED_TEMPERATURE, _TEXTS)} AS temperature_range, {_chosen(V.SYNTHESISED_CONNECTION, _TEXTS)} AS connection_type FROM {{sized_rows}}"""
_SPARSE = f"""SELECT w.row_number, {_MFR} AS manufacturer, CASE WHEN {_NO_BRAND} THEN {_MFR} ELSE {_ANY('brand')} END AS brand, {_ANY('part_number')} AS part_number, CASE WHEN k.classpath = {_q(V.GENERIC_PATH)} THEN 'Industrial Hardware' ELSE k.class_name END AS category, {_ANY('description')} AS description
 FROM {{wide}} w JOIN ({_taxonomy()}) k ON k.row_number = w.row_number"""
ORACLES["commerce_synthesise"] = duck(
    "SELECT * FROM {made} WHERE part_number <> '' AND description <> '' UNION ALL SELECT row_number, manufacturer, brand, part_number, '', description, '', '', '', '', '', '' FROM {sparse_base} WHERE part_number = '' OR description = ''",
    **_STEPS, sparse_base=_SPARSE, sized_rows=_SIZED_ROWS, made=_MADE,
)
