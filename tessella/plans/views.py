"""Catalogue-shaped views over the test tables, in SQL that Spark and DuckDB both read. {name} stands for a table or view."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "catalogue_v": """
SELECT CAST(p_partkey AS INT) + 2 AS row_number, 'part_feed' AS source_name,
 CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE concat(CASE p_partkey % 3 WHEN 0 THEN 'APO' WHEN 1 THEN 'PAR' ELSE 'ZZZ' END, '-', CAST(p_partkey - (p_partkey % 5) AS STRING)) END AS mfg_part_num,
 CASE p_partkey % 8 WHEN 0 THEN 'Apollo' WHEN 1 THEN 'PARKER  HANNIFIN' WHEN 2 THEN 'Freud Inc (2435)' WHEN 3 THEN 'Boise Cascade (BOISE)' WHEN 4 THEN '-- Unbranded --' WHEN 5 THEN NULL WHEN 6 THEN 'Emerson Electric Company Intl' ELSE 'Acme Widgets' END AS part_manuf,
 concat(CAST(p_size AS STRING), ' in ', CASE p_partkey % 4 WHEN 0 THEN 'Brass Ball Valve, 600 psi' WHEN 1 THEN 'sanding belts P150' WHEN 2 THEN 'hose clamp' ELSE '15A 120V Receptacle' END, ' ', p_name) AS part_desc,
 CASE p_partkey % 5 WHEN 0 THEN '304 SS' WHEN 1 THEN 'pvc' WHEN 2 THEN 'C.I.' WHEN 3 THEN NULL ELSE 'unobtainium' END AS material,
 CAST(p_size AS STRING) AS size, CASE p_partkey % 3 WHEN 0 THEN 'Inches' WHEN 1 THEN 'mm.' ELSE 'furlong' END AS uom,
 CAST(p_size * 40 AS STRING) AS pressure_rating, p_brand AS brand
FROM {part}""",
    "doc_pages_v": """
SELECT concat('doc-', CAST(row_number AS STRING)) AS document_id, 1 AS page,
 'Part Number: ' || mfg_part_num || chr(10) || 'Size: ' || size || ' in' || chr(10)
 || 'Material: ' || COALESCE(material, 'see materials list. Saves on materials and time') || chr(10)
 || 'Pressure Rating: ' || pressure_rating || ' psi' AS text
FROM {catalogue_v} WHERE mfg_part_num IS NOT NULL
UNION ALL
SELECT concat('doc-', CAST(row_number AS STRING)), 2,
 'Size: ' || CASE row_number % 6 WHEN 0 THEN '99' ELSE size END || ' in' || chr(10) || 'Voltage Rating: 120 V'
FROM {catalogue_v} WHERE row_number % 3 = 0""",
    "truth_v": """
SELECT row_number,
 CASE WHEN row_number % 7 = 0 THEN NULL ELSE CASE part_manuf WHEN 'Apollo' THEN 'Apollo Valves' WHEN 'PARKER  HANNIFIN' THEN 'Parker Hannifin' WHEN 'Freud Inc (2435)' THEN 'freud' WHEN 'Emerson Electric Company Intl' THEN 'Emerson-Electric' ELSE NULL END END AS manufacturer,
 CASE material WHEN '304 SS' THEN 'Stainless Steel 304' WHEN 'pvc' THEN 'PVC' WHEN 'C.I.' THEN 'Cast Iron' ELSE NULL END AS material,
 CASE uom WHEN 'Inches' THEN 'in' WHEN 'mm.' THEN 'mm' ELSE NULL END AS uom
FROM {catalogue_v}""",
    "decisions_v": """
SELECT CAST(o_orderkey AS STRING) AS event_id, CAST(o_custkey AS INT) + 2 AS row_number,
 CASE o_orderkey % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'correct' ELSE 'approve' END AS action,
 concat('reviewer-', CAST(o_orderkey % 5 AS STRING)) AS reviewer, o_orderdate AS decided_at,
 CASE WHEN o_orderkey % 8 = 2 THEN 'Brass' ELSE NULL END AS corrected_material
FROM {orders}""",
    "versions_v": """
SELECT concat('P-', CAST(l_partkey AS STRING)) AS product_id, concat('V-', CAST(year(l_shipdate) AS STRING)) AS version_id, max(l_shipdate) AS created_at,
 CASE l_linenumber % 4 WHEN 0 THEN 'size' WHEN 1 THEN 'material' WHEN 2 THEN 'pressure_rating' ELSE 'voltage' END AS name,
 max(CAST(CAST(l_quantity AS INT) % 5 AS STRING)) AS value, max(CASE l_returnflag WHEN 'A' THEN NULL ELSE 'in' END) AS unit,
 max(CASE l_linestatus WHEN 'O' THEN 'inferred' ELSE 'verified' END) AS status, max(l_discount * 10) AS confidence
FROM {lineitem} GROUP BY concat('P-', CAST(l_partkey AS STRING)), concat('V-', CAST(year(l_shipdate) AS STRING)), CASE l_linenumber % 4 WHEN 0 THEN 'size' WHEN 1 THEN 'material' WHEN 2 THEN 'pressure_rating' ELSE 'voltage' END""",
    "visits_v": """
SELECT event_id, ts AS occurred_at,
 CASE user_id % 6 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36' WHEN 1 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X) Version/17 Safari/605' WHEN 2 THEN 'Googlebot/2.1 (+http://x)' WHEN 3 THEN '' WHEN 4 THEN 'Mozilla/5.0 (X11; Linux) Firefox/121.0' ELSE 'Mozilla/5.0 (Windows) Chrome/120 Edg/120' END AS user_agent,
 event_type AS path FROM {events}""",
    "latency_v": "SELECT event_id, event_type AS batch_id, value AS latency_ms, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed FROM {events}",
    "hits_v": """
SELECT mfg_part_num AS part_number, CAST(row_number % 10 AS INT) AS rank, row_number,
 CASE row_number % 5 WHEN 0 THEN 'https://www.amazon.com/dp/' || mfg_part_num WHEN 1 THEN 'https://shop.parker.com/p/' || mfg_part_num WHEN 2 THEN 'https://www.apollovalves.com/product/' || mfg_part_num WHEN 3 THEN 'https://notparker.com/' || mfg_part_num ELSE 'https://www.diablotools.com/store/' || mfg_part_num || '.pdf' END AS url
FROM {catalogue_v} WHERE mfg_part_num IS NOT NULL""",
    "suggestions_v": """
SELECT row_number, CASE row_number % 4 WHEN 0 THEN 'Tools & Equipment > Machinery > Power Tools' WHEN 1 THEN 'Industrial Supplies > Maintenance' WHEN 2 THEN 'Made Up > Path' ELSE 'Safety & PPE > Personal Protective Equipment > Hand Protection' END AS classpath,
 CAST(row_number % 13 AS DOUBLE) / 10.0 - 0.1 AS confidence FROM {catalogue_v}""",
    "pages_v": "SELECT page_id, url, html FROM {pages}",
}


def _needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the test data."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{x: view(spark, sf_dir, x) for x in _needs(name)})


def duck(body: str, **more: str) -> str:
    """DuckDB SQL: the views that the body names in braces, and further ones, as a WITH clause before it."""
    done: dict[str, str] = {}

    def add(name: str, text: str) -> None:
        for x in re.findall(r"\{(\w+)\}", text):
            if x not in done and (x in VIEWS or x in more):
                add(x, VIEWS.get(x) or more[x])
        done[name] = re.sub(r"\{(\w+)\}", r"\1", text)

    add("result_", body)
    last = done.pop("result_")
    return ("WITH " + ", ".join(f"{k} AS ({v})" for k, v in done.items()) + " " if done else "") + last
