"""Queries on the graph's records, its checks and index, and on locators."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import graph as G
from folioflow.operators import locators as L
from folioflow.plans import bindings as B
from folioflow.plans import documents as D
from folioflow.plans import retrieval as V

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _broken(spark, sf):
    """Artifacts some of which lack an id, a page or an anchor."""
    n = F.col("number")
    a = B.artifacts(spark, sf)
    return a.withColumns(
        {
            "artifact_id": F.when(F.pmod(n, F.lit(13)) != 4, F.col("artifact_id")),
            "page_index": F.when(F.pmod(n, F.lit(17)) != 5, F.col("page_index")).otherwise(-1),
            "source_id": F.when(F.pmod(n, F.lit(19)) == 6, "whole_page").when(F.pmod(n, F.lit(19)) != 7, F.col("source_id")),
        }
    )


_BROKEN = """bk AS (SELECT * REPLACE (CASE WHEN number % 13 <> 4 THEN artifact_id END AS artifact_id, CASE WHEN number % 17 <> 5 THEN page_index ELSE -1 END AS page_index,
  CASE WHEN number % 19 = 6 THEN 'whole_page' WHEN number % 19 <> 7 THEN source_id END AS source_id) FROM art)"""


@query(f"""WITH {B.ARTIFACTS}, {_BROKEN}, k AS (SELECT *, artifact_id IS NOT NULL AND page_index >= 0 AS ok, artifact_type = 'table_cell' OR (table_id IS NOT NULL AND (row_index IS NOT NULL OR column_index IS NOT NULL)) AS cell FROM bk),
c AS (SELECT unnest(['artifact_missing_required_identity', 'artifact_missing_source_anchor', 'section_contains_missing_section_id', 'caption_figure_missing_explicit_pair', 'table_contains_cell_missing_table_id',
  'row_contains_cell_missing_row_index', 'column_contains_cell_missing_column_index', 'next_block_unparseable_source_block_id']) AS reason,
  unnest([count(*) FILTER (NOT ok), count(*) FILTER (ok AND source_id IS NULL), count(*) FILTER (ok AND artifact_type = 'section_header' AND section_id IS NULL),
  count(*) FILTER (ok AND (artifact_type IN ('figure', 'caption') OR figure_id IS NOT NULL OR caption_id IS NOT NULL) AND NOT (figure_id IS NOT NULL AND caption_id IS NOT NULL)),
  count(*) FILTER (ok AND cell AND table_id IS NULL), count(*) FILTER (ok AND cell AND table_id IS NOT NULL AND row_index IS NULL), count(*) FILTER (ok AND cell AND table_id IS NOT NULL AND column_index IS NULL),
  count(*) FILTER (ok AND source_id IS NOT NULL AND NOT regexp_matches(source_id, '[0-9]$'))]) AS n FROM k)
SELECT reason, n FROM c WHERE n > 0""")
def graph_skip_counters(spark, sf):
    return G.skipped(_broken(spark, sf))


_FILLED = ", ".join(f"CASE WHEN {c} <> '' THEN '\"{c}\":\"' || {c} || '\"' END" for c in G.LOCATOR_FIELDS)
_NODE = "'artifact:' || doc_id || ':' || page_index || ':' || artifact_id"


@query(f"""WITH {B.ARTIFACTS}, {_BROKEN} SELECT {_NODE} AS node_id, doc_id, 'page:' || doc_id || ':' || page_index AS page_id, page_index, artifact_id, artifact_type, modality, status AS candidate_status, source_id AS source_block_id,
  '{{' || array_to_string(list_filter([{_FILLED}], lambda x: x IS NOT NULL), ',') || '}}' AS locator FROM bk WHERE artifact_id IS NOT NULL AND page_index >= 0""")
def graph_artifact_nodes(spark, sf):
    """Nodes of the artifacts that a graph can name; the locator's fields as JSON."""
    return G.artifact_nodes(_broken(spark, sf)).withColumn("locator", F.to_json("locator"))


_PROVENANCE = f"""'{{"doc_id":"' || doc_id || '","page_id":"page:' || doc_id || ':' || page_index || '","page_index":' || page_index || ',"source_block_id":"' || source_id || '"'
  || array_to_string(list_transform(list_filter([{_FILLED}], lambda x: x IS NOT NULL), lambda x: ',' || x), '') || '}}'"""


@query(f"""WITH {B.ARTIFACTS}, r AS (SELECT artifact_id, {_PROVENANCE} AS provenance, {_NODE} AS na, 'page:' || doc_id || ':' || page_index AS np, 'source_anchor:' || doc_id || ':' || page_index || ':' || source_id AS ns FROM art),
e AS (SELECT 'located_on_page' AS edge_type, na AS source, np AS target, 'artifact_page_locator' AS rule_name, provenance, artifact_id FROM r UNION ALL SELECT 'supported_by_anchor', na, ns, 'artifact_source_anchor', provenance, artifact_id FROM r
  UNION ALL SELECT 'anchor_on_page', ns, np, 'source_anchor_page_locator', provenance, artifact_id FROM r)
SELECT substr(sha256(edge_type || '|' || source || '|' || target), 1, 24) AS edge_id, source, target, edge_type, rule_name, 'v1' AS rule_version, true AS deterministic, max_by(provenance, artifact_id) AS provenance FROM e GROUP BY edge_type, source, target, rule_name""")
def graph_edge_records(spark, sf):
    """Edges with their ids, rules and provenance."""
    return G.anchored_edges(B.artifacts(spark, sf))


@query(f"""WITH {B.POOLS}, {B.ARTIFACTS}, r AS (SELECT query, item FROM ord WHERE rank <= 3), n AS (SELECT DISTINCT query, {_NODE} AS node FROM r JOIN art ON number = item)
SELECT a.query, a.node AS source, b.node AS target FROM n a JOIN n b ON a.query = b.query AND a.node < b.node""")
def graph_debug_pairs(spark, sf):
    """Pairs of the artifacts of the three pages that a query found."""
    from folioflow.operators import retrieval as R

    found = R.bm25_topk(B.asked(spark, sf), B.items(spark, sf), 3).select("query", "item")
    a = B.artifacts(spark, sf)
    ids = a.select(F.col("number").alias("item"), "artifact_id")
    return G.debug_edges(found.join(ids, "item").select("query", "artifact_id"), a)


@query(f"""WITH {D._EDGES}, nt AS (SELECT CASE WHEN number % 10 = 3 THEN 'blob' ELSE 'artifact' END AS t FROM art), et AS (SELECT *, CASE WHEN hash_no % 9 = 2 THEN 'entails' ELSE edge_type END AS k FROM (SELECT *, length(source) AS hash_no FROM ed WHERE edge_type = 'located_on_page')),
v AS (SELECT 'unexpected_node_type:' || t AS violation FROM nt WHERE t <> 'artifact' UNION ALL SELECT 'unexpected_edge_type:' || k FROM et WHERE k <> 'located_on_page' UNION ALL SELECT 'missing_field:rule_name' FROM et UNION ALL SELECT 'missing_field:provenance' FROM et WHERE hash_no % 5 = 0)
SELECT violation, count(*) AS n FROM v GROUP BY violation""")
def graph_violations(spark, sf):
    """What the checks find in a graph with foreign types and missing fields."""
    a = B.artifacts(spark, sf)
    nodes = a.select(F.when(F.pmod("number", F.lit(10)) == 3, "blob").otherwise("artifact").alias("node_type"))
    n = F.length("source")
    edges = G.edges(a, context=False).filter("edge_type = 'located_on_page'")
    edges = edges.withColumns({"edge_type": F.when(n % 9 == 2, "entails").otherwise(F.col("edge_type")), "provenance": F.when(n % 5 != 0, "{}")})
    return G.violations(nodes, edges, G.EXPANSION, ["rule_name", "provenance"])


@query(f"""WITH {D._EDGES} SELECT * FROM ed WHERE edge_type NOT IN ('same_page', 'same_source_block')""")
def graph_checked_edges(spark, sf):
    """The graph's edges, after its checks."""
    a = B.artifacts(spark, sf)
    return G.checked(G.nodes(a), G.edges(a, context=False), G.EXPANSION, ["source", "target", "edge_type"])


@query(f"""WITH {D._EDGES}, e AS (SELECT * FROM ed WHERE edge_type NOT IN ('same_page', 'same_source_block')), a AS (SELECT edge_type, source AS node, 'out' AS direction FROM e UNION ALL SELECT edge_type, target, 'in' FROM e)
SELECT edge_type, direction, count(*) AS n, count(DISTINCT node) AS n_nodes FROM a GROUP BY ALL""")
def graph_edge_index(spark, sf):
    """Sizes of the index by type and direction."""
    return G.adjacency(G.edges(B.artifacts(spark, sf), context=False)).groupBy("edge_type", "direction").agg(F.count("*").alias("n"), F.count_distinct("node").alias("n_nodes"))


@query(f"""WITH {D._EDGES}, e AS (SELECT * FROM ed WHERE edge_type NOT IN ('same_page', 'same_source_block')), p AS (SELECT DISTINCT node FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) WHERE starts_with(node, 'page:'))
SELECT split_part(node, ':', 2) AS doc_id, CAST(split_part(node, ':', 3) AS INT) AS page_index, (SELECT count(*) FROM e WHERE edge_type = 'adjacent_page' AND (source = node OR target = node)) AS n_neighbours,
  (SELECT count(*) FROM e WHERE edge_type = 'located_on_page' AND target = node) AS n_artifacts, (SELECT count(*) FROM e WHERE edge_type = 'anchor_on_page' AND target = node) AS n_anchors FROM p""")
def graph_page_index(spark, sf):
    """What the re-ranking index knows of each page."""
    i = G.page_index_of(G.edges(B.artifacts(spark, sf), context=False), G.EXPANSION)
    page = F.concat_ws(":", F.lit("page"), "doc_id", F.col("page_index").cast("string"))
    out = i["structural_pages"].withColumn("page", page)
    for name, table in (("n_neighbours", "page_neighbours"), ("n_artifacts", "artifact_pages"), ("n_anchors", "anchor_pages")):
        out = out.join(i[table].groupBy("page").agg(F.count("*").alias(name)), "page", "left")
    return out.na.fill(0).drop("page")


_ADDED = f"""WITH {B.ARTIFACTS}, {B.QUESTIONS}, {V._EDGES_SEED}, x AS (SELECT {_NODE} AS node, doc_id, page_index, source_id FROM art), s3 AS (SELECT query, node FROM seed WHERE rank <= 3),
nb AS (SELECT DISTINCT a.node, b.node AS other FROM x a JOIN x b ON a.doc_id = b.doc_id AND abs(a.page_index - b.page_index) <= 1 AND a.node <> b.node),
ad AS (SELECT query, count(DISTINCT other) AS added FROM s3 JOIN nb USING (node) WHERE (query, other) NOT IN (SELECT (query, node) FROM s3) GROUP BY query),
pg AS (SELECT DISTINCT doc_id, page_index FROM x),
us AS (SELECT DISTINCT query, 'located_on_page' AS edge_type FROM s3 UNION SELECT query, 'adjacent_page' FROM s3 JOIN x USING (node) JOIN pg ON pg.doc_id = x.doc_id AND abs(pg.page_index - x.page_index) = 1)
SELECT edge_type, CAST(sum(coalesce(added, 0)) AS BIGINT) AS added, count(*) AS n_queries FROM us LEFT JOIN ad USING (query) GROUP BY edge_type"""


@query(_ADDED)
def expansion_by_edge_type(spark, sf):
    """What each edge type is credited with in an expansion by pages."""
    return G.added_by_type(V._seeds(spark, sf), G.edges(B.artifacts(spark, sf), context=False), "page_neighborhood")


@query(f"""WITH {B.ARTIFACTS}, an AS (SELECT artifact_id, doc_id, page_index, CASE WHEN number % 6 = 1 THEN 'lost' ELSE source_id END AS source_id, CASE WHEN has_bbox THEN 'own' END AS bbox FROM art),
bl AS (SELECT DISTINCT doc_id, page_index, source_id, page_index + CASE WHEN number % 9 = 0 THEN 1 ELSE 0 END AS block_page, CASE WHEN number % 2 = 0 THEN 'block' END AS bbox, char_start, char_end FROM art)
SELECT artifact_id, an.doc_id, an.source_id, coalesce(block_page, an.page_index) AS page_index, coalesce(an.bbox, bl.bbox) AS bbox, char_start, char_end, block_page IS NOT NULL AS resolved
FROM an LEFT JOIN bl ON an.doc_id = bl.doc_id AND an.page_index = bl.page_index AND an.source_id = bl.source_id""")
def anchor_enrichment(spark, sf):
    """Anchors with what their blocks know; some name no block."""
    a, n = B.artifacts(spark, sf), F.col("number")
    anchors = a.select("artifact_id", "doc_id", "page_index", F.when(F.pmod(n, F.lit(6)) == 1, "lost").otherwise(F.col("source_id")).alias("source_id"), F.when(F.col("has_bbox"), "own").alias("bbox"))
    page = F.col("page_index") + F.when(F.pmod(n, F.lit(9)) == 0, 1).otherwise(0)
    blocks = a.select("doc_id", "page_index", "source_id", page.alias("block_page"), F.when(F.pmod(n, F.lit(2)) == 0, "block").alias("bbox"), "char_start", "char_end").distinct()
    return L.enriched_anchors(anchors, blocks)


@query(f"""WITH {B.CLASSIFIED} SELECT artifact_id, list_concat(list_transform(list_filter(kinds, lambda k: k <> 'text_offset'), lambda k: '{{"block":"' || source_id || '","locator_kind":"' || k || '"}}'),
  CASE WHEN list_contains(kinds, 'text_offset') THEN ['{{"block":"' || source_id || '","locator_kind":"text_offset"}}'] ELSE [] END) AS locators FROM cls""")
def distinct_locators(spark, sf):
    """Locators that are listed twice, beside one of an unknown kind and empty fields."""
    c = B.classified(spark, sf)
    one = lambda k: F.create_map(F.lit("locator_kind"), k, F.lit("block"), F.col("source_id"), F.lit("empty"), F.lit(""))
    order = F.concat(F.filter("kinds", lambda k: k != "text_offset"), F.filter("kinds", lambda k: k == "text_offset"))
    return c.select("artifact_id", L.distinct_locators(F.concat(F.transform(order, one), F.array(one(F.lit("nonsense"))), F.transform("kinds", one))).alias("locators"))


@query(f"""WITH {B.CLASSIFIED} SELECT artifact_id, CASE WHEN element_locatable THEN NULL WHEN NOT source_anchored THEN 'missing_source_locator' WHEN NOT has_bbox THEN 'missing_bbox_locator' ELSE 'missing_element_locator' END AS note, locator_kind FROM cls""")
def locator_notes(spark, sf):
    return B.classified(spark, sf).select("artifact_id", L.note().alias("note"), "locator_kind")


_REF = "CASE number % 5 WHEN 0 THEN doc_id || '#p' || page_index || '#' || source_id WHEN 1 THEN doc_id || '#p' || page_index WHEN 2 THEN source_id WHEN 3 THEN doc_id || '#p' || (page_index + 1) || '#' || source_id ELSE 'other#p0' END"


@query(f"""WITH {B.ARTIFACTS}, r AS (SELECT artifact_id, number, doc_id, page_index, source_id, {_REF} AS ref FROM art), s AS (SELECT doc_id, page_index, list(DISTINCT source_id) AS ids FROM art WHERE number % 4 <> 1 AND block_no < 2 GROUP BY ALL)
SELECT artifact_id, ref, CASE number % 5 WHEN 3 THEN false WHEN 4 THEN false WHEN 1 THEN true ELSE s.doc_id IS NULL OR list_contains(ids, source_id) END AS resolves FROM r LEFT JOIN s USING (doc_id, page_index)""")
def source_references(spark, sf):
    """References in three spellings, to known and unknown pages and blocks."""
    a, k = B.artifacts(spark, sf), F.pmod("number", F.lit(5))
    at = lambda p: F.concat("doc_id", F.lit("#p"), p.cast("string"))
    page = F.col("page_index")
    ref = F.when(k == 0, F.concat(at(page), F.lit("#"), "source_id")).when(k == 1, at(page)).when(k == 2, F.col("source_id")).when(k == 3, F.concat(at(page + 1), F.lit("#"), "source_id")).otherwise("other#p0")
    sources = a.filter("number % 4 <> 1 AND block_no < 2").groupBy("doc_id", "page_index").agg(F.collect_set("source_id").alias("layout_block_ids"))
    return L.resolved(a.select("artifact_id", "doc_id", "page_index", ref.alias("ref")), sources).select("artifact_id", "ref", "resolves")


@query("""WITH a AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'anchored' END AS s, CASE doc_id % 4 WHEN 0 THEN 'schema_valid' END AS v, CASE WHEN doc_id % 2 = 0 THEN true END AS f FROM documents)
SELECT doc_id AS number, printf('d%d#p%03d', doc_id // 4, doc_id % 4) AS page_id, coalesce(s, v, 'candidate') AS status, coalesce(v, s, 'candidate') AS validation_status, coalesce(f, false) AS source_anchored, false AS element_locatable, false AS proof_trace_eligible, 0 AS n_locators FROM a""")
def schema_defaults(spark, sf):
    """Artifacts that lack fields or have them under another name."""
    n = F.col("number")
    raw = B.doc_pages(spark, sf).select(
        "number", "doc_id", "page_index", F.when(F.pmod(n, F.lit(3)) == 0, "anchored").alias("status"), F.when(F.pmod(n, F.lit(4)) == 0, "schema_valid").alias("validation_status"), F.when(F.pmod(n, F.lit(2)) == 0, True).alias("source_anchored")
    )
    return L.with_defaults(raw).select("number", "page_id", "status", "validation_status", "source_anchored", "element_locatable", "proof_trace_eligible", F.size("locators").alias("n_locators"))


@query(f"""WITH {B.ARTIFACTS}, st AS (SELECT * FROM art WHERE number % 3 <> 0), a AS (SELECT doc_id, page_index, count(*) AS n, list_sort(list(DISTINCT artifact_type)) AS t, list_sort(list(DISTINCT modality)) AS m, bool_and(artifact_type = 'text_span') AS ot FROM st GROUP BY ALL),
qr AS (SELECT DISTINCT doc_id, page_index, 'picked' AS reason, number % 2 = 0 AS img FROM art WHERE number % 4 <> 1), q AS (SELECT doc_id, page_index, max(reason) AS reason, bool_or(img) AS img FROM qr GROUP BY ALL),
s AS (SELECT 'd' || (doc_id // 4) AS doc_id, CAST(doc_id % 4 AS INT) AS page_index, doc_id % 5 = 0 AS img FROM documents)
SELECT doc_id, page_index, doc_id || '#p' || page_index AS page_ref, coalesce(n, 0) AS n_artifacts, coalesce(array_to_string(t, '|'), '') AS artifact_types, coalesce(array_to_string(m, '|'), '') AS modalities, coalesce(reason, '') AS selection_reason,
  coalesce(q.img, false) OR coalesce(s.img, false) AS has_image_input, coalesce(ot, false) AS only_text_span FROM a FULL JOIN q USING (doc_id, page_index) LEFT JOIN s USING (doc_id, page_index)""")
def page_info_merge(spark, sf):
    """Pages of stored artifacts, of quality rows and of sources in one table."""
    a, n = B.artifacts(spark, sf), F.col("number")
    quality = a.filter("number % 4 <> 1").select("doc_id", "page_index", F.lit("picked").alias("selection_reason"), F.when(F.pmod(n, F.lit(2)) == 0, "img").otherwise("").alias("page_image_path")).distinct()
    sources = B.doc_pages(spark, sf).select("doc_id", "page_index", (F.pmod(n, F.lit(5)) == 0).alias("has_image"))
    return L.page_infos(a.filter("number % 3 <> 0"), quality, sources)


@query(f"""WITH {D._LABELS}, c AS (SELECT count(*) AS n_raw, count(*) FILTER (NOT broad AND NOT fopen) AS n_valid, count(*) FILTER (broad OR fopen) AS n_issues FROM l4)
SELECT n_raw, n_valid, round(n_valid / n_raw, 6) AS schema_valid_rate, CAST(0.25 AS DOUBLE) AS discard_rate FROM c""")
def metric_fallback(spark, sf):
    """A summary that knows only its discard rate; the rest is recounted."""
    from folioflow.operators import artifacts as A

    kept = A.quality_labels(B.classified(spark, sf)).agg(F.count("*").alias("n_raw"), F.count_if(F.col("discard_reason").isNull()).alias("n_valid"), F.count_if(F.col("discard_reason").isNotNull()).alias("n_issues"))
    summary = spark.createDataFrame([(None, None, None, 0.25)], "n_raw long, n_valid long, schema_valid_rate double, discard_rate double")
    return L.resolved_metrics(summary, kept, F.col("n_issues"))
