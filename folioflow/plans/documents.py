"""Queries on pages, artifacts, the graph, and audits over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import artifacts as A
from folioflow.operators import audit as U
from folioflow.operators import extract as X
from folioflow.operators import graph as G
from folioflow.operators import guards as Q
from folioflow.operators import metrics as M
from folioflow.operators import pages as P
from folioflow.operators import ranking as K
from folioflow.operators import tables as J
from folioflow.plans import bindings as B
from folioflow.sources.sinks import kept


QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {B.BLOCKS} SELECT number, doc_id, page_index, block_no, char_start, char_end, block_text FROM blocks")
def layout_chunks(spark, sf):
    return B.blocks(spark, sf)


@query(r"""WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
b AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
  trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM a)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS line_index,
  CAST(off + length(raw) - length(ltrim(raw)) AS BIGINT) AS char_start, CAST(off + length(rtrim(raw)) AS BIGINT) AS char_end, line FROM b WHERE line <> ''""")
def page_lines_offsets(spark, sf):
    return P.lines(B.documents(spark, sf), ["doc_id"])


@query(f"WITH {B.BLOCKS}, p AS (SELECT doc_id, max(page_index) + 1 AS n_pages, count(DISTINCT page_index) = max(page_index) + 1 AS contiguous FROM blocks GROUP BY doc_id) SELECT * FROM p")
def page_count_inference(spark, sf):
    return P.page_counts(B.blocks(spark, sf), "doc_id", "page_index")


@query("""WITH p AS (SELECT 'd' || (doc_id // 4) AS doc_id, max(doc_id % 4) + 1 AS n FROM documents GROUP BY 1),
r AS (SELECT item_id, 'd' || (item_id * 3) AS doc_id, CAST(item_id % 6 - 1 AS INT) AS page FROM benchmark)
SELECT item_id, doc_id, page, CASE WHEN n IS NULL THEN 'unknown_document' WHEN page < 0 OR page >= n THEN 'out_of_range' END AS issue FROM r LEFT JOIN p USING (doc_id)""")
def explicit_page_bounds(spark, sf):
    i = F.col("item_id")
    refs = B.table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("d"), (i * 3).cast("string")).alias("doc_id"), (F.pmod(i, F.lit(6)) - 1).cast("int").alias("page"))
    counts = P.page_counts(B.doc_pages(spark, sf), "doc_id", "page_index").select("doc_id", "n_pages")
    return P.bounded(refs, counts, "doc_id", "page")


@query(f"WITH {B.ARTIFACTS} SELECT * FROM art")
def artifact_mock_compile(spark, sf):
    return B.artifacts(spark, sf)


@query("""WITH k AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) ORDER BY doc_id) AS n FROM documents)
SELECT lang, count(*) FILTER (n = 1) AS kept, count(*) FILTER (n > 1) AS removed FROM k GROUP BY lang""".replace("\\\\", "\\"))
def artifact_dedup(spark, sf):
    d = B.table(spark, sf, "documents")
    c = A.first_of_equal(d, [F.col("lang"), T.compact(F.lower("text"))], [F.col("doc_id")])
    return c.groupBy("lang").agg(F.count_if(F.col("copy_no") == 1).alias("kept"), F.count_if(F.col("copy_no") > 1).alias("removed"))


@query("""WITH k AS (SELECT doc_id, source, md5(text) AS id, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, source FROM k WHERE id NOT IN (SELECT id FROM k WHERE n > 1)""")
def duplicate_ids_dropped(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "source", "lang", "text", F.md5("text").alias("id"))
    return A.drop_shared_ids(d, [F.col("lang"), F.col("text")], [F.col("doc_id")], "id").select("doc_id", "source")


@query(f"WITH {B.CLASSIFIED} SELECT artifact_id, artifact_type, source_anchored, element_locatable, proof_trace_eligible, locator_kind FROM cls")
def locator_classify(spark, sf):
    return B.classified(spark, sf).select("artifact_id", "artifact_type", "source_anchored", "element_locatable", "proof_trace_eligible", "locator_kind")


@query(f"WITH {B.CLASSIFIED} SELECT kind, count(*) AS n FROM (SELECT unnest(kinds) AS kind FROM cls) GROUP BY kind")
def locator_kind_counts(spark, sf):
    return A.kind_counts(B.classified(spark, sf))


_REASON = (
    B.CLASSIFIED
    + r""",
e0 AS (SELECT *, lower(trim(regexp_replace(content, '\s+', ' ', 'g'))) AS c FROM cls),
e1 AS (SELECT *, CASE WHEN artifact_type NOT IN ('numeric_fact', 'table', 'table_cell', 'figure', 'caption') THEN 'unstructured_artifact_type'
  WHEN c = '' OR regexp_matches(c, 'mock |mocked |placeholder |generic |candidate anchored to|anchored to the full page image') THEN 'mock_or_placeholder_content'
  WHEN NOT source_anchored THEN 'missing_valid_source_anchor' WHEN hp AND NOT strong THEN 'full_page_only_locator'
  WHEN NOT (strong OR has_bbox OR anchor_type = 'table_cell') THEN 'missing_strong_locator'
  WHEN NOT element_locatable OR NOT proof_trace_eligible THEN 'not_element_locatable_or_proof_trace_ineligible' ELSE 'eligible' END AS reason,
  (hp AND NOT strong) OR confidence < 0.5 AS weak FROM e0),
elig AS (SELECT *, CASE WHEN reason <> 'eligible' THEN 0.0 WHEN weak THEN 0.25 ELSE 1.0 END AS weight FROM e1)"""
)


@query(f"WITH {_REASON} SELECT artifact_type, reason, count(*) AS n, count(*) FILTER (weak) AS n_weak, count(DISTINCT doc_id) AS n_docs, CAST(sum(weight) AS DOUBLE) AS weight FROM elig GROUP BY ALL")
def eligibility_reasons(spark, sf):
    e = A.eligibility(B.classified(spark, sf))
    return e.groupBy("artifact_type", "reason").agg(
        F.count("*").alias("n"), F.count_if("weak").alias("n_weak"), F.count_distinct("doc_id").alias("n_docs"), F.sum("weight").alias("weight")
    )


@query(f"WITH {_REASON}, x AS (SELECT reason, artifact_id, row_number() OVER (PARTITION BY reason ORDER BY artifact_id) AS n FROM elig) SELECT reason, artifact_id, CAST(n AS INT) AS n FROM x WHERE n <= 5")
def eligibility_examples(spark, sf):
    e = A.eligibility(B.classified(spark, sf)).select("reason", "artifact_id")
    return K.capped(e, [F.col("artifact_id")], [(["reason"], 5)]).withColumn("n", F.row_number().over(K.Window.partitionBy("reason").orderBy("artifact_id")))


_NUM = r"(?i)[-+]?\$?\d[\d,]*(\.\d+)?\s*(%|percent|percentage|bps|bp|million|billion|thousand|m|bn)?"
_LABELS = (
    B.CLASSIFIED
    + rf""",
l0 AS (SELECT *, trim(regexp_replace(content, '\s+', ' ', 'g')) AS c, coalesce(value_text, '') AS v, coalesce(row_label, '') AS r, coalesce(column_label, '') AS cl,
  row_index IS NOT NULL AND column_index IS NOT NULL AS placed FROM cls),
l1 AS (SELECT *, v <> '' OR regexp_matches(c, '{_NUM}') AS num, v <> '' AND r <> '' AND cl <> '' AS fields, len(string_split(c, ' ')) AS words, c || ' ' || v || ' ' || r || ' ' || cl AS said,
  (hp AND NOT strong) OR NOT (strong OR has_bbox OR anchor_type = 'table_cell') AS weak FROM l0),
l2 AS (SELECT *, artifact_type IN ('table', 'caption') AND NOT num AND (words <= 8 OR (words <= 14 AND regexp_matches(said, '(?i)\b(table|summary|overview|caption|title|figure|chart|appendix|contents)\b'))) AS title FROM l1),
l3 AS (SELECT *, artifact_type = 'table' AND NOT fields AND (title OR (NOT num AND regexp_matches(said, '(?i)\b(table|summary|overview|contains|lists|shows|presents|describes|reports|includes|data|values|metrics|indicators)\b'))
    OR (num AND r = '' AND cl = '')) AS broad, artifact_type = 'numeric_fact' AND NOT (fields AND num) AS fopen, artifact_type = 'table_cell' AND NOT (fields AND placed AND num) AS copen FROM l2),
l4 AS (SELECT *, list_filter([CASE WHEN ((artifact_type = 'table_cell' AND NOT copen) OR (artifact_type = 'numeric_fact' AND NOT fopen)) AND (strong OR has_bbox OR anchor_type = 'table_cell') THEN 'atomic_numeric_ok' END,
  CASE WHEN broad THEN 'broad_table_only' END, CASE WHEN fopen OR (copen AND num) THEN 'missing_numeric_fact' END, CASE WHEN weak THEN 'weak_locator' END,
  CASE WHEN title THEN 'caption_or_table_title_only' END, CASE WHEN broad OR fopen OR copen OR title OR weak THEN 'schema_valid_but_semantically_weak' END], lambda x: x IS NOT NULL) AS labels FROM l3)"""
)


@query(f"WITH {_LABELS} SELECT artifact_id, labels, CASE WHEN broad THEN 'broad_table_only_semantically_weak' WHEN fopen THEN 'numeric_fact_missing_value_metric_context' END AS discard_reason FROM l4")
def quality_taxonomy(spark, sf):
    return A.quality_labels(B.classified(spark, sf)).select("artifact_id", "labels", "discard_reason")


@query(f"WITH {B.ARTIFACTS}, x AS (SELECT artifact_id, unnest(list_filter([CASE WHEN artifact_type NOT IN ('text_span', 'numeric_fact', 'table', 'figure', 'caption') AND number % 4 = 3 THEN 'unknown_artifact_type' END, CASE WHEN number % 6 = 0 THEN 'anchor_source_not_in_layout' END], lambda i: i IS NOT NULL)) AS issue FROM art) SELECT * FROM x")
def schema_validation(spark, sf):
    """Artifacts with planted faults: some types are spelled wrongly, some anchors name no block."""
    a = B.artifacts(spark, sf)
    wrong = ~F.col("artifact_type").isin("text_span", "numeric_fact", "table", "figure", "caption") & (F.pmod("number", F.lit(4)) == 3)
    faulty = a.withColumn("artifact_type", F.when(wrong, "unheard_of").otherwise(F.col("artifact_type")))
    return A.validation_issues(faulty, a.filter(F.pmod("number", F.lit(6)) != 0))


_EDGES = (
    B.ARTIFACTS
    + """,
n AS (SELECT *, doc_id || ':' || page_index AS dp, 'artifact:' || doc_id || ':' || page_index || ':' || artifact_id AS na, 'page:' || doc_id || ':' || page_index AS np,
  'source_anchor:' || doc_id || ':' || page_index || ':' || source_id AS ns, table_id IS NOT NULL AND (artifact_type = 'table_cell' OR row_index IS NOT NULL OR column_index IS NOT NULL) AS cell FROM art),
pg AS (SELECT DISTINCT doc_id, page_index, np FROM n), an AS (SELECT DISTINCT doc_id, page_index, ns, block_no FROM n),
ed AS (SELECT na AS source, np AS target, 'located_on_page' AS edge_type FROM n UNION SELECT na, ns, 'supported_by_anchor' FROM n UNION SELECT ns, np, 'anchor_on_page' FROM n
  UNION SELECT 'section:' || dp || ':' || section_id, na, 'section_contains' FROM n WHERE section_id IS NOT NULL
  UNION SELECT 'caption:' || dp || ':' || caption_id, 'figure:' || dp || ':' || figure_id, 'caption_of' FROM n WHERE caption_id IS NOT NULL AND figure_id IS NOT NULL
  UNION SELECT 'figure:' || dp || ':' || figure_id, 'caption:' || dp || ':' || caption_id, 'figure_has_caption' FROM n WHERE caption_id IS NOT NULL AND figure_id IS NOT NULL
  UNION SELECT 'table:' || dp || ':' || table_id, na, 'table_contains_cell' FROM n WHERE cell
  UNION SELECT 'table_row:' || dp || ':' || table_id || ':' || row_index, na, 'row_contains_cell' FROM n WHERE cell AND row_index IS NOT NULL
  UNION SELECT 'table_column:' || dp || ':' || table_id || ':' || column_index, na, 'column_contains_cell' FROM n WHERE cell AND column_index IS NOT NULL
  UNION SELECT a.np, b.np, 'adjacent_page' FROM pg a JOIN pg b ON a.doc_id = b.doc_id AND b.page_index = a.page_index + 1
  UNION SELECT a.ns, b.ns, 'next_block' FROM an a JOIN an b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND b.block_no = a.block_no + 1
  UNION SELECT a.na, b.na, 'same_page' FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.na < b.na
  UNION SELECT a.na, b.na, 'same_source_block' FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.source_id = b.source_id AND a.na < b.na)"""
)


@query(f"""WITH {_EDGES}, m AS (SELECT na AS node_id, 'artifact' AS node_type, doc_id, page_index FROM n UNION SELECT np, 'page', doc_id, page_index FROM n UNION SELECT ns, 'source_anchor', doc_id, page_index FROM n
  UNION SELECT 'section:' || dp || ':' || section_id, 'section', doc_id, page_index FROM n WHERE section_id IS NOT NULL
  UNION SELECT 'figure:' || dp || ':' || figure_id, 'figure', doc_id, page_index FROM n WHERE caption_id IS NOT NULL AND figure_id IS NOT NULL
  UNION SELECT 'caption:' || dp || ':' || caption_id, 'caption', doc_id, page_index FROM n WHERE caption_id IS NOT NULL AND figure_id IS NOT NULL
  UNION SELECT 'table:' || dp || ':' || table_id, 'table', doc_id, page_index FROM n WHERE cell
  UNION SELECT 'table_row:' || dp || ':' || table_id || ':' || row_index, 'table_row', doc_id, page_index FROM n WHERE cell AND row_index IS NOT NULL
  UNION SELECT 'table_column:' || dp || ':' || table_id || ':' || column_index, 'table_column', doc_id, page_index FROM n WHERE cell AND column_index IS NOT NULL) SELECT * FROM m""")
def graph_nodes(spark, sf):
    return G.nodes(B.artifacts(spark, sf))


@query(f"WITH {_EDGES} SELECT * FROM ed WHERE edge_type <> 'same_page'")
def graph_edges(spark, sf):
    """All edges but the pairs on a page, whose number grows with the square of a page's artifacts."""
    a = B.artifacts(spark, sf)
    return G.edges(a, context=False).unionByName(G.pairs(G.identified(a), G.ON_BLOCK, "same_source_block"))


@query(f"WITH {_EDGES} SELECT edge_type, count(*) AS n FROM ed GROUP BY edge_type")
def graph_edges_by_type(spark, sf):
    a = B.artifacts(spark, sf)
    return G.counts_by_type(G.edges(a, context=False), a)


_DEGREE = "deg AS (SELECT node_id, count(*) AS degree FROM (SELECT source AS node_id FROM ed UNION ALL SELECT target FROM ed) WHERE starts_with(node_id, 'artifact:') GROUP BY node_id)"


@query(f"WITH {_EDGES}, {_DEGREE} SELECT node_id, degree, round(degree / max(degree) OVER (), 8) AS prior FROM deg")
def graph_degree_prior(spark, sf):
    return G.artifact_degree_prior(B.artifacts(spark, sf)).select("node_id", "degree", F.round("prior", 8).alias("prior"))


@query(f"""WITH {B.CLASSIFIED}, p AS (SELECT doc_id, page_index, bool_or(modality = 'text') AS t, bool_or(modality = 'image') AS v, bool_or(modality = 'numeric') AS n, bool_or(modality = 'table') AS tb,
  bool_and(source_anchored) AS ok FROM cls GROUP BY ALL),
r AS (SELECT count(*) AS n_pages, count(DISTINCT doc_id) AS n_docs, round(avg(CAST(t AS INT)), 6) AS text_rate, round(avg(CAST(v AS INT)), 6) AS visual_rate, round(avg(CAST(n AS INT)), 6) AS numeric_rate,
  round(avg(CAST(tb AS INT)), 6) AS table_rate, round(avg(CAST(ok AS INT)), 6) AS anchored_rate FROM p)
SELECT * FROM r""")
def crossdoc_coverage(spark, sf):
    return _coverage(spark, sf)


def _coverage(spark, sf):
    of = lambda m: F.max(F.col("modality") == m)
    p = B.classified(spark, sf).groupBy("doc_id", "page_index").agg(
        of("text").alias("t"), of("image").alias("v"), of("numeric").alias("n"), of("table").alias("tb"), F.min("source_anchored").alias("ok")
    )
    rate = lambda c, name: F.round(F.avg(F.col(c).cast("int")), 6).alias(name)
    return p.agg(
        F.count("*").alias("n_pages"), F.count_distinct("doc_id").alias("n_docs"), rate("t", "text_rate"), rate("v", "visual_rate"), rate("n", "numeric_rate"), rate("tb", "table_rate"), rate("ok", "anchored_rate")
    )


@query(ORACLE["crossdoc_coverage"].replace("SELECT * FROM r", """SELECT list_filter([CASE WHEN text_rate < 0.9 THEN 'text_rate_below_0.9' END, CASE WHEN anchored_rate < 0.9 THEN 'anchored_rate_below_0.9' END,
  CASE WHEN visual_rate > 0.2 THEN 'visual_rate_above_0.2' END], lambda x: x IS NOT NULL) AS blocking, NOT (text_rate < 0.9 OR anchored_rate < 0.9 OR visual_rate > 0.2) AS ready FROM r"""))
def readiness_gate(spark, sf):
    return U.readiness(_coverage(spark, sf), {"text_rate": 0.9, "anchored_rate": 0.9}, {"visual_rate": 0.2}).select("blocking", "ready")


_RULES_SQL = " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (regexp_matches(text, '{p}')) AS n_rows FROM documents" for k, p in U.RULES.items())


@query(_RULES_SQL)
def leak_audit(spark, sf):
    return U.scan(B.documents(spark, sf), "text")


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule FROM documents WHERE regexp_matches(text, '{p}')" for k, p in U.RULES.items()))
def secret_scan(spark, sf):
    return U.violations(B.documents(spark, sf), ["doc_id"], "text")


_ROW = """'{"doc_id":' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ',"lang":' || coalesce(CAST(to_json(lang) AS VARCHAR), 'null') || ',"n_chars":' || coalesce(CAST(n_chars AS VARCHAR), 'null')
  || ',"source":' || coalesce(CAST(to_json(source) AS VARCHAR), 'null') || ',"text":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '}'"""


@query(f"""WITH h AS (SELECT sha256({_ROW}) AS h FROM documents), s AS (SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 12) AS HUGEINT)) AS a, sum(CAST('0x' || substr(h, 13, 12) AS HUGEINT)) AS b FROM h)
SELECT n AS n_rows, sha256(n || ':' || a || ':' || b) AS digest FROM s""")
def content_hash(spark, sf):
    """Order-free hash of the documents, for reproducibility checks."""
    return U.content_hash(B.table(spark, sf, "documents"))


@query("""WITH y AS (SELECT o_orderpriority AS p, list_sort(list(DISTINCT year(o_orderdate)))[1:3] AS ys FROM orders GROUP BY 1),
c AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL),
x AS (SELECT p, y, n, list_position(ys, y) - 1 AS column_index FROM c JOIN y USING (p) WHERE list_contains(ys, y))
SELECT p AS page, 'Total ' || regexp_replace(p, '^[0-9]-', '') AS row_label, CAST(y AS VARCHAR) AS column_label, n || '%' AS value_text, CAST(column_index AS INT) AS column_index,
  CAST(10.0 + CASE WHEN column_index = 0 THEN 0.4 ELSE 0.0 END AS DOUBLE) AS confidence, CAST(row_number() OVER (PARTITION BY p ORDER BY column_index) AS INT) AS cell_rank FROM x""")
def atomic_cells(spark, sf):
    """Pages made of orders: three years as headers, a label, a value line for each year."""
    o = B.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("page"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    g = o.groupBy("page").agg(F.slice(F.array_sort(F.collect_list(F.struct("y", "n"))), 1, 3).alias("v"))
    label = F.array(F.concat(F.lit("Total "), F.regexp_replace("page", "^[0-9]-", "")))
    text = F.concat(F.transform("v", lambda x: x["y"].cast("string")), label, F.transform("v", lambda x: F.concat(x["n"].cast("string"), F.lit("%"))))
    lines = P.lines(g.select("page", F.array_join(text, "\n").alias("text")), ["page"])
    return X.atomic_cells(lines, ["page"]).select("page", "row_label", "column_label", "value_text", "column_index", "confidence", "cell_rank")


@query("""SELECT r_regionkey AS page, upper(substr(n_name, 1, 2)) || printf('%02d', n_nationkey) AS code, n_name AS name, r_name AS group_label, upper(substr(r_name, 1, 2)) AS group_code,
  CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS VARCHAR) AS ordinal FROM nation JOIN region ON n_regionkey = r_regionkey""")
def code_name_pairs(spark, sf):
    """Pages made of regions: the region with its code, then numbered nations, each followed by its code."""
    n, r = B.table(spark, sf, "nation"), B.table(spark, sf, "region")
    j = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # regions: five fixed rows
    g = j.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("v"))
    head = F.array(F.concat("r_name", F.lit(" ("), F.upper(F.substring("r_name", 1, 2)), F.lit(")")))
    item = F.transform("v", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["n_name"], F.lit("\n"), F.upper(F.substring(x["n_name"], 1, 2)), F.format_string("%02d", x["n_nationkey"])))
    return X.code_names(g.select(F.col("r_regionkey").alias("page"), F.array_join(F.concat(head, item), "\n").alias("text")), "page")


def _words(names: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in names) + "]"


def _every(text: str, words: list[str]) -> str:
    return " AND ".join(f"contains({text}, '{w}')" for w in words)


_OPERANDS_SQL = "[" + ", ".join(f"CASE WHEN {' OR '.join('(' + _every('nq', w) + ')' for w in lists)} THEN '{name}' END" for name, lists in Q.NEEDED) + "]"
_DIMENSIONS_SQL = (
    "list_concat("
    + ", ".join(
        f"""CASE WHEN {" + ".join(f"CAST(contains(nq, '{w}') AS INT)" for w in words)} >= {least} THEN [{", ".join("{'dimension': '" + d + "', 'aliases': " + _words(aliases) + "}" for d, _, aliases in dims)}] ELSE [] END"""
        for words, least, dims, _ in Q.REQUIREMENTS
    )
    + ", list_transform(regexp_extract_all(question, '\\b(?:19|20)\\d{2}\\b'), lambda y: {'dimension': 'year_' || y, 'aliases': [y]}))"
)
_NEEDED_SQL = "greatest(0, " + ", ".join(f"CASE WHEN {' + '.join(f'CAST(contains(nq, {chr(39)}{w}{chr(39)}) AS INT)' for w in words)} >= {least} THEN {n} ELSE 0 END" for words, least, _, n in Q.REQUIREMENTS) + ")"

_PROFILE = f"""{B.QUESTIONS}, px AS (SELECT query, doc_id, question, lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) AS nq, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(question, '[a-zA-Z][a-zA-Z0-9]+'), lambda w: lower(w)),
  lambda w: length(w) > 2 AND w NOT IN ({", ".join(f"'{w}'" for w in T.QUESTION_STOPWORDS)})))) AS q_tokens,
  list_sort(list_distinct(list_filter(regexp_extract_all(question, '\\b([A-Z]{{1,4}}\\d{{1,4}})\\b', 1), lambda c: NOT regexp_matches(c, '^(FY\\d+|Q\\d|F\\d+|AP\\d+|GPT\\d+)$')))) AS codes,
  regexp_extract_all(question, '[-+]?\\d+(?:\\.\\d+)?') AS numbers FROM qs),
py AS (SELECT *, list_sort(list_filter({_OPERANDS_SQL}, lambda x: x IS NOT NULL)) AS required_operands, {_DIMENSIONS_SQL} AS known, {_NEEDED_SQL} AS numbers_needed FROM px),
pz AS (SELECT *, CASE WHEN len(known) > 0 THEN known ELSE list_transform(q_tokens[1:{Q.MOST_TERMS}], lambda t: {{'dimension': 'term_' || t, 'aliases': [t]}}) END AS many FROM py),
pr AS (SELECT query, doc_id, question, lower(question) AS lq, q_tokens, codes, numbers, required_operands, numbers_needed,
  list_filter(many, lambda x, i: list_position(list_transform(many, lambda y: y.dimension), x.dimension) = i) AS dimensions,
  regexp_matches(nq, '{"|".join(Q.NUMERIC_WORDS)}') OR len(numbers) > 0 AS is_numeric, len(codes) > 0 OR regexp_matches(nq, '{"|".join(Q.TABLE_WORDS)}') AS is_code_or_table,
  len(list_intersect(q_tokens, {_words(Q.METADATA_TERMS)})) > 0 AND regexp_matches(nq, '{"|".join(Q.METADATA_WORDS)}') AS is_metadata,
  len(list_intersect(q_tokens, {_words(Q.COMPUTE_TERMS)})) > 0 OR regexp_matches(nq, '{"|".join(Q.COMPUTE_WORDS)}') AS is_computation FROM pz)""".replace("\\\\", "\\")


@query(f"""WITH {_PROFILE} SELECT query, q_tokens, codes, numbers, required_operands, numbers_needed, list_transform(dimensions, lambda d: d.dimension) AS dimensions,
  is_numeric, is_code_or_table, is_metadata, is_computation FROM pr""")
def question_profile(spark, sf):
    return Q.profile(B.questions(spark, sf)).withColumn("dimensions", F.transform("dimensions", lambda d: d["dimension"])).drop("question", "doc_id")


def _guarded(spark, sf):
    p = Q.profile(B.questions(spark, sf))
    c = kept(Q.score_candidates(p, B.artifacts(spark, sf, B.asked_pages(spark, sf)), ["doc_id"]), "candidates")
    return p, c, *Q.decide(c, p, "query", contexts=B.contexts(spark, sf))


@query(f"""WITH {_PROFILE}, f AS (SELECT *, len(codes) > 0 AS c, is_computation AND len(required_operands) > 0 AS k, regexp_matches(lq, '{"|".join(Q.VISUAL_WORDS)}') AS v, regexp_matches(lq, '{"|".join(Q.LOOKUP_WORDS)}') AS l FROM pr),
g AS (SELECT *, (is_numeric OR is_code_or_table) AND NOT c AND NOT k AS n FROM f)
SELECT query, list_filter([CASE WHEN c THEN 'exact_code_lookup' END, CASE WHEN k THEN 'numeric_computation' END, CASE WHEN n THEN 'table_numeric_lookup' END, CASE WHEN v THEN 'figure_caption_grounding' END,
  CASE WHEN l AND NOT c AND NOT k AND NOT n AND NOT v THEN 'key_value_lookup' END, CASE WHEN NOT c AND NOT k AND NOT n AND NOT v AND NOT l THEN 'text_span_grounding' END], lambda x: x IS NOT NULL) AS skills FROM g""")
def skill_activation(spark, sf):
    return Q.skills(Q.profile(B.questions(spark, sf))).select("query", "skills")


@query("SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, round(min(CAST(n_chars AS DOUBLE)), 6) AS low, round(max(CAST(n_chars AS DOUBLE)), 6) AS high FROM documents GROUP BY source")
def number_stats(spark, sf):
    return M.number_stats(B.table(spark, sf, "documents"), ["source"], "n_chars")


@query("""WITH c AS (SELECT event_type, user_id, count(*) AS c FROM events GROUP BY ALL) SELECT event_type, CAST(sum(c) AS BIGINT) AS total, round(sum(c) * sum(c) / sum(CAST(c AS DOUBLE) * c), 6) AS effective_number,
  round(max(c) / sum(c), 6) AS top_share FROM c GROUP BY event_type""")
def concentration_hhi(spark, sf):
    return M.concentration(B.table(spark, sf, "events"), ["event_type"], "user_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def top_counts(spark, sf):
    return M.top_counts(B.table(spark, sf, "events"), "user_id", 10)


@query("""WITH a AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents),
b AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM a WHERE r <= 4) SELECT doc_id, source, n_chars, CAST(position AS INT) AS position FROM b WHERE position <= 30""")
def capped_selection_doc(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return K.capped(d, [F.desc("n_chars"), F.asc("doc_id")], [(["source"], 4)], 30)


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r2 FROM a WHERE r <= 1),
c AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM b WHERE r2 <= 2) SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, CAST(position AS INT) AS position FROM c WHERE position <= 100""")
def capped_selection_doc_page(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return K.capped(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], [(["o_custkey", "o_orderpriority"], 1), (["o_custkey"], 2)], 100)


@query("""WITH f AS (SELECT o_custkey, min((o_orderdate, o_orderkey)) AS first FROM orders GROUP BY 1), d AS (SELECT o_custkey FROM f ORDER BY first, o_custkey LIMIT 12),
a AS (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_custkey IN (SELECT * FROM d)),
b AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM a WHERE r <= 2) SELECT o_orderkey, o_custkey, CAST(position AS INT) AS position FROM b WHERE position <= 20""")
def capped_selection_crossdoc(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    return K.capped(K.admitted(o, "o_custkey", order, 12), order, [(["o_custkey"], 2)], 20).drop("o_orderdate")


@query("""SELECT doc_id, source, n_chars, 'base' AS origin FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 20 < 3) UNION ALL
SELECT doc_id, source, n_chars + 1, 'delta' FROM documents WHERE doc_id % 20 < 3""")
def page_replacing_merge(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    delta = d.filter(F.pmod("doc_id", F.lit(20)) < 3).select("doc_id", "source", (F.col("n_chars") + 1).alias("n_chars"), F.lit("delta").alias("origin"))
    return J.replace_groups(d.withColumn("origin", F.lit("base")), delta, ["source"])


@query("""WITH u AS (SELECT doc_id, lang, source, md5(text) AS h, 0 AS part FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang, source, md5(text), 1 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, h ORDER BY part, doc_id) AS n FROM u) SELECT doc_id, lang, source, h FROM r WHERE n = 1""")
def union_distinct_first(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "lang", "source", F.md5("text").alias("h"))
    return J.union_first([d.filter("lang = 'en'"), d], ["lang", "h"], [F.col("doc_id")])


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def upsert_last_write(spark, sf):
    e = B.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    return J.upsert_last(e, ["user_id", "event_type"], "at").drop("at")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclusion_anti(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", "source").join(B.table(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT source, count(*) FILTER (d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS kept, count(*) FILTER (d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) AS rejected FROM documents d GROUP BY source")
def same_record_semi(spark, sf):
    good = B.table(spark, sf, "labels").filter("quality = 1").select("doc_id", F.lit(True).alias("good"))
    j = B.table(spark, sf, "documents").select("doc_id", "source").join(good, "doc_id", "left")
    return j.groupBy("source").agg(F.count_if(F.col("good")).alias("kept"), F.count_if(F.col("good").isNull()).alias("rejected"))


@query("""WITH l AS (SELECT conv_id, turn, conv_id % 7 AS k, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id, turn) AS n FROM conversations),
r AS (SELECT doc_id, quality, doc_id % 7 AS k, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) AS g, count(*) OVER (PARTITION BY doc_id % 7) AS top FROM labels)
SELECT l.k, conv_id, turn, doc_id, quality FROM l LEFT JOIN r ON l.k = r.k AND r.g = least(l.n, r.top)""")
def kth_gold(spark, sf):
    c = B.table(spark, sf, "conversations").select("conv_id", "turn", F.pmod("conv_id", F.lit(7)).alias("k"))
    g = B.table(spark, sf, "labels").select("doc_id", "quality", F.pmod("doc_id", F.lit(7)).alias("k"))
    return J.kth_match(c, g, ["k"], ["conv_id", "turn"], ["doc_id"])


@query("""SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'assistant' AND turn >= 3) GROUP BY conv_id""")
def resume_pending(spark, sf):
    c = B.table(spark, sf, "conversations")
    done = c.filter("role = 'assistant' AND turn >= 3").select("conv_id", F.col("text").alias("answer"))
    return J.pending(c.groupBy("conv_id").agg(F.max("turn").alias("last_turn")), done, ["conv_id"], "answer")


@query("""WITH a AS (SELECT DISTINCT doc_id FROM labels), b AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 = 0)
SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NULL) AS only_a, count(*) FILTER (a.doc_id IS NULL) AS only_b, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS both, count(*) AS either
FROM a FULL JOIN b USING (doc_id)""".replace("a.doc_id IS NULL) AS only_b", "a.doc_id IS NULL AND b.doc_id IS NOT NULL) AS only_b"))
def attribution_overlap(spark, sf):
    return J.attribution(B.table(spark, sf, "labels"), B.table(spark, sf, "documents").filter("doc_id % 3 = 0"), ["doc_id"])


@query("""SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'kept_right' WHEN quality = 0 AND toxic = 1 THEN 'kept_wrong' WHEN toxic = 0 THEN 'changed_to_right' ELSE 'changed_to_wrong' END AS outcome, count(*) AS n FROM labels GROUP BY 1""")
def paired_outcomes(spark, sf):
    lab = B.table(spark, sf, "labels")
    return lab.select(J.outcome(F.col("quality") == 1, F.col("toxic") == 0).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT item_id, 'On page ' || (item_id % 9 + 1) || ' and pages 12 see code AR0' || (item_id % 5) AS text, [CAST(item_id % 9 + 1 AS INT), 12] AS pages, ['AR0' || (item_id % 5)] AS codes, CAST(item_id % 9 AS INT) AS first_page FROM benchmark""")
def explicit_page_refs(spark, sf):
    i = F.col("item_id")
    t = F.concat(F.lit("On page "), (F.pmod(i, F.lit(9)) + 1).cast("string"), F.lit(" and pages 12 see code AR0"), F.pmod(i, F.lit(5)).cast("string"))
    d = B.table(spark, sf, "benchmark").select("item_id", t.alias("text"))
    pages = T.page_references(F.col("text"))
    return d.select("item_id", "text", pages.alias("pages"), T.exact_codes(F.col("text")).alias("codes"), (F.get(pages, 0) - 1).alias("first_page"))
