"""Queries on question records, pages to compile and their preflight."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import records as N
from folioflow.plans import bindings as B

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _asked(spark, sf):
    """Questions that also name pages, colours and objects, by the item's number."""
    i = F.col("query")
    more = F.array(*map(F.lit, [" on page 2 and Pages 9?", " in the red handwriting", " signature words on page 0", " in the chart, how many", " of the table image", ""]))
    q = B.questions(spark, sf)
    return q.withColumn("question", F.concat("question", F.element_at(more, (F.pmod(i, F.lit(6)) + 1).cast("int"))))


_ASKED = f"""{B.QUESTIONS}, qa AS (SELECT query, doc_id, question || [' on page 2 and Pages 9?', ' in the red handwriting', ' signature words on page 0', ' in the chart, how many', ' of the table image', ''][query % 6 + 1] AS question FROM qs)"""
_REFS = r"""list_filter(list_transform(regexp_extract_all(question, '(?i)\bpages?\s+\d+\b'), lambda s: {'surface_text': s, 'page_number': CAST(regexp_extract(s, '(\d+)$', 1) AS INT), 'page_index': CAST(regexp_extract(s, '(\d+)$', 1) AS INT) - 1}), lambda r: r.page_number >= 1)"""


def _sql_any(words) -> str:
    return f"regexp_matches(lower(question), '{'|'.join(words)}')"


@query(rf"""WITH {_ASKED} SELECT query, list_transform({_REFS}, lambda r: r.surface_text) AS surfaces, list_transform({_REFS}, lambda r: r.page_index) AS pages,
  list_filter([{", ".join(rf"CASE WHEN regexp_matches(lower(question), '\b{c}\b') THEN '{c}' END" for c in N.COLORS)}, CASE WHEN regexp_matches(lower(question), '\b(handwritten|handwriting)\b') THEN 'handwritten' END], lambda x: x IS NOT NULL) AS attributes,
  CASE WHEN regexp_matches(lower(question), '\bwords?\b') THEN 'words' WHEN regexp_matches(lower(question), '\bsignature\b') THEN 'signature' WHEN regexp_matches(lower(question), '\bstamp\b') THEN 'stamp' ELSE 'unspecified' END AS object_type,
  CASE WHEN {_sql_any(N.VISUAL_WORDS)} THEN 'visual' ELSE 'text' END AS modality_requirement FROM qa""")
def question_constraints(spark, sf):
    c = _asked(spark, sf).select("query", N.constraints(F.col("question")).alias("c"))
    at = lambda col, f: F.transform(col, lambda x: x[f])
    return c.select(
        "query", at("c.page_references", "surface_text").alias("surfaces"), at("c.page_references", "page_index").alias("pages"), at("c.visual_attributes", "attribute_value").alias("attributes"), "c.target_object.*"
    )


_CHART, _TABLE, _FIGURE, _OTHER = (_sql_any(x) for x in (N.CHART_TERMS, N.TABLE_TERMS, N.FIGURE_TERMS, N.OTHER_VISUAL_TERMS))
_NUMERIC = "regexp_matches(lower(question), '" + "|".join(rf"\b{t}\b" for t in N.NUMERIC_TERMS) + "')"


@query(f"""WITH {_ASKED}, m AS (SELECT query, query % 2 = 0 AS has_image, {_CHART} AS mentions_chart, {_TABLE} AS mentions_table, {_FIGURE} AS mentions_figure, {_NUMERIC} AS mentions_numeric, {_OTHER} AS o FROM qa),
v AS (SELECT *, mentions_chart OR mentions_table OR mentions_figure OR o AS requires_visual FROM m),
t AS (SELECT *, list_concat(CASE WHEN requires_visual AND has_image THEN ['visual_observation'] ELSE [] END, CASE WHEN mentions_chart THEN ['figure', 'numeric_fact'] ELSE [] END, CASE WHEN mentions_table THEN ['table', 'numeric_fact'] ELSE [] END,
  CASE WHEN mentions_figure THEN ['figure', 'caption'] ELSE [] END, CASE WHEN mentions_numeric THEN ['numeric_fact'] ELSE [] END) AS l FROM v)
SELECT query, requires_visual, mentions_chart, mentions_table, mentions_figure, mentions_numeric, list_filter(l, lambda x, i: list_position(l, x) = i) AS recommended_types FROM t""")
def modality_diagnosis(spark, sf):
    q = _asked(spark, sf)
    return q.select("query", N.modality(F.col("question"), F.pmod("query", F.lit(2)) == 0).alias("m")).select("query", "m.*")


def _ranked(spark, sf):
    """Each question's document's pages as two branches that list one page twice."""
    q, p = _asked(spark, sf).select("query", "doc_id"), B.doc_pages(spark, sf).select("doc_id", "page_index")
    j = q.join(p, "doc_id")
    text = j.select("query", F.lit("text").alias("branch"), F.col("page_index").alias("rank"), F.pmod(F.col("page_index") * 2 + F.col("query"), F.lit(4)).cast("int").alias("page_index"))
    image = j.filter("page_index < 2").select("query", F.lit("image").alias("branch"), F.col("page_index").alias("rank"), F.pmod(F.col("page_index") + F.col("query"), F.lit(3)).cast("int").alias("page_index"))
    return text.unionByName(image).withColumn("score", F.round(1.0 / (F.col("rank") + 1), 6))


_RANKED = """rk AS (SELECT query, 'text' AS branch, place AS rank, CAST((place * 2 + query) % 4 AS INT) AS page_index FROM qa JOIN (SELECT 'd' || (doc_id // 4) AS doc_id, CAST(doc_id % 4 AS INT) AS place FROM documents) USING (doc_id)
  UNION ALL SELECT query, 'image', place, CAST((place + query) % 3 AS INT) FROM qa JOIN (SELECT 'd' || (doc_id // 4) AS doc_id, CAST(doc_id % 4 AS INT) AS place FROM documents) USING (doc_id) WHERE place < 2),
ct AS (SELECT 'd' || (doc_id // 4) AS doc_id, CAST(max(doc_id % 4) + 1 AS INT) AS n_pages FROM documents GROUP BY 1)"""


def _normalised(spark, sf):
    counts = B.doc_pages(spark, sf).groupBy("doc_id").agg((F.max("page_index") + 1).alias("n_pages"))
    return N.normalised(_asked(spark, sf), _ranked(spark, sf), counts)


_POOL = f"""{_ASKED}, {_RANKED}, ex AS (SELECT qa.*, n_pages, list_sort(list_distinct(list_transform({_REFS}, lambda r: r.page_index))) AS raw, {_REFS} AS refs FROM qa LEFT JOIN ct USING (doc_id)),
vx AS (SELECT *, list_filter(raw, lambda p: n_pages IS NULL OR p < n_pages) AS valid FROM ex),
rp AS (SELECT query, list_sort(list(DISTINCT page_index)) AS retrieval_pages FROM rk GROUP BY query),
pool AS (SELECT vx.*, coalesce(retrieval_pages, []) AS retrieval_pages, list_sort(list_distinct(list_filter(list_concat(coalesce(retrieval_pages, []), valid), lambda p: NOT list_contains(list_filter(raw, lambda x: NOT list_contains(valid, x)), p)))) AS required FROM vx LEFT JOIN rp USING (query))"""


@query(rf"""WITH {_POOL}, u AS (SELECT query, branch, page_index, min(rank) AS rank, list_sort(list(rank))[2:] AS dup FROM rk GROUP BY ALL),
l AS (SELECT query, list(page_index ORDER BY rank) FILTER (branch = 'text') AS text_pages, list(page_index ORDER BY rank) FILTER (branch = 'image') AS image_pages,
  CAST(coalesce(sum(len(dup)), 0) AS INT) AS n_duplicate_ranks FROM u GROUP BY query)
SELECT query, regexp_replace(doc_id, '[^A-Za-z0-9]+', '_', 'g') || '__' || substr(sha1(doc_id || '::' || question), 1, 10) AS record_id, doc_id, question, text_pages, image_pages, n_duplicate_ranks, retrieval_pages, raw AS explicit_pages_raw, valid AS explicit_pages,
  list_filter(raw, lambda p: NOT list_contains(valid, p)) AS explicit_pages_invalid, required AS required_pages, list_filter(valid, lambda p: NOT list_contains(retrieval_pages, p)) AS missed_explicit_pages,
  list_transform(list_filter(refs, lambda r: list_contains(valid, r.page_index)), lambda r: r.page_index || ' ' || r.surface_text) AS reasons FROM pool LEFT JOIN l USING (query)""")
def normalised_records(spark, sf):
    """Nested records, shown flat."""
    n = _normalised(spark, sf)
    at = lambda c: F.transform(c, lambda p: p["page_index"])
    every = F.concat(F.coalesce("retrieval.text", F.array()), F.coalesce("retrieval.image", F.array()))
    return n.select(
        "query",
        "record_id",
        "document.doc_id",
        F.col("question.text").alias("question"),
        at("retrieval.text").alias("text_pages"),
        at("retrieval.image").alias("image_pages"),
        F.size(F.flatten(F.transform(every, lambda p: p["duplicate_ranks"]))).alias("n_duplicate_ranks"),
        *[f"candidate_pool.{c}" for c in ("retrieval_pages", "explicit_pages_raw", "explicit_pages", "explicit_pages_invalid", "required_pages", "missed_explicit_pages")],
        F.transform("compilation_plan.reasons", lambda x: F.concat_ws(" ", x["page_index"].cast("string"), x["reason_text"])).alias("reasons"),
    )


def _sources(spark, sf):
    """(doc_id, page_index, has_text, has_image, page_image_path, layout_block_ids) of every page; some lack text or image."""
    n = F.col("number")
    p = B.doc_pages(spark, sf)
    p = p.withColumn("page_text", F.when(F.pmod(n, F.lit(7)) != 0, F.col("text")))
    p = p.withColumn("page_image_path", F.when(F.pmod(n, F.lit(3)) != 0, F.concat(F.lit("img/"), n.cast("string"))))
    blocks = F.when(F.length(F.trim(F.coalesce("page_text", F.lit("")))) > 0, F.array(F.lit("p_text_000"))).otherwise(F.array().cast("array<string>"))
    return p.select("number", "doc_id", "page_index", "page_text", "page_image_path", F.col("page_text").isNotNull().alias("has_text"), F.col("page_image_path").isNotNull().alias("has_image"), blocks.alias("layout_block_ids"))


_SOURCES = """sr AS (SELECT doc_id AS number, 'd' || (doc_id // 4) AS doc_id, CAST(doc_id % 4 AS INT) AS page_index, CASE WHEN doc_id % 7 <> 0 THEN text END AS page_text, CASE WHEN doc_id % 3 <> 0 THEN 'img/' || doc_id END AS page_image_path FROM documents),
so AS (SELECT *, page_text IS NOT NULL AS has_text, page_image_path IS NOT NULL AS has_image, trim(coalesce(page_text, '')) <> '' AS blocks FROM sr)"""


@query(f"""WITH {_ASKED}, {_RANKED}, {_SOURCES}, ro AS (SELECT query, page_index, list_reverse(list_sort(list(DISTINCT branch))) AS routes FROM rk WHERE query % 5 <> 4 GROUP BY ALL),
rs AS (SELECT query, page_index, routes, coalesce(has_text, false) OR coalesce(has_image, false) AS there FROM ro JOIN qa USING (query) LEFT JOIN so USING (doc_id, page_index)),
g AS (SELECT query, count(*) AS n_pages, bool_or(there) AS there, list(page_index || ':' || array_to_string(routes, '+') ORDER BY page_index) AS routes FROM rs GROUP BY query)
SELECT query, coalesce(there, false) AS passed, CASE WHEN n_pages IS NULL THEN ['no_candidate_page_routes'] WHEN NOT there THEN ['missing_all_candidate_sources'] ELSE [] END AS blocking, coalesce(routes, []) AS routes FROM qa LEFT JOIN g USING (query)""")
def record_preflight(spark, sf):
    """Routes of a record's candidate pages, and whether any has a source; each fifth record has no candidates."""
    from folioflow.operators.pages import routes

    r = routes(_ranked(spark, sf).filter("query % 5 <> 4"), ["query"])
    out = N.preflight(_asked(spark, sf), r, _sources(spark, sf))
    pages = F.transform("stage2.candidate_page_routes", lambda x: F.concat(x["page_index"].cast("string"), F.lit(":"), F.array_join(x["routes"], "+")))
    return out.select("query", "stage2.preflight.passed", F.col("stage2.preflight.blocking_reasons").alias("blocking"), pages.alias("routes"))


def _prepared(spark, sf):
    """Every page with the routes of its document's first question; documents that nobody asks have none known."""
    n = F.col("number")
    route = F.when(F.pmod(n, F.lit(5)) == 0, F.array(F.lit("text"))).when(F.pmod(n, F.lit(5)) == 1, F.array(F.lit("image"))).when(F.pmod(n, F.lit(5)) == 2, F.array().cast("array<string>"))
    listed = F.array(F.struct("page_index", route.alias("routes")))
    s = _sources(spark, sf).withColumn("input_routes", N.routes_of(F.when(route.isNotNull(), listed), F.col("page_index")))
    return N.prepared(s)


_PREPARED = """pp AS (SELECT number, doc_id, page_index, CASE WHEN number % 5 IN (0, 3, 4) THEN page_text END AS page_text, CASE WHEN number % 5 IN (1, 3, 4) THEN page_image_path END AS page_image_path FROM so)"""


@query(f"""WITH {_SOURCES}, {_PREPARED} SELECT number, printf('%s#p%03d', doc_id, page_index) AS page_id, length(page_text) AS n_chars, page_image_path, page_text IS NOT NULL AS has_page_text, page_image_path IS NOT NULL AS has_page_image,
  CASE WHEN trim(coalesce(page_text, '')) = '' AND page_image_path IS NULL THEN 'missing_source_anchors' END AS error FROM pp""")
def page_preparation(spark, sf):
    """What each page's routes admit."""
    return _prepared(spark, sf).select("number", "page_id", F.length("page_text").cast("long").alias("n_chars"), "page_image_path", "has_page_text", "has_page_image", "error")


@query(f"""WITH {_SOURCES} SELECT number, has_image AND blocks AS eligible FROM so""")
def page_source_eligibility(spark, sf):
    return _sources(spark, sf).select("number", N.eligible_source().alias("eligible"))


@query(f"""WITH {_POOL}, {_SOURCES}, {_PREPARED}, t AS (SELECT query, doc_id, coalesce(raw[1], required[1]) AS target, coalesce(raw[1] >= n_pages, false) AS invalid FROM pool),
j AS (SELECT t.*, pp.number IS NOT NULL AS there, page_image_path IS NOT NULL AS img, trim(coalesce(page_text, '')) = '' AND page_image_path IS NULL AS err FROM t LEFT JOIN pp ON pp.doc_id = t.doc_id AND pp.page_index = t.target),
b AS (SELECT *, list_sort(list_filter([CASE WHEN invalid THEN 'explicit_page_out_of_range' END, CASE WHEN NOT invalid AND NOT there THEN 'target_page_not_prepared' END, CASE WHEN NOT invalid AND there AND err THEN 'missing_source_anchors' END,
  CASE WHEN NOT invalid AND there AND NOT img THEN 'missing_full_page_image_anchor' END], lambda x: x IS NOT NULL)) AS blocking FROM j)
SELECT query, doc_id, target, blocking, len(blocking) = 0 AS passed FROM b""")
def single_page_preflight(spark, sf):
    """Whether the first page that a question names, or else its first required page, can be compiled."""
    n = _normalised(spark, sf)
    counts = B.doc_pages(spark, sf).groupBy("doc_id").agg((F.max("page_index") + 1).alias("n_pages"))
    first = F.coalesce(F.get("candidate_pool.explicit_pages_raw", F.lit(0)), F.get("candidate_pool.required_pages", F.lit(0)))
    named = F.get("candidate_pool.explicit_pages_raw", F.lit(0))
    plan = n.select("query", "document.doc_id", first.alias("target"), named.alias("named")).join(counts, "doc_id", "left")
    plan = plan.withColumn("invalid", F.coalesce(F.col("named") >= F.col("n_pages"), F.lit(False))).drop("named", "n_pages")
    return N.page_preflight(plan, _prepared(spark, sf), "target")


@query(f"""WITH {_SOURCES} SELECT number, '{{"document":{{"doc_id":"' || doc_id || '"}},"question":{{' || CASE WHEN number % 2 = 0 THEN '"text":"What is it"' ELSE '' END || '}},"candidate_pool":{{"explicit_pages":['
  || CASE WHEN number % 2 = 0 THEN CAST(page_index AS VARCHAR) ELSE '' END || '],"retrieval_pages":[' || page_index || ']}},"compilation_plan":{{"pages_to_compile":[' || page_index || '],"priority_pages":[' || CASE WHEN number % 2 = 0 THEN CAST(page_index AS VARCHAR) ELSE '' END
  || '],"reason":"' || CASE WHEN number % 2 = 0 THEN 'valid_explicit_page_with_image' ELSE 'document_generic_page_compilation' END || '"}}}}' AS record FROM so""")
def compiler_safe_records(spark, sf):
    """The least record for each page, as JSON: with a question for even pages, document-generic for others."""
    s, even = _sources(spark, sf), F.pmod("number", F.lit(2)) == 0
    reason = F.when(even, "valid_explicit_page_with_image").otherwise("document_generic_page_compilation")
    r = N.compiler_record(F.col("doc_id"), F.col("page_index"), reason, F.when(even, "What is it"))
    return s.select("number", F.to_json(r).alias("record"))


@query("""WITH r AS (SELECT 'd' || (doc_id // 4) AS doc_id, CASE WHEN doc_id // 4 % 3 <> 0 THEN [CAST(doc_id % 5 AS INT), CAST(doc_id % 3 AS INT) - 1] END AS pages, CASE WHEN doc_id % 4 > 1 THEN lang END AS src, doc_id AS o FROM documents),
l AS (SELECT doc_id, list_sort(list_filter(list_distinct(flatten(list(coalesce(pages, [])))), lambda p: p >= 0)) AS pages, min_by(src, o) FILTER (src IS NOT NULL) AS src FROM r GROUP BY doc_id),
al AS (SELECT 'd' || (doc_id // 4) AS doc_id, list_sort(list(CAST(doc_id % 4 AS INT))) AS every FROM documents GROUP BY 1)
SELECT doc_id, CASE WHEN len(pages) > 0 THEN pages ELSE every END AS page_indices, coalesce(src, 'coverage_subset') AS selection_source FROM l JOIN al USING (doc_id)""")
def scope_expansion(spark, sf):
    """The pages that several rows list for a document, or all of its pages."""
    d = B.table(spark, sf, "documents")
    n = F.col("doc_id")
    pages = F.when(F.pmod(F.floor(n / 4), F.lit(3)) != 0, F.array(F.pmod(n, F.lit(5)).cast("int"), (F.pmod(n, F.lit(3)) - 1).cast("int")))
    rows = d.select(F.concat(F.lit("d"), F.floor(n / 4).cast("string")).alias("doc_id"), pages.alias("page_indices"), F.when(F.pmod(n, F.lit(4)) > 1, F.col("lang")).alias("selection_source"), n.alias("input_order"))
    return N.expanded_scope(rows, B.doc_pages(spark, sf).select("doc_id", "page_index"))


@query(f"""WITH {B.BRANCHES}, t AS (SELECT query, page_index, score, rank + 1 AS position FROM br WHERE branch = 'text' AND rank < 4), i AS (SELECT query, page_index, rank + 1 AS position FROM br WHERE branch = 'image' AND rank < 4 AND query % 2 = 0),
a AS (SELECT query, list(page_index ORDER BY position) AS p, list(round(score, 8) ORDER BY position) AS s FROM t GROUP BY query), b AS (SELECT query, list(page_index ORDER BY position) AS p, list(round(1.0 / position, 8) ORDER BY position) AS s FROM i GROUP BY query)
SELECT query, a.p AS "text-top-4", a.s AS "text-top-4_score", coalesce(b.p, a.p) AS "image-top-4", coalesce(b.s, a.s) AS "image-top-4_score" FROM a LEFT JOIN b USING (query)""")
def branch_write_back(spark, sf):
    """The common selection for all branches; even queries have one of their own, without scores, for the image branch."""
    b = B.branches(spark, sf).filter("rank < 4")
    common = b.filter("branch = 'text'").select("query", F.lit(None).cast("string").alias("branch"), (F.col("rank") + 1).alias("position"), "page_index", "score")
    own = b.filter("branch = 'image' AND query % 2 = 0").select("query", F.lit("image-top-4").alias("branch"), (F.col("rank") + 1).alias("position"), "page_index", F.lit(None).cast("double").alias("score"))
    return N.write_back(common.unionByName(own), ["text-top-4", "image-top-4"], 4)


@query(f"""WITH {_ASKED} SELECT query, regexp_replace(doc_id, '[^A-Za-z0-9]+', '_', 'g') || '__' || substr(sha1(doc_id || '::' || question), 1, 10) AS record_id, doc_id, question FROM qa WHERE contains(lower(question), 'chart') ORDER BY query LIMIT 1""")
def record_lookup(spark, sf):
    """The first record whose question holds a string."""
    from folioflow.functions.text import record_id

    r = _asked(spark, sf).withColumn("record_id", record_id(F.col("doc_id"), F.col("doc_id"), F.col("question")))
    return N.find_record(r, "query", record="none", question="Chart")
