"""Queries on selections for prompting."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import artifacts as A
from folioflow.operators import pages as P
from folioflow.operators import ranking as K
from folioflow.operators import selection as S
from folioflow.plans import bindings as B
from folioflow.plans import documents as D

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""WITH {B.BRANCHES}, t AS (SELECT * FROM br WHERE rank < 4), m AS (SELECT DISTINCT query, page_index FROM br WHERE page_index % 2 = 0)
SELECT t.query, t.branch, t.rank, t.page_index, length(d.text) AS n_chars, sha256(d.text) AS text_hash FROM t JOIN m ON t.query = m.query AND t.page_index = m.page_index LEFT JOIN documents d ON d.doc_id = t.page_index""")
def page_binding(spark, sf):
    b = B.branches(spark, sf)
    pages = B.table(spark, sf, "documents").select(F.col("doc_id").alias("page_index"), "text")
    got = S.bind_pages(b.select("query", "branch", "rank", "page_index"), pages, 4, b.filter(F.pmod("page_index", F.lit(2)) == 0))
    return got.select("query", "branch", "rank", "page_index", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


@query(f"""WITH {B.BRANCHES}, g AS (SELECT query, list(page_index ORDER BY rank) AS pages, list(score ORDER BY rank) AS scores FROM br WHERE branch = 'text' GROUP BY query)
SELECT query, pages[1:6] AS pages, list_transform(range(1, 7), lambda i: round(CASE WHEN i <= 3 THEN scores[i] ELSE 1.0 / i END, 6)) AS scores FROM g""")
def truncated_scores(spark, sf):
    """Six pages; only the first three keep their scores."""
    at = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", "page_index", "score"))), lambda x: x[c])
    g = B.text_branch(spark, sf).groupBy("query").agg(at("page_index").alias("pages"), at("score").alias("scores"))
    return g.select("query", F.slice("pages", 1, 6).alias("pages"), F.transform(S.default_scores(F.col("pages"), F.slice("scores", 1, 3), 6), lambda x: F.round(x, 6)).alias("scores"))


@query(f"""WITH {B.BLOCKS}, {B.QUESTIONS}, t AS (SELECT query, doc_id, list_distinct({B.sql_tokens("question")}) AS qt, regexp_extract_all(question, '\\d+') AS nums FROM qs),
p AS (SELECT 'd' || (doc_id // 4) AS doc_id, CAST(doc_id % 4 AS INT) AS page_index, list_distinct({B.sql_tokens("text")}) AS pt, text FROM documents),
j AS (SELECT query, page_index, len(list_intersect(qt, pt)) AS n_overlap, len(list_filter(nums, lambda n: contains(text, n))) AS n_numbers FROM t JOIN p USING (doc_id))
SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY n_overlap DESC, n_numbers DESC, page_index) AS INT) AS position FROM j""".replace("\\\\d", "\\d"))
def page_context_ranking(spark, sf):
    q = B.questions(spark, sf).select("query", "doc_id", T.tokens(F.col("question")).alias("qt"), F.regexp_extract_all("question", F.lit(r"\d+"), F.lit(0)).alias("nums"))
    p = B.doc_pages(spark, sf).select("doc_id", "page_index", T.tokens(F.col("text")).alias("pt"), "text")
    j = q.join(p, "doc_id").select("query", "page_index", F.size(F.array_intersect("qt", "pt")).alias("n_overlap"), F.size(F.filter("nums", lambda n: F.col("text").contains(n))).alias("n_numbers"))
    return S.context_rank(j, "query")


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority, list_position(['1-URGENT', '3-MEDIUM', '5-LOW'], o_orderpriority) AS p FROM orders)
SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (ORDER BY p, o_orderkey) AS INT) AS position FROM o WHERE p > 0 ORDER BY p, o_orderkey LIMIT 40""")
def bucket_ordered_take(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return S.bucket_take(o, "o_orderpriority", ["1-URGENT", "3-MEDIUM", "5-LOW"], 40, "o_orderkey")


@query(D.ORACLE["page_lines_offsets"].replace("SELECT doc_id, CAST(row_number()", ", l AS (SELECT doc_id, CAST(row_number()", 1).replace("FROM b WHERE line <> ''", """FROM b WHERE line <> ''),
n AS (SELECT *, max(CAST(regexp_matches(line, '\\d') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l),
f AS (SELECT doc_id, line, min(line_index) AS line_index FROM n WHERE near = 1 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS k FROM f)
SELECT doc_id, line_index, line FROM r WHERE k <= 18""".replace("\\\\", "\\")))
def numeric_snippets(spark, sf):
    return S.snippets(P.lines(B.documents(spark, sf), ["doc_id"]), ["doc_id"])


@query("""WITH t AS (SELECT DISTINCT source, doc_id // 20 % 7 + 1 AS u FROM documents WHERE doc_id % 3 = 0), n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
f AS (SELECT source, i, row_number() OVER (PARTITION BY source ORDER BY i) AS n FROM (SELECT DISTINCT source FROM documents), range(1, (SELECT count(*) + 20 FROM documents)) r(i) WHERE (source, i) NOT IN (SELECT (source, u) FROM t))
SELECT n.doc_id, n.source, printf('art_%03d', f.i) AS new_id FROM n JOIN f ON n.source = f.source AND n.n = f.n""")
def fresh_artifact_ids(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "source")
    used = d.filter("doc_id % 3 = 0").select("source", F.format_string("art_%03d", (F.pmod(F.floor(F.col("doc_id") / 20), F.lit(7)) + 1).cast("int")).alias("id"))
    return S.fresh_ids(d, used, "art", ["source"], [F.col("doc_id")])


@query(f"""WITH {B.BRANCHES}, {D._REASON}, s AS (SELECT query, page_index, score FROM br WHERE branch = 'image' AND rank < 4),
nr AS (SELECT DISTINCT page_index, unnest([page_index - 1, page_index + 1]) AS other FROM s), pg AS (SELECT DISTINCT number AS page_index, doc_id, page_index AS place FROM art),
lk AS (SELECT a.page_index, b.page_index AS other FROM pg a JOIN pg b ON a.doc_id = b.doc_id AND abs(a.place - b.place) >= 2),
su AS (SELECT DISTINCT query, br.page_index FROM br JOIN elig ON elig.number = br.page_index AND reason = 'eligible'),
wanted AS (SELECT query, page_index FROM s UNION SELECT query, other FROM s JOIN nr USING (page_index) UNION SELECT query, other FROM s JOIN lk USING (page_index) UNION SELECT query, page_index FROM su),
{B.sql_artifact_scores("SELECT * FROM wanted")}, ow AS (SELECT query, page_index, CASE WHEN max(raw) OVER (PARTITION BY query) > 0 THEN round(raw / max(raw) OVER (PARTITION BY query), 6) ELSE 0.0 END AS own FROM asc_),
al AS (SELECT query, page_index, score FROM s UNION ALL SELECT s.query, other, 0.85 * score + 0.15 * coalesce(own, 0) FROM s JOIN nr USING (page_index) LEFT JOIN ow ON ow.query = s.query AND ow.page_index = other
  UNION ALL SELECT s.query, other, 0.80 * score + 0.20 * coalesce(own, 0) FROM s JOIN lk USING (page_index) LEFT JOIN ow ON ow.query = s.query AND ow.page_index = other
  UNION ALL SELECT query, page_index, 0.5 * coalesce(score, 0) + 0.5 * coalesce(own, 0) FROM su LEFT JOIN s USING (query, page_index) LEFT JOIN ow USING (query, page_index)),
b AS (SELECT query, page_index, round(max(score), 4) AS score FROM al GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, page_index) AS position FROM b)
SELECT query, page_index, score, CAST(position AS INT) AS position FROM r WHERE position <= 5""")
def graph_selected_pages(spark, sf):
    """Seeds, the pages next to them, further pages of their documents, and pages with eligible artifacts."""
    b, p = B.branches(spark, sf), F.col("page_index")
    s = B.image_branch(spark, sf).filter("rank < 4").select("query", "page_index", "score")
    asked = s.select("page_index").distinct()
    near = asked.select("page_index", F.explode(F.array(p - 1, p + 1)).alias("other"))
    pages = B.doc_pages(spark, sf).filter(F.trim("text") != "").select(F.col("number").alias("page_index"), "doc_id", F.col("page_index").alias("place"))
    other = pages.select(F.col("page_index").alias("other"), "doc_id", F.col("place").alias("_place"))
    linked = pages.join(asked, "page_index", "left_semi").join(other, "doc_id").filter(F.abs(F.col("place") - F.col("_place")) >= 2).select("page_index", "other")
    found = b.select("query", "page_index").distinct()
    reach = lambda steps: s.join(steps, "page_index").select("query", F.col("other").alias("page_index"))
    asked_pages = s.select("query", "page_index").union(reach(near)).union(reach(linked)).union(found).distinct()
    # only eligible artifacts score, so the found pages with a score are those that have one
    own = K.artifact_page_scores(B.artifact_scores(spark, sf, asked_pages), ["query"]).withColumnRenamed("artifact_score", "score")
    return S.graph_pages(s, near, linked, found, own, 5, only_scored=True)


@query(f"""WITH {D._REASON}, p AS (SELECT doc_id, count(*) AS n, count(*) FILTER (reason <> 'eligible') AS n_ineligible, count(*) - count(DISTINCT (artifact_type, content)) AS n_duplicate, count(*) FILTER (weak) AS n_weak FROM elig GROUP BY doc_id)
SELECT *, list_filter([CASE WHEN n > 12 THEN 'budget_exceeded' END, CASE WHEN n_ineligible > 0 THEN 'ineligible_present' END, CASE WHEN n_duplicate > 0 THEN 'duplicates' END, CASE WHEN n_weak > 0 THEN 'weak_quality' END], lambda x: x IS NOT NULL) AS flags FROM p""")
def noise_audit(spark, sf):
    e = A.eligibility(B.classified(spark, sf))
    p = e.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("reason") != "eligible").alias("n_ineligible"), (F.count("*") - F.count_distinct("artifact_type", "content")).alias("n_duplicate"), F.count_if("weak").alias("n_weak")
    )
    return S.noise_flags(p, 12)


@query(f"""WITH {D._REASON}, q AS (SELECT item_id AS query, 'd' || item_id AS doc_id FROM benchmark), a AS (SELECT doc_id, bool_or(artifact_type = 'numeric_fact') AS art, bool_or(reason = 'eligible' AND artifact_type = 'numeric_fact') AS ok FROM elig GROUP BY doc_id),
b AS (SELECT query, CASE WHEN query % 5 = 0 THEN 'page_not_retrieved' WHEN NOT coalesce(art, false) THEN 'no_artifact_on_page' WHEN NOT coalesce(ok, false) THEN 'artifact_not_eligible' WHEN query % 3 = 0 THEN 'not_answered' ELSE 'ok' END AS bucket FROM q LEFT JOIN a USING (doc_id))
SELECT bucket, count(*) AS n FROM b GROUP BY bucket""")
def failure_buckets(spark, sf):
    e = A.eligibility(B.classified(spark, sf))
    fact = F.col("artifact_type") == "numeric_fact"
    a = e.groupBy("doc_id").agg(F.max(fact).alias("art"), F.max(fact & (F.col("reason") == "eligible")).alias("ok"))
    q = B.questions(spark, sf).select("query", "doc_id").join(a, "doc_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    b = S.failure_bucket(F.pmod("query", F.lit(5)) != 0, yes("art"), yes("ok"), F.pmod("query", F.lit(3)) != 0)
    return q.select(b.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"""WITH {B.ARTIFACTS} SELECT artifact_id, sha256(artifact_type || chr(10) || modality || CASE WHEN content <> '' THEN chr(10) || content ELSE '' END || chr(10) || '{{"column":' || coalesce('"' || column_label || '"', 'null') || ',"row":' || coalesce('"' || row_label || '"', 'null') || '}}'
  || chr(10) || source_id) AS text_hash FROM art""")
def artifact_retrieval_texts(spark, sf):
    normalized = T.canonical_json(F.create_map(F.lit("row"), F.col("row_label"), F.lit("column"), F.col("column_label")))
    c = F.col
    t = S.retrieval_text(c("artifact_type"), c("modality"), c("content"), normalized, F.array("source_id"))
    return B.artifacts(spark, sf).select("artifact_id", F.sha2(t, 256).alias("text_hash"))


@query(f"""WITH {D._REASON}, x AS (SELECT unnest(CASE WHEN artifact_type IN ('table', 'table_cell') THEN ['table', 'numeric'] WHEN modality = 'image' THEN ['figure'] ELSE ['text'] END) AS type, source_anchored AS anchored, element_locatable AS locatable, reason = 'eligible' AS eligible FROM elig)
SELECT type, count(*) AS n, count(*) FILTER (anchored) AS anchored, count(*) FILTER (locatable) AS locatable, count(*) FILTER (eligible) AS eligible FROM x GROUP BY type""")
def health_by_type(spark, sf):
    e = A.eligibility(B.classified(spark, sf))
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    types = F.when(F.col("artifact_type").isin("table", "table_cell"), lit("table", "numeric")).when(F.col("modality") == "image", lit("figure")).otherwise(lit("text"))
    rows = e.select(types.alias("types"), F.col("source_anchored").alias("anchored"), F.col("element_locatable").alias("locatable"), (F.col("reason") == "eligible").alias("eligible"))
    return S.health(rows, "types", ["anchored", "locatable", "eligible"])


@query(f"""WITH {B.ARTIFACTS}, s AS (SELECT doc_id, string_agg(content, ' ' ORDER BY content) AS al FROM art WHERE artifact_type IN ('table', 'numeric_fact', 'caption') GROUP BY doc_id),
m AS (SELECT doc_id, len(list_distinct(regexp_extract_all(al, '\\d+(?:\\.\\d+)?'))) AS n_numbers, list_filter(['the', 'license', 'mock'], lambda d: NOT contains(lower(al), d)) AS missing FROM s)
SELECT doc_id, n_numbers, missing, len(missing) = 0 AND n_numbers >= 1 AS sufficient FROM m""".replace("\\\\", "\\"))
def support_audit(spark, sf):
    a = B.artifacts(spark, sf).filter(F.col("artifact_type").isin("table", "numeric_fact", "caption"))
    rows = a.withColumn("wanted", F.array(F.lit("the"), F.lit("license"), F.lit("mock"))).withColumn("needed", F.lit(1))
    return S.support(rows, "doc_id", F.col("wanted"), "content", F.col("needed"))
