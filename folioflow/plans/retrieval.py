"""Queries on retrieval, branches, metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions import scoring
from folioflow.functions import text as T
from folioflow.functions.text import tokens
from folioflow.operators import graph as G
from folioflow.operators import metrics as M
from folioflow.operators import pages as P
from folioflow.operators import ranking as K
from folioflow.operators import retrieval as R
from folioflow.plans import bindings as B
from folioflow.plans import documents as D
from folioflow.sources.sinks import kept

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {B.POOLS} SELECT query, item, score, CAST(rank AS INT) AS rank FROM ord WHERE rank <= 5")
def bm25_topk(spark, sf):
    return R.bm25_topk(B.asked(spark, sf), B.items(spark, sf), 5)


@query(f"WITH {B.POOLS} SELECT pool, n, round(mean_length, 6) AS mean_length, t.terms FROM st JOIN (SELECT pool, count(*) AS terms FROM df GROUP BY pool) t USING (pool)")
def bm25_pool_stats(spark, sf):
    it = B.items(spark, sf)
    terms = R.document_frequency(it).groupBy("pool").agg(F.count("*").alias("terms"))
    return R.pool_stats(it).join(terms, "pool").select("pool", "n", F.round("mean_length", 6).alias("mean_length"), "terms")


_HYBRID = f"""WITH {B.CLASSIFIED}, {D._EDGES[len(B.ARTIFACTS) + 1 :]}, {D._DEGREE}, {B.QUESTIONS},
c AS (SELECT artifact_id, doc_id, {B.sql_tokens("content || ' ' || artifact_type || ' ' || modality || ' ' || coalesce(row_label, '') || ' ' || coalesce(column_label, '')")} AS terms,
  {B.sql_tokens("artifact_type || ' ' || modality || ' ' || status")} AS meta, {B.sql_tokens("artifact_type || ' ' || modality")} AS tm,
  0.2 * CAST(source_anchored AS INT) + 0.3 * CAST(element_locatable AS INT) + 0.5 * CAST(proof_trace_eligible AS INT) AS loc FROM cls),
st AS (SELECT doc_id, count(*) AS n, avg(len(terms)) AS ml FROM c GROUP BY doc_id),
tf AS (SELECT doc_id, artifact_id, length, term, count(*) AS tf FROM (SELECT doc_id, artifact_id, len(terms) AS length, unnest(terms) AS term FROM c) GROUP BY ALL),
df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT query, doc_id, term, count(*) AS qtf FROM (SELECT query, doc_id, unnest({B.sql_tokens("question")}) AS term FROM qs) GROUP BY ALL),
lx AS (SELECT query, artifact_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / ml))) AS s
  FROM qt JOIN df USING (doc_id, term) JOIN st USING (doc_id) JOIN tf USING (doc_id, term) GROUP BY ALL),
qq AS (SELECT query, doc_id, list_distinct({B.sql_tokens("question")}) AS qs FROM qs),
j AS (SELECT query, artifact_id, round(coalesce(s, 0) + 0.5 * len(list_intersect(qs, list_distinct(meta))) / len(qs) + 0.25 * loc
  + 0.25 * len(list_intersect(qs, list_distinct(tm))) / len(qs) + 0.25 * coalesce(prior, 0), 6) AS score FROM qq JOIN c USING (doc_id) LEFT JOIN lx USING (query, artifact_id)
  LEFT JOIN (SELECT split_part(node_id, ':', 4) AS artifact_id, degree / max(degree) OVER () AS prior FROM deg) USING (artifact_id))
SELECT query, artifact_id, score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, artifact_id) AS r FROM j) WHERE r <= 5"""


@query(_HYBRID)
def hybrid_topk(spark, sf):
    """The pool of a question is its document; components are weighted by the full preset, the graph prior included."""
    q = B.questions(spark, sf)
    said = F.concat_ws(" ", "content", "artifact_type", "modality", F.coalesce("row_label", F.lit("")), F.coalesce("column_label", F.lit("")))
    # only documents that some question asks are ranked; the prior is a share of the largest degree of the whole graph
    c = B.classified(spark, sf, B.asked_pages(spark, sf))
    lexical = R.bm25(q.select("query", F.col("doc_id").alias("pool"), F.col("question").alias("text")), c.select(F.col("doc_id").alias("pool"), F.col("artifact_id").alias("item"), said.alias("text")))
    meta = tokens(F.concat_ws(" ", "artifact_type", "modality", "status"))
    kind = tokens(F.concat_ws(" ", "artifact_type", "modality"))
    flags = [0.2 * F.col("source_anchored").cast("int"), 0.3 * F.col("element_locatable").cast("int"), 0.5 * F.col("proof_trace_eligible").cast("int")]
    node = T.node_id("artifact", F.col("doc_id"), F.col("page_index"), F.col("artifact_id"))
    c = c.select("doc_id", "artifact_id", node.alias("node_id"), meta.alias("meta"), kind.alias("kind"), (flags[0] + flags[1] + flags[2]).alias("locator_score"))
    c = c.join(G.artifact_degree_prior(B.artifacts(spark, sf)).select("node_id", "prior"), "node_id", "left")
    j = q.select("query", "doc_id", tokens(F.col("question")).alias("qt")).join(c, "doc_id")
    j = j.join(lexical.select("query", F.col("item").alias("artifact_id"), F.col("score").alias("lexical_score")), ["query", "artifact_id"], "left")
    j = j.withColumns(
        {
            "lexical_score": F.coalesce("lexical_score", F.lit(0.0)),
            "metadata_score": scoring.overlap(F.col("qt"), F.col("meta")),
            "type_modality_score": scoring.overlap(F.col("qt"), F.col("kind")),
            "graph_prior_score": F.coalesce("prior", F.lit(0.0)),
        }
    )
    j = j.select("query", "artifact_id", F.round(scoring.hybrid("full_hybrid"), 6).alias("score"))
    return R.ranked(j, ["query"], [F.desc("score"), F.asc("artifact_id")], 5)


@query(f"WITH {B.BRANCHES} SELECT query, page_index, list_sort(list(DISTINCT branch)) AS b, list_reverse(list_sort(list(DISTINCT branch))) AS routes FROM br GROUP BY query, page_index".replace("list_sort(list(DISTINCT branch)) AS b, ", ""))
def page_routes(spark, sf):
    return P.routes(B.branches(spark, sf), ["query"])


@query(f"""WITH {B.BRANCHES} SELECT query, page_index, min(rank) AS rank,
  CASE WHEN count(*) > 1 THEN list_sort(list(rank)) ELSE [] END AS duplicate_ranks FROM br GROUP BY ALL""")
def ranked_pages_dedupe(spark, sf):
    return P.dedupe_ranked(B.branches(spark, sf), ["query"])


@query(f"""WITH {B.BRANCHES}, b AS (SELECT query, branch, page_index, min(rank) AS first_rank, max(score) AS raw FROM br GROUP BY ALL)
SELECT query, branch, page_index, first_rank, round(greatest(0.0, CASE WHEN max(abs(raw)) OVER w > 0 THEN raw / max(abs(raw)) OVER w ELSE raw END), 6) AS score
FROM b WINDOW w AS (PARTITION BY query, branch)""")
def branch_normalise(spark, sf):
    return K.branch_scores(B.branches(spark, sf), ["query", "branch"])


@query(f"""WITH {B.BRANCHES} SELECT query, page_index, round(sum(1.0 / (rank + 1)), 8) AS rr_sum, round(max(1.0 / (rank + 1)), 8) AS rr_max FROM br GROUP BY ALL""")
def rr_page_aggregate(spark, sf):
    return K.reciprocal_ranks(B.branches(spark, sf), ["query"])


_RERANK = f"""WITH {B.BRANCHES}, {D._REASON}, {B.sql_artifact_scores("SELECT DISTINCT query, page_index FROM br")},
b AS (SELECT query, branch, page_index, min(rank) AS first_rank, max(score) AS raw FROM br GROUP BY ALL),
b1 AS (SELECT query, branch, page_index, first_rank, round(greatest(0.0, CASE WHEN max(abs(raw)) OVER w > 0 THEN raw / max(abs(raw)) OVER w ELSE raw END), 6) AS score FROM b WINDOW w AS (PARTITION BY query, branch)),
s AS (SELECT query, branch, page_index, asc_.raw FROM b1 JOIN asc_ USING (query, page_index)),
a AS (SELECT query, branch, page_index, CASE WHEN max(raw) OVER w > 0 THEN round(raw / max(raw) OVER w, 6) ELSE 0.0 END AS artifact_score FROM s WINDOW w AS (PARTITION BY query, branch)),
c AS (SELECT b1.*, coalesce(artifact_score, 0.0) AS a, row_number() OVER (PARTITION BY query, branch ORDER BY first_rank) AS place FROM b1 LEFT JOIN a USING (query, branch, page_index)),
m AS (SELECT c.*, mode, max(a) OVER (PARTITION BY query, branch, mode) > 0 AS signal FROM c, (VALUES ('original_only'), ('artifact_only'), ('original_plus_artifact')) v(mode)
  WHERE mode <> 'original_plus_artifact' OR place <= 4),
f AS (SELECT *, signal AND mode <> 'original_only' AS used FROM m),
g AS (SELECT *, round(CASE WHEN used THEN CASE WHEN mode = 'artifact_only' THEN a ELSE 0.7 * score + 0.3 * a END ELSE score END, 4) AS final FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY query, branch, mode ORDER BY CASE WHEN used THEN CASE WHEN mode = 'original_plus_artifact' AND place = 1 THEN 0 ELSE 1 END ELSE 0 END,
  CASE WHEN used THEN -final ELSE 0 END, first_rank, page_index) AS position FROM g)
SELECT mode, query, branch, page_index, final, CAST(position AS INT) AS position FROM h WHERE position <= 4"""


@query(_RERANK)
def rerank_lambda_blend(spark, sf):
    keys = ["query", "branch"]
    b = kept(K.branch_scores(B.branches(spark, sf), keys), "branches")
    scored = B.artifact_scores(spark, sf, b.select("query", "page_index").distinct())
    return K.rerank_modes(K.with_artifact_scores(b, scored, keys), None, keys, K.MODES, 4)


@query(f"""WITH {B.BRANCHES}, {D._REASON}, s AS (SELECT query, page_index, score FROM br WHERE branch = 'image' AND rank < 4),
stp AS (SELECT DISTINCT page_index, unnest([page_index - 1, page_index + 1]) AS neighbour FROM s), {B.sql_artifact_scores("SELECT DISTINCT query, neighbour AS page_index FROM s JOIN stp USING (page_index)")},
own AS (SELECT query, page_index, CASE WHEN max(raw) OVER (PARTITION BY query) > 0 THEN round(raw / max(raw) OVER (PARTITION BY query), 6) ELSE 0.0 END AS a FROM asc_),
far AS (SELECT s.query, neighbour AS page_index, 0.85 * score + 0.15 * coalesce(a, 0.0) AS score FROM s JOIN stp USING (page_index) LEFT JOIN own ON own.query = s.query AND own.page_index = neighbour),
al AS (SELECT query, page_index, score FROM s UNION ALL SELECT * FROM far),
g AS (SELECT query, page_index, round(max(score), 6) AS score FROM al GROUP BY ALL)
SELECT query, page_index, score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, page_index) AS r FROM g) WHERE r <= 6""")
def graph_context_pages(spark, sf):
    """Pages next to seeds take part of the seed's score and part of their own artifacts'."""
    s = B.image_branch(spark, sf).filter("rank < 4").select("query", "page_index", "score")
    p = F.col("page_index")
    steps = s.select("page_index").distinct().select("page_index", F.explode(F.array(p - 1, p + 1)).alias("neighbour"))
    near = s.join(steps, "page_index").select("query", F.col("neighbour").alias("page_index")).distinct()
    own = K.artifact_page_scores(B.artifact_scores(spark, sf, near), ["query"])
    return R.ranked(K.propagated(s, steps, own, ["query"]), ["query"], [F.desc("score"), F.asc("page_index")], 6)


_MACRO = f"""WITH {B.POOLS}, {B.GOLD},
f AS (SELECT query, list(item ORDER BY rank) AS found FROM ord WHERE rank <= 5 GROUP BY query),
g AS (SELECT query, list(item) AS gold FROM gold GROUP BY query),
j AS (SELECT found, coalesce(gold, []) AS gold FROM f LEFT JOIN g USING (query))
SELECT count(*) AS n_queries, count(*) FILTER (len(gold) > 0) AS n_with_gold, """ + ", ".join(
    f"""round(avg(CASE WHEN len(list_intersect(found[1:{k}], gold)) > 0 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_{k},
  round(avg(CASE WHEN len(gold) > 0 THEN len(list_intersect(found[1:{k}], gold)) / len(gold) ELSE 0.0 END), 6) AS coverage_at_{k},
  round(avg(CASE WHEN len(list_intersect(found[1:{k}], gold)) > 0 THEN 1.0 ELSE 0.0 END) FILTER (len(gold) > 0), 6) AS gold_recall_at_{k}"""
    for k in (1, 3, 5)
) + " FROM j"


@query(_MACRO)
def recall_coverage_at_k(spark, sf):
    found = R.bm25_topk(B.asked(spark, sf), B.items(spark, sf), 5).select("query", "item", "rank")
    return M.macro(M.with_gold(found, B.gold(spark, sf)))


@query(f"""WITH {B.BRANCHES}, x AS (SELECT query, list_sort(list(DISTINCT page_index) FILTER (branch = 'text')) AS t, list_sort(list(DISTINCT page_index) FILTER (branch = 'image' AND rank < 3)) AS e,
  list(page_index) FILTER (branch = 'image' AND rank = 0) AS bad FROM br GROUP BY query)
SELECT query, list_sort(list_distinct(t || e)) AS candidate_pool, list_sort(list_filter(list_distinct(t || e), lambda p: NOT list_contains(bad, p))) AS required FROM x""")
def candidate_pool_sets(spark, sf):
    from folioflow.operators.tables import pool_sets

    b = B.branches(spark, sf)
    of = lambda ok: F.collect_list(F.when(ok, F.col("page_index")))
    g = b.groupBy("query").agg(
        of(F.col("branch") == "text").alias("t"), of((F.col("branch") == "image") & (F.col("rank") < 3)).alias("e"), of((F.col("branch") == "image") & (F.col("rank") == 0)).alias("bad")
    )
    return g.select("query", *[v.alias(k) for k, v in pool_sets(F.col("t"), F.col("e"), F.col("bad")).items()])


@query("""WITH v AS (SELECT vec_id, label, embedding FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
d AS (SELECT q.vec_id AS query, v.vec_id AS page, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 5) AS score FROM q JOIN v ON q.label = v.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, page) AS rank FROM d)
SELECT query, page, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def embedding_topk(spark, sf):
    """Each twentieth vector asks the pool of its label; queries are one vector each."""
    e = B.table(spark, sf, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("pool"), F.col("embedding").alias("vector"))
    return R.max_sim(q, e.select(F.col("label").alias("pool"), F.col("vec_id").alias("page"), F.col("embedding").alias("vector")), 5)


_EDGES_SEED = "seed AS (SELECT query, 'artifact:' || doc_id || ':' || page_index || ':' || artifact_id AS node, row_number() OVER (PARTITION BY query ORDER BY artifact_id) AS rank FROM qs JOIN art USING (doc_id) WHERE artifact_type IN ('table_cell', 'caption', 'text_span'))"


def _asked_artifacts(spark, sf):
    """Artifacts of the documents that questions ask, where the seeds and all that is near them lie."""
    return kept(B.artifacts(spark, sf, B.asked_pages(spark, sf)), "asked-artifacts")


def _seeds(spark, sf, artifacts=None):
    a = (_asked_artifacts(spark, sf) if artifacts is None else artifacts).filter(F.col("artifact_type").isin("table_cell", "caption", "text_span"))
    node = T.node_id("artifact", F.col("doc_id"), F.col("page_index"), F.col("artifact_id"))
    s = B.questions(spark, sf).select("query", "doc_id").join(a.select("doc_id", "artifact_id", node.alias("node")), "doc_id")
    return R.ranked(s, ["query"], [F.asc("artifact_id")], 3).select("query", "node", "rank")


def _expansion(neighbours: str) -> str:
    return f"""WITH {B.ARTIFACTS}, {B.QUESTIONS}, {_EDGES_SEED},
x AS (SELECT artifact_id, 'artifact:' || doc_id || ':' || page_index || ':' || artifact_id AS node, doc_id, page_index, source_id FROM art),
nb AS ({neighbours}), s3 AS (SELECT * FROM seed WHERE rank <= 3),
al AS (SELECT query, node, rank, 0 AS far, '' AS name FROM s3 UNION ALL SELECT query, neighbour, rank, 1, neighbour FROM s3 JOIN nb USING (node)),
o AS (SELECT query, node, rank, far, name, row_number() OVER (PARTITION BY query, node ORDER BY rank, far, name) AS n FROM al)
SELECT query, node, CAST(row_number() OVER (PARTITION BY query ORDER BY rank, far, name) AS INT) AS position FROM o WHERE n = 1"""


@query(_expansion("SELECT DISTINCT a.node, b.node AS neighbour FROM x a JOIN x b ON a.doc_id = b.doc_id AND abs(a.page_index - b.page_index) <= 1 AND a.node <> b.node"))
def expand_page_neighborhood(spark, sf):
    a = _asked_artifacts(spark, sf)
    s = _seeds(spark, sf, a)
    return G.expand(s, G.page_neighbours(G.edges(a, context=False), s.select("node")))


@query(_expansion("SELECT DISTINCT a.node, b.node AS neighbour FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.source_id = b.source_id AND a.node <> b.node"))
def expand_anchor(spark, sf):
    a = _asked_artifacts(spark, sf)
    s = _seeds(spark, sf, a)
    return G.expand(s, G.anchor_neighbours(G.edges(a, context=False), s.select("node")))


_FIRST = "SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY artifact_id) AS n FROM x"


@query(_expansion(f"""SELECT DISTINCT a.node, b.node AS neighbour FROM ({_FIRST}) a JOIN ({_FIRST}) b ON a.doc_id = b.doc_id AND abs(a.page_index - b.page_index) = 1 AND a.n = 1 AND b.n = 1"""))
def expand_direct(spark, sf):
    """Along edges that join two artifacts. The graph's own rules make none, so edges of a formal type are brought in: from the
    first artifact of each page to that of the next page."""
    a = _asked_artifacts(spark, sf)
    first = a.groupBy("doc_id", "page_index").agg(F.min("artifact_id").alias("artifact_id"))
    node = T.node_id("artifact", F.col("doc_id"), F.col("page_index"), F.col("artifact_id"))
    w = Window.partitionBy("doc_id").orderBy("page_index")
    step = first.select(node.alias("source"), F.lead(node).over(w).alias("target"), (F.lead("page_index").over(w) - F.col("page_index")).alias("gap"))
    brought = step.filter("gap = 1").select("source", "target", F.lit("adjacent_page").alias("edge_type"))
    return G.expand(_seeds(spark, sf, a), G.direct_neighbours(G.edges(a, context=False).unionByName(brought)))
