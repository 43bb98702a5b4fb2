"""Queries that read stored indexes. An index is built once an application and input, and found again by later queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import digests as M
from folioflow.operators import passages as X
from folioflow.operators import ranking as K
from folioflow.operators import retrieval as T
from folioflow.operators import vectors as V
from folioflow.plans import bindings as B
from folioflow.sources import readers as R
from folioflow.sources import sinks as S

QUERIES, ORACLE = {}, {}
_BUILT: dict[tuple, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def stored(spark, sf, kind: str, build) -> str:
    """The folder of an index over ``sf``'s tables, which ``build`` writes unless this application has done so."""
    key = spark.sparkContext.applicationId, sf, kind
    if key not in _BUILT or not R.exists(spark, _BUILT[key]):
        folder = S.work_folder(spark, kind)
        build(folder)
        _BUILT[key] = folder
    return _BUILT[key]


def passage_index(spark, sf) -> str:
    return stored(spark, sf, "passages", lambda folder: X.build(B.items(spark, sf), folder))


@query(f"WITH {B.POOLS} SELECT query, item, score, CAST(rank AS INT) AS rank FROM ord WHERE rank <= 5")
def index_topk(spark, sf):
    """The best passages of each query's pool, from the stored index."""
    return X.top_k_filled(spark, passage_index(spark, sf), B.asked(spark, sf), 5)


#: BM25 of every item against all documents, statistics included.
_EVERYWHERE = f"""
q AS (SELECT item_id AS query, text FROM benchmark),
it AS (SELECT source AS pool, doc_id AS item, {B.sql_tokens("coalesce(text, '')")} AS terms FROM documents),
st AS (SELECT count(*) AS n, avg(len(terms)) AS mean_length FROM it),
tf AS (SELECT pool, item, len(any_value(terms)) AS length, term, count(*) AS tf FROM (SELECT pool, item, terms, unnest(terms) AS term FROM it) GROUP BY pool, item, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qf AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest({B.sql_tokens("text")}) AS term FROM q) GROUP BY ALL),
sc AS (SELECT query, pool, item, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean_length))), 6) AS score
  FROM qf JOIN df USING (term) JOIN tf USING (term), st GROUP BY query, pool, item)"""


@query(f"""WITH {_EVERYWHERE}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, pool, item) AS INT) AS rank FROM sc)
SELECT query, item, pool, score, rank FROM r WHERE rank <= 10""")
def index_topk_everywhere(spark, sf):
    """Queries that name no document ask all of them; the statistics are those of all."""
    asked = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.lit("").alias("pool"), "text")
    return X.top_k(spark, passage_index(spark, sf), asked, 10)


@query(f"""WITH {_EVERYWHERE}, a AS (SELECT * FROM sc WHERE query % 2 = 0 OR (item % 7 = query % 7 AND item IN (SELECT doc_id FROM labels WHERE quality = 1))),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, pool, item) AS INT) AS rank FROM a)
SELECT query, item, pool, score, rank FROM r WHERE rank <= 4""")
def index_topk_allowed(spark, sf):
    """Each second query is bound to a list of pages: good ones whose number leaves the query's remainder by 7."""
    asked = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.lit("").alias("pool"), "text")
    good = B.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("item"))
    bound = asked.filter(F.pmod("query", F.lit(2)) == 1).select("query")
    return X.top_k(spark, passage_index(spark, sf), asked, 4, bound.join(good, F.pmod("query", F.lit(7)) == F.pmod("item", F.lit(7))))


def vectors(spark, sf):
    """Four vectors make a page; a page's pool is even or odd by its number."""
    e = B.table(spark, sf, "embeddings")
    page = F.floor(F.col("vec_id") / 4).cast("long")
    return e.select(F.pmod(page, F.lit(2)).cast("string").alias("pool"), page.alias("page"), F.col("embedding").alias("vector"))


def vector_queries(spark, sf):
    """The vectors of each twentieth page, asking all pages."""
    return vectors(spark, sf).filter("page % 20 = 0").select(F.col("page").alias("query"), F.lit(None).cast("string").alias("pool"), "vector")


def vector_index(spark, sf) -> str:
    return stored(spark, sf, "vectors", lambda folder: V.build(vectors(spark, sf), folder))


_MAX_SIM = """
v AS (SELECT vec_id, vec_id // 4 AS page, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
b AS (SELECT q.page AS query, q.vec_id, v.page, max(list_dot_product(q.e, v.e)) AS s FROM v q JOIN v ON q.page % 20 = 0 GROUP BY ALL),
d AS (SELECT query, page, round(sum(s), 5) AS score FROM b GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, page) AS INT) AS rank FROM d)"""


@query(f"WITH {_MAX_SIM} SELECT query, page, score, rank FROM r WHERE rank <= 5")
def late_interaction_topk(spark, sf):
    """Queries and pages of four vectors each, scored exactly against all pages, block by block."""
    one = F.lit("all").alias("pool")
    q = vector_queries(spark, sf).select("query", one, "vector")
    return T.max_sim(q, vectors(spark, sf).select(one, "page", "vector"), 5)


@query()
def vector_index_topk(spark, sf):
    """The same through the stored index: exact scores of the pages that it finds (a test holds its recall against the exact query)."""
    return V.top_k(spark, vector_index(spark, sf), vector_queries(spark, sf), 5)


@query("""WITH c AS (SELECT doc_id FROM documents WHERE doc_id % 97 = 5 OR doc_id % 211 = 9 OR (doc_id % 307 = 11)) SELECT DISTINCT (doc_id // 64) * 64 AS first_key, (doc_id // 64) * 64 + 63 AS last_key FROM c""")
def runs_that_differ(spark, sf):
    """Two runs' stored digests name the key ranges in which rows were changed, lost or there twice. Rows are digested where they lie; only digests are shuffled."""
    d, root = B.table(spark, sf, "documents"), S.work_folder(spark, "digests")
    i = F.col("doc_id")
    other = d.filter("doc_id % 211 <> 9").withColumn("n_chars", F.when(i % 97 == 5, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    other = other.unionByName(other.filter("doc_id % 307 = 11"))
    for name, run in (("one", d), ("two", other)):
        M.write(run, "doc_id", f"{root}/{name}")
    return M.differing(M.read(spark, f"{root}/one"), M.read(spark, f"{root}/two"))


def _unrolled(steps: int) -> str:
    """Each seed in turn raises its neighbours, from the scores that the seeds before it have left."""
    out = []
    for k in range(1, steps + 1):
        out.append(f"""s{k} AS (SELECT p.query, p.page_index, CASE WHEN abs(p.page_index - o.page_index) = 1 THEN greatest(p.score, round(0.85 * o.score + 0.15 * p.a, 8)) ELSE p.score END AS score, p.a
  FROM s{k - 1} p JOIN rk USING (query) JOIN s{k - 1} o ON o.query = p.query AND o.page_index = rk.page_index WHERE rk.n = {k}
  UNION ALL SELECT * FROM s{k - 1} WHERE query NOT IN (SELECT query FROM rk WHERE n = {k}))""")
    return ", ".join(out)


@query(f"""WITH {B.ARTIFACTS}, c AS (SELECT number, least(1.0, count(*) / 10.0) AS a FROM art GROUP BY number),
s0 AS (SELECT item_id AS query, CAST(d.doc_id % 4 AS INT) AS page_index, round(1.0 / (1 + (d.doc_id % 4 * 7 + item_id) % 4), 6)::DOUBLE AS score, coalesce(a, 0.0)::DOUBLE AS a FROM benchmark JOIN documents d ON d.doc_id // 4 = item_id LEFT JOIN c ON number = d.doc_id),
rk AS (SELECT query, page_index, row_number() OVER (PARTITION BY query ORDER BY score, page_index) AS n FROM s0), {_unrolled(4)}
SELECT query, page_index, round(score, 6) AS score FROM s4""")
def propagation_in_order(spark, sf):
    """The pages of each question's document, lowest score first, pass their scores on seed after seed: a raised page passes on more."""
    a = B.artifacts(spark, sf).groupBy("number").agg(F.least(F.lit(1.0), F.count("*") / 10.0).alias("a"))
    q = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query"))
    n = F.col("doc_id")
    pages = B.table(spark, sf, "documents").select(n.alias("number"), F.floor(n / 4).alias("query"), F.pmod(n, F.lit(4)).cast("int").alias("page"))
    pages = q.join(pages, "query").join(a, "number", "left").withColumn("score", F.round(1.0 / (1 + F.pmod(F.col("page") * 7 + F.col("query"), F.lit(4))), 6))
    g = pages.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "page"))).alias("s"), F.map_from_entries(F.collect_list(F.struct("page", F.coalesce("a", F.lit(0.0)).alias("a")))).alias("own"))
    held = F.transform("s", lambda x: x["page"])
    near = F.map_from_entries(F.transform(held, lambda p: F.struct(p, F.filter(F.array(p - 1, p + 1), lambda o: F.array_contains(held, o)))))
    seeds = F.transform("s", lambda x: F.struct(x["page"].alias("page"), x["score"].alias("score")))
    out = g.withColumn("near", near).withColumn("seeds", seeds)
    out = out.select("query", K.propagated_in_order(out, F.col("seeds"), F.col("near"), F.col("own")).alias("m"))
    return out.select("query", F.explode("m").alias("page_index", "score")).withColumn("score", F.round("score", 6))
