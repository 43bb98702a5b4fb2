"""Ranking artifacts for queries: BM25 within candidate pools, hybrid scores, top k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import scoring
from folioflow.functions.text import tokens


def pool_stats(items: DataFrame, pool: str = "pool", item: str = "item", text: str = "text") -> DataFrame:
    """(pool, n, mean_length): artifacts in each pool and their mean token count."""
    return items.select(pool, F.size(tokens(F.col(text))).alias("length")).groupBy(pool).agg(
        F.count("*").alias("n"), F.avg("length").alias("mean_length")
    )


def document_frequency(items: DataFrame, pool: str = "pool", text: str = "text") -> DataFrame:
    """(pool, term, df): a document counts once a term, so terms are made distinct before they are exploded."""
    terms = items.select(pool, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return terms.groupBy(pool, "term").agg(F.count("*").alias("df"))


def bm25(queries: DataFrame, items: DataFrame) -> DataFrame:
    """``queries``: (query, pool, text); ``items``: (pool, item, text). Rows (query, item, score) with a positive score.

    Statistics are those of the query's pool. Only postings of terms that some query asks of the pool leave the scan.
    """
    asked = queries.select("query", "pool", F.explode(tokens(F.col("text"))).alias("term"))
    asked = asked.groupBy("query", "pool", "term").agg(F.count("*").alias("qtf"))
    # each item has one more posting, of a term that no text holds: it counts the pool's items and their lengths
    every = F.lit("")
    held = items.select("pool", "item", tokens(F.coalesce("text", F.lit(""))).alias("terms")).withColumn("length", F.size("terms"))
    wanted = asked.select("pool", "term").union(queries.select("pool", every)).distinct()
    postings = held.select("pool", "item", "length", F.explode(F.concat(F.array(every), "terms")).alias("term")).join(wanted, ["pool", "term"], "left_semi")
    postings = postings.groupBy("pool", "term", "item", "length").agg(F.count("*").alias("tf"))
    df = postings.groupBy("pool", "term").agg(F.count("*").alias("df"))
    counted = F.when(F.col("term") == every, F.col("length"))  # not a filter, so that all branches share one exchange of postings
    stats = postings.groupBy("pool").agg(F.count(counted).alias("n"), F.avg(counted).alias("mean_length"))
    scored = asked.join(df, ["pool", "term"]).join(stats, "pool").join(postings, ["pool", "term"])
    term = scoring.bm25_term(*[F.col(c) for c in ("qtf", "tf", "df", "n", "length", "mean_length")])
    return scored.groupBy("query", "pool", "item").agg(F.sum(term).alias("score"))


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; the rank is tested where it is made, so that groups are cut before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def bm25_topk(queries: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """(query, item, score, rank). Items that score nothing fill up short lists, least item first.

    To fill a list, the 2k least items of its pool are enough: fewer than k of them can have scores.
    """
    found = bm25(queries, items).select("query", "item", F.round("score", 6).alias("score"))
    least = ranked(items.select("pool", "item"), ["pool"], [F.col("item")], 2 * k, "_n")
    fill = queries.select("query", "pool").join(least, "pool").select("query", "item", F.lit(0.0).alias("score"))
    best = found.unionByName(fill).groupBy("query", "item").agg(F.max("score").alias("score"))
    return ranked(best, ["query"], [F.desc("score"), F.asc("item")], k)


def filtered_topk(ranked_: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """The first ``k`` items of each query's ranking among those allowed to it; queries without a list of their own keep all.

    ``ranked_``: (query, item, score, rank), whole rankings; ``allowed``: (query, item).
    """
    listed = allowed.select("query").distinct().withColumn("_own", F.lit(True))
    j = ranked_.join(listed, "query", "left").join(allowed.select("query", "item").distinct().withColumn("_in", F.lit(True)), ["query", "item"], "left")
    return ranked(j.filter("_own IS NULL OR _in").drop("_own", "_in").withColumnRenamed("rank", "_r"), ["query"], [F.col("_r")], k).drop("_r")


#: Vectors of a block of pages, and of queries, that meet in one task; numbers that a task's products hold at once.
BLOCK_PAGES, BLOCK_QUERIES = 20_000, 2_000
PRODUCT = 2_000_000


def _most(asked: np.ndarray, held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The highest product of each asked vector with each page's; ``PRODUCT`` bounds the rows that are multiplied at once."""
    step = max(1, PRODUCT // held.shape[1])
    return np.concatenate([np.maximum.reduceat(asked[i : i + step] @ held, at, axis=1) for i in range(0, len(asked), step)])


def max_sim(queries: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """Late interaction: sum over query vectors of the best dot product with a page's vectors; top ``k`` pages.

    ``queries``: (query, pool, vector), several rows a query; ``pages``: (pool, page, vector), several rows a page. Exact: each block of a
    pool's pages meets each block of its queries in matrix products of a few queries at a time, of which only each query's first ``k`` pages leave the
    task. A page or query lies in one block as a whole.
    """
    blocks = pages.groupBy("pool").agg(F.ceil(F.count("*") / BLOCK_PAGES).cast("int").alias("_pn"))
    blocks = blocks.join(queries.groupBy("pool").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("_qn")), "pool")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = pages.join(blocks, "pool").select("pool", "page", "vector", F.pmod(F.xxhash64("page"), "_pn").cast("int").alias("_p"), every("_qn").alias("_q"))
    q = queries.join(blocks, "pool").select("pool", "query", "vector", F.pmod(F.xxhash64("query"), "_qn").cast("int").alias("_q"), every("_pn").alias("_p"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": pd.Series(dtype="int64"), "page": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        if not len(left) or not len(right):
            return out[0]
        left, right = left.sort_values("query", kind="stable"), right.sort_values("page", kind="stable")
        q_ids, q_at = np.unique(left["query"].to_numpy(), return_index=True)
        p_ids, p_at = np.unique(right["page"].to_numpy(), return_index=True)
        held = np.stack(right["vector"].to_numpy()).astype(np.float64).T
        ends = np.append(q_at[1:], len(left))
        a = 0
        while a < len(q_ids):  # as many queries at once as have PRODUCT products with the block's vectors, at least one
            z = max(a + 1, int(np.searchsorted(ends, q_at[a] + max(1, PRODUCT // held.shape[1]), "right")))
            asked = np.stack(left["vector"].iloc[q_at[a] : ends[z - 1]].to_numpy()).astype(np.float64)
            score = np.round(np.add.reduceat(_most(asked, held, p_at), q_at[a:z] - q_at[a], axis=0), 5)
            rows, cols = [], []
            for i, s in enumerate(score):  # all that tie with the k-th are sorted, so that ties go to the lesser page
                some = np.arange(len(s)) if len(s) <= k else np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                some = some[np.argsort(-s[some], kind="stable")][:k]
                rows.append(np.full(len(some), i))
                cols.append(some)
            row, col = np.concatenate(rows), np.concatenate(cols)
            out.append(pd.DataFrame({"query": q_ids[a:z][row], "page": p_ids[col], "score": score[row, col]}))
            a = z
        return pd.concat(out[1:])

    kinds = dict(queries.dtypes)["query"], dict(pages.dtypes)["page"]
    keys = ["pool", "_q", "_p"]
    found = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(best, f"query {kinds[0]}, page {kinds[1]}, score double")
    return ranked(found, ["query"], [F.desc("score"), F.asc("page")], k)
