"""A stored index for late interaction: pages and queries of several vectors each, a score being the sum of each query vector's best product with a page's.

Index: centroids, trained on at most ``SAMPLE`` vectors (by the hash of their values), and cut points of the residuals; for each vector its nearest centroid and
its residual in ``BITS`` bits a number (``codes``, in the order of centroids); and the vectors themselves, a row a page (``pages``), for exact scores.

Search: each query vector visits its ``probes`` nearest centroids; there products with decoded vectors, block by block, give its best pages;
sums over a query's vectors give candidates, of which the first ``rescored`` are scored exactly. :func:`operators.retrieval.max_sim` is the exact way.

Defined results: a page or query without vectors isn't there; a query with a pool only meets pages of it, one without meets all; ``allowed`` (query, page) masks
the pages of the queries it names; ties go to the lesser page; empty tables give no rows. Vectors are of one length.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.operators.retrieval import ranked

SAMPLE = 50_000
CENTROIDS = 4096
BITS = 2
#: Vectors of a block of codes, and of queries, that meet in one product; pages that a query vector keeps of a block.
BLOCK_CODES, BLOCK_QUERIES, KEEP = 20_000, 2_000, 100
#: Pages whose vectors lie in one task for exact scores.
BLOCK_PAGES = 20_000


def trained(sample: np.ndarray, n: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroids, cut points, values) from a sample; values are the means of the residuals between two cuts, by dimension."""
    rng = np.random.default_rng(5)
    c = sample[rng.permutation(len(sample))[:n]].copy()
    for _ in range(rounds):
        at = nearest(c, sample, 1)[:, 0]
        size = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    rest = sample - c[nearest(c, sample, 1)[:, 0]]
    levels = 1 << BITS
    cuts = np.quantile(rest, np.arange(1, levels) / levels, axis=0)
    code = (rest[None] > cuts[:, None]).sum(axis=0)
    values = np.stack([np.where((code == v).any(0), (rest * (code == v)).sum(0) / np.maximum((code == v).sum(0), 1), 0) for v in range(levels)])
    return c, cuts, values


def nearest(centroids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each vector, nearest first."""
    far = (centroids**2).sum(1)[None] - 2 * vectors @ centroids.T
    k = min(k, len(centroids))
    some = np.argpartition(far, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)


def pack(code: np.ndarray) -> np.ndarray:
    """Codes of ``BITS`` bits as bytes, a row a vector."""
    bits = (code[:, :, None] >> np.arange(BITS) & 1).astype(np.uint8).reshape(len(code), -1)
    return np.packbits(bits, axis=1, bitorder="little")


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1, bitorder="little")[:, : width * BITS].reshape(len(packed), width, BITS)
    return (bits << np.arange(BITS, dtype=np.uint8)).sum(axis=2)


def build(pages: DataFrame, folder: str, centroids: int | None = None) -> None:
    """Write the index of ``pages`` (pool, page, vector), several rows a page, to ``folder``."""
    spark = pages.sparkSession
    v = pages.select(F.col("pool").cast("string").alias("pool"), "page", F.col("vector").cast("array<float>").alias("vector"))
    v.groupBy("pool", "page").agg(F.collect_list("vector").alias("vectors")).write.parquet(f"{folder}/pages")
    drawn = v.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toPandas()["vector"]
    sample = np.stack(drawn.to_numpy()).astype(np.float64) if len(drawn) else np.zeros((1, 1))
    n = centroids or min(CENTROIDS, max(1, int(4 * np.sqrt(len(sample)))))
    model = trained(sample, n)
    spark.createDataFrame([tuple(json.dumps(m.tolist()) for m in model)], "centroids string, cuts string, values string").write.parquet(f"{folder}/model")
    shipped = spark.sparkContext.broadcast(model)  # at most CENTROIDS vectors

    def code(batches):
        c, cuts, _ = shipped.value
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["vector"].to_numpy()).astype(np.float64)
            at = nearest(c, x, 1)[:, 0]
            packed = pack((x - c[at] > cuts[:, None]).sum(axis=0))
            yield pd.DataFrame({"pool": b["pool"], "page": b["page"], "centroid": at.astype(np.int32), "code": [p.tobytes() for p in packed]})

    kind = dict(pages.dtypes)["page"]
    codes = v.mapInPandas(code, f"pool string, page {kind}, centroid int, code binary")
    codes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "centroid", "page").sortWithinPartitions("centroid", "page").write.parquet(f"{folder}/codes")


def _model(spark: SparkSession, folder: str):
    return tuple(np.array(json.loads(x)) for x in spark.read.parquet(f"{folder}/model").first())


def candidates(spark: SparkSession, folder: str, queries: DataFrame, probes: int, n: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query, page, pool): the first ``n`` pages of each query by approximate score."""
    shipped = spark.sparkContext.broadcast(_model(spark, folder))
    codes = spark.read.parquet(f"{folder}/codes")
    kinds = dict(queries.dtypes)["query"], dict(codes.dtypes)["page"]
    if codes.isEmpty():
        return spark.createDataFrame([], f"query {kinds[0]}, pool string, page {kinds[1]}")
    q = queries.select("query", F.col("pool").cast("string").alias("pool"), F.col("vector").cast("array<float>").alias("vector"))

    def visit(batches):
        c, _, _ = shipped.value
        for b in batches:
            if len(b):
                yield b.assign(centroid=list(nearest(c, np.stack(b["vector"].to_numpy()).astype(np.float64), probes).astype(np.int32)))

    q = q.withColumn("vector_id", F.xxhash64("query", "vector")).mapInPandas(visit, f"query {kinds[0]}, pool string, vector array<float>, vector_id long, centroid array<int>")
    q = q.withColumn("centroid", F.explode("centroid"))
    blocks = codes.groupBy("centroid").agg(F.ceil(F.count("*") / BLOCK_CODES).cast("int").alias("_cn"))
    blocks = blocks.join(q.groupBy("centroid").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("_qn")), "centroid")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = q.join(blocks, "centroid").select("centroid", "query", "pool", "vector", "vector_id", F.pmod("vector_id", F.col("_qn")).cast("int").alias("_q"), every("_cn").alias("_c"))
    right = codes.join(blocks, "centroid").select("centroid", "page", "pool", "code", F.pmod(F.xxhash64("page"), "_cn").cast("int").alias("_c"), every("_qn").alias("_q"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": a["query"][:0], "vector_id": a["vector_id"][:0], "page": pd.Series(dtype=object), "pool": b["pool"][:0], "score": pd.Series(dtype=object)})
        if not len(a) or not len(b):
            return none
        c, _, values = shipped.value
        b = b.sort_values(["page", "pool"], kind="stable")
        centre = c[int(b["centroid"].iloc[0])]
        code = unpack(np.stack([np.frombuffer(x, np.uint8) for x in b["code"]]), len(centre))
        rest = np.take_along_axis(values, code, axis=0)
        dots = np.stack(a["vector"].to_numpy()).astype(np.float64) @ (centre + rest).T
        own, met = a["pool"].to_numpy(), b["pool"].to_numpy()
        dots[np.array([p is not None for p in own])[:, None] & (own[:, None] != met[None])] = -np.inf
        k = min(KEEP, len(b))
        best = np.argpartition(-dots, k - 1, axis=1)[:, :k]
        row, col = np.repeat(np.arange(len(a)), k), best.ravel()
        fine = np.isfinite(dots[row, col])
        row, col = row[fine], col[fine]
        # a row a query vector and pool, with its pages as arrays
        out = pd.DataFrame({"row": row, "pool": met[col], "page": b["page"].to_numpy()[col], "score": dots[row, col]})
        out = out.groupby(["row", "pool"], dropna=False, sort=False).agg({"page": list, "score": list}).reset_index()
        row = out.pop("row").to_numpy(np.int64)
        return out.assign(query=a["query"].to_numpy()[row], vector_id=a["vector_id"].to_numpy()[row])[["query", "vector_id", "page", "pool", "score"]]

    keys = ["centroid", "_q", "_c"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, f"query {kinds[0]}, vector_id long, page array<{kinds[1]}>, pool string, score array<double>")
    # dealt out once, by query, which all that follows is grouped by
    found = found.repartition("query").select("query", "vector_id", "pool", F.explode(F.arrays_zip("page", "score")).alias("x")).select("query", "vector_id", "pool", "x.page", "x.score")
    if allowed is not None:
        bound = allowed.select("query").distinct()
        found = found.join(allowed.select("query", "page").distinct(), ["query", "page"], "left_semi").unionByName(found.join(bound, "query", "left_anti"))
    best = found.groupBy("query", "vector_id", "pool", "page").agg(F.max("score").alias("score"))
    usual = F.avg("score").over(Window.partitionBy("query", "vector_id"))  # what a page that a query vector didn't find may well have
    best = best.withColumn("usual", usual).groupBy("query", "pool", "page").agg(F.sum(F.col("score") - F.col("usual")).alias("score"))
    return ranked(best, ["query"], [F.desc("score"), F.asc("page")], n).select("query", "pool", "page")


def top_k(spark: SparkSession, folder: str, queries: DataFrame, k: int, probes: int = 64, rescored: int = 200, allowed: DataFrame | None = None) -> DataFrame:
    """(query, page, score, rank) for ``queries`` (query, pool, vector), several rows a query; scores are exact, pages those that the index finds."""
    some = candidates(spark, folder, queries, probes, rescored, allowed)
    held = spark.read.parquet(f"{folder}/pages")
    block = F.pmod(F.xxhash64("pool", "page"), F.lit(max(1, -(-held.count() // BLOCK_PAGES)))).alias("_b")
    asked = queries.groupBy("query").agg(F.collect_list(F.col("vector").cast("array<float>")).alias("asked"))
    pairs = some.groupBy("query", block).agg(F.collect_list(F.struct("pool", "page")).alias("x")).join(asked, "query").select("_b", "query", "asked", "x.pool", "x.page")

    def exact(pages: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        """A block's pages meet all queries that found some of them, so vectors are shuffled a block and not a pair."""
        at = {(x, p): v for x, p, v in zip(pages["pool"], pages["page"], pages["vectors"], strict=True)}
        out = [pd.DataFrame({"query": pairs["query"][:0], "page": pages["page"][:0], "score": pd.Series(dtype="float64")})]
        for query, mine, pools, found in zip(pairs["query"], pairs["asked"], pairs["pool"], pairs["page"], strict=True):
            theirs = [np.stack(at[key]) for key in zip(pools, found, strict=True)]
            dots = np.stack(mine).astype(np.float64) @ np.concatenate(theirs).astype(np.float64).T
            starts = np.cumsum([0, *(len(x) for x in theirs[:-1])])
            score = np.maximum.reduceat(dots, starts, axis=1).sum(axis=0)
            out.append(pd.DataFrame({"query": np.full(len(found), query), "page": found, "score": [round(float(x), 5) for x in score]}))
        return pd.concat(out[1:] or out)

    kinds = dict(queries.dtypes)["query"], dict(held.dtypes)["page"]
    scored = held.select(block, "pool", "page", "vectors").groupBy("_b").cogroup(pairs.groupBy("_b")).applyInPandas(exact, f"query {kinds[0]}, page {kinds[1]}, score double")
    return ranked(scored, ["query"], [F.desc("score"), F.asc("page")], k)
