"""Page ranking: branch scores, re-ranking, capped selection, ordered sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def branch_scores(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page_index, first_rank, score): best score of a page over the branch's largest absolute score, at least 0."""
    best = ranked.groupBy(*keys, "page_index").agg(F.min("rank").alias("first_rank"), F.max("score").alias("raw"))
    top = F.max(F.abs("raw")).over(Window.partitionBy(*keys))
    return best.select(*keys, "page_index", "first_rank", F.round(F.greatest(F.lit(0.0), F.when(top > 0, F.col("raw") / top).otherwise(F.col("raw"))), 6).alias("score"))


def with_artifact_scores(branches: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """``branches`` with the artifact score of each page, in one join. ``scored``: (page_index, score, weight), with ``query`` where keys have it."""
    on = [k for k in (*keys, "page_index") if k in scored.columns]
    s = scored.groupBy(*on).agg(F.max(F.col("score") * F.col("weight")).alias("_raw"))
    b = branches.join(s, on, "left")
    top = F.max("_raw").over(Window.partitionBy(*keys))
    return b.withColumn("artifact_score", F.when(top > 0, F.round(F.col("_raw") / top, 6)).otherwise(0.0)).drop("_raw")


def reciprocal_ranks(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page_index, rr_sum, rr_max) over all branches."""
    rr = 1.0 / (F.col("rank") + 1)
    return ranked.groupBy(*keys, "page_index").agg(F.round(F.sum(rr), 8).alias("rr_sum"), F.round(F.max(rr), 8).alias("rr_max"))


def artifact_page_scores(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``scored``: (keys, page_index, score, weight). Best weighted score of each page over the best of all."""
    page = scored.groupBy(*keys, "page_index").agg(F.max(F.col("score") * F.col("weight")).alias("raw"))
    top = F.max("raw").over(Window.partitionBy(*keys))
    return page.select(*keys, "page_index", F.when(top > 0, F.round(F.col("raw") / top, 6)).otherwise(0.0).alias("artifact_score"))


#: Fixed values.
MODES = ["original_only", "artifact_only", "original_plus_artifact"]


def rerank_modes(branches: DataFrame, artifact_scores: DataFrame | None, keys: list[str], modes: list[str], k: int, blend: float = 0.7) -> DataFrame:
    """(mode, keys, page_index, final, position) for each of ``modes``, from one join of the branches with their artifact scores.

    ``original_only``: the branch's own order. ``artifact_only``: artifact scores over all pages. ``original_plus_artifact``:
    a blend over the branch's first ``k`` pages that keeps the first one first. Without a positive artifact score in the
    branch the original order stands. ``branches``: (keys, page_index, first_rank, score), with artifact_score where no table of
    them is given.
    """
    b = branches if artifact_scores is None else branches.join(artifact_scores, [*keys, "page_index"], "left")
    b = b.withColumn("a", F.coalesce("artifact_score", F.lit(0.0)))
    b = b.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("first_rank")))
    b = b.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    both, mode = F.col("mode") == "original_plus_artifact", F.col("mode")
    b = b.filter(~both | (F.col("place") <= k))
    w = Window.partitionBy(*keys, "mode")
    used = (F.max("a").over(w) > 0) & (mode != "original_only")
    b = b.withColumn("used", used)
    blended = F.when(mode == "artifact_only", F.col("a")).otherwise(blend * F.col("score") + (1 - blend) * F.col("a"))
    b = b.withColumn("final", F.round(F.when(F.col("used"), blended).otherwise(F.col("score")), 4))
    first = F.when(both & (F.col("place") == 1), 0).otherwise(1)
    order = [F.when(F.col("used"), first).otherwise(0), F.when(F.col("used"), -F.col("final")).otherwise(0.0), F.col("first_rank"), F.col("page_index")]
    return b.withColumn("position", F.row_number().over(w.orderBy(*order))).filter(F.col("position") <= k).select("mode", *keys, "page_index", "final", "position")


def rerank(branches: DataFrame, artifact_scores: DataFrame, keys: list[str], mode: str, k: int, blend: float = 0.7) -> DataFrame:
    """(keys, page_index, final, position) by one mode."""
    return rerank_modes(branches, artifact_scores, keys, [mode], k, blend).drop("mode")


def capped(rows: DataFrame, order: list[Column], caps: list[tuple[list[str], int]], total: int | None = None) -> DataFrame:
    """Keeps at most so many rows of each group, group after group, then so many in all; adds ``position`` if cut in all.

    Equals the greedy loop that walks the rows in order and skips full groups. The last cut takes few rows
    from each partition before one task orders them.
    """
    for by, cap in caps:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")
    if total is None:
        return rows
    return rows.orderBy(*order).limit(total).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def admitted(rows: DataFrame, doc: str, order: list[Column], max_docs: int) -> DataFrame:
    """Rows of the first ``max_docs`` documents, by each document's first row."""
    first = rows.groupBy(doc).agg(F.min(F.struct(*order)).alias("_first"))
    return rows.join(first.orderBy("_first", doc).limit(max_docs).select(doc), doc, "left_semi")


def propagated(seeds: DataFrame, steps: DataFrame, artifact_scores: DataFrame, keys: list[str], keep: float = 0.85) -> DataFrame:
    """Scores of pages next to seeds: keep x seed's + (1 - keep) x own artifact score, the best of all; one step, at once.

    ``seeds``: (keys, page_index, score); ``steps``: (page_index, neighbour). Seeds keep their score if it is better.
    """
    far = seeds.join(steps, "page_index").select(*keys, F.col("neighbour").alias("page_index"), F.col("score").alias("_seed"))
    far = far.join(artifact_scores, [*keys, "page_index"], "left")
    far = far.select(*keys, "page_index", (keep * F.col("_seed") + (1 - keep) * F.coalesce("artifact_score", F.lit(0.0))).alias("score"))
    return seeds.select(*keys, "page_index", "score").union(far).groupBy(*keys, "page_index").agg(F.round(F.max("score"), 6).alias("score"))


def propagated_in_order(df: DataFrame, seeds: Column, steps: Column, artifact: Column, keep: float = 0.85) -> Column:
    """The same, seed after seed, where a later seed may have been raised by an earlier one.

    ``seeds``: array of (page, score) in order; ``steps``: map page -> array of neighbours; ``artifact``: map page -> score.
    Returns a map page -> score.
    """
    start = F.map_from_entries(F.transform(seeds, lambda s: F.struct(s["page"], s["score"])))

    def one(scores, seed):
        base = F.coalesce(F.try_element_at(scores, seed["page"]), F.lit(0.0))
        near = F.coalesce(F.try_element_at(steps, seed["page"]), F.array().cast("array<int>"))
        raised = F.map_from_entries(
            F.transform(
                near,
                lambda p: F.struct(
                    p,
                    F.greatest(
                        F.coalesce(F.try_element_at(scores, p), F.lit(0.0)),
                        F.round(keep * base + (1 - keep) * F.coalesce(F.try_element_at(artifact, p), F.lit(0.0)), 8),
                    ),
                ),
            )
        )
        old = F.map_filter(scores, lambda k, _: ~F.array_contains(near, k))
        return F.map_concat(old, raised)

    return F.aggregate(seeds, start, one)
