"""Selections for prompting: page binding, context ranking, buckets, snippets, identifiers, support checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import present


def bind_pages(ranked: DataFrame, pages: DataFrame, k: int, mixed: DataFrame | None = None) -> DataFrame:
    """The first ``k`` pages of each branch with their texts; with ``mixed`` only pages that the mixed list has too.

    ``ranked``: (query, branch, rank, page_index); ``mixed``: (query, page_index); ``pages``: (page_index, text).
    """
    top = ranked.filter(F.col("rank") < k)
    if mixed is not None:
        top = top.join(mixed.select("query", "page_index").distinct(), ["query", "page_index"], "left_semi")
    return top.join(pages, "page_index", "left")


def default_scores(pages: Column, scores: Column, k: int) -> Column:
    """Scores of the first ``k`` pages; reciprocal ranks where there are none."""
    return F.transform(F.slice(pages, 1, k), lambda _, i: F.coalesce(F.get(scores, i), 1.0 / (i + 1)))


def context_rank(candidates: DataFrame, key: str) -> DataFrame:
    """Adds ``position``: by token overlap, then numbers hit, then page."""
    w = Window.partitionBy(key).orderBy(F.desc("n_overlap"), F.desc("n_numbers"), F.asc("page_index"))
    return candidates.withColumn("position", F.row_number().over(w))


def bucket_take(rows: DataFrame, bucket: str, order: list[str], most: int, key: str) -> DataFrame:
    """The first ``most`` rows by bucket priority (place in ``order``, others left out), then key; adds ``position``."""
    place = F.array_position(F.array(*[F.lit(b) for b in order]), F.col(bucket))
    top = rows.filter(place > 0).withColumn("_p", place).orderBy("_p", key).limit(most)
    return top.withColumn("position", F.row_number().over(Window.orderBy("_p", key))).drop("_p")  # at most so many rows


def snippets(lines: DataFrame, keys: list[str], around: int = 2, most: int = 18) -> DataFrame:
    """(keys, line_index, line): lines within ``around`` lines of one with a number, distinct, the first ``most`` of a page."""
    w = Window.partitionBy(*keys).orderBy("line_index")
    near = F.max(F.col("line").rlike(r"\d").cast("int")).over(w.rowsBetween(-around, around)) == 1
    kept = lines.withColumn("_near", near).filter("_near").drop("_near")
    first = kept.groupBy(*keys, "line").agg(F.min("line_index").alias("line_index"))
    return first.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).select(*keys, "line_index", "line")


def fresh_ids(rows: DataFrame, taken: DataFrame, prefix: str, by: list[str], order: list[Column]) -> DataFrame:
    """Adds ``new_id``: prefix and the next numbers of each group that ``taken`` (by, id) doesn't hold.

    The n-th row takes the n-th free number: that is n plus the taken numbers at or below it.
    """
    number = F.regexp_extract("id", f"^{prefix}_(\\d+)$", 1).try_cast("int")
    used = taken.select(*by, number.alias("_u")).filter("_u IS NOT NULL").distinct()
    # before the i-th taken number u (in order) lie u - i free numbers: the n-th free one comes after all taken numbers with fewer
    w = Window.partitionBy(*by).orderBy("_u")
    free = used.select(*by, (F.col("_u") - F.row_number().over(w)).alias("_at"), F.lit(1).alias("_taken"))
    n = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    # rows and taken numbers in one order: a taken number with as many free ones before it comes after the row of that rank
    both = n.withColumn("_taken", F.lit(0)).unionByName(free, allowMissingColumns=True)
    before = F.sum("_taken").over(Window.partitionBy(*by).orderBy("_at", "_taken"))
    out = both.withColumn("_skip", before).filter("_taken = 0")
    return out.withColumn("new_id", F.format_string(f"{prefix}_%03d", F.col("_at") + F.col("_skip"))).drop("_at", "_skip", "_taken")


def graph_pages(seeds: DataFrame, near: DataFrame, linked: DataFrame, structural: DataFrame, scores: DataFrame, k: int, only_scored: bool = False) -> DataFrame:
    """(query, page_index, score, position): seeds and the pages they reach, by three rules, the best score of each.

    Neighbours take 0.85 of the seed and 0.15 of their own artifact score, pages of linked anchors 0.80 and 0.20, structural pages
    0.50 of their original and 0.50 of their artifact score; with ``only_scored`` a structural page counts only if it has one. ``seeds`` and
    ``scores``: (query, page_index, score); ``near`` and ``linked``: (page_index, other); ``structural``: (query, page_index).
    """
    part = lambda base, share, must: [base.alias("_base"), F.lit(share).alias("_share"), F.lit(must).alias("_must")]

    def reach(steps, keep):
        return seeds.join(steps, "page_index").select("query", F.col("other").alias("page_index"), *part(keep * F.col("score"), 1 - keep, False))

    half = structural.join(seeds, ["query", "page_index"], "left").select("query", "page_index", *part(0.5 * F.coalesce("score", F.lit(0.0)), 0.5, only_scored))
    every = seeds.select("query", "page_index", *part(F.col("score"), 0.0, False)).union(reach(near, 0.85)).union(reach(linked, 0.80)).union(half)
    j = every.join(scores.select("query", "page_index", F.col("score").alias("_own")), ["query", "page_index"], "left").filter("NOT _must OR _own IS NOT NULL")
    best = j.groupBy("query", "page_index").agg(F.round(F.max(F.col("_base") + F.col("_share") * F.coalesce("_own", F.lit(0.0))), 4).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "page_index")
    return best.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def support(selected: DataFrame, key: str, dimensions: Column, said: str, numbers_needed: Column) -> DataFrame:
    """(key, n_numbers, missing, sufficient): whether the selected texts name all dimensions and enough distinct numbers.

    ``dimensions`` (array of strings) and ``numbers_needed`` are columns of ``selected`` that are the same for a key. Each dimension is
    looked for in each text by itself, so that no key's texts are gathered.
    """
    rows = selected.select(key, dimensions.alias("_d"), F.lower(said).alias("_said"), numbers_needed.alias("_n"))
    number = F.explode_outer(F.array_distinct(F.regexp_extract_all("_said", F.lit(r"\d+(?:\.\d+)?"), F.lit(0))))
    n = rows.select(key, "_n", number.alias("_x")).groupBy(key).agg(F.count_distinct("_x").alias("n_numbers"), F.first("_n").alias("_n"))
    named = rows.select(key, F.posexplode("_d").alias("_at", "_dim"), "_said").groupBy(key, "_at", "_dim").agg(F.max(F.contains("_said", F.lower("_dim"))).alias("_ok"))
    lost = named.groupBy(key).agg(F.array_sort(F.collect_list(F.when(~F.coalesce("_ok", F.lit(False)), F.struct("_at", "_dim")))).alias("_lost"))
    out = n.join(lost, key, "left").withColumn("missing", F.coalesce(F.transform("_lost", lambda x: x["_dim"]), F.array().cast("array<string>")))
    return out.select(key, "n_numbers", "missing", ((F.size("missing") == 0) & (F.col("n_numbers") >= F.col("_n"))).alias("sufficient"))


def noise_flags(pages: DataFrame, budget: int) -> DataFrame:
    """Adds flags: budget exceeded, ineligible present, duplicates, weak labels. ``pages`` has their counts."""
    flags = [("budget_exceeded", F.col("n") > budget), ("ineligible_present", F.col("n_ineligible") > 0), ("duplicates", F.col("n_duplicate") > 0), ("weak_quality", F.col("n_weak") > 0)]
    return pages.withColumn("flags", F.array_compact(F.array(*[F.when(ok, F.lit(k)) for k, ok in flags])))


def failure_bucket(retrieved: Column, artifact: Column, eligible: Column, answered: Column) -> Column:
    """The first stage at which a record failed."""
    return F.when(~retrieved, "page_not_retrieved").when(~artifact, "no_artifact_on_page").when(~eligible, "artifact_not_eligible").when(~answered, "not_answered").otherwise("ok")


def retrieval_text(kind: Column, modality: Column, content: Column, normalized: Column, sources: Column) -> Column:
    """What retrieval reads of an artifact: its filled fields, a line each."""
    return F.concat_ws("\n", *[F.when(present(c), c) for c in (kind, modality, content)], normalized, F.array_join(sources, "\n"))


def health(rows: DataFrame, types: str, flags: list[str]) -> DataFrame:
    """(type, n, counts of each flag) for each of a record's types."""
    return rows.select(F.explode(types).alias("type"), *flags).groupBy("type").agg(F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f) for f in flags])
