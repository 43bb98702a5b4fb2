"""Reports and gates: quality reports, expansion deltas, ablations, page scoring, answer rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import compact, present


def rate(ok: Column, total: Column) -> Column:
    """Share with a denominator of at least one."""
    return F.round(F.count_if(ok) / F.greatest(total, F.lit(1)), 6)


def quality_report(classified: DataFrame) -> DataFrame:
    """One row over artifacts with ``discard_reason``: sizes, per-page means, rates."""
    kept, n = F.col("discard_reason").isNull(), F.count("*")
    pages = F.count_distinct("doc_id", "page_index")
    return classified.agg(
        n.alias("n_artifacts"),
        F.count_distinct("doc_id").alias("n_docs"),
        pages.alias("n_pages"),
        F.count_if(kept).alias("n_kept"),
        rate(~kept, n).alias("discard_rate"),
        rate(F.col("source_anchored"), n).alias("anchored_rate"),
        rate(F.col("element_locatable"), n).alias("locatable_rate"),
        rate(F.col("proof_trace_eligible"), n).alias("proof_rate"),
        F.round(n / F.greatest(pages, F.lit(1)), 6).alias("artifacts_per_page"),
    )


def type_distribution(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows beyond the first of each key, and keys that have such."""
    c = rows.groupBy(*key).agg(F.count("*").alias("c"))
    return c.agg(F.coalesce(F.sum(F.greatest(F.col("c") - 1, F.lit(0))), F.lit(0)).alias("duplicates"), F.count_if(F.col("c") > 1).alias("keys"))


def expansion_delta(seeds: DataFrame, expanded: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: seeds, added items, ratio, and hit rates before and after, over all queries with seeds.

    Tables of (query, node); gold may lack queries, which then count as misses.
    """
    s = seeds.select("query", "node", F.lit(1).alias("seed"))
    e = expanded.select("query", "node").join(s, ["query", "node"], "left").join(gold.select("query", "node", F.lit(1).alias("gold")), ["query", "node"], "left")
    q = e.groupBy("query").agg(
        F.count("seed").alias("n_seed"), F.count("*").alias("n_all"), F.max(F.when(F.col("seed") == 1, F.col("gold"))).alias("before"), F.max("gold").alias("after")
    )
    hit = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(0))), 6)
    return q.agg(
        F.count("*").alias("n_queries"),
        F.sum("n_seed").alias("n_seeds"),
        F.sum(F.col("n_all") - F.col("n_seed")).alias("n_added"),
        F.round(F.sum("n_all") / F.greatest(F.sum("n_seed"), F.lit(1)), 6).alias("expansion_ratio"),
        hit("before").alias("hit_rate"),
        hit("after").alias("expanded_hit_rate"),
    )


def ablation(settings: dict[str, DataFrame]) -> DataFrame:
    """Delta reports of several settings as rows, the best gain first in ``rank``."""
    rows = reduce(DataFrame.unionByName, [r.withColumn("setting", F.lit(k)) for k, r in settings.items()])
    gain = F.round(F.col("expanded_hit_rate") - F.col("hit_rate"), 6)
    return rows.withColumn("gain", gain).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gain"), "setting")))  # one row a setting


def page_scores(artifacts: DataFrame, retrieval: DataFrame) -> DataFrame:
    """(doc_id, page_index, score): a clipped weighted sum of a page's artifact counts and its retrieval score."""
    of = lambda *t: F.count_if(F.col("artifact_type").isin(*t))
    a = artifacts.groupBy("doc_id", "page_index").agg(of("table_cell", "table").alias("n_table"), of("numeric_fact").alias("n_number"), of("figure", "caption").alias("n_figure"))
    score = 3 * F.least("n_table", F.lit(5)) + 2 * F.least("n_number", F.lit(5)) + F.least("n_figure", F.lit(3))
    j = a.join(retrieval.withColumnRenamed("score", "_r"), ["doc_id", "page_index"], "left")
    return j.select("doc_id", "page_index", F.round(score + F.coalesce("_r", F.lit(0.0)), 6).alias("score"))


def first_choice(candidates: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first candidate of each record; ``order`` starts with the reason's priority."""
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def coverage_matrix(questions: DataFrame, artifacts: DataFrame, on: list[str]) -> DataFrame:
    """(query, term, n_artifacts, n_pages): where each of a question's terms (``terms``) is found.

    Terms are joined to the tokens of artifacts, each token of an artifact once.
    """
    t = questions.select("query", *on, F.explode("terms").alias("term"))
    a = artifacts.select(*on, "artifact_id", "page_index", F.explode(F.array_distinct("tokens")).alias("term"))
    hit = t.join(a, [*on, "term"], "left")
    return hit.groupBy("query", "term").agg(F.count("artifact_id").alias("n_artifacts"), F.count_distinct("page_index").alias("n_pages"))


def gate(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: metrics that got worse, and whether none did. Both tables have one row."""
    b = before.select(*[F.col(m).alias(f"_b_{m}") for m in metrics])
    j = after.select(*metrics).crossJoin(F.broadcast(b))
    worse = F.array_compact(F.array(*[F.when(F.col(m) < F.col(f"_b_{m}"), F.lit(m)) for m in metrics]))
    return j.select(worse.alias("worse"), (F.size(worse) == 0).alias("passed"))


def short_answer(question: Column, content: Column) -> Column:
    """Extractive rules: a place for where-questions, else the first sentence, cut to 160 characters."""
    place = F.regexp_extract(content, r"(?i)\b(?:in|at) ((?:the )?[a-z]+)", 1)
    sentence = F.regexp_extract(content, r"(?s)^(.*?)(?:[.;!?]\s|$)", 1)
    return F.when(~present(content), F.lit(None)).when(F.lower(question).startswith("where") & (place != ""), place).otherwise(F.substring(F.trim(sentence), 1, 160))


def cleaned(text: Column) -> Column:
    """The first sentence of a compacted text, without marks at its end."""
    first = F.regexp_extract(compact(F.coalesce(text, F.lit(""))), r"(?s)^(.*?)(?:[.;!?]\s|$)", 1)
    return F.regexp_replace(F.trim(first), r"[.;]+$", "")


#: Where a text says that something is.
PLACES = [r"(?i)\bconceived\s+in\s+(?:the\s+)?([^.;\n]+)", r"(?i)\bwas\s+founded\s+in\s+(?:the\s+)?([^.;\n]+)", r"(?i)\bin\s+(?:the\s+)?([^.;\n]+)"]


def direct_answer(question: Column, primary: Column, evidence: Column) -> Column:
    """An answer taken from artifacts: the place for a where-question, the first artifact for a map or diagram that is there, for a short title,
    and otherwise; empty for a long title."""
    q, held = F.lower(question), F.lower(evidence)
    place = F.coalesce(*[F.nullif(cleaned(F.regexp_extract(evidence, p, 1)), F.lit("")) for p in PLACES])
    pictured = (q.contains("map") | q.contains("diagram")) & (held.contains("map") | held.contains("diagram"))
    words = F.size(F.split(compact(primary), " "))
    return (
        F.when(q.contains("where") & place.isNotNull(), place).when(pictured, cleaned(primary)).when(q.contains("title"), F.when(words <= 12, cleaned(primary)).otherwise("")).otherwise(cleaned(primary))
    )
