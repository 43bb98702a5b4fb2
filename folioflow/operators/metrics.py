"""Retrieval metrics and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(found: Column, gold: Column, k: int) -> Column:
    """1 if any of the first ``k`` is gold; 0 without gold."""
    return F.when(F.arrays_overlap(F.slice(found, 1, k), gold), 1.0).otherwise(0.0)


def coverage(found: Column, gold: Column, k: int) -> Column:
    """Share of distinct gold that is among the first ``k``; 0 without gold."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(F.slice(found, 1, k), g)) / F.size(g)).otherwise(0.0)


def with_gold(found: DataFrame, gold: DataFrame) -> DataFrame:
    """``found``: (query, item, rank); ``gold``: (query, item). (query, found, gold) as arrays, found in rank order."""
    lists = found.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("found"))
    want = gold.groupBy("query").agg(F.collect_set("item").alias("gold"))
    return lists.join(want, "query", "left").withColumn("gold", F.coalesce("gold", F.array().cast(lists.schema["found"].dataType)))


def macro(per_query: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """One row: mean recall and coverage over all queries, those without gold as zeros, and over those with gold."""
    has = F.size("gold") > 0
    aggs = [F.count("*").alias("n_queries"), F.count_if(has).alias("n_with_gold")]
    for k in ks:
        r, c = recall(F.col("found"), F.col("gold"), k), coverage(F.col("found"), F.col("gold"), k)
        aggs += [F.round(F.avg(r), 6).alias(f"recall_at_{k}"), F.round(F.avg(c), 6).alias(f"coverage_at_{k}")]
        aggs += [F.round(F.avg(F.when(has, r)), 6).alias(f"gold_recall_at_{k}")]
    return per_query.agg(*aggs)


def number_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("median"),
        F.round(F.min(v), 6).alias("low"), F.round(F.max(v), 6).alias("high"),
    )


def concentration(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, total, effective_number, top_share): 1 over the sum of squared shares, and the largest share."""
    c = df.groupBy(*by, key).agg(F.count("*").alias("c"))
    total = c.groupBy(*by).agg(F.sum("c").alias("total"), F.sum(F.col("c").cast("double") * F.col("c")).alias("squares"), F.max("c").alias("top"))
    return total.select(
        *by, "total", F.round(F.col("total") * F.col("total") / F.col("squares"), 6).alias("effective_number"), F.round(F.col("top") / F.col("total"), 6).alias("top_share")
    )


def top_counts(df: DataFrame, key: str, k: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)
