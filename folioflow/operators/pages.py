"""Pages: chunks, lines, routes, ranked page lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import compact, stripped

CHUNK = 1000


def chunks(pages: DataFrame, text: str = "text", size: int = CHUNK) -> DataFrame:
    """Adds (block_no, char_start, char_end, block_text): fixed-size pieces of each text.

    Offsets are those of the unstripped piece; blank pieces go, but the others keep their numbers.
    """
    n = F.ceil(F.length(text) / size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    out = pages.select("*", F.explode(at).alias("block_no"))
    piece = F.substring(F.col(text), F.col("block_no") * size + 1, F.lit(size))
    out = out.select(
        "*", (F.col("block_no") * size).alias("char_start"), (F.col("block_no") * size + F.length(piece)).alias("char_end"), stripped(piece).alias("block_text")
    )
    return out.filter("block_text <> ''")


def lines(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_index, char_start, char_end, line): non-blank lines, compacted, with offsets of their visible part."""
    parts = pages.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "raw"))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0))
    parts = parts.withColumn("line", compact(F.col("raw"))).withColumn("offset", offset).filter("line <> ''")
    lead = F.length("raw") - F.length(F.ltrim(F.col("raw")))
    seen = Window.partitionBy(*keys).orderBy("pos")
    return parts.select(
        *keys,
        (F.row_number().over(seen) - 1).alias("line_index"),
        (F.col("offset") + lead).cast("long").alias("char_start"),
        (F.col("offset") + F.length(F.rtrim(F.col("raw")))).cast("long").alias("char_end"),
        "line",
    )


def unpivot_ranked(records: DataFrame, keys: list[str], columns: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Ranked page lists as rows (keys, branch, rank, page_index, score).

    ``columns``: branch -> (pages column, scores column or None). A missing score is the reciprocal rank.
    """
    parts = None
    for branch, (pages, scores) in columns.items():
        score = F.col(scores) if scores else F.array().cast("array<double>")
        pair = F.posexplode(F.col(pages)).alias("rank", "page_index")
        one = records.select(*keys, F.lit(branch).alias("branch"), score.alias("_scores"), pair)
        one = one.withColumn("score", F.coalesce(F.get("_scores", F.col("rank")), 1.0 / (F.col("rank") + 1))).drop("_scores")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def routes(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page_index, routes): the branches that found a page, text before image."""
    order = F.transform(F.array_sort(F.collect_set(F.when(F.col("branch") == "text", "0text").otherwise(F.concat(F.lit("1"), F.col("branch"))))), lambda r: F.substring(r, 2, 20))
    return ranked.groupBy(*keys, "page_index").agg(order.alias("routes"))


def dedupe_ranked(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page_index, rank, duplicate_ranks): first rank of each page; all its ranks where there are several."""
    all_ranks = F.array_sort(F.collect_list("rank"))
    return ranked.groupBy(*keys, "page_index").agg(
        F.min("rank").alias("rank"), F.when(F.count("*") > 1, all_ranks).otherwise(F.array().cast("array<int>")).alias("duplicate_ranks")
    )


def bounded(refs: DataFrame, counts: DataFrame, doc: str, page: str) -> DataFrame:
    """Adds ``issue``: null for a page within its document, else out_of_range or unknown_document."""
    out = refs.join(counts.withColumnRenamed("n_pages", "_n"), doc, "left")
    issue = F.when(F.col("_n").isNull(), "unknown_document").when((F.col(page) < 0) | (F.col(page) >= F.col("_n")), "out_of_range")
    return out.withColumn("issue", issue).drop("_n")


def page_counts(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, n_pages, contiguous) from the page indices that exist."""
    top = F.max(page) + 1
    return pages.groupBy(doc).agg(top.alias("n_pages"), (F.count_distinct(page) == top).alias("contiguous"))


def contiguous_prefix(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Pages up to the first gap."""
    w = Window.partitionBy(doc).orderBy(page)
    return pages.withColumn("_n", F.row_number().over(w) - 1).filter(F.col(page) == F.col("_n")).drop("_n")


def preview(text: Column, n: int) -> Column:
    return F.substring(compact(text), 1, n)
