"""A stored inverted index of passages, and the best passages of queries by skipping blocks of it.

Passages are sorted by (pool, item) and numbered; ``RANGE`` numbers make up a range, ``SEGMENT`` numbers a segment. The index has two tables:

- ``docs``: number, pool, item, length;
- ``blocks``: the postings of a term in a segment (of one pool; long texts make more than one block): gaps, counts, and for each range the number of its postings
  and their highest impact, under the statistics of their pool (``impact``) and of all pools (``impact_all``). Blocks lie where their passages were read, so
  building shuffles the texts once and nothing else. Each passage has one more posting, of the empty term, whose count is its length.

A search copies the blocks of its terms once. It sums its terms' highest impacts by range, from the blocks' heads alone. The postings of the best ``SEEDS``
ranges of a query are scored first; their k-th score tells which other ranges can hold one of the first k, and only these are scored. A segment's blocks
meet the queries that ask it in one task, of which only each query's first k passages leave. Scores are exact.

A query with a null or empty pool asks all passages, under the statistics of all. Defined results: null texts are passages without terms; queries
without terms find nothing but what fills up short lists; items of a pool must differ; empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import scoring
from folioflow.functions.text import tokens
from folioflow.operators.retrieval import ranked
from folioflow.sources.sinks import kept, prepare_output

RANGE, SEGMENT = 64, 4096
SEEDS = 8
#: Words that a task holds while it makes blocks, and queries that meet a segment in one task.
WORDS, BLOCK_QUERIES = 4_000_000, 2_000
_BLOCK = "pool string, term string, segment long, n int, heads array<struct<range:long,n:int,impact:double,impact_all:double>>, gaps binary, counts binary"


def _part(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _impact(tf: np.ndarray, length: np.ndarray, mean) -> np.ndarray:
    return tf * (scoring.K1 + 1) / (tf + scoring.K1 * (1 - scoring.B + scoring.B * length / mean))


def _cut(data: np.ndarray, width: int, n: np.ndarray) -> pa.Array:
    """Numbers as little-endian binaries of ``width`` bytes each, ``n`` of them a row."""
    ends = np.concatenate([[0], np.cumsum(n) * width]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data.astype(f"<u{width}"))])


def _blocks(held: list[pa.RecordBatch], everywhere: float) -> pa.RecordBatch:
    """The blocks of passages of one segment (number, pool, terms, length, mean), which lie in order."""
    t = pa.Table.from_batches(held).combine_chunks()
    number, length, mean = (t[c].to_numpy() for c in ("number", "length", "mean"))
    pools = t["pool"].chunk(0).dictionary_encode(null_encoding="encode")
    lists = t["terms"].chunk(0)
    words = lists.flatten().dictionary_encode()
    place = np.repeat(np.arange(len(number)), pc.list_value_length(lists).to_numpy())
    key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(number) + place, return_counts=True)
    n_words = len(words.dictionary)
    key = np.concatenate([key, n_words * len(number) + np.arange(len(number))])  # the empty term's, last
    tf = np.concatenate([tf, length])
    code, at = np.divmod(key, len(number))
    pool, number, length, mean = pools.indices.to_numpy()[at], number[at], length[at], np.where(mean == 0, 1.0, mean)[at]
    new = np.append(True, (np.diff(code) != 0) | (np.diff(pool) != 0))
    start, head = np.flatnonzero(new), np.flatnonzero(new | np.append(True, np.diff(number // RANGE) != 0))
    n, base = np.diff(np.append(start, len(key))), number[0] // SEGMENT * SEGMENT
    heads = [number[head] // RANGE, np.diff(np.append(head, len(key))).astype(np.int32), *(np.maximum.reduceat(_impact(tf, length, m), head) for m in (mean, everywhere))]
    heads = pa.StructArray.from_arrays([pa.array(x) for x in heads], ["range", "n", "impact", "impact_all"])
    heads = pa.ListArray.from_arrays(np.append(np.searchsorted(head, start), len(head)).astype(np.int32), heads)
    gaps = np.diff(number - base, prepend=0)
    gaps[start] = number[start] - base
    last = int(np.searchsorted(code[start], n_words))  # blocks of the empty term from here on
    cut = start[last] if last < len(start) else len(key)
    width = next(w for w in (1, 2, 4) if tf[:cut].max(initial=0) < 1 << 8 * w)
    counts = pa.concat_arrays([_cut(tf[:cut], width, n[:last]), _cut(tf[cut:], 4, n[last:])])
    terms = pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([""], pa.string())]).take(pa.array(code[start]))
    held_by = pools.dictionary.cast(pa.string()).take(pa.array(pool[start]))
    columns = [held_by, terms, pa.array(np.full(len(start), base // SEGMENT)), pa.array(n.astype(np.int32)), heads, _cut(gaps, 2, n), counts]
    return pa.RecordBatch.from_arrays(columns, ["pool", "term", "segment", "n", "heads", "gaps", "counts"])


def build(passages: DataFrame, folder: str) -> None:
    """Write the index of ``passages`` (pool, item, text) to ``folder``. Texts are dealt out and sorted once."""
    spark = passages.sparkSession
    docs = passages.select(F.col("pool").cast("string").alias("pool"), "item", "text").repartitionByRange(_part(spark), "pool", "item").sortWithinPartitions("pool", "item")
    docs = docs.select(F.monotonically_increasing_id().alias("number"), "pool", "item", tokens(F.coalesce("text", F.lit(""))).alias("terms")).withColumn("length", F.size("terms"))
    docs.write.parquet(f"{folder}/sorted")
    docs = spark.read.schema(docs.schema).parquet(f"{folder}/sorted")
    docs.select("number", "pool", "item", "length").write.parquet(f"{folder}/docs")
    docs.groupBy(F.col("pool").alias("_pool")).agg(F.avg("length").alias("mean")).write.parquet(f"{folder}/means")
    means = spark.read.parquet(f"{folder}/means")  # a file whose size Spark knows: few pools are broadcast, and the passages stay where they lie
    everywhere = docs.agg(F.avg("length")).first()[0] or 1.0

    def write(batches):
        held, at, size = [], None, 0
        for b in batches:
            segment = b.column("number").to_numpy() // SEGMENT
            words = np.cumsum(b.column("length").to_numpy(), dtype=np.int64) // WORDS
            for a, z in pairwise([0, *(np.flatnonzero((np.diff(segment) != 0) | (np.diff(words) != 0)) + 1), len(segment)]):
                if a == z:
                    continue
                if held and (segment[a] != at or size > WORDS):
                    yield _blocks(held, everywhere)
                    held, size = [], 0
                at, part = segment[a], b.slice(a, z - a)
                held.append(part)
                size += pc.sum(part.column("length")).as_py()
        if held:
            yield _blocks(held, everywhere)

    wide = docs.join(means, F.col("pool").eqNullSafe(F.col("_pool"))).select("pool", "number", "terms", "length", "mean").sortWithinPartitions("number")
    wide.mapInArrow(write, _BLOCK).write.parquet(f"{folder}/blocks")
    prepare_output(spark, folder, ["sorted"], [])


def statistics(spark: SparkSession, folder: str) -> DataFrame:
    """(pool, n, mean_length) of each pool, and of all passages under a null pool."""
    by_pool = spark.read.parquet(f"{folder}/docs").groupBy("pool").agg(F.count("*").alias("n"), F.sum("length").alias("total"))
    every = by_pool.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select(F.lit(None).cast("string").alias("pool"), "n", "total")
    return by_pool.filter("pool IS NOT NULL").unionByName(every).select("pool", "n", (F.col("total") / F.col("n")).alias("mean_length"))


class Search:
    """The steps of a search, for its result and for counts of what it reads.

    Blocks of its terms, terms with their statistics, bounds of ranges and the scores of the first ranges are written to the shared folder between the steps; all
    grow with the queries.
    """

    def __init__(self, spark: SparkSession, folder: str, queries: DataFrame, k: int, allowed: DataFrame | None = None):
        """``queries``: (query, pool, text), a pool that is null or empty meaning all; ``allowed``: (query, item), for queries that are bound to a list."""
        self.folder, self.k = folder, k
        self.docs = spark.read.parquet(f"{folder}/docs")
        pool = F.col("pool").cast("string")
        self.queries = queries.select("query", F.when(pool != "", pool).alias("pool"), "text")
        words = self.queries.select("query", F.coalesce("pool", F.lit("")).alias("pool"), F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term"))
        words = kept(words.groupBy("query", "pool", "term").agg(F.count("*").alias("qtf")), "words")  # pool "" means all from here on
        wanted = kept(words.select("pool", "term").union(words.select("pool", F.lit(""))).distinct(), "wanted")
        held = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks").withColumnsRenamed({"pool": "_pool", "term": "_term"})
        same = (F.col("term") == F.col("_term")) & ((F.col("pool") == "") | (F.col("pool") == F.col("_pool")))
        self.blocks = kept(wanted.join(held, same).drop("_pool", "_term"), "asked-blocks")
        df = words.join(self.blocks.groupBy("pool", "term").agg(F.sum("n").alias("df")), ["pool", "term"])
        stats = statistics(spark, folder).select(F.coalesce("pool", F.lit("")).alias("pool"), "n", "mean_length")
        idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.asked = kept(df.join(stats, "pool").withColumn("weight", F.col("qtf") * idf), "asked")
        heads = self.asked.select("query", "pool", "term", "weight").join(self.blocks.select("pool", "term", "heads"), ["pool", "term"]).select("query", "pool", "weight", F.explode("heads").alias("h"))
        impact = F.when(F.col("pool") == "", F.col("h.impact_all")).otherwise(F.col("h.impact"))
        self.ranges = heads.groupBy("query", F.col("h.range").alias("range")).agg(F.sum(F.col("weight") * impact).alias("bound"), F.sum("h.n").alias("held"))
        every = F.lit(-1).cast("long").alias("mask")
        if allowed is None:
            self.ranges = self.ranges.select("*", every)
        else:  # a list becomes one number a range, whose bits are its passages
            known = allowed.join(self.queries, "query").join(self.docs.select("number", F.col("pool").alias("_pool"), "item"), "item").filter("pool IS NULL OR pool = _pool")
            bit = F.expr(f"shiftleft(1L, CAST(number % {RANGE} AS INT))")
            masks = known.groupBy("query", F.floor(F.col("number") / RANGE).cast("long").alias("range")).agg(F.bit_or(bit).alias("mask"))
            own = self.ranges.join(masks, ["query", "range"])
            self.ranges = own.unionByName(self.ranges.join(allowed.select("query").distinct(), "query", "left_anti").select("*", every))
        self.ranges = kept(self.ranges, "ranges")
        self.seeds = ranked(self.ranges, ["query"], [F.desc("bound"), F.asc("range")], SEEDS, "_seed").drop("bound", "_seed")

    def scores(self, ranges: DataFrame, k: int | None = None) -> DataFrame:
        """(query, number, score) of the passages in the ranges (query, range, mask); of each segment a query's first ``k`` if there are more."""
        parts = -(-self.asked.select("query").distinct().count() // BLOCK_QUERIES)
        block = (F.pmod(F.xxhash64("query"), F.lit(max(1, parts))) * 2 + (F.col("pool") == "").cast("int")).alias("_b")
        terms = self.asked.groupBy("query", "pool", "mean_length").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
        wide = F.floor(F.col("range") / (SEGMENT // RANGE)).cast("long").alias("segment")
        need = ranges.groupBy("query", wide).agg(F.collect_list(F.struct("range", "mask")).alias("r"))
        right = need.join(terms, "query").select("segment", block, "query", "pool", "mean_length", "t.term", "t.weight", "r.range", "r.mask")
        wanted = self.asked.select("pool", "term", block)
        wanted = wanted.union(wanted.select("pool", F.lit(""), "_b")).distinct()
        left = self.blocks.drop("heads").join(wanted, ["pool", "term"]).join(right.select("segment", "_b").distinct(), ["segment", "_b"], "left_semi")

        def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query": right["query"][:0], "number": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
            if not len(left) or not len(right):
                return out[0]
            segment = int(left["segment"].iloc[0])
            posts, lengths = defaultdict(list), np.zeros(SEGMENT)
            for pool, term, n, gaps, counts in zip(left["pool"], left["term"], left["n"], left["gaps"], left["counts"], strict=True):
                place = np.cumsum(np.frombuffer(gaps, "<u2"), dtype=np.int64)
                tf = np.frombuffer(counts, f"<u{len(counts) // n}").astype(np.float64)
                if term:
                    posts[pool, term].append((place, tf))
                else:
                    lengths[place] = tf
            impacts: dict[tuple, list] = {}
            for query, pool, mean, words, weights, ranges_, masks in zip(*(right[c] for c in ("query", "pool", "mean_length", "term", "weight", "range", "mask")), strict=True):
                total, hit = np.zeros(SEGMENT), np.zeros(SEGMENT, bool)
                for word, weight in zip(words, weights, strict=True):
                    if (pool, word) not in impacts:
                        impacts[pool, word] = [(place, _impact(tf, lengths[place], mean or 1.0)) for place, tf in posts.get((pool, word), ())]
                    for place, x in impacts[pool, word]:
                        total[place] += weight * x
                        hit[place] = True
                of = np.zeros((SEGMENT // RANGE, RANGE), bool)
                of[np.asarray(ranges_) - segment * (SEGMENT // RANGE)] = np.asarray(masks)[:, None] >> np.arange(RANGE) & 1
                at = np.flatnonzero(hit & of.ravel())
                s = np.round(total[at], 6)
                if k is not None and len(at) > k:  # all that tie with the k-th are sorted, so that ties go to the lesser number
                    some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                    some = some[np.argsort(-s[some], kind="stable")][:k]
                    at, s = at[some], s[some]
                out.append(pd.DataFrame({"query": np.full(len(at), query), "number": segment * SEGMENT + at, "score": s}))
            return pd.concat(out[1:])

        keys = ["segment", "_b"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, f"query {dict(self.asked.dtypes)['query']}, number long, score double")

    def reached(self) -> tuple[DataFrame, DataFrame]:
        """(scores of the seeds' passages, the other ranges that can hold one of the first k)."""
        first = kept(self.scores(self.seeds, self.k), "scores")
        least = ranked(first, ["query"], [F.desc("score"), F.asc("number")], self.k, "_r").filter(F.col("_r") == self.k).select("query", F.col("score").alias("least"))
        rest = self.ranges.join(self.seeds.select("query", "range"), ["query", "range"], "left_anti").join(least, "query", "left")
        return first, rest.filter(F.col("least").isNull() | (F.col("bound") + 1e-6 >= F.col("least"))).select("query", "range", "held", "mask")

    def top(self) -> DataFrame:
        """(query, item, score, rank) of passages with a score."""
        first, rest = self.reached()
        best = ranked(first.unionByName(self.scores(rest, self.k)), ["query"], [F.desc("score"), F.asc("number")], self.k)
        return best.join(self.docs.select("number", "pool", "item"), "number").select("query", "item", "pool", "score", "rank")

    def share_read(self) -> DataFrame:
        """One row: postings of the asked terms, and those in the ranges that a search reads."""
        _, rest = self.reached()
        read = self.seeds.unionByName(rest).agg(F.sum("held").alias("postings_read"))
        return self.ranges.agg(F.sum("held").alias("postings")).crossJoin(read)  # one row each


def top_k(spark: SparkSession, folder: str, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query, item, pool, score, rank) of the best passages that have a score."""
    return Search(spark, folder, queries, k, allowed).top()


def top_k_filled(spark: SparkSession, folder: str, queries: DataFrame, k: int) -> DataFrame:
    """(query, item, score, rank); passages without a score fill up short lists of queries with a pool, least item first."""
    s = Search(spark, folder, queries, k)
    found = s.top().select("query", "item", "score")
    least = ranked(s.docs.select("pool", "item"), ["pool"], [F.col("item")], 2 * k, "_n")
    fill = s.queries.filter("pool IS NOT NULL").select("query", "pool").join(least, "pool").select("query", "item", F.lit(0.0).alias("score"))
    best = found.unionByName(fill).groupBy("query", "item").agg(F.max("score").alias("score"))
    return ranked(best, ["query"], [F.desc("score"), F.asc("item")], k)
