"""Importance resampling towards a target distribution (op12).

Texts become counts of hashed features: runs of up to ``longest`` words, their checksum modulo ``buckets``. A bucket's gain is
the logarithm of its share in the target over its share in the corpus; a document's weight is the floored mean of its features'
gains, looked up in an array. Gumbel noise from a hash of its id is added, so that the highest scores are a draw
without replacement that any run repeats.

The drawn rows are found by radix selection: the composite key (score falling, doc_id rising, then what tells equal rows apart) is read
digit by digit; each pass counts the rows that agree with the digits found so far by their next digit, until the k-th key is
known exactly. The driver sees at most ``2**DIGIT`` counts a pass. Only rows up to that key are range-sorted and ranked.

Defined results: null and empty texts have no features and weight 0; a null id is hashed as the word ``null`` and comes after all
ids among equal scores; rows that share id and score are told apart by feature count, then by their place in the written
table of scores, and each gets a rank of its own; an empty table gives no rows, an empty target gains from smoothing alone; other columns are
not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_batches, materialize
from folioflow.llm.shards import number_rows
from folioflow.llm.words import words

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Bits of the key that one pass of the selection reads.
DIGIT = 12
_LEAST = -(1 << 63)
_M64 = (1 << 64) - 1


def features(text: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """(words, bucket of every feature) of a UTF-8 text."""
    n, out, tail = 0, [], []
    for some in words(text):
        n += len(some)
        run = tail + some
        out.append(np.fromiter(map(zlib.crc32, some), np.uint32, len(some)))
        for size in range(2, longest + 1):
            fresh = run[max(0, len(tail) - size + 1) :]
            grams = map(b" ".join, zip(*(fresh[i:] for i in range(size)), strict=False))
            out.append(np.fromiter(map(zlib.crc32, grams), np.uint32))
        tail = run[len(run) - longest + 1 :] if longest > 1 else []
    return n, np.concatenate(out) % buckets if out else np.zeros(0, np.uint32)


def bucket_counts(texts: DataFrame, text_col: str, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket over all texts; each task sends one row a bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b["text"]:
                total += np.bincount(features(text, longest, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    bounded_batches(texts.sparkSession)
    rows = texts.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInPandas(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, size = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weighted(docs: DataFrame, text_col: str, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """``docs`` with n_words, n_features and weight."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        known, rows = shipped.value, []
        for text in texts:
            n, at = features(text, longest, len(known))
            rows.append((n, len(at), int(known[at].sum()) // len(at) if len(at) else 0))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    w = docs.withColumn("_w", weigh(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return w.select(*[F.col(f"`{c}`") for c in docs.columns], "_w.n_words", "_w.n_features", "_w.weight")


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the hash of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


# ---- radix selection -----------------------------------------------------------------------------


def bits(value: Column, falling: bool = False) -> Column:
    """A long whose bits, read without a sign, are in the order of ``value``."""
    u = value.cast("long").bitwiseXOR(F.lit(_LEAST))
    return F.bitwise_not(u) if falling else u


def _prefix(u: Column, shift: int) -> Column:
    """The bits above ``shift`` as a long that compares as they do."""
    return F.shiftrightunsigned(u, shift) if shift else u.bitwiseXOR(F.lit(_LEAST))


def _spelled(prefix: int, shift: int) -> int:
    return prefix if shift else prefix + _LEAST


def kth_key(rows: DataFrame, key: list[Column], k: int) -> list[tuple[Column, int, int]]:
    """The k-th least key of ``rows``, as (part of the key, shift, bits above it); ``k`` is at least 1 and at most the number of rows.

    Each pass counts rows by their next digit. It ends early where all rows that agree so far belong to the first k.
    """
    found: list[tuple[Column, int, int]] = []
    for u in key:
        ends = rows.agg(F.min(_prefix(u, 0)), F.max(_prefix(u, 0))).first()
        low, high = ends[0] - _LEAST, ends[1] - _LEAST
        shift = (low ^ high).bit_length()
        prefix = low >> shift
        while shift:
            width = min(DIGIT, shift)
            shift -= width
            digit = F.shiftrightunsigned(u, shift).bitwiseAND(F.lit((1 << width) - 1))
            within = _prefix(u, shift + width) == _spelled(prefix, shift + width) if shift + width < 64 else F.lit(True)
            counts = rows.filter(within).groupBy(digit.cast("int").alias("digit")).count().collect()
            for d, n in sorted((r["digit"], r["count"]) for r in counts):
                if k <= n:
                    break
                k -= n
            prefix = prefix << width | d
            if k == n:
                return [*found, (u, shift, prefix)]
        found.append((u, 0, prefix))
        rows = rows.filter(_prefix(u, 0) == _spelled(prefix, 0))
    return found


def up_to(cut: list[tuple[Column, int, int]]) -> Column:
    """Whether a row's key is at most the one that :func:`kth_key` found."""
    out = F.lit(True)
    for u, shift, prefix in reversed(cut):
        if shift < 64:
            at, edge = _prefix(u, shift), _spelled(prefix, shift)
            out = (at < edge) | ((at == edge) & out)
    return out


def drawn(scored: DataFrame, id_col: str, percent: int, least_words: int) -> DataFrame:
    """``scored`` (id, n_words, n_features, weight, score), which must be a written table, with ``rank``."""
    kept = F.col("n_words") >= least_words
    k = scored.filter(kept).count() * percent // 100
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    i = F.col(id_col)
    key = [bits(F.col("score"), falling=True), bits(i.isNull().cast("int")), bits(F.coalesce(i, F.lit(0))), bits(F.col("n_features")), bits(F.col("_uid"))]
    inside = kept & up_to(kth_key(scored.filter(kept), key, k))
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("n_features"), F.asc("_uid")]
    placed, first, at = number_rows(scored.filter(inside), order, "drawn")
    starts = scored.sparkSession.createDataFrame(list(enumerate(first)), "_part int, _first long")  # a row a partition
    placed = placed.withColumn("_part", F.shiftright(at, 33).cast("int")).join(F.broadcast(starts), "_part")
    placed = placed.withColumn("rank", F.col("_first") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_first", at)
    return placed.unionByName(scored.filter(~inside).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; drawn rows are those with a rank."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(read, "text", longest, buckets), bucket_counts(target, target_col, longest, buckets))
    scored = weighted(read, "text", gain, longest).drop("text")
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("_uid", F.monotonically_increasing_id())
    return drawn(materialize(scored, "scored"), "doc_id", percent, least_words).drop("_uid")


_POLY = """poly AS (SELECT i AS b, 0 AS step, i AS c FROM range(256) t(i) UNION ALL
    SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE step < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM poly WHERE step = 8)"""
_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle(percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> str:
    """The same in SQL: checksums byte by byte, one window for the ranks."""
    return f"""
WITH RECURSIVE {_POLY},
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY ALL),
h AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
c AS (SELECT w, xor(4294967295, list_reduce(list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) % {buckets} AS b FROM h, tab),
s AS (SELECT b, sum(n) AS s FROM dw JOIN c USING (w) GROUP BY b), t AS (SELECT b, sum(n) AS t FROM bw JOIN c USING (w) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + {buckets})::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {buckets})::DOUBLE))) AS gain FROM s FULL JOIN t USING (b)),
m AS (SELECT doc_id, floor(sum(n * gain) / sum(n)) AS weight FROM dw JOIN c USING (w) JOIN g USING (b) GROUP BY doc_id),
k AS (SELECT doc_id, len(ws) AS n_words, len(ws) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{seed}:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM k WHERE n_words >= {least_words})
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN rank <= {percent} * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM k LEFT JOIN r USING (doc_id)"""
