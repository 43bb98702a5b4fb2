"""Sharding (op10): a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order (id, checksum, size), nulls first. A keyed Feistel network permutes
[0, 4^k), the smallest such domain that holds N; a value that falls outside [0, N) is sent through
the network again until it falls inside. So shard = p mod n and slot = p div n can be computed for any row
number, and the inverse permutation finds the row of any (shard, slot), without reading data.

Law: ``rows``. Shard counts differ by at most one and slots are gapless from 0.

Defined results: a null text has no bytes (checksum 0); rows that agree in id, checksum and size are
interchangeable; an empty table gives no rows; only the three columns named are read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import materialize, partitions

ROUNDS = 6
SEED = 20260105
N_SHARDS = 24
_M64 = (1 << 64) - 1


def round_keys(seed: int = SEED, rounds: int = ROUNDS) -> list[int]:
    """A Weyl sequence with a multiply-xor finish."""
    keys, x = [], seed & _M64
    for _ in range(rounds):
        x = (x + 0x9E3779B97F4A7C15) & _M64
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M64
        keys.append(z ^ (z >> 29))
    return keys


def half_bits(n: int) -> int:
    """Bits of one half: the least k with 4^k >= n."""
    k = 1
    while 1 << (2 * k) < n:
        k += 1
    return k


def _mix(x: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    z = (x + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(key)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (z ^ (z >> np.uint64(29))) & mask


def _network(v: np.ndarray, k: int, keys: list[int]) -> np.ndarray:
    mask, shift = np.uint64((1 << k) - 1), np.uint64(k)
    left, right = v >> shift, v & mask
    for key in keys:
        left, right = right, left ^ _mix(right, key, mask)
    return (left << shift) | right


def _network_back(v: np.ndarray, k: int, keys: list[int]) -> np.ndarray:
    mask, shift = np.uint64((1 << k) - 1), np.uint64(k)
    left, right = v >> shift, v & mask
    for key in reversed(keys):
        left, right = right ^ _mix(left, key, mask), left
    return (left << shift) | right


def permute(rows: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The place of each row number below ``n``; with ``inverse`` the row number at each place."""
    keys, k = round_keys(seed), half_bits(n)
    step = _network_back if inverse else _network
    out = step(np.asarray(rows, dtype=np.uint64), k, keys)
    while True:
        outside = out >= np.uint64(n)
        if not outside.any():
            return out.astype(np.int64)
        out[outside] = step(out[outside], k, keys)


def number_rows(df: DataFrame, order: list[str], tag: str = "rows") -> tuple[DataFrame, list[int], str]:
    """Sort ``df`` by ``order`` over range partitions and freeze it, with (partition, place) as ``_at``.

    Returns the written table, the first row number of each partition, and the name of the place column.
    The driver only sees one count a partition.
    """
    n = partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, tag)
    counts = dict(placed.groupBy(F.shiftright("_at", 33).cast("int").alias("part")).count().collect())
    last = max(counts, default=-1)
    sizes = [counts.get(i, 0) for i in range(last + 1)]
    return placed, [0, *accumulate(sizes)], "_at"


def shard(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard and row_number for every row of ``docs``."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    meta = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed, first, at = number_rows(meta, ["doc_id", "text_crc32", "size"], "shards")
    total = first[-1]

    def place(batches):
        starts = np.asarray(first, dtype=np.int64)
        for b in batches:
            spot = b[at].to_numpy(dtype=np.int64)
            rows = starts[spot >> 33] + (spot & ((1 << 33) - 1))
            p = permute(rows, total, seed)
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"],
                    "size": b["size"],
                    "text_crc32": b["text_crc32"],
                    "law": "rows",
                    "shard": (p % n_shards).astype(np.int32),
                    "slot": p // n_shards,
                    "grown_shard": pd.array([None] * len(b), dtype="Int32"),
                    "row_number": rows,
                }
            )

    return placed.mapInPandas(
        place, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, row_number long"
    )


def oracle(n_shards: int = N_SHARDS, seed: int = SEED) -> str:
    """The same in SQL: checksums byte by byte, the network in 128-bit arithmetic, cycle walking by recursion."""
    m64 = "18446744073709551616::UHUGEINT"
    mult = f"{0xD6E8FEB86659FD93}::UHUGEINT"
    keys = ", ".join(f"({i}, {k}::UHUGEINT)" for i, k in enumerate(round_keys(seed)))
    first = f"xor((v.r + 1) * {mult} % {m64}, k.key)"
    second = f"(xor({first}, ({first}) >> 32) * {mult} % {m64})"
    return f"""
WITH RECURSIVE poly AS (SELECT i AS b, 0 AS step, i AS c FROM range(256) t(i) UNION ALL
    SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE step < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM poly WHERE step = 8),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
m AS (SELECT doc_id, CAST(len(h) // 2 + 8 AS BIGINT) AS size, xor(4294967295, list_reduce(list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32 FROM h, tab),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number FROM m),
c0 AS (SELECT count(*)::UHUGEINT AS n, CAST(greatest(1, ceil(ceil(log2(greatest(count(*), 2))) / 2)) AS INT) AS k FROM r),
c AS (SELECT n, k, (1::BIGINT << k)::UHUGEINT AS half FROM c0),
keys(i, key) AS (VALUES {keys}),
walk AS (SELECT row_number, 0 AS i, 1 AS lap, (row_number >> k)::UHUGEINT AS l, row_number::UHUGEINT % half AS r FROM r, c
  UNION ALL
  SELECT row_number, CASE WHEN again THEN 0 ELSE i END, lap, l, r FROM (
    SELECT v.row_number, v.i + 1 AS i, v.lap, v.r AS l, xor(v.l, xor({second}, {second} >> 29) % c.half) AS r,
      v.i = {ROUNDS - 1} AND v.r * c.half + xor(v.l, xor({second}, {second} >> 29) % c.half) >= c.n AS again
    FROM walk v JOIN keys k ON k.i = v.i, c)),
p AS (SELECT row_number, CAST(l * half + r AS BIGINT) AS p FROM walk, c WHERE i = {ROUNDS})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {n_shards} AS INT) AS shard, p // {n_shards} AS slot, CAST(NULL AS INT) AS grown_shard, row_number FROM r JOIN p USING (row_number)
"""
