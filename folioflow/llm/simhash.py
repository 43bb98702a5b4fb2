"""SimHash near-duplicates (op7): fingerprints linked at few differing bits, with pivot distance tables.

A fingerprint has bit i set if over half of the text's shingle hashes have it set. Equal fingerprints
are first merged to one node (its least id), so copies of a text never meet each other in a task.

Pivots: each fingerprint's Hamming distances to ``N_PIVOTS`` reference fingerprints are tabulated; by the triangle
inequality a pair whose tables differ by more than the radius in any coordinate can't be near and is discarded; the
rest are verified by counting bits. Distances of random fingerprints all lie around half their bits, so tables
discard pairs but can't deal the pairs out. That is done by runs of bits: 64 bits are cut into m runs; two fingerprints
that differ in at most RADIUS bits agree in m - RADIUS whole runs, so each node is dealt under every choice of as
many. m follows from the number of nodes (:func:`runs_for`), so that a bucket of unlike nodes holds one or two at
any size. A large bucket is walked from node to node and yields a spanning tree of its links, not all pairs; one
above ``HOT`` nodes is cut into chunks, and every two chunks meet in a task of their own.

:mod:`folioflow.llm.simhash_similar` holds texts against a similarity of word shingles in place of a radius.

Defined results: a null or blank text has fingerprint zero, which links like any other; texts with fewer words
than a shingle are one shingle; repeated rows get equal results; a row without an id is never a component's name;
columns other than id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm import in_place
from folioflow.llm.common import bounded_batches, materialize, partitions, release
from folioflow.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
N_PIVOTS = 16
SMALL = 12
HOT = 50_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: a fixed multiplicative sequence, its bits mixed."""
    x = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)), dtype="<u8", count=n)
    set_bits = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        part = h[i : i + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, fp long")


def runs_for(n: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest runs whose keys, of all but ``radius`` runs, have as many bits as ``n`` has."""
    m = radius + 1
    while 64 // m * (m - radius) < n.bit_length() and m < 4 * radius:
        m += 1
    at = [i * 64 // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _keys(runs: list[tuple[int, int]], radius: int = RADIUS) -> list[Column]:
    """One key for each choice of runs: the choice's number above the runs' bits."""
    out = []
    for i, chosen in enumerate(combinations(runs, len(runs) - radius)):
        key, at = [], 0
        for first, width in chosen:
            key.append(f"shiftleft(shiftrightunsigned(fp, {first}) & {(1 << width) - 1}L, {at})")
            at += width
        out.append(F.expr(" | ".join([f"shiftleft({i}L, {at})", *key])))
    return out


def _near(table: np.ndarray, fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) are within the radius: by pivot tables, then by bits."""
    keep = np.arange(len(i))
    for k in range(0, table.shape[1], 4):
        keep = keep[np.abs(table[i[keep], k : k + 4] - table[j[keep], k : k + 4]).max(axis=1) <= RADIUS] if len(keep) else keep
    return keep[np.bitwise_count(fps[i[keep]] ^ fps[j[keep]]) <= RADIUS]


def _walk(table: np.ndarray, fps: np.ndarray, wide: int = 1 << 20):
    """(i, j) of a spanning tree of the links among ``fps``: each unseen node is compared once with each reached one."""
    unseen, frontier = np.arange(len(fps)), np.zeros(0, dtype=np.int64)
    while len(unseen):
        if not len(frontier):
            frontier, unseen = unseen[:1], unseen[1:]
        reached = []
        step = max(1, wide // max(1, len(unseen)))
        some, frontier = frontier[:step], frontier[step:]
        i, j = np.repeat(some, len(unseen)), np.tile(unseen, len(some))
        hit = _near(table, fps, i, j)
        if len(hit):
            new, at = np.unique(j[hit], return_index=True)
            yield i[hit][at], new
            reached.append(new)
            unseen = np.setdiff1d(unseen, new, assume_unique=True)
        frontier = np.concatenate([frontier, *reached])


def link_buckets(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked nodes (a, b) of rows sorted by bucket key."""
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int16)
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[head, len(keys)])
    a, b = [], []
    small = np.repeat(size <= SMALL, size)
    for lag in range(1, SMALL):
        i = np.flatnonzero((keys[:-lag] == keys[lag:]) & small[:-lag]) if lag < len(keys) else np.zeros(0, dtype=np.int64)
        if not len(i):
            break
        hit = i[_near(table, fps, i, i + lag)]
        a.append(nodes[hit])
        b.append(nodes[hit + lag])
    for h in np.flatnonzero(size > SMALL):
        s = slice(head[h], head[h] + size[h])
        for i, j in _walk(table[s], fps[s]):
            a.append(nodes[s][i])
            b.append(nodes[s][j])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _linker(batches):
    """Over batches sorted by key: holds back the last key's rows until the next key begins."""
    held = None
    for b in batches:
        rows = [b[c].to_numpy() for c in ("key", "fp", "node")]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        held = [x[cut:] for x in rows]
        if cut:
            a, c = link_buckets(rows[0][:cut], rows[1][:cut].view(np.uint64), rows[2][:cut])
            yield pd.DataFrame({"a": a, "b": c})
    if held is not None:
        a, c = link_buckets(held[0], held[1].view(np.uint64), held[2])
        yield pd.DataFrame({"a": a, "b": c})


def _split_hot(keyed: DataFrame, hot_size: int) -> DataFrame:
    """Rows of buckets above ``hot_size`` under one key for each two of their chunks."""
    hot = keyed.groupBy("key").count().filter(F.col("count") > hot_size)
    hot = materialize(hot.select("key", F.ceil(F.col("count") / hot_size).cast("int").alias("chunks")), "hot")
    if hot.isEmpty():
        return keyed
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    all_rows = keyed.join(hot, "key", "left")
    meets = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    cut = all_rows.filter("chunks IS NOT NULL").select("key", "fp", "node", own.alias("own"), meets.alias("other"))
    new_key = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return all_rows.filter("chunks IS NULL").select("key", "fp", "node").unionByName(cut.select(new_key.alias("key"), "fp", "node"))


def links(nodes: DataFrame, hot_size: int = HOT) -> DataFrame:
    """``nodes``: (fp, node) with each fingerprint once. Edges (a, b) that connect all nodes within the radius."""
    spark = nodes.sparkSession
    keyed = nodes.select(F.explode(F.array(*_keys(runs_for(nodes.count())))).alias("key"), "fp", "node")
    keyed = _split_hot(keyed, hot_size)
    dealt = keyed.repartition(partitions(spark), "key").sortWithinPartitions("key")
    return dealt.mapInPandas(_linker, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_size: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id of the component) of every row of ``docs``."""
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    names = components(links(nodes.filter("node IS NOT NULL"), hot_size))
    named = nodes.join(names, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    named = materialize(named, "names")
    release(nodes, names)
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(no_id, id, _file, _row, text) of readable ``docs``: what orders rows is their id, rows without one last, and their place, which names them."""
    rows = in_place.placed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.select(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), in_place.FILE, in_place.ROW, "text")


def keep_one(docs: DataFrame, rows: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of ``docs`` (readable) without those that are not the least of their component.

    ``rows``: node, no_id, id, _file, _row of every row; ``names``: (node, component) of linked nodes. Texts stay where
    they lie: what is dropped is marked in place.
    """
    by = ["no_id", "id", in_place.FILE, in_place.ROW]
    least = rows.groupBy("node").agg(F.min(F.struct(*by)).alias("least"), F.count("*").alias("n"))
    whole = least.join(names, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = whole.groupBy("component").agg(F.min("least").alias("first"), F.sum("n").alias("of")).filter("of > 1")
    first = materialize(whole.join(first, "component").select("node", *[F.col(f"first.{c}").alias(f"first{c}") for c in (in_place.FILE, in_place.ROW)]), "first")
    gone = rows.select("node", in_place.FILE, in_place.ROW).join(first, "node").filter(f"NOT ({in_place.FILE} = first_file AND {in_place.ROW} = first_row)")
    folder = in_place.write_marks(gone.select(in_place.FILE, in_place.ROW, F.lit(1).cast("long").alias("mark")), "gone")
    release(first)
    # under names of its own, as the columns may have any
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kept = in_place.placed(plain).withColumn("_gone", in_place.mark(folder)).filter("_gone IS NULL")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``: that with the least id, rows without one last; of rows that share it, one."""
    bounded_batches(docs.sparkSession)
    docs = in_place.readable(docs)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield b.drop(columns="text").assign(node=fp)

    rows = materialize(keyed_rows(docs, id_col, text_col).mapInPandas(run, "no_id boolean, id long, _file string, _row long, node long"), "rows")
    nodes = materialize(rows.select("node").distinct(), "nodes")
    return keep_one(docs, rows, components(links(nodes.select(F.col("node").alias("fp"), "node"))))
