"""SimHash near-duplicates held against a similarity (op7 in the pipeline): five-word shingles, Jaccard 0.8 or more.

Texts with one set of shingles are first merged to one node, named by the set's digest.

Candidates: at this similarity two texts of a thousand words differ in some 10 of 64 bits of their fingerprints, and in
up to 20, so runs of bits that both share are too short to deal nodes out: a choice of 24 bits would take some
300 tables to miss one pair in a hundred. Nodes are therefore dealt by ``BANDS`` bands of ``ROWS`` least hashes each; a pair
at similarity 0.8 shares no band with probability (1 - 0.8^4)^32 < 1e-7, a nearer one with less. Nodes of a band's
bucket are tied to its least one, and each group so tied meets in a task.

Pivots: within a group each node of ``LEAST`` shingles or more has a fingerprint of ``BITS`` bits. Its distances to reference
fingerprints, taken from the group itself, are tabulated: a copy lies near a reference where others lie at half
the bits, so that the tables tell them apart. Pairs whose tables differ by more than ``RADIUS`` in any coordinate are
discarded, then those whose fingerprints do; survivors are verified by comparing their sets. A pair at similarity
0.8 differs in 39 of 256 bits (deviation 6): beyond the radius with probability < 1e-7. The comparison is a walk that
yields a spanning tree of the links. A group above ``CHUNK`` shingles is cut into chunks, and every two chunks meet
in a task of their own.

Defined results: words are split at white space after lower-casing; texts with fewer words than a shingle are one
shingle; null and blank texts are copies of each other; rows without an id or with a shared one are rows like others;
an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import in_place
from folioflow.llm.common import bounded_batches, free, materialize, partitions
from folioflow.llm.components import components
from folioflow.llm.simhash import keep_one, keyed_rows

SHINGLE = 5
BANDS = 32
ROWS = 4
CHUNK = 1 << 18
SEED = 7
BITS = 256
RADIUS = 72
LEAST = 64
N_PIVOTS = 8
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the text's distinct shingles."""
    import xxhash

    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)), dtype=np.uint64, count=n))


def set_name(hashes: np.ndarray) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(hashes.tobytes())
    return x - (1 << 64) if x >> 63 else x


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band: its number and its least hashes, mixed."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), 1 << 11):
        least = np.minimum(least, (hashes[None, i : i + (1 << 11)] * _ODD[:, None]).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``BITS`` bits as 64-bit words: each set where it is set in over half of the hashes, mixed anew for each word."""
    count = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 12):
        x = hashes[i : i + (1 << 12), None] * _ODD[None, : BITS // 64]
        x ^= x >> np.uint64(32)
        x *= _MIX
        count += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * count > len(hashes)).view(np.uint64)


def _signed(batches):
    free()
    for b in batches:
        sets = [shingle_set(t) for t in b["text"]]
        keys = [band_keys(s) if len(s) else [] for s in sets]
        yield b.drop(columns="text").assign(node=np.array([set_name(s) for s in sets], dtype=np.int64), n=np.array([len(s) for s in sets], dtype=np.int64), keys=keys)


def _ties(batches):
    """Over (key, node) sorted by both: (a, b) of each node and the least of its bucket."""
    last = None
    for b in batches:
        key, node = b["key"].to_numpy(), b["node"].to_numpy()
        if not len(key):
            continue
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = node[head]
        if last is not None and last[0] == key[0]:
            least[0] = last[1]
        last = key[-1], least[-1]
        least = np.repeat(least, np.diff(np.r_[head, len(key)]))
        yield pd.DataFrame({"a": least[least != node], "b": node[least != node]})


class Pivots:
    """Fingerprints of a group and their distances to some of them, each reference far from those before."""

    def __init__(self, sets: list[np.ndarray]):
        self.checked = np.array([len(s) >= LEAST for s in sets])
        self.fps = np.stack([fingerprint(s) if c else np.zeros(BITS // 64, dtype=np.uint64) for s, c in zip(sets, self.checked, strict=True)])
        at, columns = 0, []
        for _ in range(min(N_PIVOTS, len(sets))):
            columns.append(np.bitwise_count(self.fps ^ self.fps[at]).sum(axis=1, dtype=np.int16))
            at = int(np.minimum.reduce(columns).argmax())
        self.table = np.stack(columns, axis=1)

    def near(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``others`` the tables leave, which of them the fingerprints leave) as near to i."""
        open_ = ~(self.checked[others] & self.checked[i])
        by_table = open_ | (np.abs(self.table[others] - self.table[i]).max(axis=1) <= RADIUS)
        left = others[by_table]
        by_bits = open_[by_table] | (np.bitwise_count(self.fps[left] ^ self.fps[i]).sum(axis=1) <= RADIUS)
        return left, left[by_bits]


def walk(sets: list[np.ndarray]):
    """(i, j) of a spanning tree of the links among ``sets``: each unseen set is compared once with each reached one."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    names = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(names, np.cumsum(size)[:-1])
    mark = np.zeros(names.max() + 1, dtype=np.int64)
    pivots = Pivots(sets)
    unseen, frontier = np.arange(1, len(sets)), [0]
    while len(unseen):
        if not frontier:
            frontier, unseen = [int(unseen[0])], unseen[1:]
            continue
        i = frontier.pop()
        left = pivots.near(i, unseen)[1]
        if not len(left):
            continue
        mark[own[i]] = 1
        common = np.add.reduceat(mark[np.concatenate([own[j] for j in left])], np.cumsum(size[left]) - size[left])
        mark[own[i]] = 0
        hit = left[9 * common >= 4 * (size[i] + size[left])]  # 0.8 of the union
        for j in hit.tolist():
            yield i, j
            frontier.append(j)
        unseen = np.setdiff1d(unseen, hit, assume_unique=True)


def _linked(texts: list[str]) -> pd.DataFrame:
    sets = {set_name(s): s for s in map(shingle_set, texts)}
    nodes = np.array(list(sets), dtype=np.int64)
    pairs = list(walk(list(sets.values()))) if len(sets) > 1 else []
    i, j = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    return pd.DataFrame({"a": nodes[i], "b": nodes[j]})


def _linker(batches):
    """Over rows sorted by key: the links of each key's texts, which are held until the next key begins."""
    held, at = [], None
    for b in batches:
        for key, rows in b.groupby("key", sort=False):
            if held and key != at:
                yield _linked(held)
                held = []
            held += rows["text"].tolist()
            at = key
    if held:
        yield _linked(held)


def _links_of(docs: DataFrame, tied: DataFrame, text_col: str) -> DataFrame:
    """Links among the nodes of each ``key`` of ``tied`` (key, _file, _row); a row may stand under many keys."""
    n = partitions(docs.sparkSession)
    text = F.coalesce("text", F.lit("")).alias("text")
    folder = in_place.write_marks(tied.select(in_place.FILE, in_place.ROW, F.col("key").alias("mark")), "tied")
    texts = in_place.placed(docs.select(F.col(text_col).alias("text"))).select(text, in_place.mark(folder).alias("key")).filter("key IS NOT NULL")
    return texts.repartition(n, "key").sortWithinPartitions("key").mapInPandas(_linker, "a long, b long")


def _links_of_large(docs: DataFrame, tied: DataFrame, text_col: str) -> DataFrame:
    """The same for groups of ``chunks`` chunks: every two chunks of a group meet under a key of their own."""
    n = partitions(docs.sparkSession)
    groups = materialize(tied.select("component", "chunks").distinct(), "large")
    folder = in_place.write_marks(tied.select(in_place.FILE, in_place.ROW, F.col("component").alias("mark")), "tied")
    texts = in_place.placed(docs.select(F.col(text_col).alias("text"))).select(F.coalesce("text", F.lit("")).alias("text"), in_place.mark(folder).alias("component")).filter("component IS NOT NULL")
    dealt = texts.withColumn("hash", F.xxhash64("text")).join(groups, "component").withColumn("own", F.pmod("hash", "chunks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("text", F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInPandas(_linker, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, text_col: str, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect all nodes at the similarity. ``nodes``: node, n, keys and the place (_file, _row) of a text."""
    n = partitions(docs.sparkSession)
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    ties = keyed.repartition(n, "key").sortWithinPartitions("key", "node").mapInPandas(_ties, "a long, b long")
    groups = components(ties)
    sized = groups.join(nodes.select("node", "n", in_place.FILE, in_place.ROW), "node")
    tied = materialize(sized, "tied")
    chunks = tied.groupBy("component").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("chunks"))
    tied = materialize(tied.join(chunks, "component").withColumn("key", F.col("component")), "chunks")
    out, large = _links_of(docs, tied.filter("chunks = 1"), text_col), tied.filter("chunks > 1")
    return out if large.isEmpty() else out.unionByName(_links_of_large(docs, large, text_col))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row of each group of linked ``docs``: that with the least id, rows without one last."""
    bounded_batches(docs.sparkSession)
    docs = in_place.readable(docs)
    signed = keyed_rows(docs, id_col, text_col).mapInPandas(_signed, "no_id boolean, id long, _file string, _row long, node long, n long, keys array<long>")
    signed = materialize(signed, "signed")
    some = F.min(F.struct(in_place.FILE, in_place.ROW)).alias("some")
    nodes = signed.groupBy("node").agg(F.max("n").alias("n"), F.first("keys").alias("keys"), some).select("node", "n", "keys", "some.*")
    nodes = materialize(nodes, "nodes")
    names = components(links(docs, nodes, text_col, chunk))
    return keep_one(docs, signed.drop("keys", "n"), names)
