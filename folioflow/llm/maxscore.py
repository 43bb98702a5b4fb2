"""Ranked lexical search (op11): MaxScore over an inverted index in segments.

Index: each task turns its documents into segments of bounded text. A segment is two files in the shared folder: its terms in order,
with the place of their postings, the highest term count and the least ratio of a document's length to it; and its postings, gaps of document numbers
and counts, with the documents' ids and lengths. Statistics of the corpus are sums over segments.

Search: items lie in block files with the weights of their terms. A task goes through segments, a block at a time, and carries each item's best
documents along. In a segment an item's terms are ordered by upper bound. Terms whose bounds sum to less than the k-th best score so
far are non-essential: a document that has no other can't enter. Documents are taken window by window from the essential postings; their non-essential
postings are probed, highest bound first, only while score and the bounds left reach the k-th best; the split is made anew for each window. Tasks
return each item's first k, which a window ranks.

Defined results: null and empty texts have no terms and are found by nothing; items without terms get no rows; a null id comes after all ids
among equal scores; repeated rows are documents, or items, of their own; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_batches, materialize, partitions, shared_dir, trim
from folioflow.llm.store import ShardFile, read_whole
from folioflow.llm.words import words

K = 10
#: Bytes of text of a segment; documents of a window; items of a block; terms of a block.
SEGMENT, WINDOW, ITEMS, TERMS = 24 << 20, 4096, 500, 50_000
UNIT = 1_000_000_000


def _packed(*parts: np.ndarray | bytes) -> bytes:
    """Arrays and bytes behind one another, each compressed, with their kinds and sizes in front."""
    raw = [(p.dtype.str, p.tobytes()) if isinstance(p, np.ndarray) else ("", p) for p in parts]
    body = [pa.compress(p, "zstd", asbytes=True) for _, p in raw]
    head = ";".join(f"{kind},{len(p)},{len(z)}" for (kind, p), z in zip(raw, body, strict=True))
    return b"\n".join([head.encode(), b"".join(body)])


def _unpacked(data: bytes) -> list:
    head, body = data.split(b"\n", 1)
    out, at = [], 0
    for part in head.decode().split(";"):
        kind, size, packed = part.split(",")
        plain = pa.decompress(body[at : at + int(packed)], int(size), "zstd", asbytes=True)
        out.append(np.frombuffer(plain, kind) if kind else plain)
        at += int(packed)
    return out


def _stored(folder: str, name: str, data: bytes) -> None:
    out = ShardFile(folder, name)
    out.write(data)
    out.commit()


class Draft:
    """A segment that is being filled."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.terms, self.counts, self.ids, self.known, self.lengths, self.size = [], [], [], [], [], 0

    def add(self, id_: int, known: bool, text: bytes) -> None:
        self.size += len(text) + 64
        held = Counter()
        for some in words(text):
            held.update(some)
        if held:
            self.terms.append(np.fromiter(map(self.number.__getitem__, held), np.int32, len(held)))
            self.counts.append(np.fromiter(held.values(), np.int32, len(held)))
            self.ids.append(id_)
            self.known.append(known)
            self.lengths.append(held.total())

    def write(self, folder: str) -> tuple[str, int, int]:
        """(name, documents with terms, all their terms)."""
        name = uuid.uuid4().hex  # of this attempt: only segments that a finished task names are read
        ordered = sorted(self.number)
        place = np.empty(len(ordered), np.int32)
        place[np.fromiter(map(self.number.__getitem__, ordered), np.int32, len(ordered))] = np.arange(len(ordered), dtype=np.int32)
        lengths = np.array(self.lengths, np.int64)
        sizes = np.array([len(t) for t in self.terms], np.int64)
        term = place[np.concatenate([*self.terms, np.zeros(0, np.int32)])]
        order = np.argsort(term, kind="stable")
        term, count = term[order], np.concatenate([*self.counts, np.zeros(0, np.int32)])[order]
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        first = np.searchsorted(term, np.arange(len(ordered) + 1)).astype(np.int64)
        most = np.maximum.reduceat(count, first[:-1]) if len(ordered) else count
        least = np.minimum.reduceat(lengths[doc] / count, first[:-1]) if len(ordered) else np.zeros(0)
        gaps = np.diff(doc, prepend=np.int32(0))
        gaps[first[:-1]] = doc[first[:-1]]
        _stored(folder, f"{name}.terms", _packed(b" ".join(ordered), first, most.astype(np.int32), least.astype(np.float64)))
        _stored(folder, f"{name}.postings", _packed(gaps.astype(np.int32), count.astype(np.int32), np.array(self.ids, np.int64), np.array(self.known, bool), lengths))
        return name, len(lengths), int(lengths.sum())


def index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Write the segments of ``docs`` to ``folder``; a written table (name, docs, terms) of those that count."""
    bounded_batches(docs.sparkSession)

    def build(batches):
        draft = Draft()
        for b in batches:
            for id_, known, text in zip(b["id"], b["known"], b["text"], strict=True):
                draft.add(id_, known, text)
                if draft.size >= segment:
                    yield pd.DataFrame([draft.write(folder)], columns=["name", "docs", "terms"])
                    draft = Draft()
        if draft.ids:
            yield pd.DataFrame([draft.write(folder)], columns=["name", "docs", "terms"])
        trim()

    i, body = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(i, F.lit(0)).alias("id"), i.isNotNull().alias("known"), body.alias("text"))
    return materialize(rows.mapInPandas(build, "name string, docs long, terms long"), "segments")


class Segment:
    """A written segment, for scoring under the corpus' statistics."""

    def __init__(self, folder: str, name: str, n: int, length: int):
        terms, self.first, most, least = _unpacked(read_whole(folder, f"{name}.terms"))
        self.at = dict(zip(terms.split(b" "), range(len(most)), strict=True)) if len(most) else {}
        self.gaps, self.count, self.ids, self.known, lengths = _unpacked(read_whole(folder, f"{name}.postings"))
        self.mass = 8 * (10 + 90 * lengths * n // length)
        # never below the true saturation: 9 for 10, as the mass is rounded down, and one for the rounding here
        self.most = np.floor(UNIT / (1000 + 72 / most + 720 * least * n / length)).astype(np.int64) + 1
        self._lists: dict = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, saturation of each), decoded once."""
        if term not in self._lists:
            a, b = self.first[term], self.first[term + 1]
            doc, tf = np.cumsum(self.gaps[a:b]), self.count[a:b].astype(np.int64)
            self._lists[term] = doc, UNIT * tf // (1000 * tf + self.mass[doc])
        return self._lists[term]


class Best:
    """An item's first k so far, and how many postings were looked at."""

    def __init__(self, k: int):
        self.k, self.seen = k, 0
        self.score, self.id, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a score must reach: at least 1, as documents without a score are not found."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def take(self, score: np.ndarray, id_: np.ndarray, known: np.ndarray) -> None:
        score, id_, known = np.r_[self.score, score], np.r_[self.id, id_], np.r_[self.known, known]
        order = np.lexsort((id_, ~known, -score))[: self.k]
        self.score, self.id, self.known = score[order], id_[order], known[order]


def search(segment: Segment, terms: list[bytes], weights: np.ndarray, best: Best, window: int = WINDOW) -> None:
    """MaxScore over one segment: what can enter ``best`` does."""
    held = [(int(w) * int(segment.most[at]), int(w), at) for t, w in zip(terms, weights, strict=True) if w > 0 and (at := segment.at.get(t)) is not None]
    if not held:
        return
    held.sort()
    reach = np.cumsum([h[0] for h in held])
    n = len(segment.ids)
    if reach[-1] < best.least():
        return
    lists: list = [None] * len(held)
    for low in range(0, n, window):
        high = min(low + window, n)
        least = best.least()
        essential = int(np.searchsorted(reach, least, side="left"))  # terms before it sum to less than is needed
        if essential == len(held):
            return
        score = np.zeros(high - low, np.int64)
        for j in range(essential, len(held)):
            doc, part = lists[j] = lists[j] or segment.postings(held[j][2])
            a, b = np.searchsorted(doc, (low, high))
            score[doc[a:b] - low] += held[j][1] * part[a:b]
            best.seen += int(b - a)
        some = np.flatnonzero(score)
        for j in range(essential - 1, -1, -1):
            some = some[score[some] + reach[j] >= least]
            if not len(some):
                break
            doc, part = lists[j] = lists[j] or segment.postings(held[j][2])
            at = np.searchsorted(doc, some + low)
            hit = doc[np.minimum(at, len(doc) - 1)] == some + low
            score[some[hit]] += held[j][1] * part[at[hit]]
            best.seen += len(some)
        some = some[score[some] >= least]
        if len(some):
            best.take(score[some], segment.ids[some + low], segment.known[some + low])


# ---- the search as Spark jobs --------------------------------------------------------------------


def _pairs(segments: DataFrame, blocks: int) -> DataFrame:
    """Work for tasks: each segment with each block, a task's work by block."""
    n = partitions(segments.sparkSession)
    work = segments.select("name", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return work.repartition(n, "name").sortWithinPartitions("block", "name")


def _item_terms(items: DataFrame) -> DataFrame:
    """(q, term): each item's terms, once each."""

    def cut(batches):
        for b in batches:
            for q, text in zip(b["q"], b["text"], strict=True):
                held = {w for some in words(text) for w in some}
                if held:
                    yield pd.DataFrame({"q": q, "term": list(held)})

    return items.select("q", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInPandas(cut, "q long, term binary")


def _write_blocks(rows: DataFrame, folder: str, kind: str) -> None:
    """One file a block: the terms of ``rows`` (block, q, term, w), by q and term."""

    def write(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["q", "term"], kind="stable")
        _stored(folder, f"{kind}-{part['block'].iloc[0]}", _packed(b" ".join(part["term"]), part["q"].to_numpy(np.int64), part["w"].to_numpy(np.int64)))
        return pd.DataFrame({"n": [len(part)]})

    rows.groupBy("block").applyInPandas(write, "n long").agg(F.sum("n")).first()


def document_frequencies(segments: DataFrame, terms: DataFrame, folder: str) -> DataFrame:
    """(term, df) of the asked ``terms`` (term); a task counts a block over all its segments before it sends anything."""
    blocks = max(1, -(-terms.count() // TERMS))
    dealt = terms.select(F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).cast("long").alias("q"), "term", F.lit(0).cast("long").alias("w"))
    _write_blocks(dealt, folder, "asked")

    def count(batches):
        at, asked, total = None, [], None
        for b in batches:
            for name, block in zip(b["name"], b["block"], strict=True):
                if block != at:
                    if at is not None:
                        yield pd.DataFrame({"term": asked, "n": total})
                    data = read_whole(folder, f"asked-{block}")
                    asked = _unpacked(data)[0].split(b" ") if data else []
                    at, total = block, np.zeros(len(asked), np.int64)
                held, first, _, _ = _unpacked(read_whole(folder, f"{name}.terms"))
                place = dict(zip(held.split(b" "), np.diff(first).tolist(), strict=True))
                total += np.fromiter((place.get(t, 0) for t in asked), np.int64, len(asked))
        if at is not None:
            yield pd.DataFrame({"term": asked, "n": total})
        trim()

    return _pairs(segments, blocks).mapInPandas(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("df"))


def top_k(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` highest-scoring documents of each item."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "index")
    segments = index(docs, folder, id_col, text_col, segment)
    n, length = segments.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).withColumn("q", F.monotonically_increasing_id())
    asked = materialize(asked, "items")
    kind = asked.schema["item_id"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    terms = materialize(_item_terms(asked), "asked")
    df = document_frequencies(segments, terms.select("term").distinct(), folder)
    blocks = max(1, -(-asked.count() // ITEMS))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighed = terms.join(df, "term").filter("df > 0").select(F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), "q", "term", weight.alias("w"))
    _write_blocks(weighed, folder, "items")

    def find(batches):
        at, block_items, best = None, [], {}

        def done():
            rows = [(q, s, i if known else None) for q, x in best.items() for s, i, known in zip(x.score.tolist(), x.id.tolist(), x.known.tolist(), strict=True)]
            return pd.DataFrame({"q": [r[0] for r in rows], "score": [r[1] for r in rows], "doc_id": pd.array([r[2] for r in rows], dtype="Int64")})

        for b in batches:
            for name, block in zip(b["name"], b["block"], strict=True):
                if block != at:
                    if at is not None:
                        yield done()
                    data = read_whole(folder, f"items-{block}")
                    block_items, best, at = [], {}, block
                    if data:
                        held, q, w = _unpacked(data)
                        held, cut = held.split(b" "), [0, *(np.flatnonzero(np.diff(q)) + 1), len(q)]
                        block_items = [(int(q[a]), held[a:z], w[a:z]) for a, z in zip(cut, cut[1:], strict=False)]
                        best = {q: Best(k) for q, _, _ in block_items}
                here = Segment(folder, name, n, length)
                for q, held, w in block_items:
                    search(here, held, w, best[q])
        if at is not None:
            yield done()
        trim()

    found = _pairs(segments, blocks).mapInPandas(find, "q long, score long, doc_id long")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return found.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT doc_id, any_value(len(ts)) AS size, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY term, n),
p AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * size * n) // l)) AS part FROM tf, s),
r AS (SELECT item_id, doc_id, CAST(sum(w * part) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY item_id, doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {K}"""
