"""Token-ID output in patched frame-of-reference blocks (op1).

Texts are encoded with the ``tokenizers`` library, an end id is appended to each, and the ids of a
range of documents go, in ascending id order, into binary files of this layout (little-endian):

    magic "PFB1", u32 ids a block, u32 partition, u64 ids before this file in its partition,
    u64 documents, u64 ids, u64 blocks,
    i64 document ids, u32 ids of each document,
    u64 block starts (bytes from the payload's start, one more than blocks),
    payload: per block u32 minimum, u8 width, u8 exceptions, ids - minimum packed at that width
    (most significant bit first), u8 places and u32 values (ids - minimum) of the exceptions.

A block's width is that of its 90th percentile; larger values are exceptions. The last block is filled with its last id.

The library is asked once a worker for each distinct chunk of text between blanks and marks; the tokenizer
joins nothing across those, so the ids are those of the whole text.

Defined results: a null text is empty and holds the end id alone; rows that repeat an id are ordered
by their text's hash; an empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_batches, kept, partitions, shared_dir
from folioflow.llm.store import ShardFile

BLOCK = 128
PERCENTILE = 90
END_ID = 2
#: Stands in the files for a missing document id.
NO_ID = -(1 << 63)
#: Ids after which a task starts its next file: bounds what writers and readers hold.
ROLL = 500_000
#: Distinct chunks a worker remembers (some 40 bytes each), and the longest of them.
CACHE = 1_000_000
LONG = 64
_MARKS = b".,;:!?"
_IS_MARK = np.isin(np.arange(256), np.frombuffer(_MARKS, dtype=np.uint8))
_IS_WORD = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_BASE = 0x5851F42D4C957F2D
_VALUE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0x94D049BB133111EB)
_HEAD = struct.Struct("<4sIIQQQQ")


class ChunkEncoder:
    """Ids of whole texts, from the ids of their distinct chunks.

    A text is cut at blanks and line ends, which the tokenizer drops, and between an ASCII letter or digit and a mark of
    ``_MARKS``, which always fall into different words; it joins nothing across those. Cutting, hashing and
    putting ids together is done for all texts of a batch at once, in numpy; the library gets each distinct chunk
    of a worker once. Known chunks are rows of flat arrays, sorted by hash. The bytes of every chunk are compared with
    those kept under its hash; one that differs is encoded by itself. Chunks over ``LONG`` bytes are not kept.

    Unknown chunks are encoded together. Chunks of letters are one word each, and the vocabulary marks the
    last piece of a word, which shows where each one's ids end. Between other chunks stands an added
    token: the library cuts texts at those before anything else.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_str(spec)
        self._library.no_padding()
        self._library.no_truncation()
        d = json.loads(spec)
        added = {t["content"]: t["id"] for t in d["added_tokens"]}
        self._added, (self._mark, self._mark_id) = tuple(added), next(iter(added.items()))
        suffix, vocab = d["model"].get("end_of_word_suffix"), d["model"]["vocab"]
        self._last = np.zeros(max([*vocab.values(), *added.values()]) + 1, dtype=bool)
        if suffix:
            self._last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._power = self._inverse = np.ones(1, dtype=np.uint64)
        self._forget()

    def _forget(self) -> None:
        self._hash = np.zeros(0, dtype=np.uint64)
        self._at = self._size = np.zeros(0, dtype=np.int64)
        self._pool, self._used = np.zeros(1 << 16, dtype="<u4"), 0
        self._text, self._text_at, self._text_used = np.zeros(1 << 16, dtype=np.uint8), np.zeros(0, dtype=np.int64), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _several(self, chunks: list[str], letters: bool) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(chunks), 1000):
            some = chunks[i : i + 1000]
            if letters:
                ids = self._ids(" ".join(some))
                ends = np.flatnonzero(self._last[ids]) + 1
                if len(ends) == len(some):
                    out += np.split(ids, ends[:-1])
                    continue
            ids = self._ids(self._mark.join(some))
            cut = np.flatnonzero(ids == self._mark_id)
            out += [ids[s:e] for s, e in zip(np.r_[0, cut + 1].tolist(), np.r_[cut, len(ids)].tolist(), strict=True)]
        return out

    def _look_up(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of each of some distinct chunks."""
        kind = [0 if c.isalpha() else 2 if "<" in c and any(a in c for a in self._added) else 1 for c in chunks]
        of = [[c for c, k in zip(chunks, kind, strict=True) if k == want] for want in range(3)]
        done = [iter(self._several(of[0], True)), iter(self._several(of[1], False)), iter([self._ids(c) for c in of[2]])]
        return [next(done[k]) for k in kind]

    def _put(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Append ids to the pool: (place, size) of each."""
        size = np.array([len(x) for x in ids], dtype=np.int64)
        end = self._used + int(size.sum())
        if end > len(self._pool):
            self._pool = np.r_[self._pool, np.zeros(max(end, 2 * len(self._pool)) - len(self._pool), dtype="<u4")]
        if len(ids):
            self._pool[self._used : end] = np.concatenate(ids)
        at = self._used + np.cumsum(size) - size
        self._used = end
        return at, size

    def _keep(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Append chunks' bytes to the kept ones, in steps of eight with zeros behind: the place of each."""
        step = -(-(ends - starts) // 8) * 8
        at = self._text_used + np.cumsum(step) - step
        end = self._text_used + int(step.sum())
        if end > len(self._text):
            self._text = np.r_[self._text, np.zeros(max(end, 2 * len(self._text)) - len(self._text), dtype=np.uint8)]
        size = ends - starts
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self._text[np.repeat(at, size) + inner] = raw[np.repeat(starts, size) + inner]
        self._text_used = end
        return at

    def _differ(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which chunks aren't, byte for byte, those kept at ``at``: eight bytes at a time, for all chunks at once."""
        padded = np.r_[raw, np.zeros(8, dtype=np.uint8)]
        here = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))
        kept = self._text[: len(self._text) // 8 * 8].view("<u8")
        left, out, live = ends - starts, np.zeros(len(starts), dtype=bool), np.arange(len(starts))
        step = 0
        while len(live):
            bits = np.minimum(left[live] - 8 * step, 8).astype(np.uint64) * np.uint64(8)
            x = here[starts[live] + 8 * step] & (~np.uint64(0) >> (np.uint64(64) - bits))
            out[live] |= x != kept[at[live] // 8 + step]
            step += 1
            live = live[left[live] > 8 * step]
        return out

    def _hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A polynomial in the bytes of each chunk, from one running sum: the power of its place is divided out."""
        if len(self._power) < len(raw) + 1:
            for name, base in (("_power", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
                x = np.full(len(raw) + 1, base, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[raw] * self._power[: len(raw)], out=total[1:])
        h = (total[ends] - total[starts]) * self._inverse[starts]
        h ^= h >> np.uint64(31)
        return h * np.uint64(0x9E3779B97F4A7C15) ^ (ends - starts).astype(np.uint64)

    def encode_bytes(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); text i is raw[off[i] : off[i + 1]] in UTF-8."""
        if len(self._hash) > CACHE:
            self._forget()
        blank = (raw == 32) | (raw == 10)
        word, mark = _IS_WORD[raw], _IS_MARK[raw]
        first = ~blank
        first[1:] &= blank[:-1] | (word[:-1] & mark[1:]) | (mark[:-1] & word[1:])
        begin = off[:-1][off[:-1] < off[1:]]
        first[begin] = ~blank[begin]
        last = ~blank
        last[:-1] &= blank[1:] | first[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(starts):
            return np.zeros(0, dtype="<u4"), np.zeros(len(off) - 1, dtype=np.int64)
        text = raw.tobytes()
        at, size = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        short = ends - starts <= LONG
        own = np.flatnonzero(short)
        h, where, back = np.unique(self._hashes(raw, starts[own], ends[own]), return_index=True, return_inverse=True)
        spot = np.searchsorted(self._hash, h)
        known = np.zeros(len(h), dtype=bool)
        inside = spot < len(self._hash)
        known[inside] = self._hash[spot[inside]] == h[inside]
        new = own[where[~known]]
        if len(new):
            chunks = [text[s:e].decode("utf-8", "surrogatepass") for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            a, z = self._put(self._look_up(chunks))
            self._hash = np.insert(self._hash, spot[~known], h[~known])
            self._text_at = np.insert(self._text_at, spot[~known], self._keep(raw, starts[new], ends[new]))
            self._at, self._size = np.insert(self._at, spot[~known], a), np.insert(self._size, spot[~known], z)
            spot = np.searchsorted(self._hash, h)
        at[own], size[own] = self._at[spot][back], self._size[spot][back]
        other = self._differ(raw, starts[own], ends[own], self._text_at[spot][back])
        rest = np.flatnonzero(~short) if not other.any() else np.sort(np.r_[np.flatnonzero(~short), own[other]])
        used = self._used
        if len(rest):
            at[rest], size[rest] = self._put([self._ids(text[starts[i] : ends[i]].decode("utf-8", "surrogatepass")) for i in rest.tolist()])
        reach = np.cumsum(size)
        ids = self._pool[np.repeat(at - (reach - size), size) + np.arange(int(reach[-1]))]
        self._used = used
        ends_of = np.r_[0, reach][np.searchsorted(starts, off)]
        return ids, np.diff(ends_of)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        off = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
        ids, size = self.encode_bytes(np.frombuffer(b"".join(raw), dtype=np.uint8), off)
        return np.split(ids, np.cumsum(size)[:-1]) if texts else []


def encoder(spec: str) -> ChunkEncoder:
    """The worker's encoder: kept from task to task."""
    return kept(("pfor", spec), lambda: ChunkEncoder(spec))


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block starts, payload) of ``ids``."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(1, dtype="<u8"), np.zeros(0, dtype=np.uint8)
    v = np.full(n * BLOCK, ids[-1], dtype=np.uint32)
    v[: len(ids)] = ids
    v = v.reshape(n, BLOCK)
    low = v.min(axis=1)
    v = v - low[:, None]
    kth = BLOCK * PERCENTILE // 100
    at = np.partition(v, kth, axis=1)[:, kth].astype(np.float64)
    width = np.frexp(at)[1].astype(np.int64)  # bits of a whole number
    over = v >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    count = over.sum(axis=1)
    sizes = 6 + BLOCK // 8 * width + 5 * count
    starts = np.zeros(n + 1, dtype="<u8")
    np.cumsum(sizes, out=starts[1:])
    first = starts[:-1].astype(np.int64)
    out = np.zeros(int(starts[-1]), dtype=np.uint8)
    out[first[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[first + 4], out[first + 5] = width, count
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bits = np.unpackbits(v[rows].astype(">u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2)[:, :, 32 - w :]
            out[first[rows][:, None] + 6 + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(rows), -1), axis=1)
    block, place = np.nonzero(over)
    rank = np.arange(len(block)) - (np.cumsum(count) - count)[block]
    spot = first[block] + 6 + BLOCK // 8 * width[block]
    out[spot + rank] = place
    out[(spot + count[block] + 4 * rank)[:, None] + np.arange(4)] = v[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return starts, out


def unpack(starts: np.ndarray, data: np.ndarray, n_ids: int) -> np.ndarray:
    first = starts[:-1].astype(np.int64)
    n = len(first)
    low = np.ascontiguousarray(data[first[:, None] + np.arange(4)]).view("<u4").reshape(n)
    width, count = data[first + 4].astype(np.int64), data[first + 5].astype(np.int64)
    v = np.zeros((n, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bits = np.zeros((len(rows), BLOCK, 32), dtype=np.uint8)
            bits[:, :, 32 - w :] = np.unpackbits(data[first[rows][:, None] + 6 + np.arange(BLOCK // 8 * w)], axis=1).reshape(len(rows), BLOCK, w)
            v[rows] = np.packbits(bits, axis=2).view(">u4").reshape(len(rows), BLOCK)
    block = np.repeat(np.arange(n), count)
    rank = np.arange(len(block)) - (np.cumsum(count) - count)[block]
    spot = first[block] + 6 + BLOCK // 8 * width[block]
    v[block, data[spot + rank]] = np.ascontiguousarray(data[(spot + count[block] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    return (v + low[:, None]).reshape(-1)[:n_ids]


def file_bytes(part: int, before: int, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    starts, payload = pack(ids)
    head = _HEAD.pack(b"PFB1", BLOCK, part, before, len(doc_ids), len(ids), len(starts) - 1)
    return b"".join((head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), starts.tobytes(), payload.tobytes()))


def read_file(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(partition, ids before, document ids, lengths, ids)."""
    magic, block, part, before, docs, n, blocks = _HEAD.unpack_from(data)
    if magic != b"PFB1" or block != BLOCK:
        raise ValueError("not a token file of this layout")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u4", docs, at + 8 * docs)
    starts = np.frombuffer(data, "<u8", blocks + 1, at + 12 * docs)
    return part, before, doc_ids, lengths, unpack(starts, np.frombuffer(data, np.uint8, offset=at + 12 * docs + 8 * (blocks + 1)), n)


def write_tokens(docs: DataFrame, folder: str, spec: str, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Write the token files of ``docs`` into ``folder``; returns the ids before each partition, and the total last.

    The driver gets one number a partition.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(spec)  # one vocabulary: of fixed size
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches):
        import pyarrow as pa

        part, codec = TaskContext.get().partitionId(), encoder(shipped.value)
        before, n, size, held, doc_ids, lengths = 0, 0, 0, [], [], []

        def flush():
            nonlocal before, n, size, held, doc_ids, lengths
            ids = np.concatenate(held)
            out = ShardFile(folder, f"tokens-{part:06d}-{n:06d}.pfb")
            out.write(file_bytes(part, before, np.concatenate(doc_ids), np.concatenate(lengths), ids))
            out.commit()
            before, n, size, held, doc_ids, lengths = before + len(ids), n + 1, 0, [], [], []

        for b in batches:
            text = b.column(1).cast(pa.large_binary())
            off = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
            ids, count = codec.encode_bytes(raw, off - off[0])
            doc_ids.append(b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
            held.append(np.insert(ids, np.cumsum(count), END_ID).astype("<u4"))
            lengths.append(count + 1)
            size += len(held[-1])
            if size >= ROLL:
                flush()
        if held:
            flush()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([before], pa.int64())})

    sums = dict(rows.select("doc_id", "text").mapInArrow(write, "part int, n long").groupBy("part").agg(F.max("n")).collect())
    return [0, *accumulate(sums.get(i, 0) for i in range(max(sums, default=-1) + 1))]


def read_tokens(spark: SparkSession, folder: str, first: list[int]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of ``folder``."""

    def read(batches):
        for b in batches:
            for data in b["content"]:
                part, before, doc_ids, lengths, ids = read_file(data)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                starts = ends - lengths
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                doc_id = pd.Series(doc_ids.astype(np.int64), dtype="Int64").mask(doc_ids == NO_ID)
                yield pd.DataFrame({"doc_id": doc_id, "start": starts + before + first[part], "n_tokens": lengths.astype(np.int64), "ids_crc32": crc})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfb").load(folder).select("content")
    return files.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, spec_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files of ``docs`` into a fresh shared folder and read them back."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    with open(spec_path, encoding="utf-8") as f:
        first = write_tokens(docs, folder, f.read(), id_col, text_col)
    if not first[-1]:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, folder, first)
