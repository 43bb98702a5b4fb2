"""Byte-level BPE (op8): encoding by batched numpy merge rounds, and decoding.

The distinct words of a batch of texts lie, as symbol ids, one after another in one flat array. In
each round every pair of neighbours within a word is looked up by binary search in the sorted pair keys;
each word's lowest-rank pair is merged wherever it stands (left to right, not overlapping); words without
a known pair are done and leave the array. A merge only makes pairs of a higher rank, which is checked when a
vocabulary is loaded, so this gives the ids of merging one pair at a time.

A word above ``LONG`` bytes would need as many rounds as it has ranks, each over the whole word. Its rounds go by rank
instead: the places of each rank wait in lists, the lowest rank's are merged at once, and only the pairs beside them
are looked up anew, so that the work follows the number of merges.

Words come from the pre-tokenizer's pattern with Unicode's White_Space written out. Texts are cut at added tokens
first. A worker keeps the ids of some ``CACHE`` words, those asked again for longer.

Defined results: a null text is empty and has no ids; repeated rows are encoded one by one; batches are
bounded by bytes, so that a worker holds few very long texts; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_batches, kept, together, trim

CACHE = 200_000
#: Words that are merged together, and characters of texts that are cut into words together.
WORDS_AT_ONCE = 16_000
CHARS_AT_ONCE = 500_000
#: Bytes of a word above which its places wait by rank.
LONG = 256
#: Code points with the property White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the byte-level pre-tokenizer's pattern.
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_NONE = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where visible in Latin-1, else the next free code point from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder for one vocabulary, given as the tokenizer file's JSON text."""

    def __init__(self, spec: str):
        import regex

        d = json.loads(spec)
        vocab = d["model"]["vocab"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        latest = np.full(max(vocab.values()) + 1, -1, dtype=np.int64)
        np.maximum.at(latest, made, np.arange(len(pairs)))  # a symbol's last merge
        if (np.maximum(latest[left], latest[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge of this vocabulary comes before one that makes its parts")
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.bytes = {i: bytes(value[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.words = regex.compile(_WORDS).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol made) of pairs; rank ``_NONE`` for unknown ones."""
        key = left << 32 | right
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[spot] == key, self.rank[spot], _NONE), self.made[spot]

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word, its places in lists by rank."""
        sym = self.first[np.frombuffer(word, dtype=np.uint8)]
        n = len(sym)
        ahead, back = np.arange(1, n + 1), np.arange(-1, n - 1)  # place n: the end
        rank, made = np.full(n, _NONE), np.zeros(n, dtype=np.int64)
        alive = np.ones(n + 1, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(at: np.ndarray) -> None:
            at = at[ahead[at] < n]
            rank[at], made[at] = self._looked_up(sym[at], sym[ahead[at]])
            at = at[rank[at] < _NONE]
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            head = np.flatnonzero(np.r_[True, np.diff(rank[at]) != 0][: len(at)])
            for some in np.split(at, head[1:]) if len(at) else []:
                r = int(rank[some[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(some)

        look(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            # In a run of overlapping places every second one merges, from the run's start.
            i = np.arange(len(at))
            joined = np.r_[False, ahead[at[:-1]] == at[1:]][: len(at)]
            start = np.maximum.accumulate(np.where(joined, 0, i))
            at = at[(i - start) % 2 == 0]
            if not len(at):
                continue
            gone = ahead[at]
            sym[at] = made[at]
            alive[gone], rank[gone] = False, _NONE
            ahead[at] = ahead[gone]
            inner = ahead[at] < n
            back[ahead[at][inner]] = at[inner]
            rank[at] = _NONE
            before = back[at]
            before = before[before >= 0]
            rank[before] = _NONE
            look(np.unique(np.r_[at, before]))
        return sym[alive[:n]]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            done = {i: self.merge_long(words[i]) for i in long}
            rest = [i for i in range(len(words)) if i not in done]
            done |= zip(rest, self.merge([words[i] for i in rest]), strict=True)
            return [done[i] for i in range(len(words))]
        out: list = [np.zeros(0, dtype=np.int64)] * len(words)
        sym = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        while len(sym):
            rank, at = np.full(len(sym), _NONE), np.zeros(len(sym), dtype=np.int64)
            key = sym[:-1] << 32 | sym[1:]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero((word[:-1] == word[1:]) & (self.keys[spot] == key))
            rank[hit], at[hit] = self.rank[spot[hit]], spot[hit]
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[head, len(sym)])
            least = np.minimum.reduceat(rank, head)
            for i in np.flatnonzero(least == _NONE):
                out[word[head[i]]] = sym[head[i] : head[i] + sizes[i]]
            best = np.repeat(least, sizes)
            same = (rank == best) & (rank < _NONE)
            # In a run of overlapping places every second one merges, from the run's start.
            i = np.arange(len(sym))
            fresh = same & ~np.r_[False, same[:-1]]
            start = np.maximum.accumulate(np.where(fresh, i, 0))
            take = same & ((i - start) % 2 == 0)
            sym[take] = self.made[at[take]]
            stay = (best < _NONE) & ~np.r_[False, take[:-1]]
            sym, word = sym[stay], word[stay]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split: list[list[str]] = []
        for t in texts:
            if any(s in t for s in self.special):
                words = []
                for k, piece in enumerate(self.cut(t)):
                    words += [f"\0{piece}"] if k % 2 else self.words(piece)
                split.append(words)
            else:
                split.append(self.words(t))
        if len(self.known) > CACHE // 2:  # words that are asked again come over from the older half
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        for t, i in self.special.items():  # a NUL never starts a word of several characters that an added token could equal
            known[f"\0{t}"] = np.array([i], dtype="<u4").tobytes()
        new = {w for s in split for w in s if w not in known}
        known.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in older]
        for i in range(0, len(new), WORDS_AT_ONCE):
            some = new[i : i + WORDS_AT_ONCE]
            for word, ids in zip(some, self.merge([w.encode() for w in some]), strict=True):
                known[word] = ids.astype("<u4").tobytes()
        return [b"".join(map(known.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def codec(spec: str) -> ByteBpe:
    """The worker's codec: kept from task to task."""
    return kept(("bpe", spec), lambda: ByteBpe(spec))


def encode_and_decode(docs: DataFrame, spec_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and, on request, the ids themselves) of every text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(spec_path, encoding="utf-8") as f:
        shipped = spark.sparkContext.broadcast(f.read())  # one vocabulary: of fixed size
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        bpe = codec(shipped.value)
        for b in batches:
            ids = [x for some in together(b["text"].tolist(), CHARS_AT_ONCE) for x in bpe.encode(some)]
            out = {
                "doc_id": b["doc_id"],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
            }
            if keep_ids:
                out["ids"] = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids]
            yield pd.DataFrame(out)
        trim()

    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
