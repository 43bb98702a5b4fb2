"""Benchmark decontamination (op2): pigeonhole edit matching.

Texts and items are compared in normal form: lower case, runs of other than word characters as one
blank. An item of m characters has an error budget of k = m // ``CHARS_PER_EDIT`` edits and is cut into k + 1
pieces. Wherever at most k edits turn the item into a passage, one piece stands there unchanged, so an
Aho-Corasick automaton over all pieces finds every candidate place. Places that lie near each other are merged to
one window, and Myers' bit-parallel distance is taken once over each window, so that a text full of hits is
read once an item. A window with few hits is first tried from small to large: of neighbouring pieces joined by two again
and again, j together must stand there with at most j - 1 edits. Were that wrong for one part on the way up from every
piece that stands unchanged, the parts' edits would add up to more than k, so no match is lost, and a chance hit
mostly ends after two pieces.

Items are the stated query set. Spark deals them by hash into block files of at most ``BLOCK_CHARS`` characters in the
shared folder, small ones of which make up a block together; nothing is broadcast and the driver gets the files' names. Documents are scanned once: a worker
holds up to ``HELD_CHARS`` characters of texts against one block after the other, and keeps the last block's automaton
from task to task.

Defined results: null and empty texts have no hits; null items and those without a word match nothing; items under
``MIN_CHARS`` characters of normal form have no budget and must stand between word ends; repeated texts each get
their hits, repeated items theirs; without items nothing is hit; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_batches, kept, shared_dir
from folioflow.llm.store import ShardFile, read_whole

CHARS_PER_EDIT = 12
MIN_CHARS = 20
BLOCK_CHARS = 1_000_000
HELD_CHARS = 16_000_000
#: Hits up to which a window is tried from small parts to large.
FEW = 4
_OTHER = re.compile(r"[\W_]+")
_PAIRS = "doc_id long, item_id long, edits int, start int"
_HITS = "array<struct<item_id: bigint, edits: int, start: int>>"


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def cut(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces whose lengths differ by at most one."""
    at = [i * len(item) // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:])]


def parts_around(item: str, budget: int, j: int) -> list[tuple[str, int, int]]:
    """(part, offset, budget) of the parts that hold piece j, from its pair up to just below the whole item."""
    at = [i * len(item) // (budget + 1) for i in range(budget + 2)]
    out, a, b = [], 0, budget + 1
    while b - a > 1:
        if b - a <= budget:
            out.append((item[at[a] : at[b]], at[a], b - a - 1))
        mid = (a + b) // 2
        a, b = (a, mid) if j < mid else (mid, b)
    return out[::-1]


def myers(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """(fewest edits, end) of the item against any passage of ``text``; None above the budget."""
    m = len(item)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score, best = mask, 0, m, (m, 0)
    for end, c in enumerate(text, 1):
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diagonal | up) & mask, up & diagonal
        if right & high:
            score += 1
        elif left & high:
            score -= 1
        right, left = right << 1 & mask, left << 1 & mask
        up, down = left | ~((eq | down) | right) & mask, right & (eq | down)
        if score < best[0]:
            best = (score, end)
    return best if best[0] <= budget else None


class Matcher:
    """One block of items: [(ids, normal form)], each normal form once."""

    def __init__(self, items: list[tuple[list, str]], chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick

        self.items = [(ids, t, len(t) // chars_per_edit if len(t) >= MIN_CHARS else -1) for ids, t in items]
        pieces: dict[str, dict[int, list[int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            if k < 0:
                pieces.setdefault(f" {t} ", {})[n] = [0]
                continue
            for j, (_, piece) in enumerate(cut(t, k)):
                pieces.setdefault(piece, {}).setdefault(n, []).append(j)
        self.offsets = [[a for a, _ in cut(t, k)] if k >= 0 else [0] for _, t, k in self.items]
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            # of a piece that an item holds more than once, its first and last place in the item, and no number
            spans = [(n, self.offsets[n][js[0]], self.offsets[n][js[-1]], js[0] if len(js) == 1 else -1) for n, js in owners.items()]
            self.automaton.add_word(piece, (len(piece), spans))
        self.automaton.make_automaton()

    def _likely(self, n: int, j: int, text: str, start: int) -> bool:
        """Whether all parts around piece j stand near ``start`` within their budgets."""
        _, item, budget = self.items[n]
        for part, offset, k in parts_around(item, budget, j):
            low = max(0, start + offset - k)
            if myers(part, text[low : max(0, start + offset + len(part) + k)], k) is None:
                return False
        return True

    def _windows(self, text: str) -> dict[int, list[list]]:
        """For each item the stretches of places where it may start: [first, last, hits (None: more than a few)]."""
        found: dict[int, list[list]] = {}
        for end, (size, owners) in self.automaton.iter(f" {text} "):
            at = end - size  # in ``text``
            for n, low, high, j in owners:
                first, last = at - high, at - low
                windows = found.setdefault(n, [])
                if windows and windows[-1][0] <= first <= windows[-1][1] + 1:
                    w = windows[-1]
                    w[1] = max(w[1], last)
                    if w[2] is not None:
                        w[2] = [*w[2], (j, first)] if j >= 0 and len(w[2]) < FEW else None
                else:
                    windows.append([first, last, [(j, first)] if j >= 0 else None])
        return found

    def _merged(self, windows: list[list], gap: int) -> list[list]:
        """Windows whose passages overlap as one."""
        out: list[list] = []
        for first, last, hits in sorted(windows, key=lambda w: w[:2]):
            if out and first <= out[-1][1] + gap:
                w = out[-1]
                w[1] = max(w[1], last)
                w[2] = None if w[2] is None or hits is None or len(w[2]) + len(hits) > FEW else w[2] + hits
            else:
                out.append([first, last, hits])
        return out

    def _best(self, n: int, text: str, windows: list[list]) -> tuple[int, int] | None:
        """(edits, start) of item n in its windows."""
        _, item, k = self.items[n]
        m, best = len(item), None
        if k < 0:
            return 0, min(w[0] for w in windows) + 1
        for first, last, hits in self._merged(windows, m + 2 * k):
            low, high = max(0, first - k), max(0, last + m + k)
            exact = text.find(item, low, high)
            if exact >= 0:
                return 0, exact
            if not k or hits is not None and not any(self._likely(n, j, text, s) for j, s in hits):
                continue
            found = myers(item, text[low:high], k)
            if found:
                found = found[0], max(0, low + found[1] - m)
                best = found if best is None else min(best, found)
        return best

    def hits(self, text: str | None) -> list[dict]:
        """The best passage of each item that the text holds."""
        text = normal(text or "")
        if not text:
            return []
        out = []
        for n, windows in sorted(self._windows(text).items()):
            best = self._best(n, text, windows)
            if best:
                out += ({"item_id": i, "edits": best[0], "start": best[1]} for i in self.items[n][0])
        return out


def write_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> tuple[str, list[tuple[str, ...]]]:
    """Write ``items`` in normal form as files: (folder, blocks). A block is the names of files of ``block_chars`` characters in all."""
    spark = items.sparkSession
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    folder = shared_dir(spark, "items")

    def write(batches):
        block, size, made, part = {}, 0, [], TaskContext.get().partitionId()

        def flush():
            name = f"items-{part:06d}-{len(made):04d}.json"
            out = ShardFile(folder, name)
            out.write(json.dumps([[ids, t] for t, ids in block.items()]).encode())
            out.commit()
            made.append((name, size))

        for b in batches:
            for i, text in zip(b["item_id"], b["text"], strict=True):
                t = normal(text)
                if not t:
                    continue
                if block and size + len(t) > block_chars:
                    flush()
                    block, size = {}, 0
                size += 0 if t in block else len(t)
                block.setdefault(t, []).append(None if i is None else int(i))
        if block:
            flush()
        yield pd.DataFrame(made, columns=["name", "chars"]).astype({"name": object})

    dealt = rows.select(F.col("item_id").cast("string"), "text").repartition(max(1, -(-chars // block_chars)), F.xxhash64("text"))
    blocks, filled = [], 0
    for name, size in sorted(dealt.mapInPandas(write, "name string, chars long").collect()):
        if not blocks or filled + size > block_chars:
            blocks.append([])
            filled = 0
        blocks[-1].append(name)
        filled += size
    return folder, [tuple(b) for b in blocks]


def _matcher(folder: str, block: tuple[str, ...], chars_per_edit: int) -> Matcher:
    def build() -> Matcher:
        items: dict[str, list] = {}
        for name in block:
            for ids, t in json.loads(read_whole(folder, name)):
                items.setdefault(t, []).extend(ids)
        return Matcher([(ids, t) for t, ids in items.items()], chars_per_edit)

    return kept(("items", folder, block, chars_per_edit), build)


def _found(batches: Iterator, texts, folder: str, blocks: list[tuple[str, ...]], chars_per_edit: int) -> Iterator[tuple]:
    """(batch, hits of each of its texts); with several blocks, batches are held and go through all of them."""

    def through(held):
        out = [[[] for _ in texts(b)] for b in held]
        for block in blocks:
            matcher = _matcher(folder, block, chars_per_edit)
            for b, lists in zip(held, out, strict=True):
                for t, hits in zip(texts(b), lists, strict=True):
                    hits += matcher.hits(t)
        yield from zip(held, out, strict=True)

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += sum(len(t) for t in texts(b) if t)
        if len(blocks) == 1 or size >= HELD_CHARS:
            yield from through(held)
            held, size = [], 0
    if held:
        yield from through(held)


def hits_column(items: DataFrame, text: Column, chars_per_edit: int = CHARS_PER_EDIT, **how) -> Column:
    """An array of (item_id, edits, start) for a text column."""
    bounded_batches(items.sparkSession)
    folder, blocks = write_blocks(items, **how)
    if not blocks:
        return F.array().cast(_HITS)

    @F.pandas_udf(_HITS)
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for _, hits in _found(batches, lambda b: b, folder, blocks, chars_per_edit):
            yield pd.Series(hits, dtype=object)

    return match(text)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_per_edit: int = CHARS_PER_EDIT, **how) -> DataFrame:
    """doc_id, item_id, edits and start (in the normal form) of every item that a document holds."""
    bounded_batches(docs.sparkSession)
    folder, blocks = write_blocks(items, **how)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, found in _found(batches, lambda b: b["text"], folder, blocks, chars_per_edit):
            rows = [(i, *h.values()) for i, hits in zip(b["doc_id"], found, strict=True) for h in hits]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "start"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(search, _PAIRS) if blocks else docs.sparkSession.createDataFrame([], _PAIRS)


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns only."""
    name = "_hits"
    while name in docs.columns:
        name += "_"
    found = docs.withColumn(name, hits_column(items, F.col(text_col), **how))
    return found.filter(F.size(name) == 0).drop(name)
