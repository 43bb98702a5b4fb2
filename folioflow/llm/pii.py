"""Personal data (op5): base patterns, and a linear-chain conditional random field over word shapes.

Base spans are leftmost, non-overlapping matches of one pattern a kind (email, ip, card, phone), dropped where
their check fails. They are found by linear scans: no pattern restarts inside a run that it has read.

The field labels blank-separated words. A word's shape is a code packed from nine small attributes (digits,
letters, at signs, dots, hyphens, ...); a label's score is the sum of weights of the attributes of the
word and of its neighbours, so scoring is three table look-ups a word. It is trained by gradient
ascent on a small labelled table, on the driver: ``labelled_table()``, a few hundred made-up sentences with forms that
the patterns miss, and on request at most ``SAMPLE`` pieces of lines of documents (:func:`labelled_lines`), labelled
where a base pattern stands. It is decoded by Viterbi over all lines of a batch at once, in numpy. It finds what the patterns
miss: phones without a plus sign, spelled-out emails, cards with other separators. A span of the field is added only
where it passes its kind's check (:func:`plausible`) and no base span overlaps it.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; repeated rows are
judged one by one; other columns are not read; an empty table gives no rows (and a model of made-up sentences).
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_batches, together, trim

KINDS = ("email", "ip", "card", "phone")
#: Characters of texts that the field looks at together.
CHARS_AT_ONCE = 250_000

# ---- base patterns -------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_DIGITS = re.compile(r"[0-9]++(?:[ -]?+[0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str):
    cursor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            cursor = m.end()
        else:
            cursor = at + 1
        at = text.find("@", cursor)


def _ips(text: str):
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _cards(text: str):
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.start(), m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out: list = []
    if "@" in text:
        out += (("email", *s) for s in _emails(text))
    out += (("ip", *s) for s in _ips(text))
    out += (("card", *s) for s in _cards(text))
    if "+" in text:
        out += (("phone", *s) for s in _phones(text))
    return out


# ---- word shapes ---------------------------------------------------------------------------------

#: Labels: outside, and for each kind its first and its further words.
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_L = len(LABELS)
#: Attributes of a shape and their number of values.
ATTRIBUTES = {"digits": 9, "letters": 3, "at": 2, "dots": 4, "hyphens": 3, "plus": 2, "bracket": 3, "length": 6, "other": 2}
_SIZES = np.array(list(ATTRIBUTES.values()))
_BASES = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
_CODES = int(_SIZES.prod())
_DIGIT_BUCKET = np.array([0, 1, 1, 2, 3, 4, 4, 4, 5, 5, 5, 6, 6, 6, 6, 6, 7, 7, 7, 7, 8], dtype=np.int64)
_LENGTH_BUCKET = np.array([0, 0, 1, 2, 3, 4, 4, 4, 4, 5], dtype=np.int64)
# classes of characters: 0 blank, 1 digit, 2 letter, 3 at, 4 dot, 5 hyphen, 6 plus, 7 opening, 8 closing bracket, 9 closing mark, 10 other
_CLASS = np.full(128, 10, dtype=np.uint8)
for _chars, _k in ((" \t\n\x0b\x0c\r", 0), ("0123456789", 1), ("@", 3), (".", 4), ("-", 5), ("+", 6), ("([", 7), (")]", 8), (",;:!?", 9)):
    for _ch in _chars:
        _CLASS[ord(_ch)] = _k
_CLASS[65:91] = _CLASS[97:123] = 2


def shape_codes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, codes) of the words in an array of code points; ends leave out closing marks and dots."""
    kind = np.where(points < 128, _CLASS[np.minimum(points, 127)], 2).astype(np.uint8)
    word = np.r_[False, kind != 0, False]
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, starts
    for _ in range(2):  # at most two closing marks
        last = kind[ends - 1]
        ends = ends - (((last == 9) | (last == 4)) & (ends - starts > 1))

    def count(k):
        total = np.r_[0, np.cumsum(kind == k, dtype=np.int32)]
        return total[ends] - total[starts]

    digits, letters, size = count(1), count(2), ends - starts
    first = kind[starts]
    attrs = [
        _DIGIT_BUCKET[np.minimum(digits, 20)],
        np.where(letters == 0, 0, np.where(letters <= 3, 1, 2)),
        np.minimum(count(3), 1),
        np.minimum(count(4), 3),
        np.minimum(count(5), 2),
        first == 6,
        np.where(first == 7, 1 + (kind[np.minimum(starts + 1, len(kind) - 1)] == 2), 0),
        _LENGTH_BUCKET[np.minimum(size, 9)],
        count(10) > 0,
    ]
    code = np.zeros(len(starts), dtype=np.int64)
    for a, n in zip(attrs, _SIZES, strict=True):
        code = code * n + a
    return starts, ends, code


@lru_cache(1)
def _attribute_rows() -> np.ndarray:
    """The one-hot places of each code's attributes: (codes, attributes)."""
    code, out = np.arange(_CODES), []
    for n in _SIZES[::-1]:
        out.append(code % n)
        code = code // n
    return np.stack(out[::-1], axis=1) + _BASES


# ---- the model -----------------------------------------------------------------------------------


def _fill(rng: random.Random) -> dict[str, str]:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 10)))
    return {
        "phone": rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}"]),
        "email": rng.choice([f"{w()}.{d(2)} [at] {w()} [dot] com", f"{w()} (at) {w()} (dot) org", f"{w()}.{d(2)}@{w()}.example.com", f"{w()} [at] {w()}.net"]),
        "card": rng.choice([d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", f"{d(4)}.{d(4)}.{d(4)}.{d(4)}"]),
        "ip": f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 254)}",
        "none": rng.choice([f"{rng.randint(1900, 2030)}", f"{d(1)}.{d(1)}", f"{d(2)}", f"{d(1)},{d(3)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"{d(2)}:{d(2)}", f"{d(3)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(1)}", f'"{w()}{d(12)}{w()}"', f"http://{w()}.com/{d(5)}", f"@{w()}", f"{d(5)}", f"#{d(4)}", f"[{w()}]", f"({w()})", f"{w()}-{w()}", f"{d(3)}-{d(2)}", f"{d(6)}-{d(2)}", f"{d(8)}", f"{d(12)}", f"({d(1)})", f"[{d(2)}]", f"{w()}{d(2)}", f"{d(4)}/{d(2)}"]),
    }


def labelled_table(n: int = 300, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """``n`` sentences as (words, labels): ordinary words, numbers that aren't personal, and the four kinds."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        words, labels = [], []
        for _ in range(rng.randint(1, 4)):
            for _ in range(rng.randint(0, 4)):
                words.append("".join(rng.choice("aeioulnrstäéñ") for _ in range(rng.randint(1, 12))) + rng.choice(["", "", "", ",", "."]))
                labels.append("O")
            kind = rng.choice([*KINDS, "none", "none", "none", "plain", "plain"])
            if kind != "plain":
                parts = _fill(rng)[kind].split(" ")
                labels += ["O"] * len(parts) if kind == "none" else [f"{'I' if i else 'B'}-{kind}" for i in range(len(parts))]
                parts[-1] += rng.choice(["", "", "", ",", "."])
                words += parts
        if words:
            out.append((words, labels))
    return out


#: Pieces of documents that the field may learn from, of one document, and words on each side of a piece's span.
SAMPLE = 200
PIECES_EACH = 4
AROUND = 5
_PERSONAL = r"@[A-Za-z0-9]|\+[0-9]|[0-9]{16}|\.[0-9]+\."


def labelled_pieces(text: str, most: int = PIECES_EACH) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of pieces of lines around base spans; without those that hold card numbers that aren't spans."""
    out = []
    for line in text.split("\n"):
        spans = sorted((s, e, k) for k, s, e in base_spans(line))
        if len(out) >= most or not spans:
            continue
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
        hit = [next((x for x in spans if x[0] < e and s < x[1]), None) for s, e in words]
        first = next(i for i, x in enumerate(hit) if x)
        piece = range(max(0, first - AROUND), min(len(words), first + AROUND + 4))
        labels = ["O" if hit[i] is None else f"{'I' if i > piece[0] and hit[i - 1] == hit[i] else 'B'}-{hit[i][2]}" for i in piece]
        chunk = [line[slice(*words[i])] for i in piece]
        if all(x != "O" or not re.search("[0-9]{12}", w) for x, w in zip(labels, chunk, strict=True)):
            out.append((chunk, labels))
    return out


def labelled_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[tuple[list[str], list[str]]]:
    """The first ``sample`` labelled pieces of documents with likely spans, by the hash of their document's id; one scan of the texts."""

    def label(batches):
        for b in batches:
            done = [(i, n, *x) for i, text in zip(b["doc_id"], b["text"], strict=True) for n, x in enumerate(labelled_pieces(text))]
            yield pd.DataFrame(done, columns=["doc_id", "n", "words", "labels"])

    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(_PERSONAL))
    rows = some.mapInPandas(label, "doc_id long, n int, words array<string>, labels array<string>").distinct()
    return [(r.words, r.labels) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "n", "words").limit(sample).collect()]


def _allowed() -> np.ndarray:
    """Transition mask: a further word follows only its own kind."""
    ok = np.zeros((_L, _L))
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            for i, at in enumerate(LABELS):
                if at == "O" or at[2:] != to[2:]:
                    ok[i, j] = -1e9
    return ok


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[list[str], list[str]]], steps: int = 60, rate: float = 0.2, penalty: float = 1e-3) -> dict[str, np.ndarray]:
    """Maximum likelihood with a square penalty, by Adam over the whole table; returns score tables by shape code."""
    width, rows = int(_SIZES.sum()), _attribute_rows()
    t_max = max(len(w) for w, _ in table)
    n = len(table)
    code, gold, mask = np.zeros((n, t_max), dtype=np.int64), np.zeros((n, t_max), dtype=np.int64), np.zeros((n, t_max))
    for i, (words, labels) in enumerate(table):
        _, _, c = shape_codes(_points(" ".join(words)))
        code[i, : len(c)], gold[i, : len(c)], mask[i, : len(c)] = c, [LABELS.index(x) for x in labels], 1
    feats = np.zeros((n, t_max, 3 * width))
    one = np.zeros((_CODES, width))
    np.put_along_axis(one, rows, 1, axis=1)
    feats[:, :, :width] = one[code]
    feats[:, 1:, width : 2 * width] = one[code[:, :-1]]
    feats[:, :-1, 2 * width :] = one[code[:, 1:]] * mask[:, 1:, None]
    feats *= mask[:, :, None]
    flat, ok = feats.reshape(n * t_max, -1), _allowed()
    ban = np.array([-1e9 if x[0] == "I" else 0 for x in LABELS])
    w, tr = np.zeros((3 * width, _L)), np.zeros((_L, _L))
    goal = np.zeros((n, t_max, _L))
    np.put_along_axis(goal, gold[:, :, None], mask[:, :, None], axis=2)
    moved = mask[:, 1:] * mask[:, :-1]
    goal_tr = np.einsum("nti,ntj,nt->ij", goal[:, :-1], goal[:, 1:], moved)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    for step in range(1, steps + 1):
        e = (flat @ w).reshape(n, t_max, _L)
        t = tr + ok
        alpha, beta = np.zeros((n, t_max, _L)), np.zeros((n, t_max, _L))
        alpha[:, 0] = e[:, 0] + ban
        for k in range(1, t_max):
            alpha[:, k] = np.where(mask[:, k, None] > 0, _lse(alpha[:, k - 1, :, None] + t, 1) + e[:, k], alpha[:, k - 1])
        for k in range(t_max - 2, -1, -1):
            beta[:, k] = np.where(mask[:, k + 1, None] > 0, _lse(t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2), 0)
        z = _lse(alpha[:, -1], 1)
        p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * mask[:, :, None]
        pair = np.exp(np.minimum(alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None, :] - z[:, None, None, None], 0)) * moved[:, :, None, None]
        for x, g, i in ((w, flat.T @ (goal - p).reshape(n * t_max, _L) / n - penalty * w, 0), (tr, (goal_tr - pair.sum((0, 1))) / n - penalty * tr, 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
            x += rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.99**step)) + 1e-8)
    tables = [w[k * width : (k + 1) * width][rows].sum(axis=1).astype(np.float32) for k in range(3)]
    return {"own": tables[0], "before": tables[1], "after": tables[2], "move": (tr + ok).astype(np.float32), "first": ban.astype(np.float32)}


def viterbi(model: dict[str, np.ndarray], codes: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best label of each word; sequence i is codes[heads[i] : heads[i] + sizes[i]], sizes falling and above 0."""
    e = model["own"][codes]
    same = np.ones(len(codes), dtype=bool)
    same[heads] = False
    inner = np.flatnonzero(same)
    e[inner] += model["before"][codes[inner - 1]]
    e[inner - 1] += model["after"][codes[inner]]
    back = np.zeros((len(codes), _L), dtype=np.int8)
    label = np.zeros(len(codes), dtype=np.int8)
    move = np.ascontiguousarray(model["move"].T)  # to, from
    live = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right") if len(sizes) else []
    score = e[heads] + model["first"]
    done = np.zeros(len(heads), dtype=np.int8)
    for t in range(1, len(live)):
        n, ended = live[t], live[t - 1]
        done[n:ended] = score[n:ended].argmax(axis=1)
        at = heads[:n] + t
        cand = score[:n, None, :] + move
        arg = cand.argmax(axis=2)
        back[at] = arg
        score = np.take_along_axis(cand, arg[:, :, None], axis=2)[:, :, 0] + e[at]
    done[: len(score)] = score.argmax(axis=1) if len(score) else done[:0]
    now = done.astype(np.int64)
    for t in range(len(live) - 1, -1, -1):
        at = heads[: live[t]] + t
        label[at] = now[: live[t]]
        if t:
            now[: live[t]] = back[at, now[: live[t]]]
    return label


def _trimmed(word: str) -> tuple[int, int]:
    """A word's part without marks around it; a bracket before digits stays."""
    a, b = 0, len(word)
    while b > a and word[b - 1] in ".,;:!?\"'*&%$#":
        b -= 1
    while a < b and word[a] in "\"'*&%$#":
        a += 1
    return a, b


def field_spans(model: dict[str, np.ndarray], texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The field's spans of each text, by start. Lines are the sequences."""
    joined = "\n".join(texts)
    points = _points(joined)
    starts, ends, codes = shape_codes(points)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not len(starts):
        return out
    line = np.r_[0, np.cumsum(points == 10)][starts]
    heads = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    sizes = np.diff(np.r_[heads, len(starts)])
    order = np.argsort(-sizes, kind="stable")
    label = viterbi(model, codes, heads[order], sizes[order])
    first = np.flatnonzero(label % 2 == 1)  # B labels
    offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(offset, starts[first], side="right") - 1
    for i, d in zip(first.tolist(), doc.tolist(), strict=True):
        j = i
        while j + 1 < len(label) and label[j + 1] == label[i] + 1 and line[j + 1] == line[i]:
            j += 1
        s, e = int(starts[i] - offset[d]), int(ends[j] - offset[d])
        a, b = _trimmed(texts[d][s:e])
        if b > a:
            out[d].append((LABELS[label[i]][2:], s + a, s + b))
    return out


def plausible(kind: str, text: str) -> bool:
    """The check of a span that the field found."""
    digits = "".join(c for c in text if c in "0123456789")
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return len(re.findall(r"[^\W_]+", text)) >= 3


def all_spans(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those others that overlap none of them, by kind as listed, then start."""
    if not more:
        return base
    by_start = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in by_start]
    reach = list(accumulate((e for _, e in by_start), max))  # the furthest end of the spans up to each
    extra = [x for x in more if not (n := bisect_left(starts, x[2])) or reach[n - 1] <= x[1]]
    return sorted([*base, *extra], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find(model: dict[str, np.ndarray], texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    out = []
    for group in together(texts, CHARS_AT_ONCE):
        for t, more in zip(group, field_spans(model, group), strict=True):
            base = base_spans(t)
            out.append((base, all_spans(base, [x for x in more if plausible(x[0], t[x[1] : x[2]])])))
    return out


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind in capitals and angle brackets."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += (text[at:s], f"<{k.upper()}>")
        at = max(at, e)
    return "".join([*out, text[at:]])


@lru_cache(1)
def trained() -> dict[str, np.ndarray]:
    return train(labelled_table())


def trained_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, np.ndarray]:
    """A model of the made-up sentences and of lines of ``docs``."""
    lines = labelled_lines(docs, id_col, text_col)
    return train(labelled_table() + lines) if lines else trained()


def _shipped(spark, model):
    return spark.sparkContext.broadcast(model or trained())  # tables by shape code: of fixed size


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model=None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_added of every text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = _shipped(spark, model)

    def run(batches):
        for b in batches:
            found = find(shipped.value, b["text"].tolist())
            out = {"doc_id": b["doc_id"]}
            for k in KINDS:
                out[f"n_{k}"] = [sum(x[0] == k for x in base) for base, _ in found]
            out["base_sha256"] = [hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in found]
            out["spans"] = [spelled(spans) for _, spans in found]
            out["n_added"] = [len(spans) - len(base) for base, spans in found]
            yield pd.DataFrame(out)
        trim()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted_column(spark, text: Column, model=None) -> Column:
    """``text`` with all spans replaced; null stays null."""
    bounded_batches(spark)
    shipped = _shipped(spark, model)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        known = [t or "" for t in texts]
        done = [redact(t, spans) for t, (_, spans) in zip(known, find(shipped.value, known), strict=True)]
        return pd.Series([None if t is None else d for t, d in zip(texts, done, strict=True)], dtype=object)

    return clean(text)
