"""Repeated passages (op3): deep-shallow suffix sorting of the places that can repeat.

A byte goes if a ``WINDOW``-byte string that starts earlier (smaller id, or same document and earlier start) also covers it.

1. Whole copies: of equal texts only the one with the least id is looked at; the others go entirely.
2. Anchors: each window names the position of its least hashed ``GRAM``-byte string, so equal windows name equal
   strings at equal offsets. Only anchors whose string occurs again anywhere can lie in a repeated window.
3. Each such anchor is dealt, by its string, with the bytes of all windows that name it. Equal contexts collapse
   to their first, within a task before the shuffle and then once more; the window starts of the others are the suffixes
   of one text and are sorted to depth ``WINDOW``: by multikey quicksort on eight-byte symbols to a shallow depth
   (groups are split three ways around a pivot until they have ``CUTOFF`` rows, and those sorted at once), then each
   group that still ties goes into a blind trie, which skips the common prefix and branches at the first byte that
   differs. The tries of all groups grow together, one level a round, in numpy. A suffix that is alone leaves, as
   nothing equals it; suffixes that end in one leaf are equal windows; all but the earliest are repeats.
4. Repeated windows are merged for each document and cut out.

Texts are kept once, in one file a bucket of ids, in the shared folder, so that the steps join them without moving them.

Defined results: a null text is empty; texts under ``WINDOW`` bytes keep all; rows that repeat an id are taken in
order of their text's digest, and equal rows one after the other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import bounded_batches, materialize, partitions, shared_dir
from folioflow.llm.shards import number_rows

WINDOW = 100
GRAM = 32
SHALLOW = 16
#: Rows of a group that is sorted at once.
CUTOFF = 256
#: Bytes of text, and windows, that a worker looks at together.
TEXT_AT_ONCE = 1_500_000
WINDOWS_AT_ONCE = 400_000
#: Bytes of distinct contexts that a task collapses at once, and rows that it sorts at once.
HELD = 24_000_000
ROWS_AT_ONCE = 20_000
_PLACE = 24  # bits of a position within the texts that are looked at together


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x, done = np.minimum(x[:-done], x[done:]), 2 * done
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, position, first window, last window, hash) of each anchor; positions within their text."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    off = np.r_[0, np.cumsum(size)]
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < WINDOW:
        return none, none, none, none, none
    h, done, mult = raw.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while done < GRAM:  # hash of 2n bytes from those of n
        h, done, mult = h[:-done] * np.uint64(mult) + h[done:], 2 * done, mult * mult & (1 << 64) - 1
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    place = np.arange(len(h), dtype=np.uint64)
    bits = np.uint64(_PLACE)
    least = _sliding_min((h >> bits << bits) | place, WINDOW - GRAM + 1)
    ends = np.repeat(off[1:], size)[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + WINDOW <= ends)
    if not len(start):
        return none, none, none, none, none
    owner = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(off, start, side="right") - 1
    head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])])
    tail = np.r_[head[1:], len(start)] - 1
    t = text[head]
    return t, owner[head] - off[t], start[head] - off[t], start[tail] - off[t], h[owner[head]].view(np.int64)


def _chunks(rows, chars: int | None = None):
    """Lists of (id, bytes, base, ...) of bounded size from (id, bytes, ...).

    A longer text comes in parts that overlap by one byte less than a window: each window lies in one part.
    """
    chars = chars or TEXT_AT_ONCE
    group, size = [], 0
    for i, body, *rest in rows:
        for base in range(0, max(1, len(body) - WINDOW + 1), chars):
            part = body[base : base + chars + WINDOW - 1]
            if group and size + len(part) > chars:
                yield group
                group, size = [], 0
            group.append((i, part, base, *rest))
            size += len(part)
    if group:
        yield group


# ---- deep-shallow sorting ------------------------------------------------------------------------


def _symbols(text: np.ndarray) -> np.ndarray:
    """At each position the eight bytes from there as one big-endian number (zeros beyond the end)."""
    x = np.r_[text, np.zeros(8, dtype=np.uint8)].astype(np.uint64)
    out = np.zeros(len(text), dtype=np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | x[k : k + len(text)]
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each row lies in."""
    new = np.zeros(len(keys[0]), dtype=bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _ties(group: np.ndarray) -> np.ndarray:
    """Rows (of sorted groups) that are not alone in their group."""
    same = group[1:] == group[:-1]
    return np.flatnonzero(np.r_[same, False] | np.r_[False, same])


def _split(run: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort's three-way splits of sorted runs by symbol: (order, finer runs), until runs are small or of one symbol."""
    order = np.arange(len(run))
    run, live = _runs(run), order
    while len(live):
        head = np.flatnonzero(np.r_[True, np.diff(run[live]) != 0])
        size = np.diff(np.r_[head, len(live)])
        x = s[order[live]]
        mixed = np.minimum.reduceat(x, head) != np.maximum.reduceat(x, head)
        keep = np.repeat(mixed & (size > CUTOFF), size)
        live, x = live[keep], x[keep]
        if not len(live):
            break
        head = np.flatnonzero(np.r_[True, np.diff(run[live]) != 0])
        size = np.diff(np.r_[head, len(live)])
        three = np.sort(np.stack([x[head], x[head + size // 2], x[head + size - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        side = (x >= pivot).astype(np.int64) + (x > pivot)
        key = 3 * run
        key[live] += side
        order[live] = order[live[np.argsort(key[live], kind="stable")]]
        run = _runs(np.sort(key))
    return order, run


def _common(sym: np.ndarray, a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b from ``depth``, at most WINDOW."""
    out, live = depth.copy(), np.arange(len(a))
    while len(live):
        x = sym[a[live] + out[live]] ^ sym[b[live] + out[live]]
        differ = x != 0
        y = x[differ]
        lead = np.zeros(len(y), dtype=np.int64)
        for k in (32, 16, 8):
            high = y >> np.uint64(64 - k) == 0
            lead[high] += k // 8
            y = np.where(high, y << np.uint64(k), y)
        out[live[differ]] += lead
        live = live[~differ]
        out[live] += 8
        live = live[out[live] < WINDOW]
    return np.minimum(out, WINDOW)


def equal_windows(text: np.ndarray, starts: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """Sets of rows (of ``starts``) in one group whose WINDOW bytes are equal, each set of two rows or more.

    ``text`` goes on for WINDOW bytes after each start.
    """
    sym = _symbols(text)
    # Shallow: multikey quicksort with eight-byte symbols; what is alone leaves.
    rows, run = np.arange(len(starts)), group
    for depth in range(0, SHALLOW, 8):
        s = sym[starts[rows] + depth]
        order, run = _split(run, s)
        rows, s = rows[order], s[order]
        order = np.lexsort((s, run))
        rows, run, s = rows[order], run[order], s[order]
        run = _runs(run, s)
        keep = _ties(run)
        rows, run = rows[keep], run[keep]
    # Deep: blind tries of all groups, a level a round.
    depth, done = np.full(len(rows), SHALLOW, dtype=np.int64), []
    while len(rows):
        run = _runs(run)
        head = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        first = starts[rows[head]][run]
        lcp = _common(sym, starts[rows], first, depth)
        branch = np.minimum.reduceat(lcp, head)[run]  # the trie's node: all agree up to here
        leaf = branch >= WINDOW
        if leaf.any():
            whole = rows[leaf]
            done += np.split(whole, np.flatnonzero(np.diff(run[leaf])) + 1)
        rows, run, branch = rows[~leaf], run[~leaf], branch[~leaf]
        edge = text[starts[rows] + branch]
        order = np.lexsort((edge, run))
        rows, run, edge, branch = rows[order], run[order], edge[order], branch[order]
        run = _runs(run, edge)
        keep = _ties(run)
        rows, run, depth = rows[keep], run[keep], branch[keep] + 1
    return done


def _repeats(group: np.ndarray, doc: np.ndarray, first: np.ndarray, contexts: list[bytes]):
    """(doc, start, end) of repeated stretches among distinct contexts; ``first``: where each context begins."""
    size = np.array([len(c) for c in contexts], dtype=np.int64)
    off = np.r_[0, np.cumsum(size)]
    text = np.frombuffer(b"".join(contexts) + bytes(WINDOW + 8), dtype=np.uint8)
    n = size - WINDOW + 1
    ctx = np.repeat(np.arange(len(contexts)), n)
    step = np.arange(len(ctx)) - (np.cumsum(n) - n)[ctx]
    sets = equal_windows(text, off[ctx] + step, group[ctx])
    if not sets:
        return
    rows = np.concatenate(sets)
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    d, s = doc[ctx[rows]], first[ctx[rows]] + step[rows]
    order = np.lexsort((s, d, which))
    late = np.r_[False, which[1:] == which[:-1]]  # in this order, all but the earliest of each set
    bad = np.unique(rows[order][late])
    cut = np.flatnonzero(np.r_[True, (np.diff(bad) != 1) | (ctx[bad][1:] != ctx[bad][:-1])])
    last = np.r_[cut[1:], len(bad)] - 1
    c = ctx[bad[cut]]
    yield doc[c], first[c] + step[bad[cut]], first[c] + step[bad[last]] + WINDOW


def _sort_contexts(key: np.ndarray, doc: np.ndarray, first: np.ndarray, contexts: list[bytes], before: np.ndarray):
    """Repeated stretches among rows sorted by (key, doc, first). ``before``: anchor's offset in its context."""
    seen: dict = {}
    keep, late = [], []
    for i, k in enumerate(zip(key.tolist(), before.tolist(), contexts, strict=True)):
        (late if k in seen else keep).append(i)
        seen.setdefault(k, i)
    late = np.array(late, dtype=np.int64)
    size = np.array([len(c) for c in contexts], dtype=np.int64)
    if len(late):
        yield doc[late], first[late], first[late] + size[late]
    keep = np.array(keep, dtype=np.int64)
    run = _runs(key[keep])
    several = _ties(run)
    keep, run = keep[several], run[several]
    edges = np.r_[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])[: len(run)], len(run)]
    total, at = np.r_[0, np.cumsum(size[keep] - WINDOW + 1)], 0
    while at < len(edges) - 1:  # whole groups, up to so many windows
        to = int(np.searchsorted(total[edges], total[edges[at]] + WINDOWS_AT_ONCE, side="right")) - 1
        to = min(max(to, at + 1), len(edges) - 1)
        some = keep[edges[at] : edges[to]]
        yield from _repeats(run[edges[at] : edges[to]], doc[some], first[some], [contexts[i] for i in some])
        at = to


# ---- the steps -----------------------------------------------------------------------------------


def _sets_of_text(batches):
    for b in batches:
        yield from zip(b["doc_id"].tolist(), b["body"], strict=True)


def _emit_grams(batches):
    for group in _chunks(_sets_of_text(batches)):
        t, _, _, _, h = anchors([bytes(x[1]) for x in group])
        ids = np.array([x[0] for x in group], dtype=np.int64)
        order = np.lexsort((h, t))
        t, h = t[order], h[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])][: len(t)]
        head = np.flatnonzero(new)
        count = np.diff(np.r_[head, len(t)])
        yield pd.DataFrame({"gram": h[head], "doc_id": ids[t[head]], "again": count > 1})


def _emit_shared(batches):
    """Of rows sorted by gram: those whose gram occurs again."""
    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        g = b["gram"].to_numpy()
        if not len(g):
            continue
        # the last row waits for the next batch, and tells it whether it has been joined
        same = g[1:] == g[:-1]
        again = b["again"].to_numpy() | np.r_[same, False] | np.r_[False, same]
        b = b.assign(again=again)
        held = b.iloc[-1:]
        out = b.iloc[:-1]
        yield out.loc[out["again"], ["gram", "doc_id"]]
    if held is not None:
        yield held.loc[held["again"], ["gram", "doc_id"]]


def _wanted(t: np.ndarray, h: np.ndarray, owner: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Anchors (text, hash) that are among the asked (owner, gram); a chance hit only costs work."""
    mixed = lambda i, x: x.view(np.uint64) ^ (i.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.flatnonzero(np.isin(mixed(t, h), mixed(owner, grams)))


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Stretches of each document, those that touch or overlap in one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.r_[True, doc[1:] != doc[:-1]][: len(doc)]
    if len(doc):
        # the furthest end so far within a document: documents are kept apart by their number
        group = np.cumsum(new) - 1
        reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
        new[1:] |= start[1:] > reach[:-1]
        head = np.flatnonzero(new)
        return pd.DataFrame({"doc_id": doc[head], "start": start[head], "end": np.maximum.reduceat(end, head)})
    return pd.DataFrame({"doc_id": doc, "start": start, "end": end})


def _late(found: list[tuple[int, int, int]]) -> pd.DataFrame:
    """Known repeats as rows of the contexts' table: no context, the length as ``before``, a gram that spreads them."""
    x = np.array(found, dtype=np.int64).reshape(-1, 3)
    m = _merged(x[:, 0], x[:, 1], x[:, 2])
    spread = (m["doc_id"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return pd.DataFrame({"gram": spread, "doc_id": m["doc_id"], "first": m["start"], "before": (m["end"] - m["start"]).astype(np.int32), "context": None})


def _reps(seen: dict) -> pd.DataFrame:
    rows = [(g, d, f, b, c) for (b, c), (d, f, g) in seen.items()]
    return pd.DataFrame(rows, columns=["gram", "doc_id", "first", "before", "context"])


def _emit_contexts(batches):
    """Contexts of shared anchors. Of equal contexts a task sends only the earliest; the others are repeats already."""

    def rows():
        for b in batches:
            yield from zip(b["doc_id"].tolist(), b["body"], b["grams"], strict=True)

    seen: dict = {}
    held, late = 0, []
    for group in _chunks(rows()):
        bodies = [bytes(x[1]) for x in group]
        t, p, lo, hi, h = anchors(bodies)
        asked = np.concatenate([np.asarray(x[3], dtype=np.int64) for x in group])
        hit = _wanted(t, h, np.repeat(np.arange(len(group)), [len(x[3]) for x in group]), asked)
        ids, bases = [x[0] for x in group], [x[2] for x in group]
        for i, a, z, k, g in zip(t[hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), (p - lo)[hit].tolist(), h[hit].tolist(), strict=True):
            key = (k, bodies[i][a : z + WINDOW])
            d, a, z = ids[i], a + bases[i], z + bases[i]
            at = seen.get(key)
            if at is None:
                seen[key] = d, a, g
                held += z - a + WINDOW
            elif (at[0], at[1]) <= (d, a):
                late.append((d, a, z + WINDOW))
            else:
                late.append((at[0], at[1], at[1] + z - a + WINDOW))
                seen[key] = d, a, g
        if held > HELD:
            yield _reps(seen)
            seen, held = {}, 0
        if len(late) > WINDOWS_AT_ONCE:
            yield _late(late)
            late = []
    if seen:
        yield _reps(seen)
    if late:
        yield _late(late)


def _emit_repeats(batches):
    """Over rows sorted by gram: whole grams together, up to many rows at once."""
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        size += len(b)
        if size >= ROWS_AT_ONCE and held[0]["gram"].iat[0] != b["gram"].iat[-1]:
            g = b["gram"].to_numpy()
            cut = int(np.searchsorted(g, g[-1]))
            if cut or len(held) > 1 and held[-2]["gram"].iat[-1] != g[-1]:
                yield from _table([*held[:-1], b.iloc[:cut]])
                held, size = [b.iloc[cut:]], len(b) - cut
    if held:
        yield from _table(held)


def _table(parts: list[pd.DataFrame]):
    b = pd.concat(parts, ignore_index=True)
    known = b["context"].isna().to_numpy()
    spans = [b.loc[known, ["doc_id", "first", "before"]].to_numpy(dtype=np.int64)]
    spans[0][:, 2] += spans[0][:, 1]
    b = b.loc[~known]
    cols = [b[c].to_numpy() for c in ("gram", "doc_id", "first")]
    spans += [np.stack(x, axis=1) for x in _sort_contexts(*cols, b["context"].tolist(), b["before"].to_numpy())]
    x = np.concatenate(spans)
    yield _merged(x[:, 0], x[:, 1], x[:, 2])


def cut_out(body: bytes, spans) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left)."""
    if spans is None or not len(spans):
        return 0, 0, body
    kept, at, removed, runs, stop = [], 0, 0, 0, -1
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if s > stop:
            runs += 1
            kept.append(body[at:s])
            removed += e - s
            stop = e
        elif e > stop:
            removed += e - stop
            stop = e
        at = stop
    return removed, runs, b"".join([*kept, body[at:]])


def _emit_results(batches):
    for b in batches:
        out = []
        for doc_id, body, first, spans in zip(b["doc_id"], b["body"], b["is_first"], b["spans"], strict=True):
            body = bytes(body)
            n, runs, left = cut_out(body, spans) if first or len(body) < WINDOW else (len(body), 1, b"")
            out.append((doc_id, len(body), n, runs, hashlib.sha256(left).hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_unique_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` as (doc_id, body, digest) with ids that are unique and not null; and the table of their own ids, if they weren't."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("body", 256)))
    n, known, several = rows.select(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == known == several:
        return rows, None
    placed, first, at = number_rows(rows, ["doc_id", "digest"], "numbered")
    starts = docs.sparkSession.createDataFrame(list(enumerate(first)), "_part long, _first long")  # a row a partition
    placed = placed.join(F.broadcast(starts), F.shiftright(at, 33) == F.col("_part"))
    placed = placed.withColumn("number", F.col("_first") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.select(F.col("number").alias("doc_id"), "body", "digest"), placed.select("number", "doc_id")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions(spark)
    rows, names = _with_unique_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    name = f"folioflow_{uuid.uuid4().hex}"
    rows.repartition(n, "doc_id").write.bucketBy(n, "doc_id").option("path", shared_dir(spark, "texts")).format("parquet").saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog forgets it; the files stay for ``texts``
    firsts = texts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("is_first"))
    firsts = materialize(firsts, "firsts")
    long_first = texts.filter(F.octet_length("body") >= WINDOW).select("doc_id", "body").join(firsts.hint("shuffle_hash"), "doc_id", "left_semi")
    grams = long_first.mapInPandas(_emit_grams, "gram long, doc_id long, again boolean")
    shared = grams.repartition(n, "gram").sortWithinPartitions("gram").mapInPandas(_emit_shared, "gram long, doc_id long")
    asked = materialize(shared.groupBy("doc_id").agg(F.collect_list("gram").alias("grams")), "asked")
    places = texts.select("doc_id", "body").join(asked.hint("shuffle_hash"), "doc_id")
    contexts = places.select("doc_id", "body", "grams").mapInPandas(_emit_contexts, "gram long, doc_id long, first long, before int, context binary")
    dealt = contexts.repartition(n, "gram").sortWithinPartitions("gram", "doc_id", "first")
    spans = dealt.mapInPandas(_emit_repeats, "doc_id long, start long, end long")
    spans = materialize(spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    marks = firsts.join(spans, "doc_id", "left")
    out = texts.select("doc_id", "body").join(marks.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "body", F.coalesce("is_first", F.lit(False)).alias("is_first"), "spans")
    out = out.mapInPandas(_emit_results, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if names is None:
        return out
    return out.withColumnRenamed("doc_id", "number").join(names, "number").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d WHERE len(h) >= 200),
k AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS m FROM w),
b AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS r FROM k) WHERE r > 1),
n AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM b),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM n),
s AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM g GROUP BY doc_id, g),
q AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS past FROM s),
f AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * past + 1, 2 * (s - past)), '' ORDER BY s) AS kept
      FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN f USING (doc_id)
"""
