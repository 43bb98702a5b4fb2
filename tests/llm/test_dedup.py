"""op2, op3, op7 against brute force."""

import hashlib
import random
import time

import numpy as np
import pandas as pd
import pytest
import xxhash

from folioflow.llm import components, decontaminate, simhash, simhash_similar, substrings


def words(rng, n):
    return " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(n))


# ---- op2


def distance(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        before = row
    return min(before)


def test_myers_is_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        k, want = rng.randint(0, 8), distance(item, text)
        found = decontaminate.myers(item, text, k)
        assert (found[0] if found else None) == (want if want <= k else None)


def test_pieces_find_every_near_passage():
    rng = random.Random(2)
    items = [(i, decontaminate.normal(words(rng, 30))) for i in range(8)]
    matcher = decontaminate.Matcher([([i], t) for i, t in items])
    hits = 0
    for _ in range(200):
        i, t = rng.choice(items)
        x = list(t)
        for _ in range(rng.randint(0, len(t) // decontaminate.CHARS_PER_EDIT + 2)):
            p = rng.randrange(len(x))
            x[p : p + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
        text = decontaminate.normal(f"{words(rng, rng.randint(0, 20))} {''.join(x)} {words(rng, rng.randint(0, 20))}")
        want = distance(t, text)
        got = [h["edits"] for h in matcher.hits(text) if h["item_id"] == i]
        hits += bool(got)
        assert got == ([want] if want <= len(t) // decontaminate.CHARS_PER_EDIT else [])
    assert hits > 50


def plain_hits(docs, items):
    """(doc_id, item_id, edits) of all items against all texts, by the whole table of distances."""
    out = []
    for d, text in docs:
        t = decontaminate.normal(text or "")
        for i, item in items:
            x = decontaminate.normal(item or "")
            if not x or not t:
                continue
            if len(x) < decontaminate.MIN_CHARS:
                out += [(d, i, 0)] * (f" {x} " in f" {t} ")
            elif (n := distance(x, t)) <= len(x) // decontaminate.CHARS_PER_EDIT:
                out.append((d, i, n))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_chars", [60, 1_000_000])
def test_all_items_against_all_texts(spark, block_chars, monkeypatch):
    """Short, repeated, null and repetitive items against texts that hold them whole, changed, in parts, or many times."""
    rng = random.Random(31)
    items = [(i, words(rng, rng.choice([3, 5, 12, 30]))) for i in range(10)]
    items += [(20, "a" * 60), (21, "ab" * 40), (22, "dcba"), (23, items[0][1].upper()), (24, None), (25, "--"), (None, items[3][1]), (26, "é" * 25)]
    docs = []
    for n in range(60):
        x = list(rng.choice(items[:10])[1])
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = rng.choice(["", "z", "q "])
        docs.append((n, f"{words(rng, 9)} {''.join(x)} {words(rng, rng.randint(0, 9))}"))
    docs += [(100, "a" * 300), (101, ("a" * 50 + "bb") * 6), (102, "ab" * 200), (103, "x dcba y"), (104, "xdcba"), (105, None), (106, ""), (107, "dcba"), (None, items[0][1]), (100, "a" * 40 + "é" * 30)]
    frame = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, edits int")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(frame, table, block_chars=block_chars).collect()]
    want = plain_hits(docs, items)
    assert sorted(got, key=str) == want and len(want) > 40
    kept = decontaminate.keep_clean(frame, table, block_chars=block_chars).collect()
    assert len(kept) == sum(not plain_hits([d], items) for d in docs)


def test_repetitive_texts_take_seconds():
    matcher = decontaminate.Matcher([([1], "a" * 400), ([2], "ab" * 100)])
    began = time.time()
    assert [h["item_id"] for h in matcher.hits("a" * 1_000_000)] == [1]
    assert matcher.hits(("a" * 300 + "b" * 60) * 600) == []
    assert time.time() - began < 60


def test_contaminated_rows(spark):
    rng = random.Random(3)
    passage = words(rng, 30)
    docs = [(1, f"Before. {passage.upper()} after"), (2, words(rng, 60)), (3, None), (4, ""), (1, passage), (5, passage.replace("a", "b", 3))]
    items = spark.createDataFrame([(7, passage), (8, None), (9, ""), (10, "short item"), (11, passage)], "item_id long, text string")
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id long")
    rows = decontaminate.contaminated(frame, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == sorted((d, i) for d in (1, 1, 5) for i in (7, 11))
    assert decontaminate.contaminated(frame, items, block_chars=1).count() == 6  # every item a block of its own
    kept = decontaminate.keep_clean(frame, items)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert decontaminate.contaminated(frame, items.limit(0)).count() == 0
    assert decontaminate.keep_clean(frame, items.limit(0)).count() == 6


# ---- op3


def removed(docs):
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()))
    seen, out = set(), []
    for doc, text in docs:
        b = (text or "").encode()
        bad = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                bad[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        runs = sum(x and not y for x, y in zip(bad, b"\0" + bad))
        out.append((doc, len(b), sum(bad), runs, hashlib.sha256(bytes(x for x, y in zip(b, bad) if not y)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("cutoff", [0, 1, 5, 256])
def test_equal_windows(cutoff, monkeypatch):
    monkeypatch.setattr(substrings, "CUTOFF", cutoff)
    rng = random.Random(4)
    text = np.frombuffer("".join(rng.choice("ab") * rng.randint(1, 60) for _ in range(60)).encode() + bytes(120), dtype=np.uint8)
    starts = np.arange(len(text) - 120)
    got = {frozenset(s.tolist()) for s in substrings.equal_windows(text, starts, np.zeros(len(starts), dtype=np.int64))}
    by = {}
    for s in starts.tolist():
        by.setdefault(text[s : s + 100].tobytes(), set()).add(s)
    assert got == {frozenset(x) for x in by.values() if len(x) > 1}


def in_one_process(docs):
    """The steps of op3 without Spark, for small limits: (id, start, end) of all repeats."""
    rows = pd.DataFrame({"doc_id": [i for i, _ in docs], "body": [t.encode() for _, t in docs]})
    grams = pd.concat(substrings._emit_grams(iter([rows]))).sort_values("gram", ignore_index=True)
    shared = pd.concat(substrings._emit_shared(iter([grams[:7], grams[7:]])))
    asked = shared.groupby("doc_id")["gram"].apply(list)
    places = rows[rows.doc_id.isin(asked.index)].assign(grams=lambda d: [asked[i] for i in d.doc_id])
    contexts = pd.concat(substrings._emit_contexts(iter([places]))).sort_values(["gram", "doc_id", "first"], ignore_index=True)
    cuts = list(range(0, len(contexts), 9))
    return pd.concat(substrings._emit_repeats(contexts[i : i + 9] for i in cuts))


@pytest.mark.parametrize("limit", [300, 1_500_000])
def test_small_limits_change_nothing(limit, monkeypatch):
    rng = random.Random(15)
    base = [words(rng, 200) for _ in range(3)]
    docs = [(i, rng.choice(base)[rng.randint(0, 80) : rng.randint(90, 700)] + words(rng, 10) + rng.choice(base)[: rng.randint(60, 400)]) for i in range(20)]
    monkeypatch.setattr(substrings, "TEXT_AT_ONCE", limit)
    monkeypatch.setattr(substrings, "WINDOWS_AT_ONCE", limit)
    monkeypatch.setattr(substrings, "HELD", limit)
    monkeypatch.setattr(substrings, "ROWS_AT_ONCE", 10)
    spans = in_one_process(docs)
    for doc, n, gone, runs, digest in removed(docs):
        mine = spans[spans.doc_id == doc]
        got, count, left = substrings.cut_out(dict(docs)[doc].encode(), [{"start": s, "end": e} for s, e in zip(mine.start, mine.end)])
        assert (got, count, hashlib.sha256(left).hexdigest()) == (gone, runs, digest) and n == len(dict(docs)[doc])


@pytest.mark.parametrize("repeated", [False, True])
def test_repeats(spark, repeated):
    rng = random.Random(5)
    base = [words(rng, 80) for _ in range(6)]
    docs = [(i, rng.choice(base)[rng.randint(0, 80) : rng.randint(90, 400)] + words(rng, rng.randint(0, 30)) + rng.choice(base)[rng.randint(0, 50) : rng.randint(60, 400)]) for i in range(50)]
    docs += [(100, "a" * 1000), (101, "b" * 500 + "a" * 150), (102, "ab" * 300), (103, None), (104, ""), (105, "é" * 80), (106, "x" + "é" * 80), (107, "a" * 100)]
    if repeated:
        docs += [*docs[:5], (3, words(rng, 40)), (None, base[0])]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_bytes int, spans string")
    got = [tuple(r) for r in substrings.remove_repeats(frame).collect()]
    assert sorted(got, key=str) == removed(docs)


def test_no_table_is_left(spark):
    substrings.remove_repeats(spark.createDataFrame([(1, "a" * 300), (2, "a" * 300)], "doc_id long, text string")).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("folioflow")]


def test_no_texts(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- op7


def plain_fingerprint(text):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two three four", "Ä b C d e", "a b c d " * 50, "x" * 10_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def plain_components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(999, i) for i in range(900, 930)]
    pairs += [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(90)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == plain_components((a, b) for a, b in pairs if a != b)


@pytest.mark.parametrize("hot", [50_000, 40])
def test_links_of_a_dense_group(spark, hot):
    """Fingerprints around a few centres, in chains too: components are those of all pairs."""
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(100)}
    for _ in range(3):
        c = rng.getrandbits(64)
        for _ in range(80):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
        for _ in range(20):
            c ^= sum(1 << b for b in rng.sample(range(64), 4))
            fps.add(c)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long")
    edges = [(r.a, r.b) for r in simhash.links(nodes, hot).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in edges)
    want = plain_components((i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4)
    assert plain_components(edges) == want


def test_runs_grow_with_the_nodes():
    """Any two fingerprints within the radius agree in as many runs as a key takes, at every size."""
    rng = random.Random(9)
    for n, bits in ((1, 12), (200_000, 18), (1 << 22, 22), (1 << 30, 30), (3 * 10**10, 35)):
        runs = simhash.runs_for(n)
        assert sum(w for _, w in runs) == 64 and sum(sorted(w for _, w in runs)[: len(runs) - 4]) >= bits
        for _ in range(200):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert sum(not x >> a & (1 << w) - 1 for a, w in runs) >= len(runs) - 4


def test_keys_at_any_number_of_runs(spark, monkeypatch):
    rng = random.Random(10)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for x in fps for _ in range(3)]
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, node long")
    want = plain_components((i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4)
    runs_for = simhash.runs_for
    for n in (1, 1 << 22, 1 << 30):
        monkeypatch.setattr(simhash, "runs_for", lambda _, n=n: runs_for(n))
        assert plain_components((r.a, r.b) for r in simhash.links(nodes).collect()) == want


def test_pivots_discard_most_pairs():
    rng = np.random.default_rng(11)
    fps = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    table = np.bitwise_count(fps[:, None] ^ simhash.pivots()[None, :]).astype(np.int16)
    i, j = np.triu_indices(400, 1)
    left = (np.abs(table[i] - table[j]).max(axis=1) <= simhash.RADIUS).sum()
    assert left < 0.01 * len(i)
    base = [rng.integers(0, 1 << 63, 300, dtype=np.uint64) for _ in range(4)]  # groups of near copies, as in the pipeline
    sets = [np.unique(np.r_[b[:280], rng.integers(0, 1 << 63, 20, dtype=np.uint64)]) for b in base for _ in range(25)]
    pivots = simhash_similar.Pivots(sets)
    by_table = [len(pivots.near(i, np.arange(100))[0]) for i in range(100)]
    assert all(set(range(i // 25 * 25, i // 25 * 25 + 25)) <= set(pivots.near(i, np.arange(100))[1].tolist()) for i in range(100))
    assert np.mean(by_table) < 50  # of 100, 25 of them near


def test_near_duplicates(spark):
    rng = random.Random(8)
    texts = [words(rng, 200) for _ in range(5)]
    docs = [(i, texts[i % 5] + (" tail" if i > 9 else "")) for i in range(15)] + [(50, None), (51, ""), (3, texts[3]), (None, texts[0]), (60, "one two")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, component_id string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(frame).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in docs]
    group = plain_components([(i, j) for i in range(len(docs)) for j in range(i + 1) if (fps[i] ^ fps[j]).bit_count() <= 4])
    want = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if group[j] == group[i] and docs[j][0] is not None]
        want.append((d, f"{fps[i]:016x}", min(ids)))
    assert got == sorted(want, key=str)
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({x[2] for x in want})
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_keep_first_names_rows_not_ids(spark):
    """Rows without an id and rows that share one stay if their texts resemble no other."""
    rng = random.Random(21)
    a, b, c, d = (words(rng, 200) for _ in range(4))
    rows = [(1, a), (1, b), (2, a), (None, c), (None, c), (None, b), (3, d), (3, d)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(1, a), (1, b), (None, c), (3, d)], key=str)
    assert sorted((tuple(r) for r in simhash.keep_first(frame).collect()), key=str) == want
    assert sorted((tuple(r) for r in simhash_similar.keep_first(frame).collect()), key=str) == want


# ---- SimHash against a similarity, as in the pipeline


@pytest.mark.parametrize("chunk", [1 << 19, 900])
def test_near_copies(spark, chunk):
    """Copies with edited words, in chains too, against all pairs of shingle sets."""
    rng = random.Random(22)
    docs = []
    for _ in range(12):
        text = words(rng, rng.choice([60, 150, 400])).split()
        for _ in range(rng.randint(1, 8)):
            docs.append(" ".join(text))
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = "edited"
    docs += ["one two", "One  Two", "", " ", "lone"]
    rng.shuffle(docs)
    sets = []
    for t in docs:
        w = t.lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [(i, j) for i in range(len(docs)) for j in range(i + 1) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    far = [(i, j) for i, j in near if (plain_fingerprint(docs[i]) ^ plain_fingerprint(docs[j])).bit_count() > 4]
    assert len(far) > 10
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    kept = simhash_similar.keep_first(frame, chunk=chunk)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_components(near).values()))
    assert simhash_similar.keep_first(frame.limit(0)).count() == 0
