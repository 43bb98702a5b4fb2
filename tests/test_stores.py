"""Versioned tables, streams that resume, indexes on disk."""

import math
import os
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions.text import STOPWORDS
from folioflow.operators import digests as D
from folioflow.operators import passages as X
from folioflow.operators import retrieval as T
from folioflow.operators import vectors as V2
from folioflow.sources import readers as R
from folioflow.sources import sinks as S
from folioflow.sources import versions as V
from folioflow.streaming import resume as W


def answered(df):
    return df.withColumn("answer", F.when(F.col("id") != 3, F.lit("ok")))


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a stream over what is in its folder; returns the answers."""

    def run(process=answered, deltas=50):
        records = spark.readStream.schema("id int").parquet(f"{tmp_path}/in")
        W.resume(records, f"{tmp_path}/out", f"{tmp_path}/cp", ["id"], "answer", process, deltas).awaitTermination()
        return sorted((r.id, r.answer) for r in W.answers(spark, f"{tmp_path}/out", ["id"]).collect())

    def add(ids):
        spark.createDataFrame([(i,) for i in ids], "id int").write.mode("append").parquet(f"{tmp_path}/in")

    return run, add


def test_a_batch_that_runs_again_keeps_its_answers(spark, tmp_path, stream):
    """The checkpoint's commit of a batch is lost, as after a crash between the answers and it."""
    run, add = stream
    add([1, 2, 3, 4, 5])
    want = [(1, "ok"), (2, "ok"), (3, None), (4, "ok"), (5, "ok")]
    assert run() == want
    for _ in range(2):
        os.unlink(tmp_path / "cp" / "commits" / "0")
        for crc in (tmp_path / "cp" / "commits").glob(".0.crc"):
            crc.unlink()
        assert run(lambda df: df.withColumn("answer", F.lit("again"))) == want
    assert [e["number"] for e in V.commits(spark, f"{tmp_path}/out")] == [0]
    add([3, 5, 6])
    assert run(lambda df: df.withColumn("answer", F.lit("late"))) == [(1, "ok"), (2, "ok"), (3, "late"), (4, "ok"), (5, "ok"), (6, "late")]


def test_answers_without_a_commit_do_not_count(spark, tmp_path, stream):
    """A batch dies while it writes, or before its manifest: it is processed anew and what it left isn't read."""
    run, add = stream
    add([1, 2, 3])

    def dies(df):
        return df.withColumn("answer", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.lit("bad")))

    with pytest.raises(Exception, match="lost"):
        run(dies)
    spark.createDataFrame([(1, "orphan")], "id int, answer string").write.parquet(f"{tmp_path}/out/data-orphan")
    assert run() == [(1, "ok"), (2, "ok"), (3, None)]
    assert "data-orphan" in V.vacuum(spark, f"{tmp_path}/out")
    assert sorted(r.id for r in W.answers(spark, f"{tmp_path}/out", ["id"]).collect()) == [1, 2, 3]


def test_a_new_stream_on_old_answers(spark, tmp_path, stream):
    """Another checkpoint starts with batch 0 again, which isn't the old stream's batch 0; compaction keeps the writers' batches."""
    run, add = stream
    add([1, 2, 3])
    run(deltas=1)
    assert [e["kind"] for e in V.commits(spark, f"{tmp_path}/out")] == ["base"]
    os.rename(tmp_path / "cp", tmp_path / "old")
    add([4])
    assert run(lambda df: df.withColumn("answer", F.lit("new")), deltas=1) == [(1, "ok"), (2, "ok"), (3, "new"), (4, "new")]
    os.rename(tmp_path / "cp", tmp_path / "newer")
    os.rename(tmp_path / "old", tmp_path / "cp")
    add([5])  # for the old stream files 4 and 5 are new
    assert run(deltas=1) == [(1, "ok"), (2, "ok"), (3, "new"), (4, "new"), (5, "ok")]


def test_merge_and_bytes(spark, tmp_path):
    table = f"{tmp_path}/t"
    assert V.current(spark, table, ["k"]) is None and V.vacuum(spark, table) == []
    big = spark.range(20_000).select((F.col("id") % 500).cast("int").alias("k"), F.xxhash64("id").alias("v"))
    base = V.append(big, table, "w", 0)
    small = V.append(spark.createDataFrame([(7, 1), (7, 2), (None, 3), (900, 4)], "k int, v long"), table, "w", 1)
    assert V.append(big, table, "w", 1) is None and V.append(big, table, "w", 0) is None
    none = V.append(big.limit(0), table, "w", 2)
    assert small["bytes"] * 10 < base["bytes"] and none["bytes"] < base["bytes"]
    V.append(spark.createDataFrame([(None, 5, "x")], "k int, v long, more string"), table, "v", 0)

    def rows():
        return sorted(((r.k, r.v, r.more) for r in V.current(spark, table, ["k"]).collect()), key=repr)

    want = sorted([(r.k, r.v, None) for r in big.filter("k <> 7").collect()] + [(7, 1, None), (7, 2, None), (None, 5, "x"), (900, 4, None)], key=repr)
    assert rows() == want
    assert not V.compact(spark, table, ["k"], deltas=9) and V.compact(spark, table, ["k"]) and not V.compact(spark, table, ["k"])
    log = V.commits(spark, table)
    assert [e["kind"] for e in log] == ["base"] and log[0]["done"] == {"w": 2, "v": 0} and rows() == want
    assert V.append(big, table, "w", 2) is None
    assert len(V.vacuum(spark, table)) == 4 and rows() == want
    assert not V._commit(spark, table, log[0])  # its number is taken


# ---- passage index -------------------------------------------------------------------------------


def plain_bm25(queries, items, k, allowed=None):
    """(query, pool, item, score, rank) by plain loops; a query without a pool asks all items."""
    held = [(p, i, Counter(words(t))) for p, i, t in items]
    out = []
    for q, pool, text in queries:
        mine = [(p, i, c) for p, i, c in held if not pool or p == pool]
        mean = sum(c.total() for *_, c in mine) / max(1, len(mine)) or 1.0
        df = Counter(t for *_, c in mine for t in c)
        scores = []
        for p, i, c in mine:
            s = sum(n * math.log(1 + (len(mine) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for t, n in Counter(words(text)).items() if t in c)
            if any(t in c for t in words(text)) and (allowed is None or q not in allowed or i in allowed[q]):
                scores.append((-round(s, 6), p or "", i))
        out += [(q, p or None, i, -s, n + 1) for n, (s, p, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def words(text):
    return [w for w in re.findall("[a-z0-9%]+", (text or "").lower()) if w not in STOPWORDS]


def passage(rng):
    return " ".join(f"w{min(int(rng.expovariate(0.05)), 200)}" for _ in range(rng.randint(0, 30)))


def test_passage_index(spark, tmp_path):
    rng = random.Random(4)
    items = [(rng.choice(["a", "a", "b", "c"]), i, passage(rng)) for i in range(400)] + [("a", 500, None), ("b", 501, ""), (None, 502, "w1 w2"), ("a", 503, "w199 " * 40), ("c", 504, "the of")]
    queries = [(i, p, passage(rng)) for i, p in enumerate(["a", "b", "", None, "c", "none", "a"])] + [(20, "a", None), (21, "", "the"), (22, None, "w1 w1 w199 w2")]
    X.build(spark.createDataFrame(items, "pool string, item long, text string").repartition(3), f"{tmp_path}/x")
    asked = spark.createDataFrame(queries, "query int, pool string, text string")
    show = lambda df: sorted(((r["query"], r.pool, r["item"], r.score, r["rank"]) for r in df.collect()), key=repr)
    near = lambda rows: [(q, p, i, pytest.approx(s, abs=2e-6), n) for q, p, i, s, n in rows]
    assert show(X.top_k(spark, f"{tmp_path}/x", asked, 5)) == near(plain_bm25(queries, items, 5))
    allowed = {0: {1, 2, 3, 503}, 2: set(range(0, 400, 9)), 22: {502, 503}, 6: {10_000}}
    pairs = spark.createDataFrame([(q, i) for q, s in allowed.items() for i in s] + [(0, 1)], "query int, item long")
    assert show(X.top_k(spark, f"{tmp_path}/x", asked, 4, pairs)) == near(plain_bm25(queries, items, 4, allowed))
    X.build(spark.createDataFrame([], "pool string, item long, text string"), f"{tmp_path}/none")
    assert X.top_k(spark, f"{tmp_path}/none", asked, 5).collect() == []


def test_blocks_are_skipped(spark, tmp_path):
    """Short queries read part of their postings, and the bounds that skip the rest hold."""
    rng = random.Random(5)
    items = [("a", i, passage(rng)) for i in range(6000)]
    queries = [(i, "a", f"w{rng.randint(0, 40)} w{rng.randint(20, 90)}") for i in range(20)]
    X.build(spark.createDataFrame(items, "pool string, item long, text string"), f"{tmp_path}/x")
    s = X.Search(spark, f"{tmp_path}/x", spark.createDataFrame(queries, "query int, pool string, text string"), 5)
    read = s.share_read().first()
    assert 0 < read.postings_read < 0.75 * read.postings
    got = sorted(((r["query"], r["item"], r["rank"]) for r in s.top().collect()), key=repr)
    assert got == [(q, i, n) for q, _, i, _, n in plain_bm25(queries, items, 5)]
    over = s.scores(s.ranges).groupBy("query", F.floor(F.col("number") / X.RANGE).cast("long").alias("range")).agg(F.max("score").alias("most"))
    assert over.join(s.ranges, ["query", "range"]).filter("most > bound + 1e-6").isEmpty()


def test_few_rows_leave_a_segment(spark, tmp_path, monkeypatch):
    """Only a query's first k passages of a segment are shuffled; a term has a block a segment, or more where texts are long; lists hold over all of them."""
    rng = random.Random(6)
    items = [(rng.choice("ab"), i, passage(rng)) for i in range(3000)] + [("a", 9000, "w1 w2 " * 3000)]
    queries = [(i, p, "w1 w2 w3 w5 w8") for i, p in enumerate(["a", "", "b", ""])]
    allowed = {1: set(range(0, 3000, 11)), 2: {9000}, 3: {9000}}
    frame = spark.createDataFrame(items, "pool string, item long, text string")
    asked = spark.createDataFrame(queries, "query int, pool string, text string")
    pairs = spark.createDataFrame([(q, i) for q, s in allowed.items() for i in s], "query int, item long")
    for words, name in ((X.WORDS, "x"), (700, "y")):
        monkeypatch.setattr(X, "WORDS", words)
        X.build(frame, f"{tmp_path}/{name}")
        blocks = spark.read.parquet(f"{tmp_path}/{name}/blocks")
        assert (blocks.count() > blocks.select("pool", "term", "segment").distinct().count()) == (name == "y")
        s = X.Search(spark, f"{tmp_path}/{name}", asked, 3, pairs)
        segments = s.docs.select(F.floor(F.col("number") / X.SEGMENT)).distinct().count()
        assert s.scores(s.ranges, 3).count() <= 3 * segments * len(queries) < s.scores(s.ranges).count()
        assert s.ranges.count() == s.ranges.select("query", "range").distinct().count()
        got = sorted(((r["query"], r["item"], r["rank"]) for r in s.top().collect()), key=repr)
        assert got == [(q, i, n) for q, _, i, _, n in plain_bm25(queries, items, 3, allowed)]


# ---- vector index --------------------------------------------------------------------------------


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for width in (1, 5, 64):
        code = rng.integers(0, 1 << V2.BITS, (20, width))
        assert (V2.unpack(V2.pack(code), width) == code).all()
    sample = rng.normal(size=(300, 8))
    c, cuts, values = V2.trained(sample, 10)
    at = V2.nearest(c, sample, 1)[:, 0]
    assert (at == ((sample[:, None] - c[None]) ** 2).sum(2).argmin(1)).all()
    decoded = c[at] + np.take_along_axis(values, (sample - c[at] > cuts[:, None]).sum(axis=0), axis=0)
    assert ((sample - decoded) ** 2).sum() < 0.3 * ((sample - c[at]) ** 2).sum()  # residual codes bring vectors nearer


def test_vector_index_against_loops(spark, tmp_path):
    """With all centroids visited and all pages rescored the index is exact: pools, masks, ties, repeated vectors."""
    rng = np.random.default_rng(2)
    pages = [(rng.choice(["a", "b"]), int(p), rng.normal(size=6).round(2)) for p in range(60) for _ in range(rng.integers(1, 5))]
    pool = {}
    pages = [(pool.setdefault(p, x), p, v) for x, p, v in pages] + [(pool[7], 70, v) for _, p, v in pages if p == 7] + [(None, 80, rng.normal(size=6))]
    queries = [(q, x, rng.normal(size=6).round(2)) for q, x in enumerate(["a", "b", None, "none", "a"]) for _ in range(3)]
    queries += [(5, None, v) for _, p, v in pages if p == 7] * 2
    allowed = {2: {1, 2, 3, 80}, 4: {999}}

    def want(masks):
        out = []
        for q in sorted({q for q, *_ in queries}):
            mine, x = [v for i, _, v in queries if i == q], next(x for i, x, _ in queries if i == q)
            scores = {}
            for p in {p for _, p, _ in pages}:
                theirs = [v for z, i, v in pages if i == p and (x is None or z == x)]
                if theirs and (q not in masks or p in masks[q]):
                    scores[p] = round(float((np.stack(mine).astype("f4").astype(float) @ np.stack(theirs).astype("f4").astype(float).T).max(1).sum()), 5)
            out += [(q, p, pytest.approx(s, abs=2e-5), n + 1) for n, (p, s) in enumerate(sorted(scores.items(), key=lambda z: (-z[1], z[0]))[:4])]
        return out

    frame = lambda rows, names: spark.createDataFrame([(a, b, v.tolist()) for a, b, v in rows], names)
    V2.build(frame(pages, "pool string, page long, vector array<double>"), f"{tmp_path}/v")
    asked = frame(queries, "query int, pool string, vector array<double>")
    mask = spark.createDataFrame([(q, p) for q, s in allowed.items() for p in s], "query int, page long")
    for masks, given in (({}, None), (allowed, mask)):
        got = V2.top_k(spark, f"{tmp_path}/v", asked, 4, probes=10_000, rescored=10_000, allowed=given)
        assert [(r["query"], r.page, r.score, r["rank"]) for r in sorted(got.collect(), key=lambda r: (r["query"], r["rank"]))] == want(masks)
    V2.build(frame([], "pool string, page long, vector array<double>"), f"{tmp_path}/none")
    assert V2.top_k(spark, f"{tmp_path}/none", asked, 4).collect() == []


def test_candidates_are_dealt_out_once(spark, tmp_path):
    """What blocks of codes find is shuffled once, by query; vectors aren't shuffled a pair."""
    rng = np.random.default_rng(7)
    rows = [("ab"[p % 2], p, rng.normal(size=4).tolist()) for p in range(80) for _ in range(2)]
    V2.build(spark.createDataFrame(rows, "pool string, page long, vector array<double>"), f"{tmp_path}/v")
    asked = spark.createDataFrame([(q, None, rng.normal(size=4).tolist()) for q in range(6)], "query int, pool string, vector array<double>")
    plan = V2.candidates(spark, f"{tmp_path}/v", asked, 8, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("FlatMapCoGroupsInPandas")].count("Exchange") == 1
    plan = V2.top_k(spark, f"{tmp_path}/v", asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("FlatMapCoGroupsInPandas") and "vectors" not in plan[: plan.index("FlatMapCoGroupsInPandas")]


def test_recall_of_the_vector_index(spark):
    """Every twentieth page against all pages: at least nine tenths of the exact five best."""
    from folioflow.plans import indexes as I

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    exact = {(r["query"], r.page): r.score for r in I.late_interaction_topk(spark, sf).collect()}
    found = {(r["query"], r.page): r.score for r in I.vector_index_topk(spark, sf).collect()}
    both = exact.keys() & found.keys()
    assert len(both) >= 0.9 * len(exact) and all(exact[k] == found[k] for k in both)


# ---- digests -------------------------------------------------------------------------------------


def test_digests_name_what_differs(spark, tmp_path):
    rows = [(i, f"v{i}", i % 3 if i % 5 else None) for i in range(-3000, 30_000, 3)] + [(None, "x", 1)]
    a = spark.createDataFrame(rows, "k long, v string, n int")
    D.write(a, "k", f"{tmp_path}/a")
    first = D.read(spark, f"{tmp_path}/a")
    same = D.tree(a.select("n", "v", "k").orderBy(F.desc("v")).repartition(3), "k")
    assert D.differing(first, same).collect() == []
    changes = {0: ("v0", None), 2997: ("other", 0), -3000: ("v-3000", 7), 29_997: None}
    other = [(k, *changes[k]) if k in changes and changes[k] else (k, v, n) for k, v, n in rows if k not in changes or changes[k]]
    other = [r for r in other if r[0] != 300] + [(None, "x", 1), (301, "fresh", None)]
    got = {tuple(r) for r in D.differing(first, D.tree(spark.createDataFrame(other, "k long, v string, n int"), "k")).collect()}
    changed = {k for k, *_ in set(rows) ^ set(other)} | {None}
    assert got == {(None, None) if k is None else (k // 64 * 64, k // 64 * 64 + 63) for k in changed}
    none = D.tree(a.limit(0), "k")
    assert D.differing(none, none).collect() == [] and D.differing(none, first).count() == len({None if k is None else k // 64 for k, *_ in rows})


def test_runs_are_digested_where_they_lie(spark, monkeypatch):
    """Neither run is dealt out anew before its digests, which are all that is shuffled: no task's share depends on a number of parts."""
    from folioflow.plans import indexes as I

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    plans, write = [], D.write
    monkeypatch.setattr(D, "write", lambda run, *rest: (plans.append(run._jdf.queryExecution().executedPlan().toString()), write(run, *rest)))
    assert I.runs_that_differ(spark, sf).count() > 0
    assert len(plans) == 2 and not any("Exchange" in p for p in plans)


# ---- stores of documents -------------------------------------------------------------------------


def test_a_store_has_few_files(spark, tmp_path):
    """Files don't grow in number with the documents; a folder with a file a document is read too."""
    pages = spark.range(2000).selectExpr("concat('d', id div 4) AS doc_id", "cast(id % 4 AS int) AS page_index", "concat('a', id) AS artifact_id")
    S.write_store(pages, f"{tmp_path}/s.jsonl")
    names = [n for n in os.listdir(tmp_path / "s.jsonl") if n.endswith(".json")]
    assert 0 < len(names) <= 20
    want = sorted(map(tuple, pages.collect()))
    for found in (R.read_store(spark, f"{tmp_path}/s.jsonl"), R.read_store(spark, f"{tmp_path}/s.jsonl", S.store(pages).schema)):
        assert {r.file_name for r in found.select("file_name").distinct().collect()} == set(names)
        rows = found.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.page_index").cast("int"), F.explode("p.artifacts.artifact_id"))
        assert sorted(map(tuple, rows.collect())) == want
    (tmp_path / "f").mkdir()
    for i in range(50):
        (tmp_path / "f" / f"{i}.json").write_text('{"doc_id":\n"d%d"}' % i)
    (tmp_path / "f" / "notes.txt").write_text("no document")
    assert sorted((r.file_name, r.doc_id) for r in R.read_store(spark, f"{tmp_path}/f").collect()) == sorted((f"{i}.json", f"d{i}") for i in range(50))


# ---- exact late interaction ----------------------------------------------------------------------


def test_products_are_bounded(spark, monkeypatch):
    """A block of queries meets a block of pages a few at a time, with the same result; ties go to the lesser page."""
    rng = np.random.default_rng(3)
    held, asked = rng.normal(size=(20_000, 8)), rng.normal(size=(2_000, 8))
    tracemalloc.start()
    most = T._most(asked[:1000], held.T, np.arange(0, 20_000, 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most.shape == (1000, 5000) and peak < 200e6  # one product of all would take 160 MB besides the 40 of each result
    monkeypatch.setattr(T, "PRODUCT", 500)  # for the tasks: the closure takes the module's value with it
    vectors = [(int(p), rng.integers(-2, 3, 3).astype(float).tolist()) for p in range(120) for _ in range(rng.integers(1, 4))]
    queries = [(int(q), rng.integers(-2, 3, 3).astype(float).tolist()) for q in range(40) for _ in range(rng.integers(1, 4))]
    frame = lambda rows, name: spark.createDataFrame([("x", *r) for r in rows], f"pool string, {name} long, vector array<double>")
    got = [(r["query"], r.page, r.score, r["rank"]) for r in T.max_sim(frame(queries, "query"), frame(vectors, "page"), 7).orderBy("query", "rank").collect()]
    want = []
    for q in range(40):
        mine = np.array([v for i, v in queries if i == q])
        scores = sorted((-(mine @ np.array([v for i, v in vectors if i == p]).T).max(1).sum(), p) for p in range(120))
        want += [(q, p, -s, n + 1) for n, (s, p) in enumerate(scores[:7])]
    assert got == want
