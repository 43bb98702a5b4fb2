"""Small cases with known results, and property checks against plain Python."""

import json
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.functions import scoring
from folioflow.functions import text as T
from folioflow.operators import audit, checks, extract, graph, guards, metrics, pages, ranking, retrieval, tables
from folioflow.sources import readers, sinks
from folioflow.streaming.resume import resume, run_with_snapshots


def values(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first().x


def test_text(spark):
    assert values(spark, T.tokens(F.col("t")), t="What is the 12% Rate of growth") == ["12%", "rate", "growth"]
    assert values(spark, T.compact(F.col("t")), t=" a  b\n c ") == "a b c"
    assert values(spark, T.percent_encoded(F.col("t")), t="a b*~/é") == "a%20b%2A~%2F%C3%A9"
    assert values(spark, T.number_in(F.col("t")), t="(1,234.5)") == -1234.5
    assert values(spark, T.number_in(F.col("t")), t="abc") is None
    assert values(spark, T.exact_codes(F.col("t")), t="AR01 FY20 Q3 GPT4 B7 AR01") == ["AR01", "B7"]
    assert values(spark, T.page_references(F.col("t")), t="Page 3, pages 12") == [3, 12]
    assert [values(spark, T.coerced_page(F.col("t")), t=x) for x in ("7", "3.0", "doc:4", "x", "")] == [7, 3, 4, None, None]
    assert values(spark, T.token_estimate(F.col("t")), t="Ab, é-c 1") == 6
    assert values(spark, T.shortened(F.col("t"), 8), t="abcdefghij") == "abcde..."
    assert values(spark, T.unit_of(F.col("t")), t="3 hours") == "hours"


def plain_bm25(queries, items, k):
    tok = lambda t: [x for x in __import__("re").findall("[a-z0-9%]+", t.lower()) if x not in T.STOPWORDS]
    out = {}
    for q, pool, text in queries:
        docs = [(i, tok(t)) for p, i, t in items if p == pool]
        mean = sum(len(t) for _, t in docs) / len(docs)
        df = Counter(w for _, t in docs for w in set(t))
        scores = []
        for i, t in docs:
            tf = Counter(t)
            s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in tok(text) if tf[w])
            scores.append((-round(s, 6), i))
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


def test_bm25(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta the of 12% x".split()) for _ in range(n))
    items = [(f"p{i % 3}", i, text(rng.randint(1, 12))) for i in range(30)]
    queries = [(i, f"p{i % 3}", text(4)) for i in range(9)] + [(90, "p0", "nothing known"), (91, "p1", "the of")]
    got = {}
    top = retrieval.bm25_topk(spark.createDataFrame(queries, "query int, pool string, text string"), spark.createDataFrame(items, "pool string, item int, text string"), 5)
    for r in top.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.item)
    assert got == plain_bm25(queries, items, 5)


def test_hybrid_and_overlap(spark):
    df = spark.createDataFrame([(1.0, 0.5, 1.0, 1.0, 0.2)], scoring.COMPONENTS)
    assert df.select(scoring.hybrid().alias("x")).first().x == pytest.approx(1 + 0.25 + 0.25 + 0.25 + 0.05)
    df = spark.createDataFrame([(["a", "b", "a"], ["b", "c"]), ([], ["b"])], "q array<string>, c array<string>")
    assert [r.x for r in df.select(scoring.overlap(F.col("q"), F.col("c")).alias("x")).collect()] == [0.5, 0.0]


def test_chunks_and_lines(spark):
    df = spark.createDataFrame([(1, "a" * 1000 + " " * 1000 + "  b "), (2, ""), (3, None)], "doc_id int, text string")
    got = [(r.block_no, r.char_start, r.char_end, r.block_text) for r in pages.chunks(df).collect()]
    assert got == [(0, 0, 1000, "a" * 1000), (2, 2000, 2004, "b")]
    df = spark.createDataFrame([(1, " one  two\n\n three ")], "doc_id int, text string")
    assert [tuple(r)[1:] for r in pages.lines(df, ["doc_id"]).collect()] == [(0, 1, 9, "one two"), (1, 12, 17, "three")]


def test_ranked_columns_and_records(spark, tmp_path):
    cols = ["image-top-4-q", "text-top-4-q", "text-top-10-q", "text-top-10-q_score", "mix-top-1-q", "other"]
    assert readers.ranked_columns(cols) == ["text-top-10-q", "text-top-4-q", "image-top-4-q", "mix-top-1-q"]
    (tmp_path / "a.json").write_text(json.dumps({"records": [{"query": "q1"}, {"query": "q2", "doc_id": 5}]}))
    (tmp_path / "b.jsonl").write_text('{"a": 1}\nnot json\n\n{"a": 2}\n')
    got = readers.public_queries(readers.read_records(spark, f"{tmp_path}/a.json")).collect()
    assert [(r.record_index, r.doc_id, r.question) for r in got] == [(0, "", "q1"), (1, "5", "q2")]
    assert sorted(r.a for r in readers.read_jsonl(spark, f"{tmp_path}/b.jsonl", "a int").collect() if r.a) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, f"{tmp_path}/b.jsonl", "a int", strict=True).collect()
    assert readers.read_optional(spark, f"{tmp_path}/none.jsonl", "a int").count() == 0
    assert values(spark, readers.parsed_list(F.col("t")), t="[2, 1]") == [2, 1] and values(spark, readers.parsed_list(F.col("t"), "string"), t="['a']") == ["a"]


def test_page_files_stop_at_a_gap(spark, tmp_path):
    for n, t in (("d_0.txt", "a\nb"), ("d_1.txt", "c"), ("d_3.txt", "lost"), ("e_1.txt", "lost")):
        (tmp_path / n).write_text(t)
    assert sorted(tuple(r) for r in readers.read_page_files(spark, str(tmp_path)).collect()) == [("d", 0, "a b"), ("d", 1, "c")]


def test_selection_caps(spark, tmp_path):
    (tmp_path / "s.csv").write_text("doc_id,page_index\na,0\na,1\nb,0\n")
    assert readers.read_selected_pages(spark, f"{tmp_path}/s.csv", 3, 2, 2).count() == 3
    with pytest.raises(Exception, match="caps"):
        readers.read_selected_pages(spark, f"{tmp_path}/s.csv", 3, 2, 1).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "n int, a string")
    sinks.write_jsonl(df.coalesce(1), f"{tmp_path}/j", ["n"])
    lines = [x for p in sorted((tmp_path / "j").glob("part*")) for x in p.read_text().splitlines()]
    assert lines == ['{"a":null,"n":1}', '{"a":"b","n":2}']
    assert json.loads(sinks.report(df.agg(F.max("n").alias("m")))) == {"m": 2}
    assert sinks.markdown(df.orderBy("n")).splitlines()[2:] == ["| 1 |  |", "| 2 | b |"]


def greedy(rows, caps, total):
    kept = rows
    for by, cap in caps:
        seen, out = Counter(), []
        for r in kept:
            if seen[tuple(r[i] for i in by)] < cap:
                out.append(r)
                seen[tuple(r[i] for i in by)] += 1
        kept = out
    return kept[:total]


def test_capped_equals_greedy(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 4), rng.randint(0, 2), i) for i in range(60)]
    df = spark.createDataFrame(rows, "d int, p int, i int")
    got = ranking.capped(df, [F.col("i")], [(["d", "p"], 2), (["d"], 3)], 10)
    assert [(r.d, r.p, r.i) for r in got.orderBy("position").collect()] == greedy(rows, [((0, 1), 2), ((0,), 3)], 10)


def test_rerank_modes(spark):
    b = spark.createDataFrame([("q", 0, 0, 1.0), ("q", 1, 1, 0.9), ("q", 2, 2, 0.1), ("q", 9, 4, 0.05)], "query string, page_index int, first_rank int, score double")
    a = spark.createDataFrame([("q", 1, 0.5), ("q", 9, 1.0)], "query string, page_index int, artifact_score double")
    order = lambda mode, art=a: [r.page_index for r in ranking.rerank(b, art, ["query"], mode, 3, 0.5).orderBy("position").collect()]
    assert order("original_only") == [0, 1, 2]
    assert order("artifact_only") == [9, 1, 0]
    assert order("original_plus_artifact") == [0, 1, 2]  # the first page is protected, the fourth out of reach
    assert order("artifact_only", a.limit(0)) == [0, 1, 2]


def test_propagation_in_order(spark):
    df = spark.createDataFrame([([(1, 1.0), (2, 0.1)], {1: [2], 2: [3]}, {3: 1.0})], "s array<struct<page int, score double>>, n map<int, array<int>>, a map<int, double>")
    got = df.select(ranking.propagated_in_order(df, F.col("s"), F.col("n"), F.col("a")).alias("x")).first().x
    assert got == {1: 1.0, 2: 0.85, 3: pytest.approx(0.85 * 0.85 + 0.15)}


def test_metrics(spark):
    found = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1), (3, 7, 1)], "query int, item int, rank int")
    gold = spark.createDataFrame([(1, 6), (1, 8), (2, 5)], "query int, item int")
    r = metrics.macro(metrics.with_gold(found, gold)).first()
    assert (r.n_queries, r.n_with_gold, r.recall_at_1, r.recall_at_3, r.coverage_at_3, r.gold_recall_at_1) == (3, 2, 0.333333, 0.666667, 0.5, 0.5)
    c = metrics.concentration(spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 3)], "g string, k int"), ["g"], "k").first()
    assert (c.total, c.effective_number, c.top_share) == (4, 2.666667, 0.5)


def test_expansion(spark):
    e = [("artifact:a", "page:0", "located_on_page"), ("artifact:b", "page:0", "located_on_page"), ("artifact:c", "page:1", "located_on_page"), ("page:0", "page:1", "adjacent_page"), ("artifact:a", "artifact:z", "same_page")]
    edges = spark.createDataFrame(e, "source string, target string, edge_type string")
    seeds = spark.createDataFrame([(1, "artifact:a", 1)], "query int, node string, rank int")
    got = graph.expand(seeds, graph.page_neighbours(edges)).orderBy("position").collect()
    assert [r.node for r in got] == ["artifact:a", "artifact:b", "artifact:c"]
    assert graph.direct_neighbours(edges).count() == 0
    hand = spark.createDataFrame([("artifact:a", "artifact:b", "adjacent_page")], "source string, target string, edge_type string")
    assert graph.direct_neighbours(hand).count() == 2


def test_atomic_cells(spark):
    text = ["2023", "2022", "Total units", "3,504", "3,931", "Tail", "note 5"]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(text)], "page string, line_index int, line string")
    got = {(r.row_label, r.column_label, r.value_text) for r in extract.atomic_cells(df, ["page"]).collect()}
    assert got == {("Total units", "2023", "3,504"), ("Total units", "2022", "3,931")}
    many = ["One", "Two", *[x for i in range(12) for x in (f"Row {chr(97 + i)} of the table with a label", f"{i + 10}%", f"{i + 30}%")]]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(many)], "page string, line_index int, line string")
    assert extract.atomic_cells(df, ["page"]).count() == 8


def test_code_names():
    text = "Arkansas (AR)\n1. Little\nRock\nAR01\n2. Northern Arkansas\nAR02\nAR03\nTexas (TX)\n1. Waco\nTX11\n1. Waco\nTX11"
    assert [x[:3] for x in extract.pairs_in(text)] == [("AR01", "Little Rock", "Arkansas"), ("AR02", "Northern Arkansas", "Arkansas"), ("TX11", "Waco", "Texas")]


def test_html(spark):
    assert values(spark, extract.html_text(F.col("h")), h="<p>a<script>x<p></script> &amp;lt;<!-- c --> b</p>") == "a &lt; b"


def test_guards(spark):
    p = guards.profile(spark.createDataFrame([(1, "What is the total for AR01?"), (2, "Who revised this document?"), (3, "Unrelated words entirely"), (4, "code ZZ99 please")], "query int, question string").withColumn("doc_id", F.lit("d")))
    a = spark.createDataFrame([("d", 0, "a1", "table_cell", "AR01 total 5", None, None, None), ("d", 0, "a2", "text_span", "something revised", None, None, None)], "doc_id string, page_index int, artifact_id string, artifact_type string, content string, value_text string, row_label string, column_label string")
    d, s = guards.decide(guards.score_candidates(p, a, ["doc_id"]), p, "query")
    assert {r.query: r.decision for r in d.collect()} == {1: "exact_code_key_value_selection", 2: "document_metadata_refusal_guard", 3: "no_relevant_artifact_guard", 4: "exact_code_absence_guard"}
    assert [(r.query, r.artifact_id) for r in s.collect()] == [(1, "a1")]
    assert values(spark, guards.phrase_present(F.col("t"), F.lit("net-income total")), t="Total of the Net income")
    assert values(spark, guards.operand_covered(F.col("t"), "total_assets"), t="Assets")


def test_tables(spark):
    left = spark.createDataFrame([(1, i) for i in range(4)] + [(2, 0)], "k int, i int")
    right = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "k int, v string, j int")
    assert [r.v for r in tables.kth_match(left, right, ["k"], ["i"], ["j"]).orderBy("k", "i").collect()] == ["x", "y", "y", "y", None]
    first = tables.union_first([right, right.withColumn("v", F.lit("z"))], ["k"], [F.col("j")]).collect()
    assert [r.v for r in first] == ["x"]
    assert {(r.k, r.v) for r in tables.upsert_last(right.select("k", "v", "j"), ["k"], "j").collect()} == {(1, "y")}


def test_audit(spark):
    df = spark.createDataFrame([(1, 'token = "' + "a" * 40 + '"'), (2, "see file:///x")], "id int, text string")
    assert {r.rule: r.n_rows for r in audit.scan(df, "text").collect() if r.n_rows} == {"hex_token": 1, "file_uri": 1}
    nested = df.select(F.array(F.struct(F.lit(1).alias("answer"))).alias("a"))
    assert audit.forbidden_fields(nested.schema) == ["a[].answer"]
    with pytest.raises(ValueError, match="answer"):
        audit.assert_public(nested)
    one, two = audit.content_hash(df).first(), audit.content_hash(df.orderBy(F.desc("id")).repartition(3)).first()
    assert one == two != audit.content_hash(df.limit(1)).first()


def test_resume(spark, tmp_path):
    folder, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    make = lambda ids: spark.createDataFrame([(i,) for i in ids], "id int").write.mode("append").parquet(folder)
    process = lambda df: df.withColumn("answer", F.when(F.col("id") != 3, F.lit("ok")))

    def run():
        resume(spark.readStream.schema("id int").parquet(folder), sink, f"{tmp_path}/cp", ["id"], "answer", process).awaitTermination()
        return sorted((r.id, r.answer) for r in spark.read.option("recursiveFileLookup", "true").parquet(sink).collect())

    make([1, 2, 3])
    assert run() == [(1, "ok"), (2, "ok"), (3, None)]
    make([2, 3, 4])
    assert run() == [(1, "ok"), (2, "ok"), (3, None), (3, None), (4, "ok")]


def test_snapshots(spark, tmp_path):
    folder = f"{tmp_path}/snap"
    records = spark.createDataFrame([(i,) for i in range(1, 8)], "id int")
    answered = lambda df: df.withColumn("answer", F.when(F.col("id") != 5, F.lit("ok")))
    out = run_with_snapshots(records, folder, ["id"], "answer", answered, 3)
    assert sorted((r.id, r.answer) for r in out.collect()) == [(i, None if i == 5 else "ok") for i in range(1, 8)]
    names = sorted(p.name for p in (tmp_path / "snap").iterdir() if p.name.startswith("snapshot-"))
    assert names[0] == "snapshot-000001" and len(names) >= 3 and spark.read.parquet(f"{folder}/snapshot-000001").count() == 3
    whole = run_with_snapshots(records, folder, ["id"], "answer", lambda df: df.withColumn("answer", F.lit("late")), 3)
    assert {r.id: r.answer for r in whole.collect()}[5] == "late" and whole.count() == 7
    assert run_with_snapshots(records.limit(0), f"{tmp_path}/none", ["id"], "answer", answered, 3).count() == 0


def test_more_readers_and_sinks(spark, tmp_path):
    for name, text in (("list.json", '[{"a": 1}, {"a": 2}]'), ("lines.json", '{"a": 1}\n{"a": 2}\n'), ("wrapped.json", '{"records": [{"a": 1}, {"a": 2}]}')):
        (tmp_path / name).write_text(text)
        assert sorted(r.a for r in readers.read_sniffed(spark, str(tmp_path / name)).collect()) == [1, 2], name
    (tmp_path / "bad.json").write_text("plain")
    with pytest.raises(ValueError):
        readers.read_sniffed(spark, str(tmp_path / "bad.json"))
    assert readers.read_config("top_k: 4 # few\nweights:\n  lexical: 1.5\n  graph: 0\nname: 'x'\non: true\n") == {"top_k": 4, "weights": {"lexical": 1.5, "graph": 0}, "name": "x", "on": True}
    with pytest.raises(ValueError):
        readers.read_config("no colon")
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "nodes.jsonl").write_text('{"node_id": "n", "node_type": "page", "doc_id": "d", "page_index": 0}\n')
    (tmp_path / "g" / "edges.jsonl").write_text('{"source": "a", "target": "b", "edge_type": "adjacent_page"}\n')
    g = readers.read_graph(spark, str(tmp_path / "g"), debug=True)
    assert (g["nodes"].count(), g["edges"].count(), g["debug_edges"].count()) == (1, 1, 0)
    p = spark.createDataFrame([("i", 3, "b"), ("i", 1, "a"), ("i", 2, "a"), ("j", 1, "z")], "index string, passage_id int, document string")
    assert {(r["index"], r.passage_id): r.page_index for r in readers.passage_pages(p).collect()} == {("i", 1): 0, ("i", 2): 0, ("i", 3): 1, ("j", 1): 0}
    out = tmp_path / "out"
    (out / "stores").mkdir(parents=True)
    (out / "stores" / "old").write_text("x")
    (out / "own.txt").write_text("kept")
    sinks.prepare_output(spark, str(out), ["stores"], ["artifacts.jsonl"])
    assert not (out / "stores").exists() and (out / "artifacts.jsonl").read_text() == "" and (out / "own.txt").read_text() == "kept"


def test_privacy_at_any_depth(spark):
    rows = [(1, "k", ("x", "t", ["see file:///a", "fine"]), [("a", "b")], {"api_key": "k", "ok": "v"})]
    schema = "id int, secret string, inner struct<api_token:string, text:string, list:array<string>>, many array<struct<gold_answer:string, keep:string>>, m map<string,string>"
    df = spark.createDataFrame(rows, schema)
    assert audit.forbidden_fields(df.schema) == ["secret", "inner.api_token", "many[].gold_answer"]
    with pytest.raises(ValueError):
        audit.assert_public(df)
    clean = audit.sanitised(df).first()
    assert clean.asDict(recursive=True) == {"id": 1, "inner": {"text": "t", "list": [None, "fine"]}, "many": [{"keep": "b"}], "m": {"ok": "v"}}
    assert audit.assert_public(audit.without_private(df)).first().inner.list == ["see file:///a", "fine"]
    assert values(spark, audit.named_fields(F.col("t")), t='An answer: "gold_answer" and my_answer') == ["answer", "gold_answer"]


def test_graph_checks(spark):
    nodes = spark.createDataFrame([("n", "page"), ("m", "blob")], "node_id string, node_type string")
    edges = spark.createDataFrame([("a", "b", "adjacent_page"), ("a", "c", "entails")], "source string, target string, edge_type string")
    found = {r.violation: r.n for r in graph.violations(nodes, edges, graph.EXPANSION, ["source", "rule"]).collect()}
    assert found == {"unexpected_node_type:blob": 1, "unexpected_edge_type:entails": 1, "missing_field:rule": 2}
    with pytest.raises(Exception, match="unexpected"):
        graph.checked(nodes, edges, graph.EXPANSION, ["source"]).collect()
    with pytest.raises(Exception, match="forbidden edge type"):
        graph.adjacency(edges).collect()
    assert graph.checked(nodes.filter("node_type = 'page'"), edges.limit(1), graph.EXPANSION, ["source"]).count() == 1


def test_error_budget_and_order(spark):
    rows = spark.range(200).withColumn("bad", F.col("id") == 7)
    assert checks.within_error_budget(rows, F.col("bad")).count() == 199
    with pytest.raises(Exception, match="too many errors"):
        checks.within_error_budget(rows.withColumn("bad", F.col("id") < 3), F.col("bad")).collect()
    e = spark.createDataFrame([("b", "x", "next_block"), ("a", "y", "next_block"), ("z", "z", "adjacent_page")], "source string, target string, edge_type string")
    assert [r.source for r in graph.in_order(e).collect()] == ["z", "a", "b"]


def test_every_edge_and_locator_kind_occurs(spark):
    """The fixture that the graph's queries run on meets every rule."""
    from folioflow.plans import bindings

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    a = bindings.artifacts(spark, sf)
    made = {r.edge_type: r.n for r in graph.counts_by_type(graph.edges(a)).collect()}
    assert set(made) == {*graph.EXPANSION, *graph.CONTEXT} and min(made.values()) > 0
    assert made == {r.edge_type: r.n for r in graph.counts_by_type(graph.edges(a, context=False), a).collect()}
    kinds = {r.locator_kind for r in bindings.classified(spark, sf).select("locator_kind").distinct().collect()}
    assert {"table_cell", "figure_region", "caption_block", "section_block", "text_offset", "full_page_anchor"} <= kinds


def test_capsules(spark):
    """Every question has one: with selected artifacts, with the best accepted candidates, with nothing."""
    asked = [(1, "Total for AR01?", "d"), (2, "Who revised this document?", "d"), (3, "code ZZ99 please", "d"), (4, "Anything else", "none")]
    p = guards.profile(spark.createDataFrame(asked, "query int, question string, doc_id string"))
    long = "AR01 total " + "x" * 200
    rows = [("d", 1, f"a{i}", "key_value", "AR01 " + "ab " * i, None, None, "metric") for i in range(5)]
    rows += [("d", 0, "b", "table_cell", long, "7", "row", None), ("d", 2, "c", "figure", "revised AR01 total", None, None, None)]
    a = spark.createDataFrame(rows, "doc_id string, page_index int, artifact_id string, artifact_type string, content string, value_text string, row_label string, column_label string")
    c = guards.score_candidates(p, a, ["doc_id"])
    d, s = guards.decide(c, p, "query")
    got = {r["query"]: r for r in guards.capsules(p, c, d, s, "query").collect()}
    lines = {q: r.capsule.split("\n") for q, r in got.items()}
    assert sorted(got) == [1, 2, 3, 4]
    assert lines[1][:5] == [
        "[Evidence Capsule]", "Skills: exact_code_lookup", "Guard: exact_code_key_value_selection; policy: answer_only_if_exact_code_value_pair_supports_it", "Evidence:",
        "- id=b | page=0 | type=table_cell | codes=AR01 | fields=row_label=row;value_text=7 | text=" + long[:177] + "...",
    ]
    assert [x.split(" ")[1] for x in lines[1][5:8]] == ["id=c", "id=a0", "id=a1"]
    assert lines[1][8:] == ["Trace: skill=exact_code_lookup; candidates=6; selected=6; guard=exact_code_absence_guard", ""]
    assert got[1].unit_source == "selected_artifacts" and got[2].unit_source == "top_accepted_candidates"
    assert lines[2][2] == "Guard: document_metadata_refusal_guard; policy: refuse_if_visible_metadata_mismatches_question"
    assert lines[2][3:8] == ["Evidence:", *lines[2][4:8]] and all("type=key_value" in x or "type=table_cell" in x for x in lines[2][4:8])
    assert lines[3][-4:] == [lines[3][-4], "Missing: exact_code:ZZ99", "Trace: skill=exact_code_lookup; candidates=6; selected=0; guard=exact_code_absence_guard", ""]
    assert lines[4][3:] == ["Evidence: none selected", "Missing: selected_supporting_artifact", "Trace: skill=text_span_grounding; candidates=0; selected=0; guard=no_relevant_artifact_guard", ""]


def test_markdown_is_whole_or_fails(spark):
    assert len(sinks.markdown(spark.range(3), limit=3).split("\n")) == 5
    with pytest.raises(ValueError, match="more than 3 rows"):
        sinks.markdown(spark.range(4), limit=3)


def test_artifacts_are_numbered_through_all_splits(spark, tmp_path):
    lines = [json.dumps({"artifact_id": "own" if i == 7 else None, "n": i}) for i in range(60)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:10]) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(lines[10:]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = readers.read_artifacts(spark, str(tmp_path), "artifact_id string, n int").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.n, r.input_order, r.artifact_id) for r in got) == [(i, i, "own" if i == 7 else f"artifact_{i + 1:06d}") for i in range(60)]
