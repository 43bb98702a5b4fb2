"""Page files, responses, audits over files."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from folioflow.operators import file_audit as FA
from folioflow.operators import grids as GR
from folioflow.operators import responses as A
from folioflow.sources import page_store as PS

# ---- page files ----------------------------------------------------------------------------------


@pytest.fixture
def pages(tmp_path):
    def put(path, content=b"x"):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(content)

    for n in (0, 1, 2, 4):
        put(f"a_b_{n}.png")
        put(f"texts/a_b_{n:03d}.txt", f"later {n}".encode())
    put("a_b_1.txt", b"one\r\ntwo\rthree\n\xff")
    put("texts/page_2.txt", b"shared 2")
    put("images/page_002.png")
    put("images/page_5.png")
    put("c_0.txt", b"text only")
    put("images/c_007.png")
    put("notes.md")
    return str(tmp_path), put


def test_places_in_order(spark, pages):
    root, put = pages
    assert PS.places("d.pdf", 7, "png") == ["d_7.png", "d_007.png", "images/d_7.png", "images/d_007.png", "images/page_7.png", "images/page_007.png"]
    got = {(r.doc_id, r.page_index): (r.text_path, r.image_path, r.text) for r in PS.read(spark, root).collect()}
    assert got == {
        ("a_b", 0): ("texts/a_b_000.txt", "a_b_0.png", "later 0"), ("a_b", 1): ("a_b_1.txt", "a_b_1.png", "one\r\ntwo\rthree\n�"),
        ("a_b", 2): ("texts/a_b_002.txt", "a_b_2.png", "later 2"), ("a_b", 4): ("texts/a_b_004.txt", "a_b_4.png", "later 4"),
        ("c", 0): ("c_0.txt", None, "text only"), ("c", 7): (None, "images/c_007.png", None),
    }
    for name in ("texts/a_b_2.txt", "a_b_002.txt", "a_b_2.txt"):  # each is wanted more than the one before
        put(name, name.encode())
        assert PS.read(spark, root).filter("doc_id = 'a_b' AND page_index = 2").first().text == name


def test_contents_stop_at_a_gap(spark, pages):
    root, _ = pages
    assert sorted((r.doc_id, r.page_index, r.text) for r in PS.contents(spark, root).collect()) == [("a_b", 0, "later 0"), ("a_b", 1, "one two three �"), ("a_b", 2, "later 2")]
    assert sorted((r.page_index, r.text) for r in PS.contents(spark, root, 2, 3).collect()) == [(0, "lat"), (1, "one")]
    assert {r.doc_id: r.pages for r in PS.discovered(spark, root).collect()} == {"a_b": [0, 1, 2, 4], "c": [0, 7]}
    assert PS.read(spark, root + "/none").count() == 0 and PS.discovered(spark, root + "/none").count() == 0


def test_requests_fall_back_to_shared_pages(spark, pages):
    root, _ = pages
    asked = spark.createDataFrame([("a_b.pdf", 0), ("z", 2), ("z", 5), ("z", 6), (None, 2)], "doc_id string, page_index int")
    got = {(r.doc_id, r.page_index): tuple(r)[2:] for r in PS.requested(spark, root, asked).collect()}
    shared = ("shared 2", "texts/page_2.txt", "images/page_002.png", True, True)
    assert got == {("a_b.pdf", 0): ("later 0", "texts/a_b_000.txt", "a_b_0.png", True, True), ("z", 2): shared, ("z", 5): (None, None, "images/page_5.png", False, True), ("z", 6): (None, None, None, False, False), (None, 2): shared}


def test_filters_reach_the_listing(spark, pages):
    """A text that can't be read doesn't matter where its document or page isn't asked for."""
    root, _ = pages
    reader = PS.PageReader(root, True)
    rest = list(reader.pushFilters([PS.EqualTo(("doc_id",), "a_b"), PS.In(("doc_id",), ("a_b", "c")), PS.GreaterThan(("page_index",), 1), PS.EqualTo(("text",), "x")]))
    assert [f.attribute for f in rest] == [("text",)]
    assert [p[:2] for part in reader.partitions() for p in part.pages] == [("a_b", 2), ("a_b", 4)]
    plan = PS.read(spark, root).filter("doc_id = 'c' AND page_index < 3")
    assert [tuple(r)[:2] for r in plan.collect()] == [("c", 0)]


def test_written_files(spark, tmp_path):
    df = spark.createDataFrame([("x_0.txt", bytearray(b"a")), ("images/x_0.png", bytearray(b""))], "path string, content binary")
    assert PS.write(df, f"{tmp_path}/new") == 2 and PS.write(df.limit(0), f"{tmp_path}/new") == 0
    assert PS.listed(f"{tmp_path}/new") == {"x_0.txt", "images/x_0.png"}


# ---- responses -----------------------------------------------------------------------------------


def slow_object(text):
    """The same, brace by brace and start by start."""
    fence, pieces = "`" * 3, [text.strip()]
    bare = text.strip()
    if bare.startswith(fence):
        lines = bare.splitlines()[1:]
        pieces.append("\n".join(lines[:-1] if lines and lines[-1].strip() == fence else lines))
    for block in text.split(fence)[1::2]:
        lines = block.strip().splitlines()
        pieces.append("\n".join(lines[1:] if lines and lines[0].strip().lower() in ("json", "json_object") else lines))
    for start in [i for i, c in enumerate(text) if c == "{"]:
        depth, inside, skip = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if inside:
                skip, inside = (not skip and c == "\\"), not (c == '"' and not skip)
            elif c == '"':
                inside = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    pieces.append(text[start : i + 1])
                    break
    like = False
    for p in (p.strip() for p in pieces):
        like = like or ("{" in p and "}" in p)
        try:
            value = json.loads(p) if p else None
        except ValueError:
            continue
        if p:
            return (value, None) if isinstance(value, dict) else (None, "json_not_object")
    return None, "json_object_not_found" if like else "json_like_block_absent"


@pytest.mark.parametrize("seed", range(4))
def test_objects_against_the_slow_way(seed):
    rng = random.Random(seed)
    bits = ["{", "}", "{", "}", '"', "\\", '"a"', ":", "1", ",", '{"a": 1}', '{"b": "}{"}', " word ", "`" * 3, "`" * 3 + "json\n", "\n", "[", "]", '{"c": {"d": []}}', '"\\""']
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert A.object_in(text) == slow_object(text), text


def test_kinds_of_failure():
    chat = lambda c: json.dumps({"choices": [{"message": {"content": c}}]})
    assert A.body_of('{"doc_id": 1, "page_index": 2, "artifacts": []}')[0]["doc_id"] == 1
    assert A.body_of(chat('Yes: {"a": "}"} or {"b": 2}')) == ({"a": "}"}, None)
    assert A.body_of(chat({"a": 1})) == ({"a": 1}, None) and A.body_of(chat([{"text": '{"a"'}, ": 1}", 7, {"image": 1}])) == ({"a": 1}, None)
    assert A.body_of('{"choices": [{"text": "{\\"a\\": 1}"}]}') == ({"a": 1}, None) and A.body_of('{"content": "{\\"a\\": 1}"}') == ({"a": 1}, None)
    assert A.body_of('HTTP 200 {"a": 1} {') == ({"a": 1}, None)
    for text, failure in (("", "http_response_not_json"), ("{", "http_response_not_json"), ("[1]", "missing_message_content"), (chat(None), "missing_message_content"), ('{"choices": [3]}', "missing_message_content"), (chat("[1]"), "message_content_not_json"), (chat("x"), "message_content_not_json")):
        assert A.body_of(text) == (None, failure), text
    assert [A.object_in(t)[1] for t in ("[1]", "{a}", "x", "", "NaN", "[" * 100_000)] == ["json_not_object", "json_object_not_found", "json_like_block_absent", "json_like_block_absent", "json_like_block_absent", "json_like_block_absent"]


@pytest.mark.parametrize("text", ["{" * 100_000, '{"a":' * 50_000, '{"' * 100_000, '{"a": [1, x], ' * 20_000 + "}" * 20_000, '"{' * 100_000 + "}" * 100_000])
def test_long_responses_take_linear_time(text):
    began = time.time()
    A.object_in(text)
    assert time.time() - began < 10


def test_response_columns(spark):
    df = spark.createDataFrame([('x {"b": 1, "a": "é"} {"c": 2}',), (None,), ("[1]",)], "t string")
    got = df.select(A.first_object(F.col("t")).alias("x")).collect()
    assert [tuple(r.x) for r in got] == [('{"a": "é", "b": 1}', None), (None, "json_like_block_absent"), (None, "json_not_object")]


# ---- audit over files ----------------------------------------------------------------------------


def test_file_audit(spark, tmp_path):
    payload = "QUJD" * 30
    files = {
        "a.jsonl": '{"ok": 1}\n\n{"answer": {"text": "file:///x and /HOME/y"}}\n[{"k": [1, {"api_token": ""}]}]\n',
        "sub/broken.jsonl": '{"gold_page": 1}\nnot json, but an answer\n{"gold_pages": 2}\n',
        "b.json": json.dumps({"no_answer_generation": True, "list": ["x", "data:image/png", payload], "answers": []}, indent=1),
        "c.json": "{broken: raw_output}",
        "d.md": f"The answers are not my_answer.\nraw-response /home/x\n{payload}\n",
        "e.txt": f"sha256 {payload}\nnothing\n", "skipped.bin": "answer", "empty.jsonl": "", "odd name +%.txt": "gold_evidence",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "f.csv").write_bytes(b"a,\xff\n")
    want = {
        ("a.jsonl", None, "forbidden_content:file://"), ("a.jsonl", None, "forbidden_content:/home/"), ("a.jsonl", "line:3", "forbidden_field:answer"), ("a.jsonl", "line:3.answer.text", "forbidden_content:file://"),
        ("a.jsonl", "line:3.answer.text", "forbidden_content:/home/"), ("a.jsonl", "line:4[0].k[1]", "forbidden_field:api_token"),
        ("sub/broken.jsonl", "line:1", "forbidden_field:gold_page"), ("sub/broken.jsonl", None, "forbidden_text:gold_page"), ("sub/broken.jsonl", None, "forbidden_text:answer"), ("sub/broken.jsonl", None, "forbidden_text:gold_pages"),
        ("b.json", None, "forbidden_content:data:image"), ("b.json", "json.list[1]", "forbidden_content:data:image"), ("b.json", "json.list[2]", "forbidden_content:base64_payload"), ("b.json", "json", "forbidden_field:answers"),
        ("c.json", None, "forbidden_text:raw_output"), ("d.md", None, "forbidden_text:answers"), ("d.md", None, "forbidden_content:/home/"), ("d.md", None, "forbidden_text:base64_payload"),
        ("odd name +%.txt", None, "forbidden_text:gold_evidence"), ("f.csv", None, "non_utf8_public_text"),
    }
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "60"):  # whole files, and files in splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = [(r.file, r.location, r.reason) for r in FA.audit(spark, str(tmp_path)).collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert set(got) == want and len(got) == len(want)
    assert FA.audit(spark, f"{tmp_path}/none").collect() == []


# ---- tables of pages -----------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_grids_against_a_matrix(seed):
    """Random spans: every place belongs to the cell that a plain matrix, filled cell by cell, gives it."""
    rng = random.Random(seed)
    for _ in range(200):
        rows = [[(f"c{i}_{j}", rng.random() < 0.3, rng.choice([1, 1, 1, 2, 3, 0]), rng.choice([1, 1, 2, 3])) for j in range(rng.randint(0, 4))] for i in range(rng.randint(1, 5))]
        html = "<table>" + "".join("<tr>" + "".join(f"<{(t := 'th' if h else 'td')} rowspan='{r}' colspan={c}>{x}</{t}>" for x, h, r, c in row) for row in rows) + "</table>"
        assert GR.tables_of(html) == [rows]
        taken = [[None] * 40 for _ in rows]
        for i, row in enumerate(rows):
            for x, _, r, c in row:
                col = 0 if x.endswith("_0") else last  # noqa: F821
                while taken[i][col]:
                    col += 1
                last = col + c
                for y in range(i, len(rows) if r == 0 else min(len(rows), i + r)):
                    for z in range(col, col + c):
                        taken[y][z] = taken[y][z] or x
        got = [[cells.get(c, (None,))[0] for c in range(40)] for cells in GR.grid(rows)]
        assert got == taken


def test_cells_of_tables(spark):
    page = "<p>no<table><caption>x<tr><th>A<th>B &amp; C<tr><td>r1<td> 5 <script>7</td></script><br>6<tr><td>r2<td><table><tr><td>in</td><td>ner</table>out<tr><td>r3<td></table>end<table><tr><td>k<td>v<tr><td>a<td>1"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page int, html string")
    got = sorted(tuple(r)[1:] for r in GR.table_cells(df, ["page"], "html").collect())
    assert got == [(0, 1, 1, "r1", "B & C", "5 6"), (0, 2, 1, "r2", "B & C", "out"), (2, 1, 1, "a", "v", "1")]
    assert len(GR.cells_of("<table><tr><th>a<th>b" + "<tr><td rowspan=99999>x<td colspan=99999>y" * 30)) > 0
