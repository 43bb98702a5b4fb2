"""Queries that write tables through the sinks and read them back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import file_audit as FA
from folioflow.operators import graph as G
from folioflow.operators import grids as GR
from folioflow.operators import responses as A
from folioflow.plans import bindings as B
from folioflow.plans import documents as D
from folioflow.sources import page_store as PS
from folioflow.sources import readers as R
from folioflow.sources import sinks as S
from folioflow.sources import versions as V
from folioflow.streaming import resume as W

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, lang, source, n_chars, text FROM documents")
def jsonl_round_trip(spark, sf):
    """Documents as sorted JSON lines, scanned as records."""
    path = S.work_folder(spark, "documents") + ".jsonl"
    S.write_jsonl(B.table(spark, sf, "documents"), path, ["doc_id"])
    return R.read_records(spark, path).select("doc_id", "lang", "source", "n_chars", "text")


_LINES = """CASE conv_id % 4 WHEN 0 THEN '{"conv_id": ' || conv_id || ', "turn": ' || turn || '}' WHEN 1 THEN '{"conv_id": ' || conv_id WHEN 2 THEN 'not json' ELSE '{"conv_id": ' || conv_id || ', "turn": ' || turn || ', "more": [1]}' END"""


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 4 IN (0, 3) UNION ALL SELECT -1, 0")
def lenient_scan(spark, sf):
    """Lines of which some are broken; they are dropped. A file that isn't there is an empty table, to which one row is added."""
    path = S.work_folder(spark, "lines")
    B.table(spark, sf, "conversations").select(F.expr(_LINES).alias("value")).write.text(path)
    found = R.read_jsonl(spark, path, "conv_id long, turn long").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    return found.unionByName(R.read_optional(spark, path + "-none", "conv_id long, turn long")).unionByName(spark.createDataFrame([(-1, 0)], "conv_id long, turn long"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def csv_round_trip(spark, sf):
    path = S.work_folder(spark, "orders")
    S.write_csv(B.table(spark, sf, "orders"), path, ["o_orderkey", "o_orderpriority", "o_custkey"])
    return R.read_csv(spark, path)


@query("SELECT 'd' || (doc_id // 4) AS doc_id, CAST(doc_id % 4 AS INT) AS page_index FROM documents WHERE doc_id % 4 < 2")
def selected_pages_scan(spark, sf):
    """A selection of pages that keeps its caps."""
    path = S.work_folder(spark, "pages")
    chosen = B.doc_pages(spark, sf).filter("page_index < 2").select("doc_id", "page_index")
    S.write_csv(chosen, path, ["doc_id", "page_index"])
    n = chosen.agg(F.count("*").alias("pages"), F.count_distinct("doc_id").alias("docs")).first()
    return R.read_selected_pages(spark, path, max_pages=n.pages, max_docs=n.docs, per_doc=2)


@query(f"""WITH {B.ARTIFACTS}, o AS (SELECT *, row_number() OVER (ORDER BY artifact_id) - 1 AS input_order FROM art)
SELECT CASE WHEN number % 7 = 0 THEN printf('artifact_%06d', input_order + 1) ELSE artifact_id END AS artifact_id, doc_id, page_index, CAST(input_order AS BIGINT) AS input_order FROM o""")
def artifact_scan(spark, sf):
    """Artifacts as sorted JSON lines, some without an id, scanned with their line numbers."""
    a = B.artifacts(spark, sf)
    a = a.select(F.col("artifact_id").alias("_by"), F.when(F.pmod("number", F.lit(7)) != 0, F.col("artifact_id")).alias("artifact_id"), "doc_id", "page_index")
    path = S.work_folder(spark, "artifacts")
    S.write_jsonl(a, path, ["_by"])
    return R.read_artifacts(spark, path, "artifact_id string, doc_id string, page_index int").select("artifact_id", "doc_id", "page_index", "input_order")


@query(f"""WITH {B.ARTIFACTS} SELECT doc_id, page_index, count(*) AS n_artifacts, min(artifact_id) AS first_artifact FROM art GROUP BY ALL""")
def store_round_trip(spark, sf):
    """One nested document a document, written and scanned as a store."""
    path = S.work_folder(spark, "store") + ".jsonl"
    artifacts = B.artifacts(spark, sf).select("doc_id", "page_index", "artifact_id", "artifact_type")
    S.write_store(artifacts, path)
    pages = R.read_store(spark, path, S.store(artifacts).schema).select("doc_id", F.explode("pages").alias("p"))
    ids = F.transform("p.artifacts", lambda a: a["artifact_id"])
    return pages.select("doc_id", F.col("p.page_index").cast("int").alias("page_index"), F.size("p.artifacts").cast("long").alias("n_artifacts"), F.array_min(ids).alias("first_artifact"))


@query("SELECT role, count(*) * 2 AS n FROM conversations GROUP BY role")
def appended_log(spark, sf):
    """A log to which two stages append."""
    path = S.work_folder(spark, "log")
    c = B.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    for stage in ("first", "second"):
        S.append_log(c.withColumn("stage", F.lit(stage)), path)
    return R.read_jsonl(spark, path, "conv_id long, turn long, role string, stage string").groupBy("role").agg(F.count("*").alias("n"))


@query(f"""WITH {B.BRANCHES} SELECT query, list(page_index ORDER BY rank) FILTER (branch = 'text') AS text, list(page_index ORDER BY rank) FILTER (branch = 'image') AS image FROM br GROUP BY query""")
def wide_ranked_lists(spark, sf):
    return S.wide(B.branches(spark, sf), ["query"], ["text", "image"])


@query(f"""WITH {D._EDGES} SELECT edge_type, count(*) AS n FROM ed WHERE edge_type NOT IN ('same_page', 'same_source_block') GROUP BY edge_type UNION ALL SELECT 'same_record_debug', 1""")
def graph_round_trip(spark, sf):
    """A graph written as JSON lines and loaded with its debug edges, which are one."""
    a, path = B.artifacts(spark, sf), S.work_folder(spark, "graph")
    S.write_jsonl(G.nodes(a), f"{path}/nodes.jsonl", ["node_id"])
    G.in_order(G.edges(a, context=False)).write.json(f"{path}/edges.jsonl")
    spark.createDataFrame([("a", "b", "same_record_debug")], "source string, target string, edge_type string").write.json(f"{path}/debug_edges.jsonl")
    g = R.read_graph(spark, path, debug=True)
    return g["edges"].unionByName(g["debug_edges"]).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN n_chars % 3 <> 0 THEN 'first:' || lang WHEN n_chars % 2 = 0 THEN 'second:' || lang END AS answer FROM documents""")
def resume_stream(spark, sf):
    """A stream of records, run twice: what got no answer comes in again beside answered records, which stay as they are."""
    root, d = S.work_folder(spark, "stream"), B.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")

    def run(records, name, answered):
        records.write.mode("append").parquet(f"{root}/in")
        answer = F.when(answered, F.concat(F.lit(f"{name}:"), "lang"))
        stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
        W.resume(stream, f"{root}/answers", f"{root}/checkpoint", ["doc_id"], "answer", lambda df: df.select("doc_id", answer.alias("answer"))).awaitTermination()

    n = F.col("n_chars")
    run(d, "first", n % 3 != 0)
    run(d.filter((n % 3 == 0) | (n % 5 == 0)), "second", n % 2 == 0)
    return W.answers(spark, f"{root}/answers", ["doc_id"])


@query("""WITH d1 AS (SELECT DISTINCT source FROM documents WHERE doc_id % 20 < 3), d2 AS (SELECT DISTINCT source FROM documents WHERE doc_id % 20 = 7)
SELECT doc_id, source, n_chars, 'base' AS origin FROM documents WHERE source NOT IN (FROM d1) AND source NOT IN (FROM d2)
UNION ALL SELECT doc_id, source, n_chars + 1, 'one' FROM documents WHERE doc_id % 20 < 3 AND source NOT IN (FROM d2)
UNION ALL SELECT doc_id, source, n_chars + 2, 'two' FROM documents WHERE doc_id % 20 = 7""")
def delta_store(spark, sf):
    """A table kept as a base and deltas that replace whole groups, compacted on the way; a batch that comes twice counts once."""
    path, d = S.work_folder(spark, "table"), B.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    part = lambda rows, n, name: rows.select("doc_id", "source", (F.col("n_chars") + n).alias("n_chars"), F.lit(name).alias("origin"))
    i = F.pmod("doc_id", F.lit(20))
    V.append(part(d, 0, "base"), path, "load", 0)
    V.append(part(d.filter(i < 3), 1, "one"), path, "load", 1)
    V.compact(spark, path, ["source"])
    for _ in range(2):
        V.append(part(d.filter(i == 7), 2, "two"), path, "load", 2)
    return V.current(spark, path, ["source"])


_PAGE_FILES = """
p AS (SELECT page_id, 'doc' || (page_id // 6) AS doc_id, CAST(page_id % 6 AS INT) AS page_index, coalesce(html, '') AS html, page_id % 11 <> 7 AS txt, page_id % 13 <> 4 AS img FROM pages),
f AS (SELECT *, CASE page_id % 4 WHEN 0 THEN doc_id || '_' || page_index WHEN 1 THEN doc_id || '_' || printf('%03d', page_index) WHEN 2 THEN 'texts/' || doc_id || '_' || page_index ELSE 'texts/' || doc_id || '_' || printf('%03d', page_index) END || '.txt' AS text_path FROM p)"""


def page_files(spark, sf) -> str:
    """A folder with the text and image files of ``pages``, six a document, at all the places that a file may have; some are missing."""
    root, i = S.work_folder(spark, "page-files"), F.col("page_id")
    p = B.table(spark, sf, "pages").select(i, F.concat(F.lit("doc"), F.floor(i / 6).cast("string")).alias("doc"), F.pmod(i, F.lit(6)).cast("int").alias("n"), F.coalesce("html", F.lit("")).alias("html"))
    short, long = F.concat_ws("_", "doc", F.col("n").cast("string")), F.format_string("%s_%03d", "doc", "n")
    name = lambda folder: F.element_at(F.array(short, long, F.concat(F.lit(folder), short), F.concat(F.lit(folder), long)), (F.pmod(i, F.lit(4)) + 1).cast("int"))
    texts = p.filter("page_id % 11 <> 7").select(F.concat(name("texts/"), F.lit(".txt")).alias("path"), F.col("html").cast("binary").alias("content"))
    more = p.filter("page_id % 4 < 2 AND page_id % 11 <> 7").select(F.concat(F.lit("texts/"), short, F.lit(".txt")).alias("path"), F.lit("not this one").cast("binary").alias("content"))
    images = p.filter("page_id % 13 <> 4").select(F.concat(name("images/"), F.lit(".png")).alias("path"), F.lit("png").cast("binary").alias("content"))
    PS.write(texts.unionByName(more).unionByName(images), root)
    return root


@query(f"""WITH {_PAGE_FILES}, g AS (SELECT doc_id, min(page_index) AS gap FROM f WHERE NOT img GROUP BY doc_id)
SELECT doc_id, page_index, CASE WHEN txt THEN regexp_replace(html, '\\r\\n|\\r|\\n', ' ', 'g') ELSE '' END AS text FROM f LEFT JOIN g USING (doc_id) WHERE img AND (gap IS NULL OR page_index < gap)""")
def page_store_scan(spark, sf):
    """Page files, read up to each document's first page without an image."""
    return PS.contents(spark, page_files(spark, sf)).select("doc_id", "page_index", "text")


@query(f"""WITH {_PAGE_FILES}, r AS (SELECT doc_id, page_index FROM f UNION ALL SELECT doc_id, 77 FROM f WHERE page_index = 0)
SELECT doc_id || '.pdf' AS doc_id, page_index, CASE WHEN txt THEN html END AS page_text, CASE WHEN txt THEN text_path END AS page_text_path, coalesce(txt, false) AS has_page_text, coalesce(img, false) AS has_page_image FROM r LEFT JOIN f USING (doc_id, page_index)""")
def page_store_requests(spark, sf):
    """Asked pages with the first of each's places that exists; one page in seven of each document isn't there."""
    root, i = page_files(spark, sf), F.col("page_id")
    p = B.table(spark, sf, "pages").select(F.format_string("doc%d.pdf", F.floor(i / 6)).alias("doc_id"), F.pmod(i, F.lit(6)).cast("int").alias("page_index"))
    asked = p.unionByName(p.filter("page_index = 0").withColumn("page_index", F.lit(77)))
    return PS.requested(spark, root, asked).drop("page_image_path")


@query(f"WITH {_PAGE_FILES} SELECT doc_id, list(page_index ORDER BY page_index) AS pages FROM f WHERE txt OR img GROUP BY doc_id")
def page_discovery(spark, sf):
    return PS.discovered(spark, page_files(spark, sf))


_SAYS = """CASE doc_id % 9 WHEN 6 THEN 'missing_message_content' WHEN 7 THEN 'http_response_not_json' WHEN 8 THEN 'message_content_not_json' END"""


@query(f"""SELECT doc_id, CASE WHEN doc_id % 9 < 6 THEN doc_id END AS n, CASE WHEN doc_id % 9 < 6 THEN coalesce(text, '') || ' }}{{" \\' END AS t, {_SAYS} AS failure FROM documents""")
def parsed_responses(spark, sf):
    """Responses made of whole documents: answers without a message, two objects, fences, chat completions, pieces that aren't JSON, and three kinds of failure."""
    o = F.to_json(F.struct(F.col("doc_id").alias("n"), F.concat(F.coalesce("text", F.lit("")), F.lit(' }{" \\')).alias("t")))
    chat = lambda content: F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    part = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    direct = F.concat(F.lit('{"doc_id": "d", "page_index": 0, "artifacts": [], '), F.substring(o, 2, 1 << 30))
    forms = [
        direct, F.concat(F.lit('Here it is: '), o, F.lit(' and {"n": -1, "t": "x"}')), F.concat(F.lit("```json\n"), o, F.lit("\n```")), chat(o),
        chat(F.array(part(F.substring(o, 1, 20)), part(F.expr("''")), part(F.substring(o, 21, 1 << 30)))), F.concat(F.lit('{not json {neither}} then "{" '), F.lit('{"open": '), o),
        F.lit("[1, 2]"), F.lit("no object at all"), chat(F.lit("only words")),
    ]
    said = F.element_at(F.array(*forms), (F.pmod("doc_id", F.lit(9)) + 1).cast("int"))
    d = B.documents(spark, sf).select("doc_id", A.response_body(said).alias("r"))
    return d.select("doc_id", F.from_json("r.object", "n long, t string").alias("x"), "r.failure").select("doc_id", "x.n", "x.t", "failure")


#: Lines of documents that leak, by the number's remainder: a key and one that looks alike, a key in a list, a fragment, a payload's key and a fragment, a payload.
_LEAKS = [
    '{"answer": "x", "meta": {"no_answer_generation": true}}', '{"items": [{"k": 1}, {"image_path": "a", "b": [{"gold_page": 1}]}]}', '{"note": "see FILE:///tmp/x"}',
    '{"meta": {"base64": ""}, "list": ["a", "data:image/png"]}', '{"held": "' + "QUJD" * 30 + '"}',
]


@query(f"""WITH l AS (SELECT doc_id, text, 'part' || (doc_id // 50) || '.jsonl' AS file, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS n FROM documents),
v AS (SELECT file, n, unnest(CASE doc_id % 6 WHEN 1 THEN [('', 'field:answer')] WHEN 2 THEN [('.items[1]', 'field:image_path'), ('.items[1].b[0]', 'field:gold_page')] WHEN 3 THEN [('.note', 'content:file://')]
    WHEN 4 THEN [('.meta', 'field:base64'), ('.list[1]', 'content:data:image')] WHEN 5 THEN [('.held', 'content:base64_payload')] ELSE [] END) AS x FROM l),
own AS (SELECT file, n, f FROM l, (VALUES ('file://'), ('/home/'), ('data:image')) t(f) WHERE doc_id % 6 = 0 AND contains(lower(coalesce(text, '')), f)),
a AS (SELECT file, 'line:' || n || x[1] AS location, 'forbidden_' || x[2] AS reason FROM v UNION ALL SELECT file, 'line:' || n || '.text', 'forbidden_content:' || f FROM own)
SELECT * FROM a UNION ALL SELECT DISTINCT file, NULL, reason FROM a WHERE reason IN ('forbidden_content:file://', 'forbidden_content:/home/', 'forbidden_content:data:image')""")
def file_audit(spark, sf):
    """Whole documents and lines that leak, fifty a file, written, read back and audited."""
    root, n = S.work_folder(spark, "public"), F.col("doc_id")
    clean = F.to_json(F.struct(n.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    line = F.element_at(F.array(clean, *map(F.lit, _LEAKS)), (F.pmod(n, F.lit(6)) + 1).cast("int"))
    d = B.table(spark, sf, "documents").select(F.format_string("part%d.jsonl", F.floor(n / 50)).alias("path"), F.struct(n.alias("n"), line.alias("line")).alias("x"))
    files = d.groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("x")).select("path", F.array_join(F.transform("x", lambda x: x["line"]), "\n").cast("binary").alias("content"))
    PS.write(files, root)
    return FA.audit(spark, root)


@query("""WITH p AS (SELECT page_id, url, length(coalesce(html, '')) AS n FROM pages)
SELECT page_id, 0 AS table_no, r AS row_index, c AS column_index, url AS row_label, CASE c WHEN 1 THEN 'size chars' WHEN 2 THEN 'size pages' ELSE 'id' END AS column_label,
  CASE WHEN c = 1 THEN CAST(n + r AS VARCHAR) WHEN c = 2 THEN '1' ELSE 'p' || page_id END AS value_text
FROM p, (VALUES (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)) v(r, c)""")
def html_table_cells(spark, sf):
    """Whole pages, each with a table on its own url and size: two rows of headers, spans to the right and down."""
    p = B.table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"), "url")
    n, url = F.length("html"), F.replace("url", F.lit("&"), F.lit("&amp;"))
    table = F.format_string(
        "<table><tr><th rowspan=2>page<th colspan='2'>size</th><th rowspan=\"2\">id</th></tr><tr><th>chars<th>pages</tr><tr><td rowspan=0>%s<td>%d</td><td>1<td rowspan=2><b>p</b>%s<tr><td>%d<td>1</table>", url, n + 2, F.col("page_id").cast("string"), n + 3
    )
    return GR.table_cells(p.withColumn("html", F.concat("html", table)), ["page_id"], "html")
