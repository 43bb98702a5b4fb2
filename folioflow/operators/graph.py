"""Structural evidence graph: node and edge tables by rule, degree prior, neighbourhood expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import node_id

CONTEXT = ["same_page", "same_source_block"]
EXPANSION = [
    "located_on_page", "supported_by_anchor", "anchor_on_page", "adjacent_page", "next_block", "section_contains",
    "table_contains_cell", "row_contains_cell", "column_contains_cell", "caption_of", "figure_has_caption",
]


#: What the artifacts of a context edge share.
ON_PAGE, ON_BLOCK = ["doc_id", "page_index"], ["doc_id", "page_index", "source_id"]


def identified(a: DataFrame) -> DataFrame:
    d, p = F.col("doc_id"), F.col("page_index")
    return a.withColumns(
        {
            "n_artifact": node_id("artifact", d, p, F.col("artifact_id")),
            "n_page": node_id("page", d, p),
            "n_anchor": node_id("source_anchor", d, p, F.col("source_id")),
            "n_section": F.when(F.col("section_id").isNotNull(), node_id("section", d, p, F.col("section_id"))),
            "n_figure": F.when(F.col("figure_id").isNotNull(), node_id("figure", d, p, F.col("figure_id"))),
            "n_caption": F.when(F.col("caption_id").isNotNull(), node_id("caption", d, p, F.col("caption_id"))),
            "n_table": F.when(F.col("table_id").isNotNull(), node_id("table", d, p, F.col("table_id"))),
            "n_row": F.when(F.col("row_index").isNotNull(), node_id("table_row", d, p, F.col("table_id"), F.col("row_index"))),
            "n_column": F.when(F.col("column_index").isNotNull(), node_id("table_column", d, p, F.col("table_id"), F.col("column_index"))),
        }
    )


def _cell() -> Column:
    return F.col("table_id").isNotNull() & (
        (F.col("artifact_type") == "table_cell") | F.col("row_index").isNotNull() | F.col("column_index").isNotNull()
    )


def nodes(artifacts: DataFrame) -> DataFrame:
    """(node_id, node_type, doc_id, page_index), each node once."""
    pair = F.col("figure_id").isNotNull() & F.col("caption_id").isNotNull()
    made = {
        "artifact": F.col("n_artifact"),
        "page": F.col("n_page"),
        "source_anchor": F.col("n_anchor"),
        "section": F.col("n_section"),
        "figure": F.when(pair, F.col("n_figure")),
        "caption": F.when(pair, F.col("n_caption")),
        "table": F.when(_cell(), F.col("n_table")),
        "table_row": F.when(_cell(), F.col("n_row")),
        "table_column": F.when(_cell(), F.col("n_column")),
    }
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("node_type"), v.alias("node_id")) for k, v in made.items()])).alias("n")
    rows = identified(artifacts).select("doc_id", "page_index", one).filter("n.node_id IS NOT NULL")
    return rows.select("n.node_id", "n.node_type", "doc_id", "page_index").dropDuplicates(["node_id"])


def edges(artifacts: DataFrame, context: bool = True) -> DataFrame:
    """(source, target, edge_type), each edge once.

    Sequence rules look at the next page or block of the same document with ``lead``; only pairs on one page
    or block (the context rules) join the artifacts with themselves.
    """
    a = identified(artifacts)
    pair = F.col("figure_id").isNotNull() & F.col("caption_id").isNotNull()
    made = [
        ("located_on_page", "n_artifact", "n_page", F.lit(True)),
        ("supported_by_anchor", "n_artifact", "n_anchor", F.lit(True)),
        ("anchor_on_page", "n_anchor", "n_page", F.lit(True)),
        ("section_contains", "n_section", "n_artifact", F.col("section_id").isNotNull()),
        ("caption_of", "n_caption", "n_figure", pair),
        ("figure_has_caption", "n_figure", "n_caption", pair),
        ("table_contains_cell", "n_table", "n_artifact", _cell()),
        ("row_contains_cell", "n_row", "n_artifact", _cell() & F.col("row_index").isNotNull()),
        ("column_contains_cell", "n_column", "n_artifact", _cell() & F.col("column_index").isNotNull()),
    ]
    each = [F.when(ok, F.struct(F.col(s).alias("source"), F.col(t).alias("target"), F.lit(k).alias("edge_type"))) for k, s, t, ok in made]
    rows = a.select(F.explode(F.array_compact(F.array(*each))).alias("e")).select("e.*").distinct()
    pages = a.select("doc_id", "page_index", "n_page").distinct()
    w = Window.partitionBy("doc_id").orderBy("page_index")
    follow = pages.select(F.col("n_page").alias("source"), F.lead("n_page").over(w).alias("target"), (F.lead("page_index").over(w) - F.col("page_index")).alias("gap"))
    rows = rows.unionByName(follow.filter("gap = 1").select("source", "target", F.lit("adjacent_page").alias("edge_type")))
    block = a.select("doc_id", "page_index", "n_anchor", F.regexp_extract("source_id", r"^(.*?)(\d+)$", 1).alias("prefix"), F.regexp_extract("source_id", r"^(.*?)(\d+)$", 2).try_cast("int").alias("no")).distinct()
    w = Window.partitionBy("doc_id", "page_index", "prefix").orderBy("no")
    follow = block.filter("no IS NOT NULL").select(F.col("n_anchor").alias("source"), F.lead("n_anchor").over(w).alias("target"), (F.lead("no").over(w) - F.col("no")).alias("gap"))
    rows = rows.unionByName(follow.filter("gap = 1").select("source", "target", F.lit("next_block").alias("edge_type")))
    if context:
        rows = rows.unionByName(pairs(a, ON_PAGE, "same_page")).unionByName(pairs(a, ON_BLOCK, "same_source_block"))
    return rows


def pairs(a: DataFrame, keys: list[str], kind: str) -> DataFrame:
    left = a.select(*keys, F.col("n_artifact").alias("source"))
    right = a.select(*keys, F.col("n_artifact").alias("target"))
    return left.join(right, keys).filter("source < target").select("source", "target", F.lit(kind).alias("edge_type")).distinct()


def _together(artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """(node_id, others): each artifact and how many others share its keys, by counting."""
    w = Window.partitionBy(*keys)
    return identified(artifacts).select(*keys, F.col("n_artifact").alias("node_id")).distinct().select("node_id", (F.count("*").over(w) - 1).alias("others"))


def counts_by_type(edges_: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """(edge_type, n); with ``artifacts`` context edges too, which are counted without being made."""
    out = edges_.groupBy("edge_type").agg(F.count("*").alias("n"))
    if artifacts is None:
        return out
    for kind, keys in (("same_page", ON_PAGE), ("same_source_block", ON_BLOCK)):
        n = identified(artifacts).select(*keys, "n_artifact").distinct().groupBy(*keys).agg(F.count("*").alias("n"))
        whole = n.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n")).filter("n > 0")
        out = out.unionByName(whole.select(F.lit(kind).alias("edge_type"), "n"))
    return out


def degree_prior(edges_: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """(node_id, degree, prior) of artifact nodes. With ``artifacts``, context edges count without being made: an artifact has
    as many on its page, and on its block, as there are others."""
    ends = edges_.select(F.explode(F.array("source", "target")).alias("node_id")).filter(F.col("node_id").startswith("artifact:"))
    deg = ends.groupBy("node_id").agg(F.count("*").alias("degree"))
    if artifacts is not None:
        for keys in (ON_PAGE, ON_BLOCK):
            deg = deg.unionByName(_together(artifacts, keys).withColumnRenamed("others", "degree"))
        deg = deg.groupBy("node_id").agg(F.sum("degree").alias("degree")).filter("degree > 0")
    top = deg.agg(F.max("degree").alias("top"))
    return deg.crossJoin(F.broadcast(top)).select("node_id", "degree", (F.col("degree") / F.col("top")).alias("prior"))  # one row


def artifact_degree_prior(artifacts: DataFrame) -> DataFrame:
    """(node_id, degree, prior) of the artifacts of a graph built by the rules above, without making an edge: an artifact has an edge to its page, its
    anchor, its section, table, row and column, and one to each other artifact on its page and on its block. Ids are unique on a page."""
    a = identified(artifacts)
    own = [F.lit(2), F.col("section_id").isNotNull().cast("int"), _cell().cast("int"), (_cell() & F.col("row_index").isNotNull()).cast("int"), (_cell() & F.col("column_index").isNotNull()).cast("int")]
    a = a.select(*ON_BLOCK, F.col("n_artifact").alias("node_id"), sum(own[1:], own[0]).alias("own"))
    others = [F.count("*").over(Window.partitionBy(*keys)) - 1 for keys in (ON_PAGE, ON_BLOCK)]
    deg = a.select("node_id", (F.col("own") + others[0] + others[1]).cast("long").alias("degree"))
    top = deg.agg(F.max("degree").alias("top"))
    return deg.crossJoin(F.broadcast(top)).select("node_id", "degree", (F.col("degree") / F.col("top")).alias("prior"))  # one row


def direct_neighbours(edges_: DataFrame) -> DataFrame:
    """(node, neighbour): artifacts joined by one structural edge, in either direction."""
    e = edges_.filter(F.col("edge_type").isin(EXPANSION) & F.col("source").startswith("artifact:") & F.col("target").startswith("artifact:"))
    return e.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).union(e.select("target", "source")).distinct()


def page_neighbours(edges_: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node, neighbour): artifacts on an artifact's page or on a page next to it; with ``of`` (node) those of the nodes named, from which it starts."""
    on = edges_.filter("edge_type = 'located_on_page'").select(F.col("source").alias("artifact"), F.col("target").alias("page"))
    step = edges_.filter("edge_type = 'adjacent_page'").select("source", "target")
    near = on.select("page", F.col("page").alias("near")).distinct().union(step).union(step.select("target", "source"))
    start = on.withColumnRenamed("artifact", "node")
    reach = (start if of is None else start.join(of, "node", "left_semi")).join(near, "page")
    other = on.select(F.col("artifact").alias("neighbour"), F.col("page").alias("near"))
    return reach.join(other, "near").filter("node <> neighbour").select("node", "neighbour").distinct()


def anchor_neighbours(edges_: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node, neighbour): artifacts supported by the same anchor; with ``of`` (node) those of the nodes named, from which it starts."""
    by = edges_.filter("edge_type = 'supported_by_anchor'")
    start = by.select(F.col("source").alias("node"), F.col("target").alias("anchor"))
    return (
        (start if of is None else start.join(of, "node", "left_semi"))
        .join(by.select(F.col("source").alias("neighbour"), F.col("target").alias("anchor")), "anchor")
        .filter("node <> neighbour").select("node", "neighbour").distinct()
    )


def expand(seeds: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``seeds``: (query, node, rank). (query, node, position): each seed is followed by its new neighbours, by name."""
    own = seeds.select("query", "node", F.struct(F.col("rank"), F.lit(0).alias("far"), F.lit("").alias("name")).alias("at"))
    more = seeds.join(neighbours, "node").select("query", F.col("neighbour").alias("node"), F.struct(F.col("rank"), F.lit(1).alias("far"), F.col("neighbour").alias("name")).alias("at"))
    first = own.union(more).groupBy("query", "node").agg(F.min("at").alias("at"))
    return first.select("query", "node", F.row_number().over(Window.partitionBy("query").orderBy("at")).alias("position"))


#: Kinds of nodes and edges.
NODE_TYPES = ["artifact", "page", "source_anchor", "section", "figure", "caption", "table", "table_row", "table_column"]
DEBUG = ["same_record_debug"]
SEMANTIC = ["supports", "contradicts", "derived_from", "semantic_relation", "entails", "refutes", "answer_supports", "proof_supports", "cites"]
#: Node-locator fields that a node takes over, and the fields of an edge's provenance.
LOCATOR_FIELDS = ["table_id", "figure_id", "caption_id", "section_id", "row_index", "column_index"]


def referable(artifacts: DataFrame) -> DataFrame:
    """Artifacts that a graph can name: a document, a page from zero, an id. An anchor without a page of its own takes the artifact's."""
    ok = (F.coalesce("doc_id", F.lit("")) != "") & (F.coalesce("page_index", F.lit(-1)) >= 0) & (F.coalesce("artifact_id", F.lit("")) != "")
    out = artifacts.filter(ok)
    if "anchor_page_index" in out.columns:
        out = out.withColumn("anchor_page_index", F.coalesce("anchor_page_index", "page_index"))
    return out


def artifact_nodes(artifacts: DataFrame) -> DataFrame:
    """(node_id, doc_id, page_id, page_index, artifact_id, artifact_type, modality, candidate_status, source_block_id, locator): the
    artifact's node with its first anchor; ``locator`` is a map without the fields that are empty."""
    a = identified(referable(artifacts))
    filled = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, LOCATOR_FIELDS)), F.array(*LOCATOR_FIELDS)), lambda _, v: v.isNotNull() & (v != ""))
    return a.select(
        F.col("n_artifact").alias("node_id"), "doc_id", F.col("n_page").alias("page_id"), "page_index", "artifact_id", "artifact_type", "modality",
        F.coalesce("status", F.lit("candidate")).alias("candidate_status"), F.col("source_id").alias("source_block_id"), filled.alias("locator"),
    )


def provenance(**given: Column) -> Column:
    """An edge's provenance as JSON without its empty fields: document, page, block, and the locator fields; a given field goes before
    the artifact's own, unless it is empty."""
    own = {"doc_id": F.col("doc_id"), "page_id": F.col("n_page"), "page_index": F.col("page_index"), "source_block_id": F.col("source_id"), **{c: F.col(c) for c in LOCATOR_FIELDS}}
    kept = lambda c: F.when(c.cast("string") != "", c)
    return F.to_json(F.struct(*[F.coalesce(kept(given[k]), kept(v)).alias(k) if k in given else kept(v).alias(k) for k, v in own.items()]))


def anchored_edges(artifacts: DataFrame) -> DataFrame:
    """(edge_id, source, target, edge_type, rule_name, rule_version, deterministic, provenance) of artifacts' pages and anchors, in total order."""
    a = identified(referable(artifacts))
    rules = [("located_on_page", "n_artifact", "n_page", "artifact_page_locator"), ("supported_by_anchor", "n_artifact", "n_anchor", "artifact_source_anchor"), ("anchor_on_page", "n_anchor", "n_page", "source_anchor_page_locator")]
    own = F.array(*[F.struct(F.lit(k).alias("edge_type"), F.col(s).alias("source"), F.col(t).alias("target"), F.lit(r).alias("rule_name")) for k, s, t, r in rules])
    e = a.select(F.explode(own).alias("e"), "artifact_id", provenance().alias("provenance")).select("e.*", "artifact_id", "provenance")
    # of an edge that several artifacts make, the last one's stays
    last = e.groupBy("edge_type", "source", "target", "rule_name").agg(F.max_by("provenance", "artifact_id").alias("provenance"))
    named = F.sha2(F.concat_ws("|", "edge_type", "source", "target"), 256)
    out = last.select(F.left(named, F.lit(24)).alias("edge_id"), "source", "target", "edge_type", "rule_name", F.lit("v1").alias("rule_version"), F.lit(True).alias("deterministic"), "provenance")
    return out


def in_order(edges_: DataFrame) -> DataFrame:
    """Edges in total order, for a sink."""
    return edges_.orderBy("edge_type", "source", "target", *([c for c in ("edge_id",) if c in edges_.columns]))


def debug_edges(retrieved: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(query, source, target): pairs of artifacts that one question retrieved. ``retrieved``: (query, artifact_id), at most top k a question."""
    a = identified(referable(artifacts)).select("artifact_id", F.col("n_artifact").alias("node"))
    hits = retrieved.select("query", "artifact_id").distinct().join(a, "artifact_id").groupBy("query").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    pair = F.flatten(F.transform("nodes", lambda x, i: F.transform(F.slice("nodes", i + 2, F.size("nodes")), lambda y: F.struct(x.alias("source"), y.alias("target")))))
    return hits.select("query", F.explode(pair).alias("p")).select("query", "p.*")


def skipped(artifacts: DataFrame) -> DataFrame:
    """(reason, n): how often a layout rule found an artifact it might apply to, but not the ids it needs."""
    a = artifacts
    t, has = F.col("artifact_type"), lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    known = (F.coalesce("doc_id", F.lit("")) != "") & (F.coalesce("page_index", F.lit(-1)) >= 0) & (F.coalesce("artifact_id", F.lit("")) != "")
    cell = (t == "table_cell") | (has("table_id") & (has("row_index") | has("column_index")))
    rules = {
        "artifact_missing_required_identity": ~known,
        "artifact_missing_source_anchor": known & ~has("source_id"),
        "section_contains_missing_section_id": known & (t == "section_header") & ~has("section_id"),
        "caption_figure_missing_explicit_pair": known & (t.isin("figure", "caption") | has("figure_id") | has("caption_id")) & ~(has("figure_id") & has("caption_id")),
        "table_contains_cell_missing_table_id": known & cell & ~has("table_id"),
        "row_contains_cell_missing_row_index": known & cell & has("table_id") & ~has("row_index"),
        "column_contains_cell_missing_column_index": known & cell & has("table_id") & ~has("column_index"),
        "next_block_unparseable_source_block_id": known & has("source_id") & ~F.col("source_id").rlike(r"\d$"),
    }
    counts = a.agg(*[F.count_if(v).alias(k) for k, v in rules.items()])
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("reason"), F.col(k).alias("n")) for k in rules]))
    return counts.select(pair.alias("x")).select("x.*").filter("n > 0")


def violations(nodes_: DataFrame, edges_: DataFrame, formal: list[str], required: list[str]) -> DataFrame:
    """(violation, n): node and edge types beyond those allowed, required fields that are missing or null, edges that aren't deterministic."""
    n = nodes_.filter(~F.col("node_type").isin(NODE_TYPES)).select(F.concat(F.lit("unexpected_node_type:"), "node_type").alias("violation"))
    tests = [F.when(~F.col("edge_type").isin(formal), F.concat(F.lit("unexpected_edge_type:"), "edge_type"))]
    tests += [F.when(F.col(c).isNull() if c in edges_.columns else F.lit(True), F.lit(f"missing_field:{c}")) for c in required]
    if "deterministic" in edges_.columns:
        tests.append(F.when(~F.col("deterministic"), F.lit("not_deterministic")))
    e = edges_.select(F.explode(F.array_compact(F.array(*tests))).alias("violation"))
    return n.unionByName(e).groupBy("violation").agg(F.count("*").alias("n"))


def checked(nodes_: DataFrame, edges_: DataFrame, formal: list[str], required: list[str]) -> DataFrame:
    """``edges_``; the job fails if :func:`violations` finds any."""
    bad = violations(nodes_, edges_, formal, required).agg(F.array_sort(F.collect_list("violation")).alias("_bad"))  # one row, a few kinds
    stop = F.when(F.size("_bad") > 0, F.raise_error(F.concat(F.lit("graph: "), F.array_join("_bad", ", ")))).otherwise(F.lit(True))
    return edges_.crossJoin(F.broadcast(bad.select(stop.alias("_ok")))).filter("_ok").drop("_ok")


def without_debug(edges_: DataFrame) -> DataFrame:
    """Formal edges; the job fails if the table holds debug or semantic ones."""
    wrong = F.col("edge_type").isin([*DEBUG, *SEMANTIC])
    return edges_.withColumn("edge_type", F.when(wrong, F.raise_error(F.concat(F.lit("forbidden edge type: "), "edge_type"))).otherwise(F.col("edge_type")))


def adjacency(edges_: DataFrame) -> DataFrame:
    """(edge_type, node, neighbour, direction): each formal edge seen from its source (out) and its target (in)."""
    e = without_debug(edges_).select("edge_type", "source", "target").distinct()
    out = e.select("edge_type", F.col("source").alias("node"), F.col("target").alias("neighbour"), F.lit("out").alias("direction"))
    return out.unionByName(e.select("edge_type", F.col("target").alias("node"), F.col("source").alias("neighbour"), F.lit("in").alias("direction")))


def page_index_of(edges_: DataFrame, formal: list[str]) -> dict[str, DataFrame]:
    """What re-ranking looks up in a graph: page_neighbours, artifact_pages, artifact_anchors, anchor_pages, structural_pages."""
    e = edges_.filter(F.col("edge_type").isin(formal))
    of = lambda kind, a, b: e.filter(F.col("edge_type") == kind).select(F.col("source").alias(a), F.col("target").alias(b)).distinct()
    step = of("adjacent_page", "page", "neighbour")
    ends = e.select(F.explode(F.array("source", "target")).alias("node")).filter(F.col("node").startswith("page:")).distinct()
    return {
        "page_neighbours": step.union(step.select("neighbour", "page")).distinct(),
        "artifact_pages": of("located_on_page", "artifact", "page"),
        "artifact_anchors": of("supported_by_anchor", "artifact", "anchor"),
        "anchor_pages": of("anchor_on_page", "anchor", "page"),
        "structural_pages": ends.select(F.split("node", ":")[1].alias("doc_id"), F.split("node", ":")[2].cast("int").alias("page_index")),
    }


def added_by_type(seeds: DataFrame, edges_: DataFrame, mode: str) -> DataFrame:
    """(edge_type, added, n_queries, hits): each edge type that an expansion of a question used is credited with all that was added to the question.

    ``seeds``: (query, node, rank). ``mode``: direct_structural, page_neighborhood or source_anchor_neighborhood.
    """
    near = {"direct_structural": direct_neighbours, "page_neighborhood": page_neighbours, "source_anchor_neighborhood": anchor_neighbours}[mode]
    both = adjacency(edges_).select("edge_type", "node", "neighbour").distinct()
    own = seeds.select("query", "node").distinct()
    if mode == "direct_structural":
        used = own.join(both.filter(F.col("edge_type").isin(EXPANSION) & F.col("neighbour").startswith("artifact:")), "node").select("query", "edge_type")
    elif mode == "source_anchor_neighborhood":
        used = own.join(both.filter("edge_type = 'supported_by_anchor'"), "node").select("query", "edge_type")
    else:
        on = own.join(both.filter("edge_type = 'located_on_page'"), "node").select("query", "edge_type", F.col("neighbour").alias("page"))
        step = on.select("query", "page").join(both.filter("edge_type = 'adjacent_page'").withColumnRenamed("node", "page"), "page").select("query", "edge_type")
        used = on.select("query", "edge_type").union(step)
    grown = expand(seeds, near(edges_)).join(own, ["query", "node"], "left_anti").groupBy("query").agg(F.count("*").alias("added"))
    j = used.distinct().join(grown, "query", "left").na.fill(0, ["added"])
    return j.groupBy("edge_type").agg(F.sum("added").alias("added"), F.count("*").alias("n_queries"))
