"""Question records: constraints named in a question, candidate pools, preflight, page preparation, page selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import page_id, record_id

#: Fixed values.
COLORS = ["blue", "red", "black", "green", "yellow", "white"]
VISUAL_WORDS = ["color", "blue", "red", "black", "green", "yellow", "white", "handwritten", "handwriting", "image", "figure", "page"]
CHART_TERMS = ["chart", "graph", "plot"]
TABLE_TERMS = ["table", "tabular", "spreadsheet"]
FIGURE_TERMS = ["figure", "image", "picture", "photo", "diagram", "map"]
OTHER_VISUAL_TERMS = ["handwritten", "handwriting", "color", "colour", "visual"]
NUMERIC_TERMS = ["how\\s+much", "how\\s+many", "percent", "percentage", "number", "amount", "value", "year"]
POOL_POLICY = "retrieval_union_plus_valid_explicit_page_constraints"


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def _word(text: Column, words: list[str]) -> Column:
    return text.rlike(rf"\b(?:{'|'.join(words)})\b")


def page_references(question: Column) -> Column:
    """Pages that a question names, in order: (surface_text, page_number one-based, page_index zero-based)."""
    said = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"(?i)\bpages?\s+\d+\b"), F.lit(0))
    number = lambda s: F.regexp_extract(s, r"(\d+)$", 1).try_cast("int")
    refs = F.transform(said, lambda s: F.struct(s.alias("surface_text"), number(s).alias("page_number"), (number(s) - 1).alias("page_index")))
    return F.filter(refs, lambda r: r["page_number"] >= 1)


def visual_attributes(question: Column) -> Column:
    """(attribute_type, attribute_value) of colours and handwriting that a question names, in a fixed order."""
    q = F.lower(F.coalesce(question, F.lit("")))
    one = lambda kind, value, ok: F.when(ok, F.struct(F.lit(kind).alias("attribute_type"), F.lit(value).alias("attribute_value")))
    return F.array_compact(F.array(*[one("color", c, _word(q, [c])) for c in COLORS], one("script_type", "handwritten", _word(q, ["handwritten", "handwriting"]))))


def target_object(question: Column) -> Column:
    """(object_type, modality_requirement): what a question is about, and whether it needs the page's image."""
    q = F.lower(F.coalesce(question, F.lit("")))
    kind = F.when(_word(q, ["word", "words"]), "words").when(_word(q, ["signature"]), "signature").when(_word(q, ["stamp"]), "stamp").otherwise("unspecified")
    return F.struct(kind.alias("object_type"), F.when(_any(q, VISUAL_WORDS), "visual").otherwise("text").alias("modality_requirement"))


def constraints(question: Column) -> Column:
    return F.struct(page_references(question).alias("page_references"), visual_attributes(question).alias("visual_attributes"), target_object(question).alias("target_object"))


def modality(question: Column, has_image: Column) -> Column:
    """What a question's words say about the evidence to compile: flags, and artifact types in order, each once."""
    q = F.lower(F.coalesce(question, F.lit("")))
    chart, table, figure = (_any(q, t) for t in (CHART_TERMS, TABLE_TERMS, FIGURE_TERMS))
    numeric = q.rlike("|".join(rf"\b{t}\b" for t in NUMERIC_TERMS))
    visual = chart | table | figure | _any(q, OTHER_VISUAL_TERMS)
    lits = lambda *x: F.array(*map(F.lit, x))
    some = lambda ok, *x: F.when(ok, lits(*x)).otherwise(F.array().cast("array<string>"))
    types = F.concat(some(visual & has_image, "visual_observation"), some(chart, "figure", "numeric_fact"), some(table, "table", "numeric_fact"), some(figure, "figure", "caption"), some(numeric, "numeric_fact"))
    flags = {"requires_visual": visual, "mentions_chart": chart, "mentions_table": table, "mentions_figure": figure, "mentions_numeric": numeric}
    return F.struct(*[v.alias(k) for k, v in flags.items()], F.array_distinct(types).alias("recommended_types"))


def pool(ranked: DataFrame, key: list[str]) -> DataFrame:
    """(key, retrieval_pages): the pages of all branches, sorted and distinct. ``ranked``: (key, branch, page_index, rank)."""
    return ranked.groupBy(*key).agg(F.array_sort(F.collect_set("page_index")).alias("retrieval_pages"))


def normalised(records: DataFrame, ranked: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """One nested record a question.

    ``records``: (query, doc_id, question); ``ranked``: (query, branch, rank, page_index, score), a branch's list of pages;
    ``page_counts``: (doc_id, n_pages), with which references beyond the document are told apart. A page that a
    branch lists twice keeps its first rank and the other ranks as duplicates.
    """
    page = ranked.groupBy("query", "branch", "page_index").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("at"))
    unique = page.select(
        "query",
        "branch",
        F.struct(F.col("at")[0]["rank"].alias("rank"), "page_index", F.col("at")[0]["score"].alias("score"), F.transform(F.slice("at", 2, F.size("at")), lambda x: x["rank"]).alias("duplicate_ranks")).alias("p"),
    )
    lists = unique.groupBy("query").pivot("branch", ["text", "image"]).agg(F.array_sort(F.collect_list("p")))
    none = F.array().cast("array<int>")
    r = records.join(lists, "query", "left")
    pages = lambda c: F.coalesce(F.transform(c, lambda p: p["page_index"].cast("int")), none)
    r = r.withColumn("retrieval_pages", F.array_sort(F.array_union(pages("text"), pages("image"))))
    r = r.withColumn("c", constraints(F.col("question")))
    r = r.join(page_counts.select("doc_id", "n_pages"), "doc_id", "left") if page_counts is not None else r.withColumn("n_pages", F.lit(None).cast("int"))
    fits = lambda i: F.col("n_pages").isNull() | (i < F.col("n_pages"))
    raw = F.array_sort(F.array_distinct(F.transform("c.page_references", lambda x: x["page_index"])))
    r = r.withColumn("raw", raw).withColumn("valid", F.filter("raw", fits))
    r = r.withColumn("required", F.array_sort(F.array_except(F.array_union("retrieval_pages", "valid"), F.array_except("raw", "valid"))))
    reasons = F.transform(
        F.filter("c.page_references", lambda x: F.array_contains(F.col("valid"), x["page_index"])),
        lambda x: F.struct(x["page_index"].alias("page_index"), F.lit("explicit_page_reference").alias("reason_type"), x["surface_text"].alias("reason_text")),
    )
    return r.select(
        "query",
        record_id(F.col("doc_id"), F.col("doc_id"), F.col("question")).alias("record_id"),
        F.struct("doc_id").alias("document"),
        F.struct(F.col("question").alias("text")).alias("question"),
        F.col("c").alias("question_constraints"),
        F.struct("text", "image").alias("retrieval"),
        F.struct(
            "retrieval_pages",
            F.col("raw").alias("explicit_pages_raw"),
            F.col("valid").alias("explicit_pages"),
            F.array_except("raw", "valid").alias("explicit_pages_invalid"),
            F.col("required").alias("required_pages"),
            F.array_except("valid", "retrieval_pages").alias("missed_explicit_pages"),
            F.lit(POOL_POLICY).alias("policy"),
        ).alias("candidate_pool"),
        F.struct(F.col("required").alias("pages_to_compile"), F.col("valid").alias("priority_pages"), reasons.alias("reasons")).alias("compilation_plan"),
    )


def preflight(records: DataFrame, routes: DataFrame, sources: DataFrame, key: str = "query") -> DataFrame:
    """``records`` with stage2: (preflight (passed, blocking_reasons), candidate_page_routes).

    ``routes``: (key, page_index, routes); ``sources``: (doc_id, page_index, has_text, has_image). A record without candidate
    pages, or none of whose candidates has a source, is blocked.
    """
    own = records.select(key, "doc_id").join(routes, key)
    j = own.join(sources, ["doc_id", "page_index"], "left")
    there = F.coalesce(F.col("has_text"), F.lit(False)) | F.coalesce(F.col("has_image"), F.lit(False))
    per = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_index", "routes"))).alias("_routes"), F.max(there).alias("_there"))
    out = records.join(per, key, "left")
    known = F.coalesce("_routes", F.array().cast("array<struct<page_index:int,routes:array<string>>>"))
    reasons = F.array_compact(F.array(F.when(F.size(known) == 0, "no_candidate_page_routes").when(~F.col("_there"), "missing_all_candidate_sources")))
    stage = F.struct(F.struct((F.size(reasons) == 0).alias("passed"), reasons.alias("blocking_reasons")).alias("preflight"), known.alias("candidate_page_routes"))
    return out.withColumn("stage2", stage).drop("_routes", "_there")


def routes_of(routes: Column, page: Column) -> Column:
    """Routes of a page among ``candidate_page_routes``: null where that list is absent, empty where it lacks the page."""
    own = F.filter(routes, lambda r: r["page_index"] == page)
    kept = F.filter(F.array(F.lit("text"), F.lit("image")), lambda x: F.array_contains(F.get(own, F.lit(0))["routes"], x))
    return F.when(routes.isNull(), F.lit(None)).when(F.size(own) > 0, kept).otherwise(F.array().cast("array<string>"))


def eligible_source() -> Column:
    """A page source that can be compiled: it has an image, the image's path, and blocks."""
    return F.coalesce(F.col("has_image") & F.col("page_image_path").isNotNull() & (F.col("page_image_path") != "") & (F.size("layout_block_ids") > 0), F.lit(False))


def prepared(pages: DataFrame) -> DataFrame:
    """Adds page_id, and what a page's routes admit: its text and image path, null where not admitted; error where neither gives a block.

    ``pages``: (doc_id, page_index, page_text, page_image_path, input_routes), routes null where nothing is known of them.
    """
    admits = lambda r: F.col("input_routes").isNull() | F.array_contains("input_routes", r)
    out = pages.withColumns({"page_text": F.when(admits("text"), F.col("page_text")), "page_image_path": F.when(admits("image"), F.col("page_image_path"))})
    blocks = (F.length(F.trim(F.coalesce("page_text", F.lit("")))) > 0) | F.col("page_image_path").isNotNull()
    out = out.withColumns({"page_id": page_id(F.col("doc_id"), F.col("page_index")), "has_page_text": F.col("page_text").isNotNull(), "has_page_image": F.col("page_image_path").isNotNull()})
    return out.withColumn("error", F.when(~blocks, "missing_source_anchors"))


def compiler_record(doc_id: Column, page: Column, reason: Column, question: Column | None = None) -> Column:
    """The least record that a compiler of one page gets; without a question the document-generic one."""
    priority = F.when(reason == "valid_explicit_page_with_image", F.array(page)).otherwise(F.array().cast("array<int>"))
    return F.struct(
        F.struct(doc_id.alias("doc_id")).alias("document"),
        F.struct((question if question is not None else F.lit(None).cast("string")).alias("text")).alias("question"),
        F.struct(priority.alias("explicit_pages"), F.array(page).alias("retrieval_pages")).alias("candidate_pool"),
        F.struct(F.array(page).alias("pages_to_compile"), priority.alias("priority_pages"), reason.alias("reason")).alias("compilation_plan"),
    )


def page_preflight(plan: DataFrame, prepared_pages: DataFrame, target: str) -> DataFrame:
    """(query, doc_id, target page, blocking, passed): whether one asked page of each record can be compiled.

    ``plan``: (query, doc_id, ``target``, invalid: whether the page lies beyond the document); pages as from :func:`prepared`.
    """
    p = prepared_pages.select("doc_id", F.col("page_index").alias(target), "has_page_image", "error", F.lit(True).alias("_there"))
    j = plan.join(p, ["doc_id", target], "left")
    missing = ~F.col("invalid") & F.col("_there").isNull()
    blocking = F.array_compact(
        F.array(
            F.when(F.col("invalid"), "explicit_page_out_of_range"),
            F.when(missing, "target_page_not_prepared"),
            F.when(~F.col("invalid") & F.col("_there") & F.col("error").isNotNull(), "missing_source_anchors"),
            F.when(~F.col("invalid") & F.col("_there") & ~F.col("has_page_image"), "missing_full_page_image_anchor"),
        )
    )
    return j.select("query", "doc_id", target, F.array_sort(blocking).alias("blocking"), (F.size(blocking) == 0).alias("passed"))


def find_record(records: DataFrame, order: str, record: str | None = None, doc_id: str | None = None, question: str | None = None) -> DataFrame:
    """The record of an id, else the first of a document whose question holds a string; the job fails where there is none."""
    tests = [F.col("record_id") == record] if record else []
    rest = [F.lit(True)] + ([F.col("doc_id") == doc_id] if doc_id else []) + ([F.lower("question").contains(question.lower())] if question else [])
    by_other = reduce(lambda a, b: a & b, rest)
    place = F.when(tests[0], 0).when(by_other, 1) if tests else F.when(by_other, 0)
    found = records.withColumn("_p", place).filter("_p IS NOT NULL").agg(F.min_by(F.struct(*records.columns), F.struct("_p", order)).alias("r"))
    return found.select(F.when(F.col("r").isNull(), F.raise_error(F.lit("no matching record"))).otherwise(F.col("r")).alias("r")).select("r.*")


def expanded_scope(rows: DataFrame, discovered: DataFrame) -> DataFrame:
    """(doc_id, page_indices, selection_source): the pages that rows list for a document, sorted and distinct, or else all discovered
    ones; the first source given. ``rows``: (doc_id, page_indices, selection_source, input_order); ``discovered``: (doc_id, page_index)."""
    r = rows.filter("doc_id <> ''")
    listed = r.groupBy("doc_id").agg(
        F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_list(F.coalesce("page_indices", F.array().cast("array<int>"))))), lambda p: p >= 0)).alias("_listed"),
        F.min_by("selection_source", F.when(F.col("selection_source") != "", F.col("input_order"))).alias("_source"),
    )
    every = discovered.groupBy("doc_id").agg(F.array_sort(F.collect_set("page_index")).alias("_all"))
    j = listed.join(every, "doc_id", "left")
    pages = F.when(F.size("_listed") > 0, F.col("_listed")).otherwise(F.coalesce("_all", F.array().cast("array<int>")))
    return j.select("doc_id", pages.alias("page_indices"), F.coalesce("_source", F.lit("coverage_subset")).alias("selection_source"))


def selected_scope(scope: DataFrame, sources: DataFrame, max_docs: int, per_doc: int, max_pages: int) -> DataFrame:
    """Pages of a scope that have a source, at most so many a document, of so many documents, and in all; adds ``position``."""
    p = scope.select("doc_id", "selection_source", F.explode("page_indices").alias("page_index"))
    p = p.join(sources.filter("has_text OR has_image").select("doc_id", "page_index"), ["doc_id", "page_index"], "left_semi")
    p = p.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index"))).filter(F.col("_n") <= per_doc).drop("_n")
    docs = p.select("doc_id").distinct().orderBy("doc_id").limit(max_docs)
    p = p.join(F.broadcast(docs), "doc_id", "left_semi").orderBy("doc_id", "page_index").limit(max_pages)  # at most max_docs rows
    return p.withColumn("position", F.row_number().over(Window.orderBy("doc_id", "page_index")))


def write_back(selected: DataFrame, branches: list[str], k: int, key: str = "query") -> DataFrame:
    """(key, a page list and a score list for each branch): the branch's own selection or, where it has none, the common one.

    ``selected``: (key, branch or null for the common list, position, page_index, score); missing scores are reciprocal ranks.
    """
    s = selected.filter(F.col("position") <= k)
    score = F.round(F.coalesce("score", 1.0 / F.col("position")), 8)
    lists = s.groupBy(key, "branch").agg(F.array_sort(F.collect_list(F.struct("position", "page_index", score.alias("score")))).alias("l"))
    lists = lists.withColumn("branch", F.coalesce("branch", F.lit("*")))
    wide = lists.groupBy(key).pivot("branch", [*branches, "*"]).agg(F.first("l"))
    own = {b: F.coalesce(F.col(f"`{b}`"), F.col("`*`")) for b in branches}
    cols = [c for b, l in own.items() for c in (F.transform(l, lambda x: x["page_index"]).alias(b), F.transform(l, lambda x: x["score"]).alias(f"{b}_score"))]
    return wide.select(key, *cols)
