"""Evidence artifacts: a deterministic compiler, locator rules, quality labels, validation, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import compact, page_id, present

#: Artifact types with their modality.
TYPES = {
    "text_span": "text",
    "numeric_fact": "numeric",
    "table": "table",
    "table_cell": "table",
    "figure": "image",
    "caption": "text",
    "visual_region": "image",
    "visual_observation": "image",
    "section_header": "layout",
}
#: Fixed values, as all to the patterns below.
ANCHOR_TYPES = ["text_block", "layout_block", "full_page_image", "table_cell", "figure_region"]
STATUSES = ["candidate", "schema_valid", "anchored", "discarded"]
KIND_PRIORITY = ["table_cell", "figure_region", "caption_block", "section_block", "text_offset", "bbox", "source_block"]
STRONG_KINDS = ["bbox", "table_cell", "figure_region", "caption_block", "text_offset", "source_block"]
RERANK_TYPES = ["numeric_fact", "table", "table_cell", "figure", "caption"]
#: Fixed values.
PLACEHOLDERS = ["mock ", "mocked ", "placeholder ", "generic ", "candidate anchored to", "anchored to the full page image"]
WEAK_STATUSES = ["weak", "invalid", "missing", "unresolved", "failed", "low_confidence"]
#: Fixed values.
NUMERIC = r"(?i)[-+]?\$?\d[\d,]*(\.\d+)?\s*(%|percent|percentage|bps|bp|million|billion|thousand|m|bn)?"
TITLE = r"(?i)\b(table|summary|overview|caption|title|figure|chart|appendix|contents)\b"
BROAD = r"(?i)\b(table|summary|overview|contains|lists|shows|presents|describes|reports|includes|data|values|metrics|indicators)\b"


def compile_blocks(blocks: DataFrame) -> DataFrame:
    """Artifacts of each block (number, doc_id, page_index, block_no, char_start, char_end, block_text): one, or two that share its anchor.

    Type, anchor and layout fields follow from the page's running number, the block number and the artifact's number, each by a
    remainder of its own, so that each rule downstream meets each case: a stand-in for a model-backed compiler with the same columns.
    """
    page, no, copy = F.col("number"), F.col("block_no"), F.col("copy")
    mod = lambda c, n, *ok: F.pmod(c, F.lit(n)).isin(*ok)
    out = blocks.withColumn("copy", F.explode(F.when(mod(page + no, 6, 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.pmod(page * 7 + no * 3 + copy * 5, F.lit(9)) + 1).cast("int"))
    out = out.withColumn("artifact_type", kind)
    t = F.col("artifact_type")
    modality = F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), t)
    anchor = F.pmod(page + no, F.lit(4))
    text = lambda c: c.cast("string")
    normalized = {
        "value_text": F.when(t.isin("numeric_fact", "table_cell", "table") & ~mod(page, 4, 2), F.when(mod(page, 4, 1), F.concat(F.lit("AR0"), text(F.pmod(F.floor(page / 4), F.lit(5))))).otherwise(text(page))),
        "row_label": F.when(~mod(page, 3, 2), F.when(mod(page, 2, 0), "net income").otherwise("metric")),
        "column_label": F.when(~mod(page, 5, 3), F.when(mod(page, 4, 1), "total assets").otherwise("period")),
    }
    return out.select(
        "number",
        "doc_id",
        "page_index",
        "block_no",
        F.concat(F.format_string("a%06d_%03d", page, no), F.when(copy == 1, "_2").otherwise("")).alias("artifact_id"),
        page_id(F.col("doc_id"), F.col("page_index")).alias("page_id"),
        "artifact_type",
        modality.alias("modality"),
        F.concat(F.when(mod(page, 11, 0), F.lit("mock ")).otherwise(F.lit("")), F.col("block_text")).alias("content"),
        F.format_string("p%d_text_%03d", page, no).alias("source_id"),
        F.when(anchor == 0, "full_page_image").when(anchor == 3, "table_cell").otherwise("text_block").alias("anchor_type"),
        mod(page, 5, 0).alias("has_bbox"),
        "char_start",
        "char_end",
        F.when(t.isin("table", "table_cell") & ~mod(page, 5, 1), F.concat(F.lit("t"), text(no))).alias("table_id"),
        F.when((t == "table_cell") & ~mod(page, 4, 1), text(F.pmod(page, F.lit(7)))).alias("row_index"),
        F.when((t == "table_cell") & ~mod(page, 7, 2), text(F.pmod(page, F.lit(3)))).alias("column_index"),
        F.when(t.isin("figure", "visual_region", "caption") & mod(page, 2, 0), F.concat(F.lit("f"), text(no))).alias("figure_id"),
        F.when((t == "caption") & ~mod(page, 7, 1), F.concat(F.lit("c"), text(no))).alias("caption_id"),
        F.when((t == "section_header") & ~mod(page, 4, 3), F.concat(F.lit("s"), text(no))).alias("section_id"),
        (F.pmod(page * 13 + no, F.lit(10)) / 10.0).alias("confidence"),
        *[v.alias(k) for k, v in normalized.items()],
        F.when(mod(page, 2, 0), "anchored").otherwise("schema_valid").alias("status"),
    )


#: Types that a page's image, and its first text block, stand for, in order.
IMAGE_TEMPLATES = ["visual_observation", "visual_region", "figure"]
TEXT_TEMPLATES = ["text_span", "section_header", "caption", "numeric_fact", "table", "table_cell"]


def page_templates(pages: DataFrame) -> DataFrame:
    """Up to nine fixed artifacts a page: three for its image, six for its first text block. ``pages``: (doc_id, page_index, has_image, first_block)."""
    one = lambda t, anchor, ok: F.when(ok, F.struct(F.lit(t).alias("artifact_type"), F.lit(anchor).alias("anchor_type")))
    made = [one(t, "full_page_image", F.col("has_image")) for t in IMAGE_TEMPLATES] + [one(t, "text_block", F.col("first_block").isNotNull()) for t in TEXT_TEMPLATES]
    rows = pages.select("doc_id", "page_index", "first_block", F.posexplode(F.array_compact(F.array(*made))).alias("at", "t"))
    modality = F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.col("t.artifact_type"))
    source = F.when(F.col("t.anchor_type") == "full_page_image", F.format_string("p%d_full_page", "page_index")).otherwise(F.format_string("p%d_text_000", "page_index"))
    content = F.concat(F.lit("mock "), F.replace("t.artifact_type", F.lit("_"), F.lit(" ")), F.lit(" candidate anchored to "), source)
    return rows.select("doc_id", "page_index", F.format_string("artifact_%04d", F.col("at") + 1).alias("artifact_id"), "t.artifact_type", modality.alias("modality"), "t.anchor_type", source.alias("source_id"), content.alias("content"))


def compiled(artifacts: DataFrame, blocks: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """A page's artifacts after all stages: copies removed, each classified, with its issues, and anchored where there are none.

    A deterministic compiler gives the same on every attempt, so nothing is tried again: pages with issues keep them.
    """
    once = first_of_equal(artifacts, key, order).filter("copy_no = 1").drop("copy_no")
    found = validation_issues(once, blocks).groupBy("artifact_id").agg(F.array_sort(F.collect_list("issue")).alias("issues"))
    out = classify_locators(once).join(found, "artifact_id", "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))
    return out.withColumn("status", F.when(F.size("issues") == 0, "anchored").otherwise("discarded"))


def locator_kinds() -> Column:
    """Kinds of the locators that an artifact's anchor and layout fields make."""
    t, full = F.col("artifact_type"), F.col("anchor_type") == "full_page_image"
    cell = F.col("table_id").isNotNull() & F.col("row_index").isNotNull() & F.col("column_index").isNotNull()
    region = t.isin("figure", "visual_region") & F.col("figure_id").isNotNull() & F.col("has_bbox")
    return F.array_compact(
        F.array(
            F.when(full, "full_page_anchor").otherwise("source_block"),
            F.when(F.col("has_bbox"), "bbox"),
            F.when(~full, "text_offset"),
            F.when(cell, "table_cell"),
            F.when(region, "figure_region"),
            F.when((t == "caption") & F.col("caption_id").isNotNull(), "caption_block"),
            F.when((t == "section_header") & F.col("section_id").isNotNull(), "section_block"),
        )
    )


def classify_locators(artifacts: DataFrame) -> DataFrame:
    """Adds kinds, source_anchored, element_locatable, proof_trace_eligible and locator_kind."""
    out = artifacts.withColumn("kinds", locator_kinds())
    has = lambda k: F.array_contains("kinds", k)
    t = F.col("artifact_type")
    text, cell, box, block, region = has("text_offset"), has("table_cell"), has("bbox"), has("source_block"), has("figure_region")
    locatable = (
        F.when(t == "text_span", text)
        .when(t == "numeric_fact", text | cell)
        .when(t == "table_cell", cell)
        .when(t == "table", F.col("table_id").isNotNull() & (box | block))
        .when(t == "figure", region | (F.col("figure_id").isNotNull() & (box | block)))
        .when(t == "caption", has("caption_block") | box | block)
        .when(t == "visual_region", region | box)
        .when(t == "visual_observation", box | block | region)
        .when(t == "section_header", has("section_block") | text | block)
        .otherwise(box | block | cell)
    )
    full = has("full_page_anchor")
    out = out.withColumn("source_anchored", present(F.col("source_id"))).withColumn("element_locatable", locatable)
    only_full = full & ~(box | block | cell | region)
    strongest = F.coalesce(*[F.when(has(k), k) for k in KIND_PRIORITY])
    return out.withColumns(
        {
            "proof_trace_eligible": F.col("source_anchored") & F.col("element_locatable") & ~only_full,
            "locator_kind": F.coalesce(
                F.when(F.col("element_locatable"), strongest),
                F.when(full, "full_page_anchor"),
                F.when(block, "source_block"),
                F.lit("none"),
            ),
        }
    )


def kind_counts(classified: DataFrame) -> DataFrame:
    return classified.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def eligibility(classified: DataFrame) -> DataFrame:
    """Adds reason (of rejection for re-ranking, else eligible), weak and weight."""
    content = F.lower(compact(F.coalesce("content", F.lit(""))))
    mock = (content == "") | F.concat(*[F.when(content.contains(p), "x").otherwise("") for p in PLACEHOLDERS]).contains("x")
    strong = F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in STRONG_KINDS]))
    full = F.array_contains("kinds", "full_page_anchor") | (F.col("anchor_type") == "full_page_image")
    signal = strong | F.col("has_bbox") | F.col("anchor_type").isin("table_cell", "figure_region")
    reason = (
        F.when(~F.col("artifact_type").isin(RERANK_TYPES), "unstructured_artifact_type")
        .when(mock, "mock_or_placeholder_content")
        .when(~F.col("source_anchored"), "missing_valid_source_anchor")
        .when(full & ~strong, "full_page_only_locator")
        .when(~signal, "missing_strong_locator")
        .when(~F.col("element_locatable") | ~F.col("proof_trace_eligible"), "not_element_locatable_or_proof_trace_ineligible")
        .otherwise("eligible")
    )
    weak = (full & ~strong) | F.lower("status").isin(WEAK_STATUSES) | (F.col("confidence") < 0.5)
    out = classified.withColumn("reason", reason).withColumn("weak", weak)
    return out.withColumn("weight", F.when(F.col("reason") != "eligible", 0.0).when(F.col("weak"), 0.25).otherwise(1.0))


def quality_labels(classified: DataFrame) -> DataFrame:
    """Adds labels (array, in fixed order) and discard_reason (null where kept)."""
    t, content = F.col("artifact_type"), compact(F.coalesce("content", F.lit("")))
    value, row, column = (F.coalesce(c, F.lit("")) for c in ("value_text", "row_label", "column_label"))
    numeric = (value != "") | content.rlike(NUMERIC)
    strong = F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in STRONG_KINDS])) | F.col("has_bbox") | (F.col("anchor_type") == "table_cell")
    full_only = F.array_contains("kinds", "full_page_anchor") & ~F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in STRONG_KINDS]))
    weak = full_only | ~strong
    words = F.size(F.split(content, " "))
    said = F.concat_ws(" ", content, value, row, column)
    title = t.isin("table", "caption") & ~numeric & ((words <= 8) | ((words <= 14) & said.rlike(TITLE)))
    context = (row != "") | (column != "")
    cell_fields = (value != "") & (row != "") & (column != "")
    broad = (t == "table") & ~cell_fields & (title | (~numeric & said.rlike(BROAD)) | (numeric & ~context))
    fact_open = (t == "numeric_fact") & ~(cell_fields & numeric)
    placed = F.col("row_index").isNotNull() & F.col("column_index").isNotNull()
    cell_open = (t == "table_cell") & ~(cell_fields & placed & numeric)
    atomic = ((t == "table_cell") & ~cell_open) | ((t == "numeric_fact") & ~fact_open)
    labels = F.array_compact(
        F.array(
            F.when(atomic & strong, "atomic_numeric_ok"),
            F.when(broad, "broad_table_only"),
            F.when(fact_open | (cell_open & numeric), "missing_numeric_fact"),
            F.when(weak, "weak_locator"),
            F.when(title, "caption_or_table_title_only"),
            F.when(broad | fact_open | cell_open | title | weak, "schema_valid_but_semantically_weak"),
        )
    )
    discard = F.when(broad, "broad_table_only_semantically_weak").when(fact_open, "numeric_fact_missing_value_metric_context")
    return classified.withColumn("labels", labels).withColumn("discard_reason", discard)


def first_of_equal(rows: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """Adds copy_no: 1 for the first row of each key, which is kept."""
    hashed = F.sha2(F.concat_ws("\u0001", *[F.coalesce(k.cast("string"), F.lit("\u0002")) for k in key]), 256)
    return rows.withColumn("copy_no", F.row_number().over(Window.partitionBy(hashed).orderBy(*order)))


def validation_issues(artifacts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(artifact_id, issue): unknown types, statuses and anchors, missing ids and content, sources that aren't blocks."""
    known = blocks.select("doc_id", "page_index", F.col("source_id").alias("_block")).distinct()
    a = artifacts
    j = a.join(known, (a["doc_id"] == known["doc_id"]) & (a["page_index"] == known["page_index"]) & (a["source_id"] == known["_block"]), "left")
    issue = F.array_compact(
        F.array(
            F.when(~present(a["artifact_id"]), "missing_artifact_id"),
            F.when(a["page_index"].isNull() | (a["page_index"] < 0), "invalid_page_index"),
            F.when(~a["artifact_type"].isin(list(TYPES)), "unknown_artifact_type"),
            F.when(~a["status"].isin(STATUSES), "unknown_status"),
            F.when(~present(F.trim(a["content"])), "empty_content"),
            F.when(~a["anchor_type"].isin(ANCHOR_TYPES), "unknown_anchor_type"),
            F.when(F.col("_block").isNull(), "anchor_source_not_in_layout"),
        )
    )
    return j.select(a["artifact_id"], F.explode(issue).alias("issue"))


def drop_shared_ids(rows: DataFrame, key: list[Column], order: list[Column], id_col: str = "artifact_id") -> DataFrame:
    """Drops every row whose id is that of a later copy: an id shared by copies removes the first one too."""
    late = first_of_equal(rows, key, order).filter("copy_no > 1").select(id_col).distinct()
    return rows.join(late, id_col, "left_anti")
