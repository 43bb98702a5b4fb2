"""Locators of artifacts: anchors joined to blocks, distinct locators, notes on what is missing, source references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import page_id

#: Fixed values.
KINDS = ["full_page_anchor", "source_block", "bbox", "text_offset", "table_cell", "figure_region", "caption_block", "section_block"]


def with_defaults(raw: DataFrame) -> DataFrame:
    """Artifacts under one schema: page_id, status and validation_status each from the other, empty locators, flags false."""
    there = lambda *names: [F.col(n) for n in names if n in raw.columns]
    status = F.coalesce(*there("status", "validation_status"), F.lit("candidate"))
    out = raw.withColumns(
        {
            "page_id": F.coalesce(*there("page_id"), page_id(F.col("doc_id"), F.col("page_index"))),
            "validation_status": F.coalesce(*there("validation_status", "status"), F.lit("candidate")),
            "status": status,
            **{c: F.coalesce(*there(c), F.lit(False)) for c in ("source_anchored", "element_locatable", "proof_trace_eligible")},
        }
    )
    return out.withColumn("locators", F.coalesce("locators", F.array().cast(raw.schema["locators"].dataType)) if "locators" in raw.columns else F.array().cast("array<string>"))


def enriched_anchors(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Anchors with the page and the box of their block; an anchor's own box stays, one without a block takes the artifact's page.

    ``anchors``: (artifact_id, doc_id, page_index, source_id, bbox); ``blocks``: (doc_id, page_index, source_id, block_page, bbox, char_start, char_end).
    """
    b = blocks.select("doc_id", "page_index", "source_id", F.col("block_page").alias("_page"), F.col("bbox").alias("_bbox"), "char_start", "char_end")
    j = anchors.join(b, ["doc_id", "page_index", "source_id"], "left")
    return j.select("artifact_id", "doc_id", "source_id", F.coalesce("_page", "page_index").alias("page_index"), F.coalesce("bbox", "_bbox").alias("bbox"), "char_start", "char_end", F.col("_page").isNotNull().alias("resolved"))


def distinct_locators(locators: Column) -> Column:
    """Locators (maps with ``locator_kind``) of known kinds, empty fields dropped, each once by its JSON with sorted keys, the first first."""
    known = F.filter(locators, lambda m: F.coalesce(m["locator_kind"], F.lit("")).isin(KINDS))
    filled = F.transform(known, lambda m: F.map_filter(m, lambda _, v: v.isNotNull() & (v != "")))
    return F.array_distinct(F.transform(filled, lambda m: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))))


def note() -> Column:
    """Why an artifact can't be located; null for one that can."""
    return F.when(F.col("element_locatable"), F.lit(None)).when(~F.col("source_anchored"), "missing_source_locator").when(~F.col("has_bbox"), "missing_bbox_locator").otherwise("missing_element_locator")


def parsed_reference(ref: Column) -> Column:
    """(doc_id, page_index, block_id) of ``doc#p3#block``, ``doc#p3`` or a bare block id."""
    pattern = r"^([^#]+)#p(\d+)(?:#(.+))?$"
    whole = ref.rlike(pattern)
    part = lambda i: F.when(whole, F.nullif(F.regexp_extract(ref, pattern, i), F.lit("")))
    return F.struct(part(1).alias("doc_id"), part(2).cast("int").alias("page_index"), F.when(whole, part(3)).otherwise(ref).alias("block_id"))


def resolved(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """``refs`` (doc_id, page_index, ref) with ``resolves``: its document and page are those given, and its block, if it names one, is on
    the page; on a page without a known source every block passes. ``sources``: (doc_id, page_index, layout_block_ids)."""
    r = refs.withColumn("_r", parsed_reference(F.col("ref")))
    j = r.join(sources.select("doc_id", "page_index", "layout_block_ids"), ["doc_id", "page_index"], "left")
    here = (F.coalesce("_r.doc_id", "doc_id") == F.col("doc_id")) & (F.coalesce("_r.page_index", "page_index") == F.col("page_index"))
    block = F.col("layout_block_ids").isNull() | F.col("_r.block_id").isNull() | F.array_contains("layout_block_ids", F.col("_r.block_id"))
    return j.select(*refs.columns, (here & F.coalesce(block, F.lit(True))).alias("resolves"))


def page_infos(store: DataFrame, quality: DataFrame, sources: DataFrame) -> DataFrame:
    """One row a page of stored artifacts or quality rows: counts and kinds of its artifacts, its selection reason, whether an image went in.

    ``store``: (doc_id, page_index, artifact_type, modality); ``quality``: (doc_id, page_index, selection_reason, page_image_path);
    ``sources``: (doc_id, page_index, has_image), which add to known pages only.
    """
    key = ["doc_id", "page_index"]
    kinds = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    a = store.groupBy(*key).agg(F.count("*").alias("n_artifacts"), kinds("artifact_type").alias("artifact_types"), kinds("modality").alias("modalities"), F.min(F.col("artifact_type") == "text_span").alias("_text_only"))
    q = quality.groupBy(*key).agg(F.max("selection_reason").alias("selection_reason"), F.max(F.coalesce(F.col("page_image_path") != "", F.lit(False))).alias("_image"))
    j = a.join(q, key, "full_outer").join(sources.select(*key, F.col("has_image").alias("_source")), key, "left")
    no = F.lit(False)
    return j.select(
        *key,
        F.format_string("%s#p%d", "doc_id", "page_index").alias("page_ref"),
        F.coalesce("n_artifacts", F.lit(0)).alias("n_artifacts"),
        F.coalesce("artifact_types", F.lit("")).alias("artifact_types"),
        F.coalesce("modalities", F.lit("")).alias("modalities"),
        F.coalesce("selection_reason", F.lit("")).alias("selection_reason"),
        (F.coalesce("_image", no) | F.coalesce("_source", no)).alias("has_image_input"),
        F.coalesce("_text_only", no).alias("only_text_span"),
    )


def resolved_metrics(summary: DataFrame, recomputed: DataFrame, issues: Column) -> DataFrame:
    """(n_raw, n_valid, schema_valid_rate, discard_rate): a summary's value where it has one, else what is recounted, else what follows
    from the number of issues. Both tables have one row: n_raw, n_valid, schema_valid_rate, discard_rate / n_raw, n_valid, n_issues."""
    s = summary.select(*[F.col(c).alias(f"_{c}") for c in ("n_raw", "n_valid", "schema_valid_rate", "discard_rate")])
    j = recomputed.crossJoin(F.broadcast(s))  # one row
    raw = F.coalesce("_n_raw", F.when(F.col("n_raw") > 0, F.col("n_raw")), F.col("n_valid") + issues)
    j = j.withColumns({"r": raw, "v": F.coalesce("_n_valid", "n_valid")})
    valid = F.coalesce("_schema_valid_rate", F.when(F.col("r") > 0, F.col("v") / F.col("r")).otherwise(1.0))
    gone = F.coalesce("_discard_rate", F.when(F.col("r") > 0, F.greatest(F.lit(0.0), (F.col("r") - F.col("v")) / F.col("r"))).when(issues > 0, issues / (F.col("v") + issues)).otherwise(0.0))
    return j.select(F.col("r").alias("n_raw"), F.col("v").alias("n_valid"), F.round(valid, 6).alias("schema_valid_rate"), F.round(gone, 6).alias("discard_rate"))
