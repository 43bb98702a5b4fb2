"""Checks and comparisons of runs: indexes, scope statistics, failure rates, deltas, attributions, gates, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.tables import numbered
from folioflow.sources.sinks import work_folder

#: Issues that deduplication doesn't mend.
BLOCKING_ISSUES = ["source_anchor_not_found", "provenance_source_not_found", "forbidden_field", "missing_required_field"]


def artifact_index(artifacts: DataFrame, by: str) -> DataFrame:
    """(key, artifact_ids): sorted ids of each value of ``by``; a key's list is as long as its artifacts, so index by page or within a document."""
    return artifacts.groupBy("doc_id", F.col(by).cast("string").alias("key")).agg(F.array_sort(F.collect_list("artifact_id")).alias("artifact_ids"))


def scope_stats(ranked: DataFrame, docs: DataFrame, top_k: int, max_docs: int, n_selected: Column) -> DataFrame:
    """One row: distinct pages that the first ``top_k`` ranks of the first ``max_docs`` documents show, those that a cap drops, the gain
    over four ranks. ``ranked``: (doc_id, rank from 0, page_index); ``docs``: (doc_id, input_order)."""
    first = docs.groupBy("doc_id").agg(F.min("input_order").alias("_o")).orderBy("_o", "doc_id").limit(max_docs).select("doc_id")
    page = F.struct("doc_id", "page_index")
    inside = ranked.join(F.broadcast(first), "doc_id", "left_semi")  # at most max_docs rows
    seen = inside.agg(F.count_distinct(F.when(F.col("rank") < top_k, page)).alias("pages_seen"), F.count_distinct(F.when(F.col("rank") < 4, page)).alias("_four"))
    known = docs.agg(F.count_distinct("doc_id").alias("docs_seen"))
    j = seen.crossJoin(F.broadcast(known))  # one row
    drop = lambda a, b: F.greatest(F.lit(0), a - b)
    return j.select("pages_seen", n_selected.alias("pages_selected"), drop(F.col("pages_seen"), n_selected).alias("dropped_pages"), drop(F.col("docs_seen"), F.lit(max_docs)).alias("dropped_docs"), drop(F.col("pages_seen"), F.col("_four")).alias("gain_over_four"))


def failure_rates(answers: DataFrame, run: str, answer: str) -> DataFrame:
    """(run, total, failed, failure_rate) of each run."""
    g = answers.groupBy(run).agg(F.count("*").alias("total"), F.count_if(F.col(answer).isNull()).alias("failed"))
    return g.withColumn("failure_rate", F.round(F.col("failed") / F.col("total"), 6))


#: Metrics that two audits are compared by, and bounds of a refined one.
DELTAS = ["visual_coverage", "table_coverage", "n_numeric", "valid_rate", "discard_rate"]


def audit_summary(classified: DataFrame, kept: Column) -> DataFrame:
    """One row: shares of pages with visual, and with table or figure, artifacts; numeric facts; valid, anchored and discarded shares."""
    pages = classified.groupBy("doc_id", "page_index").agg(F.max(F.col("modality") == "image").alias("_v"), F.max(F.col("artifact_type").isin("table", "table_cell", "figure")).alias("_t"))
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    p = pages.agg(share("_v").alias("visual_coverage"), share("_t").alias("table_coverage"))
    rate = lambda ok: F.round(F.count_if(ok) / F.greatest(F.count("*"), F.lit(1)), 6)
    a = classified.agg(F.count_if(F.col("artifact_type") == "numeric_fact").alias("n_numeric"), rate(kept).alias("valid_rate"), rate(F.col("source_anchored")).alias("anchoring_rate"), rate(~kept).alias("discard_rate"))
    return p.crossJoin(F.broadcast(a))  # one row


def audit_deltas(baseline: DataFrame, refined: DataFrame) -> DataFrame:
    """One row: refined less baseline of each metric, reasons against acceptance, accepted. Both tables have one row."""
    b = baseline.select(*[F.col(c).alias(f"_{c}") for c in DELTAS])
    j = refined.crossJoin(F.broadcast(b))
    delta = {c: F.round(F.col(c) - F.col(f"_{c}"), 6) for c in DELTAS}
    against = F.array_compact(
        F.array(
            F.when(F.col("valid_rate") < 0.9, "schema_valid_rate_below_threshold"),
            F.when(F.col("anchoring_rate") < 0.9, "anchoring_rate_below_threshold"),
            F.when(F.col("discard_rate") > 0.2, "discard_rate_above_threshold"),
            F.when((delta["visual_coverage"] <= 0) & (delta["table_coverage"] <= 0) & (delta["n_numeric"] <= 0), "prompt_schema_refinement_insufficient"),
        )
    )
    return j.select(*[v.alias(f"delta_{c}") for c, v in delta.items()], against.alias("reasons"), (F.size(against) == 0).alias("accepted"))


def issue_attribution(issues: DataFrame, artifacts: DataFrame, content_key: list[str]) -> DataFrame:
    """One row: issues by kind, pages they touch, copies by id and by content, kinds that block, whether deduplication would mend them all.

    ``issues``: (doc_id, page_index, issue); copies are counted within a page.
    """
    page = F.format_string("%s#p%d", "doc_id", "page_index")
    kinds = issues.groupBy("issue").agg(F.count("*").alias("n"))
    listed = kinds.agg(F.array_sort(F.collect_list(F.struct("issue", "n"))).alias("k"))  # one row, a few kinds
    i = issues.agg(F.count("*").alias("n_issues"), F.count_distinct(page).alias("n_pages"), F.count_if(F.col("issue") == "duplicate_artifact").alias("n_duplicate"))

    def copies(key, name):
        c = artifacts.groupBy("doc_id", "page_index", *key).agg((F.count("*") - 1).alias("c"))
        return c.agg(F.coalesce(F.sum("c"), F.lit(0)).alias(name))

    j = i.crossJoin(F.broadcast(listed)).crossJoin(F.broadcast(copies(["artifact_id"], "id_copies"))).crossJoin(F.broadcast(copies(content_key, "content_copies")))  # one row each
    names = F.transform("k", lambda x: x["issue"])
    blocking = F.array_intersect(names, F.array(*map(F.lit, sorted(BLOCKING_ISSUES))))
    mends = (F.col("n_duplicate") > 0) & (F.size(blocking) == 0) & (F.col("n_duplicate") == F.col("n_issues")) & ((F.col("id_copies") > 0) | (F.col("content_copies") > 0))
    return j.select("n_issues", F.transform("k", lambda x: F.concat_ws(":", x["issue"], x["n"].cast("string"))).alias("kinds"), "n_pages", "n_duplicate", "id_copies", "content_copies", blocking.alias("blocking"), mends.alias("deduplication_applicable"))


def atomic_coverage(candidates: DataFrame, cells: DataFrame, excluded: DataFrame | None = None, least: int = 2, most: int | None = None) -> DataFrame:
    """(doc_id, page_index, n_pairs, retrieval_score, target_records, score, position): pages that atomic cells would cover, best first; with ``most`` so many.

    ``candidates``: (record, doc_id, page_index, score), pages that records retrieved; ``cells``: (doc_id, page_index, n_cells, n_facts).
    A page's pairs count ten each, retrieval adds up, and further records count two each.
    """
    c = candidates.groupBy("doc_id", "page_index").agg(F.sum("score").alias("retrieval_score"), F.array_sort(F.collect_set("record")).alias("target_records"))
    j = c.join(cells.withColumn("n_pairs", F.least("n_cells", "n_facts")).filter(F.col("n_pairs") >= least), ["doc_id", "page_index"])
    if excluded is not None:
        j = j.join(excluded, ["doc_id", "page_index"], "left_anti")
    n = F.size("target_records")
    score = F.round(10.0 * F.col("n_pairs") + F.round("retrieval_score", 6) + F.when(n > 1, 2.0 * n).otherwise(0.0), 6)
    j = j.select("doc_id", "page_index", "n_pairs", F.round("retrieval_score", 6).alias("retrieval_score"), "target_records", score.alias("score"))
    order = [F.desc(F.size("target_records")), F.desc("score"), F.asc("doc_id"), F.asc("page_index")]
    placed, _ = numbered(j if most is None else j.orderBy(*order).limit(most), order, work_folder(j.sparkSession, "coverage"), "position")
    return placed.withColumn("position", (F.col("position") + 1).cast("int"))


def activation(candidates: DataFrame, eligible: DataFrame, top_k: int) -> DataFrame:
    """(query, matching_pages, activated): a query's first pages on which an eligible artifact lies. ``candidates``: (query, doc_id, page_index, rank from 0)."""
    top = candidates.filter(F.col("rank") < top_k)
    hit = top.join(eligible.select("doc_id", "page_index").distinct().withColumn("_hit", F.lit(True)), ["doc_id", "page_index"], "left")
    g = hit.groupBy("query").agg(F.array_sort(F.collect_set(F.when(F.col("_hit"), F.col("page_index")))).alias("matching_pages"))
    return g.withColumn("activated", F.size("matching_pages") > 0)


def smoke_report(answers: DataFrame) -> DataFrame:
    """One row over (query, n_candidates, n_retrieved, n_foreign, answer): coverage, means, hit and answer rates, foreign artifacts seen."""
    n = F.greatest(F.count("*"), F.lit(1))
    rate = lambda ok: F.round(F.count_if(ok) / n, 6)
    return answers.agg(
        F.count("*").alias("n_records"), rate(F.col("n_candidates") > 0).alias("coverage_rate"), F.round(F.sum("n_candidates") / n, 6).alias("mean_candidates"), F.round(F.sum("n_retrieved") / n, 6).alias("mean_retrieved"),
        rate(F.col("n_retrieved") > 0).alias("hit_rate"), rate(F.col("answer").isNotNull()).alias("answer_rate"), F.sum("n_foreign").alias("n_rejected_by_scope"),
    )


def page_references(artifacts: DataFrame, discarded: DataFrame) -> DataFrame:
    """Distinct (doc_id, page_index) that a run wrote artifacts for or discarded them on."""
    key = ["doc_id", "page_index"]
    return artifacts.select(*key).union(discarded.select(*key)).distinct()


def manifest_check(manifest: DataFrame, actual: DataFrame, strict: bool = False) -> DataFrame:
    """(stage, field, verdict): each hash that should be there against what was computed anew. A hash that is missing on either side is a
    warning, or with ``strict`` a mismatch; the file's plain hash is accepted with a warning.

    ``manifest``: (stage, field, expected); ``actual``: (stage, field, hash, file_hash).
    """
    j = actual.join(manifest, ["stage", "field"], "left")
    absent = "mismatch:" if strict else "warning:"
    verdict = (
        F.when(F.col("expected").isNull(), f"{absent}missing_hash_field")
        .when(F.col("hash").isNull(), f"{absent}missing_hashed_file")
        .when(F.col("expected") == F.col("hash"), "checked")
        .when(F.col("expected") == F.col("file_hash"), "warning:plain_file_hash_accepted")
        .otherwise("mismatch:different")
    )
    return j.select("stage", "field", verdict.alias("verdict"))


def role_violations(outputs: DataFrame, judge: str) -> DataFrame:
    """(path, reason): outputs of the main flow that name the judge's model or say that it was used; evaluations that lack their flags; the
    vision model as a judge. ``outputs``: (path, stage, model_id, model_role, evaluator_used, evaluation_only, not_consumed)."""
    main, is_judge, used = F.col("stage") != "evaluation", F.col("model_id") == judge, F.coalesce("evaluator_used", F.lit(False))
    flags = F.coalesce("evaluation_only", F.lit(False)) & F.coalesce("not_consumed", F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(main & is_judge, "judge_model_in_main_flow"),
            F.when(main & used, "evaluator_used_in_main_flow"),
            F.when(~main & (is_judge | used) & ~flags, "evaluation_lacks_its_flags"),
            F.when(~main & ~is_judge & (F.col("model_role") == "evaluation_judge"), "other_model_as_judge"),
        )
    )
    return outputs.select("path", F.explode(reasons).alias("reason"))


def registry_failures(skills: DataFrame, unit_types: list[str], required: list[str]) -> DataFrame:
    """(failure): names that are empty or repeated, fields that are missing, unit types beyond the registry's, of a table of skills."""
    name = F.coalesce("name", F.lit(""))
    again = skills.groupBy("name").count().filter("count > 1").select(F.lit("duplicate_skill_names").alias("failure"))
    empty = lambda c: F.col(c).isNull() | (F.size(c) == 0 if dict(skills.dtypes)[c].startswith("array") else F.col(c) == "")
    tests = [F.when(name == "", F.lit("skill_missing_name")), *[F.when(empty(c), F.concat(F.lit(f"skill_missing_{c}:"), name)) for c in required]]
    foreign = F.transform(F.array_except("accepted_types", F.array(*map(F.lit, unit_types))), lambda t: F.concat(F.lit("skill_unknown_unit_type:"), name, F.lit(":"), t))
    own = skills.select(F.explode(F.concat(F.array_compact(F.array(*tests)), F.coalesce(foreign, F.array().cast("array<string>")))).alias("failure"))
    return own.unionByName(again).distinct()


def call_id(doc_id: Column, page: Column, mode: Column, prompt: Column) -> Column:
    """The first 24 digits of the hash of a call's canonical description; the prompt enters by its hash."""
    text = F.concat(F.lit('{"doc_id":"'), doc_id, F.lit('","page_index":'), page.cast("string"), F.lit(',"prompt_hash":"'), F.sha2(prompt, 256), F.lit('","provider_mode":"'), mode, F.lit('"}'))
    return F.left(F.sha2(text, 256), F.lit(24))


def call_audit(calls: DataFrame, required: list[str]) -> DataFrame:
    """(call_id, failures): calls without required fields, an image payload without its hash or a hash without payload, success with an error."""
    missing = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing_field:{c}")) for c in required]
    sent, known = F.col("image_payload") == "sent", F.col("image_hash").isNotNull()
    more = [F.when(sent & ~known, F.lit("payload_without_hash")), F.when(~sent & known, F.lit("hash_without_payload")), F.when((F.col("status") == "ok") & F.col("error_type").isNotNull(), F.lit("success_with_error"))]
    return calls.select("call_id", F.array_compact(F.array(*missing, *more)).alias("failures")).filter(F.size("failures") > 0)


def run_gate(runs: DataFrame, top_k: int, max_delta: float) -> DataFrame:
    """One row: hard failures and soft warnings of runs that are to be compared, and whether they may be.

    ``runs``: (run, predicted, evaluated, top_k, config_hash, judge, record_slice, score, failure_rate, leaks).
    """
    one = lambda c: F.count_distinct(c) == 1
    hard = {
        "prediction_outputs_missing": ~F.bool_and("predicted"),
        "evaluation_outputs_missing": ~F.bool_and("evaluated"),
        "top_k_inconsistent": ~one("top_k"),
        "page_budget_exceeded": F.max("top_k") != top_k,
        "model_config_inconsistent": ~one("config_hash"),
        "judge_inconsistent": ~one("judge"),
        "record_slice_inconsistent": ~one("record_slice"),
        "public_leakage": F.sum("leaks") > 0,
    }
    soft = {"score_delta_above_bound": F.max("score") - F.min("score") > max_delta, "predictions_failed": F.max("failure_rate") > 0}
    named = lambda tests: F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in tests.items()]))
    out = runs.agg(F.count("*").alias("n_runs"), named(hard).alias("hard_failures"), named(soft).alias("soft_warnings"), F.round(F.max("score") - F.min("score"), 6).alias("score_delta"))
    return out.withColumn("passed", F.size("hard_failures") == 0)


def within_error_budget(rows: DataFrame, failed: Column, share: float = 0.01) -> DataFrame:
    """``rows`` that did not fail; the job fails if more than so large a share of them did."""
    n = rows.agg(F.count_if(failed).alias("_e"), F.count("*").alias("_n"))
    stop = F.when(F.col("_e") > F.col("_n") * share, F.raise_error(F.concat(F.lit("too many errors: "), F.col("_e").cast("string")))).otherwise(F.lit(True))
    return rows.crossJoin(F.broadcast(n.select(stop.alias("_ok")))).filter("_ok").drop("_ok").filter(~failed)  # one row
