"""Queries on indexes, comparisons of runs, gates, manifests, demands and question types."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import artifacts as A
from folioflow.operators import audit as U
from folioflow.operators import checks as C
from folioflow.operators import demand as W
from folioflow.operators import guards as Q
from folioflow.operators import tables as J
from folioflow.plans import bindings as B
from folioflow.plans import documents as D
from folioflow.plans import reports as P

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""WITH {B.ARTIFACTS} SELECT doc_id, 'artifact_type' AS indexed, artifact_type AS key, list(artifact_id ORDER BY artifact_id) AS artifact_ids FROM art GROUP BY ALL
  UNION ALL SELECT doc_id, 'page_index', CAST(page_index AS VARCHAR), list(artifact_id ORDER BY artifact_id) FROM art GROUP BY ALL""")
def artifact_index(spark, sf):
    a = B.artifacts(spark, sf)
    one = lambda by: C.artifact_index(a, by).select("doc_id", F.lit(by).alias("indexed"), "key", "artifact_ids")
    return one("artifact_type").unionByName(one("page_index"))


@query(f"""WITH {B.BRANCHES}, b AS (SELECT 'src' || (query % 20) AS doc_id, rank, page_index FROM br), f AS (SELECT doc_id FROM (SELECT doc_id, min(query) AS o FROM (SELECT 'src' || (query % 20) AS doc_id, query FROM br) GROUP BY 1) ORDER BY o, doc_id LIMIT 8),
i AS (SELECT * FROM b WHERE doc_id IN (SELECT doc_id FROM f)), s AS (SELECT count(DISTINCT (doc_id, page_index)) AS n, count(DISTINCT (doc_id, page_index)) FILTER (rank < 4) AS four FROM i WHERE rank < 8), d AS (SELECT count(DISTINCT doc_id) AS docs FROM b)
SELECT n AS pages_seen, 60 AS pages_selected, greatest(0, n - 60) AS dropped_pages, greatest(0, docs - 8) AS dropped_docs, greatest(0, n - four) AS gain_over_four FROM s, d""")
def scope_statistics(spark, sf):
    b = B.branches(spark, sf)
    doc = F.concat(F.lit("src"), F.pmod("query", F.lit(20)).cast("string"))
    return C.scope_stats(b.select(doc.alias("doc_id"), "rank", "page_index"), b.select(doc.alias("doc_id"), F.col("query").alias("input_order")), 8, 8, F.lit(60))


@query("""SELECT CASE conv_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'artifact' ELSE 'graph' END AS run, count(*) AS total, count(*) FILTER (turn % 4 = 3) AS failed, round(count(*) FILTER (turn % 4 = 3) / count(*), 6) AS failure_rate FROM conversations GROUP BY 1""")
def run_failure_rates(spark, sf):
    c = B.table(spark, sf, "conversations")
    run = F.element_at(F.array(F.lit("base"), F.lit("artifact"), F.lit("graph")), (F.pmod("conv_id", F.lit(3)) + 1).cast("int"))
    return C.failure_rates(c.select(run.alias("run"), F.when(F.pmod("turn", F.lit(4)) != 3, F.col("text")).alias("answer")), "run", "answer")


def _summary_sql(name: str, where: str) -> str:
    return f"""{name}p AS (SELECT bool_or(modality = 'image') AS v, bool_or(artifact_type IN ('table', 'table_cell', 'figure')) AS t FROM l4 WHERE {where} GROUP BY doc_id, page_index),
{name} AS (SELECT * FROM (SELECT round(avg(CAST(v AS INT)), 6) AS visual_coverage, round(avg(CAST(t AS INT)), 6) AS table_coverage FROM {name}p), (SELECT count(*) FILTER (artifact_type = 'numeric_fact') AS n_numeric,
  round(count(*) FILTER (NOT broad AND NOT fopen) / count(*), 6) AS valid_rate, round(count(*) FILTER (source_anchored) / count(*), 6) AS anchoring_rate, round(count(*) FILTER (broad OR fopen) / count(*), 6) AS discard_rate FROM l4 WHERE {where}))"""


@query(f"""WITH {D._LABELS}, {_summary_sql("b", "number % 2 = 0")}, {_summary_sql("r", "true")},
d AS (SELECT {", ".join(f"round(r.{c} - b.{c}, 6) AS delta_{c}" for c in C.DELTAS)}, r.valid_rate, r.anchoring_rate, r.discard_rate FROM r, b),
w AS (SELECT *, list_filter([CASE WHEN valid_rate < 0.9 THEN 'schema_valid_rate_below_threshold' END, CASE WHEN anchoring_rate < 0.9 THEN 'anchoring_rate_below_threshold' END, CASE WHEN discard_rate > 0.2 THEN 'discard_rate_above_threshold' END,
  CASE WHEN delta_visual_coverage <= 0 AND delta_table_coverage <= 0 AND delta_n_numeric <= 0 THEN 'prompt_schema_refinement_insufficient' END], lambda x: x IS NOT NULL) AS reasons FROM d)
SELECT {", ".join(f"delta_{c}" for c in C.DELTAS)}, reasons, len(reasons) = 0 AS accepted FROM w""")
def audit_deltas(spark, sf):
    """Half of the pages against all of them."""
    q = A.quality_labels(B.classified(spark, sf))
    kept = F.col("discard_reason").isNull()
    return C.audit_deltas(C.audit_summary(q.filter("number % 2 = 0"), kept), C.audit_summary(q, kept))


@query(f"""WITH {B.ARTIFACTS}, i AS (SELECT doc_id, page_index, CASE WHEN number % 11 = 0 THEN 'missing_required_field' WHEN has_bbox THEN 'duplicate_artifact' ELSE 'missing_bbox' END AS issue FROM art),
k AS (SELECT list(issue || ':' || n ORDER BY issue) AS kinds, list(issue ORDER BY issue) AS names FROM (SELECT issue, count(*) AS n FROM i GROUP BY issue)), s AS (SELECT count(*) AS n_issues, count(DISTINCT (doc_id, page_index)) AS n_pages, count(*) FILTER (issue = 'duplicate_artifact') AS n_duplicate FROM i),
a AS (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS id_copies FROM (SELECT count(*) AS c FROM art GROUP BY doc_id, page_index, artifact_id)), c AS (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS content_copies FROM (SELECT count(*) AS c FROM art GROUP BY doc_id, page_index, source_id, content))
SELECT n_issues, kinds, n_pages, n_duplicate, id_copies, content_copies, list_filter(names, lambda x: x IN ({", ".join(f"'{x}'" for x in C.BLOCKING_ISSUES)})) AS blocking,
  n_duplicate > 0 AND len(list_filter(names, lambda x: x IN ({", ".join(f"'{x}'" for x in C.BLOCKING_ISSUES)}))) = 0 AND n_duplicate = n_issues AND (id_copies > 0 OR content_copies > 0) AS deduplication_applicable FROM s, k, a, c""")
def issue_attribution(spark, sf):
    a = B.artifacts(spark, sf)
    kind = F.when(F.pmod("number", F.lit(11)) == 0, "missing_required_field").when(F.col("has_bbox"), "duplicate_artifact").otherwise("missing_bbox")
    return C.issue_attribution(a.select("doc_id", "page_index", kind.alias("issue")), a, ["source_id", "content"])


@query(f"""WITH {B.ARTIFACTS}, {B.QUESTIONS}, ce AS (SELECT doc_id, page_index, least(count(*) FILTER (artifact_type IN ('table_cell', 'table')), count(*) FILTER (artifact_type IN ('numeric_fact', 'text_span'))) AS n_pairs FROM art GROUP BY ALL),
ca AS (SELECT query % 7 AS record, 'd' || (query % 10) AS doc_id, page_index, round(1.0 / (page_index + 1), 6) AS score FROM qs, (VALUES (0), (1), (2), (3)) v(page_index)),
g AS (SELECT doc_id, page_index, sum(score) AS s, list_sort(list(DISTINCT record)) AS target_records FROM ca GROUP BY ALL), x AS (SELECT doc_id, page_index FROM art WHERE number % 13 = 1),
j AS (SELECT doc_id, page_index, n_pairs, round(s, 6) AS retrieval_score, target_records, round(10.0 * n_pairs + round(s, 6) + CASE WHEN len(target_records) > 1 THEN 2.0 * len(target_records) ELSE 0.0 END, 6) AS score FROM g JOIN ce USING (doc_id, page_index)
  WHERE n_pairs >= 1 AND (doc_id, page_index) NOT IN (SELECT (doc_id, page_index) FROM x))
SELECT *, CAST(row_number() OVER (ORDER BY len(target_records) DESC, score DESC, doc_id, page_index) AS INT) AS position FROM j""")
def atomic_coverage(spark, sf):
    """Pages by the pairs of cells and facts on them and by the records that retrieved them."""
    a = B.artifacts(spark, sf)
    of = lambda *t: F.count_if(F.col("artifact_type").isin(*t))
    cells = a.groupBy("doc_id", "page_index").agg(of("table_cell", "table").alias("n_cells"), of("numeric_fact", "text_span").alias("n_facts"))
    q, i = B.questions(spark, sf), F.col("query")
    pages = q.select(F.pmod(i, F.lit(7)).alias("record"), F.concat(F.lit("d"), F.pmod(i, F.lit(10)).cast("string")).alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("page_index"))
    pages = pages.withColumn("score", F.round(1.0 / (F.col("page_index") + 1), 6))
    return C.atomic_coverage(pages, cells, a.filter("number % 13 = 1").select("doc_id", "page_index"), least=1)


@query(f"""WITH {B.BRANCHES}, {D._REASON}, t AS (SELECT query, page_index FROM br WHERE branch = 'text' AND rank < 4), e AS (SELECT DISTINCT number FROM elig WHERE reason = 'eligible')
SELECT query, list_sort(coalesce(list(DISTINCT page_index) FILTER (page_index IN (SELECT number FROM e)), [])) AS matching_pages, count(*) FILTER (page_index IN (SELECT number FROM e)) > 0 AS activated FROM t GROUP BY query""")
def activation(spark, sf):
    """Queries whose first four pages hold an eligible artifact."""
    top = B.text_branch(spark, sf).select("query", F.lit("all").alias("doc_id"), "page_index", "rank")
    e = A.eligibility(B.classified(spark, sf)).filter("reason = 'eligible'").select(F.lit("all").alias("doc_id"), F.col("number").alias("page_index"))
    return C.activation(top, e, 4)


@query(f"""WITH {B.ARTIFACTS}, {B.QUESTIONS}, c AS (SELECT query, count(artifact_id) AS n_candidates, count(artifact_id) FILTER (artifact_type = 'caption') AS n_retrieved, count(artifact_id) FILTER (artifact_type = 'figure') AS n_foreign,
  min(content) FILTER (artifact_type = 'caption') AS answer FROM qs LEFT JOIN art USING (doc_id) GROUP BY query)
SELECT count(*) AS n_records, round(count(*) FILTER (n_candidates > 0) / count(*), 6) AS coverage_rate, round(sum(n_candidates) / count(*), 6) AS mean_candidates, round(sum(n_retrieved) / count(*), 6) AS mean_retrieved,
  round(count(*) FILTER (n_retrieved > 0) / count(*), 6) AS hit_rate, round(count(*) FILTER (answer IS NOT NULL) / count(*), 6) AS answer_rate, CAST(sum(n_foreign) AS BIGINT) AS n_rejected_by_scope FROM c""")
def smoke_report(spark, sf):
    a = B.artifacts(spark, sf).select("doc_id", "artifact_id", "artifact_type", "content")
    j = B.questions(spark, sf).select("query", "doc_id").join(a, "doc_id", "left")
    of = lambda t: F.count(F.when(F.col("artifact_type") == t, F.col("artifact_id")))
    return C.smoke_report(j.groupBy("query").agg(F.count("artifact_id").alias("n_candidates"), of("caption").alias("n_retrieved"), of("figure").alias("n_foreign"), F.min(F.when(F.col("artifact_type") == "caption", F.col("content"))).alias("answer")))


@query(f"""WITH {D._LABELS}, p AS (SELECT DISTINCT doc_id, page_index FROM l4) SELECT count(*) AS n_pages, count(DISTINCT doc_id) AS n_docs FROM p""")
def output_reaudit(spark, sf):
    """Pages that a run's artifacts and discards name."""
    q = A.quality_labels(B.classified(spark, sf))
    return C.page_references(q.filter("discard_reason IS NULL"), q.filter("discard_reason IS NOT NULL")).agg(F.count("*").alias("n_pages"), F.count_distinct("doc_id").alias("n_docs"))


@query("""WITH h AS (SELECT source AS stage, lang AS field, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS hash, sha256(source || lang) AS file_hash FROM documents GROUP BY ALL),
m AS (SELECT stage, field, CASE length(stage || field) % 3 WHEN 0 THEN hash WHEN 1 THEN file_hash ELSE 'none' END AS expected FROM h WHERE field <> 'de'),
a AS (SELECT stage, field, CASE WHEN stage <> 'src3' THEN hash END AS hash, file_hash FROM h)
SELECT stage, field, CASE WHEN expected IS NULL THEN 'warning:missing_hash_field' WHEN hash IS NULL THEN 'warning:missing_hashed_file' WHEN expected = hash THEN 'checked' WHEN expected = file_hash THEN 'warning:plain_file_hash_accepted' ELSE 'mismatch:different' END AS verdict
FROM a LEFT JOIN m USING (stage, field)""")
def manifest_check(spark, sf):
    """Hashes of parts of the documents against a manifest with right, plain, wrong and missing ones."""
    d = B.table(spark, sf, "documents")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    h = d.groupBy(F.col("source").alias("stage"), F.col("lang").alias("field")).agg(F.sha2(ids, 256).alias("hash"))
    h = h.withColumn("file_hash", F.sha2(F.concat("stage", "field"), 256))
    k = F.pmod(F.length(F.concat("stage", "field")), F.lit(3))
    m = h.filter("field <> 'de'").select("stage", "field", F.when(k == 0, F.col("hash")).when(k == 1, F.col("file_hash")).otherwise("none").alias("expected"))
    return C.manifest_check(m, h.withColumn("hash", F.when(F.col("stage") != "src3", F.col("hash"))))


_OUTPUTS = """o AS (SELECT doc_id, 'out/' || doc_id AS path, CASE doc_id % 3 WHEN 0 THEN 'evaluation' ELSE 'stage' || (doc_id % 3) END AS stage, CASE doc_id % 5 WHEN 1 THEN 'judge' ELSE 'vision' END AS model_id, CASE WHEN doc_id % 6 = 3 THEN 'evaluation_judge' END AS model_role,
  doc_id % 7 = 2 AS evaluator_used, doc_id % 2 = 0 AS evaluation_only, doc_id % 4 = 0 AS not_consumed FROM documents)"""


@query(f"""WITH {_OUTPUTS}, r AS (SELECT path, unnest(list_filter([CASE WHEN stage <> 'evaluation' AND model_id = 'judge' THEN 'judge_model_in_main_flow' END, CASE WHEN stage <> 'evaluation' AND evaluator_used THEN 'evaluator_used_in_main_flow' END,
  CASE WHEN stage = 'evaluation' AND (model_id = 'judge' OR evaluator_used) AND NOT (evaluation_only AND not_consumed) THEN 'evaluation_lacks_its_flags' END, CASE WHEN stage = 'evaluation' AND model_id <> 'judge' AND coalesce(model_role, '') = 'evaluation_judge' THEN 'other_model_as_judge' END],
  lambda x: x IS NOT NULL)) AS reason FROM o) SELECT path, reason FROM r""")
def model_roles(spark, sf):
    n = F.col("doc_id")
    mod = lambda k: F.pmod(n, F.lit(k))
    o = B.table(spark, sf, "documents").select(
        F.concat(F.lit("out/"), n.cast("string")).alias("path"), F.when(mod(3) == 0, "evaluation").otherwise(F.concat(F.lit("stage"), mod(3).cast("string"))).alias("stage"), F.when(mod(5) == 1, "judge").otherwise("vision").alias("model_id"),
        F.when(mod(6) == 3, "evaluation_judge").alias("model_role"), (mod(7) == 2).alias("evaluator_used"), (mod(2) == 0).alias("evaluation_only"), (mod(4) == 0).alias("not_consumed"),
    )
    return C.role_violations(o, "judge")


@query("""WITH s AS (SELECT DISTINCT CASE WHEN n_nationkey % 9 = 8 THEN '' WHEN n_nationkey % 7 = 6 THEN 'twin' ELSE n_name END AS name, ['text_span', 'r' || n_regionkey] AS types, CASE WHEN n_nationkey % 4 <> 1 THEN 'guard' END AS guard, n_nationkey FROM nation),
f AS (SELECT CASE WHEN name = '' THEN 'skill_missing_name' END AS failure FROM s UNION ALL SELECT CASE WHEN guard IS NULL THEN 'skill_missing_guard:' || name END FROM s UNION ALL SELECT 'skill_unknown_unit_type:' || name || ':' || t FROM (SELECT name, unnest(types) AS t FROM s) WHERE t NOT IN ('text_span', 'r0', 'r1')
  UNION ALL SELECT 'duplicate_skill_names' FROM s GROUP BY name HAVING count(*) > 1) SELECT DISTINCT failure FROM f WHERE failure IS NOT NULL""")
def registry_contract(spark, sf):
    """A registry of nations as skills: some lack a name or a guard, some share a name, some accept foreign types."""
    k = F.col("n_nationkey")
    name = F.when(F.pmod(k, F.lit(9)) == 8, "").when(F.pmod(k, F.lit(7)) == 6, "twin").otherwise(F.col("n_name"))
    s = B.table(spark, sf, "nation").select(name.alias("name"), F.array(F.lit("text_span"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("accepted_types"), F.when(F.pmod(k, F.lit(4)) != 1, "guard").alias("guard"))
    return C.registry_failures(s, ["text_span", "r0", "r1"], ["accepted_types", "guard"])


@query("""WITH c AS (SELECT substr(sha256('{"doc_id":"' || source || '","page_index":' || doc_id || ',"prompt_hash":"' || sha256(text) || '","provider_mode":"mock"}'), 1, 24) AS call_id, CASE WHEN doc_id % 9 <> 2 THEN source END AS model, CASE WHEN doc_id % 3 = 0 THEN 'sent' ELSE 'none' END AS image_payload,
  CASE WHEN doc_id % 2 = 0 THEN 'h' END AS image_hash, CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN doc_id % 10 < 2 THEN 'timeout' END AS error_type FROM documents),
f AS (SELECT call_id, list_filter([CASE WHEN model IS NULL THEN 'missing_field:model' END, CASE WHEN image_payload = 'sent' AND image_hash IS NULL THEN 'payload_without_hash' END, CASE WHEN image_payload <> 'sent' AND image_hash IS NOT NULL THEN 'hash_without_payload' END,
  CASE WHEN status = 'ok' AND error_type IS NOT NULL THEN 'success_with_error' END], lambda x: x IS NOT NULL) AS failures FROM c) SELECT * FROM f WHERE len(failures) > 0""")
def call_audit(spark, sf):
    """Calls with their deterministic ids, and what is wrong with them."""
    n = F.col("doc_id")
    mod = lambda k: F.pmod(n, F.lit(k))
    c = B.table(spark, sf, "documents").select(
        C.call_id(F.col("source"), n, F.lit("mock"), F.col("text")).alias("call_id"), F.when(mod(9) != 2, F.col("source")).alias("model"), F.when(mod(3) == 0, "sent").otherwise("none").alias("image_payload"), F.when(mod(2) == 0, "h").alias("image_hash"),
        F.when(mod(5) == 0, "error").otherwise("ok").alias("status"), F.when(mod(10) < 2, "timeout").alias("error_type"),
    )
    return C.call_audit(c, ["model", "status"])


@query("""WITH r AS (SELECT source AS run, true AS predicted, CAST(substr(source, 4) AS INT) < 19 AS evaluated, 4 AS top_k, count(DISTINCT lang) AS c, 'judge' AS judge, 'all' AS record_slice, round(avg(n_chars) / 10000, 6) AS score, 0.0 AS failure_rate, count(*) FILTER (contains(text, 'file://')) AS leaks FROM documents GROUP BY source)
SELECT count(*) AS n_runs, list_filter([CASE WHEN NOT bool_and(evaluated) THEN 'evaluation_outputs_missing' END, CASE WHEN count(DISTINCT c) <> 1 THEN 'model_config_inconsistent' END, CASE WHEN sum(leaks) > 0 THEN 'public_leakage' END], lambda x: x IS NOT NULL) AS hard_failures,
  list_filter([CASE WHEN max(score) - min(score) > 0.001 THEN 'score_delta_above_bound' END], lambda x: x IS NOT NULL) AS soft_warnings, round(max(score) - min(score), 6) AS score_delta, bool_and(evaluated) AND count(DISTINCT c) = 1 AND sum(leaks) = 0 AS passed FROM r""")
def execution_gate(spark, sf):
    """Sources as runs."""
    d = B.table(spark, sf, "documents")
    r = d.groupBy(F.col("source").alias("run")).agg(F.count_distinct("lang").cast("string").alias("config_hash"), F.round(F.avg("n_chars") / 10000, 6).alias("score"), F.count_if(F.col("text").contains("file://")).alias("leaks"))
    r = r.select("*", F.lit(True).alias("predicted"), (F.substring("run", 4, 9).cast("int") < 19).alias("evaluated"), F.lit(4).alias("top_k"), F.lit("judge").alias("judge"), F.lit("all").alias("record_slice"), F.lit(0.0).alias("failure_rate"))
    return C.run_gate(r, 4, 0.001)


# ---- literals, types, demands

_LIT = f"""{D._PROFILE}, li AS (SELECT pr.*, lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) AS nq, list_sort(list_distinct(regexp_extract_all(question, '\\b[A-Z]{{1,4}}\\d{{1,4}}\\b'))) AS like_codes,
  list_sort(list_distinct(regexp_extract_all(question, '\\b(?:19|20)\\d{{2}}\\b'))) AS years, list_sort(list_distinct(numbers)) AS all_numbers FROM pr)"""


@query(f"""WITH {_LIT} SELECT query, like_codes AS codes, codes AS actionable_codes, years, all_numbers AS numbers, list_filter([{", ".join(f"CASE WHEN contains(nq, '{p}') THEN '{p}' END" for p in sorted(W.METRIC_PHRASES))}], lambda x: x IS NOT NULL) AS metric_phrases,
  CASE WHEN len(kinds) > 0 THEN kinds ELSE ['general'] END AS types FROM (SELECT *, list_filter([CASE WHEN len(like_codes) > 0 THEN 'code_like_literal' END, CASE WHEN len(codes) > 0 AND regexp_matches(nq, '{"|".join(W.CODE_LOOKUP_TERMS)}') THEN 'exact_code_lookup' END,
  CASE WHEN regexp_matches(nq, '{"|".join(W.NUMERIC_TABLE_TERMS)}') OR is_numeric OR is_code_or_table THEN 'table_numeric' END, CASE WHEN regexp_matches(nq, '{"|".join(w.replace("'", "''") for w in W.KEY_VALUE_TERMS)}') THEN 'key_value_lookup' END,
  CASE WHEN is_computation THEN 'computation' END], lambda x: x IS NOT NULL) AS kinds FROM li)""")
def question_literals(spark, sf):
    p = Q.profile(B.questions(spark, sf))
    kinds = W.question_types(F.col("question"), F.col("codes"), F.col("is_numeric"), F.col("is_code_or_table"), F.col("is_computation"))
    return p.select("query", W.literals(F.col("question")).alias("l"), kinds.alias("types")).select("query", "l.codes", "l.actionable_codes", "l.years", "l.numbers", "l.metric_phrases", "types")


def _present_sql(text: str, x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^([A-Z]{{1,4}}[0-9]{{1,4}}|[0-9]+([.][0-9]+)?)$') THEN regexp_matches({text}, '(?i)(^|[^A-Za-z0-9])' || replace({x}, '.', '[.]') || '([^A-Za-z0-9]|$)') ELSE contains(lower(trim(regexp_replace({text}, '\\s+', ' ', 'g'))), lower({x})) END"


@query(f"""WITH {_LIT}, {B.ARTIFACTS}, {B.CONTEXTS}, w AS (SELECT query, doc_id, list_distinct(list_concat(like_codes, all_numbers)) AS wanted FROM li),
x AS (SELECT query, string_agg(content || ' ' || coalesce(value_text, ''), ' ' ORDER BY artifact_id) AS said, string_agg(content || ' ' || coalesce(value_text, ''), ' ' ORDER BY artifact_id) FILTER (artifact_type = 'numeric_fact') AS facts FROM w JOIN art USING (doc_id) GROUP BY query),
k AS ({ORACLE["question_literals"]}),
j AS (SELECT query, types, len(list_filter(wanted, lambda v: {_present_sql("coalesce(page_text, '')", "v")})) > 0 AS on_page, len(list_filter(wanted, lambda v: {_present_sql("coalesce(said, '')", "v")})) > 0 AS in_artifacts, len(list_filter(wanted, lambda v: {_present_sql("coalesce(facts, '')", "v")})) > 0 AS in_facts
  FROM w JOIN k USING (query) LEFT JOIN cx USING (query) LEFT JOIN x USING (query)),
g AS ({P.ORACLE["guarded_select"]}), t AS (SELECT unnest(types) AS type, on_page, in_artifacts, in_facts, coalesce(n_selected, 0) > 0 AS selected, decision = 'token_key_value_selection' AS by_tokens FROM j JOIN g USING (query))
SELECT type, count(*) AS n, count(*) FILTER (on_page) AS on_page, count(*) FILTER (in_artifacts) AS in_artifacts, count(*) FILTER (in_facts) AS in_facts, count(*) FILTER (selected) AS selected, count(*) FILTER (by_tokens) AS by_tokens FROM t GROUP BY type""")
def health_by_question_type(spark, sf):
    """For each type of question: how many name literals that their pages, artifacts or numeric facts hold, and how many select artifacts."""
    from folioflow.operators import selection as S

    p, _, d, s = D._guarded(spark, sf)
    kinds = W.question_types(F.col("question"), F.col("codes"), F.col("is_numeric"), F.col("is_code_or_table"), F.col("is_computation"))
    wanted = F.array_union(W.code_literals(F.col("question")), F.array_distinct("numbers"))
    q = p.select("query", "doc_id", kinds.alias("types"), wanted.alias("wanted"))
    said = F.concat("content", F.lit(" "), F.coalesce("value_text", F.lit("")))
    a = B.artifacts(spark, sf).select("doc_id", said.alias("said"), "artifact_type", "artifact_id")
    joined = lambda ok: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("artifact_id", "said")))), lambda x: x["said"]), " ")
    held = q.select("query", "doc_id").join(a, "doc_id").groupBy("query").agg(joined(F.lit(True)).alias("said"), joined(F.col("artifact_type") == "numeric_fact").alias("facts"))
    j = q.join(B.contexts(spark, sf), "query", "left").join(held, "query", "left").join(d.select("query", "decision"), "query").join(s.select("query").distinct().withColumn("_s", F.lit(True)), "query", "left")
    some = lambda c: F.exists("wanted", lambda v: W.literal_present(F.coalesce(F.col(c), F.lit("")), v))
    rows = j.select("types", some("page_text").alias("on_page"), some("said").alias("in_artifacts"), some("facts").alias("in_facts"), F.coalesce("_s", F.lit(False)).alias("selected"), (F.col("decision") == "token_key_value_selection").alias("by_tokens"))
    return S.health(rows, "types", ["on_page", "in_artifacts", "in_facts", "selected", "by_tokens"])


#: Responses by the item's number: plain, fenced, wordy, a list, broken, none.
_RESPONSES = [
    '{"answer_type": "computation", "required_entities": ["Net  income", "net income", " "], "required_operands": ["net_income"], "evidence_dimensions": [{"dimension": "Total Assets!", "label": "total assets", "aliases": []}], "min_numeric_values": 1}',
    '```json\\n{"answer_type": "odd", "required_values_or_codes": ["AR01"], "is_document_metadata_lookup": true}\\n```',
    'Surely: {"answer_type": "metadata_lookup", "evidence_dimensions": [{"dimension": "revised", "aliases": ["revised", "Revised"]}, {"dimension": "Revised"}]} I hope.',
    '["a", "list"]',
    '{"answer_type": ',
    "nothing like it",
]


def _responses(spark, sf):
    q = B.questions(spark, sf)
    texts = F.array(*[F.lit(x.replace("\\n", "\n")) for x in _RESPONSES])
    return q.withColumn("response", F.element_at(texts, (F.pmod("query", F.lit(len(_RESPONSES))) + 1).cast("int")))


@query("""SELECT item_id AS query, [NULL, NULL, NULL, 'json_not_object', 'json_object_not_found', 'json_like_block_absent'][item_id % 6 + 1] AS failure, CASE item_id % 6 WHEN 0 THEN 'computation' WHEN 1 THEN 'table_lookup' WHEN 2 THEN 'metadata_lookup' END AS answer_type,
  CASE item_id % 6 WHEN 0 THEN ['Net income'] WHEN 1 THEN [] WHEN 2 THEN [] END AS entities, CASE item_id % 6 WHEN 0 THEN ['total_assets=total assets'] WHEN 1 THEN [] WHEN 2 THEN ['revised=revised'] END AS dimensions,
  CASE item_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 0 END AS min_numeric_values, CASE WHEN item_id % 6 < 3 THEN item_id % 6 = 1 END AS exact_code, CASE WHEN item_id % 6 < 3 THEN item_id % 6 = 2 END AS metadata FROM benchmark""")
def evidence_demands(spark, sf):
    """Responses parsed into demands, and why others can't be."""
    n = W.normalised(_responses(spark, sf))
    dims = F.transform("demand.evidence_dimensions", lambda d: F.concat_ws("=", d["dimension"], F.array_join(d["aliases"], "+")))
    return n.select(
        "query", W.parse_failure(F.col("response")).alias("failure"), "demand.answer_type", F.col("demand.required_entities").alias("entities"), dims.alias("dimensions"), "demand.min_numeric_values",
        F.col("demand.requires_exact_code_selection").alias("exact_code"), F.col("demand.is_document_metadata_lookup").alias("metadata"),
    )


@query(f"""WITH {D._PROFILE}, e AS (SELECT *, query % 6 AS k, CASE query % 6 WHEN 0 THEN 'Net income total assets total assets' WHEN 1 THEN 'AR01' WHEN 2 THEN 'revised revised' ELSE '' END AS extra FROM pr)
SELECT query, list_sort(list_distinct(list_concat(q_tokens, CASE k WHEN 0 THEN ['net', 'income', 'total', 'assets'] WHEN 1 THEN ['ar01'] WHEN 2 THEN ['revised'] ELSE [] END))) AS q_tokens, list_sort(list_distinct(list_concat(codes, CASE WHEN k = 1 THEN ['AR01'] ELSE [] END))) AS codes,
  list_sort(list_distinct(list_concat(numbers, CASE WHEN k = 1 THEN ['01'] ELSE [] END))) AS numbers, list_sort(list_distinct(list_concat(required_operands, CASE WHEN k = 0 THEN ['net_income'] ELSE [] END))) AS required_operands,
  CASE WHEN k = 0 THEN greatest(numbers_needed, 2) ELSE numbers_needed END AS numbers_needed, CASE k WHEN 0 THEN ['total_assets'] WHEN 2 THEN ['revised'] ELSE list_transform(dimensions, lambda d: d.dimension) END AS dimensions,
  is_numeric OR k IN (0, 1) AS is_numeric, is_metadata OR k = 2 AS is_metadata, is_computation OR k = 0 AS is_computation FROM e""")
def demand_profiles(spark, sf):
    """Question profiles with their demands worked in."""
    p = Q.profile(B.questions(spark, sf)).join(W.normalised(_responses(spark, sf)).select("query", "demand"), "query")
    m = W.merged(p).withColumn("dimensions", F.transform("dimensions", lambda d: d["dimension"]))
    return m.select("query", "q_tokens", "codes", "numbers", "required_operands", "numbers_needed", "dimensions", "is_numeric", "is_metadata", "is_computation")


# ---- privacy and small projections


@query(f"""WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN repeat('QUJD', 40) WHEN 1 THEN 'sha256 ' || repeat('QUJD', 40) WHEN 2 THEN repeat('QUJD', 20) || 'A' WHEN 3 THEN '{{"gold_answer": 1, "x": {{"api_key": "k"}}}}' WHEN 4 THEN 'see file:///home/x' ELSE text END AS t FROM documents),
k AS (SELECT doc_id, t, list_distinct(list_filter(regexp_extract_all(t, '"([A-Za-z0-9_]+)"\\s*:', 1), lambda x: x IN ({", ".join(f"'{x}'" for x in U.FORBIDDEN)}))) AS ks,
  list_filter(regexp_extract_all(t, '[A-Za-z0-9+/]{{80,}}={{0,2}}'), lambda m: length(m) % 4 = 0) AS b FROM d)
SELECT doc_id, list_sort(list_concat(list_transform(ks, lambda x: 'forbidden_field:' || x), list_filter([{", ".join(f"CASE WHEN contains(lower(t), '{f}') THEN 'forbidden_content:{f}' END" for f in U.FRAGMENTS)},
  CASE WHEN len(b) > 0 AND NOT contains(lower(t), 'sha256') THEN 'forbidden_content:base64_payload' END], lambda x: x IS NOT NULL))) AS leaks FROM k""".replace("\\\\s", "\\s"))
def payload_leaks(spark, sf):
    """Keys, fragments and base64 payloads in texts, a few of them planted."""
    n = F.pmod("doc_id", F.lit(6))
    block = F.repeat(F.lit("QUJD"), F.lit(40))
    t = F.when(n == 0, block).when(n == 1, F.concat(F.lit("sha256 "), block)).when(n == 2, F.concat(F.repeat(F.lit("QUJD"), F.lit(20)), F.lit("A"))).when(n == 3, '{"gold_answer": 1, "x": {"api_key": "k"}}').when(n == 4, "see file:///home/x").otherwise(F.col("text"))
    return B.table(spark, sf, "documents").select("doc_id", U.json_leaks(t).alias("leaks"))


@query(f"""WITH {B.ARTIFACTS} SELECT artifact_id, list_filter(regexp_extract_all(lower(artifact_type || chr(10) || modality || chr(10) || artifact_id || chr(10) || page_id || chr(10) || status || chr(10) || '{{' ||
  array_to_string(list_filter([CASE WHEN column_label <> '' THEN '"column_label":"' || column_label || '"' END, CASE WHEN row_label <> '' THEN '"row_label":"' || row_label || '"' END, CASE WHEN value_text <> '' THEN '"value_text":"' || value_text || '"' END], lambda x: x IS NOT NULL), ',') || '}}'),
  '[a-z0-9%]+'), lambda t: t NOT IN ({", ".join(f"'{w}'" for w in T.STOPWORDS)})) AS tokens, len(regexp_extract_all(lower(content), '[a-z0-9%]+')) AS n_record_tokens FROM art""")
def metadata_tokens(spark, sf):
    """Tokens of an artifact's metadata, its empty fields dropped, and how many its content has with stop words."""
    filled = F.to_json(F.struct(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("column_label", "row_label", "value_text")]))
    said = F.concat_ws("\n", "artifact_type", "modality", "artifact_id", "page_id", "status", filled)
    return B.artifacts(spark, sf).select("artifact_id", T.tokens(said).alias("tokens"), F.size(T.record_tokens(F.col("content"))).alias("n_record_tokens"))


@query(f"""WITH {B.ARTIFACTS}, a AS (SELECT artifact_id, artifact_type, list_filter([source_id, source_id, page_id, artifact_type, source_id], lambda x: true) AS refs FROM art), u AS (SELECT artifact_id, artifact_type FROM a WHERE artifact_type < 'figure' UNION ALL SELECT artifact_id, artifact_type FROM a WHERE artifact_type >= 'caption')
SELECT artifact_id, artifact_type, count(*) AS n, any_value(list_filter(refs, lambda x, i: list_position(refs, x) = i)) AS refs FROM u JOIN a USING (artifact_id, artifact_type) GROUP BY ALL""")
def artifacts_appended(spark, sf):
    """Two overlapping parts appended as they are; references each once, in order of first sight."""
    a = B.artifacts(spark, sf).withColumn("refs", F.array_distinct(F.array("source_id", "source_id", "page_id", "artifact_type", "source_id")))
    both = a.filter("artifact_type < 'figure'").unionByName(a.filter("artifact_type >= 'caption'"))
    return both.groupBy("artifact_id", "artifact_type", "refs").agg(F.count("*").alias("n"))


@query(f"""WITH {P._GUARDED} SELECT query, decision, CASE WHEN decision IN {P._TAKES} THEN (SELECT list(artifact_id ORDER BY r) FROM gb WHERE gb.query = gr.query) END AS selected, length(page_text) AS n_page_chars FROM gr""")
def guarded_preview(spark, sf):
    """What guarded selection would give each record; the records stay as they are."""
    return Q.preview(B.questions(spark, sf), B.artifacts(spark, sf), B.contexts(spark, sf), "query", enabled=True).select("query", "decision", "selected", F.length("page_text").alias("n_page_chars"))


@query("""WITH p AS (SELECT *, doc_id // 4 AS d, doc_id % 4 AS p FROM documents WHERE doc_id % 5 <> 1), s AS (SELECT d, list(p ORDER BY p) AS pages, count(*) AS n FROM p GROUP BY d),
g AS (SELECT d, p, p - row_number() OVER (PARTITION BY d ORDER BY p) AS k FROM p), r AS (SELECT d, k, min(p) AS first, count(*) AS len FROM g GROUP BY ALL)
SELECT 'd' || d AS doc_id, CAST(first AS INT) AS first_page, CAST(first + len - 1 AS INT) AS last_page, len AS n_pages FROM r""")
def consecutive_pages(spark, sf):
    """Runs of consecutive pages of each document."""
    p = B.doc_pages(spark, sf).filter("number % 5 <> 1").select("doc_id", "page_index")
    return J.runs(p, ["doc_id"], "page_index").select("doc_id", F.col("first").alias("first_page"), F.col("last").alias("last_page"), F.col("n").alias("n_pages"))


@query(f"""WITH {B.POOLS}, al AS (SELECT query, item FROM q JOIN it USING (pool) WHERE query % 2 = 0 AND item % 3 = 0), f AS (SELECT ord.* FROM ord WHERE query % 2 = 1 OR (query, item) IN (SELECT (query, item) FROM al)),
r AS (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY rank) AS k FROM f WHERE query % 2 = 1 OR query IN (SELECT query FROM al)) SELECT query, item, score, CAST(k AS INT) AS rank FROM r WHERE k <= 4""")
def text_topk_filtered(spark, sf):
    """The first four items of each ranking; even queries may only have items that three divides."""
    from folioflow.operators import retrieval as R

    asked, items = B.asked(spark, sf), B.items(spark, sf)
    n = items.groupBy("pool").count().agg(F.max("count")).first()[0] or 1
    whole = R.bm25_topk(asked, items, n)
    allowed = asked.filter("query % 2 = 0").select("query", "pool").join(items.filter("item % 3 = 0").select("pool", "item"), "pool")
    return R.filtered_topk(whole, allowed, 4)


@query("""WITH p AS (SELECT doc_id AS n, 'd' || (doc_id // 4) AS doc_id, CAST(doc_id % 4 AS INT) AS page_index, doc_id % 3 <> 0 AS img, trim(coalesce(text, '')) <> '' AND doc_id % 5 <> 2 AS txt FROM documents),
t AS (SELECT *, list_concat(CASE WHEN img THEN ['visual_observation', 'visual_region', 'figure'] ELSE [] END, CASE WHEN txt THEN ['text_span', 'section_header', 'caption', 'numeric_fact', 'table', 'table_cell'] ELSE [] END) AS l FROM p),
u AS (SELECT doc_id, page_index, unnest(l) AS artifact_type, unnest(range(1, len(l) + 1)) AS place FROM t)
SELECT doc_id, page_index, printf('artifact_%04d', place) AS artifact_id, artifact_type, CASE artifact_type WHEN 'numeric_fact' THEN 'numeric' WHEN 'table' THEN 'table' WHEN 'table_cell' THEN 'table' WHEN 'section_header' THEN 'layout' WHEN 'text_span' THEN 'text' WHEN 'caption' THEN 'text' ELSE 'image' END AS modality,
  CASE WHEN artifact_type IN ('visual_observation', 'visual_region', 'figure') THEN 'full_page_image' ELSE 'text_block' END AS anchor_type, 'p' || page_index || CASE WHEN artifact_type IN ('visual_observation', 'visual_region', 'figure') THEN '_full_page' ELSE '_text_000' END AS source_id,
  'mock ' || replace(artifact_type, '_', ' ') || ' candidate anchored to p' || page_index || CASE WHEN artifact_type IN ('visual_observation', 'visual_region', 'figure') THEN '_full_page' ELSE '_text_000' END AS content FROM u""")
def page_template_artifacts(spark, sf):
    """Fixed artifacts of pages with and without image and text."""
    n = F.col("number")
    block = F.when((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.pmod(n, F.lit(5)) != 2), "b")
    return A.page_templates(B.doc_pages(spark, sf).select("doc_id", "page_index", (F.pmod(n, F.lit(3)) != 0).alias("has_image"), block.alias("first_block")))


@query(f"""WITH {B.CLASSIFIED}, d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, artifact_type, content ORDER BY artifact_id) AS k FROM cls), o AS (SELECT * FROM d WHERE k = 1),
i AS (SELECT *, list_sort(list_filter([CASE WHEN number % 7 = 0 THEN 'anchor_source_not_in_layout' END, CASE WHEN number % 10 = 1 THEN 'unknown_status' END], lambda x: x IS NOT NULL)) AS issues FROM o)
SELECT artifact_id, issues, CASE WHEN len(issues) = 0 THEN 'anchored' ELSE 'discarded' END AS status, locator_kind FROM i""")
def compile_chain(spark, sf):
    """Artifacts after all stages of a page's compilation; some have an odd status or an anchor that the layout lacks."""
    a = B.artifacts(spark, sf)
    a = a.withColumn("status", F.when(F.pmod("number", F.lit(10)) == 1, "odd").otherwise(F.col("status")))
    blocks = a.filter("number % 7 <> 0").select("doc_id", "page_index", "source_id")
    key = [F.col(c) for c in ("doc_id", "page_index", "artifact_type", "content")]
    return A.compiled(a, blocks, key, [F.col("artifact_id")]).select("artifact_id", "issues", "status", "locator_kind")


def _clean_sql(x: str) -> str:
    return f"regexp_replace(trim(regexp_extract(trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')), '(?s)^(.*?)(?:[.;!?]\\s|$)', 1)), '[.;]+$', '')"


@query(f"""WITH d AS (SELECT doc_id, ['Where is it', 'Show the map', 'What is the title', 'What is it'][doc_id % 4 + 1] AS q, text AS t, CASE WHEN doc_id % 8 = 1 THEN 'A map. ' || text ELSE text END AS e FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, coalesce(nullif({_clean_sql("regexp_extract(e, '(?i)\\bconceived\\s+in\\s+(?:the\\s+)?([^.;\\n]+)', 1)")}, ''), nullif({_clean_sql("regexp_extract(e, '(?i)\\bwas\\s+founded\\s+in\\s+(?:the\\s+)?([^.;\\n]+)', 1)")}, ''),
  nullif({_clean_sql("regexp_extract(e, '(?i)\\bin\\s+(?:the\\s+)?([^.;\\n]+)', 1)")}, '')) AS place FROM d)
SELECT doc_id, CASE WHEN q = 'Where is it' AND place IS NOT NULL THEN place WHEN q = 'Show the map' AND regexp_matches(lower(e), 'map|diagram') THEN {_clean_sql("t")} WHEN q = 'What is the title' THEN
  CASE WHEN len(string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ')) <= 12 THEN {_clean_sql("t")} ELSE '' END ELSE {_clean_sql("t")} END AS answer FROM p""")
def direct_answers(spark, sf):
    """Answers by rule: places, maps, titles, first sentences."""
    from folioflow.operators import reports

    n, t = F.col("doc_id"), F.col("text")
    q = F.element_at(F.array(*map(F.lit, ["Where is it", "Show the map", "What is the title", "What is it"])), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    e = F.when(F.pmod(n, F.lit(8)) == 1, F.concat(F.lit("A map. "), t)).otherwise(t)
    return B.documents(spark, sf).filter("text IS NOT NULL").select("doc_id", reports.direct_answer(q, t, e).alias("answer"))


def _types(names) -> str:
    return "[" + ", ".join(f"'{t}'" for t in names) + "]"


def _by_skill(skill: str, values: dict[str, str]) -> str:
    return f"CASE {skill} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_ACCEPTED = {k: _types(types) for k, (types, _) in Q.SKILLS.items()}
_UNIT = """array_to_string(list_filter(['- id=' || artifact_id, 'page=' || page_index, 'type=' || artifact_type, CASE WHEN len(ch) > 0 THEN 'codes=' || array_to_string(ch, ',') END, CASE WHEN len(oh) > 0 THEN 'operands=' || array_to_string(oh, ',') END,
  CASE WHEN coalesce(row_label, '') || coalesce(column_label, '') || coalesce(value_text, '') <> '' THEN 'fields=' || array_to_string(list_filter([CASE WHEN row_label <> '' THEN 'row_label=' || row_label END, CASE WHEN column_label <> '' THEN 'column_label=' || column_label END,
    CASE WHEN value_text <> '' THEN 'value_text=' || value_text END], lambda x: x IS NOT NULL), ';') END, CASE WHEN cc <> '' THEN 'text=' || CASE WHEN length(cc) > 180 THEN rtrim(substr(cc, 1, 177)) || '...' ELSE cc END END], lambda x: x IS NOT NULL), ' | ')"""
_CAPSULES = f"""{P._GUARDED}, sk AS ({D.ORACLE["skill_activation"]}), cg AS (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS cc FROM gs), cu AS (SELECT *, {_UNIT} AS line FROM cg),
cs AS (SELECT cu.*, gb.r FROM cu JOIN gb ON gb.query = cu.query AND gb.artifact_id = cu.artifact_id JOIN gr ON gr.query = cu.query WHERE decision IN {P._TAKES}),
ac AS (SELECT query, skills, list_distinct(flatten(list_transform(skills, lambda s: {_by_skill("s", _ACCEPTED)}))) AS accepted FROM sk),
rs AS (SELECT * FROM (SELECT cu.*, row_number() OVER (PARTITION BY cu.query ORDER BY score DESC, page_index, artifact_id) AS r FROM cu JOIN ac USING (query) WHERE list_contains(accepted, artifact_type) AND cu.query NOT IN (SELECT query FROM cs)) WHERE r <= 4),
un AS (SELECT query, list(line ORDER BY r, line) AS units FROM (SELECT query, line, r FROM cs WHERE r <= 4 UNION ALL SELECT query, line, r FROM rs) GROUP BY query),
mt AS (SELECT query, list(artifact_type) AS made FROM cu GROUP BY query), tt AS (SELECT query, list(artifact_type) AS taken, list_distinct(flatten(list(ch) FILTER (artifact_type IN ({_types(Q.SKILLS["exact_code_lookup"][0])[1:-1]})))) AS fc,
  list_distinct(flatten(list(oh) FILTER (artifact_type IN ({_types(Q.SKILLS["numeric_computation"][0])[1:-1]})))) AS fo FROM cs GROUP BY query),
cj AS (SELECT gr.query, decision, codes, required_operands, skills, coalesce(made, []) AS made, coalesce(taken, []) AS taken, coalesce(fc, []) AS fc, coalesce(fo, []) AS fo, units FROM gr JOIN ac USING (query) LEFT JOIN mt USING (query) LEFT JOIN tt USING (query) LEFT JOIN un USING (query)),
cm AS (SELECT *, list_sort(list_distinct(list_concat(CASE WHEN list_contains(skills, 'exact_code_lookup') THEN list_transform(list_filter(codes, lambda c: NOT list_contains(fc, c)), lambda c: 'exact_code:' || c) ELSE [] END,
  CASE WHEN list_contains(skills, 'numeric_computation') AND decision <> 'operand_page_evidence_route' THEN list_transform(list_filter(required_operands, lambda o: NOT list_contains(fo, o)), lambda o: 'operand:' || o) ELSE [] END,
  CASE WHEN decision IN ('artifact_dimension_support_guard', 'no_relevant_artifact_guard') AND len(list_filter(skills, lambda s: len(list_intersect(taken, {_by_skill("s", _ACCEPTED)})) = 0)) > 0 THEN ['selected_supporting_artifact'] ELSE [] END))) AS missing FROM cj),
ct AS (SELECT *, list_transform(skills, lambda s: 'Trace: skill=' || s || '; candidates=' || len(list_filter(made, lambda t: list_contains({_by_skill("s", _ACCEPTED)}, t))) || '; selected=' || len(list_filter(taken, lambda t: list_contains({_by_skill("s", _ACCEPTED)}, t)))
  || '; guard=' || {_by_skill("s", {k: f"'{g}'" for k, (_, g) in Q.SKILLS.items()})}) AS traces FROM cm),
cap AS (SELECT query, array_to_string(list_concat(['[Evidence Capsule]', 'Skills: ' || array_to_string(skills, ', '), 'Guard: ' || decision || '; policy: ' || {_by_skill("decision", {k: f"'{v}'" for k, v in Q.POLICIES.items()})}],
  CASE WHEN units IS NULL THEN ['Evidence: none selected'] ELSE list_concat(['Evidence:'], units) END, CASE WHEN len(missing) > 0 THEN ['Missing: ' || array_to_string(missing, ', ')] ELSE [] END, traces), chr(10)) || chr(10) AS capsule, len(taken) > 0 AS own FROM ct)"""
_ESTIMATE = r"len(regexp_extract_all({}, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s\p{{Z}}]'))"


@query(f"""WITH {_CAPSULES}, rw AS (SELECT 'd' || (doc_id // 4) AS doc_id, CAST(sum({_ESTIMATE.format("text")}) AS BIGINT) AS raw_tokens FROM documents GROUP BY 1)
SELECT cap.query, sha256(capsule) AS capsule_hash, {_ESTIMATE.format("capsule")} AS capsule_tokens, CASE WHEN own THEN 'selected_artifacts' ELSE 'top_accepted_candidates' END AS unit_source, raw_tokens,
  round(CASE WHEN raw_tokens <= 0 THEN CASE WHEN {_ESTIMATE.format("capsule")} > 0 THEN 1.0 ELSE 0.0 END ELSE {_ESTIMATE.format("capsule")} / raw_tokens END, 6) AS token_ratio FROM cap JOIN qs USING (query) LEFT JOIN rw USING (doc_id)""")
def capsule_tokens(spark, sf):
    """The capsule of each question, and its size beside that of its document's pages."""
    from folioflow.functions.scoring import ratio

    p, c, d, s = D._guarded(spark, sf)
    raw = B.doc_pages(spark, sf).groupBy("doc_id").agg(F.sum(T.token_estimate(F.col("text"))).alias("raw_tokens"))
    out = Q.capsules(p, c, d, s, "query").join(B.questions(spark, sf).select("query", "doc_id"), "query").join(raw, "doc_id", "left")
    share = F.round(ratio(F.col("capsule_tokens"), F.col("raw_tokens")), 6)
    return out.select("query", F.sha2("capsule", 256).alias("capsule_hash"), "capsule_tokens", "unit_source", "raw_tokens", share.alias("token_ratio"))
