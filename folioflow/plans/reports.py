"""Queries on reports, gates, identifiers and answer rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import artifacts as A
from folioflow.operators import extract as X
from folioflow.operators import graph as G
from folioflow.operators import guards as Q
from folioflow.operators import ranking as K
from folioflow.operators import reports as P
from folioflow.operators import retrieval as R
from folioflow.plans import bindings as B
from folioflow.plans import documents as D
from folioflow.plans import retrieval as V

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_R = "CASE WHEN broad THEN 'b' WHEN fopen THEN 'f' END"


@query(f"""WITH {D._LABELS} SELECT count(*) AS n_artifacts, count(DISTINCT doc_id) AS n_docs, count(DISTINCT (doc_id, page_index)) AS n_pages, count(*) FILTER ({_R} IS NULL) AS n_kept,
  round(count(*) FILTER ({_R} IS NOT NULL) / count(*), 6) AS discard_rate, round(count(*) FILTER (source_anchored) / count(*), 6) AS anchored_rate, round(count(*) FILTER (element_locatable) / count(*), 6) AS locatable_rate,
  round(count(*) FILTER (proof_trace_eligible) / count(*), 6) AS proof_rate, round(count(*) / count(DISTINCT (doc_id, page_index)), 6) AS artifacts_per_page FROM l4""")
def stage_quality_report(spark, sf):
    return P.quality_report(A.quality_labels(B.classified(spark, sf)))


@query(f"WITH {B.ARTIFACTS} SELECT artifact_type, modality, count(*) AS n FROM art GROUP BY ALL")
def type_modality_distribution(spark, sf):
    return P.type_distribution(B.artifacts(spark, sf), "artifact_type", "modality")


@query(f"WITH {B.ARTIFACTS}, c AS (SELECT count(*) AS c FROM art GROUP BY artifact_type, content, row_label) SELECT CAST(sum(c - 1) AS BIGINT) AS duplicates, count(*) FILTER (c > 1) AS keys FROM c")
def duplicate_atomic_keys(spark, sf):
    return P.duplicate_keys(B.artifacts(spark, sf), ["artifact_type", "content", "row_label"])


_SETS = f"""WITH {B.ARTIFACTS}, {B.QUESTIONS}, {V._EDGES_SEED},
x AS (SELECT 'artifact:' || doc_id || ':' || page_index || ':' || artifact_id AS node, doc_id, page_index, source_id, number FROM art), s3 AS (SELECT query, node FROM seed WHERE rank <= 3),
gd AS (SELECT query, x.node FROM qs JOIN x USING (doc_id) WHERE x.number % 3 = 0),
nb AS (SELECT 'page_neighborhood' AS setting, a.node, b.node AS other FROM x a JOIN x b ON a.doc_id = b.doc_id AND abs(a.page_index - b.page_index) <= 1 WHERE a.node <> b.node
  UNION SELECT 'source_anchor', a.node, b.node FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.source_id = b.source_id WHERE a.node <> b.node),
st(setting) AS (VALUES ('direct_structural'), ('page_neighborhood'), ('source_anchor')),
ex AS (SELECT setting, query, node FROM st, s3 UNION SELECT setting, query, other FROM nb JOIN s3 USING (node)),
m AS (SELECT ex.*, (query, node) IN (SELECT (query, node) FROM s3) AS seed, (query, node) IN (SELECT (query, node) FROM gd) AS gold FROM ex),
pq AS (SELECT setting, query, count(*) FILTER (seed) AS n_seed, count(*) AS n_all, max(CAST(seed AND gold AS INT)) AS b, max(CAST(gold AS INT)) AS a FROM m GROUP BY ALL),
r AS (SELECT setting, count(*) AS n_queries, CAST(sum(n_seed) AS BIGINT) AS n_seeds, CAST(sum(n_all - n_seed) AS BIGINT) AS n_added, round(sum(n_all) / sum(n_seed), 6) AS expansion_ratio, round(avg(b), 6) AS hit_rate,
  round(avg(a), 6) AS expanded_hit_rate FROM pq GROUP BY setting)
SELECT *, round(expanded_hit_rate - hit_rate, 6) AS gain, CAST(row_number() OVER (ORDER BY round(expanded_hit_rate - hit_rate, 6) DESC, setting) AS INT) AS rank FROM r"""


@query(_SETS)
def edge_ablation(spark, sf):
    """Expansion deltas of three settings against gold artifacts."""
    a = B.artifacts(spark, sf)
    edges, seeds = G.edges(a, context=False), V._seeds(spark, sf)
    node = T.node_id("artifact", F.col("doc_id"), F.col("page_index"), F.col("artifact_id"))
    gold = B.questions(spark, sf).select("query", "doc_id").join(a.filter(F.pmod("number", F.lit(3)) == 0).select("doc_id", node.alias("node")), "doc_id").select("query", "node")
    sets = {"direct_structural": G.direct_neighbours, "page_neighborhood": G.page_neighbours, "source_anchor": G.anchor_neighbours}
    return P.ablation({k: P.expansion_delta(seeds, G.expand(seeds, f(edges)), gold) for k, f in sets.items()})


@query(f"""WITH {B.ARTIFACTS}, a AS (SELECT doc_id, page_index, count(*) FILTER (artifact_type IN ('table_cell', 'table')) AS t, count(*) FILTER (artifact_type = 'numeric_fact') AS n,
  count(*) FILTER (artifact_type IN ('figure', 'caption')) AS f, min(number) AS number FROM art GROUP BY ALL),
s AS (SELECT doc_id, page_index, round(3 * least(t, 5) + 2 * least(n, 5) + least(f, 3) + CASE WHEN number % 2 = 0 THEN 1.0 / (number % 10 + 1) ELSE 0.0 END, 6) AS score FROM a)
SELECT doc_id, page_index, score, CAST(r AS INT) AS position FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, page_index) AS r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, doc_id, page_index) AS d FROM s) WHERE d <= 2) WHERE r <= 50""")
def structured_page_selection(spark, sf):
    n = F.col("number")
    found = B.doc_pages(spark, sf).filter(F.pmod(n, F.lit(2)) == 0).select("doc_id", "page_index", (1.0 / (F.pmod(n, F.lit(10)) + 1)).alias("score"))
    s = P.page_scores(B.artifacts(spark, sf), found)
    return K.capped(s, [F.desc("score"), F.asc("doc_id"), F.asc("page_index")], [(["doc_id"], 2)], 50)


@query(f"""WITH {B.BRANCHES}, c AS (SELECT query, page_index, rank, CASE WHEN page_index % 5 = 0 THEN 1 WHEN branch = 'image' THEN 2 ELSE 3 END AS priority FROM br),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY priority, rank, page_index) AS n FROM c) SELECT query, page_index, rank, priority FROM r WHERE n = 1""")
def one_page_per_record(spark, sf):
    p = F.when(F.pmod("page_index", F.lit(5)) == 0, 1).when(F.col("branch") == "image", 2).otherwise(3)
    c = B.branches(spark, sf).select("query", "page_index", "rank", p.alias("priority"))
    return P.first_choice(c, "query", [F.col("priority"), F.col("rank"), F.col("page_index")])


@query(f"""WITH {B.ARTIFACTS}, {B.QUESTIONS}, t AS (SELECT query, doc_id, unnest(list_distinct({B.sql_tokens("question")})) AS term FROM qs),
a AS (SELECT doc_id, artifact_id, page_index, unnest(list_distinct({B.sql_tokens("content")})) AS term FROM art)
SELECT query, term, count(artifact_id) AS n_artifacts, count(DISTINCT page_index) AS n_pages FROM t LEFT JOIN a USING (doc_id, term) GROUP BY ALL""")
def coverage_matrix(spark, sf):
    q = B.questions(spark, sf).select("query", "doc_id", F.array_distinct(T.tokens(F.col("question"))).alias("terms"))
    a = B.artifacts(spark, sf).select("doc_id", "artifact_id", "page_index", T.tokens(F.col("content")).alias("tokens"))
    return P.coverage_matrix(q, a, ["doc_id"])


@query(f"""WITH {B.CLASSIFIED}, m AS (SELECT avg(CAST(source_anchored AS INT)) AS anchored, avg(CAST(element_locatable AS INT)) AS locatable, avg(CAST(proof_trace_eligible AS INT)) AS proof FROM cls),
b AS (SELECT avg(CAST(source_anchored AS INT)) AS anchored, avg(CAST(element_locatable AS INT)) AS locatable, avg(CAST(proof_trace_eligible AS INT)) AS proof FROM cls WHERE number % 2 = 0)
SELECT list_filter([CASE WHEN m.anchored < b.anchored THEN 'anchored' END, CASE WHEN m.locatable < b.locatable THEN 'locatable' END, CASE WHEN m.proof < b.proof THEN 'proof' END], lambda x: x IS NOT NULL) AS worse,
  NOT (m.anchored < b.anchored OR m.locatable < b.locatable OR m.proof < b.proof) AS passed FROM m, b""")
def incremental_gate(spark, sf):
    c = B.classified(spark, sf)
    mean = lambda d: d.agg(*[F.avg(F.col(k).cast("int")).alias(n) for k, n in (("source_anchored", "anchored"), ("element_locatable", "locatable"), ("proof_trace_eligible", "proof"))])
    return P.gate(mean(c.filter(F.pmod("number", F.lit(2)) == 0)), mean(c), ["anchored", "locatable", "proof"])


@query(r"""WITH d AS (SELECT doc_id, source, lang, text, 'Where is ' || lang AS question FROM documents)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN NULL WHEN doc_id % 2 = 0 AND regexp_extract(text, '(?i)\b(?:in|at) ((?:the )?[a-z]+)', 1) <> '' THEN regexp_extract(text, '(?i)\b(?:in|at) ((?:the )?[a-z]+)', 1)
  ELSE substr(trim(regexp_extract(text, '(?s)^(.*?)(?:[.;!?]\s|$)', 1)), 1, 160) END AS answer FROM d""")
def extractive_answers(spark, sf):
    q = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit("Where is it?")).otherwise(F.lit("What is it?"))
    d = B.table(spark, sf, "documents").filter("doc_id IS NOT NULL")
    return d.select("doc_id", P.short_answer(q, F.col("text")).alias("answer"))


@query(r"""SELECT doc_id, printf('%s#p%03d', source, CAST(doc_id % 1000 AS INT)) AS page_id, 'artifact:' || url_encode(source || ' *~/' || lang) || ':' || doc_id AS node_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS text_hash,
  regexp_replace(lang || '-' || source, '[^A-Za-z0-9]+', '_', 'g') || '__' || substr(sha1(source || '::' || lang), 1, 10) AS record_id, substr(regexp_replace(lower(lang || ' / ' || source), '[^a-z0-9]+', '_', 'g'), 1, 80) AS slug FROM documents""")
def identifiers(spark, sf):
    c = F.col
    d = B.table(spark, sf, "documents")
    odd = F.concat("source", F.lit(" *~/"), "lang")
    return d.select(
        "doc_id",
        T.page_id(c("source"), F.pmod("doc_id", F.lit(1000)).cast("int")).alias("page_id"),
        T.node_id("artifact", odd, c("doc_id")).alias("node_id"),
        T.text_hash(c("text")).alias("text_hash"),
        T.record_id(F.concat("lang", F.lit("-"), "source"), c("source"), c("lang")).alias("record_id"),
        T.slug(F.concat("lang", F.lit(" / "), "source")).alias("slug"),
    )


@query(r"""WITH n AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '(' || o_custkey || '.5)' WHEN 1 THEN '$' || o_custkey || ',000' WHEN 2 THEN o_custkey || ' %' ELSE 'n/a' END || CASE o_orderkey % 3 WHEN 0 THEN ' ' ELSE '' END AS raw,
  CASE o_orderkey % 5 WHEN 0 THEN 'percent of all' WHEN 1 THEN '3 hours' WHEN 2 THEN 'days' WHEN 3 THEN 'million' ELSE 'count' END AS said FROM orders)
SELECT o_orderkey, CASE WHEN starts_with(raw, '(') THEN -1 ELSE 1 END * TRY_CAST(regexp_replace(raw, '[(),%$\s]', '', 'g') AS DOUBLE) AS number,
  CASE WHEN contains(said, 'percent') THEN 'percent' WHEN contains(said, 'hour') THEN 'hours' WHEN contains(said, 'day') THEN 'days' WHEN contains(said, 'million') THEN 'scaled_number' ELSE 'numeric' END AS unit FROM n""")
def numbers_and_units(spark, sf):
    k, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    mod = lambda n: F.pmod(k, F.lit(n))
    raw = F.when(mod(4) == 0, F.concat(F.lit("("), cust, F.lit(".5)"))).when(mod(4) == 1, F.concat(F.lit("$"), cust, F.lit(",000"))).when(mod(4) == 2, F.concat(cust, F.lit(" %"))).otherwise("n/a")
    raw = F.concat(raw, F.when(mod(3) == 0, F.lit(" ")).otherwise(F.lit("")))
    said = F.when(mod(5) == 0, "percent of all").when(mod(5) == 1, "3 hours").when(mod(5) == 2, "days").when(mod(5) == 3, "million").otherwise("count")
    return B.table(spark, sf, "orders").select("o_orderkey", T.number_in(raw).alias("number"), T.unit_of(said).alias("unit"))


_ENT = "h"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _ENT = f"replace({_ENT}, '{_a}', '{_b}')"


@query(rf"""WITH a AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
  regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS h FROM pages)
SELECT page_id, title, trim(regexp_replace({_ENT}, '\s+', ' ', 'g')) AS text FROM a""")
def html_page_text(spark, sf):
    h = F.col("html")
    return B.table(spark, sf, "pages").select("page_id", X.html_title(h).alias("title"), X.html_text(h).alias("text"))


def _tok(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.QUESTION_STOPWORDS)
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '[a-zA-Z][a-zA-Z0-9]+'), lambda w: lower(w)), lambda w: length(w) > 2 AND w NOT IN ({stop})))"


def _covered(text: str) -> str:
    """Operands of ``required_operands`` that a lower-case text covers."""
    cases = " ".join(f"WHEN '{k}' THEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) for k, words in Q.OPERANDS.items())
    return f"list_sort(list_filter(required_operands, lambda o: CASE o {cases} ELSE contains({text}, o) END))"


def _norm(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def _missing(text: str) -> str:
    """Dimensions none of whose aliases a plain text names."""
    alias = f"replace({_norm('a')}, '-', ' ')"
    named = f"contains({text}, {alias}) OR (len(string_split({alias}, ' ')) > 1 AND len(list_filter(string_split({alias}, ' '), lambda w: NOT contains({text}, w))) = 0)"
    return f"list_transform(list_filter(dimensions, lambda d: len(list_filter(d.aliases, lambda a: {named})) = 0), lambda d: d.dimension)"


_NUMBERS = "'[-+]?\\d+(?:\\.\\d+)?\\s*%?'"
_SAID = "content || ' ' || coalesce(value_text, '') || ' ' || coalesce(row_label, '') || ' ' || coalesce(column_label, '')"
_FIELDS = ", ".join(f"""CASE WHEN {c} <> '' THEN '"{c}": "' || {c} || '"' END""" for c in ("column_label", "row_label", "value_text"))
_SUPPORT_SQL = f"""
su0 AS (SELECT key, dimensions, numbers_needed, coalesce(n_selected, 0) AS n_selected, coalesce(n_citable, 0) AS n_citable, {_norm("coalesce(said, '')")} AS said, {_norm("coalesce(page_text, '')")} AS page
  FROM asked LEFT JOIN (SELECT key, count(*) AS n_selected, count(*) FILTER (artifact_id <> '' AND page_index IS NOT NULL AND trim(content) <> '') AS n_citable, string_agg(ev, ' ' ORDER BY r) AS said FROM picked GROUP BY key) USING (key)),
su1 AS (SELECT *, replace(said, '-', ' ') AS pa, replace(said || ' ' || page, '-', ' ') AS pv, list_distinct(regexp_extract_all(said, {_NUMBERS})) AS na, list_distinct(regexp_extract_all(page, {_NUMBERS})) AS np FROM su0),
su2 AS (SELECT *, {_missing("pa")} AS artifact_missing, {_missing("pv")} AS visible_missing, len(na) AS n_numbers, len(list_distinct(list_concat(na, np))) AS n_visible FROM su1),
su3 AS (SELECT *, n_selected > 0 AND n_citable = n_selected AND len(artifact_missing) = 0 AND n_numbers >= numbers_needed AS sufficient, len(visible_missing) = 0 AND n_visible >= numbers_needed AS visible_sufficient FROM su2),
su4 AS (SELECT *, list_filter([CASE WHEN n_selected = 0 THEN 'no_selected_artifacts' END, CASE WHEN n_citable <> n_selected THEN 'selected_artifacts_not_all_citable' END,
  CASE WHEN len(artifact_missing) > 0 THEN 'artifact_missing_dimensions:' || array_to_string(artifact_missing, ',') END,
  CASE WHEN n_numbers < numbers_needed THEN 'artifact_numeric_values_below_required:' || n_numbers || '<' || numbers_needed END,
  CASE WHEN NOT visible_sufficient AND len(visible_missing) > 0 THEN 'visible_context_missing_dimensions:' || array_to_string(visible_missing, ',') END], lambda x: x IS NOT NULL) AS many FROM su3),
su AS (SELECT *, CASE WHEN len(many) > 0 THEN many ELSE ['none'] END AS failures FROM su4)"""
_EVIDENCE = f"artifact_id || ' ' || artifact_type || ' ' || substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, {Q.PREVIEW}) || ' {{' || array_to_string(list_filter([{_FIELDS}], lambda x: x IS NOT NULL), ', ') || '}}'"
_TAKES = "('exact_code_key_value_selection', 'operand_complete_selection', 'token_key_value_selection')"
_GUARDED = f"""{B.ARTIFACTS}, {D._PROFILE}, {B.CONTEXTS},
ga AS (SELECT doc_id, page_index, artifact_id, artifact_type, content, row_label, column_label, value_text, {_SAID} AS said, {_tok(_SAID)} AS atk, {_tok("coalesce(row_label, '') || ' ' || coalesce(column_label, '')")} AS kt, {_EVIDENCE} AS ev FROM art),
gj AS (SELECT pr.*, ga.* EXCLUDE (doc_id), len(list_intersect(q_tokens, atk)) AS ov, list_filter(codes, lambda c: regexp_matches(said, '(?i)(^|[^A-Za-z0-9])' || c || '([^A-Za-z0-9]|$)')) AS ch, len(ch) AS nc,
  len(list_filter(numbers, lambda n: contains(said, n))) AS nn, len(list_intersect(q_tokens, kt)) AS nk, {_norm("said")} AS ns FROM pr JOIN ga USING (doc_id)),
gs AS (SELECT *, round(ov + CASE WHEN (is_numeric OR is_code_or_table) AND artifact_type IN ('numeric_fact', 'table_cell', 'table') THEN 3.0 ELSE 0 END + CASE WHEN artifact_type IN ('numeric_fact', 'table_cell') THEN 1.0 ELSE 0 END
  + 5.0 * nc + 2.0 * nn + 1.5 * nk, 4) AS score, {_covered("ns")} AS oh, ov > 0 OR nk > 0 AS rel,
  CASE WHEN is_metadata THEN 'metadata' WHEN len(codes) > 0 THEN 'code' WHEN is_computation AND len(required_operands) > 0 THEN 'operands' ELSE 'tokens' END AS route FROM gj),
gp AS (SELECT query, count(*) FILTER (nc > 0) AS with_code, count(*) FILTER (rel) AS related, count(*) FILTER (rel OR nc > 0 OR len(oh) > 0) AS positive FROM gs GROUP BY query),
gb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, page_index, artifact_type, artifact_id) AS r FROM gs WHERE (route = 'code' AND nc > 0) OR route = 'operands' OR (route = 'tokens' AND rel)) WHERE r <= 8),
asked AS (SELECT query AS key, dimensions, numbers_needed, page_text FROM pr LEFT JOIN cx USING (query)), picked AS (SELECT *, query AS key FROM gb), {_SUPPORT_SQL},
gh AS (SELECT query, list_distinct(flatten(list(oh))) AS held FROM gb GROUP BY query),
gd0 AS (SELECT pr.*, coalesce(with_code, 0) AS with_code, coalesce(related, 0) AS related, coalesce(positive, 0) AS positive, coalesce(held, []) AS held, sufficient, failures, coalesce(page_text, '') AS page_text,
  CASE WHEN is_metadata THEN 'metadata' WHEN len(codes) > 0 THEN 'code' WHEN is_computation AND len(required_operands) > 0 THEN 'operands' ELSE 'tokens' END AS route
  FROM pr LEFT JOIN gp USING (query) LEFT JOIN gh USING (query) LEFT JOIN su ON su.key = pr.query LEFT JOIN cx USING (query)),
gd1 AS (SELECT *, list_sort(list_filter(required_operands, lambda o: NOT list_contains(held, o))) AS lacking, {_norm("page_text")} AS pn, {_covered(_norm("page_text"))} AS on_page FROM gd0),
gd AS (SELECT *, CASE WHEN route = 'metadata' THEN 'document_metadata_refusal_guard' WHEN route = 'code' AND with_code = 0 THEN 'exact_code_absence_guard' WHEN route = 'code' THEN 'exact_code_key_value_selection'
  WHEN route = 'operands' AND len(lacking) = 0 THEN 'operand_complete_selection' WHEN route = 'operands' AND len(on_page) = len(required_operands) THEN 'operand_page_evidence_route'
  WHEN route = 'operands' THEN 'operand_completeness_guard' WHEN related = 0 THEN 'no_relevant_artifact_guard' WHEN NOT sufficient THEN 'artifact_dimension_support_guard' ELSE 'token_key_value_selection' END AS decision FROM gd1),
gr AS (SELECT *, list_sort(list_distinct(CASE decision
  WHEN 'document_metadata_refusal_guard' THEN list_concat(['document_metadata_lookup_uses_page_text_not_numeric_artifacts'], CASE WHEN contains(pn, 'produced') OR contains(pn, 'revised') THEN ['visible_page_metadata_present'] ELSE [] END,
    list_transform(list_filter(numbers, lambda n: NOT contains(page_text, n)), lambda n: 'question_date_not_visible:' || n))
  WHEN 'exact_code_absence_guard' THEN ['no_artifact_contains_exact_question_code', 'numeric_artifacts_rejected_without_exact_code_key'] WHEN 'exact_code_key_value_selection' THEN ['selected_only_exact_code_artifacts']
  WHEN 'operand_complete_selection' THEN ['all_required_operands_covered']
  WHEN 'operand_page_evidence_route' THEN ['artifact_operand_completeness_failed', 'visible_page_operands_complete', 'missing_artifact_operands:' || array_to_string(lacking, ','), 'page_covered_operands:' || array_to_string(on_page, ',')]
  WHEN 'operand_completeness_guard' THEN ['operand_completeness_failed', 'missing_operands:' || array_to_string(lacking, ',')] WHEN 'no_relevant_artifact_guard' THEN ['no_question_overlapping_artifacts']
  WHEN 'artifact_dimension_support_guard' THEN list_concat(['selected_artifacts_do_not_cover_question_dimensions'], failures) ELSE ['selected_question_overlapping_artifacts'] END)) AS reasons FROM gd)"""


@query(f"""WITH {_GUARDED}, g AS (SELECT gb.query, count(*) AS n_selected, CAST(max(score) AS DOUBLE) AS best FROM gb JOIN gd USING (query) WHERE decision IN {_TAKES} GROUP BY gb.query)
SELECT query, decision, reasons, with_code, related, positive, n_selected, best FROM gr LEFT JOIN g USING (query)""")
def guarded_select(spark, sf):
    """The decision on each question, by nine rules, with its reasons and what it selects."""
    _, _, d, s = D._guarded(spark, sf)
    return d.drop("policy").join(s.groupBy("query").agg(F.count("*").alias("n_selected"), F.max("selection_score").alias("best")), "query", "left")


@query(f"""WITH {_GUARDED} SELECT key AS query, n_selected, n_citable, n_numbers, artifact_missing, visible_missing, sufficient, visible_sufficient, failures FROM su""")
def evidence_support(spark, sf):
    """Whether the best artifacts of each question, and its pages, name all that it asks for."""
    p = Q.profile(B.questions(spark, sf))
    c = Q.score_candidates(p, B.artifacts(spark, sf), ["doc_id"])
    return Q.support(Q.preselected(c, p, "query"), p, "query", B.contexts(spark, sf))


@query("""WITH t AS (SELECT * FROM (VALUES ('retrieval'), ('all')) a(scope), (VALUES (4), (8)) b(top_k), (VALUES ('lexical_only'), ('full_hybrid')) c(preset)) SELECT DISTINCT scope, top_k, preset FROM t WHERE NOT (scope = 'all' AND top_k = 8)""")
def experiment_specs(spark, sf):
    """All combinations of a few settings, less those that don't apply: three tables of two rows."""
    one = lambda v, n: spark.createDataFrame([(x,) for x in v], f"{n} {'int' if isinstance(v[0], int) else 'string'}")
    t = one(["retrieval", "all"], "scope").crossJoin(one([4, 8], "top_k")).crossJoin(one(["lexical_only", "full_hybrid"], "preset"))
    return t.filter(~((F.col("scope") == "all") & (F.col("top_k") == 8))).distinct()


@query(f"""WITH {B.POOLS}, r AS (SELECT * FROM ord WHERE rank <= 5)
SELECT count(*) AS n_rows, count(DISTINCT query) AS n_queries, round(avg(score), 4) AS mean_score, count(*) FILTER (score > 0) AS n_positive, round(count(*) FILTER (score > 0) / count(*), 6) AS positive_rate FROM r""")
def retrieval_report(spark, sf):
    r = R.bm25_topk(B.asked(spark, sf), B.items(spark, sf), 5)
    return r.agg(
        F.count("*").alias("n_rows"), F.count_distinct("query").alias("n_queries"), F.round(F.avg("score"), 4).alias("mean_score"), F.count_if(F.col("score") > 0).alias("n_positive"), P.rate(F.col("score") > 0, F.count("*")).alias("positive_rate")
    )
