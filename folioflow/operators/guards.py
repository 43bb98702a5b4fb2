"""Question profiles, guarded artifact selection, evidence skills, capsules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import compact, exact_codes, question_tokens, shortened, token_estimate

#: Fixed values.
NUMERIC_WORDS = ["percent", "percentage", "difference", "sum", "total", "ratio", "rate", "number", "amount", "value", "average"]
TABLE_WORDS = ["code", "table", "row", "column", "market"]
METADATA_TERMS = ["produced", "producer", "revised", "revision", "document", "version"]
METADATA_WORDS = ["revised", "produced", "producer", "document"]
COMPUTE_TERMS = ["difference", "sum", "total", "ratio", "rate", "percentage", "calculate"]
COMPUTE_WORDS = ["percentage difference", "return on asset", "round your answer"]
NUMERIC_TYPES = ["numeric_fact", "table_cell", "table"]
VISUAL_WORDS = ["figure", "fig", "chart", "image", "caption", "visual"]
LOOKUP_WORDS = ["what", "which", "who", "where", "name", "value"]
#: An operand is covered where one of its terms appears.
OPERANDS = {
    "older_age_group": ["older", "age", "25"],
    "children": ["children", "child", "k-12", "student"],
    "received_stem_degree": ["stem", "degree"],
    "employed_in_field": ["employed", "occupation", "field", "working"],
    "net_income": ["net income"],
    "total_assets": ["total assets", "assets"],
}
#: Skill -> (accepted artifact types, guard).
SKILLS = {
    "exact_code_lookup": (["code_name_pair", "table_cell", "key_value", "text_span"], "exact_code_absence_guard"),
    "key_value_lookup": (["key_value", "table_cell", "text_span"], "artifact_dimension_support_guard"),
    "table_numeric_lookup": (["table_cell", "numeric_fact", "key_value"], "artifact_dimension_support_guard"),
    "numeric_computation": (["numeric_fact", "table_cell"], "operand_completeness_guard"),
    "figure_caption_grounding": (["caption", "text_span"], "artifact_dimension_support_guard"),
    "text_span_grounding": (["text_span", "key_value", "caption"], "no_relevant_artifact_guard"),
}
#: Fixed values: (words, how many of them a question must hold, dimensions as (name, label, aliases), numbers needed).
REQUIREMENTS = [
    (["figure 4", "raptor"], 2, [
        ("figure_4", "figure 4", ["figure 4", "fig. 4", "fig 4"]),
        ("raptor", "RAPTOR", ["raptor"]),
        ("retrieved_nodes", "retrieved nodes", ["node", "nodes", "retrieved"]),
        ("both_questions", "both questions", ["both questions", "both"]),
    ], 0),
    (["higher-income", "higher income"], 1, [
        ("higher_income_seniors", "Higher-income seniors", ["higher-income seniors", "higher income seniors", "higher-income", "higher income"]),
        ("go_online", "go online", ["go online", "online"]),
        ("smartphone", "smartphone", ["smartphone"]),
        ("tablet_computer", "tablet computer", ["tablet computer", "tablet"]),
    ], 3),
    (["college graduate"], 1, [
        ("age_65_plus", "65+ people", ["65+", "65 +", "65 and older", "65 or older"]),
        ("college_graduate", "College graduate", ["college graduate", "college"]),
        ("cell_phone", "cell phone", ["cell phone", "cellphone"]),
        ("tablet_computer", "tablet computer", ["tablet computer", "tablet"]),
        ("gap_operation", "gap", ["gap", "difference"]),
    ], 2),
]
#: Operands that a question needs where it holds all words of one of the lists.
NEEDED = [
    ("older_age_group", [["older"]]),
    ("children", [["children"]]),
    ("received_stem_degree", [["received", "stem", "degree"]]),
    ("employed_in_field", [["employed", "field"]]),
    ("net_income", [["net income"], ["return on asset"], ["roa"]]),
    ("total_assets", [["net income"], ["return on asset"], ["roa"]]),
]
#: Terms of a question that stand for its dimensions where no rule and no year does; characters of a preview.
MOST_TERMS, PREVIEW = 8, 300
#: Decision -> how to answer.
POLICIES = {
    "document_metadata_refusal_guard": "refuse_if_visible_metadata_mismatches_question",
    "exact_code_absence_guard": "use_page_evidence_for_absence_or_refuse",
    "exact_code_key_value_selection": "answer_only_if_exact_code_value_pair_supports_it",
    "operand_page_evidence_route": "calculate_from_visible_page_evidence_when_operands_are_cited",
    "operand_completeness_guard": "not_answerable_due_to_incomplete_operands",
    "operand_complete_selection": "calculate_only_from_cited_operands",
    "artifact_dimension_support_guard": "use_page_evidence_or_refuse",
    "token_key_value_selection": "cite_visible_support_or_refuse",
    "no_relevant_artifact_guard": "use_page_evidence_or_refuse",
}


def _any_word(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def required_operands(text: Column) -> Column:
    """Names of the operands that a question needs, sorted."""
    norm = F.lower(compact(text))
    every = lambda words: reduce(lambda x, y: x & y, [norm.contains(w) for w in words])
    hit = [F.when(reduce(lambda x, y: x | y, map(every, lists)), F.lit(name)) for name, lists in NEEDED]
    return F.array_sort(F.array_compact(F.array(*hit)))


_DIMENSION = "array<struct<dimension:string,label:string,aliases:array<string>>>"


def requirements(text: Column, tokens: Column) -> tuple[Column, Column]:
    """(dimensions that evidence for a question must name, distinct numbers that it must hold)."""
    norm, none = F.lower(compact(text)), F.array().cast(_DIMENSION)
    lits = lambda words: F.array(*map(F.lit, words))
    parts, numbers = [], F.lit(0)
    for words, least, dims, needed in REQUIREMENTS:
        hit = sum((norm.contains(w).cast("int") for w in words), F.lit(0)) >= least
        rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(label).alias("label"), lits(aliases).alias("aliases")) for d, label, aliases in dims])
        parts.append(F.when(hit, rows).otherwise(none))
        numbers = F.greatest(numbers, F.when(hit, needed).otherwise(0))
    one = lambda prefix, x: F.struct(F.concat(F.lit(prefix), x).alias("dimension"), x.alias("label"), F.array(x).alias("aliases"))
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0)), lambda y: one("year_", y))
    known = F.concat(*parts, years)
    terms = F.transform(F.slice(tokens, 1, MOST_TERMS), lambda t: one("term_", t))
    return first_of(F.when(F.size(known) > 0, known).otherwise(terms)), numbers


def first_of(dimensions: Column) -> Column:
    """Each dimension once, the first."""
    return F.filter(dimensions, lambda x, i: F.array_position(F.transform(dimensions, lambda y: y["dimension"]), x["dimension"]) == i + 1)


def profile(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds q_tokens, codes, numbers, is_numeric, is_code_or_table, is_metadata, is_computation, required_operands, dimensions, numbers_needed."""
    q = F.col(text)
    norm = F.lower(compact(q))
    out = questions.withColumns(
        {
            "q_tokens": F.array_sort(question_tokens(q)),
            "codes": F.array_sort(exact_codes(q)),
            "numbers": F.regexp_extract_all(q, F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0)),
            "required_operands": required_operands(q),
        }
    )
    has = lambda words: F.arrays_overlap("q_tokens", F.array(*[F.lit(w) for w in words]))
    dimensions, needed = requirements(q, F.col("q_tokens"))
    return out.withColumns(
        {
            "is_numeric": _any_word(norm, NUMERIC_WORDS) | (F.size("numbers") > 0),
            "is_code_or_table": (F.size("codes") > 0) | _any_word(norm, TABLE_WORDS),
            "is_metadata": has(METADATA_TERMS) & _any_word(norm, METADATA_WORDS),
            "is_computation": has(COMPUTE_TERMS) | _any_word(norm, COMPUTE_WORDS),
            "dimensions": dimensions,
            "numbers_needed": needed,
        }
    )


def phrase_present(text: Column, phrase: Column) -> Column:
    """The phrase stands in the text, or all of its several words do."""
    t, p = (F.replace(F.lower(compact(c)), F.lit("-"), F.lit(" ")) for c in (text, phrase))
    words = F.split(p, " ")
    return t.contains(p) | ((F.size(words) > 1) & F.forall(words, lambda w: t.contains(w)))


def plain(text: Column) -> Column:
    """The form in which phrases are looked for."""
    return F.replace(F.lower(compact(text)), F.lit("-"), F.lit(" "))


def dimension_checks(dimensions: Column, plain_text: Column) -> Column:
    """For each dimension the aliases that a :func:`plain` text names: whole, or by all of their several words."""

    def named(alias: Column) -> Column:
        p = plain(alias)
        words = F.split(p, " ")
        return plain_text.contains(p) | ((F.size(words) > 1) & F.forall(words, lambda w: plain_text.contains(w)))

    return F.transform(dimensions, lambda d: F.struct(d["dimension"].alias("dimension"), F.filter(d["aliases"], named).alias("matched")))


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text, percent signs kept."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[-+]?\d+(?:\.\d+)?\s*%?"), F.lit(0))))


def evidence_text() -> Column:
    """What an artifact brings as evidence: id, type, the start of its content, its filled fields."""
    fields = [F.when(F.col(c) != "", F.concat(F.lit(f'"{c}": "'), F.col(c), F.lit('"'))) for c in ("column_label", "row_label", "value_text")]
    shown = F.substring(compact(F.coalesce("content", F.lit(""))), 1, PREVIEW)
    return F.concat_ws(" ", "artifact_id", "artifact_type", shown, F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ", "), F.lit("}")))


def support(selected: DataFrame, profiles: DataFrame, key: str, contexts: DataFrame | None = None, rank: str = "selection_rank") -> DataFrame:
    """(key, n_selected, n_citable, n_numbers, artifact_missing, visible_missing, sufficient, visible_sufficient, failures): whether the
    selected artifacts are citable, name all dimensions of a question and hold enough numbers; and whether they do with the page texts.

    ``contexts``: (key, page_text).
    """
    citable = (F.col("artifact_id") != "") & F.col("page_index").isNotNull() & (compact(F.coalesce("content", F.lit(""))) != "")
    g = selected.groupBy(key).agg(
        F.count("*").alias("n_selected"),
        F.count_if(citable).alias("n_citable"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), evidence_text().alias("t")))), lambda x: x["t"]), " ").alias("_said"),
    )
    d = profiles.select(key, "dimensions", "numbers_needed").join(g, key, "left").na.fill(0, ["n_selected", "n_citable"])
    d = d.join(contexts.select(key, "page_text"), key, "left") if contexts is not None else d.withColumn("page_text", F.lit(""))
    said, page = F.lower(compact(F.coalesce("_said", F.lit("")))), F.lower(compact(F.coalesce("page_text", F.lit(""))))
    d = d.select(key, "dimensions", "numbers_needed", "n_selected", "n_citable", said.alias("_said"), page.alias("_page"))
    missing = lambda text: F.transform(F.filter(dimension_checks(F.col("dimensions"), text), lambda c: F.size(c["matched"]) == 0), lambda c: c["dimension"])
    d = d.withColumns({"_a": plain(F.col("_said")), "_v": plain(F.concat_ws(" ", "_said", "_page"))})
    d = d.withColumns(
        {
            "artifact_missing": missing(F.col("_a")),
            "visible_missing": missing(F.col("_v")),
            "n_numbers": F.size(numbers_in(F.col("_said"))),
            "_n_visible": F.size(F.array_union(numbers_in(F.col("_said")), numbers_in(F.col("_page")))),
        }
    )
    sufficient = (F.col("n_selected") > 0) & (F.col("n_citable") == F.col("n_selected")) & (F.size("artifact_missing") == 0) & (F.col("n_numbers") >= F.col("numbers_needed"))
    visible = (F.size("visible_missing") == 0) & (F.col("_n_visible") >= F.col("numbers_needed"))
    d = d.withColumns({"sufficient": sufficient, "visible_sufficient": visible})
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ",")))
    failures = F.array_compact(
        F.array(
            F.when(F.col("n_selected") == 0, "no_selected_artifacts"),
            F.when(F.col("n_citable") != F.col("n_selected"), "selected_artifacts_not_all_citable"),
            listed("artifact_missing_dimensions:", "artifact_missing"),
            F.when(F.col("n_numbers") < F.col("numbers_needed"), F.format_string("artifact_numeric_values_below_required:%d<%d", "n_numbers", "numbers_needed")),
            F.when(~F.col("visible_sufficient"), listed("visible_context_missing_dimensions:", "visible_missing")),
        )
    )
    d = d.withColumn("failures", F.when(F.size(failures) > 0, failures).otherwise(F.array(F.lit("none"))))
    return d.select(key, "n_selected", "n_citable", "n_numbers", "artifact_missing", "visible_missing", "sufficient", "visible_sufficient", "failures")


def operand_covered(text: Column, operand: str) -> Column:
    return _any_word(F.lower(compact(text)), OPERANDS.get(operand, [operand]))


def score_candidates(profiles: DataFrame, artifacts: DataFrame, on: list[str]) -> DataFrame:
    """Candidates of each question with n_overlap, n_codes, n_keys and selection_score.

    Tokens of an artifact are made once, before the join.
    """
    said = F.concat_ws(" ", "content", F.coalesce("value_text", F.lit("")), F.coalesce("row_label", F.lit("")), F.coalesce("column_label", F.lit("")))
    a = artifacts.withColumn("said", said)
    keys = F.concat_ws(" ", F.coalesce("row_label", F.lit("")), F.coalesce("column_label", F.lit("")))
    a = a.withColumn("a_tokens", question_tokens(F.col("said"))).withColumn("k_tokens", question_tokens(keys))
    j = profiles.join(a, on)
    code = lambda c: F.regexp_like(F.col("said"), F.concat(F.lit(r"(?i)(^|[^A-Za-z0-9])"), c, F.lit(r"([^A-Za-z0-9]|$)")))
    j = j.withColumns(
        {
            "n_overlap": F.size(F.array_intersect("q_tokens", "a_tokens")),
            "code_hits": F.filter("codes", code),
            "n_codes": F.size(F.filter("codes", code)),
            "n_numbers": F.size(F.filter("numbers", lambda n: F.col("said").contains(n))),
            "n_keys": F.size(F.array_intersect("q_tokens", "k_tokens")),
            "operand_hits": operand_hits(F.col("required_operands"), F.col("said")),
        }
    )
    t = F.col("artifact_type")
    score = (
        F.col("n_overlap")
        + F.when((F.col("is_numeric") | F.col("is_code_or_table")) & t.isin(NUMERIC_TYPES), 3.0).otherwise(0.0)
        + F.when(t.isin("numeric_fact", "table_cell"), 1.0).otherwise(0.0)
        + 5.0 * F.col("n_codes")
        + 2.0 * F.col("n_numbers")
        + 1.5 * F.col("n_keys")
    )
    for flag, weight in (("on_reranked_page", 1.0), ("on_original_page", 0.25)):
        if flag in artifacts.columns:
            score = score + F.when(F.col(flag), weight).otherwise(0.0)
    if "source_anchored" in artifacts.columns:
        score = score - F.when(~F.col("source_anchored"), 2.0).otherwise(0.0)
    return j.withColumn("selection_score", F.round(score.cast("double"), 4))


def routed(profiles: DataFrame) -> DataFrame:
    """Adds route: what a question's selection goes by."""
    by_operands = F.col("is_computation") & (F.size("required_operands") > 0)
    return profiles.withColumn("route", F.when(F.col("is_metadata"), "metadata").when(F.size("codes") > 0, "code").when(by_operands, "operands").otherwise("tokens"))


def preselected(candidates: DataFrame, profiles: DataFrame, key: str, most: int = 8) -> DataFrame:
    """The best artifacts of each question among those that its route admits, with selection_rank."""
    related = (F.col("n_overlap") > 0) | (F.col("n_keys") > 0)
    fit = F.when(F.col("route") == "code", F.col("n_codes") > 0).when(F.col("route") == "operands", F.lit(True)).when(F.col("route") == "tokens", related)
    w = Window.partitionBy(key).orderBy(F.desc("selection_score"), "page_index", "artifact_type", "artifact_id")
    best = candidates.join(routed(profiles).select(key, "route"), key).filter(F.coalesce(fit, F.lit(False)))
    return best.withColumn("selection_rank", F.row_number().over(w)).filter(F.col("selection_rank") <= most)


def decide(candidates: DataFrame, profiles: DataFrame, key: str, most: int = 8, contexts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions, selected): one decision a question, with its reasons, and its artifacts in rank order.

    Document questions take page text; questions for exact codes take only artifacts that hold one; computations need all
    their operands among the best artifacts, or else on the pages; others take what shares a token or key with them, if
    that supports all that the question asks for. ``contexts``: (key, page_text).
    """
    p = routed(profiles)
    related = (F.col("n_overlap") > 0) | (F.col("n_keys") > 0)
    per = candidates.groupBy(key).agg(
        F.count_if(F.col("n_codes") > 0).alias("with_code"),
        F.count_if(related).alias("related"),
        F.count_if(related | (F.col("n_codes") > 0) | (F.size("operand_hits") > 0)).alias("positive"),
    )
    best = preselected(candidates, profiles, key, most)
    held = best.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("operand_hits"))).alias("held"))
    checked = support(best, profiles, key, contexts).select(key, "sufficient", "failures")
    d = p.join(per, key, "left").na.fill(0, ["with_code", "related", "positive"]).join(held, key, "left").join(checked, key, "left")
    d = d.join(contexts.select(key, "page_text"), key, "left") if contexts is not None else d.withColumn("page_text", F.lit(""))
    none, page = F.array().cast("array<string>"), F.coalesce("page_text", F.lit(""))
    d = d.withColumns(
        {
            "lacking": F.array_sort(F.array_except("required_operands", F.coalesce("held", none))),
            "on_page": operand_hits(F.col("required_operands"), page),
        }
    )
    whole_page = F.size(F.array_except("required_operands", "on_page")) == 0
    code, operands = F.col("route") == "code", F.col("route") == "operands"
    decision = (
        F.when(F.col("route") == "metadata", "document_metadata_refusal_guard")
        .when(code & (F.col("with_code") == 0), "exact_code_absence_guard")
        .when(code, "exact_code_key_value_selection")
        .when(operands & (F.size("lacking") == 0), "operand_complete_selection")
        .when(operands & whole_page, "operand_page_evidence_route")
        .when(operands, "operand_completeness_guard")
        .when(F.col("related") == 0, "no_relevant_artifact_guard")
        .when(~F.col("sufficient"), "artifact_dimension_support_guard")
        .otherwise("token_key_value_selection")
    )
    d = d.withColumn("decision", decision)
    said, norm = page, F.lower(compact(page))
    joined = lambda label, c: F.concat(F.lit(label), F.array_join(c, ","))
    unseen = F.transform(F.filter("numbers", lambda n: ~said.contains(n)), lambda n: F.concat(F.lit("question_date_not_visible:"), n))
    dated = F.when(norm.contains("produced") | norm.contains("revised"), F.array(F.lit("visible_page_metadata_present"))).otherwise(none)
    lits = lambda *x: F.array(*map(F.lit, x))
    reasons = {
        "document_metadata_refusal_guard": F.concat(lits("document_metadata_lookup_uses_page_text_not_numeric_artifacts"), dated, unseen),
        "exact_code_absence_guard": lits("no_artifact_contains_exact_question_code", "numeric_artifacts_rejected_without_exact_code_key"),
        "exact_code_key_value_selection": lits("selected_only_exact_code_artifacts"),
        "operand_complete_selection": lits("all_required_operands_covered"),
        "operand_page_evidence_route": F.concat(
            lits("artifact_operand_completeness_failed", "visible_page_operands_complete"), F.array(joined("missing_artifact_operands:", "lacking"), joined("page_covered_operands:", "on_page"))
        ),
        "operand_completeness_guard": F.concat(lits("operand_completeness_failed"), F.array(joined("missing_operands:", "lacking"))),
        "no_relevant_artifact_guard": lits("no_question_overlapping_artifacts"),
        "artifact_dimension_support_guard": F.concat(lits("selected_artifacts_do_not_cover_question_dimensions"), F.coalesce("failures", none)),
        "token_key_value_selection": lits("selected_question_overlapping_artifacts"),
    }
    because = F.coalesce(*[F.when(F.col("decision") == k, v) for k, v in reasons.items()])
    policy = F.create_map(*[F.lit(v) for pair in POLICIES.items() for v in pair])[F.col("decision")]
    d = d.select(key, "decision", F.array_sort(F.array_distinct(because)).alias("reasons"), policy.alias("policy"), "with_code", "related", "positive")
    takes = ["exact_code_key_value_selection", "operand_complete_selection", "token_key_value_selection"]
    return d, best.join(d.filter(F.col("decision").isin(takes)).select(key, "decision"), key).drop("route")


def preview(questions: DataFrame, artifacts: DataFrame, contexts: DataFrame, key: str, enabled: bool = False, text: str = "question") -> DataFrame:
    """``questions`` with what guarded selection would give them: decision, reasons, selected ids, page text. Off unless enabled: then they come back as they are."""
    if not enabled:
        return questions
    p = profile(questions, text)
    d, s = decide(score_candidates(p, artifacts, ["doc_id"]), p, key, contexts=contexts)
    ids = s.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("selection_rank", "artifact_id"))), lambda x: x["artifact_id"]).alias("selected"))
    shown = contexts.select(key, "page_text")
    return questions.join(d.select(key, "decision", "reasons", "policy"), key, "left").join(ids, key, "left").join(shown, key, "left").withColumn("page_text", F.coalesce("page_text", F.lit("")))


def skills(profiles: DataFrame, text: str = "question") -> DataFrame:
    """Adds skills: the evidence skills that a question activates, in order, each once."""
    q = F.lower(text)
    code, compute = F.size("codes") > 0, F.col("is_computation") & (F.size("required_operands") > 0)
    numeric = (F.col("is_numeric") | F.col("is_code_or_table")) & ~code & ~compute
    visual = _any_word(q, VISUAL_WORDS)
    lookup = _any_word(q, LOOKUP_WORDS) & ~code & ~compute & ~numeric & ~visual
    none = ~code & ~compute & ~numeric & ~visual & ~lookup
    names = [
        ("exact_code_lookup", code), ("numeric_computation", compute), ("table_numeric_lookup", numeric),
        ("figure_caption_grounding", visual), ("key_value_lookup", lookup), ("text_span_grounding", none),
    ]
    return profiles.withColumn("skills", F.array_compact(F.array(*[F.when(ok, F.lit(n)) for n, ok in names])))


def operand_hits(required: Column, text: Column) -> Column:
    def covered(o: Column) -> Column:
        out = F.lower(compact(text)).contains(o)
        for name in OPERANDS:
            out = F.when(o == name, operand_covered(text, name)).otherwise(out)
        return out

    return F.array_sort(F.filter(required, covered))


def capsule_line(most_chars: int = 180) -> Column:
    """One unit of a capsule: id, page, type, codes, operands, fields and shortened text, as far as they are there."""
    field = lambda c: F.when(F.col(c) != "", F.concat(F.lit(f"{c}="), F.col(c)))
    some = lambda label, found, sep: F.when(F.size(found) > 0, F.concat(F.lit(label), F.array_join(found, sep)))
    text = shortened(compact(F.coalesce("content", F.lit(""))), most_chars)
    return F.concat_ws(
        " | ",
        F.concat(F.lit("- id="), "artifact_id"),
        F.concat(F.lit("page="), F.col("page_index").cast("string")),
        F.concat(F.lit("type="), "artifact_type"),
        some("codes=", F.col("code_hits"), ","),
        some("operands=", F.col("operand_hits"), ","),
        some("fields=", F.array_compact(F.array(*[field(c) for c in ("row_label", "column_label", "value_text")])), ";"),
        F.when(text != "", F.concat(F.lit("text="), text)),
    )


def capsules(profiles: DataFrame, candidates: DataFrame, decisions: DataFrame, selected: DataFrame, key: str, text: str = "question", most: int = 4) -> DataFrame:
    """(key, capsule, capsule_tokens, unit_source) of every question: skills, guard, units, missing requirements, a trace of each skill.

    Units are the first of the selected artifacts or, where none is selected, the best candidates of the types that the
    question's skills accept.
    """
    p = skills(profiles, text).select(key, "skills", "codes", F.col("required_operands").alias("required"))
    accepted = F.array_distinct(F.flatten(F.array(*[F.when(F.array_contains("skills", s), F.array(*map(F.lit, types))).otherwise(F.array().cast("array<string>")) for s, (types, _) in SKILLS.items()])))
    p = p.join(decisions.select(key, "decision"), key).withColumn("accepted", accepted)
    of = lambda s: F.col("artifact_type").isin(SKILLS[s][0])
    found = lambda s, c: F.array_distinct(F.flatten(F.collect_list(F.when(of(s), F.col(c)))))
    made = candidates.groupBy(key).agg(*[F.count_if(of(s)).alias(f"made_{s}") for s in SKILLS])
    chosen = selected
    took = chosen.groupBy(key).agg(
        F.count("*").alias("taken"),
        *[F.count_if(of(s)).alias(f"took_{s}") for s in SKILLS],
        found("exact_code_lookup", "code_hits").alias("found_codes"),
        found("numeric_computation", "operand_hits").alias("found_operands"),
    )
    w = Window.partitionBy(key).orderBy(F.desc("selection_score"), "page_index", "artifact_id")
    without = p.join(selected.select(key).distinct(), key, "left_anti").select(key, "required", "accepted")
    rest = candidates.join(without, key).filter(F.array_contains("accepted", F.col("artifact_type")))
    rest = rest.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    unit = lambda df, place: df.select(key, F.struct(F.col(place).alias("place"), capsule_line().alias("line")).alias("unit"))
    units = unit(chosen.filter(F.col("selection_rank") <= most), "selection_rank").unionByName(unit(rest, "place"))
    units = units.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("unit")), lambda x: x["line"]).alias("units"))
    j = p.join(made, key, "left").join(took, key, "left").join(units, key, "left")
    none = F.array().cast("array<string>")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    has = lambda s: F.array_contains("skills", s)
    lacks = lambda asked, got, label: F.transform(F.array_except(asked, F.coalesce(got, none)), lambda x: F.concat(F.lit(label), x))
    unmet = F.lit(False)
    for s in SKILLS:
        unmet = unmet | (has(s) & (count(f"took_{s}") == 0))
    missing = F.array_sort(
        F.array_distinct(
            F.concat(
                F.when(has("exact_code_lookup"), lacks("codes", F.col("found_codes"), "exact_code:")).otherwise(none),
                F.when(has("numeric_computation") & (F.col("decision") != "operand_page_evidence_route"), lacks("required", F.col("found_operands"), "operand:")).otherwise(none),
                F.when(F.col("decision").isin("artifact_dimension_support_guard", "no_relevant_artifact_guard") & unmet, F.array(F.lit("selected_supporting_artifact"))).otherwise(none),
            )
        )
    )
    trace = {s: F.format_string(f"Trace: skill={s}; candidates=%d; selected=%d; guard={guard}", count(f"made_{s}"), count(f"took_{s}")) for s, (_, guard) in SKILLS.items()}
    traces = F.transform("skills", lambda x: F.coalesce(*[F.when(x == s, line) for s, line in trace.items()]))
    policy = F.create_map(*[F.lit(v) for pair in POLICIES.items() for v in pair])[F.col("decision")]
    head = F.array(F.lit("[Evidence Capsule]"), F.concat(F.lit("Skills: "), F.array_join("skills", ", ")), F.concat(F.lit("Guard: "), "decision", F.lit("; policy: "), policy))
    body = F.when(F.col("units").isNotNull(), F.concat(F.array(F.lit("Evidence:")), "units")).otherwise(F.array(F.lit("Evidence: none selected")))
    lack = F.when(F.size("missing") > 0, F.array(F.concat(F.lit("Missing: "), F.array_join("missing", ", ")))).otherwise(none)
    out = j.withColumn("missing", missing).withColumn("capsule", F.concat(F.array_join(F.concat(head, body, lack, traces), "\n"), F.lit("\n")))
    source = F.when(F.col("taken") > 0, "selected_artifacts").otherwise("top_accepted_candidates")
    return out.select(key, "capsule", token_estimate(F.col("capsule")).alias("capsule_tokens"), source.alias("unit_source"))
