"""Questions as demands: literals and types, parsed responses, normalised evidence demands and their merge into profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import compact, exact_codes, question_tokens, slug
from folioflow.operators import guards as Q
from folioflow.operators.responses import first_object

#: Fixed values.
NUMERIC_TABLE_TERMS = [
    "table", "code", "value", "number", "percent", "percentage", "difference", "total", "ratio", "rate", "market", "metric", "score", "amount", "year",
    "fy", "q1", "q2", "q3", "q4", "round", "average",
]
KEY_VALUE_TERMS = ["what is", "what's", "which", "who", "where", "name", "market", "code", "value"]
CODE_LOOKUP_TERMS = ["code", "eps code", "market", "geographic market", "designated area", "segment", "row", "column"]
METRIC_PHRASES = [
    "gross profit", "net income", "total assets", "current liabilities", "total liabilities", "capital expenditure", "cash flow", "geographic market name",
    "f1", "ap50", "ebitda", "cash ratio", "current ratio", "quick ratio",
]
ANSWER_TYPES = ["numeric_comparison", "metadata_lookup", "table_lookup", "visual_caption", "computation", "not_answerable_sensitive", "general_fact_lookup"]
GENERAL = "general_fact_lookup"
MOST_DIMENSIONS, MOST_STRINGS, MOST_CHARS = 12, 20, 120
_CODE = r"\b[A-Z]{1,4}\d{1,4}\b"
_DEMAND = (
    "answer_type string, required_entities array<string>, required_metrics array<string>, required_values_or_codes array<string>, required_operands array<string>, "
    "evidence_dimensions array<struct<dimension:string,label:string,aliases:array<string>>>, min_numeric_values int, requires_exact_code_selection boolean, "
    "is_document_metadata_lookup boolean, is_computation_question boolean, is_numeric_or_table_question boolean"
)


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def code_literals(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_CODE})"), F.lit(1))))


def literals(question: Column) -> Column:
    """A question's literals by kind, each kind sorted and distinct."""
    norm = F.lower(compact(question))
    every = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(question, F.lit(p), F.lit(1))))
    quoted = F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(question, F.lit("[\"']([^\"']{2,80})[\"']"), F.lit(1)), F.trim), lambda x: x != "")))
    phrases = F.array_compact(F.array(*[F.when(norm.contains(p), F.lit(p)) for p in sorted(METRIC_PHRASES)]))
    return F.struct(
        code_literals(question).alias("codes"), F.array_sort(exact_codes(question)).alias("actionable_codes"), every(r"\b((?:19|20)\d{2})\b").alias("years"), every(r"([-+]?\d+(?:\.\d+)?)").alias("numbers"),
        quoted.alias("quoted"), phrases.alias("metric_phrases"),
    )


def literal_present(text: Column, literal: Column) -> Column:
    """Codes and numbers stand as words of a text; other literals anywhere in its normal form."""
    exact = literal.rlike(rf"^(?:[A-Z]{{1,4}}\d{{1,4}}|\d+(?:\.\d+)?)$")
    word = F.regexp_like(text, F.concat(F.lit(r"(?i)(^|[^A-Za-z0-9])"), F.replace(literal, F.lit("."), F.lit(r"\.")), F.lit(r"([^A-Za-z0-9]|$)")))
    return F.when(literal == "", F.lit(False)).when(exact, word).otherwise(F.lower(compact(text)).contains(F.lower(compact(literal))))


def question_types(question: Column, codes: Column, is_numeric: Column, is_code_or_table: Column, is_computation: Column) -> Column:
    """Types of a question, in order; general where none fits."""
    norm = F.lower(compact(question))
    found = F.array_compact(
        F.array(
            F.when(F.size(code_literals(question)) > 0, "code_like_literal"),
            F.when((F.size(codes) > 0) & _any(norm, CODE_LOOKUP_TERMS), "exact_code_lookup"),
            F.when(_any(norm, NUMERIC_TABLE_TERMS) | is_numeric | is_code_or_table, "table_numeric"),
            F.when(_any(norm, KEY_VALUE_TERMS), "key_value_lookup"),
            F.when(is_computation, "computation"),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def json_body(text: Column) -> Column:
    """The first object of a response; null where there is none."""
    return first_object(text)["object"]


def parse_failure(text: Column) -> Column:
    """Why a response holds no object: null where it does."""
    failure, known = first_object(text)["failure"], F.coalesce(text, F.lit(""))
    return F.when(failure.isin("json_object_not_found", "json_like_block_absent") & (known.contains("{") | known.contains("[")), "json_object_not_found").otherwise(failure)


def clean_strings(values: Column) -> Column:
    """Strings compacted, empty ones dropped, each once by its lower-case form, cut in length and number."""
    texts = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), compact), lambda x: x != "")
    lower = F.transform(texts, F.lower)
    once = F.filter(texts, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)
    return F.slice(F.transform(once, lambda x: F.substring(x, 1, MOST_CHARS)), 1, MOST_STRINGS)


def clean_dimensions(values: Column) -> Column:
    """Dimensions named by a slug, each once, cut in number; the label or else the name stands for missing aliases."""
    name = lambda d: F.regexp_replace(slug(F.trim(F.coalesce(d["dimension"], d["label"], F.lit("")))), "^_+|_+$", "")
    label = lambda d: F.trim(F.coalesce(F.when(d["label"] != "", d["label"]), d["dimension"], F.lit("")))

    def one(d: Column) -> Column:
        own = clean_strings(d["aliases"])
        return F.struct(name(d).alias("dimension"), F.when(label(d) != "", label(d)).otherwise(name(d)).alias("label"), F.when(F.size(own) > 0, own).otherwise(F.filter(F.array(label(d)), lambda x: x != "")).alias("aliases"))

    rows = F.filter(F.transform(F.coalesce(values, F.array().cast(Q._DIMENSION)), one), lambda d: d["dimension"] != "")
    return F.slice(Q.first_of(rows), 1, MOST_DIMENSIONS)


def normalised(responses: DataFrame, text: str = "response") -> DataFrame:
    """Adds demand: a parsed and normalised evidence demand; null where the response holds none. A code among the demanded values makes it a table look-up."""
    out = responses.withColumn("_d", F.from_json(json_body(F.col(text)), _DEMAND))
    yes = lambda c: F.coalesce(F.col(f"_d.{c}"), F.lit(False))
    kind = F.lower(F.trim(F.coalesce("_d.answer_type", F.lit(GENERAL))))
    out = out.withColumn("_k", F.when(kind.isin(ANSWER_TYPES), kind).otherwise(GENERAL))
    lists = {c: clean_strings(F.col(f"_d.{c}")) for c in ("required_entities", "required_metrics", "required_values_or_codes", "required_operands")}
    out = out.withColumn("_l", F.struct(*[v.alias(k) for k, v in lists.items()], clean_dimensions(F.col("_d.evidence_dimensions")).alias("evidence_dimensions")))
    out = out.withColumn("_codes", exact_codes(F.concat_ws(" ", F.array_join("_l.required_values_or_codes", " "), F.array_join("_l.required_entities", " "))))
    code = F.size("_codes") > 0
    compute = yes("is_computation_question") | F.col("_k").isin("computation", "numeric_comparison")
    least = F.greatest(F.lit(0), F.coalesce("_d.min_numeric_values", F.lit(0)))
    demand = F.struct(
        F.when(code, "table_lookup").otherwise(F.col("_k")).alias("answer_type"), "_l.*", F.when(compute, F.greatest(F.lit(2), least)).otherwise(least).alias("min_numeric_values"), code.alias("requires_exact_code_selection"),
        ((yes("is_document_metadata_lookup") | (F.col("_k") == "metadata_lookup")) & ~code).alias("is_document_metadata_lookup"), compute.alias("is_computation_question"),
        (code | yes("is_numeric_or_table_question") | F.col("_k").isin("numeric_comparison", "table_lookup", "computation")).alias("is_numeric_or_table_question"),
    )
    return out.withColumn("demand", F.when(F.col("_d").isNotNull(), demand)).drop("_d", "_k", "_l", "_codes")


def merged(profiles: DataFrame) -> DataFrame:
    """Profiles with a ``demand`` (from :func:`normalised`) worked in: more tokens, codes, numbers and operands, its dimensions in place of the rules'."""
    d = lambda c: F.col(f"demand.{c}")
    joined = lambda c: F.array_join(d(c), " ")
    dims = F.array_join(F.transform(d("evidence_dimensions"), lambda x: F.concat_ws(" ", x["label"], F.array_join(x["aliases"], " "))), " ")
    out = profiles.withColumn("_extra", F.concat_ws(" ", joined("required_entities"), joined("required_metrics"), joined("required_values_or_codes"), dims))
    both = lambda a, b: F.array_sort(F.array_union(a, F.coalesce(b, F.array().cast("array<string>"))))
    some = F.coalesce(F.size(d("evidence_dimensions")) > 0, F.lit(False))
    yes = lambda c: F.coalesce(d(c), F.lit(False))
    return out.withColumns(
        {
            "q_tokens": both("q_tokens", question_tokens(F.col("_extra"))),
            "codes": both("codes", exact_codes(F.col("_extra"))),
            "numbers": both(F.array_distinct("numbers"), F.regexp_extract_all("_extra", F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0))),
            "required_operands": both("required_operands", d("required_operands")),
            "numbers_needed": F.when(some, F.greatest("numbers_needed", d("min_numeric_values"))).otherwise(F.col("numbers_needed")),
            "dimensions": F.when(some, d("evidence_dimensions")).otherwise(F.col("dimensions")),
            "is_numeric": F.col("is_numeric") | yes("is_numeric_or_table_question"),
            "is_metadata": F.col("is_metadata") | yes("is_document_metadata_lookup"),
            "is_computation": F.col("is_computation") | yes("is_computation_question"),
        }
    ).drop("_extra")
