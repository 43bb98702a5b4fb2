"""Quality rules (op6): a threshold table compiled into one projection of built-in expressions.

``THRESHOLDS`` lists (rule, metric, lowest, highest). :func:`compile_rules` folds it into a single
boolean column; nothing is evaluated by user functions. Of the test tables' documents that are labelled good, none is
rejected by these rules; the base rule rejects those under 50 words.

Defined results: a null text counts as empty and has no words, so it fails the base rule; columns of
the input whose names clash with the measures are replaced only in the measuring projection, since
callers get exactly the columns they ask for; repeated rows are judged one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import BLANK_CLASS, BLANKS

#: (rule, metric, lowest, highest); None leaves a side open. Ratios are per word unless named by line. Numbers of
#: words and of repeated words are judged by :func:`base_failed`.
THRESHOLDS = [
    ("mean_word_length", "word_length", 2.5, 12.0),
    ("symbols_per_word", "symbol_ratio", None, 0.10),
    ("stop_words_per_word", "stop_ratio", 0.04, None),
    ("repeated_lines", "dup_line_ratio", None, 0.45),
]

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "with", "for", "on", "as", "by", "are", "was", "be", "this", "from", "have", "not", "le",
    "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "en", "est", "pour", "dans", "sur", "par", "au", "aux", "pas", "der", "die",
    "das", "und", "den", "dem", "von", "zu", "mit", "ist", "ein", "eine", "im", "für", "auf", "sich", "nicht", "des", "el", "los", "las", "y", "una",
    "es", "por", "con", "para", "del", "se", "lo", "al", "como", "su", "no",
]

#: Names the measuring projection adds; prefixed so that they can't clash with input columns.
_P = "__q_"


def _c(name: str) -> Column:
    return F.col(_P + name)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the raw counts of every whole text as ``__q_*`` columns.

    Each stage is its own projection so that arrays are computed once per row and referenced by column.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    not_blank = F.length(F.translate(t, BLANKS, ""))
    out = docs.withColumns(
        {
            f"{_P}words": F.filter(F.split(t, BLANK_CLASS, -1), lambda w: w != ""),
            f"{_P}lines": F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, BLANKS, "") != ""),
            f"{_P}word_chars": not_blank.cast("long"),
            f"{_P}n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        }
    )
    out = out.withColumns(
        {
            f"{_P}n_words": F.size(_c("words")).cast("long"),
            f"{_P}n_lines": F.size(_c("lines")).cast("long"),
            f"{_P}n_dup_lines": (F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))).cast("long"),
            f"{_P}n_stop": F.size(F.filter(_c("words"), lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            f"{_P}hashes": F.expr(
                f"""CASE WHEN size({_P}words) < 3 THEN cast(array() AS array<bigint>)
                ELSE transform(sequence(0, size({_P}words) - 3), i -> xxhash64({_P}words[i], {_P}words[i + 1], {_P}words[i + 2])) END"""
            ),
        }
    )
    # (hash, position) of windows in order of their hashes, where any repeat: equal windows become neighbours
    out = out.withColumn(
        f"{_P}windows",
        F.expr(
            f"""CASE WHEN size(array_distinct({_P}hashes)) = size({_P}hashes) THEN cast(array() AS array<struct<h: bigint, p: int>>)
            ELSE sort_array(transform({_P}hashes, (h, i) -> struct(h, i AS p))) END"""
        ),
    )
    # Different windows with one hash, if there ever are any, send the text down the path that sorts the windows themselves.
    words = lambda x: f"concat({_P}words[{x}], ' ', {_P}words[{x} + 1], ' ', {_P}words[{x} + 2])"
    out = out.withColumn(
        f"{_P}clash",
        F.expr(f"exists(transform({_P}windows, (x, i) -> get({_P}windows, i - 1).h <=> x.h AND {words(f'get({_P}windows, i - 1).p')} <> {words('x.p')}), c -> c)"),
    )
    out = out.withColumn(
        f"{_P}exact",
        F.expr(
            f"""CASE WHEN {_P}clash THEN sort_array(transform(sequence(0, size({_P}words) - 3), i -> struct({words('i')} AS w, i AS p)))
            ELSE cast(array() AS array<struct<w: string, p: int>>) END"""
        ),
    )
    near = lambda a, k: f"transform(filter({_P}{a}, (x, i) -> get({_P}{a}, i - 1).{k} <=> x.{k} OR get({_P}{a}, i + 1).{k} <=> x.{k}), x -> x.p)"
    out = out.withColumn(f"{_P}starts", F.expr(f"CASE WHEN {_P}clash THEN {near('exact', 'w')} ELSE {near('windows', 'h')} END"))
    return out.withColumn(
        f"{_P}n_repeat_words",
        F.expr(f"size(array_distinct(flatten(transform({_P}starts, p -> array(p, p + 1, p + 2)))))").cast("long"),
    ).drop(*[f"{_P}{c}" for c in ("words", "lines", "hashes", "windows", "clash", "exact", "starts")])


def metrics() -> dict[str, Column]:
    words, lines = F.greatest(_c("n_words"), F.lit(1)), F.greatest(_c("n_lines"), F.lit(1))
    return {
        "word_length": _c("word_chars") / words,
        "symbol_ratio": _c("n_symbols") / words,
        "stop_ratio": _c("n_stop") / words,
        "dup_line_ratio": _c("n_dup_lines") / lines,
    }


def compile_rules(thresholds=THRESHOLDS) -> Column:
    """One boolean column: every metric lies within its bounds."""
    known, tests = metrics(), [F.lit(True)]
    for _, metric, low, high in thresholds:
        if low is not None:
            tests.append(known[metric] >= F.lit(low))
        if high is not None:
            tests.append(known[metric] <= F.lit(high))
    return reduce(lambda a, b: a & b, tests)


def base_failed() -> Column:
    return (_c("n_words") < 50) | (100 * _c("n_repeat_words") > 50 * _c("n_words"))


def judge(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    m = measure(docs, text)
    extra = {c: _c(c) for c in counts} | {"base_failed": base_failed(), "kept": ~base_failed() & compile_rules(thresholds)}
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in extra]
    return m.select(*keep, *[v.alias(k) for k, v in extra.items()])


def keep_good(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    # A filter on the measures would be pushed below their projections, and the arrays then be built anew for
    # every element; it is not pushed below a projection with a number that depends on the partition.
    m = measure(docs, text).withColumn(f"{_P}row", F.monotonically_increasing_id())
    return m.filter(~base_failed() & compile_rules(thresholds) & (_c("row") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


_SQL_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
a AS (SELECT doc_id, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
        list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
b AS (SELECT *, CASE WHEN len(ws) < 3 THEN [] ELSE list_transform(range(1, len(ws) - 1),
        lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END AS tri FROM a),
u AS (SELECT row_number() OVER () AS r, * FROM b),
e AS (SELECT r, unnest(tri) AS w, unnest(range(1, len(tri) + 1)) AS p FROM u),
f AS (SELECT r, p, count(*) OVER (PARTITION BY r, w) AS c FROM e),
g AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM f WHERE c > 1) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
        len(ls) AS n_lines, len(list_filter(ws, lambda w: lower(w) IN ({_SQL_STOP}))) AS n_stop
      FROM u LEFT JOIN g USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 50
  AND CAST(word_chars AS DOUBLE) / greatest(n_words, 1) BETWEEN 2.5 AND 12.0
  AND CAST(n_symbols AS DOUBLE) / greatest(n_words, 1) <= 0.10
  AND CAST(n_stop AS DOUBLE) / greatest(n_words, 1) >= 0.04
  AND CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1) <= 0.45
  AND CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1) <= 0.50 AS kept
FROM j
"""
