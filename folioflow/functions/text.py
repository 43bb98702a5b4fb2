"""Text primitives as column expressions: tokens, compaction, identifiers, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that retrieval ignores.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "what", "which", "with"]
#: Words that question profiles ignore.
QUESTION_STOPWORDS = [
    "according", "document", "what", "which", "who", "where", "when", "this", "that", "with", "from", "into", "about", "using", "there", "their",
    "have", "been", "were", "will", "shall", "the", "and", "for", "are", "was", "not", "can", "you", "its", "his", "her",
]


def tokens(text: Column, stopwords=STOPWORDS) -> Column:
    """Lower-case runs of letters, digits and percent signs, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9%]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stopwords)) if stopwords else found


def record_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and percent signs, stop words kept."""
    return tokens(text, ())


def question_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("[a-zA-Z][a-zA-Z0-9]+"), F.lit(0))
    lowered = F.transform(found, F.lower)
    return F.array_distinct(F.filter(lowered, lambda t: (F.length(t) > 2) & ~t.isin(QUESTION_STOPWORDS)))


def compact(text: Column) -> Column:
    """One blank for each run of white space, none at the ends; white space as in Unicode."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 3)), F.lit("..."))).otherwise(text)


def token_estimate(text: Column) -> Column:
    """Words and single marks."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))


def present(c: Column) -> Column:
    """Neither null nor the empty string: zero and false are present."""
    return c.isNotNull() & (c.cast("string") != "")


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[F.when(present(c), c) for c in cols])


def canonical_json(m: Column) -> Column:
    """JSON of a map with sorted keys and its nulls kept."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))), {"ignoreNullFields": "false"})


def text_hash(text: Column) -> Column:
    """SHA-256 with line ends unified."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def percent_encoded(text: Column) -> Column:
    """Every byte but letters, digits and ``_.-~`` as ``%XX``."""
    e = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def page_id(doc: Column, page: Column) -> Column:
    return F.format_string("%s#p%03d", doc, page)


def node_id(kind: str, doc: Column, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), percent_encoded(doc), *[percent_encoded(p.cast("string")) for p in parts])


def record_id(stem: Column, doc: Column, question: Column) -> Column:
    return F.concat(F.regexp_replace(stem, "[^A-Za-z0-9]+", "_"), F.lit("__"), F.left(F.sha1(F.concat_ws("::", doc, question)), F.lit(10)))


def slug(text: Column) -> Column:
    return F.left(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit(80))


def number_in(text: Column) -> Column:
    """The number that a string spells: grouping and percent signs dropped, an opening bracket makes it negative."""
    value = F.regexp_replace(text, r"[(),%$\s]", "").try_cast("double")
    return F.when(F.trim(text).startswith("("), -value).otherwise(value)


def unit_of(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(t.contains("%") | t.contains("percent"), "percent")
        .when(t.contains("minute"), "minutes")
        .when(t.contains("hour"), "hours")
        .when(t.contains("day"), "days")
        .when(t.rlike("million|billion|thousand"), "scaled_number")
        .otherwise("numeric")
    )


def page_references(text: Column) -> Column:
    """One-based page numbers named in a text."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\bpages?\s+(\d+)\b"), F.lit(1)), lambda p: p.try_cast("int"))


def exact_codes(text: Column) -> Column:
    """Codes of one to four capitals and one to four digits that aren't fiscal years, quarters or the like."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Z]{1,4}\d{1,4})\b"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda c: ~c.rlike(r"^(FY\d+|Q\d|F\d+|AP\d+|GPT\d+)$")))


def coerced_page(text: Column) -> Column:
    """A page index from an integer, an integral float or the tail after a colon; null otherwise."""
    tail = F.regexp_extract(F.trim(text), r"([^:]+)$", 1)
    whole = tail.try_cast("double")
    return F.when(whole.isNotNull() & (whole == F.floor(whole)), whole.cast("int"))
