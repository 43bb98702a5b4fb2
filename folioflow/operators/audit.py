"""Audits: leaks and secrets by rule, forbidden fields in schemas, content hashes, readiness gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that must not reach public tables: gold answers, raw outputs, secrets, paths, payloads.
FORBIDDEN = [
    "answer", "answers", "gold_answer", "gold_answer_for_posthoc_diagnostic_only", "evidence_pages", "evidence_sources", "binary_correctness",
    "gold_evidence", "gold_page", "gold_pages", "raw_output", "raw_response", "provider_response", "raw_outputs", "api_key", "api_token", "access_token",
    "secret", "secret_token", "local_path", "absolute_path", "image_path", "page_image_path", "page_text_path", "file_url", "base64", "image_base64",
    "base64_payload", "image_payload_base64",
]
#: What a public text must not hold.
FRAGMENTS = ["file://", "/home/", "data:image"]
#: Fixed values.
BASE64, LEAST_DECODED = r"[A-Za-z0-9+/]{80,}={0,2}", 48
#: Part of a rule's every match: texts without it aren't searched.
HINTS = {"secret_key": "sk-", "hex_token": "token", "email": "@", "ipv4": "."}
#: rule -> pattern that RE2 and Java read alike.
RULES = {
    "file_uri": r"file://",
    "home_path": r"/home/",
    "data_image": r"data:image",
    "base64_block": r"[A-Za-z0-9+/]{80,}={0,2}",
    "secret_key": r"sk-[A-Za-z0-9_-]{16,}",
    "hex_token": r"token\s*=\s*\"[0-9a-f]{40}\"",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "license_line": r"Licensed under|Copyright \(c\)|SPDX-License",
}


def matches(text: Column, rule: str, pattern: str) -> Column:
    """Whether a text matches: plain strings are looked for as such, others only in texts that hold the rule's hint."""
    if pattern in FRAGMENTS:
        return text.contains(pattern)
    return text.contains(HINTS[rule]) & text.rlike(pattern) if rule in HINTS else text.rlike(pattern)


def base64_payload(text: Column) -> Column:
    """Whether a text that isn't about hashes holds a run of base64 that decodes to a payload."""
    size = lambda m: F.octet_length(F.try_to_binary(m, F.lit("base64")))
    found = F.regexp_extract_all(text, F.lit(f"({BASE64})"), F.lit(1))
    return ~F.lower(text).contains("sha256") & F.exists(found, lambda m: (F.length(m) % 4 == 0) & F.coalesce(size(m) >= LEAST_DECODED, F.lit(False)))


def named_fields(text: Column, forbidden=FORBIDDEN) -> Column:
    """Forbidden field names that stand as words in a plain text, sorted."""
    low = F.lower(text)
    word = lambda n: low.contains(n) & low.rlike(f"(^|[^a-z0-9_]){n}([^a-z0-9_]|$)")
    return F.array_compact(F.array(*[F.when(word(n), F.lit(n)) for n in sorted(forbidden)]))


def json_leaks(text: Column, forbidden=FORBIDDEN) -> Column:
    """Forbidden keys of a JSON text, at any depth, and what its strings must not hold."""
    keys = F.regexp_extract_all(text, F.lit(r'"([A-Za-z0-9_]+)"\s*:'), F.lit(1))
    bad = F.array_intersect(keys, F.array(*map(F.lit, forbidden)))
    held = F.array_compact(F.array(*[F.when(F.lower(text).contains(f), F.lit(f"forbidden_content:{f}")) for f in FRAGMENTS], F.when(base64_payload(text), F.lit("forbidden_content:base64_payload"))))
    return F.array_sort(F.concat(F.transform(bad, lambda k: F.concat(F.lit("forbidden_field:"), k)), held))


def scan(rows: DataFrame, text: str, rules: dict[str, str] = RULES) -> DataFrame:
    """(rule, n_rows): rows that match each rule, rules without a match included; one pass over the table."""
    counts = rows.agg(*[F.count_if(matches(F.col(text), k, p)).alias(k) for k, p in rules.items()])
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n_rows")) for k in rules]))
    return counts.select(pair.alias("x")).select("x.*")


def violations(rows: DataFrame, keys: list[str], text: str, rules: dict[str, str] = RULES) -> DataFrame:
    """(keys, rule) of every match."""
    hit = F.array_compact(F.array(*[F.when(matches(F.col(text), k, p), F.lit(k)) for k, p in rules.items()]))
    return rows.select(*keys, F.explode(hit).alias("rule"))


def forbidden_fields(schema: T.DataType, forbidden=FORBIDDEN, at: str = "") -> list[str]:
    """Paths of forbidden field names, at any depth; costs no job."""
    if isinstance(schema, T.StructType):
        out = []
        for f in schema.fields:
            here = f"{at}.{f.name}" if at else f.name
            out += [here] * (f.name in forbidden) + forbidden_fields(f.dataType, forbidden, here)
        return out
    if isinstance(schema, T.ArrayType):
        return forbidden_fields(schema.elementType, forbidden, at + "[]")
    if isinstance(schema, T.MapType):
        return forbidden_fields(schema.valueType, forbidden, at + "{}")
    return []


def assert_public(df: DataFrame) -> DataFrame:
    if bad := forbidden_fields(df.schema):
        raise ValueError(f"forbidden fields: {', '.join(bad)}")
    return df


def without_private(df: DataFrame, forbidden=FORBIDDEN) -> DataFrame:
    """``df`` without forbidden fields, at any depth."""
    return df.select(*[_public(F.col(f"`{f.name}`"), f.dataType, forbidden).alias(f.name) for f in df.schema.fields if f.name not in forbidden])


def _public(c: Column, kind: T.DataType, forbidden, clean: bool = False) -> Column:
    """A value without forbidden fields and, with ``clean``, without texts that hold a forbidden fragment."""
    if isinstance(kind, T.StructType):
        if not clean and not forbidden_fields(kind, forbidden):
            return c
        return F.when(c.isNotNull(), F.struct(*[_public(c[f.name], f.dataType, forbidden, clean).alias(f.name) for f in kind.fields if f.name not in forbidden]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _public(x, kind.elementType, forbidden, clean)) if clean or forbidden_fields(kind, forbidden) else c
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        kept = F.map_filter(c, lambda k, _: ~k.isin(forbidden))
        return F.transform_values(kept, lambda _, v: _public(v, kind.valueType, forbidden, clean))
    return redacted(c) if clean and isinstance(kind, T.StringType) else c


def sanitised(df: DataFrame, forbidden=FORBIDDEN) -> DataFrame:
    """``df`` without forbidden fields at any depth, texts that hold a path or an inline image null."""
    return df.select(*[_public(F.col(f"`{f.name}`"), f.dataType, forbidden, True).alias(f.name) for f in df.schema.fields if f.name not in forbidden])


def redacted(c: Column) -> Column:
    """Null where a text holds a local path or an inline image."""
    return F.when(~F.lower(c).rlike("|".join(FRAGMENTS)), c)


def content_hash(df: DataFrame) -> DataFrame:
    """(n_rows, digest) that doesn't depend on the order or files of the rows.

    The digests of all rows are added up in two long sums, so nothing is collected.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.conv(F.substring(row, i, 12), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.count("*").alias("n_rows"), F.sum(part(1)).alias("a"), F.sum(part(13)).alias("b"))
    return sums.select("n_rows", F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("digest"))


def readiness(report: DataFrame, floors: dict[str, float], ceilings: dict[str, float]) -> DataFrame:
    """Adds blocking (names of metrics beyond their bounds) and ready."""
    bad = [F.when(F.col(k) < v, F.lit(f"{k}_below_{v}")) for k, v in floors.items()]
    bad += [F.when(F.col(k) > v, F.lit(f"{k}_above_{v}")) for k, v in ceilings.items()]
    out = report.withColumn("blocking", F.array_compact(F.array(*bad)))
    return out.withColumn("ready", F.size("blocking") == 0)
