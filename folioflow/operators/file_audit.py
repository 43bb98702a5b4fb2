"""Audit of public files: what their texts must not hold, and keys that must not be in their JSON, with line and path.

JSON lines are judged line by line, other JSON files as a whole, all other texts as words. Lines come from Spark's text reader, in as many tasks as the
files have splits, with their number in their file. All fragments and names are looked for in one pass of one pattern.

Results are (file, location, reason). A fragment anywhere in a file is named once without a location, and again where a JSON string holds it. A file of JSON
lines in which a line is not JSON is judged up to that line, and then as words. Defined results: blank lines count but are not judged; an
absent folder has no files; a file with bytes that aren't UTF-8 is named for these and not judged further.
"""

from __future__ import annotations

import base64
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.audit import BASE64, FRAGMENTS, LEAST_DECODED
from folioflow.sources.readers import exists

#: Field names that a public file must not have, those that only look alike, and those of payloads and tokens.
FIELDS = [
    "answer", "answers", "gold_answer", "evidence_pages", "evidence_sources", "binary_correctness", "gold_evidence", "gold_page", "gold_pages", "raw_output", "raw_response",
    "api_key", "local_path", "absolute_path", "image_path",
]
KEYS = ["base64", "image_base64", "base64_payload", "image_payload_base64", "api_token", "access_token", "secret_token"]
#: Kinds of files that are read.
KINDS = "*.{jsonl,json,md,txt,csv,yaml,yml,log}"
_FRAGMENT = re.compile("|".join(map(re.escape, FRAGMENTS)))
_WORD = re.compile(r"(?<![a-z0-9_])(?:" + "|".join(sorted(FIELDS, key=len, reverse=True)) + r")(?![a-z0-9_])")
_PAYLOAD = re.compile(BASE64)


def has_payload(text: str) -> bool:
    """Whether a run of base64 decodes to a payload; texts about hashes are left alone."""
    if "sha256" in text.lower():
        return False
    for run in _PAYLOAD.findall(text):
        try:
            if len(base64.b64decode(run, validate=True)) >= LEAST_DECODED:
                return True
        except ValueError:
            continue
    return False


def in_value(value, location: str) -> list[tuple[str, str]]:
    """(location, reason) of all violations in a JSON value, in the order of the text."""
    out, todo = [], [(value, location)]
    while todo:
        v, at = todo.pop()
        if isinstance(v, dict):
            out += [(at, f"forbidden_field:{k}") for k in v if k in FIELDS or k in KEYS]
            todo += [(x, f"{at}.{k}") for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(x, f"{at}[{i}]") for i, x in reversed(list(enumerate(v)))]
        elif isinstance(v, str):
            out += [(at, f"forbidden_content:{f}") for f in sorted(set(_FRAGMENT.findall(v.lower())))]
            if has_payload(v):
                out.append((at, "forbidden_content:base64_payload"))
    return out


def numbered_lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(file, line, value): the lines of all files below a folder, numbered from 1 in their file. The driver sees one row a split."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    raw = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_at", F.monotonically_increasing_id())
    before, rows, last = 0, [], None
    for r in sorted(raw.groupBy("file", "_start").agg(F.min("_at").alias("first"), F.count("*").alias("n")).collect()):
        before = before if r.file == last else 0
        rows.append((r.file, r["_start"], before - r["first"] + 1))
        before, last = before + r.n, r.file
    shift = spark.createDataFrame(rows, "file string, _start long, _shift long")
    return raw.join(F.broadcast(shift), ["file", "_start"]).select("file", (F.col("_at") + F.col("_shift")).alias("line"), "value")


def _json(text: str, location: str) -> list[tuple[str, str]] | None:
    try:
        return in_value(json.loads(text), location)
    except (ValueError, RecursionError):
        return None


def audit(spark: SparkSession, folder: str) -> DataFrame:
    """(file, location, reason) of all violations in the files below a folder; ``file`` is the path below it."""
    schema = "file string, location string, reason string"
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)

    @F.pandas_udf("array<struct<location:string,reason:string>>")
    def by_line(line: pd.Series, text: pd.Series) -> pd.Series:
        found = [[] if not t.strip() else _json(t, f"line:{n}") for n, t in zip(line, text, strict=True)]
        return pd.Series([None if f is None else [{"location": a, "reason": b} for a, b in f] for f in found], dtype=object)

    @F.pandas_udf("array<struct<location:string,reason:string>>")
    def whole(text: pd.Series) -> pd.Series:
        return pd.Series([None if (f := _json(t, "json")) is None else [{"location": a, "reason": b} for a, b in f] for t in text], dtype=object)

    @F.pandas_udf("fragments array<string>, fields array<string>, payload boolean, hashes boolean")
    def words(text: pd.Series) -> pd.DataFrame:
        low = text.str.lower()
        return pd.DataFrame({
            "fragments": [sorted(set(_FRAGMENT.findall(t))) for t in low], "fields": [sorted(set(_WORD.findall(t))) for t in low],
            "payload": [has_payload(t) for t in text], "hashes": ["sha256" in t for t in low],
        })

    lines = numbered_lines(spark, folder, KINDS).withColumn("odd", ~F.is_valid_utf8("value")).withColumn("value", F.make_valid_utf8("value"))
    odd = lines.filter("odd").select("file").distinct()
    seen = lines.select("file", words("value").alias("w")).groupBy("file").agg(
        F.array_distinct(F.flatten(F.collect_set("w.fragments"))).alias("fragments"), F.array_distinct(F.flatten(F.collect_set("w.fields"))).alias("fields"),
        (F.bool_or("w.payload") & ~F.bool_or("w.hashes")).alias("payload"), 
    )
    judged = lines.filter(F.col("file").endswith(".jsonl")).select("file", "line", by_line("line", "value").alias("found"))
    broken = judged.groupBy("file").agg(F.min(F.when(F.col("found").isNull(), F.col("line"))).alias("_broken"))
    in_lines = judged.join(broken, "file").filter("_broken IS NULL OR line < _broken").select("file", F.explode("found").alias("x"))
    single = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    single = single.select(F.col("_metadata.file_path").alias("file"), whole(F.make_valid_utf8("value")).alias("found"))
    in_files = single.select("file", F.explode("found").alias("x"))
    # of JSON files only those that are not JSON are judged as words
    fine = broken.filter("_broken IS NULL").select("file").unionByName(single.filter("found IS NOT NULL").select("file"))
    by_word = seen.join(fine, "file", "left_anti")
    none = F.lit(None).cast("string").alias("location")
    said = lambda df, c, kind: df.select("file", none, F.explode(F.transform(c, lambda x: F.concat(F.lit(f"{kind}:"), x))).alias("reason"))
    parts = [
        in_lines.select("file", "x.*"), in_files.select("file", "x.*"), said(seen, "fragments", "forbidden_content"), said(by_word, "fields", "forbidden_text"),
        by_word.filter("payload").select("file", none, F.lit("forbidden_text:base64_payload").alias("reason")), 
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.join(odd, "file", "left_anti").unionByName(odd.select("file", none, F.lit("non_utf8_public_text").alias("reason")))
    root = re.sub(r"^[a-z0-9+.-]+:/*", "/", folder.rstrip("/"))
    name = F.regexp_replace(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), r"^.*?" + re.escape(root).replace(r"\/", "/") + "/", "")
    return out.select(name.alias("file"), "location", "reason")
