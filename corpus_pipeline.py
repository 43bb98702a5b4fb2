"""From documents to token ids: quality rules, near-duplicates, benchmark passages, personal data, tokens.

Every stage takes what the one before kept, as (spark, docs, sf_dir), and returns a DataFrame that is written as
Parquet and read again for the next. All but the last return the columns of ``documents``.

Defined results: a null text fails the quality rules; repeated rows are near-duplicates of each other; rows without an
id, or with a shared one, are rows like others; columns may have any names; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, decontaminate, pii, quality, simhash_similar
from folioflow.llm.common import materialize, release, spread, table, tokenizer_json


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules reject."""
    return quality.keep_good(spread(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies: five words, similarity 0.8."""
    return simhash_similar.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows the new text."""
    text = pii.redacted_column(spark, F.col("text"), pii.trained_on(docs))
    masked = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of the text decoded from them."""
    return bpe.encode_and_decode(docs, tokenizer_json("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", tokens),
]

#: SQL has no CRF and no BPE; tests hold all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        release(before)
    return docs
