"""Marks on rows: frames that are read from files and frames that are not."""

import pytest
from pyspark.sql import functions as F

from folioflow.llm import in_place, simhash_similar

TEXT = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [(1, TEXT), (2, TEXT), (3, TEXT + " " + TEXT.replace("one", "other")), (4, "quite another text that has words of its own and no copy"), (5, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def kept(df):
    return sorted(r.doc_id for r in simhash_similar.keep_first(df).collect())


@pytest.mark.parametrize("kind", ["parquet", "json", "orc"])
def test_formats(spark, docs, tmp_path, kind):
    docs.coalesce(2).write.format(kind).save(f"{tmp_path}/d")
    read = spark.read.schema(docs.schema).format(kind).load(f"{tmp_path}/d")
    assert kept(read) == kept(docs) == [1, 3, 4, 5]
    assert (in_place.readable(read) is read) == (kind == "parquet")


def test_frames_that_are_not_rows_of_their_files(spark, docs, tmp_path):
    """Exploded, united, joined, limited and grouped rows are written first; columns and filters are not."""
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    read = spark.read.parquet(f"{tmp_path}/d")
    twice = read.withColumn("x", F.explode(F.array(F.lit(0), F.lit(10)))).select((F.col("doc_id") + F.col("x")).alias("doc_id"), F.when(F.col("x") == 0, F.col("text")).otherwise(F.concat(F.lit("Alpha beta gamma delta epsilon. "), "text")).alias("text"))
    assert kept(twice) == kept(spark.createDataFrame(twice.collect(), docs.schema))
    assert kept(read.union(read.withColumn("doc_id", F.col("doc_id") + 10))) == [1, 3, 4, 5]
    for df in (twice, read.union(read), read.limit(3), read.distinct(), read.join(read.select("doc_id"), "doc_id"), docs):
        assert in_place.readable(df) is not df
    for df in (read, read.filter("doc_id > 1"), read.select("text", F.lit(1).alias("y")).filter("y = 1")):
        assert in_place.readable(df) is df
