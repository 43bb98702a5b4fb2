"""Scans: records, JSON lines, artifacts, page files, CSV selections, directories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys under which a wrapped record list may lie, in order.
WRAPPERS = ["records", "data", "items", "queries"]
#: Legal types of the ranked columns' names.
RANKED = re.compile(r"^(text|image|mix)-top-(\d+)-(.+)$")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its files give fewer; tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a ``.jsonl`` file, of a JSON list, or of a JSON object that wraps the list."""
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    df = spark.read.json(path, multiLine=True)
    wrapped = [c for c in WRAPPERS if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType)]
    return df.select(F.explode(wrapped[0]).alias("r")).select("r.*") if wrapped else df


def read_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file whose content tells its kind: one JSON list or object, or one object a line."""
    head = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"^\s*(.)", 1).alias("c"), F.col("value").rlike(r"(?s)^\s*\{.*\}\s*\n\s*\{").alias("lines")).first()
    if head is None or head.c not in ("[", "{"):
        raise ValueError(f"{path} holds no JSON records")
    return spark.read.json(path) if head.lines else read_records(spark, path)


def read_config(text: str) -> dict:
    """Flat keys and maps one level deep of a small settings file: ``key: value`` lines, values as numbers, booleans or strings."""

    def scalar(x: str):
        if x.lower() in ("true", "false"):
            return x.lower() == "true"
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                continue
        return None if x in ("", "null") else x.strip("\"'")

    out: dict = {}
    inside = out
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].rstrip()
        if not line:
            continue
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a setting: {raw}")
        if line[0] not in " \t":
            inside = out
            if not value.strip():
                inside = out[key.strip()] = {}
                continue
        inside[key.strip()] = scalar(value.strip())
    return out


def read_graph(spark: SparkSession, folder: str, debug: bool = False) -> dict[str, DataFrame]:
    """Nodes and edges of a folder; debug edges only on request, and empty where there are none."""
    edge = "source string, target string, edge_type string"
    out = {"nodes": read_jsonl(spark, f"{folder}/nodes.jsonl", "node_id string, node_type string, doc_id string, page_index int"), "edges": read_jsonl(spark, f"{folder}/edges.jsonl", edge)}
    out["debug_edges"] = read_optional(spark, f"{folder}/debug_edges.jsonl", edge) if debug else spark.createDataFrame([], edge)
    return out


def passage_pages(passages: DataFrame) -> DataFrame:
    """(index, passage_id, page_index) of an external text index: a page's number is the place at which its document id is first seen.

    ``passages``: (index, passage_id, document).
    """
    first = passages.groupBy("index", "document").agg(F.min("passage_id").alias("_first"))
    place = first.withColumn("page_index", F.row_number().over(Window.partitionBy("index").orderBy("_first")) - 1).drop("_first")
    return passages.join(place, ["index", "document"]).select("index", "passage_id", "page_index")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines of a known schema; other rows are dropped, or with ``strict`` fail the job."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An absent file is an empty table."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def read_selected_pages(spark: SparkSession, path: str, max_pages: int, max_docs: int, per_doc: int) -> DataFrame:
    """A CSV of (doc_id, page_index) that must keep its caps; the job fails beyond them."""
    df = read_csv(spark, path).select("doc_id", F.col("page_index").try_cast("int").alias("page_index"))
    by_doc = df.groupBy("doc_id").agg(F.count("*").alias("c"))
    caps = by_doc.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("d"), F.coalesce(F.max("c"), F.lit(0)).alias("m"))
    ok = (F.col("n") <= max_pages) & (F.col("d") <= max_docs) & (F.col("m") <= per_doc)
    checked = caps.select(F.when(~ok, F.raise_error(F.lit("selection exceeds its caps"))).otherwise(F.lit(True)).alias("ok"))
    return df.crossJoin(F.broadcast(checked)).filter("ok").drop("ok")  # one row


def read_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Artifacts with ``input_order`` by file and line; a missing id becomes ``artifact_`` and the order.

    Lines are numbered by the counts of the splits before theirs, whose sizes must stay as they are until the table is
    read; the driver sees one row a split.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    raw = raw.withColumn("_at", F.monotonically_increasing_id())
    splits = raw.groupBy("_file", "_start").agg(F.min("_at").alias("first"), F.count("*").alias("n")).collect()
    before, offsets = 0, []
    for r in sorted(splits):
        offsets.append((r["_file"], r["_start"], before - r["first"]))
        before += r["n"]
    shift = spark.createDataFrame(offsets, "_file string, _start long, _shift long")
    raw = raw.join(F.broadcast(shift), ["_file", "_start"]).select("value", (F.col("_at") + F.col("_shift")).alias("input_order"))  # one row a split
    df = raw.withColumn("a", F.from_json("value", schema)).filter("a IS NOT NULL").select("input_order", "a.*")
    missing = F.col("artifact_id").isNull() | (F.col("artifact_id") == "")
    return df.withColumn("artifact_id", F.when(missing, F.format_string("artifact_%06d", F.col("input_order") + 1)).otherwise(F.col("artifact_id")))


def read_page_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, page_index, text) of files ``<doc>_<page>.txt``, line ends as blanks, up to each document's first gap."""
    raw = spark.read.text(f"{folder}/*.txt", wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    pages = raw.select(
        F.regexp_extract("name", r"^(.*)_(\d+)\.txt$", 1).alias("doc_id"),
        F.regexp_extract("name", r"^(.*)_(\d+)\.txt$", 2).try_cast("int").alias("page_index"),
        F.regexp_replace("value", "\n", " ").alias("text"),
    ).filter("page_index IS NOT NULL")
    w = Window.partitionBy("doc_id").orderBy("page_index")
    return pages.withColumn("_n", F.row_number().over(w) - 1).filter("page_index = _n").drop("_n")


def read_store(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """All JSON documents of a folder, with their file names: a line each if the folder is named ``.jsonl``, else a file each.

    The folder is listed as one; without a ``schema`` all files are read once more, to find it.
    """
    scan = spark.read if schema is None else spark.read.schema(schema)
    scan = scan.option("pathGlobFilter", "*.json").option("multiLine", not folder.endswith(".jsonl"))
    return scan.json(folder).withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))


def latest_file(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """One row: the file whose name holds the latest ``YYYY-MM-DD-HH-MM`` stamp, result files left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    stamp = F.try_to_timestamp(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd-HH-mm"))
    return files.filter(~F.col("path").endswith("_results.json")).withColumn("at", stamp).filter("at IS NOT NULL").agg(F.max_by("path", "at").alias("path"))


def ranked_columns(columns: list[str]) -> list[str]:
    """Names of ranked page lists: text, image, mix; within a family the largest N first, then by name."""
    found = [(["text", "image", "mix"].index(m[1]), -int(m[2]), c) for c in columns if (m := RANKED.match(c)) and not c.endswith("_score")]
    return [c for *_, c in sorted(found)]


def aliased(df: DataFrame, names: list[str]) -> Column:
    """The first of several column names that the table has, chosen when the plan is built."""
    there = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None)


def parsed_list(c: Column, item: str = "int") -> Column:
    """A list that may come as the text of a Python or JSON list; null and bad text are empty."""
    return F.coalesce(F.from_json(F.replace(c, F.lit("'"), F.lit('"')), f"array<{item}>"), F.array().cast(f"array<{item}>"))


def public_queries(df: DataFrame) -> DataFrame:
    """(record_index, doc_id, question): the record's number defaults to its place."""
    place = F.monotonically_increasing_id()
    index = F.coalesce(aliased(df, ["record_index"]).cast("long"), place)
    return df.select(index.alias("record_index"), F.coalesce(aliased(df, ["doc_id", "document_id"]).cast("string"), F.lit("")).alias("doc_id"), aliased(df, ["question", "query"]).alias("question"))
