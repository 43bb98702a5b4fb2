"""Shared plumbing of the training-data operators: shared folders, written tables, table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: ASCII blanks that separate words in the text contracts: space, tab, LF, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset a folder of this machine serves, but only for a local master, whose executors are this machine;
    on a cluster nobody else could read it, so the call fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "folioflow-shared")
    return base.rstrip("/")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the shared folder, in the folder of this application."""
    return f"{shared_base(spark)}/folioflow/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, if it is there."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def clean_up(spark: SparkSession) -> None:
    """Remove all that this application has written to the shared folder. Results that were not stored elsewhere go too."""
    delete(spark, f"{shared_base(spark)}/folioflow/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    Unlike a local checkpoint the copy outlives lost executors. :func:`release` removes it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._folioflow_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove the written copies of frames from :func:`materialize` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_folioflow_path", None)
        if path:
            delete(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its files give fewer; tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def bounded_batches(spark: SparkSession, rows: int = 10_000, megabytes: int = 2) -> None:
    """Bound Arrow batches by bytes: a Python worker then holds few long texts, or many short rows, at once.

    These are settings of the session, read when a plan runs, so they stay for the lazy result; they change no
    result. A session whose batches are smaller already keeps its settings.
    """
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < now <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20
    size = str(spark.conf.get(key)).rstrip("bB")
    if not size.isdigit() or not 0 < int(size) <= most:
        spark.conf.set(key, str(most))


def together(texts: list[str], chars: int):
    """Texts in lists of at most so many characters, a longer text by itself."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > chars:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


_KEPT: list = [None, None]


def kept(key: tuple, build):
    """What ``build`` makes, kept by this Python worker from task to task until a task of another key asks.

    A worker serves all operators of an application in turn; it holds the tables of one of them at a time.
    """
    if _KEPT[0] != key:
        _KEPT[:] = None, None
        free()
        _KEPT[:] = key, build()
    return _KEPT[1]


def trim() -> None:
    """Return freed memory to the system where the C library can: at a task's end, as an idle worker stays."""
    import ctypes

    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def free() -> None:
    """Give up what this worker keeps."""
    import gc

    _KEPT[:] = None, None
    gc.collect()
    trim()


def tokenizer_json(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
