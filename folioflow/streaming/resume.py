"""Incremental runs: only records without an answer are processed; answers are commits of a versioned table.

A micro-batch is committed under the stream's own id and the batch's number when all its answers are written. A batch that runs again,
because the stream died after its answers and before its checkpoint, finds its commit and writes nothing; one that died before
its commit is processed anew, and what it left is never read. So no answer is lost or there twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.tables import numbered, pending
from folioflow.sources import versions
from folioflow.sources.sinks import work_folder

#: Deltas after which a run makes a new base.
DELTAS = 50


def resume(records: DataFrame, sink: str, checkpoint: str, key: list[str], answer: str, process: Callable[[DataFrame], DataFrame], deltas: int = DELTAS) -> StreamingQuery:
    """Start a query that processes what is new in ``records`` (a streaming table) and not yet answered in ``sink``.

    A record with a null answer counts as not answered and is processed when it comes in again. :func:`answers` reads the sink.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        writer = json.loads(versions.text_of(spark, f"{checkpoint}/metadata"))["id"]  # of this stream, for as long as its checkpoint lives
        log = versions.commits(spark, sink)
        if versions.committed(log, writer, number):
            return
        todo = pending(df, versions.merged(spark, sink, log, key), key, answer) if log else df
        versions.append(process(todo), sink, writer, number)
        versions.compact(spark, sink, key, deltas)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers(spark: SparkSession, sink: str, key: list[str]) -> DataFrame | None:
    """The last row of each record; None if nothing was committed."""
    return versions.current(spark, sink, key)


def run_with_snapshots(records: DataFrame, folder: str, key: list[str], answer: str, process: Callable[[DataFrame], DataFrame], save_every: int) -> DataFrame:
    """Process what has no answer yet in groups of ``save_every`` records, by key; after each group its answers are saved as a delta.

    A run that is broken off goes on from its last whole group. A record that gets no answer is kept without one and tried again by the next
    run. Returns all answers so far.
    """
    spark = records.sparkSession
    log = versions.commits(spark, folder)
    todo = pending(records, versions.merged(spark, folder, log, key), key, answer) if log else records
    todo, n = numbered(todo, key, work_folder(spark, "pending"))
    at = max([e["number"] for e in log], default=-1) + 1
    for i in range(-(-n // save_every)):
        group = todo.filter((F.col("_n") >= i * save_every) & (F.col("_n") < (i + 1) * save_every)).drop("_n")
        versions.append(process(group), folder, "snapshots", at + i, f"snapshot-{at + i + 1:06d}")
        versions.compact(spark, folder, key, DELTAS)
    done = versions.current(spark, folder, key)
    return spark.createDataFrame([], process(records).schema) if done is None else done
