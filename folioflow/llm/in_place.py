"""Marks on rows, taken back to the rows where they lie, so that long texts need no shuffle.

A row is named by its file and its place there, which Spark's readers give. What an operator finds out about
rows (a shuffle of names and digests) is written as one small file of marks for each ``BLOCK`` rows of a file;
a later scan of the same files looks its rows up in them. A task holds one block of marks at a time.

Defined results: a frame that isn't read from files, or no longer one row a row of them, is first written to the
shared folder; rows without a mark get null; of a row's several marks the least counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import materialize, partitions, shared_dir
from folioflow.llm.store import ShardFile, read_whole

#: Rows of a file whose marks share one file.
BLOCK = 1 << 20
FILE, ROW = "_file", "_row"


def _scans_parquet(plan) -> bool:
    """Whether a plan is columns and filters over one scan of Parquet files, so that its rows are rows of these."""
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and plan.relation().fileFormat().toString() == "Parquet"


def readable(df: DataFrame) -> DataFrame:
    """``df`` itself if each of its rows is one row of a Parquet file, else a written copy."""
    plan = df._jdf.queryExecution().analyzed()
    there = "_metadata" in plan.metadataOutput().mkString(" ")
    return df if there and _scans_parquet(plan) else materialize(df, "rows")


def placed(df: DataFrame) -> DataFrame:
    """A :func:`readable` frame with each row's file and place."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def _name(file: str, block: int) -> str:
    return f"{hashlib.sha1(file.encode()).hexdigest()}-{block}.marks"


def write_marks(marks: DataFrame, tag: str) -> str:
    """Write ``marks`` (_file, _row, mark long); returns their folder."""
    spark = marks.sparkSession
    folder = shared_dir(spark, tag)
    dealt = marks.withColumn("_block", F.floor(F.col(ROW) / BLOCK)).select(FILE, ROW, "_block", "mark")
    dealt = dealt.repartition(partitions(spark), FILE, "_block").sortWithinPartitions(FILE, ROW, "mark")

    def write(batches):
        at, rows, values, n = None, [], [], 0

        def flush():
            row, value = np.concatenate(rows), np.concatenate(values)
            first = np.r_[True, row[1:] != row[:-1]]
            out = ShardFile(folder, _name(*at))
            out.write(row[first].astype("<i8").tobytes())
            out.write(value[first].astype("<i8").tobytes())
            out.commit()

        for b in batches:
            for key, part in b.groupby([FILE, "_block"], sort=False):
                if at is not None and key != at:
                    flush()
                    rows, values, n = [], [], n + 1
                at = key
                rows.append(part[ROW].to_numpy(dtype=np.int64))
                values.append(part["mark"].to_numpy(dtype=np.int64))
        if at is not None:
            flush()
            n += 1
        yield pd.DataFrame({"n": [n]})

    dealt.mapInPandas(write, "n long").agg(F.sum("n")).first()
    return folder


class Marks:
    """Looks rows up in the marks of a folder; holds one block."""

    def __init__(self, folder: str):
        self.folder, self._at, self._rows, self._values = folder, None, None, None

    def _load(self, file: str, block: int) -> None:
        if self._at != (file, block):
            data = read_whole(self.folder, _name(file, block)) or b""
            self._rows, self._values = np.frombuffer(data, "<i8").reshape(2, -1)
            self._at = file, block

    def look_up(self, files: pd.Series, rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """(whether marked, mark) of each row."""
        found, out = np.zeros(len(rows), dtype=bool), np.zeros(len(rows), dtype=np.int64)
        r = rows.to_numpy(dtype=np.int64)
        code, names = pd.factorize(files)
        key = code * (1 << 40) + r // BLOCK
        order = np.argsort(key, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(r) else []:
            self._load(names[code[some[0]]], int(r[some[0]] // BLOCK))
            if len(self._rows):
                at = np.minimum(np.searchsorted(self._rows, r[some]), len(self._rows) - 1)
                found[some] = self._rows[at] == r[some]
                out[some] = self._values[at]
        return found, out


def mark(folder: str) -> Column:
    """The mark of each row of a :func:`placed` frame; only the names of rows go through Python."""

    @F.pandas_udf("long")
    def marked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        marks = Marks(folder)
        for files, rows in batches:
            found, value = marks.look_up(files, rows)
            yield pd.Series(value, dtype="Int64").where(found)

    return marked(F.col(FILE), F.col(ROW))
