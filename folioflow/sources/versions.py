"""A table kept as a log of commits: one base and the deltas after it, of which a key's last write counts.

A commit is a folder of Parquet files and, when these are complete, a manifest in the log, which is renamed into place. What has no manifest is
not part of the table, so a writer may die at any point and run again. A manifest names its writer and the writer's batch; a
batch that has one is not written twice. A key's rows are those of the last commit that holds it: one row a key gives upserts, many rows
a key the replacement of whole groups. A delta costs what it holds, not what the table holds; :func:`compact` makes a new base when there
are many.

Defined results: an absent table has no commits; an empty delta is a commit that replaces nothing; a null in a key is a key like others.
Two writers that commit at once collide on the manifest's name: one of them goes on with the next number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEQUENCE = "_sequence"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, in order; an absent folder is empty."""
    p, fs = _files(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    p, fs = _files(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def bytes_of(spark: SparkSession, folder: str) -> int:
    p, fs = _files(spark, folder)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def _commit(spark: SparkSession, table: str, entry: dict) -> bool:
    """Put a manifest into the log; False if its number is taken."""
    draft, fs = _files(spark, f"{table}/_log/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    jvm = spark._jvm
    final = jvm.org.apache.hadoop.fs.Path(f"{table}/_log/{entry['number']:012d}.json")
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(draft).toUri(), fs.getConf())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), option)
    except Exception as e:  # noqa: BLE001
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(draft, False)
        return False
    return True


def commits(spark: SparkSession, table: str) -> list[dict]:
    """The manifests that make up the table: the last base, if there is one, and the deltas after it."""
    out: list[dict] = []
    for name in reversed([n for n in names(spark, f"{table}/_log") if n.endswith(".json") and n[0] != "_"]):
        out.insert(0, json.loads(text_of(spark, f"{table}/_log/{name}")))
        if out[0]["kind"] == "base":
            break
    return out


def committed(log: list[dict], writer: str, batch: int) -> bool:
    """Whether a writer's batch is part of the table; batches of a writer are committed in order."""
    done = [e["batch"] for e in log if e["kind"] == "delta" and e["writer"] == writer]
    return batch <= max([*done, *(e["done"].get(writer, -1) for e in log if e["kind"] == "base")], default=-1)


def _written(df: DataFrame, table: str, folder: str, entry: dict) -> dict:
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{table}/{folder}")
    entry |= {"folder": folder, "schema": df.schema.json(), "bytes": bytes_of(spark, f"{table}/{folder}")}
    number = max([e["number"] for e in commits(spark, table)], default=-1) + 1
    while not _commit(spark, table, entry | {"number": number}):
        number += 1
    return entry | {"number": number}


def append(df: DataFrame, table: str, writer: str, batch: int, folder: str | None = None) -> dict | None:
    """Commit ``df`` as the writer's batch; None if that batch is part of the table already."""
    if committed(commits(df.sparkSession, table), writer, batch):
        return None
    return _written(df, table, folder or f"data-{uuid.uuid4().hex}", {"kind": "delta", "writer": writer, "batch": batch})


def rows(spark: SparkSession, table: str, log: list[dict]) -> DataFrame:
    """All rows of the commits, with their commit's number; columns that a commit lacks are null."""
    out = None
    for e in log:
        part = spark.read.schema(_schema(e)).parquet(f"{table}/{e['folder']}").withColumn(SEQUENCE, F.lit(e["number"]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _schema(entry: dict):
    return StructType.fromJson(json.loads(entry["schema"]))


def merged(spark: SparkSession, table: str, log: list[dict], key: list[str]) -> DataFrame:
    """The rows that count. Deltas are ranked among themselves; the base only loses the keys that they hold, so it isn't sorted."""
    base, deltas = [e for e in log if e["kind"] == "base"], [e for e in log if e["kind"] == "delta"]
    if not deltas:
        return rows(spark, table, base).drop(SEQUENCE)
    fresh = rows(spark, table, deltas)
    last = fresh.groupBy(*key).agg(F.max(SEQUENCE).alias("_last"))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in key]
    fresh = fresh.alias("f").join(last.alias("l"), [*same(fresh, last), fresh[SEQUENCE] == last["_last"]], "left_semi").drop(SEQUENCE)
    if not base:
        return fresh
    old = rows(spark, table, base).drop(SEQUENCE)
    gone = rows(spark, table, deltas).select(*key).distinct()
    return old.join(gone, same(old, gone), "left_anti").unionByName(fresh, allowMissingColumns=True)


def current(spark: SparkSession, table: str, key: list[str]) -> DataFrame | None:
    """The table as of its last commit; None if it has none."""
    log = commits(spark, table)
    return merged(spark, table, log, key) if log else None


def compact(spark: SparkSession, table: str, key: list[str], deltas: int = 1) -> bool:
    """Make the table a new base if at least so many deltas follow the last one. Readers of earlier commits are not disturbed."""
    log = commits(spark, table)
    if sum(e["kind"] == "delta" for e in log) < deltas:
        return False
    done: dict[str, int] = {}
    for e in log:
        for w, b in e["done"].items() if e["kind"] == "base" else [(e["writer"], e["batch"])]:
            done[w] = max(b, done.get(w, -1))
    entry = {"kind": "base", "done": done}
    folder = f"data-{uuid.uuid4().hex}"
    df = merged(spark, table, log, key)
    df.write.parquet(f"{table}/{folder}")
    entry |= {"folder": folder, "schema": df.schema.json(), "bytes": bytes_of(spark, f"{table}/{folder}"), "number": log[-1]["number"] + 1}
    return _commit(spark, table, entry)  # False if another commit came in between: the new base would lack it


def vacuum(spark: SparkSession, table: str) -> list[str]:
    """Remove folders and manifests that the table no longer needs; only while nobody reads older commits or writes. Returns the folders."""
    log = commits(spark, table)
    used, first = {e["folder"] for e in log}, log[0]["number"] if log else 0
    gone = [n for n in names(spark, table) if n != "_log" and n not in used]
    for path in [*gone, *(f"_log/{n}" for n in names(spark, f"{table}/_log") if n[0] == "_" or int(n[:12]) < first)]:
        p, fs = _files(spark, f"{table}/{path}")
        fs.delete(p, True)
    return gone

