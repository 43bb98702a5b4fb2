"""Joins and set operations on keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_first(parts: list[DataFrame], key: list[str], order: list[Column]) -> DataFrame:
    """Union by name; of rows with one key the first part's first row stays."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    w = Window.partitionBy(*key).orderBy("_part", *order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_part")


def replace_groups(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """``base`` without the groups that ``delta`` has, and ``delta``."""
    return base.join(delta.select(*key).distinct(), key, "left_anti").unionByName(delta, allowMissingColumns=True)


def upsert_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last written row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def kth_match(left: DataFrame, right: DataFrame, key: list[str], order_left: list[str], order_right: list[str]) -> DataFrame:
    """The n-th row of a key on the left takes the n-th on the right; beyond those the last one."""
    n = left.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order_left)))
    g = right.withColumn("_g", F.row_number().over(Window.partitionBy(*key).orderBy(*order_right)))
    top = right.groupBy(*key).agg(F.count("*").alias("_top"))
    n = n.join(top, key, "left").withColumn("_g", F.least("_k", "_top"))
    return n.join(g, [*key, "_g"], "left").drop("_g", "_k", "_top")


def pending(records: DataFrame, done: DataFrame, key: list[str], answer: str) -> DataFrame:
    """Records without a row in ``done`` that has an answer."""
    return records.join(done.filter(F.col(answer).isNotNull()).select(*key).distinct(), key, "left_anti")


def attribution(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: keys only in a, only in b, in both, in either."""
    x = a.select(*key).distinct().withColumn("_a", F.lit(1)).join(b.select(*key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    left, right = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return x.agg(
        F.count_if(left & ~right).alias("only_a"), F.count_if(right & ~left).alias("only_b"), F.count_if(left & right).alias("both"), F.count("*").alias("either")
    )


def pool_sets(retrieved: Column, explicit: Column, invalid: Column) -> dict[str, Column]:
    """Candidate pool and required pages, sorted and distinct."""
    pool = F.array_sort(F.array_union(retrieved, explicit))
    return {"candidate_pool": pool, "required": F.array_sort(F.array_except(pool, invalid))}


def outcome(before: Column, after: Column) -> Column:
    return (
        F.when(before & after, "kept_right").when(~before & ~after, "kept_wrong").when(after, "changed_to_right").otherwise("changed_to_wrong")
    )


def runs(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """(key, first, last, n) of each run of consecutive positions, which are distinct within a key."""
    w = Window.partitionBy(*key).orderBy(position)
    g = rows.withColumn("_g", F.col(position) - F.row_number().over(w))
    return g.groupBy(*key, "_g").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("_g")


def numbered(df: DataFrame, order: list[str], folder: str, name: str = "_n") -> tuple[DataFrame, int]:
    """``df``, written to ``folder`` in the order of ``order``, with row numbers from 0; and the number of rows.

    Rows are sorted over range partitions and numbered by the counts of the partitions before theirs; the driver sees one count a partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(folder)
    placed = spark.read.schema(placed.schema).parquet(folder).withColumn("_part", F.shiftright("_at", 33).cast("int"))
    first, total = [], 0
    for part, count in sorted(placed.groupBy("_part").count().collect()):
        first.append((part, total))
        total += count
    starts = spark.createDataFrame(first, "_part int, _first long")  # a row a partition
    placed = placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.drop("_part", "_first", "_at"), total
