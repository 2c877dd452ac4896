"""Nearest-value joins without a reach: both sides in one order, values carried across the edges of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.operators.shared import materialize


#: Rows that one task sorts.
ROWS = 500_000


def neighbours(left: DataFrame, right: DataFrame, by: list[str], x: str, y: str, *ties: str, parts: int | None = None) -> DataFrame:
    """Each row of ``left`` with the rows of ``right`` (as structs ``before`` and ``after``, null where there is none) of equal ``by`` whose ``y``
    is the last up to ``x`` and the first from ``x`` on; of rows with equal ``y`` the one whose ``ties`` come first.

    Rows of both sides are dealt by range over ``by`` and the value, so a group of any size is spread, into ``parts`` partitions or the session's. Inside a
    partition the last row of ``right`` is carried along, from below and from above; what a partition hands on to the next is one row. Rows with a null key or
    value have no neighbours; those of ``left`` stay. Groups within partitions are sorted in tasks of about ``ROWS`` rows, however many rows there are.
    """
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    rest = [c for c in right.columns if c not in (*by, y, *ties)]
    one = F.struct(F.col(y), *[F.col(c) for c in (*ties, *rest)])
    whole = right.where(F.col(y).isNotNull())
    for k in by:
        whole = whole.where(F.col(k).isNotNull())
    distinct = whole.groupBy(*keys, F.col(y).cast("double").alias("_v")).agg(F.min(one).alias("_r"))
    own = F.struct(*left.columns)
    rows = left.select(*keys, F.col(x).cast("double").alias("_v"), own.alias("_l")).unionByName(distinct, allowMissingColumns=True)
    order = [*names, "_v", F.col("_l").isNotNull(), F.xxhash64(F.col("_l").cast("string"))]
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ranged = materialize(dealt.withColumn("_part", F.spark_partition_id()))
    at = F.struct(*names, "_v", "_r")
    here = F.when(F.col("_r").isNotNull(), at)
    edges = ranged.groupBy("_part").agg(F.min(here).alias("_first"), F.max(here).alias("_last"))
    earlier, later = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select("_part", F.last("_last", True).over(earlier).alias("_from"), F.last("_first", True).over(later).alias("_to"))
    inside = W.partitionBy("_part", *names)
    up = inside.orderBy(F.col("_v"), F.col("_l").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    down = inside.orderBy(F.col("_v").desc(), F.col("_l").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    tasks = -(-ranged.count() // ROWS)
    if tasks > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        ranged = ranged.repartition(tasks, "_part", *names)
    met = ranged.withColumns({"_up": F.last("_r", True).over(up), "_down": F.last("_r", True).over(down)}).where("_l is not null").join(F.broadcast(edges), "_part")  # a row for each partition

    def same(edge: str) -> Column:
        out = F.col("_v").isNotNull()
        for k in names:
            out = out & (F.col(k) == F.col(f"{edge}.{k}"))
        return out

    valid = F.col("_v").isNotNull()
    for k in names:
        valid = valid & F.col(k).isNotNull()
    before = F.when(valid, F.coalesce("_up", F.when(same("_from"), F.col("_from._r"))))
    after = F.when(valid, F.coalesce("_down", F.when(same("_to"), F.col("_to._r"))))
    return met.select("_l.*", before.alias("before"), after.alias("after"))


def nearest_value(left: DataFrame, right: DataFrame, by: list[str], x: str, y: str, *ties: str, parts: int | None = None) -> DataFrame:
    """Rows of ``left`` with the row of ``right`` (all its columns but ``by``) of least distance ``abs(x - y)``, then least ``y``, then ``ties``."""
    found = neighbours(left, right, by, x, y, *ties, parts=parts)
    low, high = F.abs(F.col(x) - F.col(f"before.{y}")), F.abs(F.col(x) - F.col(f"after.{y}"))
    nearer = F.when(F.col("after").isNull() | (low <= high), F.col("before")).otherwise(F.col("after"))
    return found.withColumn("_near", nearer).where("_near is not null").select(*left.columns, "_near.*")
