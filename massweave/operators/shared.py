"""Intermediate tables in the folder that driver and executors share, and running sums over a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) that names none gets a temporary folder; on a cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/massweave-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: lineage ends here."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._massweave_path = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes the table of a ``materialize`` that no later step reads."""
    path = getattr(df, "_massweave_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def dealt(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """``df`` dealt by ``by`` into the session's shuffle partitions, or into so many that about ``rows`` are in one, if that is more.

    What later steps hold by these keys stays in that partitioning, so a task's memory doesn't grow with the table. The count of a Parquet table reads footers only.
    """
    parts = -(-df.count() // rows)
    return df.repartition(parts, *by) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*by)


def spread_out(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """``df`` dealt by ``by`` into partitions of about ``rows`` rows, for steps that make many rows of each. The number is a given one, which adaptive execution doesn't lower."""
    parts = -(-df.count() // rows)
    return df.repartition(parts, *by) if parts > 1 else df


def running(df: DataFrame, order: list[Column | str], **sums: Column) -> DataFrame:
    """``df`` with, for each of ``sums``, the sum over all rows that come before in ``order`` (which tells rows apart).

    Rows are dealt by range and summed up by partition; only these sums, one row for each partition, meet in one place.
    """
    ranged = materialize(df.withColumns({f"_own_{k}": c for k, c in sums.items()}).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    here = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(*[F.sum(f"_own_{k}").alias(f"_sum_{k}") for k in sums])
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_sum_{k}").over(here), F.lit(0)).alias(f"_base_{k}") for k in sums])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    every = ranged.join(parts, "_part").withColumns({k: F.col(f"_base_{k}") + F.coalesce(F.sum(f"_own_{k}").over(inside), F.lit(0)) for k in sums})
    return every.drop("_part", *[f"_{w}_{k}" for k in sums for w in ("own", "base")])
