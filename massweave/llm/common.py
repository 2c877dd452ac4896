"""What the operators of this subpackage share: the shared folder, text helpers, row matching."""

from __future__ import annotations

import gc
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.operators.shared import discard, materialize, running  # noqa: F401

#: The white space of every contract here: space and U+0009 to U+000D, nothing else.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: What names a row of a table: its file's hash and its place there.
ROW = ["_mw_file", "_mw_row"]


#: Steps of a plan that give each row of a file at most once.
PLAIN = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}


def plain_scan(df: DataFrame) -> bool:
    """Whether the plan is one scan of files below projections and filters; a join, generator, sample or union gives several rows one place."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in PLAIN:
        if not node.children().size():
            return "HadoopFsRelation" in node.relation().getClass().getName() if node.nodeName() == "LogicalRelation" else False
        node = node.children().head()
    return False


def numbered_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ROW. Rows of a plain scan are named by where they are; any other frame is written to the shared folder first."""
    rows = docs if plain_scan(docs) else materialize(docs)
    meta = rows.metadataColumn("_metadata")
    return rows.select("*", F.xxhash64(meta["file_path"]).alias(ROW[0]), meta["row_index"].alias(ROW[1]))


def shielded(stage):
    """A stage over documents whose own names (those that begin with ``_mw_``) may be columns of its input: they are renamed meanwhile."""

    @wraps(stage)
    def run(docs: DataFrame, *more, **named) -> DataFrame:
        clash = [c for c in docs.columns if c.lower().startswith("_mw_")]
        if not clash:
            return stage(docs, *more, **named)
        free = "x" * (1 + max(map(len, docs.columns)))
        away = {c: f"{free}{i}" for i, c in enumerate(clash)}
        return stage(docs.withColumnsRenamed(away), *more, **named).withColumnsRenamed({v: k for k, v in away.items()})

    return run


def tie(docs: DataFrame) -> Column:
    """A hash of all columns that puts rows of one doc_id and text in an order that doesn't depend on where they are."""
    return F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if c not in ROW and "map<" not in kind and "variant" not in kind])


def rows_named(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` (as ``numbered_rows`` gives them) that ``kept`` names; each text moves once."""
    return docs.join(kept.select(*ROW), ROW, "left_semi").drop(*ROW)


def released(spark: SparkSession) -> None:
    """Has the driver collect its garbage, on which Spark deletes the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches to Python bounded by bytes unless the session bounds them itself."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > (1 << 26):
        spark.conf.set(key, str(1 << 25))
    return df


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def squeezed(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, SPACES, " ")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
