"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut into chunks at places that its own content decides. A chunk's identifier is its
64-bit hash together with a variant number; the variant is 0 unless two different chunks were seen
under one hash, which a single pass over the distinct chunks verifies. The ordered list of
identifiers is the document's recipe, and texts are equal exactly when their recipes are. Only that
verifying pass moves text, once and after a map-side distinct; comparing moves the short recipes.

Defined results: a null text counts as empty; an empty text has the empty recipe, so all empty
texts are one group; a null ``doc_id`` sorts after every other (it stays only in a group of nulls);
of repeated rows (same ``doc_id``, equal text) the one stays whose columns hash lowest; an empty table
gives no rows; other columns are never compared, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massweave.llm.common import ROW, materialize, numbered_rows, rows_named, shielded, squeezed, text_of, tie

#: A chunk ends, 128 characters in at the earliest, at the first two windows of three characters, side by side, whose last is
#: their first; where 2,000 characters have none (a large alphabet), at the first such window; a stretch of 4,608 without one is a chunk.
#: So its ends are rare against its least length in any script, and after an insertion chunks soon end where they did.
CHUNK = r"(?s).{128,2000}?(.).\1(.).\2|.{128,4608}?(.).\3|.{1,4608}"


def chunks(text: Column) -> Column:
    """The ordered chunks of a text; joined again they give the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_key(chunk: Column, bits: int = 64) -> Column:
    """The chunk's hash; fewer ``bits`` force collisions in tests."""
    key = F.xxhash64(chunk)
    return key if bits == 64 else key.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """ROW, ``doc_id, tie, text_sha256, recipe`` with a recipe of verified identifiers for each row of ``docs``, which ``numbered_rows`` has named."""
    cut = docs.select(*ROW, "doc_id", tie(docs).alias("tie"), squeezed(text_of()).alias("norm"))
    distinct = (
        cut.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
        .select(chunk_key(F.col("chunk"), bits).alias("key"), "chunk")
        .distinct()
    )
    shared = materialize(distinct.groupBy("key").agg(F.count("*").alias("contents")).where("contents > 1").select("key"))
    sha = F.sha2(F.col("norm"), 256).alias("text_sha256")
    if shared.isEmpty():
        ids = F.transform(chunks(F.col("norm")), lambda c: F.struct(chunk_key(c, bits).alias("key"), F.lit(0).alias("variant")))
        return cut.select(*ROW, "doc_id", "tie", sha, ids.alias("recipe"))
    # Several contents under one hash: number them in the order of their text, and put the numbers into the recipes.
    twins = distinct.join(shared, "key", "left_semi")
    below = twins.select("key", F.col("chunk").alias("other"))
    numbered = twins.join(below, "key").groupBy("key", "chunk").agg(F.sum(F.when(F.col("other") < F.col("chunk"), 1).otherwise(0)).cast("int").alias("variant"))
    parts = cut.select(*ROW, "doc_id", "tie", sha, F.posexplode_outer(chunks(F.col("norm"))).alias("pos", "chunk")).withColumn("key", chunk_key(F.col("chunk"), bits))
    named = parts.join(numbered, ["key", "chunk"], "left").withColumn("id", F.struct("key", F.coalesce("variant", F.lit(0)).alias("variant")))
    ids = F.filter(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda p: p["pos"].isNotNull())
    return named.groupBy(*ROW, "doc_id", "tie", "text_sha256").agg(F.transform(ids, lambda p: p["id"]).alias("recipe"))


def exact_rows(docs: DataFrame, bits: int = 64) -> DataFrame:
    """ROW and ``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``, which ``numbered_rows`` has named.

    A group of any size is one pre-aggregated row on one side of the join back. Both sides are written
    first, so the join has an exchange of its own on both sides and adaptive execution can split the
    partition of a group that holds a third of all rows.
    """
    rows = materialize(recipes(docs, bits))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "tie", *ROW)
    groups = materialize(rows.groupBy("recipe").agg(F.min(first).alias("first"), F.count("*").alias("group_size")))
    kept = (F.col(ROW[0]) == F.col(f"first.{ROW[0]}")) & (F.col(ROW[1]) == F.col(f"first.{ROW[1]}"))
    return rows.join(groups, "recipe").select(*ROW, "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    return exact_rows(numbered_rows(docs), bits).drop(*ROW)


@shielded
def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: the smallest ``doc_id`` of each group of equal texts."""
    docs = numbered_rows(docs)
    return rows_named(docs, exact_rows(docs).where("kept"))
