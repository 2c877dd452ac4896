"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Each source has a weight schedule over training time t in [0, 1]: linear, from ``w * (1 + ramp)``
to ``w * (1 - ramp)``; the ramp's sign alternates from source to source. Its integral, w, sets the
source's share of all words. The schedule's running integral D(t) is the part of that share due by
time t; a document (or a copy of it) whose middle lies at the part u of its source's stream gets
the position t = D^-1(u), and sorting by position gives the training order.

Defined results: a null text has size 0; a null source is a source of its own and comes last; a
document of size 0 is taken with 0 words and has no position; a null ``doc_id`` is mixed like any
other; repeated rows are rows of their own (of rows with one ``doc_id`` the one whose columns hash
lower comes first); an empty table gives no rows; other columns take no part but in that hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.llm.common import ROW, WORD, materialize, numbered_rows, running, shielded, text_of, tie

#: Weights of the sources in order, again and again.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST = 3
#: How far a source's weight moves from its mean over the training time.
RAMP = 0.5
#: A word with the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
#: Documents in one stretch of a source's stream, on average at most; a stretch is summed in one task.
STRETCH = 500
#: Times that, from which a stretch (of rows that share a doc_id, or have none) is dealt again by a hash of the rows.
CROWDED = 8


def sizes(docs: DataFrame) -> DataFrame:
    """ROW, ``doc_id, src_null, src, size, ord, tie``: words of each row and its order in its source's stream; ``docs`` has its rows named."""
    return docs.select(
        *ROW,
        "doc_id",
        F.col("source").isNull().alias("src_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("bigint").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("ord"),
        tie(docs).alias("tie"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, ramp: float = RAMP) -> DataFrame:
    """One row for each source: its size, target, the words to take, its ramp, and the words of all sources before it.

    With sources in the order of (limit / weight), the level at which the limits of those before are
    reached rises and then falls; its maximum is the level that leaves no source above its limit.
    Sources are ranked and summed up by range, so their number is not bounded by a task.
    """
    per = rows.groupBy("src_null", "src").agg(F.sum("size").alias("source_size"))
    per = running(per, ["src_null", "src"], rank=F.lit(1), earlier=F.col("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("limit", most * F.col("source_size"))
    per = materialize(running(per, [F.col("limit") / F.col("weight"), F.col("rank")], limits=F.col("limit"), weighed=F.col("weight")))
    size, weight = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = per.agg(F.max((F.lit(size) - F.col("limits")) / (F.lit(weight) - F.col("weighed")))).first()[0]
    per = per.withColumn("target", F.least(F.col("limit").cast("double"), F.lit(level).cast("double") * F.col("weight")))
    per = per.withColumn("take", F.floor(F.col("target") + 0.5))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0)
    return per.withColumn("whole", whole.cast("bigint")).select(
        "src_null", "src", "source_size", "earlier", "target", "take", "whole",
        (F.col("take") - F.col("whole") * F.col("source_size")).alias("rest"),
        F.when(F.col("rank") % 2 == 0, F.lit(float(ramp))).otherwise(F.lit(-float(ramp))).alias("ramp"),
    )


def position(u: Column, ramp: Column) -> Column:
    """The time t at which the part ``u`` of the demand (1 + r) t - r t^2 is reached."""
    return F.when(ramp == 0, u).otherwise(((1 + ramp) - F.sqrt((1 + ramp) * (1 + ramp) - 4 * ramp * u)) / (2 * ramp))


def assign(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, ramp: float = RAMP) -> DataFrame:
    """One row for each row of ``docs``, which ``numbered_rows`` has named: ROW, ``doc_id, src_null, src, size, source_size, target, copies``.

    ``copies`` lists what the mix takes: ``words`` of the document (all, or fewer for the one
    document at which a source's target is reached) and the copy's ``position``.

    A source's running sum goes over stretches of its stream: sums of stretches first, then sums
    within a stretch, so a source that holds a third of all rows is many groups. Stretches are cut by
    a hash of doc_id; one that is crowded all the same is cut again by a hash of the rows.
    """
    rows = materialize(sizes(docs))
    stretches = max(1, -(-rows.count() // STRETCH))
    stretch = F.floor(F.conv(F.substring("ord", 1, 8), 16, 10).cast("bigint") * stretches / F.lit(1 << 32))
    rows = rows.withColumn("stretch", stretch)
    src = ["src_null", "src"]
    crowded = materialize(rows.groupBy(*src, "stretch").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED * STRETCH))
    if crowded.isEmpty():
        rows = rows.withColumn("cut", F.lit(0).cast("bigint"))
    else:
        cuts = F.coalesce(F.ceil(F.col("n") / STRETCH), F.lit(1))
        shuffled = F.xxhash64("tie", *ROW)
        rows = rows.join(crowded, [*src, "stretch"], "left").withColumn("cut", F.pmod(shuffled, cuts)).drop("n")
    at = [*src, "stretch", "cut"]
    starts = running(rows.groupBy(*at).agg(F.sum("size").alias("words")), at, all_before=F.col("words"))
    starts = starts.join(targets(rows, weights, most, ramp), src).withColumn("before", F.col("all_before") - F.col("earlier")).drop("words", "all_before", "earlier")
    inside = F.sum("size").over(W.partitionBy(*at).orderBy("ord", "doc_id", "size", "tie", *ROW).rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = rows.join(starts, at).withColumn("at", F.col("before") + inside)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at")))
    copy = lambda k, words: F.struct(words.cast("bigint").alias("words"), position((k * F.col("source_size") + F.col("at") + words / 2) / F.col("take"), F.col("ramp")).alias("position"))
    full = F.transform(F.sequence(F.lit(1), F.col("whole")), lambda k: copy(k - 1, F.col("size")))
    none = F.array().cast("array<struct<words:bigint,position:double>>")
    copies = F.when(F.col("size") == 0, none).otherwise(F.concat(F.when(F.col("whole") > 0, full).otherwise(none), F.when(extra > 0, F.array(copy(F.col("whole"), extra))).otherwise(none)))
    return placed.select(*ROW, "doc_id", *src, "size", "source_size", "target", copies.alias("copies"))


def by_position(rows: DataFrame, position: Column) -> DataFrame:
    """``rows`` sorted by position over all partitions. Positions lie in [0, 1] and near even, so even cuts deal them out without a look at them."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.least(F.floor(F.coalesce(position, F.lit(0.0)) * n), F.lit(n - 1)).cast("int")
    return rows.repartitionById(n, part).sortWithinPartitions(position, "doc_id")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """Documents with the words taken and the position of the first copy, sorted by position."""
    rows = assign(numbered_rows(docs), **how).select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("copies", F.lit(0).cast("bigint"), lambda n, c: n + c["words"]).alias("taken"),
        F.when(F.size("copies") > 0, F.col("copies")[0]["position"]).alias("position"),
    )
    return rows.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


@shielded
def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, in training order: repeated, left out, or (one document of a source) cut after the words taken.

    Texts move twice: to meet what is taken of them, and to their place in the order.
    """
    names, docs = docs.columns, numbered_rows(docs)
    picked = assign(docs, **how).where(F.size("copies") > 0).select(*ROW, F.col("size").alias("_mw_size"), F.col("copies").alias("_mw_copies"))
    taken = docs.join(materialize(picked), ROW).withColumn("_mw_copy", F.explode("_mw_copies")).drop("_mw_copies")
    cut = F.array_join(F.slice(F.regexp_extract_all(text_of(), F.lit(SPACED_WORD), F.lit(0)), 1, F.col("_mw_copy.words").cast("int")), "")
    ordered = by_position(taken, F.col("_mw_copy.position"))
    return ordered.select(*[F.when(F.col("_mw_copy.words") < F.col("_mw_size"), cut).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in names])
