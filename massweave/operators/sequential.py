"""Greedy packing of rows in one global order.

Batches close where a sum passes its budget, so where each would end if it began at a row follows
from running sums alone. Rows are dealt by range in their order. Inside a partition the ends of all possible batches
come from one sorted search, and what a batch leads to from doubled pointers. A partition tells the others two short lists: the rows
at which a batch would still be open at its end, and the rows at its beginning at which one that came in may close. These
lists, whose length a budget bounds, meet in one order; doubled pointers over them tell which batches really are open at
each edge, and a second pass marks the batches that begin inside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.operators.shared import discard, materialize, running

#: Rows of a partition, on average.
PART = 200_000


def ends(before: list[np.ndarray], sizes: list[np.ndarray], budgets: list[int]) -> np.ndarray:
    """For each row the row at which a batch that begins there closes; the number of rows where it stays open."""
    n = len(before[0])
    out = np.full(n, n)
    for b, s, most in zip(before, sizes, budgets):
        out = np.minimum(out, np.searchsorted(b + s, b + most, "right"))
    return np.maximum(out, np.arange(1, n + 1))


def fixed(pointers: np.ndarray) -> np.ndarray:
    """The last row that following the pointers reaches before the end."""
    n = len(pointers)
    last = np.where(pointers < n, pointers, np.arange(n))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            return last
        last = further


def followed(pointers: np.ndarray, start: int) -> np.ndarray:
    """Whether each row is reached from ``start``."""
    n = len(pointers)
    jump, seen = np.append(pointers, n), np.array([start])
    while jump[start] < n:
        seen = np.unique(np.concatenate([seen, jump[seen]]))
        jump = jump[jump]
    out = np.zeros(n + 1, bool)
    out[seen] = True
    return out[:n]


def sequential_pack(df: DataFrame, key: str, order: list[str], budgets: dict[str, int], drop_oversize: bool = True, flush_every: int | None = None, part: int = PART) -> DataFrame:
    """``key, batch``: rows in ``order`` (which must tell them apart), each batch going on until a row would pass a budget or it holds ``flush_every`` rows.

    A row beyond a budget is left out, or is a batch of its own. Budgets are above 0 and sizes whole numbers from 0.
    """
    if not budgets or min(budgets.values()) <= 0 or (flush_every is not None and flush_every <= 0):
        raise ValueError("budgets must be above 0")
    names, limits = [f"_s{i}" for i in range(len(budgets))], list(budgets.values())
    sized = df.withColumns({f"_s{i}": F.col(c).cast("bigint") for i, c in enumerate(budgets)})
    if drop_oversize:
        for s, most in zip(names, limits):
            sized = sized.where(F.col(s) <= most)
    if flush_every is not None:
        sized, names, limits = sized.withColumn("_count", F.lit(1).cast("bigint")), [*names, "_count"], [*limits, flush_every]
    kind = df.schema[key].dataType.simpleString()
    extra = [c for c in order if c != key]
    many = max(1, -(-df.count() // part))
    counted = running(sized.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o_{c}") for c in extra], *names), [f"_o_{c}" if c != key else "_key" for c in order], _place=F.lit(1).cast("bigint"), **{f"_b{n}": F.col(n) for n in names})
    befores = [f"_b{n}" for n in names]
    rows = materialize(counted.select("_key", "_place", *names, *befores).repartitionByRange(many, "_place").withColumn("_part", F.spark_partition_id()))
    lists = [pa.field(f"v{i}", pa.int64()) for i in range(len(names))]
    told = pa.schema([("_part", pa.int32()), ("open", pa.bool_()), ("place", pa.int64()), *lists, ("leads", pa.int64())])

    def numbers(table: pa.Table) -> tuple[pa.Table, list[np.ndarray], list[np.ndarray], np.ndarray]:
        table = table.sort_by("_place")
        each = lambda cs: [table.column(c).to_numpy() for c in cs]
        return table, each(befores), each(names), table.column("_place").to_numpy()

    def tell(table: pa.Table) -> pa.Table:
        """Open rows with the sums that close them, and the first rows with their sums and the open row that each leads to."""
        table, before, size, place = numbers(table)
        to = ends(before, size, limits)
        last = fixed(to)
        still = np.flatnonzero(to == len(place))
        inside = np.ones(len(place), bool)
        for b, s, most in zip(before, size, limits):
            inside &= b + s - b[0] <= most
        heads = np.arange(min(len(place), 1 + int(np.argmin(inside)) if not inside.all() else len(place)))
        at, is_open = np.concatenate([still, heads]), np.arange(len(still) + len(heads)) < len(still)
        values = [np.where(is_open, b[at] + most, (b + s)[at]) for b, s, most in zip(before, size, limits)]
        return pa.table([pa.array([table.column("_part")[0].as_py()] * len(at), pa.int32()), pa.array(is_open), pa.array(place[at]), *map(pa.array, values), pa.array(place[last[at]])], schema=told)

    edges = materialize(rows.groupBy("_part").applyInArrow(tell, f"_part int, open boolean, place bigint, {', '.join(f'v{i} bigint' for i in range(len(names)))}, leads bigint"))
    closing = F.lit(None).cast("bigint")
    for i in range(len(names)):  # the first of the heads whose sum is above; sums grow with places
        above = W.orderBy(F.desc(f"v{i}"), F.desc("open")).rowsBetween(W.unboundedPreceding, -1)
        closing = F.least(closing, F.min(F.when(~F.col("open"), F.col("place"))).over(above))
    jumps = edges.withColumn("closes", F.greatest(closing, F.when(closing.isNotNull(), F.col("place") + 1))).where("open").select("place", "closes")
    heads = edges.where("not open").select(F.col("place").alias("closes"), "leads")
    jumps = materialize(jumps.join(heads, "closes", "left").select("place", "closes", F.col("leads").alias("next")))
    start = edges.where("not open and place = 0").select(F.col("leads").alias("place"))
    seen, jump = materialize(start), jumps.select("place", "next")
    while not jump.where("next is not null").isEmpty():
        more = seen.join(jump, "place").where("next is not null").select(F.col("next").alias("place"))
        grown = materialize(seen.unionByName(more).distinct())
        doubled = materialize(jump.join(jump.select(F.col("place").alias("next"), F.col("next").alias("far")), "next", "left").select("place", F.col("far").alias("next")))
        discard(seen)
        discard(jump)
        seen, jump = grown, doubled
    entries = jumps.join(seen, "place").where("closes is not null").select(F.col("closes").alias("_entry")).unionByName(start.select(F.lit(0).cast("bigint").alias("_entry")))
    parts = edges.where("not open").select("_part", F.col("place").alias("_entry"))
    entered = entries.distinct().join(parts, "_entry").groupBy("_part").agg(F.min("_entry").alias("_entry"))

    def mark(table: pa.Table) -> pa.Table:
        table, before, size, place = numbers(table)
        entry = table.column("_entry")[0].as_py()
        begins = np.zeros(len(place), bool) if entry is None else followed(ends(before, size, limits), int(np.searchsorted(place, entry)))
        return pa.table({"_part": table.column("_part"), key: table.column("_key"), "_own": pa.array(np.cumsum(begins)), "_begins": pa.array(begins)})

    marked = materialize(rows.join(entered, "_part", "left").groupBy("_part").applyInArrow(mark, f"_part int, {key} {kind}, _own bigint, _begins boolean"))
    done = marked.groupBy("_part").agg(F.sum(F.col("_begins").cast("bigint")).alias("_n"))
    base = done.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    out = marked.join(base, "_part").select(key, (F.col("_base") + F.col("_own") - 1).alias("batch"))
    for used in (rows, edges, jumps):
        discard(used)
    return out
