"""Hard negatives by exact inner-product search in STR-packed R-trees.

Points (quantised vectors) that are equal with id and label are one with a number of copies. They are
dealt by range over label and the coordinate of greatest spread; each partition packs its points into an R-tree
by sort-tile-recursive: sorted by one coordinate and sliced, each slice by the next, down to leaves,
with minimum bounding boxes over leaves and over groups of leaves.

A box gives every coordinate an interval, and so an anchor's inner product with anything in the box an
interval too. A search keeps a queue of boxes, the one with the highest bound first: boxes whose interval
misses the score window, and boxes whose bound lies strictly below the k-th score found, are never opened.

Positives: an anchor first searches the tree that it lies in, while that is packed; the k-th score there is the floor
for all others. Negatives: the five windows of an anchor share one pass, so a leaf is multiplied once.
Trees meet anchors in blocks of bounded size, the trees and the anchors that each task holds; every tree
sees every anchor, as an exact search must, but a tree whose root misses the windows ends at its root.
Each task hands on the best k of its tree only.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; a row
without an id is no anchor and comes last among ties; shorter vectors count as filled up with 0; repeated rows
are rows of their own (a repeated anchor gives its rows as often, and its twins are other rows); components beyond
a 64-bit integer count as its ends, as do scores in the result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.llm.common import discard, materialize

#: Positives of an anchor, and negatives of each positive.
POSITIVES, NEGATIVES = 5, 5
ANCHORS, MOVED, LABELS = 100, 7, 10
#: A negative's score lies between so many hundredths of the positive's.
LOW, HIGH = 80, 100
#: Points of a leaf, leaves of a group, points of a tree, anchors of a block.
LEAF, FAN, TREE, BLOCK = 128, 16, 8192, 16_384
#: Coordinates by which a tree is tiled, those of greatest spread.
AXES = 3
END = 1 << 63


def points(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, label, q, copies``: distinct points with quantised vectors; labels of ids divisible by seven are moved on."""
    x = F.col(vector)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = table.where(F.col("label").isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False)))
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label").cast("bigint") + 1) % LABELS).otherwise(F.col("label").cast("bigint"))
    q = F.transform(x, lambda v: F.floor(256 * v.cast("double")))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), q.alias("q")).groupBy("vec_id", "label", "q").agg(F.count("*").alias("copies"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of integers as rows; shorter ones are filled up with 0."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((len(sizes), max(width or 0, int(sizes.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    return out


def exact(*parts: np.ndarray) -> list[np.ndarray]:
    """The integers as floats where no inner product leaves the integers that floats hold, else as Python's."""
    width = max(p.shape[-1] for p in parts)
    parts = tuple(np.pad(p, [(0, 0)] * (p.ndim - 1) + [(0, width - p.shape[-1])]) for p in parts)
    most = max([1, *(max(abs(int(p.max())), abs(int(p.min()))) for p in parts if p.size)])
    return [p.astype(np.float64 if HIGH * width * most * most < 1 << 53 else object) for p in parts]


def tiled(q: np.ndarray, axes: list[int], leaf: int = LEAF) -> list[np.ndarray]:
    """Sort-tile-recursive: the rows of each leaf."""
    parts = [np.arange(len(q))]
    for depth, axis in enumerate(axes):
        left = len(axes) - depth
        parts = [s for p in parts for s in np.array_split(p[np.argsort(q[p, axis], kind="stable")], max(1, round((-(-len(p) // leaf)) ** (1 / left))))]
    return [s for p in parts for s in np.array_split(p, -(-len(p) // leaf)) if len(s)]


@dataclass
class Tree:
    """Leaves of points with their boxes, and boxes over groups of FAN leaves."""

    place: np.ndarray
    ids: np.ndarray
    nameless: np.ndarray
    labels: np.ndarray
    copies: np.ndarray
    q: np.ndarray
    begin: np.ndarray

    def __post_init__(self):
        self.end = np.append(self.begin[1:], len(self.q))
        self.low, self.high = (of.reduceat(self.q, self.begin, axis=0) for of in (np.minimum, np.maximum))
        self.least, self.most = (of.reduceat(self.labels, self.begin) for of in (np.minimum, np.maximum))
        groups = np.arange(0, len(self.begin), FAN)
        self.group_low, self.group_high = np.minimum.reduceat(self.low, groups, axis=0), np.maximum.reduceat(self.high, groups, axis=0)

    @classmethod
    def of(cls, rows: pa.Table, leaf: int = LEAF) -> Tree:
        ids = rows.column("vec_id").combine_chunks()
        q = matrix(rows.column("q").combine_chunks())
        spread = np.argsort(-q.astype(np.float64).var(axis=0), kind="stable")[:AXES].tolist() if q.shape[1] else []
        leaves = tiled(q, spread, leaf)
        order = np.concatenate(leaves)
        column = lambda name: rows.column(name).to_numpy()[order].astype(np.int64)
        named = ids.fill_null(0).to_numpy(zero_copy_only=False)[order]
        sizes = [len(p) for p in leaves]
        place = column("place") if "place" in rows.column_names else np.arange(len(order))
        return cls(place, named, np.asarray(ids.is_null().to_numpy(zero_copy_only=False))[order], column("label"), column("copies"), q[order], np.cumsum(sizes) - sizes)

    def ready(self, anchors: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree and the anchors with numbers whose inner products are exact."""
        q, low, high, glow, ghigh, anchors = exact(self.q, self.low, self.high, self.group_low, self.group_high, anchors)
        other = object.__new__(Tree)
        other.__dict__ = self.__dict__ | {"q": q, "low": low, "high": high, "group_low": glow, "group_high": ghigh}
        return other, anchors


@dataclass
class Window:
    """A search for the ``k`` best points of the anchor's label (or of any other) with 100 scores in [low, high], no worse than ``floor``."""

    same: bool
    k: int
    low: int | None = None
    high: int | None = None
    floor: int | None = None

    def __post_init__(self):
        self.best: list[tuple[int, bool, int, int, int]] = []  # (-score, nameless, id, row, copies), sorted

    def misses(self, low: int, high: int) -> bool:
        """Whether nothing of a score in [low, high] can be among the best."""
        if self.low is not None and (100 * high < self.low or 100 * low > self.high):
            return True
        return self.floor is not None and high < self.floor

    def take(self, tree: Tree, rows: np.ndarray, scores: np.ndarray) -> None:
        if self.low is not None:
            inside = (100 * scores >= self.low) & (100 * scores <= self.high)
            rows, scores = rows[inside], scores[inside]
        if self.floor is not None:
            inside = scores >= self.floor
            rows, scores = rows[inside], scores[inside]
        if len(rows) > self.k:
            inside = scores >= np.sort(scores)[-self.k]
            rows, scores = rows[inside], scores[inside]
        if not len(rows):
            return
        new = [(-int(s), bool(tree.nameless[r]), int(tree.ids[r]), r, int(tree.copies[r])) for s, r in zip(scores.tolist(), rows.tolist())]
        self.best, held = sorted(self.best + new), 0
        for n, one in enumerate(self.best):
            held += one[4]
            if held >= self.k:
                del self.best[n + 1 :]
                self.floor = max(-one[0], self.floor if self.floor is not None else -one[0])
                break


def search(tree: Tree, anchor: np.ndarray, label: int, windows: list[Window]) -> int:
    """Best-first search of a tree for all windows of one anchor; returns how many leaves were opened."""
    up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
    group_high, group_low = tree.group_high @ up + tree.group_low @ down, tree.group_low @ up + tree.group_high @ down
    queue = [(-int(h), 1, k, int(low)) for k, (low, h) in enumerate(zip(group_low.tolist(), group_high.tolist()))]
    heapq.heapify(queue)
    opened = 0
    while queue:
        bound, level, k, low = heapq.heappop(queue)
        if all(w.floor is not None and -bound < w.floor for w in windows):
            break
        if all(w.misses(low, -bound) for w in windows):
            continue
        if level:
            here = slice(k * FAN, (k + 1) * FAN)
            highs, lows = tree.high[here] @ up + tree.low[here] @ down, tree.low[here] @ up + tree.high[here] @ down
            for j, (lo, hi) in enumerate(zip(lows.tolist(), highs.tolist())):
                leaf = k * FAN + j
                if any((w.same and tree.least[leaf] <= label <= tree.most[leaf] or not w.same and not (tree.least[leaf] == label == tree.most[leaf])) and not w.misses(int(lo), int(hi)) for w in windows):
                    heapq.heappush(queue, (-int(hi), 0, leaf, int(lo)))
            continue
        opened += 1
        rows = np.arange(tree.begin[k], tree.end[k])
        scores, own = tree.q[rows] @ anchor, tree.labels[rows] == label
        for w in windows:
            if not w.misses(low, -bound):
                fit = own if w.same else ~own
                w.take(tree, rows[fit], scores[fit])
    return opened


def bounds(positive: int | None) -> tuple[int | None, int | None]:
    return (None, None) if positive is None else (LOW * positive, HIGH * positive)


def clipped(x: int) -> int:
    return max(-END, min(END - 1, x))


def packed(table: DataFrame, rows_of_tree: int = TREE) -> DataFrame:
    """Trees: one row for each point, ``tree, place`` and the point; of anchors also ``floor``, the k-th best score of their label in their tree."""
    rows = materialize(table)
    count = rows.count()
    spread = rows.select(F.posexplode("q").alias("axis", "x")).groupBy("axis").agg(F.variance("x").alias("v")).orderBy(F.col("v").desc_nulls_last(), "axis").first()
    order = [F.col("label"), F.try_element_at("q", F.lit(spread["axis"] + 1 if spread else 1)), F.xxhash64("vec_id", "q")]
    ranged = rows.repartitionByRange(max(1, -(-count // rows_of_tree)), *order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        every = pa.Table.from_batches(held)
        every = every.sort_by([("vec_id", "ascending"), ("label", "ascending")])
        tree = Tree.of(every)  # places are those in the packed order
        sharp, numbers = tree.ready(tree.q)
        anchors = np.flatnonzero(~tree.nameless & (tree.ids % ANCHORS == 0))
        floors: list[int | None] = [None] * len(tree.q)
        for i in anchors.tolist():
            w = Window(True, POSITIVES + 1)
            search(sharp, numbers[i], int(tree.labels[i]), [w])
            floors[i] = None if w.floor is None else clipped(w.floor)
        part = TaskContext.get().partitionId()
        names = [None if gone else i for i, gone in zip(tree.ids.tolist(), tree.nameless.tolist())]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tree.q) + 1) * tree.q.shape[1], pa.int32()), pa.array(tree.q.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(names), pa.int32()), pa.array(np.arange(len(names)), pa.int32()), pa.array(names, pa.int64()), pa.array(tree.labels), pa.array(tree.copies), lists, pa.array(floors, pa.int64())],
            names=["tree", "place", "vec_id", "label", "copies", "q", "floor"],
        )

    done = materialize(ranged.mapInArrow(pack, "tree int, place int, vec_id bigint, label bigint, copies bigint, q array<bigint>, floor bigint"))
    discard(rows)
    return done



def visited(trees: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """The ``k`` best points of each tree for each anchor and window: ``a_tree, a_place, nth, score, vec_id, copies, tree, place``.

    ``anchors``: ``a_tree, a_place, q, label, floor, windows`` (an array of nth and the score of the positive; null: without bounds).
    """
    anchors = materialize(anchors)
    many, last = anchors.count(), trees.agg(F.max("tree")).first()[0]
    blocks = max(1, -(-many // BLOCK))
    block = F.pmod(F.xxhash64("a_tree", "a_place"), F.lit(blocks)).cast("int")
    found = [("a_tree", pa.int32()), ("a_place", pa.int32()), ("nth", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()), ("copies", pa.int64()), ("tree", pa.int32()), ("place", pa.int32())]

    def meet(here: pa.Table, callers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if here.num_rows and callers.num_rows:
            tree = Tree.of(here)
            sharp, numbers = tree.ready(matrix(callers.column("q").combine_chunks(), tree.q.shape[1]))
            part, place = here.column("tree")[0].as_py(), tree.place.tolist()
            for i, (a_tree, a_place, label, floor, asked) in enumerate(zip(*(callers.column(c).to_pylist() for c in ("a_tree", "a_place", "label", "floor", "windows")))):
                windows = [Window(same, k, *bounds(w["positive"]), floor) for w in asked]
                search(sharp, numbers[i], label, windows)
                for w, one in zip(asked, windows):
                    out += [(a_tree, a_place, w["nth"], clipped(-s), None if gone else v, n, part, place[r]) for s, gone, v, r, n in one.best]
        columns = list(zip(*out)) or [()] * len(found)
        return pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, found)], schema=pa.schema(found))

    left = trees.select("tree", "place", "vec_id", "label", "copies", "q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(last if last is not None else 0))).alias("tree"), block.alias("block"))
    sql = "a_tree int, a_place int, nth int, score bigint, vec_id bigint, copies bigint, tree int, place int"
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(meet, sql)


def first_of(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first ``k`` rows by score, then id, of each of ``keys``, in ``rank``; copies are rows of their own."""
    each = found.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, vector: str = "embedding", rows_of_tree: int = TREE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor and each of its positives."""
    trees = packed(points(table, vector), rows_of_tree)
    anchors = trees.where(F.col("vec_id") % ANCHORS == 0).select(F.col("tree").alias("a_tree"), F.col("place").alias("a_place"), "q", "label", "floor", F.col("vec_id").alias("anchor_id"), F.col("copies").alias("repeats"))
    free = F.array(F.struct(F.lit(0).alias("nth"), F.lit(None).cast("bigint").alias("positive")))
    near = visited(trees, anchors.select("a_tree", "a_place", "q", "label", "floor", free.alias("windows")), True, POSITIVES + 1)
    itself = (F.col("tree") == F.col("a_tree")) & (F.col("place") == F.col("a_place"))
    positives = materialize(first_of(near.withColumn("copies", F.col("copies") - itself.cast("int")), POSITIVES, "a_tree", "a_place").select("a_tree", "a_place", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    asked = positives.where("positive_score >= 0").groupBy("a_tree", "a_place").agg(
        F.sort_array(F.collect_list(F.struct("nth", F.col("positive_score").alias("positive")))).alias("windows")
    )
    callers = anchors.join(asked, ["a_tree", "a_place"]).select("a_tree", "a_place", "q", "label", F.lit(None).cast("bigint").alias("floor"), "windows")
    found = first_of(visited(trees, callers, False, NEGATIVES), NEGATIVES, "a_tree", "a_place", "nth")
    named = found.select("a_tree", "a_place", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    every = named.join(positives, ["a_tree", "a_place", "nth"]).join(anchors.select("a_tree", "a_place", "anchor_id", "repeats"), ["a_tree", "a_place"])
    every = every.withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("bigint"), "repeats")))
    return every.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
