"""SimHash near-dedup: segment-popcount embedding, grid range-join, exact verification.

A fingerprint's 64 bits are 32 segments of two; a segment's bit count is 0, 1 or 2. The Manhattan
distance of two count vectors is at most the Hamming distance of the fingerprints. Counts are kept
as a thermometer code (0: 00, 1: 01, 2: 11), for which that distance is a population count.

Grid: the segments form six blocks. Vectors within a distance of four agree in two blocks at least,
so each fingerprint goes to the 15 grid cells that a pair of blocks and its counts there name. In a
cell the Manhattan distance is tested first, then the Hamming distance. A cell only hands on a
spanning star of each of its groups, never all its pairs.

One fingerprint of 64 bits finds copies with few edits only, so near-dedup takes PRINTS of them, over
words in fives, from one hash of each shingle mixed anew: documents alike by 0.85 to 0.9 of their shingles agree
to four bits in one fingerprint in four to ten. A link in any of them is a link.

Skew: equal fingerprints become one row before anything is compared. A cell beyond CELL members is
dealt again by the blocks of its other segments; one that is still beyond goes in pairs of blocks of
rows. No link is lost on either way.

Defined results: null and empty texts have the fingerprint 0 and link like any other; a null
``doc_id`` takes part, and ``component_id`` is null only where all doc_ids of a group are; repeated
rows get a row each, and of rows with the smallest ``doc_id`` the one stays whose columns hash lowest;
an empty table gives no rows; other columns are never compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.llm.arrow import by_bytes, table
from massweave.llm.common import ROW, discard, materialize, numbered_rows, rows_named, shielded, small_batches, tie
from massweave.llm.components import components

#: Words of a shingle: of the one fingerprint of ``near_components``, and of the fingerprints of ``near_dedup``.
SHINGLE, WIDE = 4, 5
SEED = 42
#: Fingerprints that near-dedup compares.
PRINTS = 12
BITS = 4
#: Members of a grid cell that one task compares.
CELL = 50_000
#: Up to so many members a cell is compared in step with others, beyond it on its own.
SMALL = 256
ODD = 0x5555555555555555


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles, repeats included; none for a text without words."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-width].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())), dtype=np.uint64, count=len(starts))


def fingerprint(text: str) -> int:
    """The text's 64 majority bits as a signed number."""
    return majorities(shingle_hashes(text), 1)[0]


def majorities(hashes: np.ndarray, prints: int) -> list[int]:
    """Majority bits of the hashes, then of the hashes mixed anew for each further fingerprint; 0 without hashes."""
    if not len(hashes):
        return [0] * prints
    ones = np.zeros((prints, 64), dtype=np.int64)
    salt = (np.arange(prints, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for a in range(0, len(hashes), 4096):
        h = hashes[None, a : a + 4096]
        if prints > 1:
            z = h + salt
            z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            h = np.where(salt == 0, h, z ^ z >> np.uint64(31))
        bits = np.unpackbits(np.ascontiguousarray(h).astype("<u8").view(np.uint8).reshape(prints, -1, 8), axis=2, bitorder="little")
        ones += bits.sum(axis=1, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def fingerprints(docs: DataFrame, prints: int = 1, width: int = SHINGLE) -> DataFrame:
    """ROW, ``doc_id, tie, fps`` for each row of ``docs``, which ``numbered_rows`` has named."""

    def encode(batches):
        schema = None
        for batch, texts in by_bytes(batches):
            schema = schema or pa.schema([f for f in batch.schema if f.name != "text"] + [("fps", pa.list_(pa.int64()))])
            found = pa.array([majorities(shingle_hashes(t, width), prints) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema if f.name != "fps"), found], schema=schema)

    rows = docs.select(*ROW, "doc_id", tie(docs).alias("tie"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(encode, f"{ROW[0]} bigint, {ROW[1]} bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie bigint, fps array<bigint>")


def long(x: int) -> int:
    """64 bits as a signed number."""
    return x - (1 << 64) if x >> 63 else x


def counts_code(x: np.ndarray) -> np.ndarray:
    """The thermometer code of the bit counts of the 32 segments."""
    odd = np.uint64(ODD)
    low, high = x & odd, (x >> np.uint64(1)) & odd
    return low | high | ((low & high) << np.uint64(1))


def counts_column(x: Column) -> Column:
    odd = F.lit(ODD)
    low, high = x.bitwiseAND(odd), F.shiftrightunsigned(x, 1).bitwiseAND(odd)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def block_masks(fixed: int = 0) -> list[int]:
    """Masks of each pair out of six blocks of the segments that are free, with the fixed ones."""
    free = [s for s in range(32) if not fixed >> 2 * s & 1]
    blocks = [sum(3 << 2 * s for s in free[k::6]) for k in range(6)]
    return [fixed | a | b for a, b in combinations(blocks, 2)]


def cells(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """``nth, mask, key, part, fp``: the grid cells of each fingerprint; together they hold every pair of one ``nth`` that links."""
    spark, of = fps.sparkSession, ["nth", "mask", "key"]
    grid = lambda df: df.select("nth", "mask", counts_column(F.col("fp")).bitwiseAND(F.col("mask")).alias("key"), F.lit("").alias("part"), "fp")
    coarse = grid(fps.select("nth", "fp", F.explode(F.array(*[F.lit(long(m)) for m in block_masks()])).alias("mask")))
    if fps.count() <= cell:
        return coarse
    crowded = lambda df: materialize(df.groupBy(*of).agg(F.count("*").alias("n")).where(F.col("n") > cell))
    hot = crowded(coarse)
    if hot.isEmpty():
        return coarse
    finer = spark.createDataFrame([(long(m), long(f)) for m in block_masks() for f in block_masks(m)], "mask bigint, finer bigint")
    again = coarse.join(hot.select(*of), of, "left_semi").join(F.broadcast(finer), "mask").select("nth", F.col("finer").alias("mask"), "fp").distinct()
    fine = materialize(grid(again))
    still = crowded(fine)
    rest = coarse.join(hot.select(*of), of, "left_anti").unionByName(fine.join(still.select(*of), of, "left_anti"))
    blocks = F.ceil(F.col("n") / (cell / 2)).cast("int")
    dealt = fine.drop("part").join(still, of).withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rest.unionByName(dealt.select(*of, F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")).alias("part"), "fp"))


def close(x: np.ndarray, y: np.uint64, bits: int) -> np.ndarray:
    """Where in ``x`` the Manhattan distance of the counts allows a link and the Hamming distance confirms it."""
    hit = np.bitwise_count(counts_code(x) ^ counts_code(y)) <= bits
    where = np.flatnonzero(hit)
    hit[where] = np.bitwise_count(x[where] ^ y) <= bits
    return hit


def stars_of_small(x: np.ndarray, size: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that ``places_of_small`` links."""
    member, centre = places_of_small(x, size, bits)
    return x[member], x[centre]


def places_of_small(x: np.ndarray, size: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, centre) of many small cells in step; ``size``: rows from each row to its cell's end, itself included."""
    code, left, right = counts_code(x), [], []
    i = np.flatnonzero(size > 1)
    for d in range(1, int(size.max(initial=0))):
        i = i[size[i] > d]
        j = i + d
        may = np.bitwise_count(code[i] ^ code[j]) <= bits
        a, b = i[may], j[may]
        sure = np.bitwise_count(x[a] ^ x[b]) <= bits
        left.append(a[sure])
        right.append(b[sure])
    a, b = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (left, right))
    root = np.arange(len(x))
    while len(a):  # the smallest row of each group, by passing on the smaller root
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            break
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
    member = np.flatnonzero(root != np.arange(len(x)))
    return member, root[member]


def stars_of_large(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that ``places_of_large`` links."""
    member, centre = places_of_large(x, bits)
    return x[member], x[centre]


def places_of_large(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, centre) of one cell: what a row has reached is not compared again, so a dense cell costs little more than its size."""
    free, members, centres = np.arange(len(x)), [], []
    while len(free) > 1:
        centre, free, todo = free[0], free[1:], [free[0]]
        while todo and len(free):
            hit = close(x[free], x[todo.pop()], bits)
            if hit.any():
                new = free[hit]
                members.append(new)
                centres.append(np.full(len(new), centre))
                todo += new.tolist()
                free = free[~hit]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(members), np.concatenate(centres)) if members else (none, none)


def cell_links(batches, bits: int = BITS):
    """Links ``nth, a, b`` from rows ``nth, mask, key, part, fp`` that come sorted by cell."""
    schema = pa.schema([("nth", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def links(x: np.ndarray, first: np.ndarray):
        """``first``: where cells begin."""
        sizes = np.diff(first, append=len(x))
        for k in np.flatnonzero(sizes > SMALL):
            a, b = places_of_large(x[first[k] : first[k] + sizes[k]], bits)
            yield first[k] + a, first[k] + b
        keep = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
        small = sizes[sizes <= SMALL]
        ends = np.repeat(np.cumsum(small), small)
        a, b = places_of_small(x[keep], ends - np.arange(len(ends)), bits)
        yield keep[a], keep[b]

    held: list[pa.RecordBatch] = []

    def work(rows: pa.Table, first: np.ndarray):
        fp, nth = rows.column("fp").to_numpy(), rows.column("nth").to_numpy()
        for a, b in links(fp.view(np.uint64), first):
            if len(a):
                yield table(schema, nth=nth[a], a=fp[a], b=fp[b])

    def starts(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, dtype=bool)
        new[0] = True
        for c in ("nth", "mask", "key"):
            v = rows.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        part = rows.column("part").combine_chunks()
        if pc.any(pc.not_equal(part, "")).as_py():
            v = part.to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        first = starts(rows)
        if len(first) > 1:  # the last cell may go on in the next batch
            yield from work(rows.slice(0, int(first[-1])), first[:-1])
            held = rows.slice(int(first[-1])).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield from work(rows, starts(rows))


def numbered_prints(groups: DataFrame, bits: int = 64) -> DataFrame:
    """``groups`` with the number ``node`` of their ``fps``, which no two share: the only fingerprint, or a hash of several with those that collide told apart.

    Fewer ``bits`` of the hash make collisions in tests.
    """
    key = F.xxhash64("fps") if bits == 64 else F.xxhash64("fps").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    keyed = groups.withColumn("node", F.when(F.size("fps") > 1, key).otherwise(F.col("fps")[0]))
    twin = F.row_number().over(W.partitionBy("node").orderBy("fps"))
    return keyed.withColumn("twin", twin).withColumn("node", F.when(F.col("twin") > 1, F.xxhash64("node", "twin")).otherwise(F.col("node"))).drop("twin")


def near_components(docs: DataFrame, bits: int = BITS, cell: int = CELL, prints: int = 1, width: int = SHINGLE) -> DataFrame:
    """ROW and ``doc_id, fp, component_id, stays`` for each row of ``docs``, which ``numbered_rows`` has named; ``fp``: its first fingerprint.

    ``component_id``: the smallest doc_id reachable over links; ``stays``: whether near-dedup keeps the row, one of each component.
    """
    rows = materialize(fingerprints(docs, prints, width))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", *ROW)
    nodes = materialize(numbered_prints(rows.groupBy("fps").agg(F.min(first).alias("keep"))))
    each = nodes.select("node", F.posexplode("fps").alias("nth", "fp"))
    fps = materialize(each.groupBy("nth", "fp").agg(F.min("node").alias("own"), F.count("*").alias("n")))
    order = ["nth", "mask", "key", "part"]
    grid = cells(fps.select("nth", "fp"), cell).repartition(*order).sortWithinPartitions(*order)
    links = grid.mapInArrow(lambda batches: cell_links(batches, bits), "nth int, a bigint, b bigint")
    if prints > 1:  # a link of fingerprints is one of the documents that have them
        known = fps.select("nth", "fp", "own")
        named = links.join(known.toDF("nth", "a", "x"), ["nth", "a"]).join(known.toDF("nth", "b", "y"), ["nth", "b"])
        shared = each.join(fps.where("n > 1").select("nth", "fp", "own"), ["nth", "fp"]).where("node <> own")
        links = named.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(shared.select(F.col("node").alias("a"), F.col("own").alias("b")))
    roots = components(links.select("a", "b"))
    named = nodes.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "fps", F.coalesce("root", "node").alias("root"), "keep")
    groups = named.groupBy("root").agg(F.min("keep").alias("keep"))
    known = materialize(named.select("fps", "root").join(groups, "root").select("fps", "keep"))
    discard(fps)
    stays = (F.col(ROW[0]) == F.col(f"keep.{ROW[0]}")) & (F.col(ROW[1]) == F.col(f"keep.{ROW[1]}"))
    return rows.join(known, "fps").select(*ROW, "doc_id", F.col("fps")[0].alias("fp"), F.col("keep.doc_id").alias("component_id"), stays.alias("stays"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@shielded
def near_dedup(docs: DataFrame, bits: int = BITS, prints: int = PRINTS, width: int = WIDE) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component over several fingerprints."""
    docs = numbered_rows(docs)
    return rows_named(docs, near_components(docs, bits, prints=prints, width=width).where("stays"))
