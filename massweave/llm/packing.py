"""Packing documents into sequences: first-fit decreasing over a tournament tree of bin capacities.

Encoding leaves the texts where they are: a task turns each document into its number of tokens and
checksums, of every full sequence cut from its front and of its tail, whole and in powers of two.
Only these few numbers go to randomised groups, and each group is packed on its own: full pieces
are sequences, tails go by first-fit decreasing. Bins left with more than SLACK empty places are
taken apart; their tails are cut in powers of two, which fill sequences exactly, and what is left
over at the end becomes sequences whose length is a power of two, which need no padding.

Defined results: a null or empty text is one document of its end token; a null ``doc_id`` is packed
like any other; repeated rows are documents of their own; groups are dealt by a row's place in the
input, ties in length go by ``doc_id`` and checksum; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massweave.llm.arrow import by_bytes, table
from massweave.llm.common import ROW, numbered_rows, small_batches
from massweave.llm.tokens import byte_encoder, vocabulary

VOCABULARY = "byte_bpe_50k.json"
LENGTH = 1024
#: Empty places that a sequence may keep.
SLACK = 16
#: Documents in a group on average; a group is packed in one task.
GROUP = 4096
END = bytes(4)


def powers(n: int) -> list[int]:
    """``n`` as falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Bins:
    """Bins in order, with a tournament tree that finds the first one with enough room."""

    def __init__(self, most: int, length: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.room = [length] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``, and its room left."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        left = room[k] = room[k] - size
        at = k - self.leaves
        while k > 1:
            k //= 2
            room[k] = max(room[2 * k], room[2 * k + 1])
        return at, left


def pack(sizes: list[int], length: int) -> list[list[int]]:
    """First-fit: for each bin the indices of ``sizes``, given in falling order."""
    bins, out = Bins(len(sizes), length), []
    for i, size in enumerate(sizes):
        at, _ = bins.place(size)
        if at == len(out):
            out.append([])
        out[at].append(i)
    return out


def pack_group(docs: dict[str, list], length: int = LENGTH, slack: int = SLACK) -> list[list[tuple]]:
    """The sequences of a group; each a list of pieces (row, start, length, checksum)."""
    sequences, tails = [], []
    for row, (tokens, full, tail, parts) in enumerate(zip(docs["doc_tokens"], docs["full_crcs"], docs["tail_crc"], docs["part_crcs"])):
        sequences += [[(row, k * length, length, crc)] for k, crc in enumerate(full)]
        start = len(full) * length
        if tokens > start:
            tails.append((row, start, tokens - start, tail, parts))
    tails.sort(key=lambda t: -t[2])
    loose = []
    for one in pack([t[2] for t in tails], length):
        pieces = [tails[i] for i in one]
        filled = sum(p[2] for p in pieces)
        if length - filled <= slack or filled & (filled - 1) == 0:
            sequences.append([p[:4] for p in pieces])
            continue
        for row, start, size, _, parts in pieces:
            for part, crc in zip(powers(size), parts):
                loose.append((row, start, part, crc))
                start += part
    loose.sort(key=lambda p: -p[2])
    for one in pack([p[2] for p in loose], length):
        pieces = [loose[i] for i in one]
        at = 0
        for part in powers(sum(p[2] for p in pieces)):
            sequence = []
            while part:
                sequence.append(pieces[at])
                part -= pieces[at][2]
                at += 1
            sequences.append(sequence)
    return sequences


def encoded(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """ROW, ``doc_id, doc_tokens`` and the checksums of each document's pieces; ids are those of the public vocabulary, then 0."""

    def encode(batches):
        encoder, schema = byte_encoder(path or vocabulary(VOCABULARY)), None
        for batch, texts in by_bytes(batches):
            schema = schema or pa.schema([*[batch.schema.field(c) for c in ROW], batch.schema.field("doc_id"), ("doc_tokens", pa.int64()), ("full_crcs", pa.list_(pa.int64())), ("tail_crc", pa.int64()), ("part_crcs", pa.list_(pa.int64()))])
            tokens, full, tail, part = [], [], [], []
            for text in texts:
                ids = encoder.ids(text) + END
                n, view = len(ids) // 4, memoryview(ids)
                tokens.append(n)
                full.append([zlib.crc32(view[4 * a : 4 * (a + length)]) for a in range(0, n - length + 1, length)])
                at, crcs = n - n % length, []
                tail.append(zlib.crc32(view[4 * at :]))
                for size in powers(n % length):
                    crcs.append(zlib.crc32(view[4 * at : 4 * (at + size)]))
                    at += size
                part.append(crcs)
            yield table(schema, **{c: batch.column(c) for c in ROW}, doc_id=batch.column("doc_id"), doc_tokens=tokens, full_crcs=full, tail_crc=tail, part_crcs=part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = numbered_rows(docs).select(*ROW, "doc_id", F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(encode, f"{ROW[0]} bigint, {ROW[1]} bigint, doc_id {kind}, doc_tokens bigint, full_crcs array<bigint>, tail_crc bigint, part_crcs array<bigint>")


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, slack: int = SLACK, group: int = GROUP, seed: int = 7) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    groups = max(1, -(-docs.count() // group))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("tail_crc", "ascending")])
        sequences = pack_group({c: rows.column(c).to_pylist() for c in ("doc_tokens", "full_crcs", "tail_crc", "part_crcs")}, length, slack)
        out = [(row, start, size, crc, n, at) for n, s in enumerate(sequences) for (row, start, size, crc), at in zip(s, np.cumsum([0, *(p[2] for p in s)]).tolist())]
        row, start, size, crc, n, at = (pa.array(x, pa.int64()) for x in zip(*out))
        number = pa.array([(key[0].as_py() << 32) + x for x in n.to_pylist()], pa.int64())
        return pa.table({"doc_id": rows.column("doc_id").take(row), "start": start, "length": size, "ids_crc32": crc, "doc_tokens": rows.column("doc_tokens").take(row), "sequence_id": number, "offset": at})

    # Groups are dealt by a row's place in the input, so equal rows, repeated and null doc_ids spread like any other.
    dealt = encoded(docs, path, length).withColumn("_group", F.pmod(F.xxhash64(*ROW, F.lit(seed)), F.lit(groups))).drop(*ROW)
    return dealt.groupBy("_group").applyInArrow(packed, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
