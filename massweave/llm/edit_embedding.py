"""Document fingerprints by a randomised edit embedding.

Shared random walks map edit distance to Hamming distance: a walk over a text repeats each
character until a shared random bit, drawn for the character's class and the step, lets it go on.
Texts that differ by few edits fall into step again, so they differ at few steps. A fingerprint
samples the walk at the multiples of a power of two; coarser samples are part of finer ones, so
fingerprints of texts of any length compare. All characters take part.

For the next document (descending ``doc_id``) rows are dealt and sorted by range once. A task knows
the next text of all its rows but the last; these last rows, one for each partition, meet the first
row of the next partition in a small join.

Fingerprints that share a band (a few samples at places drawn once) are verified by their Hamming
distance over all samples: those alike by SIMILAR or more link, and a row's ``class_id`` is the smallest
doc_id that its fingerprint reaches over links. Equal fingerprints are one before anything is compared;
all members of a band meet, a crowded band's in pairs of blocks, and hand on spanning stars only.

Defined results: a null text is empty; an empty text has the empty fingerprint, like another empty
one by 1 and any other by 0, so all empty texts are one class; rows of one ``doc_id`` follow each other
by a hash of their text, a null ``doc_id`` comes last (``class_id`` is null where a class has no other);
a table's only row is its own next document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.llm.arrow import by_bytes, table
from massweave.llm.common import discard, materialize, released, small_batches, text_of
from massweave.llm.components import components

CLASSES, PERIOD, SEED = 32, 1 << 16, 2017
#: A text of 2^k characters or more, k at least this, is sampled every 2^(k - this + 1) steps: 128 to 300 samples.
FINE = 7
#: Places of the matrix in which texts of similar length walk in step.
PLACES = 4_000_000


@lru_cache(maxsize=1)
def strides() -> np.ndarray:
    """For each class and step (modulo the period) the steps until the walk leaves the character."""
    bits = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, size=(CLASSES, PERIOD), dtype=np.uint8)
    bits[:, ::64] = 1  # a bound on every wait
    steps = np.empty((CLASSES, PERIOD), dtype=np.uint8)
    wait = np.zeros(CLASSES, dtype=np.uint8)
    for j in range(2 * PERIOD - 1, -1, -1):
        wait = np.where(bits[:, j % PERIOD] == 1, 1, wait + 1).astype(np.uint8)
        steps[:, j % PERIOD] = wait
    return steps.reshape(-1)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return ((points * np.uint32(2654435761)) >> np.uint32(27)).astype(np.uint8)


def walks(texts: list[np.ndarray], begin: list[int]) -> list[np.ndarray]:
    """For each text the step at which each character begins, and the step after the last."""
    out: list[np.ndarray] = [np.array([b], dtype=np.int32) for b in begin]
    order = sorted((i for i, t in enumerate(texts) if len(t)), key=lambda i: -len(texts[i]))
    table_, at = strides(), 0
    while at < len(order):
        longest = len(texts[order[at]])
        end = at + 1
        while end < len(order) and (end - at + 1) * longest <= PLACES and 2 * len(texts[order[end]]) >= longest:
            end += 1
        lanes = order[at:end]
        rows = np.zeros((len(lanes), longest), dtype=np.uint8)
        for k, i in enumerate(lanes):
            rows[k, : len(texts[i])] = texts[i]
        base = np.ascontiguousarray(rows.T).astype(np.int32) << 16
        step = np.array([begin[i] for i in lanes], dtype=np.int32)
        steps = np.empty((longest + 1, len(lanes)), dtype=np.int32)
        mask = np.int32(PERIOD - 1)
        for j in range(longest):
            steps[j] = step
            step = step + table_[base[j] | (step & mask)]
        steps[longest] = step
        across = np.ascontiguousarray(steps.T)
        for k, i in enumerate(lanes):
            out[i] = across[k, : len(texts[i]) + 1].copy()
        at = end
    return out


def sampled(text: np.ndarray, steps: np.ndarray) -> tuple[int, np.ndarray]:
    """The sampling exponent and the samples (four bits each)."""
    n = len(text)
    e = max(0, n.bit_length() - FINE)
    if not n:
        return 0, np.zeros(0, dtype=np.uint8)
    marks = np.arange(0, int(steps[-1]), 1 << e)
    return e, text[np.searchsorted(steps[:-1], marks, "right") - 1] & 15


def packed(e: int, samples: np.ndarray) -> bytes:
    """One byte of exponent, two of the number of samples, then the samples, two a byte."""
    even = np.concatenate([samples, np.zeros(len(samples) % 2, dtype=np.uint8)])
    return bytes([e]) + len(samples).to_bytes(2, "big") + (even[::2] << 4 | even[1::2]).tobytes()


def unpacked(fingerprint: bytes) -> tuple[int, np.ndarray]:
    both = np.frombuffer(fingerprint[3:], dtype=np.uint8)
    return fingerprint[0], np.column_stack([both >> 4, both & 15]).reshape(-1)[: int.from_bytes(fingerprint[1:3], "big")]


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """The part of samples, taken as coarse as the coarser of the two, that agree."""
    (i, x), (j, y) = a, b
    x, y = x[:: 1 << max(0, j - i)], y[:: 1 << max(0, i - j)]
    if not len(x) and not len(y):
        return 1.0
    n = min(len(x), len(y))
    return float((x[:n] == y[:n]).sum()) / max(len(x), len(y))


FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
FIELDS_SQL = "n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def described(texts: list[str], after: list[int]) -> dict[str, list]:
    """The columns of FIELDS for the first ``len(after)`` texts; ``after``: the index of the next text."""
    own = [classes(t) for t in texts]
    steps = walks(own, [0] * len(own))
    prints = [sampled(t, s) for t, s in zip(own, steps)]
    half = [len(own[i]) // 2 for i in range(len(after))]
    moved = [own[j][:k] for k, j in zip(half, after)]
    kept = [len(own[i]) - k for i, k in enumerate(half)]
    more = walks(moved, [int(steps[i][k]) for i, k in enumerate(kept)])
    edited = [sampled(np.concatenate([own[i][:k], moved[i]]), np.concatenate([steps[i][:k], more[i]])) for i, k in enumerate(kept)]
    return {
        "n_chars": [len(own[i]) for i in range(len(after))],
        "edited_sha256": [hashlib.sha256((texts[i][:k] + texts[j][:h]).encode()).digest() for i, (k, j, h) in enumerate(zip(kept, after, half))],
        "fingerprint": [packed(*prints[i]) for i in range(len(after))],
        "edited_fingerprint": [packed(*p) for p in edited],
        "near_edited": [likeness(prints[i], p) for i, p in enumerate(edited)],
        "near_next": [likeness(prints[i], prints[j]) for i, j in enumerate(after)],
    }


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` with its fingerprint and that of the text edited with the next document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def in_order(batches):
        """Rows in order; the first and the last of a partition come with their texts, the last without results."""
        part, schema, held, none, begun = TaskContext.get().partitionId(), None, None, [None], False
        for batch, texts in by_bytes(batches):
            schema = schema or pa.schema([batch.schema.field("doc_id"), *FIELDS, ("part", pa.int32()), ("head", pa.string()), ("tail", pa.string())])
            ids = batch.column("doc_id")
            if held:
                ids, texts = pa.concat_arrays([held[0], ids]), [held[1], *texts]
            n = len(texts) - 1
            if n:
                head = none * n if begun else [texts[0]] + none * (n - 1)
                begun = True
                yield table(schema, doc_id=ids.slice(0, n), part=[part] * n, head=head, tail=none * n, **described(texts, list(range(1, n + 1))))
            held = (ids.slice(n), texts[n])
        if held:
            yield table(schema, doc_id=held[0], part=[part], head=none if begun else [held[1]], tail=[held[1]], **{name: none for name, _ in FIELDS})

    def at_edges(batches):
        for batch, texts in by_bytes(batches, "tail"):
            schema = pa.schema([batch.schema.field("doc_id"), *FIELDS])
            for i, text in enumerate(texts):
                yield table(schema, doc_id=batch.column("doc_id").slice(i, 1), **described([text, batch.column("head")[i].as_py() or ""], [1]))

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(text_of()).alias("key"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("key")]
    ranged = small_batches(rows).repartitionByRange(*order).sortWithinPartitions(*order).drop("key")
    done = materialize(ranged.mapInArrow(in_order, f"doc_id {kind}, {FIELDS_SQL}, part int, head string, tail string"))
    heads = done.where("head is not null").select(F.col("part").alias("next_part"), "head")
    tails = done.where("tail is not null").select("doc_id", "tail", "part")
    parts = tails.select("part")  # one row for each partition that has rows
    following = parts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("next_part"))
    edges = tails.join(following, "part").join(heads, "next_part").select("doc_id", "tail", "head")
    last = edges.mapInArrow(at_edges, f"doc_id {kind}, {FIELDS_SQL}")
    digits = lambda c: F.lower(F.hex(c)).alias(c)
    every = materialize(done.where("tail is null").select("doc_id", *[n for n, _ in FIELDS]).unionByName(last))
    discard(done)
    del ranged, done, heads, tails, edges, last
    released(docs.sparkSession)
    named = every.join(fingerprint_classes(every), "fingerprint")
    return named.select("doc_id", "n_chars", digits("edited_sha256"), digits("fingerprint"), digits("edited_fingerprint"), "near_edited", "near_next", "class_id")


#: Bands of each reach that alike fingerprints must share one of, the samples each takes, from anywhere up to the reach, and the reaches.
BANDS, WIDTH = 12, 8
REACHES = (8, 12, 16, 24, 32, 48, 64, 96, 128, 192)
SIMILAR = 0.8
#: Fingerprints of a band that one task compares.
CELL = 4096


@lru_cache(maxsize=1)
def band_places() -> np.ndarray:
    """Places of the samples of each band: by reach, band and sample."""
    rng = np.random.Generator(np.random.PCG64(SEED + 1))
    return np.stack([rng.integers(0, r, size=(BANDS, WIDTH)) for r in REACHES])


def reaches(n: int) -> list[int]:
    """Which reaches a fingerprint of ``n`` samples uses: the greatest up to ``n``, and the one below if a fingerprint alike may be so much shorter."""
    own = max([k for k, r in enumerate(REACHES) if r <= n], default=0)
    return [own, own - 1] if own and SIMILAR * n < REACHES[own] else [own]


def band_keys(e: int, samples: np.ndarray) -> list[int]:
    """Keys of bit-sampled bands; where a text of one more bit of length may be alike, also at the next coarser sampling, which that one has."""
    out: list[int] = []
    for coarse, x in ((e, samples), (e + 1, samples[::2])):
        if len(x) and (coarse == e or len(x) >= SIMILAR * (1 << FINE)):
            for k in reaches(len(x)):
                each = x[band_places()[k] % len(x)].astype(np.int64)
                values = (each << (4 * np.arange(WIDTH))).sum(axis=1)
                out += (values | np.arange(BANDS) << 32 | k << 36 | coarse << 40).tolist()
    return out


def alike(band: int, prints: list[bytes], similar: float = SIMILAR) -> tuple[list[int], list[int]]:
    """Spanning stars (member, centre) of the links between fingerprints of one band; what a member has reached is not compared again."""
    coarse = band >> 40
    each = [x[:: 1 << max(0, coarse - e)] for e, x in map(unpacked, prints)]
    sizes = np.array([len(x) for x in each])
    rows = np.full((len(each), sizes.max()), 255, dtype=np.uint8)
    for i, x in enumerate(each):
        rows[i, : len(x)] = x
    free, members, centres = np.arange(len(each)), [], []
    while len(free) > 1:
        centre, free, todo = int(free[0]), free[1:], [int(free[0])]
        while todo and len(free):
            one = todo.pop()
            n = sizes[one]
            hit = (rows[free, :n] == rows[one, :n]).sum(axis=1) >= similar * np.maximum(sizes[free], n)
            new = free[hit].tolist()
            members += new
            centres += [centre] * len(new)
            todo += new
            free = free[~hit]
    return members, centres


def fingerprint_classes(rows: DataFrame, similar: float = SIMILAR, cell: int = CELL) -> DataFrame:
    """``fingerprint, class_id``: of each fingerprint in ``rows`` (``doc_id, fingerprint``) the smallest doc_id that it reaches over links."""

    def banded(batches):
        schema = pa.schema([("id", pa.int64()), ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            yield table(schema, id=batch.column("id"), bands=[band_keys(*unpacked(f)) for f in batch.column("fingerprint").to_pylist()])

    def linked(batches):
        """Rows come sorted by band and part; one of them may go on in the next batch."""
        held, name = [], None
        for batch in batches:
            for band, part, f in zip(*(batch.column(c).to_pylist() for c in ("band", "part", "fingerprint"))):
                if (band, part) != name:
                    yield from stars(name, held)
                    held, name = [], (band, part)
                held.append(f)
        yield from stars(name, held)

    def stars(name, held):
        if len(held) > 1:
            members, centres = alike(name[0], held, similar)
            if members:
                yield table(pa.schema([("a", pa.binary()), ("b", pa.binary())]), a=[held[i] for i in members], b=[held[i] for i in centres])

    prints = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).withColumn("id", F.xxhash64("fingerprint")))
    bands = materialize(prints.select("id", "fingerprint").mapInArrow(banded, "id bigint, bands array<bigint>").select("id", F.explode(F.array_distinct("bands")).alias("band")))
    shared = materialize(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    met = bands.join(shared, "band")
    blocks = F.ceil(F.col("n") / (cell / 2)).cast("int")
    own = F.pmod(F.col("id"), blocks).cast("int")
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("n") <= cell, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), blocks - 1))))
    part = F.when(F.col("other") < 0, F.lit("")).otherwise(F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")))
    cells = dealt.select("band", part.alias("part"), "id").join(prints.select("id", "fingerprint"), "id").drop("id")
    links = materialize(cells.repartition("band", "part").sortWithinPartitions("band", "part").mapInArrow(linked, "a binary, b binary"))
    discard(bands)
    roots = components(links)
    named = prints.join(roots, prints["fingerprint"] == roots["node"], "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "doc_id")
    least = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return materialize(named.select("fingerprint", "root").join(least, "root").select("fingerprint", "class_id"))
