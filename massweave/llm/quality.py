"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded: counts of pairs of byte classes, hashed
byte triples and how concentrated those are go through a learned layer; gated attention, learned
from document labels only, weighs the passages; a logistic layer scores the weighted sum.

The model is fitted on a bounded sample (documented bounds: the fit costs the same at every size):
SAMPLE labelled doc_ids in the order of a hash, and of a longer document BAG passages spread evenly
over its whole text. Every passage of every document is scored: features are made for CHUNK bytes at
a time and the attention's sum is carried across, so a text of any length needs no more memory.

Defined results: a null or empty text is one passage of no bytes and gets a score like any other;
rows keep their ``doc_id``, repeated or null; a labelled doc_id that several rows carry is fitted once,
by the row whose features hash lowest; with no labelled rows every score is 0.5; an empty table gives
no rows; other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massweave.llm.arrow import by_bytes
from massweave.llm.common import shielded, small_batches

SAMPLE, BAG = 6000, 24
PASSAGE = 768
#: Bytes of text whose features are made at once.
CHUNK = 1 << 18
FOLDS, THRESHOLD = 5, 0.3
HIDDEN, GATES, EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 32, 16, 14, 700, 128, 4e-3, 1e-4, 11
BUCKETS = 256


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def byte_classes() -> np.ndarray:
    """Small letter, capital, digit, space, line end, stop, comma, other ASCII signs in four kinds, other bytes in two."""
    kind = np.full(256, 11, dtype=np.int64)
    kind[128:192] = 12
    kind[:32] = 10
    for signs, k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t", 3), (b"\n\r\x0b\x0c", 4), (b".", 5), (b",;:", 6), (b"!?", 7), (b"\"'()-", 8), (b"#$%&*@^~+=<>", 9), (b"|/\\_[]{}`", 10)):
        for b in signs:
            kind[b] = k
    return kind


KIND, KINDS = byte_classes().astype(np.int32), 13
WIDTH = KINDS * KINDS + BUCKETS + 3


def features(data: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row for each passage: ``data`` holds their bytes one after the other, ``sizes`` the bytes of the whole text of each."""
    n = len(lengths)
    out = np.zeros((n, WIDTH), dtype=np.float32)
    passage, kind = np.repeat(np.arange(n, dtype=np.int32), lengths), KIND[data]
    same = passage[1:] == passage[:-1]
    pair = passage[1:] * np.int32(KINDS * KINDS) + kind[:-1] * np.int32(KINDS) + kind[1:]
    pairs = np.bincount(pair[same], minlength=n * KINDS * KINDS).reshape(n, -1)
    low = data.astype(np.uint32)
    hashed = (low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(24)
    triple = passage[:-2] * np.int32(BUCKETS) + hashed.astype(np.int32)
    triples = np.bincount(triple[same[1:] & same[:-1]], minlength=n * BUCKETS).reshape(n, -1)
    held = np.maximum(lengths, 1).astype(np.float32)[:, None]
    out[:, : KINDS * KINDS] = np.sqrt(pairs / held)
    out[:, KINDS * KINDS : -3] = 2 * np.sqrt(triples / held)
    out[:, -3] = np.log1p((triples.astype(np.float32) ** 2).sum(axis=1) * BUCKETS / (held[:, 0] ** 2))
    out[:, -2] = np.log1p(lengths) / 8
    out[:, -1] = np.log1p(sizes) / 12
    return out


def passages(texts: list[str], bag: int | None = None, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of passages in order and the index of each one's text, at most about ``most`` bytes of text at a time.

    Passages of a text are equally long, but for one byte. Of a text of more than ``bag`` passages that many are taken, spread evenly.
    """
    held: list[tuple[bytes, int, int]] = []
    count, most = 0, most or CHUNK
    made = lambda: (features(np.frombuffer(b"".join(h[0] for h in held), np.uint8), np.array([len(h[0]) for h in held]), np.array([h[1] for h in held])), np.array([h[2] for h in held]))
    for i, text in enumerate(texts):
        raw = text.encode()
        size, many = len(raw), max(1, -(-len(raw) // PASSAGE))
        for k in range(many) if bag is None or many <= bag else (j * many // bag for j in range(bag)):
            part = raw[-(-k * size // many) : -(-(k + 1) * size // many)]
            held.append((part, size, i))
            count += len(part) + 64
            if count >= most:
                yield made()
                held, count = [], 0
    if held:
        yield made()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Attention:
    """Passage layer (w, b), gates (v, u, g) and document layer (c, d)."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = SEED) -> Attention:
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return cls({"w": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, GATES), "u": draw(HIDDEN, GATES), "g": draw(GATES, 1), "c": draw(HIDDEN, 1), "d": np.zeros(1, np.float32)})

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, doc = self.p, np.repeat(np.arange(len(first)), np.diff(first, append=len(x)))
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (t * s @ p["g"])[:, 0]
        e = np.exp(e - np.maximum.reduceat(e, first)[doc])
        a = e / np.add.reduceat(e, first)[doc]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"doc": doc, "h": h, "t": t, "s": s, "a": a, "z": z, "y": sigmoid((z @ p["c"] + p["d"])[:, 0])}

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of whole texts: the running maximum, sum of weights and weighted sum of each go on from chunk to chunk."""
        p, n = self.p, len(texts)
        top, weight, total = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
        for x, of in passages(texts):
            h = np.tanh(x @ p["w"] + p["b"])
            e = (np.tanh(h @ p["v"]) * sigmoid(h @ p["u"]) @ p["g"])[:, 0].astype(np.float64)
            first = np.flatnonzero(np.diff(of, prepend=-1))
            docs = of[first]
            best = np.maximum(top[docs], np.maximum.reduceat(e, first))
            kept, a = np.exp(top[docs] - best), np.exp(e - np.repeat(best, np.diff(first, append=len(of))))
            weight[docs] = weight[docs] * kept + np.add.reduceat(a, first)
            total[docs] = total[docs] * kept[:, None] + np.add.reduceat(a[:, None] * h, first, axis=0)
            top[docs] = best
        return sigmoid((total / weight[:, None] @ p["c"] + p["d"])[:, 0]) if n else np.zeros(0)

    def gradients(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first)
        dy = ((f["y"] - label) / len(label)).astype(np.float32)[:, None]
        dz = dy @ p["c"].T
        dzp = dz[f["doc"]]
        da = (dzp * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[f["doc"]])
        dg = de[:, None] @ p["g"].T
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dzp + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
        return {"w": x.T @ dh, "b": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "g": (f["t"] * f["s"]).T @ de[:, None], "c": f["z"].T @ dy, "d": dy.sum(axis=0)}

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, seed: int = SEED) -> Attention:
        """Adam over batches of documents in a seeded order."""
        rng, ends = np.random.Generator(np.random.PCG64(seed)), np.append(first[1:], len(x))
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, epochs = 0, max(EPOCHS, -(-STEPS * BATCH // len(first)))  # a small sample is gone over more often
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(len(first))
            for at in range(0, len(order), BATCH):
                docs = np.sort(order[at : at + BATCH])
                rows = np.concatenate([np.arange(first[i], ends[i]) for i in docs])
                sizes = (ends - first)[docs]
                step += 1
                for k, grad in self.gradients(x[rows], np.cumsum(sizes) - sizes, label[docs]).items():
                    mean[k] += 0.1 * (grad - mean[k])
                    square[k] += 0.001 * (grad * grad - square[k])
                    self.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8) + rate * DECAY * self.p[k]).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Attention | None:
    """The model, from at most ``sample`` labelled documents outside the held-out part."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")

    def bags(batches):
        for batch, texts in by_bytes(batches, most=CHUNK):
            out: list[list[bytes]] = [[] for _ in texts]
            for x, of in passages(texts, BAG):
                for i, row in zip(of.tolist(), x.astype(np.float16)):
                    out[i].append(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([b"".join(b) for b in out], pa.binary())], names=["doc_id", "label", "x"])

    made = small_batches(rows).mapInArrow(bags, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label double, x binary")
    found = made.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("x").alias("order"), "x", "label")).alias("bag")).select("bag.*").toArrow().sort_by("order")
    if not found.num_rows:
        return None
    each = [np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in found.column("x").to_pylist()]
    sizes = np.array([len(b) for b in each])
    x = np.concatenate(each).astype(np.float32)
    return Attention.new().fit(x, np.cumsum(sizes) - sizes, found.column("label").to_numpy())


def with_score(docs: DataFrame, model: Attention | None, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in one more column."""

    def score(batches):
        for batch, texts in by_bytes(batches):
            y = np.full(len(texts), 0.5) if model is None else model.scores(texts).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y, pa.float64())], names=[*batch.schema.names, name])

    return small_batches(docs).mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    scored = with_score(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@shielded
def quality_filter(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    return with_score(docs, fit(docs, labels, sample), "_mw_score").where(F.col("_mw_score") >= THRESHOLD).drop("_mw_score")
