"""Periodic runs, hard negatives and quality rules: odd rows, empty tables, brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from llm_data import TEXTS, documents_of, rows_of
from massweave.llm import hard_negatives, periodic_runs, quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# periodic runs


def brute_runs(words):
    out = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            b = i + q
            if b - a >= max(24, 3 * q) and not any(words[a : b - d] == words[a + d : b] for d in range(1, q)):
                out.append((a, b - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng):
    words, v = [], rng.choice([1, 2, 3, 5, 50])
    for _ in range(rng.randint(0, 5)):
        block = [rng.randrange(v) for _ in range(rng.choice([1, 2, 3, 7, 20, 33, 40, 64, 70, 130, 200]))]
        if rng.random() < 0.4:
            block = block + [9] + block + [rng.randrange(9)]
        words += block * rng.choice([1, 2, 3, 4, 7]) + block[: rng.randint(0, len(block))]
    return (words * 3 if rng.random() < 0.3 else words)[:2000]


def test_runs_by_brute_force():
    rng, many = random.Random(5), 0
    for _ in range(40):
        docs = [periodic(rng) for _ in range(rng.randint(1, 4))]
        for words, (n, runs) in zip(docs, periodic_runs.runs_of([b" ".join(b"w%d" % x for x in d) for d in docs])):
            want = brute_runs(words)
            assert n == len(words) and runs == want
            many += len(want)
    assert many > 100


def test_pairs_stay_few_in_simple_texts():
    """Texts of one word, of short periods inside long ones, and a Thue-Morse word."""
    morse = [bin(i).count("1") % 2 for i in range(20_000)]
    nested = ([1] * 300 + [2]) * 40
    for words in ([7] * 20_000, nested, morse, [1, 2] * 5000 + [3] + [1, 2] * 5000):
        (n, runs), = periodic_runs.runs_of([b" ".join(b"%d" % x for x in words)])
        assert n == len(words)
        if words is nested:
            assert (0, len(words), 301) in runs


def plain_digest(doc_id, text, plant):
    words = WORDS.findall(text or "")
    if plant and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_run_digest(spark, odd, none):
    docs = documents_of(spark).where("n_chars < 4000").orderBy("doc_id").limit(250)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = periodic_runs.run_digest(periodic_runs.with_planted_runs(docs)).collect()
    assert len(got) == len(texts) and sum(r["n_runs"] for r in got) > 10
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == plain_digest(r["doc_id"], texts[r["doc_id"]], True)
    rows = sorted((tuple(r[c] for c in COLUMNS) for r in periodic_runs.run_digest(periodic_runs.with_planted_runs(odd.where("doc_id is null or doc_id not in (8, 9)"))).collect()), key=str)
    assert rows == sorted((plain_digest(i, t, True) for i, t, _ in TEXTS if i not in (8, 9)), key=str)
    assert periodic_runs.run_digest(odd).count() == len(TEXTS) and periodic_runs.run_digest(periodic_runs.with_planted_runs(none)).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    from massweave.llm import words as w

    monkeypatch.setattr(w, "PIECE", 16)
    monkeypatch.setattr(periodic_runs, "TOGETHER", 10)
    text = (" ".join(f"w{i}" for i in range(60)) + "\n") * 4 + "end\t of it " + "x" * 50
    raw = text.encode()
    (n, runs), = periodic_runs.runs_of([raw])
    words = WORDS.findall(text)
    assert n == len(words) and runs == [(0, 240, 60)]
    assert periodic_runs.collapsed(raw, n, runs).decode().split() == words[:60] + words[240:]
    assert periodic_runs.collapsed(raw, n, []).decode() == " ".join(words)


# hard negatives


def brute_negatives(rows):
    kept = []
    for v, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if v is not None and v % 7 == 0:
            label = (label + 1) % 10
        kept.append((v, label, [math.floor(256 * c) for c in x]))
    last = lambda v: (v is None, v or 0)
    out = []
    for i, (a, label, q) in enumerate(kept):
        if a is None or a % 100:
            continue
        score = lambda p: sum(m * n for m, n in zip(q, p))
        others = [(-score(x), last(v), k == label, v) for j, (v, k, x) in enumerate(kept) if j != i]
        positives = sorted(o for o in others if o[2])[:5]
        for s, _, _, p in positives:
            near = sorted(o for o in others if not o[2] and 80 * -s <= 100 * -o[0] <= 100 * -s)[:5]
            out += [(a, p, r + 1, o[3], -s, -o[0]) for r, o in enumerate(near)]
    return out


def mined(spark, rows, **how):
    df = spark.createDataFrame([(v, x, k, 1.0, "t", 2) for v, x, k in rows], "vec_id bigint, embedding array<float>, label int, score double, tree string, copies int").repartition(3)
    return sorted((tuple(r) for r in hard_negatives.hard_negatives(df, **how).collect()), key=str)


@pytest.mark.parametrize("trees", [50, 5000])
def test_hard_negatives(spark, trees):
    rng = random.Random(trees)
    vector = lambda n=6: [float(np.float32(rng.choice([-0.5, 0.25, 0.125, 1.0, rng.uniform(-1, 1)]))) for _ in range(n)]
    rows = [(i * rng.choice([1, 10, 100]) % 900, vector(), rng.randrange(10) if i % 3 else 3) for i in range(260)]
    rows += [(100, [0.5] * 6, 3)] * 3 + [(7, [0.5] * 6, 3)] * 8 + [(200, None, 1), (300, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (300, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 1), (400, [float("inf")] * 6, 1), (400, vector(), None), (None, vector(), 2), (None, [0.9] * 6, 3), (500, [0.5, 0.5], 3), (600, [], 3)]
    assert mined(spark, rows, rows_of_tree=trees) == sorted(brute_negatives(rows), key=str)


def test_hard_negatives_of_large_numbers_and_of_none(spark):
    rng = random.Random(6)
    rows = [(i * 50, [float(np.float32(rng.uniform(-1, 1) * 10**rng.choice([0, 5, 7]))) for _ in range(4)], i % 3) for i in range(40)]
    assert mined(spark, rows) == sorted(brute_negatives(rows), key=str)
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0], 1)]) == []


def test_boxes_are_pruned():
    """Where vectors lie in clusters most leaves stay closed, and the best are the same."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 4
    q = np.floor(256 * (np.repeat(centres, 64, axis=0) + rng.normal(size=(2560, 16)) * 0.05)).astype(np.int64)
    table = pa.table({"vec_id": list(range(2560)), "label": [0] * 2560, "copies": [1] * 2560, "q": q.tolist()})
    tree = hard_negatives.Tree.of(table, leaf=64)
    sharp, anchors = tree.ready(q[::100])
    opened = 0
    for i, a in enumerate(anchors):
        w = hard_negatives.Window(True, 6)
        opened += hard_negatives.search(sharp, a, 0, [w])
        scores = q @ q[i * 100]
        want = sorted((-int(s), v) for v, s in enumerate(scores))[:6]
        assert [(s, v) for s, _, v, _, _ in w.best] == want
    assert opened <= 0.4 * len(anchors) * len(tree.begin)


# quality rules


def plain_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd, none):
    docs = documents_of(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = quality_rules.quality_rules(docs).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        want = plain_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality_rules.COUNTS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["kept"] and r["base_failed"])
    judged = [(labels[r["doc_id"]], r["kept"]) for r in got if r["doc_id"] in labels and not r["base_failed"]]
    good, bad = [k for q, k in judged if q == 1], [k for q, k in judged if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad) and bad
    few = quality_rules.quality_rules(odd).collect()
    assert sorted(tuple(r[c] for c in quality_rules.COUNTS) for r in few) == sorted(plain_counts(t) for _, t, _ in TEXTS)
    assert quality_rules.quality_rules(none).count() == 0


def test_divergence_of_one_batch_is_that_of_another(spark):
    docs = documents_of(spark).where("doc_id < 120")
    one, two = ({r["doc_id"]: tuple(r) for r in quality_rules.quality_rules(d).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == two


def test_distance_and_guards():
    p, q = np.array([[0.5, 0.5, 0.0], [0.2, 0.3, 0.5]]), np.array([0.2, 0.3, 0.5])
    d = quality_rules.distance(p, q)
    m = (p[0] + q) / 2
    want = math.sqrt((sum(a * math.log2(a / b) for a, b in zip(p[0], m) if a) + sum(a * math.log2(a / b) for a, b in zip(q, m))) / 2)
    assert abs(d[0] - want) < 1e-12 and d[1] == 0 and quality_rules.distance(np.array([[1.0, 0, 0]]), np.array([0, 0.5, 0.5]))[0] == 1
    words, chars = quality_rules.limits(np.array([50, 200, 5000]))
    assert (np.diff(words) < 0).all() and (np.diff(chars) < 0).all()


def test_languages_without_reference_are_not_compared(spark):
    from pyspark.sql import functions as F

    docs = documents_of(spark).withColumn("lang", F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("lang")))
    rare = rows_of(spark, [(10_000, "zzz qqq xxx " * 3 + " ".join(f"unique{i}" for i in range(60)), "s")]).select("doc_id", "text", F.lit("xx").alias("lang"))
    many = docs.select("doc_id", "text", "lang").withColumn("doc_id", F.explode(F.array("doc_id", F.col("doc_id") + 20_000))).unionByName(rare)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(many).where("doc_id in (10000, 0, 4, 20000)").collect()}
    assert got[10_000]["kept"] and got[10_000]["word_divergence"] is None
    assert got[0]["kept"] == got[20_000]["kept"] and got[0]["word_divergence"] is not None
