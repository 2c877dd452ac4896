"""Joins and packings that must not meet all pairs, or not go row by row, against plain versions."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from massweave.operators import allpairs, asof, matching, sequential
from pyspark.sql import functions as F


def spectra(seed, n, bins, most, common=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        for b in rng.sample(range(1, bins), rng.randint(1, most)):
            rows.append((i, b + 0.5, float(rng.randint(1, 20))))
        if common is not None:
            rows.append((i, 0.5, float(rng.choice(common))))
    return rows


def cosines_of(rows):
    each = defaultdict(dict)
    for i, mz, x in rows:
        each[i][int(mz)] = each[i].get(int(mz), 0) + x
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in each.items()}
    out = {}
    for a, b in itertools.combinations(sorted(each), 2):
        shared = each[a].keys() & each[b].keys()
        if shared:
            out[a, b] = sum(each[a][k] * each[b][k] for k in shared) / norm[a] / norm[b]
    return out


@pytest.mark.parametrize("common", [None, [1, 2, 200]])
def test_cosine_above_and_topk(spark, common):
    rows = spectra(3, 120, 40, 6, common)
    df, want = spark.createDataFrame(rows, "spec_id bigint, mz double, ints double").repartition(3), cosines_of(rows)
    for t in (0.3, 0.8):
        got = {(r["a"], r["b"]): r["cos"] for r in allpairs.cosine_above(df, t, 1.0).collect()}
        assert got.keys() == {k for k, c in want.items() if round(c, 6) >= t} and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    best = defaultdict(list)
    for (a, b), c in want.items():
        best[a].append((-round(c, 6), b))
    got = {(r["a"], r["b"]) for r in allpairs.cosine_topk(df, 4, 1.0).collect()}
    assert got == {(a, b) for a, v in best.items() for _, b in sorted(v)[:4]}
    with pytest.raises(ValueError):
        allpairs.cosine_above(df, 0.0)


@pytest.mark.parametrize("common", [None, [1, 2, 200]])
def test_cosine_search(spark, common):
    rows = spectra(5, 200, 30, 9, common)
    rows += [(a + 1000 * i, m, x) for a, m, x in rows if a < 20 for i in range(1, 9)]
    df, want = spark.createDataFrame(rows, "spec_id bigint, mz double, ints double").repartition(3), cosines_of(rows)
    best = defaultdict(list)
    for (a, b), c in want.items():
        best[a].append((-round(c, 6), b))
        best[b].append((-round(c, 6), a))
    asked = {a for a in best if a % 5 == 0}
    for k in (5, 300):
        got = {(r["a"], r["b"]): r["cos"] for r in allpairs.cosine_search(df, df.where("spec_id % 5 = 0"), k, 1.0).collect()}
        assert got.keys() == {(a, b) for a in asked for _, b in sorted(best[a])[:k]}


def test_cosine_search_hands_on_few_pairs(spark):
    rows = [(i + 1000 * j, 1.0 * (i * 7 + n * n * 13) % 60, 1.0 + (i * 31 + n * 17) % 50) for i in range(300) for n in range(5) for j in range(30)]
    found = allpairs.vectors(spark.createDataFrame(rows, "spec_id bigint, mz double, ints double"), 1.0).cache()
    asked, few = found.where("spec_id % 100 = 0"), found.where("copy <= 6")
    made = allpairs.reachable(few, asked, allpairs.seeds(few, asked, 5))
    assert made.distinct().count() <= 12 * asked.count()


def test_a_bin_in_every_spectrum_hands_on_few_pairs(spark):
    n = 600
    rows = [(i, 0.5, 1.0) for i in range(n)] + [(i, 1.5 + (i * 7 + k) % 300, 30.0) for i in range(n) for k in range(2)]
    df = spark.createDataFrame(rows, "spec_id bigint, mz double, ints double")
    post = allpairs.postings(df, 1.0)
    asked = post.select(F.col("spec_id").alias("a")).distinct().withColumns({"least": F.lit(0.5), "last": F.lit(None).cast("bigint")})
    made = allpairs.candidates(post, asked)
    assert made.count() <= 0.05 * n * (n - 1) / 2
    best = allpairs.candidates(post, allpairs.lower_bounds(post, 3))
    assert best.count() <= 0.1 * n * (n - 1) / 2
    want = {k for k, c in cosines_of(rows).items() if c >= 0.5}
    assert {(r["a"], r["b"]) for r in made.distinct().collect()} >= want


def test_tanimoto_by_bit_counts(spark):
    rng = random.Random(8)
    prints = [(i, rng.randint(0, 1), sum(1 << b for b in rng.sample(range(32), rng.choice([1, 4, 16, 30]))), sum(1 << b for b in rng.sample(range(32), rng.choice([0, 5, 20])))) for i in range(150)] + [(150, 0, 0, 0), (151, 0, 0, 0)]
    df = spark.createDataFrame(prints, "id bigint, label int, w0 bigint, w1 bigint")

    def likeness(p, q):
        either = (p[2] | q[2]).bit_count() + (p[3] | q[3]).bit_count()
        return ((p[2] & q[2]).bit_count() + (p[3] & q[3]).bit_count()) / either if either else 0.0

    pairs = {(p[0], q[0]): likeness(p, q) for p in prints for q in prints if p[0] != q[0] and p[1] == q[1]}
    got = {(r["a"], r["b"]): r["tanimoto"] for r in allpairs.tanimoto_above(df, 0.4, "id", ["w0", "w1"], "label").collect()}
    assert got == {k: t for k, t in pairs.items() if t >= 0.4}
    best = defaultdict(list)
    for (a, b), t in pairs.items():
        best[a].append((-t, b))
    found = {(r["a"], r["b"]) for r in allpairs.tanimoto_topk(df, 3, "id", ["w0", "w1"], "label").collect()}
    assert found == {(a, b) for a, v in best.items() for _, b in sorted(v)[:3]}
    asked = df.select(F.col("id").alias("a")).withColumn("least", F.lit(0.7))
    assert allpairs.counted_pairs(df, asked, "id", ["w0", "w1"], "label").count() < 0.5 * len(pairs)


def test_matched_pairs_above(spark):
    rows = [(i, 100.0 + 0.0007 * ((i * k) % 7) + 40 * k, float(1 + (i + k) % 5)) for i in range(14) for k in range(4)]
    df = spark.createDataFrame(rows, "spec_id bigint, mz double, ints double").withColumn("peak_idx", F.monotonically_increasing_id())
    ids = spark.createDataFrame(list(itertools.combinations(range(14), 2)), "a bigint, b bigint")
    for score, least in (("cos", 0.6), ("jss", 0.5), ("ce", 7.0)):
        every = {(r["a"], r["b"]): r[f"{score}_hun"] for r in matching.pairwise_matched(df, ids, score=score).collect()}
        got = {(r["a"], r["b"]): r[f"{score}_hun"] for r in matching.pairwise_matched(df, ids, score=score, least=least).collect()}
        want = {k: v for k, v in every.items() if (round(v, 6) <= least if score == "ce" else round(v, 6) >= least)}
        assert 0 < len(want) < len(every) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_hopeful_drops_before_the_solver(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.6), (1, 1, 2, 0.5), (1, 2, 1, 0.4), (2, 1, 1, 0.6), (2, 2, 1, 0.6), (3, 1, 1, 0.3)], "spec_id int, t_idx int, p_idx int, gain double")
    kept = {r["spec_id"] for r in matching.hopeful(pairs, 0.8).collect()}
    assert kept == {1}  # 2: one predicted peak gains once; 3: too little


@pytest.mark.parametrize("parts", [1, 5])
def test_nearest_without_reach(spark, parts):
    rng = random.Random(parts)
    left = [(i, rng.choice("abcd"), round(rng.uniform(0, 100), 1)) for i in range(200)] + [(900, None, 3.0), (901, "a", None), (902, "z", 5.0)]
    right = [(rng.choice("abcd"), round(rng.uniform(0, 100) ** 1.0, 0), f"n{rng.randint(0, 9)}") for _ in range(40)] + [("e", 5.0, "x"), (None, 3.0, "y")] + [("d", 7.0, "n3")] * 3
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = asof.nearest_value(spark.createDataFrame(left, "i int, k string, x double"), spark.createDataFrame(right, "k string, y double, name string"), ["k"], "x", "y", "name").collect()
        none = asof.nearest_value(spark.createDataFrame([], "i int, k string, x double"), spark.createDataFrame(right, "k string, y double, name string"), ["k"], "x", "y", "name").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for i, k, x in left:
        near = [(abs(x - y), y, name) for kk, y, name in right if kk == k and k is not None and x is not None]
        if near:
            want[i] = min(near)[1:]
    assert {r["i"]: (r["y"], r["name"]) for r in got} == want and len(got) == len(want) and none == 0


def packed_plainly(rows, budgets, drop, flush):
    out, batch, used, count = {}, 0, [0] * len(budgets), 0
    for key, *sizes in rows:
        if drop and any(s > b for s, b in zip(sizes, budgets)):
            continue
        if count and (any(u + s > b for u, s, b in zip(used, sizes, budgets)) or (flush and count >= flush)):
            batch, used, count = batch + 1, [0] * len(budgets), 0
        out[key] = batch
        used, count = [u + s for u, s in zip(used, sizes)], count + 1
    return out


@pytest.mark.parametrize("drop,flush,part", [(True, None, 40), (False, None, 40), (False, 5, 7), (True, 3, 500), (False, None, 3)])
def test_sequential_pack(spark, drop, flush, part):
    rng = random.Random(part)
    rows = [(i, rng.choice([0, 1, 3, 9, 30]), rng.choice([0, 2, 5, 25])) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, n int, e int").repartition(4)
    got = {r["id"]: r["batch"] for r in sequential.sequential_pack(df, "id", ["id"], {"n": 20, "e": 22}, drop, flush, part).collect()}
    assert got == packed_plainly(rows, [20, 22], drop, flush)


def test_sequential_pack_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, n int")
    assert sequential.sequential_pack(df, "id", ["id"], {"n": 20}).count() == 0
    with pytest.raises(ValueError):
        sequential.sequential_pack(df, "id", ["id"], {"n": 0})


def test_independent_draws(spark):
    """Frequencies follow the weights, pairs of neighbours too; reruns and other partitions agree."""
    from massweave.operators import splits

    weights = [1.0, 3.0, 0.0, 6.0, 2.0]
    df = spark.createDataFrame(list(enumerate(weights)), "id bigint, w double")
    n = 6000
    got = {r["id"]: r["draws"] for r in splits.independent_draws(df, n, "w", "id").collect()}
    assert got == {r["id"]: r["draws"] for r in splits.independent_draws(df.repartition(4), n, "w", "id").collect()}
    assert 2 not in got and sum(got.values()) == n
    chi = sum((got[i] - n * w / 12) ** 2 / (n * w / 12) for i, w in enumerate(weights) if w)
    assert chi < 16.3  # the 0.1 % point of three degrees
    counts = [{r["id"]: r["draws"] for r in splits.independent_draws(df, 40, "w", "id", seed=s).collect()} for s in range(12)]
    spread = [c.get(3, 0) for c in counts]
    assert max(spread) - min(spread) >= 3  # systematic draws would differ by one at most
    assert splits.independent_draws(df.where("w = 0"), 5, "w", "id").count() == 0


def test_repeated_batch_is_written_once(spark, tmp_path):
    from massweave.streaming import jobs

    write = jobs.written_once(str(tmp_path / "out"))
    one, two = spark.range(5), spark.range(5, 8)
    for df, batch in ((one, 0), (two, 1), (two, 1), (one, 0)):
        write(df, batch)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["id"], r["batch_id"]) for r in back.collect()) == [(i, int(i > 4)) for i in range(8)]


def test_agreement_by_threshold(spark):
    from massweave.operators import annotations

    peaks = spark.createDataFrame([(1, 1, 100.0, 6.0), (1, 2, 200.0, 3.0), (1, 3, 300.0, 1.0), (2, 1, 50.0, 1.0)], "spec_id int, peak_idx bigint, mz double, ints double")
    ann = spark.createDataFrame([(1, "A", 100.0), (1, "B", 200.0), (2, "A", 50.0)], "spec_id int, formula string, mz double")
    pred = spark.createDataFrame([(1, "A", 100.0, 0.5), (1, "C", 200.0, 0.3), (1, "B", 200.0, 0.2), (1, "D", 900.0, 0.0)], "spec_id int, formula string, mz double, prob double")
    got = {(r["spec_id"], r["threshold"]): r for r in annotations.agreement_by_threshold(peaks, ann, pred, [0.0, 0.25, 0.6]).collect()}
    r = got[1, 0.0]
    assert (r["t_formula_cov"], r["t_peak_cov"], r["t_w_peak_cov"]) == (1.0, 1.0, 1.0) and abs(r["t_peak_cov_2"] - 2 / 3) < 1e-12 and abs(r["t_w_peak_cov_2"] - 0.9) < 1e-12
    assert (r["p_formula_cov"], r["p_peak_cov_2"]) == (0.5, 0.5) and abs(r["p_peak_cov"] - 2 / 3) < 1e-12 and abs(r["p_w_peak_cov"] - 0.7) < 1e-12
    assert r["mode_peak_cov"] == 0.5 and abs(r["mode_w_peak_cov"] - 6 / 9) < 1e-12
    r = got[1, 0.25]
    assert (r["t_formula_cov"], r["t_peak_cov"], r["p_formula_cov"], r["p_peak_cov"]) == (0.5, 0.5, 0.5, 0.5)
    r = got[1, 0.6]
    assert r["t_formula_cov"] == 0 and r["p_formula_cov"] is None and r["p_peak_cov"] is None
    assert got[2, 0.0]["t_peak_cov"] == 0 and got[2, 0.0]["jsd"] is None
