"""Plans that must hold on tables far larger than their sources' bytes tell, on small ones."""

import datetime
from fractions import Fraction
from pathlib import Path

import duckdb
import pytest
from massweave.operators import aggregates, allpairs, joins, retrieval, splits
from massweave.plans import QUERIES, SQL
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def broadcast(df):
    """The parts of a plan that it broadcasts."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for more in lines[i + 1 :]:
                if depth(more) <= depth(line):
                    break
                below.append(more)
            out.append("\n".join(below))
    return out


def exploded(spark, name):
    return [b for b in broadcast(QUERIES[name](spark, SF)) if "Generate" in b]


def test_entity_counts_broadcast_no_nodes(spark):
    assert not exploded(spark, "entity_counts")


def test_fragment_boundary_broadcasts_no_edges(spark):
    assert not exploded(spark, "fragment_boundary")


def test_wl_hash_broadcasts_no_labels(spark):
    assert not exploded(spark, "wl_hash")


def test_theoretical_peaks_broadcast_no_formulas(spark):
    assert not exploded(spark, "theoretical_peaks")


def test_fragment_of_peak_broadcasts_no_fragments(spark):
    assert not exploded(spark, "fragment_of_peak")


def test_formula_coverage_broadcasts_no_formulas(spark):
    assert not exploded(spark, "formula_coverage") and not exploded(spark, "coverage_by_molecule")


def molecules(spark, n=300):
    import random

    rng = random.Random(3)
    rows = [(i, 100.0 + rng.randint(0, 12) * 0.02, rng.randint(1, 5), rng.randint(0, 1), f"K{rng.randint(0, 40)}") for i in range(n)]
    return spark.createDataFrame(rows, "mol_id long, exact_mw double, num_atoms int, charge int, inchikey_s string")


def alike(a, b):
    return F.least(a, b) / F.greatest(a, b)


def every_pair(m):
    rows = retrieval.mass_candidates(m, m, 500.0, {"num_atoms": "t_num_atoms", "charge": "t_charge"})
    return rows.withColumns({"similarity": alike(F.col("num_atoms"), F.col("t_num_atoms")), "score": alike(F.col("num_atoms"), F.col("t_num_atoms")) + (F.col("charge") == F.col("t_charge")).cast("int"), "is_target": F.col("mol_id") == F.col(retrieval.TARGET)})


def counted(m):
    rows = retrieval.class_candidates(m, 500.0, ["num_atoms", "charge"])
    return rows.withColumns({"similarity": alike(F.col("num_atoms"), F.col("t_num_atoms")), "score": alike(F.col("num_atoms"), F.col("t_num_atoms")) + (F.col("charge") == F.col("t_charge")).cast("int")})


CLASS = ["target_mw", "t_num_atoms", "t_charge"]


def table(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_best_in_windows_is_top_candidates(spark):
    m = molecules(spark)
    sound = m.where("charge = 0")
    plain = retrieval.top_candidates(every_pair(m).where("is_target or charge = 0"), "similarity", 4)
    got = retrieval.best_in_windows(m, sound, 500.0, 4, "num_atoms", alike)
    assert table(got, retrieval.TARGET, "mol_id", "score") == table(plain, retrieval.TARGET, "mol_id", "similarity")


def test_counted_ranks_are_those_of_every_pair(spark):
    m = molecules(spark)
    plain = retrieval.ranked(every_pair(m), "score").where("is_target or rank = 1")
    got = retrieval.of_targets(retrieval.ranked(counted(m), "score", CLASS, "n").where("is_target or rank = 1"), m, ["num_atoms", "charge"])
    assert table(got, retrieval.TARGET, "is_target", "rank", "similarity") == table(plain, retrieval.TARGET, "is_target", "rank", "similarity")


def test_counted_ndcg_is_that_of_every_pair(spark):
    m = molecules(spark)
    for exponential in (False, True):
        plain = retrieval.ranked_ndcg(every_pair(m), "score", "similarity", 7, exponential)
        got = retrieval.of_targets(retrieval.ranked_ndcg(counted(m), "score", "similarity", 7, exponential, CLASS, "n"), m, ["num_atoms", "charge"])
        assert table(got, retrieval.TARGET, "ndcg") == table(plain, retrieval.TARGET, "ndcg")


def test_classes_don_t_grow_with_their_members(spark):
    m = molecules(spark)
    more = m.unionByName(m.withColumn("mol_id", F.col("mol_id") + 1000)).unionByName(m.withColumn("mol_id", F.col("mol_id") + 2000))
    others = lambda df: counted(df).where("not is_target").groupBy(*CLASS, "num_atoms", "charge").count().count()
    assert counted(more).where("is_target").count() == counted(m).where("is_target").count() and others(more) <= 2 * others(m)
    assert counted(more).agg(F.sum("n")).first()[0] < every_pair(more).count()


def test_pair_counts_are_those_of_every_pair(spark):
    m = molecules(spark)
    pairs = every_pair(m).where(F.col(retrieval.TARGET) < F.col("mol_id"))
    plain = pairs.select(F.explode(F.array(retrieval.TARGET, "mol_id")).alias("mol_id")).groupBy("mol_id").agg(F.count("*").alias("pairs"))
    assert table(retrieval.pair_counts(m, 500.0), "mol_id", "pairs") == table(plain, "mol_id", "pairs")


def tables(spark, folder, orders, lines=()):
    """Small tables of orders (key, customer, price) and lines (order, number, price, quantity)."""
    made = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(k, c, "F", p, made, "1-URGENT") for k, c, p in orders], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    rows = [(k, 1, 1, n, q, p, 0.0, 0.0, "N", "O", made) for k, n, p, q in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def by_sql(folder, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con.execute(SQL[name]).fetchall()


def test_best_epoch_of_equal_means_is_the_first(spark, tmp_path):
    prices = [500.1, 0.05, 1000.3]
    orders = [(7 * i + 1, 1, p) for i, p in enumerate(prices)] + [(7 * i + 3, 1, p) for i, p in enumerate(reversed(prices))] + [(7 * i + 2, 1, p) for i, p in enumerate([prices[1], prices[0], prices[2]])]
    folder = tables(spark, tmp_path, orders)
    got = QUERIES["best_epoch"](spark, folder).select("dset", "best", "epoch").collect()
    assert [tuple(r) for r in got] == by_sql(folder, "best_epoch") and got[0]["epoch"] == 1
    means = aggregates.best(spark.createDataFrame([("d", 2, 0.1 + 0.2), ("d", 1, 0.3)], "dset string, epoch int, x double").withColumn("x", F.round("x", 6)), ["dset"], "epoch", "x", False)
    assert means.first()["epoch"] == 1 and "round(avg(prec_mz), 6)" in SQL["best_epoch"]


def test_fused_spectra_round_halves_to_even(spark, tmp_path):
    folder = tables(spark, tmp_path, [(1, 1, 400_000.0)], [(1, 1, 70 * 100.25, 5.0), (1, 2, 70 * 100.21, 4.0), (1, 3, 70 * 100.29, 3.0), (1, 4, 70 * 200.15, 2.0), (1, 5, 70 * 200.19, 1.0)])
    got = QUERIES["fused_spectra"](spark, folder).select("spec_id", "mz", "ints").collect()
    assert sorted(map(tuple, got)) == sorted(by_sql(folder, "fused_spectra"))
    assert [r["mz"] for r in sorted(got, key=lambda r: r["mz"])] == [100.21, 100.29, 200.15]


def test_weighted_draws_are_exact(spark):
    rows, n = [(i, 1.0 / (1 + i % 7)) for i in range(700)], 10**15 + 7
    got = {r["id"]: r["draws"] for r in splits.weighted_draws(spark.createDataFrame(rows, "id long, w double"), n, "w", "id").collect()}
    units = {i: int(w * splits.UNITS) for i, w in rows}
    total = sum(units.values())
    assert sum(got.values()) == n
    assert all(abs(got[i] - Fraction(units[i] * n, total)) < 1 for i in got)


def test_copies_are_one_class(spark, tmp_path):
    lines = [(i, n, 70 * (100.0 + 11 * n + i % 3 * (n == 1)), float(n)) for i in range(12) for n in range(1, 4)]
    folder = tables(spark, tmp_path, [(1, 1, 400.0)], lines)
    for name in ("pairwise_jss", "pairwise_cross_entropy", "pairwise_hungarian", "pairwise_matched_ce", "pairwise_matched_jss", "pairwise_cosine_above"):
        got = [tuple(r) for r in QUERIES[name](spark, folder).collect()]
        assert {(a, b) for a, b, x in got if x is None} == {(i % 3, i) for i in range(3, 12)}, name
        assert {v for a, b, x in got if x is not None for v in (a, b)} <= {0, 1, 2}, name
        near = lambda rows: sorted((a, b, -1 if x is None else round(x, 5)) for a, b, x in rows)
        assert near(got) == near(by_sql(folder, name)), name


def test_tanimoto_search_meets_the_queries_only(spark):
    rows = [(i, 0, (i * 2654435761) % (1 << 32), (i * 40503) % (1 << 32)) for i in range(300)]
    f = spark.createDataFrame(rows, "id long, label int, w0 long, w1 long")
    every = allpairs.tanimoto_topk(f, 3, "id", ["w0", "w1"], "label").where("a % 100 = 0")
    got = allpairs.tanimoto_topk(f, 3, "id", ["w0", "w1"], "label", f.where("id % 100 = 0"))
    assert table(got, "a", "b", "tanimoto") == table(every, "a", "b", "tanimoto") and got.count() == 9
    asked = allpairs.tanimoto_bounds(f, 3, "id", ["w0", "w1"], "label", f.where("id % 100 = 0"))
    assert asked.count() == 3 and allpairs.counted_pairs(f, asked, "id", ["w0", "w1"], "label").count() <= 3 * 299


def test_query_candidates_meet_molecules_of_the_queries_only(spark):
    got = QUERIES["query_candidates"](spark, SF)
    assert got.where("spec_id % 100 <> 0").isEmpty() and not got.isEmpty()


def test_window_join_by_key(spark):
    a = spark.createDataFrame([(i, i % 3, 100 + 0.3 * i) for i in range(30)], "a long, k int, x double")
    b = spark.createDataFrame([(i, i % 2, 100 + 0.2 * i) for i in range(50)], "b long, k int, y double")
    got = joins.window_join(a, b, "x", "y", 5000.0, True, ["k"]).select("a", "b")
    want = {(i, j) for i in range(30) for j in range(50) if i % 3 == j % 2 and abs((100 + 0.2 * j) - (100 + 0.3 * i)) <= (100 + 0.3 * i) * 5e-3}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_mass_classes_are_every_pair_and_don_t_grow_with_their_members(spark):
    m = molecules(spark)
    plain = retrieval.mass_candidates(m, m, 500.0).groupBy("target_mw").agg(F.count("*").alias("pairs")).collect()
    sizes = {r["exact_mw"]: r["count"] for r in m.groupBy("exact_mw").count().collect()}
    rows = retrieval.mass_classes(m, 500.0)
    got = {r["target_mw"]: r["n"] for r in rows.groupBy("target_mw").agg(F.sum("n").alias("n")).collect()}
    assert {r["target_mw"]: r["pairs"] for r in plain} == {k: n * sizes[k] for k, n in got.items()}
    assert retrieval.mass_classes(m.unionByName(m.withColumn("mol_id", F.col("mol_id") + 1000)), 500.0).count() == rows.count()


def plain_batches(sizes, groups, budget, ks):
    free, queues, out, batch = dict.fromkeys(range(len(sizes))), [list(g) for g in groups], [], 0
    while free:
        room, taken = budget, 0
        for queue, k in zip(queues, ks):
            done = 0
            while queue and done < k:
                left, fits = [i for i in queue[0] if i in free], []
                for i in left:
                    if sizes[i] <= room or not taken and not fits:
                        fits.append(i)
                        room -= sizes[i]
                for i in fits:
                    free.pop(i)
                    out.append((i, batch))
                taken += len(fits)
                if len(fits) < len(left):
                    break
                queue.pop(0)
                done += bool(left)
        for i in list(free):
            if sizes[i] <= room or not taken:
                free.pop(i)
                out.append((i, batch))
                room -= sizes[i]
                taken += 1
            elif room <= 0:
                break
        batch += 1
    return out


def test_contrastive_batches_are_the_plain_ones():
    import random

    rng = random.Random(5)
    for least in (0, 1):
        for _ in range(300):
            n = rng.randint(1, 60)
            sizes = [rng.randint(least, 14) for _ in range(n)]
            groups = []
            for kinds in (rng.randint(1, 20), rng.randint(1, 4)):
                of = [rng.randrange(kinds) for _ in range(n)]
                groups.append([[i for i in range(n) if of[i] == k] for k in dict.fromkeys(of)])
            args = sizes, groups, rng.choice([5, 10, 30]), (rng.randint(1, 2), rng.randint(1, 2))
            assert splits.contrastive_batches(*args) == plain_batches(*args)


def test_contrastive_batches_of_one_large_group_take_no_square():
    import time

    n = 300_000
    began = time.process_time()
    out = splits.contrastive_batches([1 + i % 13 for i in range(n)], [[list(range(j, n, n // 10)) for j in range(n // 10)], [range(n)]], 64, (2, 2))
    assert sorted(i for i, _ in out) == list(range(n)) and time.process_time() - began < 30


def test_peaks_are_dealt_by_their_number(spark, monkeypatch):
    from massweave.plans import views

    monkeypatch.setattr(views, "PEAKS", 100)
    parts = -(-views.Views(spark, SF).table("lineitem").count() // 100)
    for name in ("conditional_entropy", "metric_grid", "bin_sum_max_lse", "ensemble_logmean", "ensemble_log_std", "f1_by_model", "peak_match_recall_precision", "peak_match_inst_tolerance", "weighted_cosine_by_instrument"):
        lines = [x for x in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x and ("spec_id" in x or "l_orderkey" in x)]
        assert lines and all(f", {parts})" in x for x in lines), (name, lines)


def test_nearby_agreement_is_that_of_all_matches(spark):
    import random

    from massweave.operators import similarity

    rng = random.Random(2)
    rows = [(i, n, 150 + 0.001 * rng.randint(0, 40), float(rng.randint(1, 9)), s) for i in range(60) for s in "tp" for n in range(rng.randint(0, 9))]
    df = spark.createDataFrame(rows, "spec_id long, peak_idx long, mz double, ints double, side string")
    t, p = (df.where(F.col("side") == s).drop("side") for s in "tp")
    plain = similarity.agreement(t, p, similarity.matches(t, p, 1e-5, 200.0))
    got = similarity.nearby_agreement(t, p, 1e-5, 200.0)
    assert table(got, *plain.columns) == table(plain, *plain.columns) and 0 < got.where("recall between 0.2 and 0.8").count()
