"""Hand-valued cases, invariants and brute force for the spectrum operators."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from massweave.functions import annotation, energy, formula, intensity, text
from massweave.operators import aggregates, annotations, filters, graphs, isotopes, joins, matching, peaks, retrieval, similarity, splits, standardize
from massweave.operators.ordering import numbered
from pyspark.sql import functions as F

PEAK = "spec_id bigint, peak_idx int, mz double, ints double"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def spectrum(spark, *peak_lists):
    return spark.createDataFrame([(s, i + 1, float(m), float(x)) for s, p in enumerate(peak_lists) for i, (m, x) in enumerate(p)], PEAK)


def values(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_energy_texts(spark):
    cases = {"35": (35.0, None), "35 eV": (35.0, None), "NCE=20% 15eV": (15.0, 20.0), "35HCD": (35.0, None), "CE 35": (35.0, None), "NCE=35%": (None, 35.0), "35% resonant relative/normalized": (None, 35.0), "35 (nominal)": (None, 35.0), "HCD 35%": (None, 35.0), "35 NCE": (None, 35.0), "35(NCE)": (None, 35.0), "35 %": (None, 35.0), "HCD (NCE 35%)": (None, 35.0), "high": (None, None)}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: (r["a"], r["n"]) for r in df.select("t", energy.absolute_energy(F.col("t")).alias("a"), energy.normalised_energy(F.col("t")).alias("n")).collect()}
    assert got == cases


def test_energy_conversion(spark):
    df = spark.createDataFrame([("[M+H]+", 1), ("[M+2H]2+", 2), ("[M-H]-", -1), ("[M+3H]3+", 3), ("EI", 1)], "p string, c int")
    assert all(r["x"] == r["c"] for r in df.select("c", energy.charge_of(F.col("p")).alias("x")).collect())
    ace = one(spark, energy.to_absolute(F.col("n"), F.col("c"), F.col("m")), n=30.0, c=2, m=500.0)
    assert math.isclose(ace, 27.0) and math.isclose(one(spark, energy.to_normalised(F.col("a"), F.col("c"), F.col("m")), a=ace, c=2, m=500.0), 30.0)
    assert one(spark, energy.energy_list(F.col("a"), F.col("b"), F.lit(None).cast("double")), a=10.0, b=12.0) == [10.0, 11.0, 12.0]
    assert one(spark, energy.energy_list(F.col("a"), F.col("b"), F.lit(None).cast("double")), a=10.0, b=12.5) == [10.0, 11.0, 12.0]


def test_formulas(spark):
    assert one(spark, formula.elements_of(F.col("f")), f="C6H12O6") == {"C": 6, "H": 12, "O": 6}
    assert one(spark, formula.elements_of(F.col("f")), f="CH3CH2OH") == {"C": 2, "H": 6, "O": 1}
    assert one(spark, formula.elements_of(F.col("f")), f="H-1") == {"H": 1} and one(spark, formula.elements_of(F.col("f")), f="c6") is None
    assert math.isclose(one(spark, formula.mass_of(formula.elements_of(F.col("f"))), f="H2O"), 18.010564684, abs_tol=1e-6)
    assert one(spark, formula.hill(formula.elements_of(F.col("f"))), f="OH2C") == "CH2O" and one(spark, formula.alphabetic(formula.elements_of(F.col("f"))), f="OH2") == "H2O1"
    assert one(spark, formula.combined(formula.elements_of(F.col("a")), formula.elements_of(F.col("b")), -1), a="C2H6O", b="H2O") == {"C": 2, "H": 4}
    assert one(spark, formula.unsaturation(formula.elements_of(F.col("f"))), f="C6H6") == 4
    assert one(spark, formula.only_elements(F.col("f"), ["C", "H"]), f="C2H6") and not one(spark, formula.only_elements(F.col("f"), ["C", "H"]), f="C2H6O")


def test_annotations(spark):
    rows = [(1, "lib", "", "[M+H]+", "C2H6O", '47.0491 10 "p/1.0ppm;?"\n29.0386 5 "p-H2O=x/2.0ppm 1/2"\n30.0 1 "p-H2O+i"'), (2, "other", "", "[M+H]+", "C2H6O", "1 1 p"), (3, "lib", "a peptide", "[M+H]+", "C2H6O", "1 1 p"), (4, "lib", "", "[M+H]+", "C2H6O", '1 1 "C2Hx"'), (5, "lib", "", "[M+H]+", "C2H6O", '1 1 "y3"')]
    good, bad = annotation.annotations(spark.createDataFrame(rows, "spec_id int, dset string, notes string, prec_type string, formula string, peaks string"), ["lib"])
    assert sorted((r["peak_mz"], r["product"], r["loss"], r["isotope"]) for r in good.collect()) == [("29.0386", "C2H5", "H2O1", 0), ("30.0", "C2H5", "H2O1", 1), ("47.0491", "C2H7O1", "", 0)]
    assert {r["spec_id"] for r in bad.collect()} == {2, 3, 4, 5}


def test_text(spark):
    assert [tuple(p) for p in one(spark, text.peaks_of(F.col("t")), t="100.5 1\n\n200 2.5 x\n")] == [(100.5, 1.0), (200.0, 2.5)]
    assert one(spark, text.resolution(F.col("t")), t="100.51 1\n200 2") == 2
    assert one(spark, text.listed(F.col("t")), t=" a; b ;;c0") == ["a", "b", "c0"] and one(spark, text.listed(F.lit(None).cast("string"))) == []
    assert one(spark, text.smiles_tokens(F.col("t")), t="C[C@H](Cl)Br") == ["C", "[C@H]", "(", "Cl", ")", "Br"]


def test_merge(spark):
    p = spectrum(spark, [(10, 1), (20, 2)], [(10, 1), (30, 1)]).withColumn("group_id", F.lit(0))
    (row,) = peaks.merged(p, "group_id", renormalize=True).collect()
    assert [(x["mz"], round(x["ints"], 6)) for x in row["peaks"]] == [(10.0, 0.4), (20.0, 0.4), (30.0, 0.2)]


def test_top_and_bins(spark):
    p = spectrum(spark, [(1, 5), (2, 1), (3, 4)], [(7, 2)])
    assert sorted((r["spec_id"], r["mz"]) for r in peaks.top(p, 5, drop_least=True).collect()) == [(0, 1.0), (0, 3.0), (1, 7.0)]
    with pytest.raises(ValueError):
        peaks.top(p, 0)
    with pytest.raises(ValueError):
        peaks.check_bins(10.0, 3.0)
    assert peaks.check_bins(1500.0, 0.01) == 150_000
    assert sorted((r["spec_id"], r["bin"], r["ints"]) for r in peaks.binned(p, 2.0).collect()) == [(0, 0, 5.0), (0, 1, 5.0), (1, 3, 2.0)]


def test_transforms_invert(spark):
    for name in intensity.TRANSFORMS:
        got = one(spark, intensity.untransform(name, intensity.transform(name, F.col("x")), intensity.transform(name, F.col("m"))), x=250.0, m=1000.0)
        assert math.isclose(got, 250.0, rel_tol=1e-3)


def test_cosine_and_jss(spark):
    a = spectrum(spark, [(100, 1), (200, 2)], [(100, 3)], [(50, 1)])
    b = spectrum(spark, [(100, 2), (200, 4)], [(300, 3)])
    assert values(similarity.binned_cosine(a, b), "spec_id", "cos") == pytest.approx({0: 1.0, 1: 0.0, 2: 0.0})
    assert values(similarity.binned_jss(a, b), "spec_id", "jss") == pytest.approx({0: 1.0, 1: 0.0, 2: 0.0})
    assert values(similarity.binned_cosine(a, a.withColumn("ints", F.col("ints") * 7)), "spec_id", "cos") == pytest.approx({0: 1, 1: 1, 2: 1})


def test_match_is_strict_and_floored(spark):
    t, p = spectrum(spark, [(100.0, 1)]), spectrum(spark, [(100.0019, 1), (100.0021, 1)])
    assert [r["p_idx"] for r in similarity.matches(t, p).collect()] == [1]


def test_band_join_is_the_plain_join(spark):
    rng = random.Random(1)
    t = spectrum(spark, *[[(rng.uniform(50, 60), 1) for _ in range(30)] for _ in range(4)])
    p = spectrum(spark, *[[(rng.uniform(50, 60), 1) for _ in range(30)] for _ in range(4)])
    got = {(r["spec_id"], r["t_idx"], r["p_idx"]) for r in similarity.matches(t, p, 0.04, relative=False, width=0.05).collect()}
    a, b = t.collect(), p.collect()
    assert got == {(x["spec_id"], x["peak_idx"], y["peak_idx"]) for x in a for y in b if x["spec_id"] == y["spec_id"] and abs(x["mz"] - y["mz"]) < 0.04} and got


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, m = map(int, rng.integers(1, 6, 2))
        s = rng.random((n, m)) * (rng.random((n, m)) > 0.4)
        got = matching.assign(s)
        best = max(sum(s[i, j] for i, j in zip(range(n), p)) for p in itertools.permutations(range(m), n)) if n <= m else max(sum(s[i, j] for i, j in zip(p, range(m))) for p in itertools.permutations(range(n), m))
        assert math.isclose(sum(s[i, j] for i, j in got), best, abs_tol=1e-9) and len({i for i, _ in got}) == len({j for _, j in got}) == min(n, m)


def test_matched_scores(spark):
    t = spectrum(spark, [(500.0, 3), (500.004, 4), (700, 1)], [(100, 1)])
    p = spectrum(spark, [(500.002, 5), (500.006, 1)], [(300, 1)])
    cos = values(matching.matched_cosine(t, p), "spec_id", "cos_hun")
    nt, np_ = math.sqrt(9 + 16 + 1), math.sqrt(26)
    assert cos == pytest.approx({0: max(3 * 5 + 4 * 1, 4 * 5) / nt / np_, 1: 0.0})
    t = spectrum(spark, [(500.0, 3), (510.0, 4), (700, 1)], [(100, 1)])
    assert values(matching.matched_jss(t, t), "spec_id", "jss_hun") == pytest.approx({0: 1.0, 1: 1.0})
    assert values(matching.matched_ndcg(t, t), "spec_id", "ndcg") == pytest.approx({0: 1.0, 1: 1.0})


def test_isotopes(spark):
    p = spectrum(spark, [(100.0, 1000), (101.008, 100), (200.0, 500), (201.012, 50)])
    assert [r["isotope"] for r in isotopes.by_spacing(p).orderBy("peak_idx").collect()] == [False, True, False, True]
    kept = isotopes.cleaned(p, [isotopes.by_spacing(p)])
    assert [r["mz"] for r in kept.orderBy("mz").collect()] == [100.0, 200.0]


def test_orphans(spark):
    p = spectrum(spark, [(100, 1000), (150, 500), (200, 200)], [(100, 900), (150, 450), (999, 10)], [(100, 800), (150, 300), (200, 150)])
    s = spark.createDataFrame([(i, 0, "FT") for i in range(3)] + [(3, 1, "FT")], "spec_id bigint, group_id int, inst_type string")
    alone = spark.createDataFrame([(3, 1, 50.0, 1.0)], PEAK)
    assert [(r["spec_id"], r["mz"]) for r in isotopes.orphans(s, p.unionByName(alone)).where("orphan").collect()] == [(1, 999.0)]


def test_average_rank_and_ndcg(spark):
    df = spark.createDataFrame([(0, i, s, t) for i, (s, t) in enumerate([(3.0, 1.0), (2.0, 0.5), (2.0, 0.2), (1.0, 0.0)])], "target_mol_id int, mol_id int, score double, sim double")
    assert [r["rank"] for r in retrieval.ranked(df, "score").orderBy("mol_id").collect()] == [1.0, 2.5, 2.5, 4.0]
    d = [1 / math.log2(k + 2) for k in range(4)]
    want = (1.0 * d[0] + 0.35 * (d[1] + d[2])) / (1.0 * d[0] + 0.5 * d[1] + 0.2 * d[2])
    assert retrieval.ranked_ndcg(df, "score", "sim").first()["ndcg"] == pytest.approx(want)


def test_splits(spark):
    df = spark.range(1000).select(F.col("id").alias("spec_id"), (F.col("id") % 100).alias("key"))
    s = splits.keyed_split(df, "key", 0.1, 0.2)
    assert values(s.groupBy("split").agg(F.countDistinct("key").alias("n")), "split", "n") == {"test": 10, "val": 20, "train": 70}
    assert s.groupBy("key").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    f = splits.folds(df, "key", 0.3)
    assert sorted(values(f.groupBy("fold").agg(F.countDistinct("key").alias("n")), "fold", "n").items()) == [(0, 34), (1, 33), (2, 33)]
    draws = splits.weighted_draws(df.withColumn("w", F.when(F.col("spec_id") < 500, 3.0).otherwise(1.0)), 400, "w", "spec_id")
    assert draws.agg(F.sum("draws")).first()[0] == 400 and draws.where("spec_id < 500").agg(F.sum("draws")).first()[0] == pytest.approx(300, abs=15)


def test_numbered(spark):
    df = spark.range(130_000).select((F.col("id") * 7919 % 130_000).alias("k"))
    got = numbered(df, ["k"], "i")
    assert got.where("k <> i").count() == 0 and got.count() == 130_000


def test_packing(spark):
    df = spark.range(300).select(F.col("id").alias("spec_id"), (F.col("id") % 13 + 1).alias("nodes"), (F.col("id") % 5).alias("a"), (F.col("id") % 3).alias("b"))
    g = splits.greedy_pack(df, "spec_id", {"nodes": 20}, shards=4).join(df, "spec_id")
    assert g.count() == 300 and g.groupBy("shard", "batch").agg(F.sum("nodes").alias("n")).where("n > 20").count() == 0
    assert splits.greedy_pack(df, "spec_id", {"nodes": 10}, shards=4).count() == df.where("nodes <= 10").count()
    c = splits.contrastive_pack(df, "spec_id", ["a", "b"], ["b"], 30, "nodes", 2, 2, shards=2).join(df, "spec_id")
    assert c.count() == 300 and c.select("spec_id").distinct().count() == 300 and c.groupBy("shard", "batch").agg(F.sum("nodes").alias("n")).where("n > 30").count() == 0


def test_filters(spark):
    s = spark.createDataFrame([(i, i % 2, "FT", "HCD", "[M+H]+", 200.0 + i, 30.0, None) for i in range(6)], "spec_id bigint, mol_id bigint, inst_type string, frag_mode string, prec_type string, prec_mz double, nce double, ace double")
    m = spark.createDataFrame([(0, 0, True, "C2H6", 8, 7, 0), (1, 1, True, "C2H6", 8, 7, 0)], "mol_id bigint, charge int, single_mol boolean, formula string, num_atoms int, num_bonds int, num_radicals int")
    kept, mols = filters.filtered(s, m, filters.Criteria(prec_mz=(200.0, 204.0), energy="nce"))
    assert sorted(r["spec_id"] for r in kept.collect()) == [0, 2, 4] and [r["mol_id"] for r in mols.collect()] == [0]
    with pytest.raises(ValueError):
        filters.checked(kept.where("spec_id < 0"))
    with pytest.raises(ValueError):
        filters.spectrum_masks(filters.Criteria(energy_kinds=["odd"]))


def test_groups(spark):
    df = spark.createDataFrame([(0, 0.0), (0, math.log(3.0)), (1, 5.0)], "g int, x double")
    assert values(aggregates.lse(df, ["g"], "x"), "g", "lse") == pytest.approx({0: math.log(4), 1: 5.0})
    assert values(aggregates.log_mean_exp(df, ["g"], "x"), "g", "lme") == pytest.approx({0: math.log(2), 1: 5.0})
    assert values(aggregates.reduced(df, spark.range(3).select(F.col("id").cast("int").alias("g")), "g", "x", "sum"), "g", "x") == pytest.approx({0: math.log(3), 1: 5.0, 2: 0.0})
    assert aggregates.merged_by(df, ["g"], {"x": "lse"}).count() == 2
    m = joins.mismatches(df, df.withColumn("x", F.col("x") + 1), "g", {"x": 10.0})
    assert m.count() == 0


def test_graphs(spark):
    n = spark.createDataFrame([(0, 1, "C"), (0, 2, "O"), (1, 1, "O"), (1, 2, "C"), (2, 1, "C"), (2, 2, "C")], "mol_id int, node int, label string")
    e = spark.createDataFrame([(0, 1, 2), (1, 1, 2), (2, 1, 2)], "mol_id int, src int, dst int")
    h = values(graphs.wl_hash(n, e), "mol_id", "graph_hash")
    assert h[0] == h[1] != h[2]
    bits = spark.createDataFrame([(5, -(1 << 63))], "mask_low bigint, mask_high bigint").select(graphs.mask_atoms().alias("x")).first()["x"]
    assert bits == [0, 2, 127]


def test_standardized(spark):
    from massweave.schemas import RAW_COLUMNS

    base = dict.fromkeys(RAW_COLUMNS) | {"dset": "d", "spec_id": "1", "peaks": "100.5 1\n200.25 2", "prec_type": "[M+H]1+", "inst_type": "HCD", "col_energy": "NCE=20% 15eV", "spec_type": "MS2", "ion_mode": "POSITIVE", "smiles": "CCO", "formula": "C2H6O"}
    rows = [base, base, base | {"spec_id": "2", "formula": "C9H9"}, base | {"spec_id": "3", "smiles": "??"}]
    raw = spark.createDataFrame([tuple(r[c] for c in RAW_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in RAW_COLUMNS))
    out = standardize.standardized(raw, spark.createDataFrame([("CCO", "C2H6O", 46.041865)], "smiles string, formula string, exact_mw double"))
    (s,) = out["spectra"].collect()
    assert (s["prec_type"], s["inst_type"], s["frag_mode"], s["ion_mode"], s["ace"], s["nce"], s["res"], s["group_id"]) == ("[M+H]+", "FT", "HCD", "P", 15.0, 20.0, 2, 0) and s["prec_mz"] == pytest.approx(47.049141, abs=1e-5)
    assert out["formula_audit"].count() == 1 and out["unknown_molecules"].count() == 1


def test_taxonomy(spark):
    t = spark.createDataFrame([("b", "CCO", "K2", "x; y"), ("a", "CCO", "K1", "x"), ("c", "CC", "K3", None)], "sid string, smiles string, kingdom string, substituents string")
    m = spark.createDataFrame([(0, "CCO", "I"), (1, "N", "J")], "mol_id int, smiles string, inchikey_s string")
    (r,) = standardize.with_taxonomy(m, t).collect()
    assert (r["mol_id"], r["kingdom"], r["substituents"]) == (0, "K1", ["x"])


def test_annotation_agreement(spark):
    a = spark.createDataFrame([(0, "A", 0.6), (0, "B", 0.4)], "spec_id int, formula string, p double")
    b = spark.createDataFrame([(0, "A", 0.5), (0, "C", 0.5)], "spec_id int, formula string, p double")
    r = annotations.annotation_agreement(a, b).first()
    assert (r["recall"], r["wt_recall"], r["precision"], r["f1"]) == pytest.approx((0.5, 0.6, 0.5, 0.5))


class FewViews:
    """Seven molecules with spectra of all adducts."""

    def __init__(self, spark):
        self.spark = spark
        self.formulas = {0: "C2H6O2", 1: "C3H8Cl", 2: "C4H10NaS", 3: "C12H26O2", 4: "C9H20Cl", 5: "C10H22NaS", 6: "C2H6O2"}
        self.rows = [(12 * m + a, m, p) for m in self.formulas for a, p in enumerate(("[M+H]+", "[M-H]-", "[M+Na]+", "[M+H]+") * 3)]

    def molecules(self):
        return self.spark.createDataFrame(list(self.formulas.items()), "mol_id int, formula string")

    def spectra(self):
        return self.spark.createDataFrame([(*r, 100.5) for r in self.rows], "spec_id int, mol_id int, prec_type string, prec_mz double")


def counts(f):
    return {e: int(n or 1) for e, n in re.findall(r"([A-Z][a-z]?)(\d*)", f)}


def test_annotation_parse_all(spark):
    from massweave.plans import domain_queries

    v, want = FewViews(spark), {}
    for i, m, p in v.rows:
        if p == "[M+Na]+":
            want[i] = (None, None, None, "adduct not supported")
        elif i % 3 == 2:
            want[i] = (None, None, None, "annotation can't be read")
        else:
            own = Counter(counts(v.formulas[m]))
            own["H"] += 1 if p == "[M+H]+" else -1
            product = Counter({"C": 2, "H": 5}) if i % 3 == 1 else Counter(own)
            if i % 3 == 0:
                product.subtract({"H": 2, "O": 1})
            loss = Counter(own)
            loss.subtract(product)
            text = lambda c: "".join(f"{e}{n}" for e, n in sorted(c.items()) if n)
            want[i] = (text(product), text(loss), int(i % 3 == 1), None)
    got = domain_queries.annotation_parse_all(v).collect()
    assert len(got) == len(v.rows) and {r["spec_id"]: (r["product"], r["loss"], r["isotope"], r["reason"]) for r in got} == want


def test_formula_subsets_all(spark):
    from massweave.plans import table_queries

    v = FewViews(spark)
    got = {r["mol_id"]: (r["n"], round(r["heaviest"], 6)) for r in table_queries.formula_subsets_all(v).collect()}
    for m, f in v.formulas.items():
        own, masses = counts(f), []
        for n in itertools.product(*[range(k + 1) for k in own.values()]):
            sub = dict(zip(own, n))
            if 1 + 0.5 * (2 * sub["C"] - sub["H"] - sub.get("Cl", 0)) >= 0:
                masses.append(sum(formula.MASSES[e] * k for e, k in sub.items()))
        assert got[m] == (len(masses), round(max(masses), 6))
    assert len(got) == len(v.formulas)
