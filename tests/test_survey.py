"""Operators that no query reaches, errors, brute force for assignments and packing, files of other systems."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from massweave.functions import energy, formula, text
from massweave.operators import aggregates, annotations, filters, graphs, isotopes, joins, matching, peaks, retrieval, similarity, splits, standardize
from massweave.operators.ordering import numbered
from massweave.operators.shared import running
from massweave.schemas import RAW_COLUMNS, require
from massweave.sources import readers, sinks
from massweave.streaming import jobs
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

PEAK = "spec_id bigint, peak_idx int, mz double, ints double"


def spectrum(spark, *peak_lists):
    return spark.createDataFrame([(s, i + 1, float(m), float(x)) for s, p in enumerate(peak_lists) for i, (m, x) in enumerate(p)], PEAK)


def values(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# assignments, all permutations


def best_total(score):
    n, m = score.shape
    if n > m:
        return best_total(score.T)
    return max(sum(score[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))


def tangled(rng):
    at = 400 + rng.random() * 50
    return sorted(round(at + rng.random() * 0.02, 4) for _ in range(rng.randrange(1, 5))) + [round(600 + rng.random(), 4)]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(5)
    t = [[(m, rng.randrange(1, 9)) for m in tangled(rng)] for _ in range(40)]
    p = [[(round(m + rng.choice([0, 0.002, -0.003]), 4), rng.randrange(1, 9)) for m, _ in s] + [(900.0, 2)] for s in t]
    clean = lambda s: [(m, sum(x for y, x in s if y == m)) for m in sorted({m for m, _ in s})]
    return [clean(s) for s in t], [clean(s) for s in p]


def near(a, b, tol=1e-5):
    return abs(a - b) / max(a, 200) < tol


def normal(s, power):
    total = sum(x**power for _, x in s) ** (1 / power)
    return [(m, x / total) for m, x in s]


def matrix(t, p, score):
    """Scores of pairs within tolerance, 0 for others (all scores are above 0)."""
    return np.array([[score(x, y) if near(a, b) else 0.0 for b, y in p] for a, x in t])


def test_matched_cosine_by_permutations(spark, pairs):
    t, p = pairs
    got = values(matching.matched_cosine(spectrum(spark, *t), spectrum(spark, *p)), "spec_id", "cos_hun")
    for i, (a, b) in enumerate(zip(t, p)):
        assert got[i] == pytest.approx(best_total(matrix(normal(a, 2), normal(b, 2), lambda x, y: x * y)), abs=1e-9)


def jss(a, b, links):
    h = lambda x: x * math.log(x) if x > 0 else 0.0
    rows = [(a[i][1], b[j][1]) for i, j in links]
    rows += [(x, 0.0) for i, (_, x) in enumerate(a) if i not in {i for i, _ in links}] + [(0.0, y) for j, (_, y) in enumerate(b) if j not in {j for _, j in links}]
    return 1 - sum(0.5 * h(x) + 0.5 * h(y) - h((x + y) / 2) for x, y in rows) / math.log(2)


def test_matched_jss_by_permutations(spark, pairs):
    """The best assignment need not be unique; any of the best ones may be scored."""
    t, p = pairs
    got = values(matching.matched_jss(spectrum(spark, *t), spectrum(spark, *p)), "spec_id", "jss_hun")
    for i, (a, b) in enumerate(zip(t, p)):
        a, b = normal(a, 1), normal(b, 1)
        m = matrix(a, b, lambda x, y: x + y)
        best, found = best_total(m), set()
        for perm in itertools.permutations(range(m.shape[1]), m.shape[0]) if m.shape[0] <= m.shape[1] else []:
            if math.isclose(sum(m[k, j] for k, j in enumerate(perm)), best):
                found.add(round(jss(a, b, [(k, j) for k, j in enumerate(perm) if m[k, j] > 0]), 9))
        assert round(got[i], 9) in found, i


def test_pairwise_matched_scores(spark, pairs):
    t, _ = pairs
    few = t[:6] + [[(m + 0.001, x) for m, x in s] for s in t[:3]]
    peaks_, ids = spectrum(spark, *few), spark.createDataFrame([(i, j) for i in range(9) for j in range(9) if i != j], "a bigint, b bigint")
    cos = {(r["a"], r["b"]): r["cos_hun"] for r in matching.pairwise_matched(peaks_, ids).collect()}
    ce = {(r["a"], r["b"]): r["ce_hun"] for r in matching.pairwise_matched(peaks_, ids, score="ce").collect()}
    js = {(r["a"], r["b"]): r["jss_hun"] for r in matching.pairwise_matched(peaks_, ids, score="jss").collect()}
    for (i, j), x in cos.items():
        a, b = few[i], few[j]
        assert x == pytest.approx(best_total(matrix(normal(a, 2), normal(b, 2), lambda x, y: x * y)), abs=1e-9)
        gain = best_total(matrix(normal(a, 1), normal(b, 1), lambda x, y: x * (math.log(y + 1e-7) - math.log(1e-7))))
        assert ce[i, j] == pytest.approx(-math.log(1e-7) - gain, abs=1e-9) and 0 <= js[i, j] <= 1
    with pytest.raises(ValueError):
        matching.pairwise_matched(peaks_, ids, score="odd")


# packing


def test_packs_hold_their_budgets(spark):
    df = spark.range(500).select(F.col("id").alias("spec_id"), (F.col("id") % 17 + 1).alias("nodes"), (F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"))
    rows = splits.greedy_pack(df, "spec_id", {"nodes": 12}, shards=3, drop_oversize=False, flush_every=4).join(df, "spec_id").collect()
    batches = defaultdict(list)
    for r in rows:
        batches[(r["shard"], r["batch"])].append(r["nodes"])
    assert len(rows) == 500 == len({r["spec_id"] for r in rows})
    assert all(len(b) <= 4 and (sum(b) <= 12 or len(b) == 1) for b in batches.values())
    assert len({r["shard"] for r in splits.greedy_pack(df, "spec_id", {"nodes": 99}).collect()}) == 1 and splits.shards_for(df, None) == 1
    got = splits.contrastive_pack(df, "spec_id", ["a", "b"], ["b"], 40, "nodes", 1, 1, shards=2).join(df, "spec_id").collect()
    batches = defaultdict(list)
    for r in got:
        batches[(r["shard"], r["batch"])].append(r)
    assert len(got) == 500 == len({r["spec_id"] for r in got}) and all(sum(r["nodes"] for r in b) <= 40 for b in batches.values())


def test_stream_pack_keeps_every_row(spark, tmp_path):
    """Rows of a shard that come in several pieces, the flush among the first; then rows after it."""
    schema = "id bigint, size bigint, flush boolean, shard bigint"
    rows = [(-1, 0, True, 0)] + [(i, i % 5 + 1, False, 0) for i in range(25_000)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    packed = jobs.packed(stream, "id", "size", 12, 1)
    for k in range(2):
        jobs.to_files(packed, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        if not k:
            spark.createDataFrame([(25_000, 3, False, 0), (-1, 0, True, 0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    ids = [i for r in sorted(out, key=lambda r: r["batch"]) for i in r["ids"]]
    assert ids == list(range(25_001)) and all(r["total"] == sum(i % 5 + 1 if i < 25_000 else 3 for i in r["ids"]) <= 12 for r in out)


# files


def test_msp_of_another_system(spark, tmp_path):
    records = ["Name: X\nNum Peaks: 2\n50.1 10\n60.2 20", "Name: Y\nNum Peaks: 1\n1 2", "Name: Z\nNum Peaks: 1\n3 4"]
    for name, text_ in (("lf", "\n\n".join(records)), ("crlf", "\n\n".join(records).replace("\n", "\r\n")), ("blank", "\n \n\n".join(records) + "\n\n")):
        (tmp_path / f"{name}.msp").write_bytes(text_.encode())
        rows = {r["name"]: r["peaks"] for r in readers.msp(spark, str(tmp_path / f"{name}.msp")).collect()}
        assert rows == {"X": "50.1 10\n60.2 20", "Y": "1 2", "Z": "3 4"}, name
    assert readers.msp(spark, str(tmp_path / "*.msp")).count() == 9
    few = [{r["name"] for r in readers.msp(spark, str(tmp_path / "lf.msp"), first=2).collect()} for _ in range(2)]
    assert few[0] == few[1] and len(few[0]) == 2


def test_datasets_and_results(spark, tmp_path):
    for name, n in (("a", 5), ("b", 3)):
        rows = "".join(f'{i},"x\ny",{name}\n' for i in range(n))
        (tmp_path / f"{name}_df.csv").write_text("spec_id,notes,name\n" + rows)
    both = readers.datasets(spark, str(tmp_path), ["a", "b"], n=4)
    assert values(both.groupBy("dset").agg(F.count("*").alias("n")), "dset", "n") == {"a": 4, "b": 3}
    tidy = readers.unified(both)
    assert tidy.columns == list(RAW_COLUMNS) and tidy.where("prec_mz is null and notes = 'x\ny'").count() == 7
    for model in ("m", "n"):
        spark.range(2).write.parquet(f"{tmp_path}/runs/model={model}/split=test/seed=1")
    got = readers.results(spark, f"{tmp_path}/runs/*/*/*/*.parquet").select("model", "split", "seed").distinct().collect()
    assert sorted(map(tuple, got)) == [("m", "test", "1"), ("n", "test", "1")]
    with pytest.raises(ValueError):
        require(both, ["spec_id", "mass"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"\nc"), (2, None)], "id bigint, x string")
    for kind in ("csv", "json", "parquet"):
        sinks.table(df, str(tmp_path / kind), kind)
        back = spark.read.csv(str(tmp_path / kind), header=True, multiLine=True, escape='"') if kind == "csv" else getattr(spark.read, kind)(str(tmp_path / kind))
        assert sorted((int(r["id"]), r["x"]) for r in back.collect()) == [(1, "a,\"b\"\nc"), (2, None)]
    with pytest.raises(ValueError):
        sinks.table(df, str(tmp_path / "x"), "odd")
    sinks.tables({"one": df, "two": df.limit(1)}, str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts/two")).count() == 1
    sinks.by_group(df.withColumnRenamed("id", "target_mol_id"), str(tmp_path / "groups"))
    assert spark.read.parquet(str(tmp_path / "groups/target_mol_id=2")).count() == 1
    p = spark.createDataFrame([(1, 2, [1.0], [2.0], 0.5)], "spec_id bigint, mol_id bigint, pred_mzs array<double>, pred_ints array<double>, cos_0.01 double".replace("cos_0.01", "`cos_0.01`"))
    for _ in range(2):
        sinks.predictions(p, str(tmp_path / "pred"), chunk=3, columns=["spec_id", "pred_mzs"])
    assert spark.read.parquet(str(tmp_path / "pred")).count() == 1 and sinks.ranking_only(p).columns == ["spec_id", "mol_id", "cos_0.01"]
    scores = sinks.score_columns(["cos", "cos_hun"], [0.01, 0.1], bin_sqrt=True, matched_sqrt=True)
    assert scores == ["cos_0.01", "cos_sqrt_0.01", "cos_0.1", "cos_sqrt_0.1", "cos_hun", "cos_hun_sqrt"]
    plain = p.withColumnRenamed("cos_0.01", "cos")
    assert sinks.tabular(plain, ["cos"]).columns == ["spec_id", "mol_id", "pred_mzs", "pred_ints", "cos"] and sinks.tabular(plain, ["cos"], subset=["cos", "mol_id"]).columns == ["mol_id", "cos"]


# texts, formulas, filters


def test_errors(spark):
    assert tuple(one(spark, energy.argument_energy(F.lit("10.0eV")))) == (10.0, "ace") and one(spark, energy.argument_energy(F.lit("20%")))["unit"] == "nce"
    for bad in (energy.argument_energy(F.lit("10 volts")), formula.parsed_elements(F.lit("c6")), formula.inferred_precursor(F.lit(None).cast("double"), F.lit("MS2"), F.lit(10.0), F.lit("[M+H]+"), F.lit("nist20"))):
        with pytest.raises(PySparkException):
            one(spark, bad)
    assert one(spark, formula.parsed_elements(F.lit("C2H6"))) == {"C": 2, "H": 6} and one(spark, formula.parsed_elements(F.lit(None).cast("string"))) is None
    assert one(spark, formula.inferred_precursor(F.lit(None).cast("double"), F.lit("MS2"), F.lit(10.0), F.lit("[M+H]+"), F.lit("mona"))) == pytest.approx(11.00727646, abs=1e-6)
    p = spectrum(spark, [(9000, 1)])
    with pytest.raises(PySparkException):
        similarity.matches(p, p).collect()


def test_smiles_tokens(spark):
    for smiles in ("C[C@H](Cl)Br", "F/C=C\\F", "[Na+].[Cl-]", "c1ccc%12cc1", "CC>>C*", "N#N"):
        tokens = one(spark, text.smiles_tokens(F.lit(smiles)))
        assert "".join(tokens) == smiles and "\\" in tokens or "\\" not in smiles
    assert one(spark, text.smiles_tokens(F.lit("C[13CH2]%(123)/[se]"))) == ["C", "[13CH2]", "%(123)", "/", "[se]"]
    for wrong in ("C?", "C>C", "C@H", "C>>C>O", "[]", "C~C"):
        assert one(spark, text.smiles_tokens(F.lit(wrong))) is None
    assert one(spark, text.smiles_tokens(F.lit("C!"))) is None and one(spark, text.smiles_tokens(F.lit("BrB"))) == ["Br", "B"]


def test_dense_elements(spark):
    got = one(spark, formula.dense(formula.elements_of(F.lit("C2H6O")), ["C", "N", "O", "H"]))
    assert list(got) == [2, 0, 1, 6]


def test_criteria(spark):
    s = spark.createDataFrame([(i, 0, "FT", "HCD", "[M+H]+", 200.0, 30.0, None, "P" if i % 2 else "N", "MS2" if i < 4 else "MS1", 4 if i else 0) for i in range(6)], "spec_id bigint, mol_id bigint, inst_type string, frag_mode string, prec_type string, prec_mz double, nce double, ace double, ion_mode string, spec_type string, res int")
    m = spark.createDataFrame([(0, 0, True, "C2H6", 8, 7, 0)], "mol_id bigint, charge int, single_mol boolean, formula string, num_atoms int, num_bonds int, num_radicals int")
    fields = filters.Criteria.__dataclass_fields__
    for name, value, want in (("ion_modes", ["P"], {1, 3, 5}), ("ion_mode", "P", {1, 3, 5}), ("spec_types", ["MS2"], {0, 1, 2, 3}), ("spec_type", "MS2", {0, 1, 2, 3})):
        if name in fields:
            kept, _ = filters.filtered(s, m, filters.Criteria(**{name: value}))
            assert {r["spec_id"] for r in kept.collect()} == want, name
    stats = spark.createDataFrame([(1, 10, 20, 0.9), (2, 99, 20, 0.9), (3, 10, 20, 0.1)], "mol_id int, num_nodes int, num_edges int, wt_recall double")
    assert [r["mol_id"] for r in filters.small_graphs(stats, 50, 50, 0.5).collect()] == [1] and filters.small_graphs(stats).count() == 3
    empty = spark.createDataFrame([(1, None), (2, []), (3, [1])], "spec_id int, peaks array<int>")
    assert tuple(filters.peaks_missing(empty).first()) == (2, 3)


# peaks


def test_null_precursor_keeps_peaks(spark):
    p = spectrum(spark, [(100.001, 1), (200, 2)], [(100.001, 1)])
    s = spark.createDataFrame([(0, 100.004), (1, None)], "spec_id bigint, prec_mz double")
    assert sorted((r["spec_id"], r["mz"]) for r in peaks.without_precursor(p, s, 0.01).collect()) == [(0, 200.0), (1, 100.001)]


def test_arrays_and_back(spark):
    p = spectrum(spark, [(3, 1), (1, 2), (2, 5)], [(7, 7)])
    arrays = peaks.to_arrays(p)
    rows = peaks.to_rows(arrays).collect()
    assert sorted((r["spec_id"], r["peak_idx"], r["mz"], r["ints"]) for r in rows) == [(0, 1, 1.0, 2.0), (0, 2, 2.0, 5.0), (0, 3, 3.0, 1.0), (1, 1, 7.0, 7.0)]
    pad = {r["spec_id"]: r for r in peaks.padded(arrays, 2).collect()}
    assert [tuple(x) for x in pad[0]["peaks"]] == [(1.0, 2.0), (2.0, 5.0)] and pad[0]["n_peaks"] == 2
    assert [tuple(x) for x in pad[1]["peaks"]] == [(7.0, 7.0), (0.0, 0.0)] and pad[1]["n_peaks"] == 1
    far = peaks.as_vector(spectrum(spark, [(1, 1)], [(50, 1)]), 10.0, 5.0)
    assert values(far, "spec_id", "ints") == {0: [1.0, 0.0], 1: [0.0, 0.0]}


def test_merged_values(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0), (0, math.log(3.0), 5.0), (1, 5.0, 2.0)], "g int, x double, y double")
    got = {r["g"]: r for r in aggregates.merged_by(df, ["g"], {"x": "lse", "y": "amax"}).collect()}
    assert got[0]["x"] == pytest.approx(math.log(4)) and got[0]["y"] == 5.0 and got[1]["x"] == pytest.approx(5.0)


def test_quantiles(spark):
    rng = random.Random(3)
    rows = [(g, float(rng.randrange(9))) for g in range(3) for _ in range(rng.randrange(1, 30))] + [(0, None), (None, 4.0), (None, 6.0)]
    got = aggregates.quantiles(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", {"a": 0.25, "b": 0.5, "c": 1.0}).collect()
    for r in got:
        x = [v for g, v in rows if g == r["g"] and v is not None]
        assert (r["a"], r["b"], r["c"]) == pytest.approx(tuple(np.quantile(x, [0.25, 0.5, 1.0])))
    (all_,) = aggregates.quantiles(spark.createDataFrame(rows, "g int, x double"), [], "x", {"m": 0.5}).collect()
    assert all_["m"] == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_running_and_numbered(spark, monkeypatch):
    import massweave.operators.ordering as ordering

    df = spark.createDataFrame([(i % 2, i * 7 % 40) for i in range(40)], "hot int, k int")
    rows = running(df, ["hot", "k"], before=F.col("k")).collect()
    assert all(r["before"] == sum(k for h, k in [(i % 2, i * 7 % 40) for i in range(40)] if (h, k) < (r["hot"], r["k"])) for r in rows)
    monkeypatch.setattr(ordering, "ALONE", 5)
    order = sorted((i % 2, i * 7 % 40) for i in range(40))
    assert {(r["hot"], r["k"]): r["n"] for r in numbered(df, ["hot", "k"], "n", 1).collect()} == {x: n + 1 for n, x in enumerate(order)}


# molecules, fragments, ensembles


def test_library_peaks(spark):
    s = spark.createDataFrame([(0, 100.0), (1, 20.0)], "spec_id bigint, prec_mz double")
    lib = spark.createDataFrame([("A", "product", 50.0), ("B", "loss", 30.0)], "formula string, kind string, mz double")
    got = {(r["spec_id"], r["formula"], r["isotope"]): r["mz"] for r in annotations.library_peaks(s, lib).collect()}
    assert got == pytest.approx({(0, "A", 0): 50.0, (0, "A", 1): 51.008665, (0, "B", 0): 70.0, (0, "B", 1): 71.008665, (1, "A", 0): 50.0, (1, "A", 1): 51.008665})


def test_fragment_elements(spark):
    members = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (0, 2, 2)], "mol_id int, frag_id int, node int")
    atoms = spark.createDataFrame([(0, 1, "C"), (0, 2, "C")], "mol_id int, node int, element string")
    assert {(r["frag_id"], r["element"]): r["n"] for r in graphs.fragment_elements(members, atoms).collect()} == {(1, "C"): 2, (2, "C"): 1}


def test_coverage_tables(spark):
    c = spark.createDataFrame([(0, 1.0), (1, 0.5), (2, 0.0)], "spec_id bigint, recall double")
    m = spark.createDataFrame([(0, 0.75), (1, 0.0)], "group_id bigint, recall double")
    s = spark.createDataFrame([(0, 7, 0), (1, 7, 0), (2, 8, 1)], "spec_id bigint, mol_id bigint, group_id bigint")
    out = annotations.coverage_tables(c, m, s, s.select("group_id", "mol_id").distinct())
    assert values(out["molecules"], "mol_id", "recall") == {7: 0.75, 8: 0.0} and values(out["merged_molecules"], "mol_id", "recall") == {7: 0.75, 8: 0.0}
    assert out["spectra"].count() == 3 and out["merged_spectra"].count() == 2


def test_strongest_and_lists(spark):
    df = spark.createDataFrame([(0, 1, 5.0), (0, 2, 5.0), (0, 3, 1.0), (1, 4, 0.5)], "g int, i int, x double")
    assert values(joins.strongest(df, ["g"], "x", "i"), "g", "i") == {0: 1, 1: 4}
    assert [r["i"] for r in retrieval.top_items(df, ["g"], "i", "x", 1).orderBy("g").collect()] == [2, 4]
    got = values(retrieval.top_lists(df, ["g"], "i", "x", 2, 0.6), "g", "items")
    assert got == {0: [2, 1], 1: [-1, -1]}
    with pytest.raises(ValueError):
        joins.in_list(df, "odd", [1])
    random_ = retrieval.baseline(df.withColumnRenamed("g", "target_mol_id").withColumn("mol_id", F.col("i")), "random").collect()
    assert all(0 < r["score"] < 1 for r in random_) and len({r["score"] for r in random_}) == 4
    logs = retrieval.log_mean(spark.createDataFrame([(0, "a", math.log(1.0)), (0, "b", math.log(3.0))], "k int, m string, x double"), ["k"], "m", "x").first()
    assert logs["log_mean"] == pytest.approx(math.log(2)) and logs["log_std"] == pytest.approx(math.log(math.sqrt(2)))


def test_splits_of_all_kinds(spark):
    df = spark.range(20).select(F.col("id").alias("spec_id"), (F.col("id") % 5).alias("mol_id"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    ids = splits.loaded(df)
    assert [r["id"] for r in ids["mol_id"].where("split = 'train'").collect()] == [1, 2, 3, 4] and ids["spec_id"].count() == 20
    assert [r["spec_id"] for r in splits.row_range(df, ["spec_id"], 3, 6).orderBy("spec_id").collect()] == [3, 4, 5]
    sizes = spark.createDataFrame([(i, 10) for i in range(4)], "mol_id bigint, nodes int")
    mols = spark.createDataFrame([(i, "C") for i in range(5)], "mol_id bigint, formula string")
    with pytest.raises(PySparkException):
        splits.with_sizes(df, sizes, mols).collect()
    assert splits.with_sizes(df.where("mol_id < 4"), sizes, mols).count() == 16


def test_window_of_any_size(spark):
    """Relative windows at masses far apart, against all pairs."""
    rng = random.Random(8)
    masses = [rng.uniform(50, 60) for _ in range(30)] + [rng.uniform(1900, 1930) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(masses)), "mol_id int, exact_mw double").withColumn("inchikey_s", F.lit("K"))
    got = {(r["target_mol_id"], r["mol_id"]) for r in retrieval.mass_candidates(df, df, 2000.0).collect()}
    assert got == {(i, j) for i, x in enumerate(masses) for j, y in enumerate(masses) if x - x * 2e-3 <= y <= x + x * 2e-3} and len(got) > 60


def test_audits(spark):
    base = dict.fromkeys(RAW_COLUMNS) | {"dset": "d", "peaks": "100.5 1", "prec_type": "[M+H]1+", "inst_type": "HCD", "spec_type": "MS2", "ion_mode": "P", "smiles": "CCO", "formula": "C2H6O", "inchikey": "AAAAAAAAAAAAAA-X", "exact_mass": "46.04"}
    rows = [base | {"spec_id": "1", "col_energy": "20 eV", "col_energy_extra_1": "40 eV"}, base | {"spec_id": "2", "inchikey": "B"}, base | {"spec_id": "3", "exact_mass": "50"}, base | {"spec_id": "4", "formula": "C9"}, base | {"spec_id": "5", "col_energy": "10", "col_energy_extra_1": "20", "col_energy_extra_2": "30"}]
    raw = spark.createDataFrame([tuple(r.get(c) for c in RAW_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in RAW_COLUMNS))
    out = standardize.standardized(raw, spark.createDataFrame([("CCO", "C2H6O", "AAAAAAAAAAAAAA", 46.041865)], "smiles string, formula string, inchikey_s string, exact_mw double"))
    kept = {r["dset_spec_id"]: r for r in out["spectra"].collect()}
    assert set(kept) == {"1", "2", "5"} and kept["1"]["ce_type"] == "ramped" and kept["1"]["ace_extra_1"] == 40.0 and kept["2"]["ce_type"] == "none" and kept["5"]["ce_type"] == "stepped"
    assert [[r["dset_spec_id"] for r in out[a].collect()] for a in ("formula_audit", "inchikey_audit", "mass_audit")] == [["4"], ["2"], ["3"]]
    assert all(r["prec_mz"] == pytest.approx(47.049141, abs=1e-5) for r in kept.values())


def test_isotope_cleanup(spark):
    """A spectrum whose only peaks are flagged keeps them; flags of several kinds add up."""
    p = spectrum(spark, [(100.0, 10), (101.008, 1), (300.0, 5)], [(101.008, 1)])
    flag = lambda *rows: spark.createDataFrame([(*r, True) for r in rows], "spec_id bigint, peak_idx int, isotope boolean")
    kept = isotopes.cleaned(p, [isotopes.by_spacing(p), flag((0, 3), (1, 1))])
    assert Counter((r["spec_id"], r["mz"]) for r in kept.collect()) == Counter([(0, 100.0), (1, 101.008)])
