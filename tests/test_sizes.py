"""Steps whose tasks or passes grew with the table: plans, and results against plain versions."""

import math
import random

import pytest
from massweave.functions import formula
from massweave.operators import asof, retrieval
from massweave.plans import views
from massweave.plans.registry import QUERIES
from pyspark.sql import functions as F

SMOKE = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_formula_any_parts(spark, monkeypatch):
    monkeypatch.setattr(views, "PARTS", 20)
    assert views.Views(spark, SMOKE).frag_formulas().rdd.getNumPartitions() == 10
    monkeypatch.setattr(asof, "ROWS", 40)
    rng = random.Random(1)
    left = [(i, f"k{i % 3}", float(rng.randint(0, 60))) for i in range(400)]
    right = [(f"k{rng.randint(0, 2)}", float(rng.randint(0, 60)), f"n{j}") for j in range(60)]
    got = asof.nearest_value(spark.createDataFrame(left, "i int, k string, x double"), spark.createDataFrame(right, "k string, y double, name string"), ["k"], "x", "y", "name", parts=11)
    assert "RepartitionByExpression [_part" in plan(got)
    want = {i: min((abs(x - y), y, n) for kk, y, n in right if kk == k)[1:] for i, k, x in left}
    assert {r["i"]: (r["y"], r["name"]) for r in got.collect()} == want


def test_agreement_of_all_in_one_pass(spark):
    rows = [("a", 1, 0, [1]), ("b", 1, 0, [1]), ("a", 1, 1, [2]), ("b", 1, 1, [3]), ("a", 2, 0, [1]), ("b", 3, 0, [1]), ("a", 4, 0, [5]), ("b", 4, 0, [5])]
    df = spark.createDataFrame(rows, "model string, s int, g int, item array<int>")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = retrieval.agreement_of_all(df, "model", ["s", "g"], "s", "item")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert [tuple(r) for r in got.collect()] == [(0.75, 2, 2)]
    assert [tuple(r) for r in retrieval.agreement_of_all(df.where("s in (2, 3)"), "model", ["s", "g"], "s", "item").collect()] == [(None, 0, 2)]
    lists = retrieval.top_lists(spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, 9.0), (1, 4, 1.0), (2, 1, 0.5), (3, 1, None)], "g int, i int, x double"), ["g"], "i", "x", 2, 2.0)
    assert "Join" not in plan(lists)
    assert {r["g"]: (r["items"], r["n"]) for r in lists.collect()} == {1: ([3, 2], 3), 2: ([-1, -1], 0), 3: ([-1, -1], 0)}


def test_formula_subsets_rdbe_by_formula(spark):
    text = plan(QUERIES["formula_subsets_rdbe"](spark, SMOKE))
    assert "Aggregate [text" in text[text.rindex("Generate explode"):]
    got = formula.subformulas(spark.createDataFrame([(1, {"C": 2, "H": 3, "X": 1})], "i int, e map<string,int>"), "e", ["C", "H", "X"]).collect()
    assert {r["sub_mass"] is None for r in got if r["sub"].get("X")} == {True}
    known = [r for r in got if not r["sub"].get("X")]
    assert known and all(r["sub_mass"] == pytest.approx(sum(formula.MASSES[k] * n for k, n in r["sub"].items())) for r in known)
    assert all(1 + 0.5 * (2 * r["sub"].get("C", 0) - r["sub"].get("H", 0)) >= 0 for r in got)


def exchanges(df):
    """Shuffles of a plan whose keys go beyond the spectrum."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "Exchange hashpartitioning(" in line and ("idx" in line or "formula" in line or "_b#" in line or "k#" in line.split("hashpartitioning(")[1].split(",")[0])]


def test_hungarian_jss_stays_by_spectrum(spark):
    assert exchanges(QUERIES["hungarian_jss"](spark, SMOKE)) == []


def test_matched_ndcg_assigns_once(spark):
    text = QUERIES["matched_ndcg"](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInPandas") == 1
    assert exchanges(QUERIES["matched_ndcg"](spark, SMOKE)) == []


def test_isotopes_stay_by_spectrum(spark):
    for name in ("isotope_cleanup", "isotope_flags", "isotope_flags_by_formula"):
        assert exchanges(QUERIES[name](spark, SMOKE)) == [], name


def test_agreement_by_threshold_stays_by_spectrum(spark):
    df = QUERIES["agreement_by_threshold"](spark, SMOKE)
    assert exchanges(df) == [] and "Join" not in plan(df)


def test_agreement_by_threshold_by_brute_force(spark):
    """Formulas with several m/z; spectra without peaks, predictions or annotations."""
    from massweave.operators import annotations

    rng = random.Random(3)
    at = lambda: 150 + rng.randint(0, 6) * 0.001
    names, ids = "ABCDE", range(40)
    t = [(s, i, at(), float(rng.randint(1, 9))) for s in ids for i in range(rng.randint(0, 6))]
    a = [(s, f, at()) for s in ids for f in names[:3] if rng.random() < 0.6]
    p = [(s, f, at(), rng.randint(1, 9) / 10) for s in ids for f in names if rng.random() < 0.6]
    frame = lambda rows, schema: spark.createDataFrame(rows, "spec_id int, " + schema)
    got = annotations.agreement_by_threshold(frame(t, "peak_idx bigint, mz double, ints double"), frame(a, "formula string, mz double"), frame(p, "formula string, mz double, prob double"), [0.0, 0.5]).collect()
    near = lambda x, m: abs(x - m) / 200 < 1e-5
    part = lambda x, y: x / y if y else None
    want = {}
    for s in ids:
        peaks, prob = [x for x in t if x[0] == s], {x[1]: x[3] for x in p if x[0] == s}
        known = {x[1] for x in a if x[0] == s}
        total = sum(x[3] for x in peaks)
        on = [{x[1] for x in a if x[0] == s and near(y[2], x[2])} for y in peaks]
        pr = [{x[1] for x in p if x[0] == s and near(y[2], x[2])} for y in peaks]
        share = {f: [y[3] / total for y, o in zip(peaks, on) if f in o] for f in known}
        share = {f: sum(x) / len(x) for f, x in share.items() if x}
        jsd = None
        if share and prob:
            ent = lambda x: x * math.log(x) if x > 0 else 0.0
            sides = [(prob.get(f, 0) / sum(prob.values()), share.get(f, 0) / sum(share.values())) for f in known | set(prob)]
            jsd = sum(ent(x) / 2 + ent(y) / 2 - ent((x + y) / 2) for x, y in sides)
        mode = [min(q, key=lambda f: (-prob[f], f)) in o if q else False for o, q in zip(on, pr)]
        for c in (0.0, 0.5):
            of = {f for f, x in prob.items() if x >= c}
            both = [bool(o & q & of) for o, q in zip(on, pr)]
            hit = {f for f in of if any(f in o and f in q for o, q in zip(on, pr))}
            close = {f for f in of if any(o and f in q for o, q in zip(on, pr))}
            w = lambda flags: sum(y[3] / total for y, x in zip(peaks, flags) if x)
            if known and peaks:
                want[s, c] = [part(len(of & known), len(known)), part(sum(both), sum(map(bool, on))), part(w(both), w(on)), sum(both) / len(peaks), w(both), part(len(of & known), len(of)), part(len(hit), len(close)), part(len(hit), len(of))]
                want[s, c] += [part(sum(prob[f] for f in hit), sum(prob[f] for f in close)), sum(prob[f] for f in hit), part(sum(mode), sum(map(bool, on))), part(w(mode), w(on)), jsd]
    assert {(r["spec_id"], r["threshold"]) for r in got} == set(want) and len(got) == len(want) > 50
    for r in got:
        for x, y in zip(list(r)[2:], want[r["spec_id"], r["threshold"]]):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9)), (r, want[r["spec_id"], r["threshold"]])


def test_formulas_of_precursors_are_read_in_dealt_tasks(spark, monkeypatch):
    from massweave.plans import domain_queries

    monkeypatch.setattr(domain_queries, "PARTS", 20)
    text = plan(domain_queries.precursor_spectra(views.Views(spark, SMOKE)))
    dealt = [line for line in text.splitlines() if "RepartitionByExpression" in line and line.rstrip().endswith(", 10")]
    assert dealt and text.index("elements#") < text.index(dealt[0])


def test_isotopes_by_brute_force(spark):
    from massweave.operators import isotopes

    rng, step = random.Random(5), isotopes.SPACING
    rows = [(s, i, 100 + rng.randint(0, 3) * 0.5 + rng.randint(0, 3) * step + rng.choice([0, 0.003, -0.003, 0.006, 0.012]), float(rng.randint(1, 60))) for s in range(30) for i in range(rng.randint(0, 12))]
    p = spark.createDataFrame(rows, "spec_id bigint, peak_idx bigint, mz double, ints double")
    s = spark.createDataFrame([(i, "FT" if i % 5 else "IT", 103.0, "[M+H]+", {"C": 30, "H": 8, "Cl": 1}) for i in range(30)], "spec_id bigint, inst_type string, prec_mz double, prec_type string, elements map<string,int>")
    at = lambda x, k, d: [o for o in rows if o[0] == x[0] and x[2] + k * d - 0.02 <= o[2] <= x[2] + k * d + 0.02]
    low = {x[:2] for x in rows if any(o[3] >= x[3] for k in (1, 2, 3) for o in at(x, -k, isotopes.NEUTRON))}
    assert {tuple(r) for r in isotopes.by_spacing(p).where("isotope").select("spec_id", "peak_idx").collect()} == low and low
    best = {}
    for x in rows:
        for k in (1, 2):
            near = [o for o in rows if o[0] == x[0] and x[0] % 5 and x[2] + k * step - 0.008 <= o[2] <= x[2] + k * step + 0.008 and (k > 1 or abs(o[2] - (x[2] + k * step)) <= 0.004)]
            if near:
                best[(*x[:2], k)] = max((o[3], -o[2], -o[1]) for o in near)
    pairs = isotopes.envelope_pairs(s, p).collect()
    assert {(r["spec_id"], r["peak_idx"], r["k"]): (r["o_ints"], r["o_idx"]) for r in pairs} == {k: (o[0], -o[2]) for k, o in best.items()} and len(pairs) == len(best) > 20
    fraction = spark.createDataFrame([(i, k, 0.4) for i in range(30) for k in (1, 2) if i % 7], "spec_id bigint, k int, f double")

    def good(r):
        want = 0.4 * r["r_frag"] / (1 + 0.4 * (r["r_prec"] - r["r_frag"])) if r["k"] == 1 else 0.4 * r["r_frag"]
        return r["spec_id"] % 7 and r["o_ints"] < r["ints"] and 0.05 * want <= r["o_ints"] / r["ints"] <= 10 * want

    first = {(r["spec_id"], r["peak_idx"]) for r in pairs if good(r) and r["k"] == 1}
    want = {(r["spec_id"], r["o_idx"]) for r in pairs if good(r) and (r["spec_id"], r["peak_idx"]) in first}
    leaking = isotopes.leak_peaks(s, p, fraction)
    assert leaking.count() == len(rows) and {tuple(r) for r in leaking.where("isotope").select("spec_id", "peak_idx").collect()} == want and want
    kept = isotopes.cleaned(isotopes.by_spacing(p), [leaking]).select("spec_id", "peak_idx").collect()
    left = {x[:2] for x in rows} - low - want
    assert sorted(map(tuple, kept)) == sorted(x[:2] for x in rows if x[:2] in left or x[0] not in {y[0] for y in left})


def test_records_of_many_batches(spark, tmp_path):
    from massweave.sources.readers import entries
    from massweave.sources.records import BLANK, records

    want = [f"r{i}\n" + "\n".join(f"{j} x" for j in range(i % 7)) for i in range(300)]
    (tmp_path / "a.txt").write_text("\r\n \n".join(want) + "\n")
    (tmp_path / "b.txt").write_text("open\nend")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = records(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], BLANK).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["value"] for r in got) == sorted([w.rstrip("\n") for w in want] + ["open\nend"])
    assert {r["file"][-5:] for r in got if r["value"] == "open\nend"} == {"b.txt"}
    df = spark.createDataFrame([([("a", "1"), ("b", "2")],), ([("a", "1"), ("b", "2"), ("a", "3")],)], "p array<struct<k:string,v:string>>").select(entries(F.col("p")).alias("m"))
    assert "map_from_entries" in plan(df)
    assert [r["m"] for r in df.collect()] == [{"a": "1", "b": "2"}, {"a": "3", "b": "2"}]
