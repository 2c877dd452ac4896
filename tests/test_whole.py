"""Queries that do their whole job: all rows as queries, all spectra as sides of pairs, copies included; held against their SQL."""

from pathlib import Path

import duckdb
import pytest
from massweave.plans import QUERIES, SQL

from test_large import by_sql, tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def near(rows):
    return sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)


def copies(spark, folder):
    """Twelve spectra of three kinds."""
    lines = [(i, n, 70 * (100.0 + 11 * n + i % 3 * (n == 1)), float(n)) for i in range(12) for n in range(1, 4)]
    return tables(spark, folder, [(1, 1, 400.0)], lines)


def same_on_copies(spark, folder, name):
    """Rows that equal those of the SQL."""
    folder = copies(spark, folder)
    got = [tuple(r) for r in QUERIES[name](spark, folder).collect()]
    assert near(got) == near(by_sql(folder, name))
    return got


def same_on_smallest(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = [tuple(r) for r in QUERIES[name](spark, SF).collect()]
    assert near(got) == near(con.execute(SQL[name]).fetchall())
    return got


def test_query_candidates_of_every_spectrum(spark):
    got = same_on_smallest(spark, "query_candidates")
    assert {r[0] % 100 for r in got} > {0, 1, 2}


def test_tanimoto_topk_of_every_vector(spark):
    got = same_on_smallest(spark, "tanimoto_topk")
    assert {r[0] % 100 for r in got} > {0, 1, 2}


def test_pairwise_jss_pairs_copies_too(spark, tmp_path):
    got = same_on_copies(spark, tmp_path, "pairwise_jss")
    assert len(got) == 66 and (0, 3) in {(a, b) for a, b, _ in got} and all(x is not None for _, _, x in got)


def test_pairwise_cosine_topk_asks_for_every_spectrum(spark, tmp_path):
    got = same_on_copies(spark, tmp_path, "pairwise_cosine_topk")
    assert {a for a, _, _ in got} == set(range(11)) and all(a < b for a, b, _ in got)


def test_pairwise_cosine_above_pairs_copies_too(spark, tmp_path):
    got = same_on_copies(spark, tmp_path, "pairwise_cosine_above")
    assert len(got) == 66 and (0, 3) in {(a, b) for a, b, _ in got} and all(x is not None for _, _, x in got)


def test_pairwise_cosine_topk_coarse_asks_for_every_spectrum(spark, tmp_path):
    got = same_on_copies(spark, tmp_path, "pairwise_cosine_topk_coarse")
    assert {a for a, _, _ in got} == set(range(11)) and all(a < b for a, b, _ in got)


def test_pairwise_hungarian_pairs_copies_too(spark, tmp_path):
    got = same_on_copies(spark, tmp_path, "pairwise_hungarian")
    assert len(got) == 66 and (0, 3) in {(a, b) for a, b, _ in got} and all(x is not None for _, _, x in got)


def test_pairwise_matched_ce_pairs_copies_too(spark, tmp_path):
    got = same_on_copies(spark, tmp_path, "pairwise_matched_ce")
    assert len(got) == 66 and (0, 3) in {(a, b) for a, b, _ in got} and all(x is not None for _, _, x in got)


def test_pairwise_matched_jss_pairs_copies_too(spark, tmp_path):
    got = same_on_copies(spark, tmp_path, "pairwise_matched_jss")
    assert len(got) == 66 and (0, 3) in {(a, b) for a, b, _ in got} and all(x is not None for _, _, x in got)


def test_pairwise_cross_entropy_pairs_copies_too(spark, tmp_path):
    got = same_on_copies(spark, tmp_path, "pairwise_cross_entropy")
    assert len(got) == 132 and (0, 3) in {(a, b) for a, b, _ in got} and all(x is not None for _, _, x in got)


def hot(spark, folder):
    """Forty spectra with a bin in common, and two more that only some share."""
    lines = [(i, n, 70 * (100.0 + 11 * n * (i % (1 + 2 * n))), float(1 + (i * n) % 7)) for i in range(40) for n in range(3)]
    return tables(spark, folder, [(1, 1, 400.0)], lines)


def exchanges(df):
    """The columns that a plan deals rows by."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [x.split("hashpartitioning(")[1].split(")")[0] for x in lines if "Exchange hashpartitioning(" in x]


def test_meetings_of_a_crowded_bin_are_all_pairs_once(spark, tmp_path, monkeypatch):
    from massweave.operators import meetings

    folder = hot(spark, tmp_path)
    for block in (20_000, 7):
        monkeypatch.setattr(meetings, "BLOCK", block)
        for name in ("pairwise_jss", "pairwise_cross_entropy"):
            got = [tuple(r) for r in QUERIES[name](spark, folder).collect()]
            assert near(got) == near(by_sql(folder, name)) and len(got) >= 780, (name, block)


def test_pairwise_jss_deals_nothing_by_pair(spark):
    assert {x.split("#")[0] for x in exchanges(QUERIES["pairwise_jss"](spark, SF))} == {"bin"}


def test_pairwise_cross_entropy_deals_nothing_by_pair(spark):
    assert {x.split("#")[0] for x in exchanges(QUERIES["pairwise_cross_entropy"](spark, SF))} == {"bin"}


def close_peaks(spark, n=40):
    """Peaks so close that many have several partners, across edges of bins too."""
    import random

    rng = random.Random(8)
    rows = [(i, k, 199.99 + 0.0005 * rng.randint(0, 60), float(rng.randint(1, 9))) for i in range(n) for k in range(rng.randint(1, 7))]
    return spark.createDataFrame(rows, "spec_id long, peak_idx long, mz double, ints double")


def test_sharing_matched_is_pairwise_matched(spark, monkeypatch):
    from massweave.operators import allpairs, matching, meetings

    df = close_peaks(spark)
    pairs = allpairs.sharing(df, 0.01)
    for score, least in (("cos", None), ("ce", None), ("ce", 8.0), ("cos", 0.5)):
        want = matching.pairwise_matched(df, pairs, score=score, least=least)
        monkeypatch.setattr(matching, "PAIRS", 30 if least is None else 2_000_000)
        monkeypatch.setattr(meetings, "BLOCK", 9 if least is None else 20_000)
        got = matching.sharing_matched(df, 0.01, score=score, least=least)
        assert near(map(tuple, got.select(want.columns).collect())) == near(map(tuple, want.collect())), (score, least)
        assert got.count() > 10
    with pytest.raises(ValueError):
        matching.sharing_matched(df, 0.01, score="odd")


def test_matched_jss_is_that_of_its_assignment(spark):
    """Pairs without ties: gains of every assignment, of which the one of most intensity counts."""
    import math
    from itertools import permutations

    from massweave.operators import matching

    rows = [(0, k, m, x) for k, (m, x) in enumerate([(199.991, 3.0), (199.9925, 5.0), (300.0, 1.5)])] + [(1, k, m, x) for k, (m, x) in enumerate([(199.9915, 7.0), (199.9935, 2.0), (300.001, 4.25), (500.0, 1.0)])]
    df = spark.createDataFrame(rows, "spec_id long, peak_idx long, mz double, ints double")
    t, p = [[(m, x / sum(v for s, _, _, v in rows if s == side)) for s, _, m, x in rows if s == side] for side in (0, 1)]
    log = lambda x: x * math.log(x) if x else 0.0
    gain = lambda x, y: (x + y) / 2 - (0.5 * log(x) + 0.5 * log(y) - log((x + y) / 2)) / math.log(2)
    best = max(([(x, p[j][1]) for (m, x), j in zip(t, order) if abs(m - p[j][0]) / max(m, 200) < 1e-5] for order in permutations(range(len(p)), len(t))), key=lambda a: sum(map(sum, a)))
    got = matching.sharing_matched(df, 0.01, score="jss").collect()
    assert len(got) == 1 and abs(got[0]["jss_hun"] - sum(gain(*v) for v in best)) < 1e-9 and len(best) > 1


@pytest.mark.parametrize("name", ["pairwise_hungarian", "pairwise_matched_ce", "pairwise_matched_jss"])
def test_matched_pairs_are_not_dealt_by_pair(spark, name):
    assert not {x.split("#")[0] for x in exchanges(QUERIES[name](spark, SF))} - {"bin"}


def some_spectra(spark, n=150, most=14):
    import random

    rng = random.Random(4)
    rows = [(i, k, rng.randint(0, 9) + 0.5 if i % 3 else rng.randint(0, 30) + 0.5, float(rng.choice([1, 2, 9, 30, 31]))) for i in range(n) for k in range(rng.randint(1, most))]
    return spark.createDataFrame(rows, "spec_id long, peak_idx long, mz double, ints double")


def test_cosine_above_is_every_pair_of_that_cosine(spark, monkeypatch):
    from massweave.operators import allpairs, similarity

    df = some_spectra(spark)
    every = {(r["a"], r["b"]): r["cos"] for r in similarity.pairwise_cosine(df, 1.0).collect()}
    monkeypatch.setattr(allpairs, "CELLS", 50)
    for least in (0.3, 0.8, 0.95, 1.0):
        want = {k for k, x in every.items() if round(x, 6) >= least}
        rows = allpairs.cosine_above(df, least, 1.0).collect()
        assert {(r["a"], r["b"]) for r in rows} == want and len(rows) == len(want) > 0, least
        assert all(abs(r["cos"] - every[r["a"], r["b"]]) < 1e-9 for r in rows)


def test_cosine_above_deals_nothing_by_pair(spark):
    assert {x.split("#")[0] for x in exchanges(QUERIES["pairwise_cosine_above"](spark, SF))} == {"key"}
