"""Each stage of the pipeline on its own input against a plain version."""

from collections import Counter

import corpus_pipeline
import pytest
from llm_data import documents_of
from massweave.llm.common import materialize
from test_llm_operators import brute_groups, brute_prints, brute_targets, norm

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = docs
        docs = materialize(stage(spark, docs, SF))
        assert name == "packing" or docs.columns == names
        kept[f"{name}_out"] = docs
    before = {r["doc_id"]: r["text"] for r in kept["exact_dedup"].collect()}
    groups = {}
    for i in sorted(before):
        groups.setdefault(norm(before[i]), i)
    assert sorted(r["doc_id"] for r in kept["exact_dedup_out"].collect()) == sorted(groups.values())
    before = {r["doc_id"]: brute_prints(r["text"]) for r in kept["near_dedup"].collect()}
    want = {min(group) for group in brute_groups(before)}
    assert {r["doc_id"] for r in kept["near_dedup_out"].collect()} == want
    words = lambda df: Counter({s: n for s, n in df.rdd.map(lambda r: (r["source"], len((r["text"] or "").encode().split()))).reduceByKey(lambda a, b: a + b).collect()})
    target = brute_targets(words(kept["mixing"]))
    taken = words(kept["mixing_out"])
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    pieces = docs.toPandas()
    whole = pieces.groupby(["doc_id", "doc_tokens"]).length.sum()
    assert all(n % t == 0 for (_, t), n in whole.items()) and kept["packing"].count() == sum(n // t for (_, t), n in whole.items())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert documents_of(spark).count() == 1000


@pytest.mark.parametrize("case", ["odd", "none"])
def test_run_on_odd_rows(spark, odd, none, tmp_path, case):
    """Nulls, empty and long texts, repeated rows, clashing names; and no rows at all."""
    (odd if case == "odd" else none).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, 0)] if case == "odd" else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert (pieces.count() > 0) == (case == "odd") and "ids_crc32" in pieces.columns
