"""Readers and writers on small texts; streams against batch."""

import io
import json
import tarfile
import zipfile

import pytest
from massweave.sources import readers, sinks
from massweave.streaming import jobs
from pyspark.sql import functions as F


def test_msp(spark, tmp_path):
    (tmp_path / "a.msp").write_text('Name: X0\nPrecursorMZ: 100.5\nCAS#: 1-2; NISTNO: 77\nComments: "computed SMILES=CCO" "MoNA Rating=4"\nNum Peaks: 2\n50.1 10\n60.2 20 "p"\n\nName: Y\nUnknown: 1\nNum peaks: 1\n1 2\n\n\n')
    rows = {r["name"]: r for r in readers.msp(spark, str(tmp_path / "a.msp")).collect()}
    assert rows["X0"]["peaks"] == '50.1 10\n60.2 20 "p"' and rows["X0"]["smiles"] == "CCO" and rows["X0"]["rating"] == "4" and rows["X0"]["num_peaks"] == "2"
    assert rows["Y"]["peaks"] == "1 2" and len(rows) == 2


def test_mgf(spark, tmp_path):
    (tmp_path / "a.mgf").write_text("BEGIN IONS\nTITLE=LIB0007\nINCHI=abc\nINCHIKEY=K\nSMILES=CCO |t:4|\nADDUCT=[M+H]+\nCOLLISION_ENERGY_1=20\nCOLLISION_ENERGY_2=nan\nPRECURSOR_MZ=100.5\n50.10 10.0\n60.0 2.0\nEND IONS\n\nBEGIN IONS\nTITLE=LIB8\nADDUCT=[M-H]-\n1.0 2.0\nEND IONS\n")
    a, b = readers.mgf(spark, str(tmp_path / "a.mgf")).orderBy("title").collect()
    assert (a["inchi"], a["inchikey"], a["smiles"], a["ion_mode"], a["col_energy"], a["col_energy_extra_1"], a["prec_mz"], a["peaks"], a["dset_spec_id"]) == ("abc", "K", "CCO", "P", "20 eV", None, 100.5, "50.10 10.0\n60.0 2.0", "0007")
    assert b["ion_mode"] == "N"


def test_ms(spark, tmp_path):
    d = tmp_path / "ms"
    d.mkdir()
    (d / "S1.ms").write_text(">compound X\n>parentmass 100.5\n#instrumentation Orbitrap\n\n>ms1peaks\n100 1\n\n>collision 20\n50 1\n60 2\n\n>ms2peaks\n70 1\n")
    (tmp_path / "meta.tsv").write_text("spec\tname\tionization\tformula\tsmiles\nS1\tX\t[M+H]+\tC2H6O\tCCO\n")
    rows = {r["dset_spec_id"]: r for r in readers.ms_library(spark, str(d), str(tmp_path / "meta.tsv")).collect()}
    assert set(rows) == {"S1_1", "S1_2"} and rows["S1_1"]["col_energy"] == "20" and rows["S1_1"]["peaks"] == "50 1\n60 2" and rows["S1_2"]["prec_type"] == "[M+H]+" and rows["S1_2"]["inst_type"] == "Orbitrap"
    s = readers.sirius(spark, str(d / "S1.ms")).collect()
    assert sorted(r["header"] for r in s) == ["collision 20", "ms1peaks", "ms2peaks"] and s[0]["meta"]["parentmass"] == "100.5"


def test_zip_and_tar(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "lib.zip", "w") as z:
        z.writestr("a.txt", "ACCESSION: 7\nMS$FOCUSED_ION: PRECURSOR_TYPE [M+H]+\nAC$MASS_SPECTROMETRY: ION_MODE POSITIVE\nAC$MASS_SPECTROMETRY: COLLISION_ENERGY 10\nPK$NUM_PEAK: 1\n  50.5 10 999\n")
    (r,) = readers.pcdl(spark, str(tmp_path / "*.zip")).collect()
    assert (r["dset_spec_id"], r["ion_mode"], r["col_energy"], r["peaks"]) == ("lib_7", "P", "10 eV", "50.5 10")
    (tmp_path / "c.json").write_text(json.dumps({"A": ["B", "C"], "D": []}))
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as t:
        data = (tmp_path / "c.json").read_bytes()
        info = tarfile.TarInfo("c.json")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    for name in ("c.json", "c.tar.gz"):
        assert sorted((r["target"], r["candidate"]) for r in readers.candidate_map(spark, str(tmp_path / name)).collect()) == [("A", "B"), ("A", "C")]
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("x.tsv", "sid\tsmiles\n1\tCCO\n")
        z.writestr("y.txt", "no")
    assert [r["smiles"] for r in readers.taxonomy(spark, str(tmp_path / "t.zip")).collect()] == ["CCO"]
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("y.txt", "no")
    with pytest.raises(ValueError):
        readers.taxonomy(spark, str(tmp_path / "u.zip"))


def test_tables(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("identifier\tmzs\tintensities\tadduct\tfold\tsimulation_challenge\tcollision_energy\nA\t1.0,2.0\t0.5,1.0\t[M+H]+\ttrain\tTrue\t30.0 normalized=True\nB\t3.0\t1.0\t[M+H]+\ttest\tFalse\t20.0\n")
    spectra, folds = readers.gym_tsv(spark, str(tmp_path / "g.tsv"), "simulation_challenge")
    (r,) = spectra.collect()
    assert (r["peaks"], r["col_energy"]) == ("1.0 0.5\n2.0 1.0", "NCE=30.0%") and folds.first()["fold"] == "train"
    with pytest.raises(ValueError):
        readers.gym_tsv(spark, str(tmp_path / "g.tsv"), "odd")
    (tmp_path / "e.csv").write_text('name,peaks,smiles\nX,"(50 10) (60 20)",CCO\n')
    assert readers.ei_csv(spark, str(tmp_path / "e.csv")).first()["peaks"] == "50 10\n60 20"
    (tmp_path / "s.sdf").write_text("x\n> <PUBCHEM_COMPOUND_CID>\n7\n\n> <PUBCHEM_EXACT_MASS>\n46.04\n\n$$$$\ny\n> <PUBCHEM_COMPOUND_CID>\n8\n\n$$$$\n")
    assert [(r["cid"], r["exact_mass"]) for r in readers.sdf(spark, str(tmp_path / "s.sdf")).orderBy("cid").collect()] == [(7, 46.04), (8, None)]
    (tmp_path / "p.log").write_text("#In-silico\n#ID=x\nenergy0\n100.5 50.0 0 1 (30 20)\nenergy1\n60.5 10.0 1 (10)\n\n0 100.5 CCO\n1 60.5 CC\n")
    assert sorted((r["smi"], r["inten"], r["energy"]) for r in readers.fragment_predictions(spark, str(tmp_path / "p.log")).collect()) == [("CC", 10.0, "energy1"), ("CC", 20.0, "energy0"), ("CCO", 30.0, "energy0")]
    assert sorted((r["smi"], r["inten"]) for r in readers.fragment_predictions(spark, str(tmp_path / "p.log"), merge=True).collect()) == [("CC", 20.0), ("CCO", 30.0)]
    (tmp_path / "l.smi").write_text("CCO x\nCC\nCCO\n")
    assert [r["smiles"] for r in readers.smiles_list(spark, str(tmp_path / "l.smi")).collect()] == ["CC", "CCO"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, 0, "train", 0), (2, 6, 1, "test", 1)], "spec_id int, mol_id int, group_id int, split string, fold int")
    sinks.splits(df, str(tmp_path / "s"), {"seed": 1})
    assert spark.read.csv(str(tmp_path / "s/ids"), header=True).count() == 2 and json.loads(spark.read.text(str(tmp_path / "s/meta")).first()[0]) == {"seed": 1}
    sinks.fold_lists(df, str(tmp_path / "f"), ["fold"])
    assert spark.read.csv(str(tmp_path / "f"), header=True).count() == 2
    path = str(tmp_path / "c")
    df.limit(1).write.parquet(path)
    sinks.append_new(df, spark.read.parquet(path), path, "spec_id")
    assert spark.read.parquet(path).count() == 2 and sinks.remaining(df, df.limit(1), "spec_id").count() == 1
    r = sinks.report(spark.createDataFrame([("a", "x", 0.5, 0.1), ("b", "x", None, None)], "m string, c string, u double, s double"), "m", "c", "u", "s", ["x", "y"])
    assert {x["m"]: (x["x"], x["y"]) for x in r.collect()} == {"a": ("0.5000 ± 0.1000", "-"), "b": ("-", "-")}


def drain(spark, rows, tmp_path, name, mode):
    out = str(tmp_path / name)
    rows.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)).option("checkpointLocation", f"{out}.c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_streams(spark, tmp_path):
    batch = spark.range(500).select(F.col("id"), (F.col("id") % 5).alias("m"), (F.col("id") * 0.5).alias("x"), (F.col("id") % 7 + 1).alias("size"), F.lit(False).alias("flush"), F.timestamp_seconds("id").alias("ts"), F.lit(0).alias("shard"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["m"]: r["sum_wx"] for r in drain(spark, jobs.running_moments(stream(), ["m"], "x"), tmp_path, "a", "complete").collect()}
    assert got == {r["m"]: r["s"] for r in batch.groupBy("m").agg(F.sum("x").alias("s")).collect()}
    assert drain(spark, jobs.first_seen(stream().select("m"), ["m"]), tmp_path, "b", "append").count() == 5
    packs = drain(spark, jobs.packed(stream(), "id", "size", 50, 2), tmp_path, "d", "append").collect()
    assert all(r["total"] <= 50 for r in packs) and len({i for r in packs for i in r["ids"]}) == sum(len(r["ids"]) for r in packs)
    windows = drain(spark, jobs.tumbling(stream(), "ts", ["m"], "x", "1 minute", "0 seconds"), tmp_path, "e", "append")
    assert windows.count() > 0


def test_records_cut_anywhere(spark, tmp_path):
    """Records of mixed line ends, cut by Spark at every few bytes, are the same as from one read."""
    from massweave.sources.records import BLANK, IONS, records

    ends = ["\n", "\r\n"]
    each = [[f"Name: N{i}", f"Num Peaks: {i % 4}", *[f"{k}.5 {i}" for k in range(i % 4)]] for i in range(40)]
    texts = {
        "mixed.msp": "".join(ends[i % 2].join(r) + ends[i % 2] + "  " * (i % 3) + ends[i % 2] * (1 + i % 2) for i, r in enumerate(each)),
        "last.msp": "\r\n\r\n".join("\r\n".join(r) for r in each[:5]),
        "blank.msp": "\n\n\n \n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = sorted(["\n".join(r) for r in each] + ["\n".join(r) for r in each[:5]])
    key = "spark.sql.files.maxPartitionBytes"
    before, cost = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        for size in (1, 2, 3, 7, 16, 50, 333, 100_000):
            spark.conf.set(key, f"{size}b")
            if size < 7:
                (tmp_path / f"few{size}").mkdir()
                (tmp_path / f"few{size}" / "x.msp").write_bytes(texts["mixed.msp"].encode()[:130])
                got = sorted(r["value"] for r in records(spark, str(tmp_path / f"few{size}"), BLANK).collect())
                import re

                assert got == sorted(x for x in (b.strip() for b in re.split(r"\n[ ]*\n", texts["mixed.msp"][:130].replace("\r\n", "\n"))) if x)
            else:
                got = records(spark, [str(tmp_path / n) for n in texts], BLANK)
                assert sorted(r["value"] for r in got.collect()) == want
        (tmp_path / "a.mgf").write_bytes(b"BEGIN IONS\r\nTITLE=x 1\r\n1.0 2\r\nEND IONS\r\n\r\nBEGIN IONS\nTITLE=y 2\n3.0 4\nEND IONS\n")
        spark.conf.set(key, "9b")
        assert sorted(r["value"].strip() for r in records(spark, str(tmp_path / "a.mgf"), IONS).collect()) == ["BEGIN IONS\nTITLE=x 1\n1.0 2", "BEGIN IONS\nTITLE=y 2\n3.0 4"]
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_many_targets_in_few_files(spark, tmp_path):
    """100,000 targets and a large one in a dozen files; one target is read from one file or two."""
    from massweave.sources import sinks
    from pyspark.sql import functions as F

    path = str(tmp_path / "by_target")
    rows = spark.range(100_000).select(F.col("id").alias("target"), (F.col("id") * 2).alias("x")).unionByName(spark.range(60_000).select(F.lit(7).cast("bigint").alias("target"), F.col("id").alias("x")))
    rows = rows.unionByName(spark.createDataFrame([(None, 1)], "target bigint, x bigint"))
    sinks.clustered(rows, path, "target", 12)
    ranges = spark.read.parquet(f"{path}/ranges").collect()
    assert len(ranges) <= 12 and sum(r["rows"] for r in ranges) == 160_001 and max(r["rows"] for r in ranges) < 40_000
    for target in (0, 555, 31_000, 99_999):
        held = [r for r in ranges if r["first"] <= target <= r["last"]]
        got = sinks.of_target(spark, path, "target", target).collect()
        assert [(r["target"], r["x"]) for r in got] == [(target, 2 * target)] and len(held) <= 2
    assert sinks.of_target(spark, path, "target", 7).count() == 60_001
    assert sinks.of_target(spark, path, "target", -5).count() == 0 and sinks.of_target(spark, path, "target", None).count() == 1
