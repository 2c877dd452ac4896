"""Readers of spectral libraries as text: one record a row, then column expressions."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massweave.functions.text import comment_value, missing_as_null
from massweave.operators.ordering import hash_order
from massweave.schemas import RAW_COLUMNS
from massweave.sources.records import BLANK, COMPOUND, IONS, records

#: Keys of MSP records and their columns.
MSP_COLUMNS = {
    "Precursor_type": "prec_type", "Spectrum_type": "spec_type", "PrecursorMZ": "prec_mz", "Instrument_type": "inst_type", "Collision_energy": "col_energy",
    "Ion_mode": "ion_mode", "Ionization": "ion_type", "ID": "spec_id", "Collision_gas": "col_gas", "Pressure": "pressure", "Num peaks": "num_peaks", "MW": "mw",
    "ExactMass": "exact_mass", "CASNO": "cas_num", "NISTNO": "dset_spec_id", "Name": "name", "MS": "peaks", "SMILES": "smiles", "Rating": "rating", "Frag_mode": "frag_mode",
    "Instrument": "inst", "RI": "ri", "DB#": "dset_spec_id_2", "Notes": "notes", "Formula": "formula", "InChIKey": "inchikey",
}
#: Keys of MGF records and their columns.
MGF_COLUMNS = {
    "FORMULA": "formula", "SMILES": "smiles", "INCHI": "inchi", "INCHIKEY": "inchikey", "IONMODE": "ion_mode", "ADDUCT": "prec_type", "COMPOUND_NAME": "name",
    "PRECURSOR_MZ": "prec_mz", "PARENT_MASS": "exact_mass", "MS_LEVEL": "spec_type", "CHARGE": "charge", "INSTRUMENT_TYPE": "inst_type",
    "COLLISION_ENERGY_1": "col_energy", "COLLISION_ENERGY_2": "col_energy_extra_1", "COLLISION_ENERGY_3": "col_energy_extra_2",
    "FOLD_INCHI": "fold_inchi", "FOLD_FORM": "fold_form", "FOLD_MCES": "fold_mces", "FOLD_MCESFORM": "fold_mcesform", "INDEX": "spec_id", "SOURCE": "source", "TITLE": "title", "NUM_PEAKS": "num_peaks",
}
#: Keys of zipped library records and their columns.
PCDL_COLUMNS = {
    "ACCESSION:": "dset_spec_id", "CH$NAME:": "name", "CH$FORMULA:": "formula", "CH$EXACT_MASS:": "exact_mass", "CH$SMILES:": "smiles", "CH$LINK: INCHIKEY": "inchikey",
    "AC$INSTRUMENT_TYPE:": "inst_type", "AC$MASS_SPECTROMETRY: MS_TYPE": "spec_type", "AC$MASS_SPECTROMETRY: ION_MODE": "ion_mode", "AC$MASS_SPECTROMETRY: COLLISION_ENERGY": "col_energy",
    "MS$FOCUSED_ION: PRECURSOR_M/Z": "prec_mz", "MS$FOCUSED_ION: PRECURSOR_TYPE": "prec_type", "PK$NUM_PEAK:": "num_peaks",
}
#: Tags of compound records and their columns.
SDF_TAGS = {"PUBCHEM_COMPOUND_CID": "cid", "PUBCHEM_IUPAC_INCHIKEY": "inchikey", "PUBCHEM_EXACT_MASS": "exact_mass", "PUBCHEM_MOLECULAR_FORMULA": "formula", "PUBCHEM_OPENEYE_CAN_SMILES": "smiles"}

PEAK_LINE = r"^\d+(?:\.\d+)?\s\d+(?:\.\d+)?"


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def entries(pairs: Column) -> Column:
    """A map of (key, value) structs; a later key wins over an earlier one."""
    last = lambda ps: F.aggregate(ps, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    once = lambda ps: F.size(F.array_distinct(F.transform(ps, lambda p: p["k"]))) == F.size(ps)
    return F.transform(F.array(pairs), lambda ps: F.when(once(ps), F.map_from_entries(ps)).otherwise(last(ps)))[0]


def pair(line: Column, sign: str) -> Column:
    return F.struct(F.substring_index(line, sign, 1).alias("k"), F.trim(F.substring(line, F.instr(line, sign) + len(sign), F.length(line))).alias("v"))


def picked(df: DataFrame, source: str, columns: dict[str, str]) -> list[Column]:
    return [F.try_element_at(F.col(source), F.lit(k)).alias(c) for k, c in columns.items()]


def msp(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """MSP records (at most ``first`` of them, in the order of a hash); a line with both ``CAS#`` and ``NIST#`` is two; unknown keys and empty records go."""
    found = records(spark, path, BLANK)
    found = found.orderBy(F.md5("value")).limit(first) if first is not None else found
    df = found.withColumn("_l", F.flatten(F.transform(lines(F.col("value")), lambda x: F.when(F.contains(x, F.lit("CAS#")) & F.contains(x, F.lit("NIST#")), F.transform(F.split(x, ";"), lambda x: F.trim(x))).otherwise(F.array(x)))))
    at = F.array_position(F.transform("_l", lambda x: F.startswith(x, F.lit("Num peaks:")) | F.startswith(x, F.lit("Num Peaks:"))), F.lit(True))
    df = df.withColumn("_at", at)
    head = F.when(F.col("_at") > 0, F.slice("_l", 1, F.col("_at").cast("int"))).otherwise(F.col("_l"))
    peaks = F.when(F.col("_at") > 0, F.array_join(F.expr("slice(_l, cast(_at as int) + 1, size(_l))"), "\n"))
    keyed = F.transform(head, lambda x: pair(F.when(F.startswith(x, F.lit("Num Peaks:")), F.concat(F.lit("Num p"), F.substring(x, 6, 1_000_000_000))).otherwise(x), ":"))
    df = df.withColumn("_m", entries(keyed)).withColumn("_c", F.try_element_at("_m", F.lit("Comments")))
    cols = {c: v for c, v in zip(MSP_COLUMNS.values(), picked(df, "_m", MSP_COLUMNS))}
    cols["peaks"] = peaks.alias("peaks")
    for c, key in (("smiles", "computed SMILES"), ("rating", "MoNA Rating"), ("frag_mode", "fragmentation mode")):
        cols[c] = F.coalesce(comment_value(F.col("_c"), key), cols[c]).alias(c)
    return df.select(*cols.values()).dropna("all")


def mgf(spark: SparkSession, path: str) -> DataFrame:
    """MGF records with exact keys; words for missing values as null, energies with their unit, first part of SMILES."""
    df = records(spark, path, IONS).withColumn("_l", F.filter(lines(F.col("value")), lambda x: x != "BEGIN IONS"))
    is_peak = lambda x: F.regexp_like(x, F.lit(PEAK_LINE))
    df = df.withColumn("_m", entries(F.transform(F.filter("_l", lambda x: F.contains(x, F.lit("=")) & ~is_peak(x)), lambda x: pair(x, "="))))
    out = df.select(*[missing_as_null(c).alias(n) for n, c in zip(MGF_COLUMNS.values(), picked(df, "_m", MGF_COLUMNS))], F.array_join(F.transform(F.filter("_l", is_peak), lambda x: F.regexp_replace(x, r"\s+", " ")), "\n").alias("peaks"))
    mode = F.when(F.contains("prec_type", F.lit("+")), "P").when(F.contains("prec_type", F.lit("-")), "N")
    out = out.withColumn("ion_mode", mode)
    out = out.withColumns({c: F.concat(F.col(c), F.lit(" eV")) for c in ("col_energy", "col_energy_extra_1", "col_energy_extra_2")} | {c: F.col(c).cast("double") for c in ("prec_mz", "exact_mass")} | {"smiles": F.split_part(F.col("smiles"), F.lit(" "), F.lit(1))})
    return out.withColumn("dset_spec_id", F.regexp_extract("title", r"(\d+)$", 1))


def ms_files(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a directory of ``.ms`` files: ``stem, idx, level, col_energy, peaks`` with the file's name, mass and instrument; only level 2."""
    df = spark.read.text(f"{path}/*.ms", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.ms$", 1).alias("stem"), F.regexp_replace("value", "\r", "").alias("value"))
    meta = {">compound": "name", ">parentmass": "prec_mz", "#instrumentation": "inst_type"}
    blocks = F.filter(F.regexp_extract_all("value", F.lit(r"(?m)^>(?:ms1peaks|ms1merged|ms2peaks|ms2merged|collision)[^\n]*\n(?:[^\n>#][^\n]*\n?)*"), F.lit(0)), lambda b: b != "")
    one = df.select("stem", *[F.nullif(F.regexp_extract("value", rf"(?m)^{k} (.*)$", 1), F.lit("")).alias(c) for k, c in meta.items()], F.posexplode(blocks).alias("idx", "_b"))
    head = F.split_part("_b", F.lit("\n"), F.lit(1))
    level = F.when(head.startswith(">ms1"), 1).otherwise(2)
    peaks = F.array_join(F.filter(F.transform(F.split(F.substring("_b", F.length(head) + 2, F.length("_b")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    out = one.select("stem", F.concat_ws("_", "stem", "idx").alias("dset_spec_id"), level.alias("level"), F.nullif(F.regexp_extract(head, r"^>collision (.*)$", 1), F.lit("")).alias("col_energy"), peaks.alias("peaks"), *meta.values())
    return out.where("level = 2").drop("level")


def ms_library(spark: SparkSession, path: str, meta_tsv: str) -> DataFrame:
    """``ms_files`` with adduct, formula and SMILES of a tab-separated table by file stem."""
    meta = spark.read.csv(meta_tsv, sep="\t", header=True).select(F.col("spec").alias("stem"), F.col("ionization").alias("prec_type"), "formula", "smiles")
    return ms_files(spark, path).join(meta, "stem").withColumn("ion_mode", F.lit("P")).withColumn("spec_type", F.lit("MS2")).drop("stem")


def sirius(spark: SparkSession, path: str) -> DataFrame:
    """Files of a metadata block and ``>header`` peak blocks: ``file, meta, header, peaks`` for each block that has peaks."""
    df = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^([^.]*)", 1).alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    groups = F.regexp_extract_all("value", F.lit(r"(?:(?<=\n)|^)((?:[>#][^\n]*\n)+(?:[^>#\n][^\n]*\n?|\n)*)"), F.lit(1))
    df = df.withColumn("_g", groups)
    keys = F.transform(F.filter(F.split(F.col("_g")[0], "\n"), lambda x: F.regexp_like(x, F.lit(r"^[>#]\S+ "))), lambda x: pair(F.substring(x, 2, 1_000_000), " "))
    blocks = df.withColumn("meta", entries(keys)).select("file", "meta", F.explode(F.slice("_g", 2, 1_000_000)).alias("b"))
    rows = F.filter(F.split("b", "\n"), lambda x: F.regexp_like(x, F.lit(r"^\s*\d")))
    peaks = F.transform(rows, lambda x: F.struct(F.split(F.trim(x), r"\s+")[0].cast("double").alias("mz"), F.split(F.trim(x), r"\s+")[1].cast("double").alias("ints")))
    return blocks.select("file", "meta", F.regexp_extract("b", r"^[>#]([^\n]*)", 1).alias("header"), peaks.alias("peaks")).where(F.size("peaks") > 0)


def unzipped(spark: SparkSession, path: str) -> DataFrame:
    """``library, member, value``: text of the members of zip files, one row each (small ones: a record a member)."""

    def members(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.namelist():
                        yield pd.DataFrame({"library": [name.rsplit("/", 1)[-1].removesuffix(".zip")], "member": [m], "value": [z.read(m).decode()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "library string, member string, value string")


def unzipped_lines(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``member, n, value``: the numbered lines of zip members with a suffix, streamed out of the archive."""

    def members(batches):
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.namelist():
                        if not m.endswith(suffix):
                            continue
                        with io.TextIOWrapper(z.open(m), encoding="utf-8") as text:
                            numbers = enumerate(text)
                            while part := list(islice(numbers, 10_000)):
                                yield pd.DataFrame({"member": m, "n": [i for i, _ in part], "value": [x.rstrip("\r\n") for _, x in part]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "member string, n bigint, value string")


def pcdl(spark: SparkSession, path: str) -> DataFrame:
    """Zipped records of prefixed lines; of one compound, adduct and energy the record with most peaks."""
    df = unzipped(spark, path).withColumn("_l", F.split(F.regexp_replace("value", "\r", ""), "\n"))
    value = lambda prefix: F.try_element_at(F.transform(F.filter("_l", lambda x: x.startswith(prefix)), lambda x: F.trim(F.substring(x, len(prefix) + 1, F.length(x)))), F.lit(-1))
    rows = F.transform(F.filter("_l", lambda x: x.startswith(" ") & (F.trim(x) != "")), lambda x: F.array_join(F.slice(F.split(F.trim(x), r"\s+"), 1, 2), " "))
    out = df.select("library", *[value(p).alias(c) for p, c in PCDL_COLUMNS.items()], F.array_join(rows, "\n").alias("peaks"))
    out = out.withColumns({"dset_spec_id": F.concat_ws("_", "library", "dset_spec_id"), "col_energy": F.concat("col_energy", F.lit(" eV")), "num_peaks": F.col("num_peaks").cast("int"), "smiles": F.split_part("smiles", F.lit(" "), F.lit(1)), "ion_mode": F.when(F.col("ion_mode") == "POSITIVE", "P").when(F.col("ion_mode") == "NEGATIVE", "N").otherwise(F.col("ion_mode"))})
    from pyspark.sql import Window as W

    by = W.partitionBy("inchikey", "prec_type", "col_energy").orderBy(F.desc("num_peaks"), "dset_spec_id")
    kept = out.where(F.col("prec_type").isin("[M+H]+", "[M-H]-")).withColumn("_r", F.row_number().over(by)).where("_r = 1")
    return kept.drop("_r", "library").withColumn("frag_mode", F.lit("CID")).withColumn("ion_type", F.lit("ESI"))


def gym_tsv(spark: SparkSession, path: str, subset: str = "all") -> tuple[DataFrame, DataFrame]:
    """Table with lists of m/z and intensity: (spectra, their folds); ``subset``: simulation_challenge, extra or all."""
    from massweave.functions.energy import listed_energy

    df = spark.read.csv(path, sep="\t", header=True)
    flag = F.lower("simulation_challenge") == "true"
    if subset not in ("simulation_challenge", "extra", "all"):
        raise ValueError(f"unknown subset {subset}")
    df = df if subset == "all" else df.where(flag if subset == "simulation_challenge" else ~flag)
    text = F.array_join(F.transform(F.arrays_zip(F.split("mzs", ",").alias("a"), F.split("intensities", ",").alias("b")), lambda p: F.concat_ws(" ", p["a"], p["b"])), "\n")
    rows = df.withColumn("peaks", text).withColumnsRenamed({"identifier": "dset_spec_id", "precursor_mz": "prec_mz", "adduct": "prec_type", "instrument_type": "inst_type", "parent_mass": "exact_mass"})
    rows = rows.withColumn("col_energy", listed_energy(F.col("collision_energy"))["text"])
    return rows.drop("mzs", "intensities", "fold", "collision_energy"), rows.select("dset_spec_id", "fold")


def ei_csv(spark: SparkSession, path: str) -> DataFrame:
    """Electron-ionisation table: integer peak pairs, constant instrument columns."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    pairs = F.regexp_extract_all("peaks", F.lit(r"([0-9]+\s[0-9]+)"), F.lit(1))
    return df.withColumn("peaks", F.array_join(F.transform(pairs, lambda x: F.regexp_replace(x, r"\s", " ")), "\n")).withColumns({c: F.lit(v) for c, v in {"inst_type": "EI", "inst": "EI", "frag_mode": "EI", "col_energy": "100", "spec_type": "EI", "ion_mode": "EI", "prec_type": "EI"}.items()})


def sdf(spark: SparkSession, path: str) -> DataFrame:
    """Compound records: five tags each."""
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("value", rf"> <{t}>\s*\n([^\n]*)", 1)), F.lit(""))
    df = records(spark, path, COMPOUND).select(*[tag(t).alias(c) for t, c in SDF_TAGS.items()])
    return df.withColumn("cid", F.col("cid").cast("bigint")).withColumn("exact_mass", F.col("exact_mass").cast("double"))


def fragment_predictions(spark: SparkSession, path: str, merge: bool = False) -> DataFrame:
    """Prediction files: ``file, smi, mass, inten, energy`` of each fragment, or its maxima over energies."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "\r", "").alias("v"))
    df = df.select("file", F.split_part("v", F.lit("\n\n"), F.lit(1)).alias("s"), F.split_part("v", F.lit("\n\n"), F.lit(2)).alias("k"))
    keys = df.select("file", F.explode(lines(F.col("k"))).alias("r")).select("file", F.split("r", " ")[0].alias("num"), F.split("r", " ")[1].cast("double").alias("mass"), F.split("r", " ")[2].alias("smi"))
    blocks = df.select("file", F.explode(F.regexp_extract_all("s", F.lit(r"(energy\d+\n(?:[^e#\n][^\n]*\n?)+)"), F.lit(1))).alias("b"))
    rows = blocks.select("file", F.split_part("b", F.lit("\n"), F.lit(1)).alias("energy"), F.explode(F.slice(lines(F.col("b")), 2, 1_000_000)).alias("r"))
    rest = F.regexp_extract("r", r"^\S+ \S+ (.*) \((.*)\)$", 1)
    amounts = F.regexp_extract("r", r"^\S+ \S+ (.*) \((.*)\)$", 2)
    each = rows.select("file", "energy", F.explode(F.arrays_zip(F.split(rest, " ").alias("num"), F.split(amounts, " ").alias("inten"))).alias("p")).select("file", "energy", "p.num", F.col("p.inten").cast("double").alias("inten"))
    out = each.join(keys, ["file", "num"]).select("file", "smi", "mass", "inten", "energy")
    return out.groupBy("file", "smi").agg(F.max("mass").alias("mass"), F.max("inten").alias("inten"), F.max("energy").alias("energy")) if merge else out


def candidate_map(spark: SparkSession, path: str) -> DataFrame:
    """``target, candidate`` from a JSON map of lists; also inside ``.tar.gz``. A task reads a map and hands on one row for each target."""
    packed = path.endswith((".tar.gz", ".tgz"))

    def maps(content: bytes):
        if not packed:
            yield json.loads(content)
            return
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t:
                if m.name.endswith(".json"):
                    yield json.load(t.extractfile(m))

    def inside(batches):
        for batch in batches:
            for content in batch["content"]:
                for one in maps(content):
                    entries_ = iter(one.items())
                    while part := list(islice(entries_, 1000)):
                        yield pd.DataFrame({"target": [k for k, _ in part], "c": [list(v) for _, v in part]})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(inside, "target string, c array<string>")
    return rows.select("target", F.explode("c").alias("candidate"))


def smiles_list(spark: SparkSession, path: str, column: str = "smiles") -> DataFrame:
    """Sorted distinct SMILES of a list (.smi, .txt), a table (.csv, .tsv, gzipped too) or a candidate map (.json)."""
    stem = path.removesuffix(".gz")
    if stem.endswith((".csv", ".tsv")):
        df = spark.read.csv(path, header=True, sep="\t" if stem.endswith(".tsv") else ",").select(F.col(column).alias("smiles"))
    elif stem.endswith(".json"):
        df = candidate_map(spark, path)
        df = df.select(F.col("target").alias("smiles")).unionByName(df.select(F.col("candidate").alias("smiles")))
    else:
        df = spark.read.text(path).select(F.split_part(F.trim("value"), F.lit(" "), F.lit(1)).alias("smiles"))
    return df.where("smiles <> ''").distinct().orderBy("smiles")


def datasets(spark: SparkSession, folder: str, names: list[str], n: int | None = None, seed: int = 420) -> DataFrame:
    """Unified tables ``<name>_df.csv`` as text, tagged, at most n rows of each by a seeded order."""
    out = None
    for name in names:
        one = spark.read.csv(f"{folder}/{name}_df.csv", header=True, multiLine=True, escape='"').withColumn("dset", F.lit(name))
        one = one.orderBy(hash_order(seed, "spec_id")).limit(n) if n is not None else one
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """The one table inside a zip (exactly one TSV expected), or a plain TSV."""
    if not path.endswith(".zip"):
        return spark.read.csv(path, sep="\t", header=True)
    df = unzipped_lines(spark, path, ".tsv")
    heads = df.where("n = 0").limit(2).collect()
    if len(heads) != 1:
        raise ValueError(f"expected one TSV in {path}, found {[r['member'] for r in heads] or 'none'}")
    row = df.where("n > 0 and value <> ''")
    return row.select(*[F.split("value", "\t")[i].alias(c) for i, c in enumerate(heads[0]["value"].split("\t"))])


def results(spark: SparkSession, pattern: str) -> DataFrame:
    """Result files; model, split and seed from ``.../model=../split=../seed=..`` or ``.../<model>/<split>/<seed>/`` paths; missing files are skipped."""
    df = spark.read.option("ignoreMissingFiles", "true").parquet(pattern)
    path = F.col("_metadata.file_path")
    part = lambda k, back: F.coalesce(F.nullif(F.regexp_extract(path, rf"{k}=([^/]+)/", 1), F.lit("")), F.element_at(F.split(path, "/"), -back))
    return df.withColumns({c: part(c, b) for c, b in (("model", 4), ("split", 3), ("seed", 2)) if c not in df.columns})


def unified(df: DataFrame, columns: tuple[str, ...] = RAW_COLUMNS) -> DataFrame:
    """The standard columns as text; missing ones null, others dropped."""
    return df.select(*[(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])
