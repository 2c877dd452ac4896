"""Writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A unified table as csv, json or parquet."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format {kind}")
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True, escape='"') if kind == "csv" else getattr(writer, kind)(path)


def tables(parts: dict[str, DataFrame], folder: str) -> None:
    """The standardised tables and their audits, one folder each."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def splits(df: DataFrame, folder: str, meta: dict) -> None:
    """Ids by fold and split as CSV, with a row of run metadata beside them."""
    df.select("spec_id", "mol_id", "group_id", "split", *(["fold"] if "fold" in df.columns else [])).write.mode("overwrite").partitionBy(*(["fold", "split"] if "fold" in df.columns else ["split"])).csv(f"{folder}/ids", header=True)
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def by_group(df: DataFrame, folder: str, key: str = "target_mol_id") -> None:
    df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(folder)


def clustered(df: DataFrame, path: str, key: str, files: int) -> None:
    """Rows by range of ``key`` in about ``files`` files, and a table of each file's range: for very many targets, in place of a folder each.

    A target that holds many rows goes on over several files, which are as even as the range sample. A null key comes first.
    """
    spread = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
    df.withColumn("_spread", spread).repartitionByRange(files, key, "_spread").sortWithinPartitions(key).drop("_spread").write.mode("overwrite").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    file = F.col("_metadata.file_path").alias("file")
    ranges = rows.select(file, key).groupBy("file").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows"), F.bool_or(F.col(key).isNull()).alias("nulls"))
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def of_target(spark: SparkSession, path: str, key: str, target) -> DataFrame:
    """The rows of one target from the files whose range holds it: one, or two where ranges meet, or as many as a large target fills."""
    held = F.col("nulls") if target is None else F.lit(target).between(F.col("first"), F.col("last"))
    names = [r["file"] for r in spark.read.parquet(f"{path}/ranges").where(held).select("file").collect()]
    whole = spark.read.parquet(f"{path}/rows")
    found = spark.read.schema(whole.schema).parquet(*names) if names else whole.limit(0)
    return found.where(F.col(key).isNull() if target is None else F.col(key) == F.lit(target))


def fold_lists(df: DataFrame, folder: str, folds: list[str], key: str = "spec_id") -> None:
    """One list of ids for each value of each fold column."""
    long = df.unpivot(key, folds, "fold_type", "fold")
    long.write.mode("overwrite").partitionBy("fold_type", "fold").csv(folder, header=True)


def mgf_text(meta: list[str], peaks: str = "peaks", mass: tuple[str, ...] = ("PEPMASS", "parentmass", "PRECURSOR_MZ", "prec_mz")) -> Column:
    """A row as an MGF record; the mass is the first of the named columns among ``meta``, peaks are sorted by m/z."""
    first = next((c for c in mass if c in meta), None)
    head = [F.lit("BEGIN IONS")] + ([F.concat(F.lit("PEPMASS="), F.col(first).cast("string"))] if first else [])
    keys = [F.concat(F.lit(f"{c.upper().replace(' ', '_')}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in meta]
    rows = F.array_join(F.transform(F.array_sort(peaks), lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["ints"].cast("string"))), "\n")
    return F.concat_ws("\n", *head, *keys, F.nullif(rows, F.lit("")), F.lit("END IONS"))


def mgf(df: DataFrame, path: str, meta: list[str]) -> None:
    df.select(F.concat(mgf_text(meta), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def mean_std(mean: str, std: str, digits: int = 4) -> Column:
    """``mean ± std``; ``-`` for a missing mean, the mean alone without a deviation."""
    number = lambda c: F.format_string(f"%.{digits}f", c)
    return F.when(F.col(mean).isNull(), "-").when(F.col(std).isNull(), number(mean)).otherwise(F.concat(number(mean), F.lit(" ± "), number(std)))


def report(df: DataFrame, row: str, column: str, mean: str, std: str, values: list[str]) -> DataFrame:
    return df.withColumn("_t", mean_std(mean, std)).groupBy(row).pivot(column, values).agg(F.first("_t")).fillna("-")


def append_new(df: DataFrame, stored: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key the stored table doesn't have (once each)."""
    df.dropDuplicates([key]).join(stored.select(key), key, "left_anti").write.mode("append").parquet(path)


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose output doesn't exist yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def ranking_only(df: DataFrame, heavy: tuple[str, ...] = ("pred_mzs", "pred_ints")) -> DataFrame:
    return df.drop(*heavy)


def predictions(df: DataFrame, path: str, chunk: int | None = None, columns: list[str] | None = None) -> None:
    """Appends a chunk of prediction rows (a subset of columns if named); ragged values are arrays, which need no offsets.

    A numbered chunk has a folder of its own, which a repeated attempt writes anew.
    """
    rows = df.select(*columns) if columns is not None else df
    if chunk is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path}/chunk={chunk}")


#: Columns of every prediction table, those asked for by an option, and the score families that need no bins.
BASE_COLUMNS = (
    "spec_id", "mol_id", "pred_mzs", "pred_ints", "pred_oos_prob", "frag_formula_peak_idxs", "frag_formula_peak_mzs", "pred_formula_formula_idxs", "pred_formula_probs", "pred_joint_formula_idxs",
    "pred_formula_node_probs", "pred_joint_node_idxs", "pred_node_formula_probs", "pred_node_probs", "pred_node_node_idxs", "index_rebased",
)
OPTIONAL_COLUMNS = {"formula_str": "pred_formula_strs", "cc_hash": "pred_node_ccs"}


def score_columns(scores: list[str], resolutions: list[float], bin_sqrt: bool = False, matched_sqrt: bool = False) -> list[str]:
    """Column names of the scores: a matched one (``_hun``) once, a binned one for each resolution, with variants over roots."""
    out: list[str] = []
    for score in scores:
        matched = "_hun" in score
        forms = [score, *([f"{score}_sqrt"] if (matched_sqrt if matched else bin_sqrt) else [])]
        out += forms if matched else [f"{form}_{res}" for res in resolutions for form in forms]
    return out


def tabular(df: DataFrame, scores: list[str], options: tuple[str, ...] = (), subset: list[str] | None = None) -> DataFrame:
    """The prediction columns in order, with those of the options and the scores; of a subset those that exist."""
    names = [*BASE_COLUMNS, *(OPTIONAL_COLUMNS[o] for o in options), *scores]
    return df.select(*[c for c in names if c in df.columns and (subset is None or c in subset)])
