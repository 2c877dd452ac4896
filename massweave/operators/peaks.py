"""Peak operators on the long table ``spec_id, peak_idx, mz, ints``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.operators.aggregates import TINY


def spectrum():
    """The window of a spectrum's peaks."""
    return W.partitionBy("spec_id")


def kept(peaks: DataFrame, least: float = 0.0, mz_max: float = 0.0) -> DataFrame:
    """Peaks above an intensity and (if positive) below an m/z, both strictly."""
    out = peaks.where(F.col("ints") > least)
    return out.where(F.col("mz") < mz_max) if mz_max > 0 else out


def top(peaks: DataFrame, k: int, drop_least: bool = False) -> DataFrame:
    """The k most intense of each spectrum, after its single weakest went (if it has more than one); k below 0: all."""
    if k == 0:
        raise ValueError("k = 0 would keep no peak")
    ranked = peaks.withColumn("_r", F.row_number().over(spectrum().orderBy(F.col("ints").desc(), "mz", "peak_idx")))
    if drop_least:
        ranked = ranked.withColumn("_n", F.count("*").over(spectrum())).where("_n = 1 or _r < _n").drop("_n")
    return (ranked.where(F.col("_r") <= k) if k > 0 else ranked).drop("_r")


def top_above(peaks: DataFrame, k: int | None = 60, least: float = 0.0) -> DataFrame:
    """The k most intense peaks of each spectrum (all without a k), and of these the ones above ``least``."""
    return kept(top(peaks, k) if k is not None else peaks, least)


def fused(peaks: DataFrame, spectra: DataFrame, decimals: int = 4) -> DataFrame:
    """Peaks of all energies of a spectrum as one: the largest intensity of each rounded m/z at the first such m/z, none beyond the parent mass plus 1, as roots of shares of the largest.

    A spectrum without a parent mass keeps all its peaks; one that none is left of goes.
    """
    bound = spectra.select("spec_id", (F.coalesce("prec_mz", F.lit(1_000_000.0)) + 1).alias("_most"))
    one = peaks.groupBy("spec_id", F.bround("mz", decimals).alias("_r")).agg(F.min_by("mz", "peak_idx").alias("mz"), F.max("ints").alias("ints"))
    one = one.join(bound, "spec_id").where(F.col("mz") <= F.col("_most"))
    return one.select("spec_id", "mz", F.sqrt(F.col("ints") / F.max("ints").over(spectrum())).alias("ints"))


def l1(ints: Column, window=None) -> Column:
    return ints / F.greatest(F.sum(ints).over(window or spectrum()), F.lit(TINY))


def l2(ints: Column, window=None) -> Column:
    return ints / F.greatest(F.sqrt(F.sum(ints * ints).over(window or spectrum())), F.lit(TINY))


def max_scaled(ints: Column, to: float = 1000.0, window=None) -> Column:
    return ints / F.max(ints).over(window or spectrum()) * to


def with_log_weights(peaks: DataFrame, x: str, window=None) -> DataFrame:
    """``soft, log_soft, log_l2``: softmax of a column of logs over each spectrum, its log, and the logs normalised by L2; no window stands inside another."""
    w = window or spectrum()
    rows = peaks.withColumn("_m", F.max(x).over(w))
    rows = rows.withColumns({"_s": F.sum(F.exp(F.col(x) - F.col("_m"))).over(w), "_s2": F.sum(F.exp(2 * (F.col(x) - F.col("_m")))).over(w)})
    weights = {"soft": F.exp(F.col(x) - F.col("_m")) / F.col("_s"), "log_soft": F.col(x) - F.col("_m") - F.ln("_s"), "log_l2": F.col(x) - 0.5 * (2 * F.col("_m") + F.ln("_s2"))}
    return rows.withColumns(weights).drop("_m", "_s", "_s2")


def bin_of(mz: Column, res: float) -> Column:
    """Bin i covers [i res, (i + 1) res); rounding before the floor keeps edges alike everywhere."""
    return F.floor(F.round(mz / res, 6))


def check_bins(mz_max: float, res: float) -> int:
    n = round(mz_max / res)
    if abs(mz_max / res - n) > 1e-9:
        raise ValueError(f"{mz_max} is no multiple of {res}")
    return n


def aggregated(peaks: DataFrame, key: Column, name: str, agg: str = "sum", by: tuple[str, ...] = ("spec_id",)) -> DataFrame:
    """Intensities by spectrum and key: ``sum, amax`` or ``lse``."""
    keyed = peaks.withColumn(name, key)
    if agg == "lse":
        keyed = keyed.withColumn("_m", F.max("ints").over(W.partitionBy(*by, name)))
        return keyed.groupBy(*by, name).agg((F.max("_m") + F.ln(F.sum(F.exp(F.col("ints") - F.col("_m"))))).alias("ints"))
    return keyed.groupBy(*by, name).agg({"sum": F.sum, "amax": F.max}[agg]("ints").alias("ints"))


def binned(peaks: DataFrame, res: float, agg: str = "sum", centre: bool = False) -> DataFrame:
    out = aggregated(peaks, bin_of(F.col("mz"), res), "bin", agg)
    return out.withColumn("mz", (F.col("bin") + 0.5) * res) if centre else out


def binned_thrice(peaks: DataFrame, res: float) -> DataFrame:
    """``spec_id, bin, ints_sum, ints_max, ints_lse``: all three of ``binned`` from one pass."""
    keyed = peaks.withColumn("bin", bin_of(F.col("mz"), res)).withColumn("_m", F.max("ints").over(W.partitionBy("spec_id", "bin")))
    lse = F.max("_m") + F.ln(F.sum(F.exp(F.col("ints") - F.col("_m"))))
    return keyed.groupBy("spec_id", "bin").agg(F.sum("ints").alias("ints_sum"), F.max("_m").alias("ints_max"), lse.alias("ints_lse"))


def rounded(peaks: DataFrame, decimals: int = 4, agg: str = "sum") -> DataFrame:
    """Peaks merged where their m/z agrees to so many decimals (halves up)."""
    scale = float(10**decimals)
    return aggregated(peaks, F.floor(F.col("mz") * scale + 0.5) / scale, "mz_r", agg).withColumnRenamed("mz_r", "mz")


def without_precursor(peaks: DataFrame, spectra: DataFrame, res: float) -> DataFrame:
    """Peaks outside the precursor's bin; a spectrum without a precursor m/z keeps all."""
    outside = F.coalesce(bin_of(F.col("mz"), res) != bin_of(F.col("prec_mz"), res), F.lit(True))
    return peaks.join(spectra.select("spec_id", "prec_mz"), "spec_id").where(outside).drop("prec_mz")


def merged(peaks: DataFrame, group: str, sum_ints: bool = True, renormalize: bool = False) -> DataFrame:
    """One spectrum for each group: peaks of equal m/z summed (or the largest), as an array sorted by m/z."""
    one = peaks.groupBy(group, "mz").agg((F.sum if sum_ints else F.max)("ints").alias("ints"))
    if renormalize:
        one = one.withColumn("ints", l1(F.col("ints"), W.partitionBy(group)))
    return one.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("mz", "ints"))).alias("peaks"))


def merged_spectra(spectra: DataFrame, peaks: DataFrame, keep_energies: bool = True, **how) -> DataFrame:
    """Spectra of a group as one: merged peaks, the first row's metadata, lists of energies."""
    grouped = peaks.join(spectra.select("spec_id", "group_id"), "spec_id")
    energies = [F.array_sort(F.collect_list(F.struct("spec_id", c))).getField(c).alias(f"{c}s") for c in ("nce", "ace")] if keep_energies else [F.lit(None).cast("array<double>").alias(f"{c}s") for c in ("nce", "ace")]
    rest = [c for c in spectra.columns if c not in ("spec_id", "group_id", "nce", "ace", "ts", "peaks")]
    first = [F.min_by(c, "spec_id").alias(c) for c in rest]
    return spectra.groupBy("group_id").agg(F.count("*").alias("n_spectra"), *first, *energies).join(merged(grouped, "group_id", **how), "group_id")


def to_arrays(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("spec_id").agg(F.sort_array(F.collect_list(F.struct("mz", "ints"))).alias("peaks"))


def to_rows(spectra: DataFrame) -> DataFrame:
    return spectra.select("spec_id", F.posexplode("peaks").alias("peak_idx", "p")).select("spec_id", (F.col("peak_idx") + 1).alias("peak_idx"), "p.mz", "p.ints")


def padded(spectra: DataFrame, n: int) -> DataFrame:
    """Peak arrays of one length: cut after ``n``, or filled with (0, 0); ``n_peaks`` tells how many are real."""
    fill = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.try_element_at("peaks", i), F.struct(F.lit(0.0).alias("mz"), F.lit(0.0).alias("ints"))))
    return spectra.withColumn("n_peaks", F.least(F.size("peaks"), F.lit(n))).withColumn("peaks", fill)


def as_vector(peaks: DataFrame, mz_max: float, res: float, agg: str = "sum") -> DataFrame:
    """Dense bins as an array, for export only: every bin of every spectrum; a spectrum without a peak below ``mz_max`` is all zeros."""
    n = check_bins(mz_max, res)
    bins = F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("int"), "ints")))
    found = binned(peaks.where(F.col("mz") < mz_max), res, agg).groupBy("spec_id").agg(bins.alias("_m"))
    every = peaks.select("spec_id").distinct().join(found, "spec_id", "left")
    return every.select("spec_id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("ints"))
