"""Isotope and orphan peaks: flags, co-isolation, clean-up."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.functions.formula import MASSES, NEUTRON, SPACING, count_of, literal_map
from massweave.operators.joins import band_join, beside

#: What an atom adds to the M+1 and M+2 peaks.
M1 = {"C": 0.01103, "H": 0.000149, "N": 0.00368, "O": 0.000404, "S": 0.00421, "Si": 0.04683}
M2 = {"Cl": 0.322, "Br": 0.9735, "K": 0.0673, "S": 0.0425, "Si": 0.0337, "O": 0.00204}
#: Tolerances in Da by instrument; others are not handled (isotopes) or get the last (orphans).
FINE = {"FT": 0.004}
ORPHAN = {"FT": 0.02, "QTOF": 0.05, None: 0.5}
#: Gates of the co-isolation estimate.
MIN_F, MAX_F, RATIO, ENVELOPE, M0_TOL, M0_SHARE = 0.05, 1.5, (0.05, 10.0), (0.2, 5.0), 0.05, 0.005

PEAK = ["spec_id", "peak_idx"]


def spaced(k: int, spacing: float, tol: float, down: bool) -> Column:
    """The peaks of a peak's spectrum in a frame about ``mz -/+ k spacing``, as structs ``peak_idx, mz, ints``.

    The frame is a little wider than ``tol``, so ``within`` still decides. It is a window within the spectrum: what is dealt by spectrum isn't dealt again.
    """
    at, reach = (-k if down else k) * spacing, tol * 1.001
    return F.expr(f"collect_list(struct(peak_idx, mz, ints)) over (partition by spec_id order by cast(mz as double) range between {at - reach!r}D following and {at + reach!r}D following)")


def within(o: Column, k: int, spacing: float, tol: float, down: bool) -> Column:
    """Whether a peak ``o`` is within ``tol`` of ``mz -/+ k spacing``."""
    at = F.col("mz") + k * (-spacing if down else spacing)
    return (o["mz"] >= at - tol) & (o["mz"] <= at + tol)


def flagged(peaks: DataFrame, hits: DataFrame, name: str = "isotope") -> DataFrame:
    """``peaks`` with a flag for those among ``hits``; both stand in one window by peak, so what is dealt by spectrum isn't dealt again."""
    found = hits.select(*[F.col(c).cast(peaks.schema[c].dataType).alias(c) for c in PEAK], F.lit(True).alias(name), F.lit(False).alias("_peak"))
    rows = peaks.withColumns({name: F.lit(False), "_peak": F.lit(True)}).unionByName(found, allowMissingColumns=True)
    return rows.withColumn(name, F.bool_or(name).over(W.partitionBy(*PEAK))).where("_peak").drop("_peak")


def by_spacing(peaks: DataFrame, tol: float = 0.02, orders: int = 3, check: bool = True) -> DataFrame:
    """Flags a peak with one as intense a whole number of neutron masses below it."""
    rows, hit = peaks, F.lit(False)
    for k in range(1, orders + 1):
        rows = rows.withColumn(f"_o_{k}", spaced(k, NEUTRON, tol, down=True))
        as_intense = lambda o: o["ints"] >= F.col("ints") if check else F.lit(True)
        hit = hit | F.coalesce(F.exists(f"_o_{k}", lambda o: within(o, k, NEUTRON, tol, True) & as_intense(o)), F.lit(False))
    return rows.select(*peaks.columns, hit.alias("isotope"))


def by_offsets(peaks: DataFrame, offsets: DataFrame, tol: float = 0.02, check: bool = True, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """Flags by rows ``spec_id, offset, ratio`` of the formula's isotope pattern, with a gate on the intensity ratio."""
    left = peaks.join(offsets, "spec_id").withColumn("at", F.col("mz") - F.col("offset")).where("at >= 0")
    right = peaks.select("spec_id", F.col("mz").alias("o_mz"), F.col("ints").alias("o_ints"))
    near = beside(left, right, "spec_id", "at", "o_mz", F.abs(F.col("o_mz") - F.col("at")) <= tol, tol * 1.001)
    mono = near.groupBy(*PEAK, "mz", "ints", "offset", "ratio").agg(F.max("o_ints").alias("mono"))
    seen = F.col("ints") / F.col("mono")
    ok = (F.col("mono") <= 0) | seen.between(low * F.col("ratio"), high * F.col("ratio"))
    if check:
        ok = ok & ~((F.col("ratio") <= 1) & (F.col("mono") < F.col("ints")))
    return flagged(peaks, mono.where(ok))


def shares(elements: Column) -> tuple[Column, Column]:
    """What a formula's atoms add to M+1 (Poisson part) and, beyond that, to M+2."""
    total = lambda table: sum((count_of(elements, e) * c for e, c in table.items()), F.lit(0.0))
    return total(M1), total(M2)


def expected_ratio(first: Column, second: Column, k: int) -> Column:
    """Expected M+k over M: a Poisson term from M+1 shares, for k = 2 an additive term; never below 1e-4."""
    out = F.pow(first, F.lit(float(k))) / math.factorial(k)
    return F.greatest(out + second if k == 2 else out, F.lit(1e-4))


#: Elements of an adduct's formula as read up to its first minus sign, where negative counts read as positive.
READ = {"[M+H]+": {"H": 1}, "[M+Na]+": {"Na": 1}, "[M+H+2i]+": {"H": 1, "I": 2}, "[M+K]+": {"K": 1}, "[M+NH4]+": {"N": 1, "H": 4}, "[M-H]-": {"H": 1}, "[M-H-CO2]-": {"H": 1}, "[M+Cl]-": {"Cl": 1}, "[M-H-H2O]-": {"H": 1}, "[M-H+2i]-": {"H": 1}, "[M+HCOOH-H]-": {"C": 1, "H": 2, "O": 2}, "[M+CH3COOH-H]-": {"C": 2, "H": 3, "O": 2}, "[M+CH3COO]-": {"C": 2, "H": 3, "O": 2}, "[M-H2O+H]+": {"O": 1}, "[M-2H2O+H]+": {"O": 1}, "[M+H-NH3]+": {"H": 1}}


def of_adduct(prec_type: Column, weights: dict[str, float]) -> Column:
    """Weighted sum of the elements that an adduct adds; 0 for an unknown one."""
    sums = {name: float(sum(n * weights.get(e, 0.0) for e, n in counts.items())) for name, counts in READ.items()}
    return F.coalesce(F.try_element_at(literal_map(sums), prec_type), F.lit(0.0))


def coisolation(spectra: DataFrame, peaks: DataFrame, orders: int = 2) -> DataFrame:
    """``spec_id, f_1, f_2``: co-isolation fractions from the precursor's residual peaks (null where there is none to trust).

    ``spectra`` has ``spec_id, inst_type, prec_mz, prec_type, elements``; instruments without a fine tolerance have no rows.
    """
    tol = F.lit(None).cast("double")
    for inst, t in FINE.items():
        tol = F.when(F.col("inst_type") == inst, t).otherwise(tol)
    s = spectra.withColumn("tol", tol).where("tol is not null and prec_mz > 0 and elements is not null")
    first, second = shares(F.col("elements"))
    added = [of_adduct(F.col("prec_type"), m) for m in (M1, M2)]
    s = s.withColumns({f"r_{k}": expected_ratio(first + added[0], second + added[1], k) for k in range(1, orders + 1)})
    p = peaks.join(s.select("spec_id", "prec_mz", "tol"), "spec_id")
    best = lambda at, t: F.max_by(F.struct("mz", "ints"), F.struct(F.when(F.abs(F.col("mz") - at) <= t, F.col("ints")), -F.col("mz")))
    near = lambda at, t: F.when(F.count_if(F.abs(F.col("mz") - at) <= t) > 0, best(at, t))
    at = lambda k: F.col("prec_mz") + k * SPACING
    wide = lambda k: F.col("tol") * (1 if k == 1 else 2)
    seen = p.groupBy("spec_id").agg(F.max("ints").alias("base"), near(F.col("prec_mz"), F.lit(M0_TOL)).alias("p_0"), *[near(at(k), wide(k)).alias(f"p_{k}") for k in range(1, orders + 1)])
    rows = s.join(seen, "spec_id").where((F.col("p_0.ints") > 0) & ~((F.col("base") > 0) & (F.col("p_0.ints") / F.col("base") < M0_SHARE)))
    for k in range(1, orders + 1):
        f = F.col(f"p_{k}.ints") / F.col("p_0.ints") / F.col(f"r_{k}")
        rows = rows.withColumn(f"f_{k}", F.when((F.col(f"p_{k}.mz") > F.col("prec_mz") + wide(k)) & f.between(MIN_F, MAX_F), f))
    if orders >= 2:
        shape = (F.col("p_2.ints") / F.col("p_1.ints")) / (F.col("r_2") / F.col("r_1"))
        bad = F.col("f_1").isNotNull() & F.col("f_2").isNotNull() & ~(shape.between(*ENVELOPE) & (F.col("f_2") / F.col("f_1")).between(*RATIO))
        bad = F.coalesce(bad, F.lit(False))
        rows = rows.withColumns({f"f_{k}": F.when(~bad, F.col(f"f_{k}")) for k in range(1, orders + 1)})
    return rows.select("spec_id", *[f"f_{k}" for k in range(1, orders + 1)])


def group_fraction(values: DataFrame, by: list[str], x: str, least: int = 2, max_cv: float = 0.6) -> DataFrame:
    """``by, f``: the median of a group's values where there are enough and they agree."""
    g = values.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.percentile(x, 0.5).alias("f"), F.stddev_pop(x).alias("_s"))
    return g.where((F.col("n") >= least) & (F.col("f") > 0) & (F.col("_s") / F.col("f") <= max_cv)).drop("_s")


def envelopes(spectra: DataFrame, peaks: DataFrame, orders: int = 2) -> DataFrame:
    """Peaks with ``near``: for each order k the strongest one k spacings above (``k, o_idx, o_ints``), with the expected ratio at the fragment's share of the mass."""
    s = spectra.where(F.col("inst_type").isin(*FINE) & F.col("elements").isNotNull()).withColumn("delta", of_adduct(F.col("prec_type"), MASSES))
    first, second = shares(F.col("elements"))
    s = s.withColumns({"whole": F.col("prec_mz") - F.col("delta"), "m1": first, "m2": second, "a1": of_adduct(F.col("prec_type"), M1), "a2": of_adduct(F.col("prec_type"), M2)}).where("whole > 0")
    tol, rows = FINE["FT"], peaks.select(*PEAK, "mz", "ints")
    for k in range(1, orders + 1):
        # The first order is held to the tolerance from both sides of its place, the others to twice that.
        close = lambda o: within(o, k, SPACING, 2 * tol, False) & (F.abs(o["mz"] - (F.col("mz") + k * SPACING)) <= tol if k == 1 else F.lit(True))
        best = F.array_max(F.transform(F.filter(f"_o_{k}", close), lambda o: F.struct(o["ints"].alias("o_ints"), -o["mz"], (-o["peak_idx"]).alias("o_idx"))))
        rows = rows.withColumn(f"_o_{k}", spaced(k, SPACING, 2 * tol, down=False)).withColumn(f"_o_{k}", best)
    rows = rows.where(F.coalesce(*[f"_o_{k}.o_idx" for k in range(1, orders + 1)]).isNotNull()).join(s.select("spec_id", "delta", "whole", "m1", "m2", "a1", "a2"), "spec_id")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("mz") - F.col("delta")) / F.col("whole")))
    one_, two = (lambda scale: F.col("m1") * scale + F.col("a1")), (lambda scale: F.col("m2") * scale + F.col("a2"))
    ratio = lambda k, scale: expected_ratio(one_(scale), two(scale), min(k, 2))
    each = [F.struct(F.lit(k).alias("k"), (-F.col(f"_o_{k}.o_idx")).alias("o_idx"), F.col(f"_o_{k}.o_ints").alias("o_ints"), ratio(k, share).alias("r_frag"), ratio(k, F.lit(1.0)).alias("r_prec")) for k in range(1, orders + 1)]
    return rows.select(*PEAK, "mz", "ints", F.filter(F.array(*each), lambda x: x["o_idx"].isNotNull()).alias("near"))


def envelope_pairs(spectra: DataFrame, peaks: DataFrame, orders: int = 2) -> DataFrame:
    """Pairs of a peak and the strongest one k spacings above it, with the expected ratio at the fragment's share of the mass."""
    return envelopes(spectra, peaks, orders).select(*PEAK, "mz", "ints", F.explode("near").alias("x")).select(*PEAK, "mz", "ints", "x.*")


def consensus(pairs: DataFrame, least: int = 2, max_cv: float = 0.6) -> DataFrame:
    """``spec_id, k, f``: the fraction on which pairs within a spectrum agree; a single pair counts from MIN_F on."""
    seen = F.col("o_ints") / F.col("ints")
    denom = F.when(F.col("k") == 1, F.col("r_frag") - seen * (F.col("r_prec") - F.col("r_frag"))).otherwise(F.col("r_frag"))
    rows = pairs.where((F.col("ints") > 0) & (F.col("o_ints") < F.col("ints"))).withColumn("f", F.when(denom > 0, seen / denom)).where("f is not null")
    g = rows.groupBy("spec_id", "k").agg(F.count("*").alias("n"), F.percentile("f", 0.5).alias("f"), F.stddev_pop("f").alias("_s"))
    agreed = (F.col("n") >= least) & (F.col("_s") / F.col("f") <= max_cv) & (F.col("f") >= MIN_F)
    single = (F.col("n") == 1) & (F.col("f") >= MIN_F)
    return g.where((F.col("f") > 0) & (agreed | single)).select("spec_id", "k", "f")


def leaks(spectra: DataFrame, peaks: DataFrame, fractions: DataFrame) -> DataFrame:
    """``spec_id, peak_idx`` of the peaks that co-isolation explains: below their M peak, in proportion to the expected ratio; M+2 only after its M+1."""
    of = fractions.groupBy("spec_id").agg(F.collect_list(F.struct("k", "f")).alias("_f"))
    ints = F.col("ints")

    def good(x: Column, y: Column) -> Column:
        want = F.when(x["k"] == 1, y["f"] * x["r_frag"] / (1 + y["f"] * (x["r_prec"] - x["r_frag"]))).otherwise(y["f"] * x["r_frag"])
        return (x["k"] == y["k"]) & (x["o_ints"] < ints) & (x["o_ints"] / ints).between(RATIO[0] * want, RATIO[1] * want)

    rows = envelopes(spectra, peaks).join(of, "spec_id")
    rows = rows.select("spec_id", F.filter("near", lambda x: F.exists("_f", lambda y: good(x, y))).alias("_x")).where(F.exists("_x", lambda x: x["k"] == 1))
    return rows.select("spec_id", F.explode("_x.o_idx").alias("peak_idx"))


def leak_peaks(spectra: DataFrame, peaks: DataFrame, fractions: DataFrame) -> DataFrame:
    """Flags the peaks among ``leaks``."""
    return flagged(peaks, leaks(spectra, peaks, fractions))


def cleaned(peaks: DataFrame, flags: list[DataFrame], name: str = "isotope") -> DataFrame:
    """Peaks without any flag, in ``flags`` or of their own; a spectrum that would lose all keeps all."""
    own, out = name in peaks.columns, peaks
    for i, f in enumerate(flags):
        hits = f.where(name).select(*PEAK) if i == 0 else hits.unionByName(f.where(name).select(*PEAK))
    out = flagged(peaks, hits, "_drop") if flags else peaks.withColumn("_drop", F.lit(False))
    out = out.withColumn("_drop", F.col("_drop") | F.coalesce(name, F.lit(False))) if own else out
    out = out.withColumn("_left", F.count_if(~F.col("_drop")).over(W.partitionBy("spec_id")))
    return out.where("_left = 0 or not _drop").drop("_drop", "_left")


def orphans(spectra: DataFrame, peaks: DataFrame, group: str = "group_id", others: int = 1) -> DataFrame:
    """Flags peaks that fewer than ``others`` other spectra of the group share; a group of one spectrum has none."""
    tol = F.lit(ORPHAN[None])
    for inst, t in ORPHAN.items():
        if inst:
            tol = F.when(F.col("inst_type") == inst, t).otherwise(tol)
    rows = peaks.join(spectra.select("spec_id", group, tol.alias("tol")), "spec_id")
    right = rows.select(group, F.col("spec_id").alias("o_spec"), F.col("mz").alias("o_mz"))
    near = band_join(rows, right, [group], "mz", "o_mz", (F.col("spec_id") != F.col("o_spec")) & (F.col("o_mz") >= F.col("mz") - F.col("tol")) & (F.col("o_mz") <= F.col("mz") + F.col("tol")), ORPHAN[None])
    shared = near.groupBy(*PEAK).agg(F.countDistinct("o_spec").alias("_n")).where(F.col("_n") >= others).select(*PEAK).withColumn("_seen", F.lit(True))
    sizes = spectra.join(peaks.select("spec_id").distinct(), "spec_id", "left_semi").groupBy(group).agg(F.count("*").alias("_size"))
    out = rows.join(shared, PEAK, "left").join(sizes, group)
    return out.select(*peaks.columns, (F.col("_seen").isNull() & (F.col("_size") > 1)).alias("orphan"))
