"""Chemical formulas as element maps, their masses, and adducts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Mass of the most common isotope.
MASSES = {
    "H": 1.00782503223, "B": 11.00930536, "C": 12.0, "N": 14.00307400443, "O": 15.99491461957, "F": 18.99840316273, "Na": 22.989769282,
    "Si": 27.97692653465, "P": 30.97376199842, "S": 31.9720711744, "Cl": 34.968852682, "K": 38.9637064864, "Se": 79.9165218, "Br": 78.9183376, "I": 126.9044719,
}
ELECTRON, NEUTRON, SPACING = 0.00054858, 1.008665, 1.003355

#: Elements that an adduct adds to the molecule and the electrons it takes away, kept with the values in use (some are odd).
ADDUCTS: dict[str, tuple[dict[str, int], int]] = {
    "[M+H]+": ({"H": 1}, 1), "[M+Na]+": ({"Na": 1}, 1), "[M+H+2i]+": ({"H": 1, "I": 2}, 1), "[M+K]+": ({"K": 1}, 1),
    "[M+NH4]+": ({"N": 1, "H": 4}, 1), "[M-H2O+H]+": ({"H": -1, "O": -1}, 1), "[M-2H2O+H]+": ({"H": -3, "O": -2}, 1),
    "[M+H-NH3]+": ({"H": -2, "N": 1}, 1), "[M]+": ({}, 1), "": ({}, 0),
    "[M-H]-": ({"H": -1}, -1), "[M-H-CO2]-": ({"H": -1}, -1), "[M+Cl]-": ({"Cl": 1}, -1), "[M-H-H2O]-": ({"H": -3, "O": -1}, -1),
    "[M-H+2i]-": ({"H": -1, "I": 2}, -1), "[M+HCOOH-H]-": ({"C": 1, "H": 1, "O": 2}, -1), "[M+CH3COOH-H]-": ({"C": 2, "H": 4, "O": 2}, -1),
    "[M+CH3COO]-": ({"C": 2, "H": 4, "O": 2}, -1), "[M+H]+_NL": ({"H": -1}, -1), "[M-H]-_NL": ({"H": 1}, 1),
}
#: Adducts for which a missing precursor m/z is inferred.
INFERRED: dict[str, tuple[dict[str, int], int]] = {
    "[M+HCOO]-": ({"H": 1, "C": 1, "O": 2}, -1), "[M]+": ({}, 1), "[M+HOO]-": ({"H": 1, "O": 2}, -1), "[M-OH]+": ({"H": -1, "O": -1}, 1),
    "[M+H-C12H20O9]+": ({"H": -19, "C": -12, "O": -9}, 1), "[M-H]-": ({"H": -1}, -1), "[M+H]+": ({"H": 1}, 1), "[M+Na]+": ({"Na": 1}, 1),
}


def shift(elements: dict[str, int], electrons: int) -> float:
    return sum(MASSES[e] * n for e, n in elements.items()) - electrons * ELECTRON


def adduct_table(spark: SparkSession) -> DataFrame:
    """``prec_type, mz_shift, migrated_shift``: the adduct's mass shift, and that of a fragment whose charge moved to a proton (20 rows)."""
    moved = lambda p: shift({"H": 1}, 1) if p.endswith("+") else shift({"H": -1}, -1)
    rows = [(p, shift(*a), None if p in ("", "[M]+") or p.endswith("_NL") else moved(p)) for p, a in ADDUCTS.items()]
    return spark.createDataFrame(rows, "prec_type string, mz_shift double, migrated_shift double")


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def cut(formula: Column) -> Column:
    """A formula without what follows its first sign."""
    return F.regexp_extract(formula, r"^([^+-]*)", 1)


ATOM = r"([A-Z][a-z]?)(\d*)"


def elements_of(formula: Column) -> Column:
    """Element map; null for a text that isn't a formula. A later count of one element adds to the earlier."""
    text = cut(formula)
    atoms = F.regexp_extract_all(text, F.lit(ATOM), F.lit(0))
    name = lambda a: F.regexp_extract(a, ATOM, 1)
    count = lambda a: F.coalesce(F.nullif(F.regexp_extract(a, ATOM, 2), F.lit("")).cast("int"), F.lit(1))
    unique = F.array_distinct(F.transform(atoms, lambda a: name(a)))
    total = lambda e: F.aggregate(F.filter(atoms, lambda a: name(a) == e), F.lit(0), lambda s, a: s + count(a))
    valid = F.regexp_like(text, F.lit(r"^([A-Z][a-z]?\d*)*$"))
    return F.when(valid, F.map_from_arrays(unique, F.transform(unique, lambda e: total(e))))


def parsed_elements(formula: Column) -> Column:
    """``elements_of``; a text that isn't a formula is an error."""
    e = elements_of(formula)
    return F.when(formula.isNotNull() & e.isNull(), F.raise_error(F.concat(F.lit("not a formula: "), formula)).cast("map<string,int>")).otherwise(e)


def mass_of(elements: Column) -> Column:
    """Mass of an element map; an unknown element makes it null."""
    masses = literal_map(MASSES)
    return F.aggregate(F.map_entries(elements), F.lit(0.0), lambda s, e: s + e["value"] * F.element_at(masses, e["key"]))


def alphabetic(elements: Column) -> Column:
    """``C2H6O1``: elements by name, each with its count."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(elements)), lambda e: F.concat(e["key"], e["value"].cast("string"))), "")


def hill(elements: Column) -> Column:
    """Carbon, hydrogen, then the rest by name; a count of one is left out, a zero count too."""
    ranked = F.transform(F.filter(F.map_entries(elements), lambda e: e["value"] != 0), lambda e: F.struct(F.when(e["key"] == "C", 0).when(e["key"] == "H", 1).otherwise(2).alias("r"), e["key"].alias("k"), e["value"].alias("v")))
    return F.array_join(F.transform(F.array_sort(ranked), lambda e: F.concat(e["k"], F.when(e["v"] == 1, "").otherwise(e["v"].cast("string")))), "")


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Sum (or difference) of two element maps, without zero counts."""
    return F.map_filter(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + sign * F.coalesce(y, F.lit(0))), lambda _, n: n != 0)


def count_of(elements: Column, e: str) -> Column:
    return F.coalesce(F.try_element_at(elements, F.lit(e)), F.lit(0))


def unsaturation(elements: Column) -> Column:
    """Rings and double bonds; a possible formula has none below zero."""
    n = {e: count_of(elements, e) for e in ("C", "H", "N", "P", "Cl", "Br", "I", "F")}
    return 1 + 0.5 * (2 * n["C"] - n["H"] + n["N"] + n["P"] - n["Cl"] - n["Br"] - n["I"] - n["F"])


def dense(elements: Column, order: list[str]) -> Column:
    return F.array(*[count_of(elements, e) for e in order])


def only_elements(formula: Column, allowed: list[str]) -> Column:
    """Whether every element is allowed; a text that isn't a formula is not."""
    return F.coalesce(F.forall(F.map_keys(elements_of(formula)), lambda e: e.isin(*allowed)), F.lit(False))


def inferred_precursor(prec_mz: Column, spec_type: Column, exact_mw: Column, prec_type: Column, dset: Column | None = None) -> Column:
    """A missing precursor m/z of an MS2 spectrum from mass and adduct; in a dataset named after NIST a missing one is an error."""
    known = literal_map({p: shift(*a) for p, a in INFERRED.items()})
    missing = prec_mz.isNull() & (spec_type == "MS2")
    out = F.when(missing, exact_mw + F.element_at(known, prec_type)).otherwise(prec_mz)
    if dset is None:
        return out
    return F.when(missing & F.contains(dset, F.lit("nist")), F.raise_error(F.concat(F.lit("no precursor m/z in "), dset)).cast("double")).otherwise(out)


def subformulas(df: DataFrame, elements: str, order: list[str], most: int = 200_000) -> DataFrame:
    """Each row times its sub-formulas (counts 0..n of each element of ``order``) with no negative unsaturation.

    A formula with more than ``most`` combinations is an error, not cut short.
    """
    combinations = F.lit(1.0)
    for e in order:
        combinations = combinations * (count_of(F.col(elements), e) + 1)
    out = df.withColumn("_n", F.when(combinations > most, F.raise_error(F.lit("too many sub-formulas"))).otherwise(combinations)).where("_n > 0").drop("_n")
    for e in order:
        out = out.withColumn(f"n_{e}", F.explode(F.sequence(F.lit(0), count_of(F.col(elements), e))))
    n = lambda e: F.col(f"n_{e}") if e in order else F.lit(0)
    rings = 1 + 0.5 * (2 * n("C") - n("H") + n("N") + n("P") - n("Cl") - n("Br") - n("I") - n("F"))
    mass = F.lit(0.0)
    for e in order:
        mass = mass + (n(e) * F.lit(MASSES[e]) if e in MASSES else F.when(n(e) == 0, 0.0))
    sub = F.map_filter(F.map_from_arrays(F.array(*[F.lit(e) for e in order]), F.array(*[F.col(f"n_{e}") for e in order])), lambda _, n: n > 0)
    return out.where(rings >= 0).withColumn("sub", sub).withColumn("sub_mass", mass)
