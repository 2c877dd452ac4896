"""Row filters on spectra, molecules and predictions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massweave.functions.formula import only_elements
from massweave.operators.ordering import hash_order

ENERGY = {
    "ace": lambda: F.col("ace").isNotNull(),
    "nce": lambda: F.col("nce").isNotNull(),
    "nce_or_ace": lambda: F.col("nce").isNotNull() | F.col("ace").isNotNull(),
}
ENERGY_KINDS = ("none", "single", "ramped", "stepped")
MAX_ATOMS, MAX_BONDS = 128, 512


@dataclass
class Criteria:
    """What spectra and molecules must meet; None or empty switches a criterion off."""

    members: dict[str, list[str]] = field(default_factory=dict)
    energy: str | None = None
    energy_kinds: list[str] | None = None
    spec_type: str | None = None
    prec_mz: tuple[float | None, float | None] = (None, None)
    max_peak_mz: float | None = None
    single_mol: bool = True
    charges: tuple[int, ...] | None = (0, 1)
    max_atoms: int | None = MAX_ATOMS
    max_bonds: int | None = MAX_BONDS
    radicals: bool = False
    elements: list[str] | None = None


def spectrum_masks(c: Criteria) -> dict[str, Column]:
    masks = {f"in_{k}": F.col(k).isin(*v) for k, v in c.members.items() if v is not None}
    if c.energy:
        masks["energy"] = ENERGY[c.energy]()
    if c.energy_kinds is not None:
        if bad := set(c.energy_kinds) - set(ENERGY_KINDS):
            raise ValueError(f"unknown energy kinds {sorted(bad)}")
        masks["energy_kind"] = F.col("ce_type").isin(*c.energy_kinds)
    if c.spec_type:
        masks["spec_type"] = F.col("spec_type") == c.spec_type
    low, high = c.prec_mz
    if low is not None or high is not None:
        ok = F.col("prec_mz").isNotNull()
        ok = ok & (F.col("prec_mz") >= low) if low is not None else ok
        masks["prec_mz"] = ok & (F.col("prec_mz") <= high) if high is not None else ok
    if c.max_peak_mz is not None:
        masks["peak_mz"] = F.array_max(F.transform("peaks", lambda p: p["mz"])) <= c.max_peak_mz
    return masks


def molecule_masks(c: Criteria) -> dict[str, Column]:
    masks = {}
    if c.single_mol:
        masks["single_mol"] = F.col("single_mol")
    if c.charges is not None:
        masks["charge"] = F.col("charge").isin(*c.charges)
    if c.max_atoms is not None:
        masks["num_atoms"] = F.col("num_atoms") <= c.max_atoms
    if c.max_bonds is not None:
        masks["num_bonds"] = F.col("num_bonds") <= c.max_bonds
    if not c.radicals:
        masks["radicals"] = F.col("num_radicals") == 0
    if c.elements is not None:
        masks["elements"] = only_elements(F.col("formula"), c.elements)
    return masks


def masked(spectra: DataFrame, molecules: DataFrame, c: Criteria) -> tuple[DataFrame, list[str]]:
    """Spectra with one boolean column for each criterion."""
    mol = molecule_masks(c)
    props = molecules.select("mol_id", F.col("charge").alias("_charge"), *[F.coalesce(m, F.lit(False)).alias(f"ok_{k}") for k, m in mol.items()])
    own = spectrum_masks(c)
    both = spectra.join(props, "mol_id", "left").withColumns({f"ok_{k}": F.coalesce(m, F.lit(False)) for k, m in own.items()} | {f"ok_{k}": F.coalesce(f"ok_{k}", F.lit(False)) for k in mol})
    both = both.withColumn("ok_charged_adduct", (F.coalesce("_charge", F.lit(0)) != 1) | (F.col("prec_type") == "[M]+")).drop("_charge")
    return both, [f"ok_{k}" for k in [*own, *mol, "charged_adduct"]]


def filtered(spectra: DataFrame, molecules: DataFrame, c: Criteria, sample: int | None = None, seed: int = 420) -> tuple[DataFrame, DataFrame]:
    """Spectra that meet all criteria (a seeded sample of them if asked), and the molecules they have."""
    both, names = masked(spectra, molecules, c)
    kept = both.where(reduce(lambda a, b: a & b, [F.col(n) for n in names])).select(*spectra.columns)
    if sample is not None:
        kept = kept.orderBy(hash_order(seed, "spec_id")).limit(sample)
    return kept, molecules.join(kept.select("mol_id").distinct(), "mol_id", "left_semi")


def checked(df: DataFrame) -> DataFrame:
    """``df``, or an error if no row is left."""
    if df.isEmpty():
        raise ValueError("no rows left after filtering")
    return df


def keep_rates(spectra: DataFrame, molecules: DataFrame, c: Criteria) -> DataFrame:
    """One row for each criterion: the share of spectra that meet it, from one pass."""
    both, names = masked(spectra, molecules, c)
    every = reduce(lambda a, b: a & b, [F.col(n) for n in names])
    rates = F.explode(F.array(*[F.struct(F.lit(n.removeprefix("ok_")).alias("criterion"), F.col(n).cast("double").alias("ok")) for n in names], F.struct(F.lit("all").alias("criterion"), every.cast("double").alias("ok"))))
    return both.select(rates.alias("r")).groupBy("r.criterion").agg(F.avg("r.ok").alias("keep_rate"), F.sum("r.ok").cast("bigint").alias("n_kept"))


def energy_in_range(ranges: dict[str, tuple[float, float]], key: str = "nce") -> Column:
    """For rows of a listed instrument: the energy is present and in range, and extra energies are in range where present."""
    out = F.lit(True)
    for inst, (low, high) in ranges.items():
        ok = F.col(key).isNotNull() & F.col(key).between(low, high)
        for extra in (f"{key}_extra_1", f"{key}_extra_2"):
            ok = ok & (F.col(extra).isNull() | F.col(extra).between(low, high))
        out = F.when(F.col("inst_type") == inst, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def split_adducts(df: DataFrame, molecules: DataFrame, allowed: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Of the splits named in ``allowed`` only spectra of their adducts, and the molecules that are still in use; other splits stay whole."""
    keep = F.lit(True)
    for split, adducts in allowed.items():
        keep = F.when(F.col("split") == split, F.coalesce(F.col("prec_type").isin(*adducts), F.lit(False))).otherwise(keep)
    kept = df.where(keep)
    return kept, molecules.join(kept.select("mol_id").distinct(), "mol_id", "left_semi")


def any_energy(energies: str, wanted: list[float]) -> Column:
    return F.arrays_overlap(F.col(energies), F.array(*[F.lit(float(w)) for w in wanted]))


def small_graphs(stats: DataFrame, max_nodes: int = -1, max_edges: int = -1, min_recall: float = 0.0) -> DataFrame:
    out = stats.where(F.col("wt_recall") >= min_recall)
    out = out.where(F.col("num_nodes") <= max_nodes) if max_nodes >= 0 else out
    return out.where(F.col("num_edges") <= max_edges) if max_edges >= 0 else out


def strong_predictions(peaks: DataFrame, joint: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Predicted peaks above ``least``, and the (formula, node) rows of formulas that surviving peaks refer to."""
    strong = peaks.where(F.col("ints") > least)
    formulas = strong.select("spec_id", "formula_idx").distinct()
    return strong, joint.join(formulas, ["spec_id", "formula_idx"], "left_semi")


def is_sound(elements: list[str], max_atoms: int = MAX_ATOMS) -> Column:
    """Neutral, of allowed elements, without radicals, not too large."""
    return (F.col("num_atoms") <= max_atoms) & (F.col("num_radicals") == 0) & (F.col("charge") == 0) & only_elements(F.col("formula"), elements)


def sound_molecules(df: DataFrame, elements: list[str], max_atoms: int = MAX_ATOMS) -> DataFrame:
    """Rows that ``is_sound``; each formula is parsed once, by shuffled tasks, as a table of molecules is often one small file."""
    plain = df.where((F.col("num_atoms") <= max_atoms) & (F.col("num_radicals") == 0) & (F.col("charge") == 0))
    good = plain.select("formula").distinct().where(only_elements(F.col("formula"), elements))
    return plain.join(good, "formula", "left_semi")


def sound_candidates(df: DataFrame, elements: list[str], max_atoms: int = MAX_ATOMS) -> DataFrame:
    """One molecule that is sound."""
    return df.where(~F.contains(F.col("smiles"), F.lit(".")) & is_sound(elements, max_atoms))


def peaks_missing(spectra: DataFrame) -> DataFrame:
    """One row: how many spectra have no peak list, or an empty one."""
    return spectra.agg(F.count_if(F.col("peaks").isNull() | (F.size("peaks") == 0)).alias("n_empty"), F.count("*").alias("n"))
