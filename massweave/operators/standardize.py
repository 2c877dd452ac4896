"""The standardisation pipeline from the unified raw table to spectra, molecules and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.functions import energy, formula, text
from massweave.operators.aggregates import dense_ids
from massweave.operators.joins import drop_ids, mismatches
from massweave.operators.ordering import numbered


def molecules_of(raw: DataFrame, properties: DataFrame) -> DataFrame:
    """One row for each SMILES with its properties, numbered in sorted order."""
    one = raw.select("smiles").where("smiles is not null").distinct()
    return numbered(one, ["smiles"], "mol_id").join(properties, "smiles")


def standardized(raw: DataFrame, properties: DataFrame) -> dict[str, DataFrame]:
    """``spectra, molecules`` and the audits ``unknown_molecules, formula_audit, inchikey_audit, mass_audit``.

    Of rows of one (dset, spec_id) the first by its text stays; texts become typed columns, all three
    energies too; groups are (molecule, adduct, instrument). Spectra whose formula is not their molecule's,
    or whose mass is off by more than 0.1, go; another key is only reported. A missing precursor m/z is
    filled in last, for what is left.
    """
    first = W.partitionBy("dset", "spec_id").orderBy(F.md5(F.concat_ws("|", "peaks", "smiles")))
    raw = raw.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    mols = molecules_of(raw, properties)
    energies = {f"{kind}{extra}": parse(F.col(f"col_energy{extra}")) for extra in ("", "_extra_1", "_extra_2") for kind, parse in (("ace", energy.absolute_energy), ("nce", energy.normalised_energy))}
    rows = raw.select(
        "dset", F.col("spec_id").alias("dset_spec_id"), "smiles", F.nullif("formula", F.lit("")).alias("formula"), F.substring("inchikey", 1, 14).alias("inchikey_s"), F.col("exact_mass").try_cast("double").alias("exact_mw"),
        text.adduct(F.col("prec_type")).alias("prec_type"), text.instrument(F.col("inst_type"), F.col("inst")).alias("inst_type"),
        text.fragmentation(F.col("inst_type"), F.col("frag_mode"), F.col("col_energy")).alias("frag_mode"), "spec_type", text.ion_mode(F.col("ion_mode")).alias("ion_mode"), "col_gas",
        text.resolution(F.col("peaks")).alias("res"), *[c.alias(n) for n, c in energies.items()],
        F.col("prec_mz").try_cast("double").alias("prec_mz"), F.col("ri").try_cast("double").alias("ri"), text.peaks_of(F.col("peaks")).alias("peaks"),
    )
    none = rows.join(mols.select("smiles"), "smiles", "left_anti").select("dset", "dset_spec_id", "smiles")
    known = numbered(rows.join(mols.select("smiles", "mol_id"), "smiles"), ["dset_spec_id", "dset"], "spec_id")
    has = lambda extra: F.col(f"ace{extra}").isNotNull() | F.col(f"nce{extra}").isNotNull()
    known = known.withColumn("ce_type", F.when(~(has("") | has("_extra_1") | has("_extra_2")), "none").when(has("_extra_2"), "stepped").when(has("_extra_1"), "ramped").otherwise("single"))
    known = dense_ids(known, ["mol_id", "prec_type", "inst_type"], "group_id")
    audit = lambda column, off: mismatches(known.select("dset_spec_id", "spec_id", "mol_id", column).where(F.col(column).isNotNull()), mols, "mol_id", {column: off}).drop("reason")
    formula_audit, inchikey_audit = audit("formula", None), audit("inchikey_s", None) if "inchikey_s" in mols.columns else None
    mass_audit = mismatches(known.select("dset_spec_id", "spec_id", "mol_id", "exact_mw").where("exact_mw > 0"), mols, "mol_id", {"exact_mw": 0.1}).drop("reason")
    kept = drop_ids(drop_ids(known, formula_audit, "spec_id"), mass_audit, "spec_id").drop("smiles", "formula", "inchikey_s", "exact_mw")
    kept = kept.join(mols.select("mol_id", "exact_mw"), "mol_id")
    kept = kept.withColumn("prec_mz", formula.inferred_precursor(F.col("prec_mz"), F.col("spec_type"), F.col("exact_mw"), F.col("prec_type"), F.col("dset"))).drop("exact_mw")
    audits = {"unknown_molecules": none, "formula_audit": formula_audit, "inchikey_audit": inchikey_audit, "mass_audit": mass_audit}
    return {"spectra": kept, "molecules": mols} | {k: v for k, v in audits.items() if v is not None}


def with_taxonomy(molecules: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Molecules with the first taxonomy row of their SMILES; others are left out; lists by semicolon as arrays."""
    one = taxonomy.withColumn("_r", F.row_number().over(W.partitionBy("smiles").orderBy("sid"))).where("_r = 1").drop("_r", "sid")
    lists = [c for c in ("alternative_parents", "substituents") if c in one.columns]
    return molecules.select("mol_id", "smiles", "inchikey_s").join(one.withColumns({c: text.listed(F.col(c)) for c in lists}), "smiles").select("mol_id", "smiles", "inchikey_s", *[c for c in one.columns if c != "smiles"])
