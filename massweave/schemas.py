"""Explicit schemas of the tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PEAKS = T.ArrayType(T.StructType([T.StructField("mz", T.DoubleType()), T.StructField("ints", T.DoubleType())]))


def _table(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v if isinstance(v, T.DataType) else v()) for k, v in kinds.items()])


SPECTRA = _table(
    spec_id=T.LongType, mol_id=T.LongType, group_id=T.LongType, dset=T.StringType, dset_spec_id=T.StringType,
    prec_type=T.StringType, inst_type=T.StringType, frag_mode=T.StringType, spec_type=T.StringType, ion_mode=T.StringType,
    col_gas=T.StringType, res=T.IntegerType, ace=T.DoubleType, ace_extra_1=T.DoubleType, ace_extra_2=T.DoubleType,
    nce=T.DoubleType, nce_extra_1=T.DoubleType, nce_extra_2=T.DoubleType, ce_type=T.StringType, prec_mz=T.DoubleType,
    ri=T.DoubleType, peaks=PEAKS,
)
MOLECULES = _table(
    mol_id=T.LongType, smiles=T.StringType, inchikey_s=T.StringType, scaffold=T.StringType, formula=T.StringType,
    inchi=T.StringType, mw=T.DoubleType, exact_mw=T.DoubleType, num_atoms=T.IntegerType, num_bonds=T.IntegerType,
    charge=T.IntegerType, single_mol=T.BooleanType, num_radicals=T.IntegerType,
)
FRAG_FORMULAS = _table(mol_id=T.LongType, formula_idx=T.IntegerType, formula=T.StringType, k=T.IntegerType, mz=T.DoubleType, prob=T.DoubleType, h_delta=T.IntegerType)
PREDICTIONS = _table(model=T.StringType, spec_id=T.LongType, mol_id=T.LongType, pred_mzs=T.ArrayType(T.DoubleType()), pred_ints=T.ArrayType(T.DoubleType()), oos_prob=T.DoubleType)

#: Columns of the unified raw table; every value is text.
RAW_COLUMNS = (
    "dset", "spec_id", "peaks", "prec_mz", "prec_type", "inst_type", "inst", "frag_mode", "col_energy", "spec_type", "ion_mode",
    "col_gas", "ri", "smiles", "inchi", "inchikey", "formula", "exact_mw", "mw", "name", "notes",
    "col_energy_extra_1", "col_energy_extra_2", "exact_mass",
)


def require(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df
