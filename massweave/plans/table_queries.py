"""Queries on spectrum and molecule tables: filters, parsing, ids, splits, samples, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.functions import energy, formula, text
from massweave.operators import aggregates, filters, graphs, joins, sequential, splits
from massweave.operators.ordering import hash_order
from massweave.plans.registry import query
from massweave.plans.views import Views, sql

CRITERIA = filters.Criteria(
    members={"inst_type": ["FT", "QTOF"], "frag_mode": ["HCD", "CID"], "prec_type": ["[M+H]+", "[M-H]-", "[M]+"]}, energy="nce_or_ace", prec_mz=(150.0, 900.0),
    max_atoms=40, max_bonds=38, elements=["C", "H", "O", "N", "Cl"],
)
MASKS = """SELECT spec_id, inst_type IN ('FT', 'QTOF') AS in_inst_type, frag_mode IN ('HCD', 'CID') AS in_frag_mode, prec_type IN ('[M+H]+', '[M-H]-', '[M]+') AS in_prec_type,
  nce IS NOT NULL OR ace IS NOT NULL AS energy, prec_mz BETWEEN 150 AND 900 AS prec_mz, single_mol, charge IN (0, 1) AS charge, num_atoms <= 40 AS num_atoms, num_bonds <= 38 AS num_bonds,
  num_radicals = 0 AS radicals, formula NOT LIKE '%NaS%' AS elements, charge <> 1 OR prec_type = '[M]+' AS charged_adduct FROM spectra JOIN molecules USING (mol_id)"""
NAMES = ["in_inst_type", "in_frag_mode", "in_prec_type", "energy", "prec_mz", "single_mol", "charge", "num_atoms", "num_bonds", "radicals", "elements", "charged_adduct"]
ALL = " AND ".join(NAMES)


@query(sql(["spectra", "molecules"], " UNION ALL ".join([f"SELECT '{n}' AS criterion, round(avg({n}::INT), 6) AS keep_rate, sum({n}::INT)::BIGINT AS n_kept FROM masks" for n in NAMES] + [f"SELECT 'all', round(avg(({ALL})::INT), 6), sum(({ALL})::INT)::BIGINT FROM masks"]), masks=MASKS))
def spec_filter_report(v: Views) -> DataFrame:
    return filters.keep_rates(v.spectra(), v.molecules(), CRITERIA)


@query(sql(["spectra", "molecules"], f"SELECT spec_id, mol_id, round(prec_mz, 6) AS prec_mz FROM spectra WHERE spec_id IN (SELECT spec_id FROM masks WHERE {ALL})", masks=MASKS))
def spec_filter(v: Views) -> DataFrame:
    return filters.filtered(v.spectra(), v.molecules(), CRITERIA)[0].select("spec_id", "mol_id", "prec_mz")


@query(sql(["spectra", "molecules"], f"SELECT mol_id, formula FROM molecules WHERE mol_id IN (SELECT mol_id FROM spectra WHERE spec_id IN (SELECT spec_id FROM masks WHERE {ALL}))", masks=MASKS))
def molecule_prune(v: Views) -> DataFrame:
    return filters.filtered(v.spectra(), v.molecules(), CRITERIA)[1].select("mol_id", "formula")


@query(sql(["spectra"], """SELECT spec_id, round(coalesce(nce, ace * 500.0::DOUBLE / prec_mz), 6) AS nce, round(coalesce(ace, nce * prec_mz / 500.0::DOUBLE), 6) AS ace FROM spectra
  WHERE CASE inst_type WHEN 'FT' THEN coalesce(nce, ace * 500.0::DOUBLE / prec_mz) BETWEEN 0 AND 60 WHEN 'QTOF' THEN coalesce(nce, ace * 500.0::DOUBLE / prec_mz) BETWEEN 10 AND 40 ELSE true END"""))  # fmt: skip
def ce_fill_and_range_filter(v: Views) -> DataFrame:
    charge = energy.charge_of(F.col("prec_type"))
    filled = v.spectra().select(
        "spec_id", "inst_type", energy.filled_normalised(F.col("nce"), F.col("ace"), charge, F.col("prec_mz")).alias("nce"), energy.filled_absolute(F.col("ace"), F.col("nce"), charge, F.col("prec_mz")).alias("ace"),
        F.lit(None).cast("double").alias("nce_extra_1"), F.lit(None).cast("double").alias("nce_extra_2"),
    )
    return filled.where(filters.energy_in_range({"FT": (0.0, 60.0), "QTOF": (10.0, 40.0)})).select("spec_id", "nce", "ace")


@query(sql(["spectra"], """SELECT spec_id, kind, len(l) AS n, round(coalesce(list_avg(l), 0), 6) AS mean, round(CASE WHEN len(l) > 0 THEN list_stddev_pop(l) ELSE 0 END, 6) AS std, len(l) > 0 AS valid FROM (
  SELECT spec_id, CASE WHEN nce IS NULL THEN 'none' WHEN spec_id % 7 = 0 THEN 'stepped' WHEN spec_id % 2 = 0 THEN 'ramped' ELSE 'single' END AS kind,
  CASE WHEN nce IS NULL THEN [] WHEN spec_id % 7 = 0 THEN [nce, nce + 5, nce + 9] WHEN spec_id % 2 = 0 THEN list_transform(generate_series(0, (spec_id % 6)::INT), lambda x: nce + x) ELSE [nce] END AS l FROM spectra)"""))  # fmt: skip
def ce_list_expand(v: Views) -> DataFrame:
    id_ = F.col("spec_id")
    s = v.spectra().withColumn("x1", F.when(id_ % 7 == 0, F.col("nce") + 5).when(id_ % 2 == 0, F.col("nce") + id_ % 6)).withColumn("x2", F.when(id_ % 7 == 0, F.col("nce") + 9))
    args = [F.col(c) for c in ("nce", "x1", "x2")]
    rows = s.select("spec_id", energy.energy_kind(*args).alias("kind"), energy.energy_list(*args).alias("l")).withColumn("m", energy.energy_moments(F.col("l")))
    return rows.select("spec_id", "kind", F.size("l").cast("bigint").alias("n"), "m.mean", "m.std", "m.valid")


TEXTS = ["{n}", "{n} eV", "NCE={n}% {m}eV", "{n}HCD", "CE {n}", "NCE={n}%", "{n}% resonant relative/normalized", "{n} (nominal)", "HCD {n}%", "{n} NCE", "{n}(NCE)", "{n} %", "HCD (NCE {n}%)", "{n} normalized=True ramped=True", "n/a"]


def ce_text_sql() -> str:
    parts = " ".join("WHEN {} THEN {}".format(i, "concat(" + ", ".join(f"'{p}'" if p not in "nm" or len(p) != 1 else f"{p}::VARCHAR" for p in t.replace("{", "\0").replace("}", "\0").split("\0") if p) + ")") for i, t in enumerate(TEXTS))
    return f"SELECT o_orderkey AS spec_id, CASE o_orderkey % {len(TEXTS)} {parts} END AS t FROM (SELECT o_orderkey, (10 + o_orderkey % 50) AS n, (5 + o_orderkey % 40) AS m FROM orders)"


def sql_first(patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '')" for p in patterns) + ")::DOUBLE"


@query(sql([], f"SELECT spec_id, t, {sql_first(energy.ABSOLUTE)} AS ace, {sql_first(energy.NORMALISED)} AS nce, CASE WHEN contains(t, 'normalized=True') THEN concat('NCE=', split_part(t, ' ', 1), '%') ELSE concat(split_part(t, ' ', 1), ' eV') END AS canonical, contains(t, 'ramped=True') AS ramped FROM tx", tx=ce_text_sql()))
def ce_text_parse(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    n, m = (10 + k % 50).cast("string"), (5 + k % 40).cast("string")
    t = F.lit(None).cast("string")
    for i, pattern in enumerate(TEXTS):
        t = F.when(k % len(TEXTS) == i, F.replace(F.replace(F.lit(pattern), F.lit("{n}"), n), F.lit("{m}"), m)).otherwise(t)
    rows = v.table("orders").select(k.alias("spec_id"), t.alias("t"))
    listed = energy.listed_energy(F.col("t"))
    return rows.select("spec_id", "t", energy.absolute_energy(F.col("t")).alias("ace"), energy.normalised_energy(F.col("t")).alias("nce"), listed["text"].alias("canonical"), listed["ramped"].alias("ramped"))


INST = ["QTOF", "Q-TOF", "HCD", "QqQ", "LC-ESI-IT", "Orbitrap (LCMS)", "Unknown (LCMS)", "strange", None]


@query(sql([], """SELECT o_orderkey AS spec_id, CASE o_orderkey % 9 WHEN 0 THEN 'QTOF' WHEN 1 THEN 'QTOF' WHEN 2 THEN 'FT' WHEN 3 THEN 'QQQ' WHEN 4 THEN 'IT' WHEN 5 THEN 'FT' WHEN 6 THEN 'Other' WHEN 7 THEN 'Other' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'FT' ELSE 'Other' END END AS inst_type,
  CASE WHEN o_orderkey % 9 = 2 OR o_orderkey % 4 = 0 THEN 'HCD' WHEN o_orderkey % 4 = 1 THEN 'CID' WHEN o_orderkey % 4 = 2 THEN 'HCD' END AS frag_mode,
  CASE WHEN o_orderkey % 3 = 0 THEN 'P' WHEN o_orderkey % 3 = 1 THEN 'N' END AS ion_mode, CASE o_orderkey % 4 WHEN 0 THEN '[M+H]+' WHEN 1 THEN '[M+2H]2+' WHEN 2 THEN '[M+CH2O2-H]-' ELSE '[M-H]-' END AS prec_type,
  CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN -1 ELSE -1 END AS charge,
  CASE o_orderkey % 4 WHEN 0 THEN 'mph_p' WHEN 1 THEN 'mp2h_2p' WHEN 2 THEN 'mpch2o2mh_m' ELSE 'mmh_m' END AS tag FROM orders"""))  # fmt: skip
def instrument_adduct_parse(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(x).cast("string") for x in values]), (k % len(values) + 1).cast("int"))
    rows = v.table("orders").select(k.alias("spec_id"), pick(INST).alias("it"), pick(["Orbitrap", "thing"]).alias("inst"), pick(["CID", None, "HCD", "odd"]).alias("fm"), pick(["35HCD", "10 eV", "10 eV", "10 eV"]).alias("ce"), pick(["POSITIVE", "N", "?"]).alias("im"), pick(["[M+H]1+", "[M+2H]2+", "[M+FA-H]-", "[M-H]1-"]).alias("pt"))
    rows = rows.withColumn("prec_type", text.adduct(F.col("pt")))
    return rows.select("spec_id", text.instrument(F.col("it"), F.col("inst")).alias("inst_type"), text.fragmentation(F.col("it"), F.col("fm"), F.col("ce")).alias("frag_mode"), text.ion_mode(F.col("im")).alias("ion_mode"), "prec_type", energy.charge_of(F.col("prec_type")).alias("charge"), text.adduct_tag(F.col("prec_type")).alias("tag"))


M = formula.MASSES
MASS_SQL = f"({M['C']}::DOUBLE * num_atoms + {M['H']}::DOUBLE * (2 * num_atoms + 2)) + CASE WHEN mol_id % 3 = 0 THEN 2 * {M['O']}::DOUBLE WHEN mol_id % 3 = 1 THEN {M['Cl']}::DOUBLE ELSE {M['Na']}::DOUBLE + {M['S']}::DOUBLE END"


@query(sql(["molecules"], f"""SELECT mol_id, round({MASS_SQL}, 6) AS mass, mol_id % 3 <> 2 AS organic, round(1 + 0.5::DOUBLE * (2 * num_atoms - (2 * num_atoms + 2) - CASE WHEN mol_id % 3 = 1 THEN 1 ELSE 0 END), 6) AS rdbe,
  concat('C', CASE WHEN num_atoms = 1 THEN '' ELSE num_atoms::VARCHAR END, 'H', (2 * num_atoms + 2)::VARCHAR, CASE mol_id % 3 WHEN 0 THEN 'O2' WHEN 1 THEN 'Cl' ELSE 'NaS' END) AS hill,
  CASE mol_id % 3 WHEN 0 THEN concat('C', num_atoms::VARCHAR, 'H', (2 * num_atoms + 2)::VARCHAR, 'O2') WHEN 1 THEN concat('C', num_atoms::VARCHAR, 'Cl1H', (2 * num_atoms + 2)::VARCHAR) ELSE concat('C', num_atoms::VARCHAR, 'H', (2 * num_atoms + 2)::VARCHAR, 'Na1S1') END AS alphabetic FROM molecules"""))  # fmt: skip
def formula_elements_mass(v: Views) -> DataFrame:
    e = formula.elements_of(F.col("formula"))
    rows = v.molecules().withColumn("e", e)
    return rows.select("mol_id", formula.mass_of(F.col("e")).alias("mass"), formula.only_elements(F.col("formula"), ["C", "H", "O", "N", "Cl"]).alias("organic"), formula.unsaturation(F.col("e")).alias("rdbe"), formula.hill(F.col("e")).alias("hill"), formula.alphabetic(F.col("e")).alias("alphabetic"))


@query(sql(["molecules"], f"""SELECT mol_id, count(*) AS n, round(max(c * {M['C']}::DOUBLE + h * {M['H']}::DOUBLE + o * {M['O']}::DOUBLE), 6) AS heaviest FROM (
  SELECT mol_id, c, h, unnest(generate_series(0, CASE WHEN mol_id % 3 = 0 THEN 2 ELSE 0 END)) AS o FROM (SELECT mol_id, c, unnest(generate_series(0, 2 * (num_atoms % 8) + 2)) AS h FROM (SELECT *, unnest(generate_series(0, num_atoms % 8)) AS c FROM molecules)))
  WHERE 1 + 0.5::DOUBLE * (2 * c - h) >= 0 GROUP BY mol_id"""))  # fmt: skip
def formula_subsets_rdbe(v: Views) -> DataFrame:
    """Molecules of one formula share one enumeration."""
    size = (F.col("num_atoms") % 8).cast("int")
    e = F.map_from_arrays(F.array(F.lit("C"), F.lit("H"), F.lit("O")), F.array(size, 2 * size + 2, F.when(F.col("mol_id") % 3 == 0, 2).otherwise(0)))
    m = v.molecules().select("mol_id", e.alias("e")).withColumn("text", formula.alphabetic(F.col("e")))
    rows = formula.subformulas(m.groupBy("text").agg(F.any_value("e").alias("e")), "e", ["C", "H", "O"])
    return m.select("mol_id", "text").join(rows.groupBy("text").agg(F.count("*").alias("n"), F.max("sub_mass").alias("heaviest")), "text").drop("text")


@query(sql(["molecules"], f"""SELECT mol_id, n, heaviest FROM molecules JOIN (SELECT num_atoms, tail, count(*) AS n, round(max(c * {M['C']}::DOUBLE + h * {M['H']}::DOUBLE + o * {M['O']}::DOUBLE + x * {M['Cl']}::DOUBLE + a * {M['Na']}::DOUBLE + s * {M['S']}::DOUBLE), 6) AS heaviest
  FROM (SELECT DISTINCT num_atoms, mol_id % 3 AS tail FROM molecules) f JOIN (SELECT unnest(generate_series(0, 100)) AS c) ON c <= num_atoms JOIN (SELECT unnest(generate_series(0, 202)) AS h) ON h <= 2 * num_atoms + 2
  JOIN (SELECT * FROM (VALUES (0, 0, 0, 0, 0), (0, 1, 0, 0, 0), (0, 2, 0, 0, 0), (1, 0, 0, 0, 0), (1, 0, 1, 0, 0), (2, 0, 0, 0, 0), (2, 0, 0, 1, 0), (2, 0, 0, 0, 1), (2, 0, 0, 1, 1)) v(t, o, x, a, s)) ON t = tail WHERE 1 + 0.5::DOUBLE * (2 * c - h - x) >= 0 GROUP BY num_atoms, tail) e
  ON e.num_atoms = molecules.num_atoms AND e.tail = mol_id % 3"""))  # fmt: skip
def formula_subsets_all(v: Views) -> DataFrame:
    """Sub-formulas of every molecule's own formula, all elements; molecules of one formula share one enumeration."""
    m = v.molecules().select("mol_id", "formula")
    e = m.select("formula").distinct().withColumn("e", formula.elements_of(F.col("formula")))
    rows = formula.subformulas(e, "e", list(formula.MASSES)).groupBy("formula").agg(F.count("*").alias("n"), F.max("sub_mass").alias("heaviest"))
    return m.join(rows, "formula", "left").select("mol_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "heaviest")


@query(sql(["grouped"], """SELECT spec_id, group_id, (SELECT count(*) FROM grouped g WHERE g.group_id = s.group_id) AS spec_per_group, m.groups_per_mol, m.spec_per_mol FROM grouped s JOIN (SELECT mol_id, count(DISTINCT group_id) AS groups_per_mol, count(*) AS spec_per_mol FROM grouped GROUP BY mol_id) m USING (mol_id)"""))
def group_ids_and_counts(v: Views) -> DataFrame:
    return aggregates.group_counts(v.grouped()).select("spec_id", "group_id", "spec_per_group", "groups_per_mol", "spec_per_mol")


@query(sql(["spectra", "molecules"], """SELECT spec_id, concat_ws(',', CASE WHEN s.f <> m.formula THEN 'formula' END, CASE WHEN abs(s.mw - m.exact_mw) > 0.1 THEN 'exact_mw' END) AS reason FROM (
  SELECT spec_id, mol_id, CASE WHEN spec_id % 11 = 0 THEN 'C1H4' ELSE NULL END AS f0, spec_id FROM spectra) x JOIN molecules m USING (mol_id) JOIN (SELECT s.spec_id, CASE WHEN s.spec_id % 11 = 0 THEN 'C1H4' ELSE m2.formula END AS f, m2.exact_mw + CASE WHEN s.spec_id % 13 = 0 THEN 0.5 ELSE 0 END AS mw FROM spectra s JOIN molecules m2 USING (mol_id)) s USING (spec_id)
  WHERE s.f <> m.formula OR abs(s.mw - m.exact_mw) > 0.1"""))  # fmt: skip
def audit_mismatches(v: Views) -> DataFrame:
    m = v.molecules()
    claimed = v.spectra().select("spec_id", "mol_id").join(m.select("mol_id", "formula", "exact_mw"), "mol_id")
    claimed = claimed.withColumn("formula", F.when(F.col("spec_id") % 11 == 0, "C1H4").otherwise(F.col("formula"))).withColumn("exact_mw", F.col("exact_mw") + F.when(F.col("spec_id") % 13 == 0, 0.5).otherwise(0.0))
    return joins.mismatches(claimed, m, "mol_id", {"formula": None, "exact_mw": 0.1}).select("spec_id", "reason")


@query(sql(["spectra", "peaks"], """SELECT mol_id, prec_type, first_spec, last_spec, (SELECT spec_id FROM n WHERE n.mol_id = f.mol_id AND n.prec_type = f.prec_type ORDER BY n_peaks DESC, spec_id LIMIT 1) AS best_spec FROM f""",
  n="SELECT s.spec_id, mol_id, prec_type, coalesce(c.n, 0) AS n_peaks FROM spectra s LEFT JOIN (SELECT spec_id, count(*) AS n FROM peaks GROUP BY spec_id) c USING (spec_id)", f="SELECT mol_id, prec_type, min(spec_id) AS first_spec, max(spec_id) AS last_spec FROM spectra GROUP BY mol_id, prec_type"))
def dedup_first_last(v: Views) -> DataFrame:
    n = v.spectra().join(v.plain_peaks().groupBy("spec_id").agg(F.count("*").alias("n_peaks")), "spec_id", "left").fillna({"n_peaks": 0})
    return aggregates.one_of_each(n, ["mol_id", "prec_type"], "spec_id", "n_peaks").withColumnsRenamed({k: f"{k}_spec" for k in ("first", "last", "best")})


KEYS = "SELECT inchikey_s, row_number() OVER (ORDER BY md5(concat(inchikey_s, '|420')), inchikey_s) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT inchikey_s FROM molecules)"
SPLIT = "SELECT mol_id, inchikey_s, CASE WHEN i < ceil(n * 0.1::DOUBLE) THEN 'test' WHEN i < ceil(n * 0.1::DOUBLE) + ceil(n * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM molecules JOIN k USING (inchikey_s)"


@query(sql(["molecules"], "SELECT * FROM s", k=KEYS, s=SPLIT))
def split_by_key(v: Views) -> DataFrame:
    return splits.keyed_split(v.molecules().select("mol_id", "inchikey_s"), "inchikey_s", 0.1, 0.2)


@query(sql(["molecules"], "SELECT mol_id, scaffold, f AS fold FROM molecules JOIN (SELECT scaffold, ntile(5) OVER (ORDER BY scaffold) - 1 AS f FROM (SELECT DISTINCT scaffold FROM molecules)) USING (scaffold)"))
def cv_folds(v: Views) -> DataFrame:
    return splits.folds(v.molecules().select("mol_id", "scaffold"), "scaffold", 0.2).withColumn("fold", F.col("fold").cast("bigint"))


@query(sql(["molecules"], "SELECT mol_id, inchikey_s FROM molecules WHERE mol_id % 2 = 0 AND inchikey_s NOT IN (SELECT inchikey_s FROM s WHERE split IN ('val', 'test') AND mol_id % 2 = 1)", k=KEYS, s=SPLIT))
def secondary_exclusion(v: Views) -> DataFrame:
    m = v.molecules().select("mol_id", "inchikey_s")
    primary = splits.keyed_split(m, "inchikey_s", 0.1, 0.2).where("mol_id % 2 = 1")
    return splits.secondary(m.where("mol_id % 2 = 0"), primary, "inchikey_s", ["val", "test"])


@query(sql(["grouped"], """SELECT spec_id, round(1.0::DOUBLE / count(*) OVER (PARTITION BY group_id), 6) AS w_group, round(1.0::DOUBLE / count(*) OVER (PARTITION BY mol_id), 6) AS w_mol, round(1.0::DOUBLE / count(*) OVER (PARTITION BY prec_type, inst_type) * (1.0::DOUBLE / count(*) OVER (PARTITION BY group_id)), 6) AS w_adduct FROM grouped"""))
def inverse_freq_weights(v: Views) -> DataFrame:
    w = splits.inverse_frequency
    return v.grouped().select("spec_id", w(["group_id"]).alias("w_group"), w(["mol_id"]).alias("w_mol"), (w(["prec_type", "inst_type"]) * w(["group_id"])).alias("w_adduct"))


@query(sql(["grouped"], "SELECT spec_id, mol_id FROM (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY md5(concat(spec_id::VARCHAR, '|421')), spec_id) AS r FROM grouped) WHERE r <= 2"))
def group_sample_k(v: Views) -> DataFrame:
    return splits.sample_of_each(v.grouped(), ["mol_id"], 2, "spec_id", seed=421).select("spec_id", "mol_id")


U = "(('0x' || substr(md5(concat(spec_id::VARCHAR, '|7')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


@query(sql(["grouped"], f"SELECT spec_id, mol_id FROM (SELECT *, -ln({U}) * count(*) OVER (PARTITION BY mol_id) AS e FROM grouped) ORDER BY e, spec_id LIMIT 500"))
def weighted_sample(v: Views) -> DataFrame:
    """A weighted sampling operator's output: 500 spectra, molecules of equal chance."""
    rows = v.grouped().withColumn("w", splits.inverse_frequency(["mol_id"]))
    return splits.weighted_sample(rows, 500, "w", "spec_id", seed=7).select("spec_id", "mol_id")


@query(sql(["spectra"], f"""SELECT spec_id, (CASE WHEN (f + u) * n > st THEN ((f + u) * n - st + total - 1) // total ELSE 0 END - CASE WHEN f * n > st THEN (f * n - st + total - 1) // total ELSE 0 END)::BIGINT AS draws FROM (
  SELECT *, total * {splits.first_units(420)}::HUGEINT // 4294967296 AS st FROM (SELECT spec_id, u, coalesce(sum(u) OVER (ORDER BY w, md5(concat(spec_id::VARCHAR, '|420')), spec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS f, (sum(u) OVER ())::HUGEINT AS total, (count(*) OVER ())::HUGEINT AS n
    FROM (SELECT *, floor(w / max(w) OVER () * {splits.UNITS})::BIGINT AS u FROM (SELECT spec_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY mol_id) AS w FROM spectra))))"""))  # fmt: skip
def weighted_draws(v: Views) -> DataFrame:
    rows = v.grouped().withColumn("w", splits.inverse_frequency(["mol_id"]))
    return splits.weighted_draws(rows, rows.count(), "w", "spec_id")


@query(sql(["spectra"], """SELECT spec_id, count(*) AS draws FROM u ASOF JOIN c ON u.u >= c.start GROUP BY spec_id""",
  w="SELECT spec_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY mol_id) AS w, md5(concat(spec_id::VARCHAR, '|420')) AS h FROM spectra", c="SELECT spec_id, coalesce(sum(w) OVER (ORDER BY h, spec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w",
  u="SELECT (concat('0x', md5(concat(i::VARCHAR, '|420+'))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE * (SELECT sum(w) FROM w) AS u FROM (SELECT unnest(generate_series(0, (SELECT count(*) FROM spectra) - 1)) AS i)"))
def independent_draws(v: Views) -> DataFrame:
    rows = v.spectra().withColumn("w", splits.inverse_frequency(["mol_id"]))
    return splits.independent_draws(rows, rows.count(), "w", "spec_id")


#: Batches one after another: each ends at the last row that keeps its sums within the budgets.
@query(sql(["peaks"], """SELECT r.spec_id, r.shard, b.batch::INT AS batch FROM (WITH RECURSIVE b AS (
    SELECT shard, 0::BIGINT AS batch, 0::HUGEINT AS n0, 0::HUGEINT AS e0, max(cn) AS n1, max(ce) AS e1 FROM r WHERE cn <= 64 AND ce <= 400 GROUP BY shard UNION ALL
    SELECT b.shard, b.batch + 1, b.n1, b.e1, max(r.cn), max(r.ce) FROM b JOIN r ON r.shard = b.shard AND r.cn > b.n1 AND r.cn <= b.n1 + 64 AND r.ce <= b.e1 + 400 GROUP BY 1, 2, 3, 4) SELECT * FROM b) b JOIN r ON r.shard = b.shard AND r.cn > b.n0 AND r.cn <= b.n1""",
  one="SELECT spec_id, count(*) AS nodes, count(*) * count(*) AS edges, md5(concat(spec_id::VARCHAR, '|420')) AS h FROM peaks GROUP BY spec_id",
  sh="SELECT *, (concat('0x', h[9:16])::BIGINT % greatest(1, ceil(count(*) OVER () / 20000.0))::BIGINT)::INT AS shard FROM one",
  r="SELECT *, sum(nodes) OVER w AS cn, sum(edges) OVER w AS ce FROM sh WHERE nodes <= 64 AND edges <= 400 WINDOW w AS (PARTITION BY shard ORDER BY h, spec_id ROWS UNBOUNDED PRECEDING)"))
def greedy_pack(v: Views) -> DataFrame:
    n = v.plain_peaks().groupBy("spec_id").agg(F.count("*").alias("nodes")).withColumn("edges", F.col("nodes") * F.col("nodes"))
    return splits.greedy_pack(n, "spec_id", {"nodes": 64, "edges": 400})


#: The same over one global order: a batch closes before the first row (from the second on) that passes a budget.
IN_ORDER = """SELECT r.spec_id, b.batch FROM (WITH RECURSIVE b AS (
    SELECT 0::BIGINT AS batch, 0::BIGINT AS i, 0::BIGINT AS n0, 0::BIGINT AS e0, (SELECT count(*) FROM r)::BIGINT AS last UNION ALL
    SELECT b.batch + 1, min(r.place), min(r.cn - r.nodes), min(r.ce - r.edges), b.last FROM b JOIN r ON r.place > b.i AND r.place <= b.i + {reach} AND (r.cn > b.n0 + {nodes} OR r.ce > b.e0 + {edges}{flush}) GROUP BY b.batch, b.last) SELECT batch, i, lead(i, 1, last) OVER (ORDER BY batch) AS j FROM b) b JOIN r ON r.place >= b.i AND r.place < b.j"""
SIZED = "SELECT spec_id, count(*)::BIGINT AS nodes, (count(*) * count(*))::BIGINT AS edges FROM peaks GROUP BY spec_id"
PLACED = "SELECT *, row_number() OVER w - 1 AS place, (sum(nodes) OVER w)::BIGINT AS cn, (sum(edges) OVER w)::BIGINT AS ce FROM one {where} WINDOW w AS (ORDER BY spec_id ROWS UNBOUNDED PRECEDING)"


@query(sql(["peaks"], IN_ORDER.format(reach=65, nodes=64, edges=400, flush=""), one=SIZED, r=PLACED.format(where="WHERE nodes <= 64 AND edges <= 400")))
def sequential_pack(v: Views) -> DataFrame:
    """Batches in the order of ids, oversized rows left out."""
    n = v.plain_peaks().groupBy("spec_id").agg(F.count("*").alias("nodes")).withColumn("edges", F.col("nodes") * F.col("nodes"))
    return sequential.sequential_pack(n, "spec_id", ["spec_id"], {"nodes": 64, "edges": 400})


@query(sql(["peaks"], IN_ORDER.format(reach=13, nodes=40, edges=30, flush=" OR r.place >= b.i + 12"), one=SIZED, r=PLACED.format(where="")))
def sequential_pack_all(v: Views) -> DataFrame:
    """Batches of at most twelve in the order of ids; oversized rows are batches of their own."""
    n = v.plain_peaks().groupBy("spec_id").agg(F.count("*").alias("nodes")).withColumn("edges", F.col("nodes") * F.col("nodes"))
    return sequential.sequential_pack(n, "spec_id", ["spec_id"], {"nodes": 40, "edges": 30}, drop_oversize=False, flush_every=12)


@query()
def contrastive_pack(v: Views) -> DataFrame:
    n = v.plain_peaks().groupBy("spec_id").agg(F.count("*").alias("nodes")).join(v.spectra(), "spec_id").join(v.molecules().select("mol_id", "formula"), "mol_id")
    return splits.contrastive_pack(n, "spec_id", ["prec_type", "mol_id"], ["prec_type", "formula"], 64, "nodes", 2, 2)


@query(sql(["spectra", "peaks"], " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max, sum(({c} IS NULL)::INT)::BIGINT AS nulls FROM spectra" for c in ("prec_mz", "nce", "ace"))))
def describe_columns(v: Views) -> DataFrame:
    return aggregates.described(v.spectra(), ["prec_mz", "nce", "ace"])


@query(sql(["spectra"], "SELECT inst_type, prec_type, count(*) AS n FROM spectra GROUP BY 1, 2"))
def value_counts(v: Views) -> DataFrame:
    return v.spectra().groupBy("inst_type", "prec_type").agg(F.count("*").alias("n"))


@query(sql(["spectra", "molecules"], """SELECT inst_type, (SELECT count(*) FROM (SELECT DISTINCT mol_id FROM spectra s WHERE s.inst_type = a.inst_type INTERSECT SELECT mol_id FROM molecules WHERE charge = 0)) AS shared,
  (SELECT count(*) FROM (SELECT DISTINCT mol_id FROM spectra s WHERE s.inst_type = a.inst_type EXCEPT SELECT mol_id FROM molecules WHERE charge = 0)) AS only_left,
  (SELECT count(DISTINCT mol_id) FROM spectra s WHERE s.inst_type = a.inst_type) AS n,
  round((SELECT count(*) FROM (SELECT DISTINCT mol_id FROM spectra s WHERE s.inst_type = a.inst_type INTERSECT SELECT mol_id FROM molecules WHERE charge = 0))::DOUBLE / (SELECT count(DISTINCT mol_id) FROM spectra s WHERE s.inst_type = a.inst_type), 6) AS coverage
  FROM (SELECT DISTINCT inst_type FROM spectra) a"""))  # fmt: skip
def set_coverage(v: Views) -> DataFrame:
    a = v.spectra().select("inst_type", "mol_id").distinct()
    b = v.molecules().where("charge = 0").select("mol_id", F.lit(1).alias("hit"))
    rows = a.join(b, "mol_id", "left").groupBy("inst_type").agg(F.count("hit").alias("shared"), F.count_if(F.col("hit").isNull()).alias("only_left"), F.count("*").alias("n"))
    return rows.withColumn("coverage", F.col("shared") / F.col("n"))


@query(sql(["nodes", "edges"], """SELECT mol_id, md5(array_to_string(list(label ORDER BY label), ',')) AS graph_hash FROM r2 GROUP BY mol_id""",
  e2="SELECT mol_id, src, dst FROM edges UNION ALL SELECT mol_id, dst, src FROM edges", r0="SELECT mol_id, node, label::VARCHAR AS label FROM nodes",
  n1="SELECT e.mol_id, e.src AS node, array_to_string(list(r.label ORDER BY r.label), ',') AS n FROM e2 e JOIN r0 r ON e.mol_id = r.mol_id AND e.dst = r.node GROUP BY 1, 2", r1="SELECT r.mol_id, r.node, md5(concat(r.label, '|', coalesce(n, ''))) AS label FROM r0 r LEFT JOIN n1 USING (mol_id, node)",
  n2="SELECT e.mol_id, e.src AS node, array_to_string(list(r.label ORDER BY r.label), ',') AS n FROM e2 e JOIN r1 r ON e.mol_id = r.mol_id AND e.dst = r.node GROUP BY 1, 2", r2="SELECT r.mol_id, r.node, md5(concat(r.label, '|', coalesce(n, ''))) AS label FROM r1 r LEFT JOIN n2 USING (mol_id, node)"))
def wl_hash(v: Views) -> DataFrame:
    return graphs.wl_hash(v.nodes(), v.edges(), 2)


@query(sql(["nodes", "edges"], """SELECT mol_id, num_nodes, num_edges, round(CASE WHEN num_nodes > 1 THEN 2.0::DOUBLE * num_edges / (num_nodes * (num_nodes - 1)) ELSE 0 END, 6) AS sparsity, round(num_nodes::DOUBLE / num_labels, 6) AS redundancy, round(om, 6) AS out_mean, round(os, 6) AS out_std, round(im, 6) AS in_mean, round(i_s, 6) AS in_std
  FROM (SELECT mol_id, count(*) AS num_nodes, count(DISTINCT label) AS num_labels FROM nodes GROUP BY mol_id) JOIN (SELECT mol_id, sum(o)::BIGINT AS num_edges, avg(o) AS om, stddev_pop(o) AS os, avg(i) AS im, stddev_pop(i) AS i_s FROM (
    SELECT n.mol_id, n.node, (SELECT count(*) FROM edges e WHERE e.mol_id = n.mol_id AND e.src = n.node) AS o, (SELECT count(*) FROM edges e WHERE e.mol_id = n.mol_id AND e.dst = n.node) AS i FROM nodes n) GROUP BY mol_id) USING (mol_id)"""))  # fmt: skip
def graph_stats(v: Views) -> DataFrame:
    return graphs.graph_stats(v.nodes(), v.edges())


@query(sql(["nodes", "edges"], "SELECT m.mol_id, m.node % 3 AS frag_id, m.node, e.dst AS outside FROM nodes m JOIN (SELECT mol_id, src, dst FROM edges UNION ALL SELECT mol_id, dst, src FROM edges) e ON e.mol_id = m.mol_id AND e.src = m.node WHERE e.dst % 3 <> m.node % 3"))
def fragment_boundary(v: Views) -> DataFrame:
    members = v.nodes().select("mol_id", (F.col("node") % 3).alias("frag_id"), "node")
    return graphs.boundary(members, v.edges()).select("mol_id", "frag_id", "node", "outside")


@query(sql(["spectra"], """SELECT spec_id, dense_rank() OVER (ORDER BY prec_type) - 1 AS prec_idx, CASE inst_type WHEN 'FT' THEN 0 WHEN 'IT' THEN 1 ELSE 2 END AS inst_idx, CASE WHEN prec_mz <= 200 THEN '0-200' WHEN prec_mz <= 300 THEN '200-300' WHEN prec_mz <= 400 THEN '300-400' WHEN prec_mz <= 500 THEN '400-500' WHEN prec_mz <= 600 THEN '500-600' WHEN prec_mz <= 700 THEN '600-700' WHEN prec_mz <= 2000 THEN '700-2000' END AS mass_range FROM spectra"""))
def category_index(v: Views) -> DataFrame:
    """Categories as places among their sorted values; an instrument outside the list would get the list's length."""
    s = v.spectra()
    inst = F.coalesce(F.try_element_at(formula.literal_map({"FT": 0, "IT": 1}), F.col("inst_type")), F.lit(2))
    return aggregates.dense_ids(s, ["prec_type"], "prec_idx").select("spec_id", "prec_idx", inst.alias("inst_idx"), aggregates.mass_range(F.col("prec_mz")).alias("mass_range"))


@query(sql(["spectra"], "SELECT spec_id FROM spectra ORDER BY md5(concat(spec_id::VARCHAR, '|420')), spec_id LIMIT 200"))
def seeded_sample(v: Views) -> DataFrame:
    """A sampling operator's output: 200 spectra."""
    return splits.sampled(v.spectra(), 200, "spec_id").select("spec_id")


@query(sql(["molecules"], "SELECT m.mol_id, c.inst_type, c.ce, m.mol_id * 4 + c.i AS row_id FROM molecules m, (VALUES (0, 'FT', 20.0::DOUBLE), (1, 'FT', 40.0::DOUBLE), (2, 'QTOF', 20.0::DOUBLE), (3, 'QTOF', 40.0::DOUBLE)) c(i, inst_type, ce)"))
def inference_conditions(v: Views) -> DataFrame:
    """Molecules times a configured list of conditions."""
    c = v.spark.createDataFrame([(0, "FT", 20.0), (1, "FT", 40.0), (2, "QTOF", 20.0), (3, "QTOF", 40.0)], "i int, inst_type string, ce double")
    return joins.with_conditions(v.molecules().select("mol_id"), c).select("mol_id", "inst_type", "ce", (F.col("mol_id") * 4 + F.col("i")).alias("row_id"))
