"""Peak annotations: ``p-H2O+i/2.1ppm;?`` as products, losses and isotopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massweave.functions.formula import NEUTRON, alphabetic, combined, elements_of, mass_of

#: Adducts whose annotations are understood, and the hydrogens they add.
SUPPORTED = {"[M+H]+": 1, "[M-H]-": -1}
#: Fixed value: annotations of peptides.
PEPTIDE = r"^(?:(?:a|b|y)\d+|pi)"


def stripped(annotation: Column) -> Column:
    """An annotation without its peak count, mass error and alias."""
    bare = F.regexp_replace(annotation, r" ?\d+/\d+$", "")
    return F.split_part(F.split_part(bare, F.lit("/"), F.lit(1)), F.lit("="), F.lit(1))


def parts_of(annotation: Column) -> Column:
    """Signed chunks as structs (sign, body)."""
    chunks = F.regexp_extract_all(annotation, F.lit(r"([+-]?)([^+-]+)"), F.lit(0))
    sign = lambda c: F.when(c.startswith("-"), -1).otherwise(1)
    return F.transform(chunks, lambda c: F.struct(sign(c).alias("sign"), F.regexp_replace(F.regexp_replace(c, "^[+-]", ""), r"\^\d+$", "").alias("body")))


def is_isotope(body: Column) -> Column:
    return body.endswith("i") & ~body.endswith("Si")


def isotope_of(annotation: Column) -> Column:
    """The last isotope number of an annotation, 0 without one."""
    number = lambda p: p["sign"] * F.when(p["body"] == "i", 1).otherwise(F.regexp_replace(p["body"], "i$", "").try_cast("int"))
    return F.aggregate(F.filter(parts_of(annotation), lambda p: is_isotope(p["body"])), F.lit(0), lambda _, p: number(p))


def charge_of(annotation: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(annotation, r"\^(\d+)", 1), F.lit("")).cast("int"), F.lit(1))


def product_of(annotation: Column, precursor: Column) -> Column:
    """Element map of the annotated product; null where a chunk is no formula."""
    none = F.create_map().cast("map<string,int>")

    def chunk(p: Column) -> Column:
        n = F.when(F.regexp_like(p["body"], F.lit(r"^\d")), F.substring(p["body"], 1, 1).cast("int")).otherwise(1) * p["sign"]
        rest = F.regexp_replace(p["body"], r"^\d", "")
        elements = F.when(rest == "p", precursor).otherwise(elements_of(rest))
        return F.transform_values(elements, lambda _, v: v * n)

    return F.aggregate(F.filter(parts_of(annotation), lambda p: ~is_isotope(p["body"])), none, lambda m, p: combined(m, chunk(p)))


def rejection(dset: Column, notes: Column, prec_type: Column, peaks: Column, supported: list[str]) -> Column:
    """Why a spectrum's annotations are not read; null if they are."""
    low = F.lower(F.coalesce(notes, F.lit("")))
    return (
        F.when(~dset.isin(*supported), "dataset not supported").when(F.contains(low, F.lit("glycan")), "glycans not supported").when(F.contains(low, F.lit("peptide")), "peptides not supported")
        .when(~prec_type.isin(*SUPPORTED), "adduct not supported").when(peaks.isNull() | (F.trim(peaks) == ""), "no peaks").when(F.contains(peaks, F.lit("|")), "glycans not supported")
    )


def annotations(spectra: DataFrame, supported: list[str]) -> tuple[DataFrame, DataFrame]:
    """(annotations, rejections) of spectra ``spec_id, dset, notes, prec_type, formula, peaks``.

    Annotations: ``spec_id, peak_mz, product, loss, isotope, exact_mz``. A spectrum with one
    annotation that can't be read is rejected whole.
    """
    s = spectra.withColumn("reason", rejection(F.col("dset"), F.col("notes"), F.col("prec_type"), F.col("peaks"), supported))
    hydrogen = F.create_map(F.lit("H"), F.when(F.col("prec_type") == "[M+H]+", 1).otherwise(-1))
    rows = s.where("reason is null").select("spec_id", combined(elements_of(F.col("formula")), hydrogen).alias("precursor"), F.explode(F.split("peaks", "\n")).alias("line"))
    rows = rows.withColumn("peak_mz", F.split_part("line", F.lit(" "), F.lit(1))).withColumn("text", F.trim(F.regexp_extract("line", r"^\S+ \S+ (.*)$", 1), F.lit('"'))).where("text <> ''")
    each = rows.select("spec_id", "precursor", "peak_mz", F.explode(F.split("text", ";")).alias("a"), F.regexp_like("text", F.lit(PEPTIDE)).alias("peptide"))
    each = each.withColumn("a", F.regexp_replace("a", r" ?\d+/\d+$", "")).where("a not in ('?', 'more')").withColumn("bare", stripped(F.col("a")))
    each = each.withColumn("product", product_of(F.col("bare"), F.col("precursor"))).withColumn("isotope", isotope_of(F.col("bare")))
    mass = mass_of(F.col("product"))
    bad = F.col("peptide") | (F.col("a") == "") | F.col("product").isNull() | F.col("isotope").isNull() | mass.isNull()
    each = each.withColumn("bad", F.coalesce(bad, F.lit(True)))
    broken = each.where("bad").groupBy("spec_id").agg(F.lit("annotation can't be read").alias("reason"))
    good = each.join(broken, "spec_id", "left_anti").select("spec_id", "peak_mz", alphabetic(F.col("product")).alias("product"), alphabetic(combined(F.col("precursor"), F.col("product"), -1)).alias("loss"), "isotope", (mass + F.col("isotope") * NEUTRON).alias("exact_mz"))
    return good, s.where("reason is not null").select("spec_id", "reason").unionByName(broken)
