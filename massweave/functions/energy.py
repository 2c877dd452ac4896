"""Collision energies: from text, between absolute and normalised, and as lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(\d+\.?\d*)"
#: Texts that hold an absolute energy, the number in the group.
ABSOLUTE = (rf"^{NUMBER}$", rf"^{NUMBER} ?eV$", rf"^NCE=\d+\.?\d*% {NUMBER}eV$", rf"^{NUMBER}HCD$", rf"^CE {NUMBER}$")
#: Texts that hold a normalised energy.
NORMALISED = (
    rf"^NCE={NUMBER}% \d+\.?\d*eV$", rf"^NCE={NUMBER}%$", r"^(\d+)% resonant relative/normalized$", rf"^{NUMBER} ?%? \(nominal\)$",
    rf"^HCD {NUMBER}%$", rf"^{NUMBER} NCE$", rf"^{NUMBER}\(NCE\)$", rf"^{NUMBER} ?%$", rf"^HCD \(NCE {NUMBER}%\)$",
)
#: Factor by charge; a larger charge counts as five.
CHARGE_FACTORS = {1: 1.0, 2: 0.9, 3: 0.85, 4: 0.8, 5: 0.75}


def first_number(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]).cast("double")


def absolute_energy(text: Column) -> Column:
    return first_number(text, ABSOLUTE)


def normalised_energy(text: Column) -> Column:
    return first_number(text, NORMALISED)


def listed_energy(text: Column) -> Column:
    """Struct (text, normalized, ramped) from energy texts with ``normalized=True`` and ``ramped=True`` marks; null is ("", false, false)."""
    normalized, ramped = F.contains(text, F.lit("normalized=True")), F.contains(text, F.lit("ramped=True"))
    number = F.split_part(text, F.lit(" "), F.lit(1))
    canonical = F.when(normalized, F.concat(F.lit("NCE="), number, F.lit("%"))).otherwise(F.concat(number, F.lit(" eV")))
    return F.struct(F.coalesce(canonical, F.lit("")).alias("text"), F.coalesce(normalized, F.lit(False)).alias("normalized"), F.coalesce(ramped, F.lit(False)).alias("ramped"))


def argument_energy(text: Column) -> Column:
    """Struct (value, unit) from ``10.0eV``, ``20%`` or ``30NCE``; another text is an error."""
    number = F.nullif(F.regexp_extract(text, rf"^{NUMBER}(eV|%|NCE)$", 1), F.lit(""))
    unit = F.when(text.endswith("eV"), F.lit("ace")).otherwise(F.lit("nce"))
    return F.when(number.isNull(), F.raise_error(F.concat(F.lit("not an energy: "), text))).otherwise(F.struct(number.cast("double").alias("value"), unit.alias("unit")))


def charge_of(prec_type: Column) -> Column:
    """Signed charge of an adduct text; ``EI`` is 1, a text without a charge null."""
    size = F.regexp_extract(prec_type, r"\](\d*)[+-]$", 1)
    sign = F.when(prec_type.endswith("-"), -1).otherwise(1)
    number = F.when(F.regexp_like(prec_type, F.lit(r"\]\d*[+-]$")), F.when(size == "", 1).otherwise(size.cast("int")) * sign)
    return F.when(prec_type == "EI", 1).otherwise(number)


def charge_factor(charge: Column) -> Column:
    size = F.abs(charge)
    out = F.lit(CHARGE_FACTORS[5])
    for k in (4, 3, 2, 1):
        out = F.when(size == k, CHARGE_FACTORS[k]).otherwise(out)
    return out


def to_absolute(nce: Column, charge: Column, prec_mz: Column) -> Column:
    return nce * prec_mz * charge_factor(charge) / 500.0


def to_normalised(ace: Column, charge: Column, prec_mz: Column) -> Column:
    return ace * 500.0 / (prec_mz * charge_factor(charge))


def present(energy: Column) -> Column:
    """An energy, or null where it is missing (null, NaN or -1)."""
    return F.when(~F.isnan(energy) & (energy != -1), energy)


def filled_normalised(nce: Column, ace: Column, charge: Column, prec_mz: Column) -> Column:
    return F.coalesce(present(nce), to_normalised(present(ace), charge, prec_mz))


def filled_absolute(ace: Column, nce: Column, charge: Column, prec_mz: Column) -> Column:
    return F.coalesce(present(ace), to_absolute(present(nce), charge, prec_mz))


def energy_kind(main: Column, extra_1: Column, extra_2: Column) -> Column:
    """none, single, ramped (one extra) or stepped (two)."""
    return F.when(main.isNull(), "none").when(extra_2.isNotNull(), "stepped").when(extra_1.isNotNull(), "ramped").otherwise("single")


def energy_list(main: Column, extra_1: Column, extra_2: Column) -> Column:
    """One, three (stepped), or the range by steps of one up to the upper value (ramped)."""
    steps = F.floor(extra_1 + 0.1 - main + F.when(F.floor(extra_1 + 0.1 - main) == extra_1 + 0.1 - main, -1).otherwise(0)).cast("int")
    ramp = F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), lambda i: main + i)
    return F.when(main.isNull(), F.array().cast("array<double>")).when(extra_2.isNotNull(), F.array(main, extra_1, extra_2)).when(extra_1.isNotNull(), ramp).otherwise(F.array(main))


def energy_moments(energies: Column) -> Column:
    """Struct (mean, std, valid) of a list; zeros for an empty one."""
    n = F.size(energies)
    mean = F.aggregate(energies, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(energies, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return F.struct(F.when(n > 0, mean).otherwise(0.0).alias("mean"), F.when(n > 0, F.sqrt(var)).otherwise(0.0).alias("std"), (n > 0).alias("valid"))


def scaled(x: Column, mean: float, std: float) -> Column:
    """z-score; negatives (missing) pass."""
    return F.when(x < 0, x).otherwise((x - mean) / (std + 1e-8))


def unscaled(z: Column, mean: float, std: float) -> Column:
    return z * (std + 1e-8) + mean


def min_max(x: Column, low: float, high: float) -> Column:
    return (x - low) / (high - low + 1e-8)


def from_min_max(y: Column, low: float, high: float) -> Column:
    return y * (high - low + 1e-8) + low
