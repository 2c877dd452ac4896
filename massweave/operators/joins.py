"""Joins on a tolerance: buckets make them equality joins, the exact predicate stays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, near: Column, width: float, how: str = "inner") -> DataFrame:
    """Rows of both sides with equal ``keys`` and ``near``, which must imply ``abs(x - y) <= width``.

    The right side's rows go to one bucket, the left side's to the one or two that their window
    touches, so a pair meets once. Within keys (a spectrum) buckets are wide, and few rows go to two.
    Both sides' column names must differ, but for ``keys``.
    """
    size = width * (8 if keys else 2)
    low, high = F.floor((F.col(x) - width) / size), F.floor((F.col(x) + width) / size)
    a = left.withColumn("_b", F.explode(F.when(low == high, F.array(low)).otherwise(F.array(low, high))))
    b = right.withColumn("_b", F.floor(F.col(y) / size))
    return a.join(b.withColumnsRenamed({k: f"_r_{k}" for k in keys} | {"_b": "_r_b"}), _all([F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_b") == F.col("_r_b"), near]), how).drop("_b", "_r_b", *[f"_r_{k}" for k in keys])


def together(left: DataFrame, right: DataFrame, key: str, x: str, y: str, width: float) -> DataFrame:
    """Rows of both sides (``_left`` tells which) in one window over both, within a key; ``_near``: rows of ``right`` in a frame of ``width`` as structs, ``_r``: a right row's own.

    What is dealt by the key (a spectrum's peaks) isn't dealt again.
    """
    here = width * 1.0001
    a = left.withColumns({"_v": F.col(x).cast("double"), "_left": F.lit(True)})
    b = right.select(key, F.col(y).cast("double").alias("_v"), F.struct(*[c for c in right.columns if c != key]).alias("_r"))
    frame = F.expr(f"collect_list(_r) over (partition by {key} order by _v range between {here!r}D preceding and {here!r}D following)")
    return a.unionByName(b, allowMissingColumns=True).withColumn("_near", frame)


def beside(left: DataFrame, right: DataFrame, key: str, x: str, y: str, near: Column, width: float) -> DataFrame:
    """``band_join`` within a key, by a window over both sides in one order: what is dealt by the key (a spectrum's peaks) isn't dealt again.

    A row of ``left`` gets the rows of ``right`` in a frame of ``width``, so the work follows the pairs in it.
    """
    met = together(left, right, key, x, y, width).where("_left")
    return met.select(*left.columns, F.explode("_near").alias("_one")).select(*left.columns, *[F.col(f"_one.{c}") for c in right.columns if c != key]).where(near)


def spread(df: DataFrame) -> DataFrame:
    """``df`` as a join's side that is sorted and never broadcast: rows made by an explosion are estimated by their source's few bytes."""
    return df.hint("merge")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def window_join(targets: DataFrame, base: DataFrame, x: str, y: str, tolerance: float, relative: bool, keys: list[str] | None = None) -> DataFrame:
    """Every base row (of equal ``keys``, if given) whose ``y`` is within the tolerance (ppm of ``x`` if relative, inclusive) of a target's ``x``.

    Relative windows have buckets of equal ratio, so they fit values of any size; values must then be above 0.
    A crowded bucket is a skewed join key, which adaptive execution splits.
    """
    half = F.col(x) * tolerance * 1e-6 if relative else F.lit(float(tolerance))
    near = (F.col(y) >= F.col(x) - half) & (F.col(y) <= F.col(x) + half)
    if not relative:
        return band_join(targets, base, keys or [], x, y, near, float(tolerance) * 1.0001)
    width = -math.log1p(-tolerance * 1e-6) * 1.0001
    t, b = targets.withColumn("_ln_x", F.ln(x)), base.withColumn("_ln_y", F.ln(y))
    return band_join(t, b, keys or [], "_ln_x", "_ln_y", near, width).drop("_ln_x", "_ln_y")


def at_most(x: str, limit: float, what: str) -> Column:
    """A column as it is, and an error for a value beyond what a bucket's width allows."""
    return F.when(F.col(x) > limit, F.raise_error(F.concat(F.lit(f"{what} beyond {limit}: "), F.col(x).cast("string"))).cast("double")).otherwise(F.col(x))


def nearest(pairs: DataFrame, by: list[str], distance: Column, *ties: str) -> DataFrame:
    """Of the pairs of each ``by`` the one of least distance, ties by columns."""
    order = W.partitionBy(*by).orderBy(distance, *ties)
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def strongest(pairs: DataFrame, by: list[str], ints: str, *ties: str) -> DataFrame:
    return nearest(pairs, by, -F.col(ints), *ties)


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose named column (an id, mass, key, SMILES or formula) is one of the values; the list becomes a table to join with."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"_v {df.schema[column].dataType.simpleString()}").distinct()
    return df.join(wanted, df[column] == wanted["_v"], "left_semi")


def pairs_within(pairs: DataFrame, molecules: DataFrame, ids: DataFrame, sides: tuple[str, str] = ("mol_id_1", "mol_id_2")) -> tuple[DataFrame, DataFrame]:
    """Pairs of which both sides are among ``ids``, and the molecules that are on either side of one."""
    kept = pairs
    for side in sides:
        kept = kept.join(ids.select(F.col("mol_id").alias(side)).distinct(), side, "left_semi")
    used = kept.select(F.col(sides[0]).alias("mol_id")).unionByName(kept.select(F.col(sides[1]).alias("mol_id"))).distinct()
    return kept, molecules.join(used, "mol_id", "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def expand(queries: DataFrame, candidates: DataFrame, key: str, mol: str = "mol_id") -> DataFrame:
    """Each query with every candidate of its target; ``is_sanity`` marks the subset in which the candidate is the target itself."""
    return queries.join(candidates, key).withColumn("is_sanity", F.col(mol) == F.col(key))


def with_conditions(molecules: DataFrame, conditions: DataFrame) -> DataFrame:
    """Molecules times a configured list of conditions, whose size the caller bounds (an error beyond 10,000)."""
    rows = conditions.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 conditions")
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()]) for r in rows])
    return molecules.withColumn("_c", F.explode(listed)).select(*molecules.columns, "_c.*")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows that a report counts before they are dropped."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def mismatches(left: DataFrame, right: DataFrame, key: str, columns: dict[str, float | None]) -> DataFrame:
    """Rows of equal key whose columns differ: as values (None) or by more than a number."""
    r = right.select(key, *[F.col(c).alias(f"{c}_right") for c in columns])
    off = [F.abs(F.col(c) - F.col(f"{c}_right")) > t if t is not None else F.col(c) != F.col(f"{c}_right") for c, t in columns.items()]
    reason = F.array_join(F.filter(F.array(*[F.when(o, F.lit(c)) for o, c in zip(off, columns)]), lambda x: x.isNotNull()), ",")
    return left.join(r, key).withColumn("reason", reason).where("reason <> ''")
