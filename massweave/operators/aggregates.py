"""Grouped aggregates beyond the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.operators.shared import running

TINY = 1e-7


def lse(df: DataFrame, by: list[str], x: str, name: str = "lse") -> DataFrame:
    """Log-sum-exp by group, shifted by the group's maximum."""
    top = df.withColumn("_m", F.max(x).over(W.partitionBy(*by)))
    return top.groupBy(*by).agg((F.max("_m") + F.ln(F.sum(F.exp(F.col(x) - F.col("_m"))))).alias(name))


def log_mean_exp(df: DataFrame, by: list[str], x: str, name: str = "lme") -> DataFrame:
    top = df.withColumn("_m", F.max(x).over(W.partitionBy(*by)))
    return top.groupBy(*by).agg((F.max("_m") + F.ln(F.sum(F.exp(F.col(x) - F.col("_m")))) - F.ln(F.count("*").cast("double"))).alias(name))


def masked_softmax(df: DataFrame, by: list[str], x: str, mask: Column, name: str = "p") -> DataFrame:
    """``df`` with the softmax over the rows of each group where ``mask`` holds; 0 elsewhere."""
    w = W.partitionBy(*by)
    rows = df.withColumn("_x", F.when(mask, F.col(x)))
    rows = rows.withColumn("_e", F.exp(F.col("_x") - F.max("_x").over(w)))
    return rows.withColumn(name, F.coalesce(F.col("_e") / F.sum("_e").over(w), F.lit(0.0))).drop("_x", "_e")


def reduced(df: DataFrame, groups: DataFrame, by: str, x: str, how: str, default: float = 0.0) -> DataFrame:
    """``sum, amax, amin, mean`` or ``prod`` of each group; groups without rows get the default."""
    fs = {"sum": F.sum, "amax": F.max, "amin": F.min, "mean": F.avg, "prod": F.product}
    if how not in fs:
        raise ValueError(f"unknown reduction {how}")
    got = df.groupBy(by).agg(fs[how](x).alias(x))
    return groups.select(by).distinct().join(got, by, "left").fillna({x: default})


def variance(df: DataFrame, by: list[str], x: str, correction: int = 1, sqrt: bool = False, name: str = "var") -> DataFrame:
    """Variance (or its root) of each group over its count less the correction; a count that leaves nothing counts as almost 0."""
    v = F.var_pop(x) * F.count(x) / F.greatest(F.count(x) - correction, F.lit(TINY))
    return df.groupBy(*by).agg((F.sqrt(v) if sqrt else v).alias(name))


def vocabulary(*tables: DataFrame, column: str = "formula", name: str = "idx") -> DataFrame:
    """The distinct values of a column over several tables, with their places from 0."""
    from massweave.operators.ordering import numbered

    every = tables[0].select(column)
    for t in tables[1:]:
        every = every.unionByName(t.select(column))
    return numbered(every.distinct(), [column], name)


def rebased(df: DataFrame, by: list[str], ids: str, name: str) -> DataFrame:
    """``df`` with its ids renumbered from 0 without gaps in each group."""
    return df.withColumn(name, F.dense_rank().over(W.partitionBy(*by).orderBy(ids)) - 1)


def average_rank(score: str, by: list[str]) -> Column:
    """Rank by falling score; ties share the average of their places."""
    place = F.rank().over(W.partitionBy(*by).orderBy(F.col(score).desc()))
    return place + (F.count("*").over(W.partitionBy(*by, score)) - 1) / 2.0


def dense_ids(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """``df`` with the place of its key among the sorted distinct keys, from 0.

    Distinct keys are dealt by range; each task numbers its own and starts at the sum of the counts
    before it, so no task sees all keys.
    """
    from massweave.operators.ordering import numbered

    return df.join(numbered(df.select(*key).distinct(), key, name), key)


def weighted_moments(df: DataFrame, by: list[str], x: str, w: Column) -> DataFrame:
    """Weighted mean, standard deviation and sums: all from three sums, so partial results add up."""
    v = df.withColumn("_w", w)
    sums = v.groupBy(*by).agg(F.count(x).alias("n"), F.sum("_w").alias("sum_w"), F.sum(F.col("_w") * F.col(x)).alias("sum_wx"), F.sum(F.col("_w") * F.col(x) * F.col(x)).alias("sum_wxx"))
    return moments(sums)


def moments(sums: DataFrame) -> DataFrame:
    mean = F.col("sum_wx") / F.col("sum_w")
    return sums.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.col("sum_wxx") / F.col("sum_w") - mean * mean, F.lit(0.0))))


def pearson(x: str, y: str, exact: bool = False) -> Column:
    """Correlation; by default with the mean of products over sample deviations, that is times (n - 1) / n."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return F.corr(x, y) if exact else F.corr(x, y) * (n - 1) / n


def same_group(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join on the keys of a grouping, in which null is a key like any other."""
    on = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in by]
    return left.alias("_l").join(right.alias("_r"), on, how).select("_l.*", *[F.col(f"_r.{c}") for c in right.columns if c not in by])


def quantiles(df: DataFrame, by: list[str], x: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, between neighbours in proportion; nulls don't count.

    Distinct values are counted first and placed by a running sum over ranges, so no state holds a group's values.
    """
    if not by:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], x, wanted).drop("_all")
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_c"))
    placed = running(counts, [*by, "_x"], _n=F.col("_c"))
    sizes = placed.groupBy(*by).agg(F.min("_n").alias("_first"), F.sum("_c").alias("_size"))
    rows = same_group(placed, sizes, by)
    low = F.col("_n") - F.col("_first")
    out = []
    for name, q in wanted.items():
        at = (F.col("_size") - 1) * F.lit(float(q))
        value = lambda place: F.max(F.when((low <= place) & (place < low + F.col("_c")), F.col("_x")))
        out.append((value(F.floor(at)) + (value(F.ceil(at)) - value(F.floor(at))) * F.max(at - F.floor(at))).alias(name))
    return rows.groupBy(*by).agg(*out)


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: count, mean, std, min, quartiles, max."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))
    rows = df.select(parts.alias("p")).select("p.column", "p.x")
    sums = rows.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.count_if(F.col("x").isNull()).alias("nulls"))
    found = quantiles(rows, ["column"], "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return sums.join(found, "column", "left").select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max", "nulls")


def stratified(df: DataFrame, by: list[str], x: str, least: int) -> DataFrame:
    """Count, median, mean, deviation, half a 95 % interval and range of a value in each stratum of at least so many rows."""
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), (1.96 * F.stddev_samp(x) / F.sqrt(F.count("*"))).alias("ci95"), F.min(x).alias("min"), F.max(x).alias("max")).where(F.col("n") >= least)
    return same_group(sums, quantiles(df, by, x, {"median": 0.5}), by, "left")


def group_counts(grouped: DataFrame, group: str = "group_id", outer: str = "mol_id") -> DataFrame:
    """``grouped`` with ``spec_per_group, groups_per_mol, spec_per_mol``."""
    g = grouped.groupBy(group).agg(F.count("*").alias("spec_per_group"))
    m = grouped.groupBy(outer).agg(F.countDistinct(group).alias("groups_per_mol"), F.count("*").alias("spec_per_mol"))
    return grouped.join(g, group).join(m, outer)


def one_of_each(df: DataFrame, by: list[str], key: str, size: str) -> DataFrame:
    """``first, last, best``: of each group the smallest and the largest key, and the key of the largest row (the smaller one on ties)."""
    return df.groupBy(*by).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.min_by(key, F.struct(-F.col(size), F.col(key))).alias("best"))


def by_seed(df: DataFrame, by: list[str], seed: str, x: str) -> DataFrame:
    """Mean of each seed first, then mean and sample deviation over seeds."""
    return df.groupBy(*by, seed).agg(F.avg(x).alias("_x")).groupBy(*by).agg(F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.count("*").alias("seeds"))


def best(df: DataFrame, by: list[str], epoch: str, x: str, smallest: bool) -> DataFrame:
    """The best value of a metric and the first epoch that has it."""
    pick = F.min_by if smallest else F.max_by
    value = F.min(x) if smallest else F.max(x)
    return df.groupBy(*by).agg(value.alias("best"), pick(epoch, F.struct(F.col(x), (-F.col(epoch) if not smallest else F.col(epoch)))).alias("epoch"))


def mass_range(mass: Column) -> Column:
    """Label of the range; lower bound out, upper in."""
    edges = [0, 200, 300, 400, 500, 600, 700, 2000]
    out = F.lit(None).cast("string")
    for a, b in reversed(list(zip(edges, edges[1:]))):
        out = F.when((mass > a) & (mass <= b), f"{a}-{b}").otherwise(out)
    return out


def merged_by(df: DataFrame, keys: list[str], how: dict[str, str]) -> DataFrame:
    """One row for each key, each value column by ``sum, min, mean, amax`` or ``lse``."""
    plain = {"sum": F.sum, "min": F.min, "mean": F.avg, "amax": F.max}
    tops = {c: F.max(c).over(W.partitionBy(*keys)) for c, h in how.items() if h == "lse"}
    if unknown := set(how.values()) - {*plain, "lse"}:
        raise ValueError(f"unknown aggregates {sorted(unknown)}")
    df = df.withColumns({f"_m_{c}": t for c, t in tops.items()})
    return df.groupBy(*keys).agg(*[(F.max(f"_m_{c}") + F.ln(F.sum(F.exp(F.col(c) - F.col(f"_m_{c}"))))).alias(c) if h == "lse" else plain[h](c).alias(c) for c, h in how.items()])
