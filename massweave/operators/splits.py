"""Splits by key, folds, samples, weights and packing."""

from __future__ import annotations

import hashlib
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.operators.joins import drop_ids, keep_ids
from massweave.operators.asof import neighbours
from massweave.operators.ordering import hash_order, numbered, unit
from massweave.operators.shared import running


def keyed_split(df: DataFrame, key: str, test: float, val: float, seed: int = 420, total: float = 1.0) -> DataFrame:
    """``df`` with ``split``; all rows of a key go together.

    Keys in a seeded order: the first ``total`` of them take part, of these ceil(n test) are test,
    then ceil(n val) validation, the rest training; others have a null split.
    """
    keys = numbered(df.select(key).distinct().withColumn("_h", hash_order(seed, key)), ["_h", key], "_i")
    n = keys.count()
    used = int(n * total)
    n_test, n_val = -(-int(round(used * test * 1e6)) // 1_000_000), -(-int(round(used * val * 1e6)) // 1_000_000)
    split = F.when(F.col("_i") < n_test, "test").when(F.col("_i") < n_test + n_val, "val").when(F.col("_i") < used, "train")
    return df.join(keys.select(key, split.alias("split")), key)


def folds(df: DataFrame, key: str, test: float) -> DataFrame:
    """``df`` with ``fold``: int(1 / test) runs of the sorted keys, larger ones first."""
    n_folds = int(1 / test)
    keys = numbered(df.select(key).distinct(), [key], "_i")
    n = keys.count()
    size, more = divmod(n, n_folds)
    large = more * (size + 1)
    fold = F.when(F.col("_i") < large, F.floor(F.col("_i") / (size + 1))).otherwise(more + F.floor((F.col("_i") - large) / max(size, 1)))
    return df.join(keys.select(key, fold.cast("int").alias("fold")), key)


def secondary(df: DataFrame, primary: DataFrame, key: str, splits: list[str]) -> DataFrame:
    """Rows whose key is in none of the named splits of the primary data."""
    return drop_ids(df, primary.where(F.col("split").isin(*splits)), key)


def predefined(df: DataFrame, lists: dict[str, DataFrame], key: str, val: float, seed: int = 420) -> DataFrame:
    """``df`` with ``split`` from lists of ids; without a list for training or validation, validation is drawn from the rest."""
    parts = [keep_ids(df, ids, key).withColumn("split", F.lit(name)) for name, ids in lists.items()]
    rest = df
    for ids in lists.values():
        rest = drop_ids(rest, ids, key)
    if "train" not in lists or "val" not in lists:
        parts.append(keyed_split(rest, key, 0.0, val, seed))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.countDistinct("spec_id").alias("n_spec"), F.countDistinct("mol_id").alias("n_mol"), F.countDistinct("group_id").alias("n_group"))


def sampled(df: DataFrame, n: int, *keys: str, seed: int = 420) -> DataFrame:
    """n rows by seeded order."""
    return df.orderBy(hash_order(seed, *keys), *keys).limit(n)


def sample_of_each(df: DataFrame, by: list[str], k: int, *keys: str, seed: int | str = 420) -> DataFrame:
    """At most k rows of each group by a seeded order; another epoch is another seed."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(hash_order(seed, *keys), *keys))).where(F.col("_r") <= k).drop("_r")


def inverse_frequency(by: list[str]) -> Column:
    return 1.0 / F.count("*").over(W.partitionBy(*by))


def weighted_sample(df: DataFrame, n: int, weight: str, *keys: str, seed: int = 420) -> DataFrame:
    """n rows without replacement, with chances by weight: order by -ln(u)/w."""
    return df.withColumn("_e", -F.ln(unit(seed, *keys)) / F.col(weight)).orderBy("_e", *keys).limit(n).drop("_e")


#: Systematic draws take weights in so many parts of the largest, as integers, so that sums are exact in any order.
UNITS = 1 << 40


def first_units(seed: int) -> int:
    """Where in the first step systematic draws begin, in parts of 2 to the 32."""
    return int(hashlib.md5(str(seed).encode()).hexdigest()[:8], 16)


def first_share(seed: int) -> float:
    return first_units(seed) / (1 << 32)


def weighted_draws(df: DataFrame, n: int, weight: str, key: str, seed: int = 420) -> DataFrame:
    """``key, draws``: n draws with replacement by weight, systematically from one seeded start.

    A row is drawn as often as start + i * total / n falls into its stretch of the running weight, in
    the order of weight and seeded hash, so that rows of each weight get their share. Weights are whole
    parts of the largest one (see ``UNITS``); a smaller part than one is none.
    """
    rows = df.select(key, F.col(weight).cast("double").alias("_w"), hash_order(seed, key).alias("_h"))
    top = rows.agg(F.max("_w")).first()[0] or 0.0
    if not top:
        return rows.select(key, F.lit(0).cast("bigint").alias("draws"))
    rows = rows.withColumn("_u", F.coalesce(F.floor(F.col("_w") / top * UNITS), F.lit(0)).cast("decimal(20,0)"))
    total = int(rows.agg(F.sum("_u")).first()[0])
    placed = running(rows, ["_w", "_h", key], _from=F.col("_u"))
    start = total * first_units(seed) // (1 << 32)
    whole = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    at = lambda x: x.cast("decimal(38,0)") * F.lit(str(n)).cast("decimal(20,0)")
    steps = placed.withColumns({"_a": at(F.col("_from")).cast("decimal(38,0)"), "_b": at(F.col("_from") + F.col("_u")).cast("decimal(38,0)")}).withColumns({"_st": whole(start), "_all": whole(total)})
    hits = lambda c: F.when(F.col(c) > F.col("_st"), F.expr(f"({c} - _st + _all - 1) div _all")).otherwise(0)
    return steps.select(key, (hits("_b") - hits("_a")).cast("bigint").alias("draws"))


def independent_draws(df: DataFrame, n: int, weight: str, key: str, seed: int = 420) -> DataFrame:
    """``key, draws``: how often each row comes up in ``n`` independent draws with replacement, by ``weight``; rows that never come up are left out.

    Each draw is a seeded number on the line of running weights, and falls to the last row that begins at or before it, found by a nearest join over ranges.
    """
    rows = df.select(key, F.col(weight).cast("double").alias("_w")).where("_w > 0").withColumn("_h", hash_order(seed, key))
    placed = running(rows, ["_h", key], _from=F.col("_w"))
    total = placed.agg(F.sum("_w")).first()[0]
    if not total or n <= 0:
        return rows.select(key, F.lit(0).cast("bigint").alias("draws")).limit(0)
    spark = df.sparkSession
    draws = spark.range(n).select((unit(f"{seed}+", "id") * F.lit(total)).alias("_u"))
    got = neighbours(draws, placed.select("_from", key), [], "_u", "_from", key).select(F.col(f"before.{key}").alias(key))
    return got.groupBy(key).agg(F.count("*").alias("draws"))


#: Rows in a shard that is packed in one task, on average.
SHARD = 20_000


def shards_for(df: DataFrame, shards: int | None) -> int:
    """The number of shards: as given, or so many that SHARD rows are in one."""
    return shards or max(1, -(-df.count() // SHARD))


def shard_of(seed: int, key: str, shards: int) -> Column:
    return F.pmod(F.conv(F.substring(hash_order(seed, key), 9, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


def greedy_pack(df: DataFrame, key: str, budgets: dict[str, int], shards: int | None = None, drop_oversize: bool = True, flush_every: int | None = None, seed: int = 420) -> DataFrame:
    """``key, shard, batch``: rows packed in a seeded order, each shard on its own, until a budget is full."""
    names, shards = list(budgets), shards_for(df, shards)
    rows = df.select(key, *names, shard_of(seed, key, shards).alias("shard"), hash_order(seed, key).alias("_h"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_h", key])
        batch, used, count, out = 0, dict.fromkeys(names, 0), 0, []
        for row in group[[key, *names]].to_dict("records"):
            large = any(row[c] > budgets[c] for c in names)
            if large and drop_oversize:
                continue
            full = any(used[c] + row[c] > budgets[c] for c in names) or (flush_every is not None and count >= flush_every)
            if count and full:
                batch, used, count = batch + 1, dict.fromkeys(names, 0), 0
            out.append((row[key], batch))
            used = {c: used[c] + row[c] for c in names}
            count += 1
        return pd.DataFrame({key: [k for k, _ in out], "shard": int(group["shard"].iloc[0]), "batch": [b for _, b in out]})

    return rows.groupBy("shard").applyInPandas(pack, f"{key} {df.schema[key].dataType.simpleString()}, shard int, batch int")


def contrastive_batches(sizes: list, groups: list[list], budget: int, ks: tuple[int, int]) -> list[tuple[int, int]]:
    """Places with their batch: a batch takes rows of up to so many groups of each kind, then any, each time the first that fits; its first row always does.

    Rows wait in one line for each size, all oversized ones in one, so that the first that fits is at the head of a line.
    """
    n, out, batch = len(sizes), [], 0
    free, none = bytearray(b"\x01") * n, float("inf")
    kind = [x if x <= budget else none for x in sizes]

    def lines(places) -> dict:
        by_size: dict = {}
        for i in places:
            by_size.setdefault(kind[i], deque()).append(int(i))
        return by_size

    def head(waiting: dict, room) -> int:
        best = n
        for x in [x for x in waiting if x <= room]:
            line = waiting[x]
            while line and not free[line[0]]:
                line.popleft()
            if not line:
                del waiting[x]
            elif line[0] < best:
                best = line[0]
        return best

    every, queues = lines(range(n)), [deque(g) for g in groups]
    while len(out) < n:
        room, taken = budget, 0
        for queue, k in zip(queues, ks):
            done = 0
            while queue and done < k:
                if not isinstance(queue[0], dict):
                    queue[0] = lines(queue[0])
                any_, i = False, head(queue[0], room if taken else none)
                while i < n:
                    any_, free[i], taken = True, 0, taken + 1
                    out.append((i, batch))
                    room -= sizes[i]
                    i = head(queue[0], room)
                if head(queue[0], none) < n:
                    break
                queue.popleft()
                done += any_
        at = -1
        while (i := head(every, room if taken else none)) < n:
            # A full batch ends at the first row after the last one that doesn't fit; only rows of size 0 still do.
            if taken and room <= 0 and any(free[at + 1 : i]):
                break
            free[i], taken, at = 0, taken + 1, i
            out.append((i, batch))
            room -= sizes[i]
        batch += 1
    return out


def contrastive_pack(df: DataFrame, key: str, first: list[str], second: list[str], budget: int, size: str, k1: int, k2: int, shards: int | None = None, seed: int = 420) -> DataFrame:
    """``key, shard, batch``: each batch takes up to k1 whole groups of ``first``, then up to k2 of ``second``, then fills up; each row once.

    Shards are dealt by ``second`` so that a group of it stays together.
    """
    cols, shards = list(dict.fromkeys([*first, *second])), shards_for(df, shards)
    rows = df.select(key, size, *cols, F.pmod(F.xxhash64(*second, F.lit(seed)), F.lit(shards)).cast("int").alias("shard"), hash_order(seed, key).alias("_h"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_h", key], ignore_index=True)
        out = contrastive_batches(group[size].tolist(), [list(group.groupby(c, sort=False, dropna=False).indices.values()) for c in (first, second)], budget, (k1, k2))
        return pd.DataFrame({key: group[key].to_numpy()[[i for i, _ in out]], "shard": int(group["shard"].iloc[0]), "batch": [b for _, b in out]})

    return rows.groupBy("shard").applyInPandas(pack, f"{key} {df.schema[key].dataType.simpleString()}, shard int, batch int")


def by_adduct(df: DataFrame, adducts: list[str]) -> DataFrame:
    """Copies of existing folds restricted to one adduct each, with a ``tag`` for their folder."""
    from massweave.functions.text import adduct_tag

    return df.where(F.col("prec_type").isin(*adducts)).withColumn("tag", adduct_tag(F.col("prec_type")))


def loaded(df: DataFrame) -> dict[str, DataFrame]:
    """The distinct molecules and spectra of each split or fold, as sorted tables ``split, id``."""
    return {c: df.select("split", F.col(c).alias("id")).distinct().orderBy("split", "id") for c in ("mol_id", "spec_id")}


def with_sizes(spectra: DataFrame, sizes: DataFrame, molecules: DataFrame) -> DataFrame:
    """Each spectrum with its molecule's size columns and formula; one whose molecule has none is an error."""
    extra = [c for c in sizes.columns if c != "mol_id"]
    rows = spectra.join(sizes.withColumn("_there", F.lit(True)), "mol_id", "left").join(molecules.select("mol_id", "formula"), "mol_id", "left")
    ok = F.col("_there").isNotNull() & F.col("formula").isNotNull()
    checked = F.when(ok, F.col("mol_id")).otherwise(F.raise_error(F.concat(F.lit("no sizes or formula for molecule "), F.col("mol_id").cast("string"))).cast(spectra.schema["mol_id"].dataType))
    return rows.withColumn("mol_id", checked).select(*spectra.columns, *extra, "formula")


def row_range(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows from place ``first`` to before ``last`` in an order that tells rows apart."""
    return numbered(df, order, "_n").where(F.col("_n").between(first, last - 1)).drop("_n")
