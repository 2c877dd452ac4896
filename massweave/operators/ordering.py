"""Places in a global order without a task that sees every row; orders by seeded hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.operators.shared import running

#: Rows that one task may number; more are dealt by range over all columns of the order.
ALONE = 50_000


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with each row's place in the order of ``order`` (which must tell rows apart)."""
    if df.count() <= ALONE:
        return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("bigint") - 1 + start)
    return running(df, order, **{name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) + start)


def hash_order(seed: int | str, *keys: str) -> Column:
    """A seeded order that any engine can give: md5 of the keys and the seed as text."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def unit(seed: int | str, *keys: str) -> Column:
    """A seeded number in (0, 1) for each row: the first 8 hex digits of the hash order."""
    return (F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
