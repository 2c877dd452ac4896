"""Structured Streaming jobs: moments, packing, first occurrence, windows, sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_moments(events: DataFrame, by: list[str], x: str, weight: str | None = None) -> DataFrame:
    """Sums from which mean and deviation follow, in update or complete mode; an epoch among ``by`` resets them."""
    w = F.col(weight) if weight else F.lit(1.0)
    return events.groupBy(*by).agg(F.count(x).alias("n"), F.sum(w).alias("sum_w"), F.sum(w * F.col(x)).alias("sum_wx"), F.sum(w * F.col(x) * F.col(x)).alias("sum_wxx"))


def first_seen(events: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; with a time, state is kept only for the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if time else events.dropDuplicates(keys)


def tumbling(events: DataFrame, time: str, by: list[str], x: str, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts and means in windows of event time."""
    g = events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"))
    return g.select(F.col("w.start").alias("start"), *by, "n", "mean")


def packed(events: DataFrame, key: str, size: str, budget: int, shards: int = 8, drop_oversize: bool = False, flush: str = "flush", idle_ms: int | None = None) -> DataFrame:
    """Batches ``shard, batch, ids, total`` closed by a budget; the open batch of a shard is its state.

    A row whose ``flush`` column is true closes its shard's open batch (as the end of a stream does) after
    all other rows of its micro-batch; rows of later micro-batches open new ones. In a long-running query ``idle_ms`` without rows does so too.
    """
    rows = events.select(F.col(key).cast("long").alias("id"), F.col(size).cast("long").alias("size"), F.col(flush).alias("flush"), F.pmod(F.col("shard") if "shard" in events.columns else F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"))

    def step(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, ids, total = state.get if state.exists else (0, [], 0)
        ids, out = list(ids), []

        def close():
            nonlocal number, ids, total
            if ids:
                out.append((key_[0], number, ids, total))
                number, ids, total = number + 1, [], 0

        if state.hasTimedOut:
            close()
        else:
            # A micro-batch's rows of a shard come in several pieces: all of them before any flush.
            rows_ = pd.concat(list(batches), ignore_index=True)
            for i, s, end in rows_.sort_values(["flush", "id"])[["id", "size", "flush"]].itertuples(index=False):
                if end:
                    close()
                    continue
                if s > budget and drop_oversize:
                    continue
                if ids and total + s > budget:
                    close()
                ids.append(int(i))
                total += int(s)
        state.update((number, ids, total))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["shard", "batch", "ids", "total"])

    return rows.groupBy("shard").applyInPandasWithState(step, "shard int, batch long, ids array<long>, total long", "batch long, ids array<long>, total long", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def to_files(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes each micro-batch to a folder of its own below ``path`` (read back with its number as ``batch_id``); a batch that is tried again replaces what it wrote."""
    writer = rows.writeStream.foreachBatch(written_once(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def written_once(path: str):
    """A batch function whose repetition leaves a batch's rows once."""
    return lambda df, batch_id: df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
