"""Records of many lines from text files of any size, read in parts.

Spark cuts files at any byte and gives each task whole lines. A task joins the lines of its part to records. What may belong to a
record that is cut, the first and the last piece of each part, is put together by file; these few pieces come from a read of their
own, so the text itself is never shuffled, cached or written. Line ends of any kind, also mixed ones, are the text source's business.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What ends a record, as a pattern of its last line; the line itself goes.
BLANK, IONS, COMPOUND = r"^\s*$", r"^\s*END IONS\s*$", r"^\s*\$\$\$\$\s*$"


def records(spark: SparkSession, path: str | list[str], end: str = BLANK) -> DataFrame:
    """``file, value``: one record a row, its lines joined by a line feed, without the line that ends it; blank records go."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), "value")
    fields = pa.schema([("file", pa.string()), ("block", pa.int64()), ("nth", pa.int64()), ("closed", pa.bool_()), ("value", pa.string())])

    def pieces(whole: bool):
        """Records that lie whole in a part, or the pieces before its first end and after its last."""

        def rows(part, nth: int, closed: bool, values: pa.Array) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part[0], pa.string()), n), pa.repeat(pa.scalar(part[1], pa.int64()), n), pa.array(range(nth, nth + n), pa.int64()), pa.repeat(pa.scalar(closed), n), values], schema=fields)

        def text(*parts: pa.Array) -> pa.Array:
            return pa.array(["\n".join(x for p in parts for x in p.to_pylist())], pa.string())

        def assemble(batches):
            # ``held``: lines since the last end; a batch's records are cut out of it by the places of its ends, not line by line.
            part, nth, held, first = None, 0, [], True
            for batch in batches:
                file, block, value = (batch.column(c) for c in ("file", "block", "value"))
                ends = pc.match_substring_regex(value, end).to_numpy(zero_copy_only=False)
                new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(value)]
                for a, b in zip(edges, edges[1:]):
                    if a == b:
                        continue
                    if (own := (file[a].as_py(), block[a].as_py())) != part:
                        if part and not whole:
                            yield rows(part, nth, False, text(*held))
                        part, nth, held, first = own, 0, [], True
                    at = np.flatnonzero(ends[a:b]) + a
                    if not len(at):
                        if not (whole and first):
                            held.append(value[a:b])
                        continue
                    if first != whole:
                        yield rows(part, nth, True, text(*held, value[a : at[0]]))
                    if whole and len(at) > 1:
                        inside = value[at[0] + 1 : at[-1] + 1].filter(pa.array(~ends[at[0] + 1 : at[-1] + 1]))
                        offsets = np.concatenate([[0], np.cumsum(np.diff(at) - 1)]).astype(np.int32)
                        yield rows(part, nth + 1, True, pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), inside), "\n"))
                    nth, held, first = nth + len(at), [value[at[-1] + 1 : b]], False
            if part and not whole:
                yield rows(part, nth, False, text(*held))

        return lines.mapInArrow(assemble, "file string, block bigint, nth bigint, closed boolean, value string")

    earlier = W.partitionBy("file").orderBy("block", "nth").rowsBetween(W.unboundedPreceding, -1)
    cut = pieces(False).withColumn("record", F.coalesce(F.sum(F.col("closed").cast("int")).over(earlier), F.lit(0)))
    in_order = F.array_sort(F.collect_list(F.struct("block", "nth", "value")))
    joined = F.array_join(F.transform(F.filter(in_order, lambda p: p["value"] != ""), lambda p: p["value"]), "\n")
    stitched = cut.groupBy("file", "record").agg(joined.alias("value")).select("file", "value")
    return pieces(True).select("file", "value").unionByName(stitched).where(F.regexp_like("value", F.lit(r"\S")))
