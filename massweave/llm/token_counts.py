"""Token counts of whole texts: Arrow functions that return lengths only.

Batches are balanced by bytes; every text is split where no token can cross (before a single space
between other characters), distinct pieces are encoded once a task and the lengths are added up.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows keep their ``doc_id`` (null,
repeated or not); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massweave.llm.arrow import by_bytes, table
from massweave.llm.common import small_batches
from massweave.llm.tokens import PieceCounter, vocabulary

VOCABULARY = "piece_bpe_32k.model"
#: A text of more tokens than this is over the limit.
LIMIT = 4096


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row; ``path``: the sentencepiece model, else the public one."""

    def count(batches):
        counter, schema = PieceCounter(path or vocabulary(VOCABULARY)), None
        for batch, texts in by_bytes(batches):
            schema = schema or pa.schema([batch.schema.field("doc_id"), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
            yield table(schema, doc_id=batch.column("doc_id"), n_bytes=batch.column("n_bytes"), n_tokens=counter.counts(texts))

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = small_batches(rows).mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
