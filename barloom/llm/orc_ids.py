"""Token ids as ORC files in document order.

Stripes hold ids with integer run-length encoding, row indexes and a Bloom filter on doc_id. Files follow one another
in doc_id order, so a range of documents is a range of files and stripes, and a lookup by doc_id skips stripes and row
groups by their statistics and filters. Each stripe can be read by a task of its own.

Null texts are empty documents and hold the end id alone; null doc_ids sort first. Rows of one doc_id follow one
another in text order. An empty table gives no files' rows. Other columns of the input are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import batch_encoder, joined_batches, small_batches
from barloom.session import shared_dir

LAYOUT = "doc_id long, ids array<int>, first long, part int"
#: Words a worker keeps, and bytes of text it encodes at a time: this job holds little else.
MEMO_WORDS, TEXT_BYTES = 300_000, 2 << 20
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
    "compression": "zstd",
}


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col="doc_id", text_col="text", memo_words: int = MEMO_WORDS) -> None:
    """Write the ids of every document, its end id behind them, in ascending doc_id order.

    ``memo_words`` bounds the words whose ids a Python worker keeps, and so its memory; the ids do not depend on it."""
    small_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def encoded(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, first, part = batch_encoder(tokenizer, end, memo_words), 0, TaskContext.get().partitionId()
        for batch in joined_batches(batches, 1, TEXT_BYTES):
            flat, sizes = encode.batch(batch.column(1))
            ends = np.cumsum(sizes)
            flat = pa.array(flat.astype(np.int32))
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array(first + ends - sizes), pa.array(np.full(len(sizes), part, np.int32))],
                names=["doc_id", "ids", "first", "part"],
            )
            first += int(ends[-1]) if len(ends) else 0

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange(parts, "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    ordered.mapInArrow(encoded, LAYOUT).write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids, start: the number of ids in all documents before it. File totals are one row per file."""
    rows = spark.read.schema(LAYOUT).orc(path)
    files = rows.groupBy("part").agg(F.max(F.col("first") + F.size("ids")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # one row per file
    starts = files.select("part", (F.sum("n").over(before) - F.col("n")).alias("base"))
    return rows.join(starts, "part").select("doc_id", "ids", (F.col("base") + F.col("first")).alias("start"))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id; the filter reaches the files, which skip row groups by statistics and Bloom filters."""
    return spark.read.schema(LAYOUT).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document read back: doc_id, start, n_tokens and the crc32 of its ids as little-endian uint32."""
    small_batches(spark)
    rows = spark.read.schema(LAYOUT).orc(path)

    def crc(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(1)
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = ids.offsets.to_numpy(zero_copy_only=False)
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "first", "part", "n_tokens", "ids_crc32"],
            )

    thin = rows.mapInArrow(crc, "doc_id long, first long, part int, n_tokens long, ids_crc32 long")
    files = rows.groupBy("part").agg(F.max(F.col("first") + F.size("ids")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # one row per file
    starts = files.select("part", (F.sum("n").over(before) - F.col("n")).alias("base"))
    return thin.join(starts, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/barloom/orc-{uuid.uuid4().hex}"
