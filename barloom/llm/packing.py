"""Best-two-fit packing of token sequences.

Documents become token pieces of at most ``capacity`` ids; only longer documents are cut, with the remainder first. How
many pieces there are of each length (at most ``capacity`` rows) is all the packing needs: it fills a bin greedily with
the largest pieces that fit, then replaces the bin's smallest piece by two unpacked ones that fill its gap more tightly.
A bin's pattern is repeated as long as its lengths last, so the plan is a short table of runs. Pieces find their place
by their rank among the pieces of their length, and no text or id list is shuffled.

Null texts are empty documents: one piece holding the end id alone. Ties and repeated rows are separate pieces. An
empty table packs into no sequence. Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import MEMO_WORDS, encoder, small_batches, written

PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, nth long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col="doc_id", text_col="text", memo_words: int = MEMO_WORDS) -> DataFrame:
    """One row per piece: ids (little-endian uint32), and its rank ``nth`` among the task's pieces of its length.

    ``memo_words`` bounds the words whose ids a Python worker keeps, and so its memory; the ids do not depend on it."""
    small_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, seen, part = encoder(tokenizer, end, memo_words), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()),
                            ("ids", pa.binary()), ("part", pa.int32()), ("nth", pa.int64())])
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text)
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                start, piece = 0, 0
                while start < n:
                    size = first if piece == 0 else capacity
                    rows.append((doc, piece, start, size, ids[4 * start : 4 * (start + size)], part, int(seen[size])))
                    seen[size] += 1
                    start, piece = start + size, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, PIECES)


def two_fit_runs(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, pieces a sequence, offset) that place every counted piece."""
    left, runs, rank, sequence = counts.astype(np.int64).copy(), [], np.zeros(capacity + 1, np.int64), 0
    index = np.arange(capacity + 1)
    while left.any():
        used: dict[int, int] = {}
        gap, rest = capacity, left.copy()
        below = np.maximum.accumulate(np.where(rest > 0, index, 0))
        while gap and (size := int(below[gap])):
            take = min(int(rest[size]), gap // size)
            used[size] = used.get(size, 0) + take
            rest[size] -= take
            gap -= take * size
            if rest[size] == 0:
                below = np.maximum.accumulate(np.where(rest > 0, index, 0))
        while gap and sum(used.values()) > 1 and rest.any():
            small = min(used)
            room = gap + small
            below = np.maximum.accumulate(np.where(rest > 0, index, 0))
            one = np.flatnonzero(rest[: room + 1])
            one = one[one < room]
            if not len(one):
                break
            two = below[np.minimum(one, room - one)]
            lone = (two == one) & (rest[one] < 2)
            two = np.where(lone, below[np.maximum(two - 1, 0)], two)
            best = int(np.argmax(np.where(two > 0, one + two, 0)))
            if two[best] == 0 or one[best] + two[best] <= small:
                break
            used[small] -= 1
            rest[small] += 1
            if not used[small]:
                del used[small]
            for size in (int(one[best]), int(two[best])):
                used[size] = used.get(size, 0) + 1
                rest[size] -= 1
            gap = room - int(one[best] + two[best])
        times = min(int(left[s]) // n for s, n in used.items())
        offset = 0
        for size in sorted(used, reverse=True):
            n = used[size]
            runs.append((size, rank[size], times * n, sequence, n, offset))
            rank[size] += times * n
            left[size] -= times * n
            offset += n * size
        sequence += times
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces."""
    spark = pieces.sparkSession
    sizes = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    runs = spark.sparkContext.broadcast(two_fit_runs(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.withColumn("rank0", F.sum("n").over(before) - F.col("n")).drop("n")
    schema = pieces.drop("part", "nth").schema.fieldNames()
    ranked = pieces.join(starts, ["part", "length"]).select(*schema, (F.col("rank0") + F.col("nth")).alias("rank"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)

    def place(batches):
        import pyarrow as pa

        table = runs.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            top = int(table[:, 1].max(initial=0)) + int(rank.max(initial=0)) + 1
            at = np.searchsorted(table[:, 0] * top + table[:, 1], length * top + rank, side="right") - 1
            run, k = table[at], rank - table[at, 1]
            out = [batch.column(c) for c in schema]
            out += [pa.array(run[:, 3] + k // np.maximum(run[:, 4], 1)), pa.array(run[:, 5] + (k % np.maximum(run[:, 4], 1)) * length)]
            yield pa.RecordBatch.from_arrays(out, names=[*schema, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col="doc_id", text_col="text") -> DataFrame:
    """Packed pieces: doc_id, piece, start, length, ids, sequence_id, offset. The pieces are a table in the shared folder."""
    pieces = written(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col))
    return pack(pieces, capacity)


def digest(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, memo_words: int = MEMO_WORDS) -> DataFrame:
    """As ``pack_documents`` with the crc32 of a piece's ids in place of the ids."""
    pieces = written(token_pieces(docs, tokenizer, end_id, capacity, memo_words=memo_words))
    thin = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(thin, capacity).withColumn("length", F.col("length").cast("long"))
