"""Best-fit-decreasing sharding of indivisible groups.

A group is one distinct text with all its copies and goes to one shard. Groups of at least ``1 / fine`` of a shard are
few (at most shards times ``fine``); sorted by size, each enters the tightest remaining capacity that holds it, found in
a balanced tree. The rest are far smaller than any gap, so best fit fills the tightest gap with them until it is full,
then the next: each gap takes a stretch of their running size in descending size classes, found by two distributed sums.

Null texts are one group of size-16 rows. Ties and repeated rows are told apart by their place in the input. An empty
table gives an empty result. A group above the even share gets a shard of its own and the rest share what is left.
Input columns other than doc_id and text are not read, so names cannot clash.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bucket_of, running, written

#: Size classes of one eighth of an octave for groups that are placed by running size.
CLASSES_AN_OCTAVE = 8


class GapTree:
    """Treap of (remaining capacity, bin): the tightest gap that holds a size, in logarithmic time."""

    def __init__(self):
        self.root, self.rng = None, random.Random(7)

    @staticmethod
    def _split(node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = GapTree._split(node[2], key)
            return node, right
        left, node[1] = GapTree._split(node[1], key)
        return left, node

    @staticmethod
    def _join(a, b):
        if a is None or b is None:
            return a or b
        if a[3] < b[3]:
            a[2] = GapTree._join(a[2], b)
            return a
        b[1] = GapTree._join(a, b[1])
        return b

    def add(self, gap: int, bin_: int) -> None:
        left, right = self._split(self.root, (gap, bin_))
        self.root = self._join(self._join(left, [(gap, bin_), None, None, self.rng.random()]), right)

    def drop(self, gap: int, bin_: int) -> None:
        left, right = self._split(self.root, (gap, bin_))
        _, right = self._split(right, (gap, bin_ + 1))
        self.root = self._join(left, right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest gap of at least ``size``."""
        left, right = self._split(self.root, (size, -1))
        found, node = None, right
        while node is not None:
            found, node = node[0], node[1]
        if found is not None:
            _, right = self._split(right, (found[0], found[1] + 1))
        self.root = self._join(left, right)
        return found


def best_fit_decreasing(sizes: list[int], capacity: int, bins: int | None = None) -> tuple[list[int], list[int]]:
    """(bin of each size, remaining capacity of each bin) for sizes in descending order.

    With ``bins`` None, bins are opened as needed and their number is what best fit minimises; else there are that many
    and a size that fits nowhere goes to the emptiest one.
    """
    tree, gaps, out = GapTree(), [], []
    for b in range(bins or 0):
        gaps.append(capacity)
        tree.add(capacity, b)
    for size in sizes:
        found = tree.take(size)
        if found is None:
            if bins is None:
                gaps.append(max(capacity, size))
                found = (gaps[-1], len(gaps) - 1)
            else:
                b = int(np.argmax(gaps))
                tree.drop(gaps[b], b)
                found = (gaps[b], b)
        gaps[found[1]] = found[0] - size
        tree.add(gaps[found[1]], found[1])
        out.append(found[1])
    return out, gaps


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), text_crc32, the group key and a place, without the text."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), text), F.lit("")).cast("binary"))).alias("grp"),
        F.monotonically_increasing_id().alias("nth"),
    )


def shard_groups(rows: DataFrame, shards: int, fine: int = 500) -> DataFrame:
    """(grp, shard) of a written table from ``sized``: group sums near equal across ``shards``."""
    groups = written(rows.groupBy("grp").agg(F.sum("size").alias("bytes")))
    total = int(groups.agg(F.sum("bytes")).first()[0] or 0)
    share = -(-total // shards)
    limit = max(1, share // fine)
    large = groups.where(F.col("bytes") >= limit)  # at most shards * fine rows
    named = [(r["bytes"], bytes(r["grp"])) for r in large.toLocalIterator()]
    named.sort(key=lambda x: (-x[0], x[1]))
    # Groups above the even share of what is left stand alone.
    alone, left, n = 0, total, shards
    while alone < len(named) and n > 1 and named[alone][0] * n > left:
        left -= named[alone][0]
        n -= 1
        alone += 1
    capacity = -(-left // n)
    places, gaps = best_fit_decreasing([s for s, _ in named[alone:]], capacity, n)
    chosen = [(g, i) for i, (_, g) in enumerate(named[:alone])] + [(g, alone + b) for (_, g), b in zip(named[alone:], places)]
    spark = rows.sparkSession
    fixed = spark.createDataFrame([(bytearray(g), int(b)) for g, b in chosen], "grp binary, shard int")
    # Stretches of the small groups' running size, tightest gap first.
    order = sorted(range(n), key=lambda b: (gaps[b], b))
    ends = np.cumsum([max(0, gaps[b]) for b in order])
    small = groups.where(F.col("bytes") < limit)
    octave = F.floor(F.log2(F.col("bytes").cast("double")) * CLASSES_AN_OCTAVE)
    bucket = ((F.lit(64 * CLASSES_AN_OCTAVE) - octave) * 64 + bucket_of("grp", n=64)).cast("int")
    placed = running(small.withColumn("all", F.lit(0)), ["all"], ["grp"], F.col("bytes"), "at", bucket)
    last = alone + order[-1]
    stretch = F.lit(last)
    for b, end in reversed(list(zip(order[:-1], ends[:-1]))):
        stretch = F.when(F.col("at") < int(end), F.lit(alone + b)).otherwise(stretch)
    return written(placed.select("grp", stretch.cast("int").alias("shard")).unionByName(fixed))


def shard_documents(docs: DataFrame, shards: int = 40, fine: int = 500) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: every row in one shard, copies of a text together."""
    rows = written(sized(docs))
    where = shard_groups(rows, shards, fine)
    joined = rows.join(where, "grp")
    slotted = running(joined, ["shard"], ["nth"], F.lit(1), "slot", bucket_of("nth", n=256))
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
