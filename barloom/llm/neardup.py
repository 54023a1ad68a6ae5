"""MinHash near-duplicates by tensored banding, with links confirmed on full shingle sets.

A document's set is its distinct ``k``-word shingles of ASCII-lower-cased words. Two collections of ``bands`` short keys
of ``rows`` minhashes each are combined pairwise into bands * bands table keys, so 2 * bands * rows minhashes serve as
many tables as bands * bands * 2 * rows would. At a similarity s a link is missed with probability about
2 * (1 - s ** rows) ** bands: 7e-5 at 0.85 with 8 bands of 2.

Equal sets are one node. Every node gets a home, the smallest node in any of its tables' buckets; two nodes that share a
bucket both belong to the cell of either one's home. Cells are cut into blocks of bounded size and each pair of blocks
counts the common shingles of its pairs exactly, giving back a spanning set of links, never all pairs. Components of
the links are the classes; no bucket, cell or class has a cap.

Texts with fewer words than ``k`` are one shingle; null texts and texts without words have an empty set and link with
nothing. Null doc_ids are classes of their own, with a null class id. Repeated rows fall into one class, and so do tied
ids of linked texts; an id with several texts has a row, and maybe another class, for each of them. Very long texts are
shingled whole and make a block of their own. An empty table gives an empty result. Input columns other than doc_id and
text are not read, so names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import components, groups_of, mix64, shingle_set, small_batches, word_hashes, written

#: Shingles of a block at most, unless one document has more.
BLOCK_SHINGLES = 400_000


def set_name(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a sorted shingle set."""
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, k: int, bands: int, rows: int, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, nth, text_hash, n_shingles, set_id (of equal sets) and the 2 * bands short keys."""
    small_batches(docs.sparkSession)

    def sign(batches):
        import pyarrow as pa

        n = 2 * bands * rows
        seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        mul, add = seeds[:n] | np.uint64(1), seeds[n:]
        for batch in batches:
            sets = [shingle_set(word_hashes(t), k) if t else np.empty(0, np.uint64) for t in batch.column(3).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            short = np.zeros((len(sets), 2 * bands), np.uint64)
            if len(full):
                flat = mix64(np.concatenate([sets[i] for i in full]))
                at = np.append(0, np.cumsum(sizes[full])[:-1])
                for b in range(2 * bands):
                    key = np.full(len(full), np.uint64(b + 1))
                    for r in range(b * rows, (b + 1) * rows):
                        key = mix64(key * np.uint64(0x9FB21C651E98DF25) + np.minimum.reduceat(flat * mul[r] + add[r], at))
                    short[full, b] = key
            ids = [set_name(s) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * 2 * bands), pa.array(short.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes), pa.array(ids, pa.binary()), lists], names=["doc_id", "nth", "text_hash", "n_shingles", "set_id", "short"]
            )

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("nth"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return source.mapInArrow(sign, "doc_id long, nth long, text_hash long, n_shingles long, set_id binary, short array<long>")


def cells(nodes: DataFrame, bands: int) -> DataFrame:
    """(node, cell, block, blocks) of ``nodes(node, n_shingles, short)`` that share a table's bucket with another node."""
    tables = F.expr(
        f"""explode(flatten(transform(slice(short, 1, {bands}), (x, i) ->
            transform(slice(short, {bands + 1}, {bands}), (y, j) -> xxhash64(i, j, x, y)))))"""
    )
    keys = nodes.select("node", tables.alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = written(keys.join(buckets, "key"))
    homes = written(members.groupBy("node").agg(F.min("low").alias("cell")))
    housed = members.join(homes, "node").select("key", "cell").distinct()
    inside = written(members.select("key", "node").join(housed, "key").select("node", "cell").distinct())
    sized = inside.join(nodes.select("node", "n_shingles"), "node")
    totals = sized.groupBy("cell").agg(F.sum("n_shingles").alias("all"), F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int")
    return inside.join(totals, "cell").select("node", "cell", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), blocks.alias("blocks"))


def link_blocks(k: int, percent: int):
    """Task function: spanning links of the pairs of each (cell, low, high) group with Jaccard >= percent / 100."""

    def spans(batches):
        import pyarrow as pa

        for (_, low, high), rows in groups_of(batches, ["cell", "low", "high"]):
            sets = [shingle_set(word_hashes(t), k) for t in rows.column("text").to_pylist()]
            # an id may name other texts than the node's
            mine = [i for i, (s, name) in enumerate(zip(sets, rows.column("set_id").to_pylist())) if len(s) and set_name(s) == name]
            if len(mine) < 2:
                continue
            sets = [sets[i] for i in mine]
            node, block = (rows.column(c).to_numpy()[mine] for c in ("node", "block"))
            sizes = np.array([len(s) for s in sets], np.int64)
            order = np.lexsort((node, sizes))
            node, block, sizes = node[order], block[order], sizes[order]
            ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1].ravel()
            at = np.append(0, np.cumsum(sizes))
            flags = np.zeros(int(ids.max()) + 1, np.int32)
            root = np.arange(len(node))
            for x in range(len(node)):
                # A larger set can link only up to 100 / percent times this size.
                end = int(np.searchsorted(sizes, sizes[x] * 100 // percent, side="right"))
                if end <= x + 1:
                    continue
                may = root[x + 1 : end] != root[x]
                if low != high:
                    may &= block[x + 1 : end] != block[x]
                if not may.any():
                    continue
                mine = ids[at[x] : at[x + 1]]
                flags[mine] = 1
                common = np.add.reduceat(flags[ids[at[x + 1] : at[end]]], at[x + 1 : end] - at[x + 1])
                flags[mine] = 0
                union = sizes[x] + sizes[x + 1 : end] - common
                for y in np.flatnonzero(may & (100 * common >= percent * union)) + x + 1:
                    a, b = root[x], root[y]
                    if a != b:
                        root[root == max(a, b)] = min(a, b)
            lowest = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(lowest, root, node)
            linked = lowest[root] != node
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(lowest[root][linked])], names=["a", "b"])

    return spans


def grouped(docs: DataFrame, k: int, percent: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, comp (a class of linked sets, null without one) and its smallest doc_id, a row an input row.

    A node is a distinct set and goes by the number of one of its rows, so that one id may name several texts.
    """
    signed = written(signatures(docs, k, bands, rows, id_col, text_col))
    first = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min(F.struct("doc_id", "nth")).alias("m"))
    first = written(first.select("set_id", F.col("m.doc_id").alias("doc_id"), F.col("m.nth").alias("node")))
    nodes = signed.join(first.select(F.col("node").alias("nth"), "node"), "nth").select("node", "n_shingles", "short")
    placed = cells(written(nodes), bands).join(first, "node")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    paired = (
        placed.join(texts, "doc_id")
        .select("node", "set_id", "text", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("node", "set_id", "text", "cell", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = paired.repartition(parts, "cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    links = sorted_.mapInArrow(link_blocks(k, percent), "a long, b long")
    label = components(links)
    known = first.join(label, "node", "left").select("set_id", "doc_id", F.coalesce("label", "node").alias("comp"))
    least = known.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    known = written(known.drop("doc_id").join(least, "comp"))
    joined = signed.drop("short", "nth").join(known, "set_id", "left").drop("set_id")
    real = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return joined.select("doc_id", "text_hash", "n_shingles", *[F.when(real, F.col(c)).alias(c) for c in ("comp", "component_id")])


def classes(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 8, rows: int = 2, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept, one row per input row."""
    found = grouped(docs, k, percent, bands, rows, id_col, text_col)
    out = found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col="doc_id", text_col="text", bands: int = 8, rows: int = 2) -> DataFrame:
    """``docs`` with one row of each class of linked texts, the one of the smallest id (of its texts, the least hash).

    Rows of a null id all stay. Of rows of one id without words, one stays for each different text. Of rows equal in id
    and text any one stays, whatever their other columns.
    """
    found = grouped(docs, k, percent, bands, rows, id_col, text_col).where("doc_id IS NOT NULL")
    best = found.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("doc_id", "text_hash")).alias("m")).select("m.doc_id", "m.text_hash")
    bare = found.where("comp IS NULL").select("doc_id", "text_hash").distinct()
    keep = written(best.unionByName(bare).select(F.col("doc_id").alias("_keep"), F.col("text_hash").alias("_hash")))
    rows_ = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_h"))
    one = rows_.join(keep, (rows_["_id"] == keep["_keep"]) & (rows_["_h"] == keep["_hash"]), "left_semi").dropDuplicates(["_id", "_h"])
    return one.unionByName(rows_.where("_id IS NULL")).select("_row.*")
