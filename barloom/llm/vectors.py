"""Near-duplicate vectors by an exact metric range join.

On unit vectors a cosine of at least c is a Euclidean distance of at most r = sqrt(2 - 2c). Pivots split the vectors into
cells by their nearest pivot. By the triangle inequality a vector within r of a member of cell h is at most 2r farther
from pivot h than from its own, and within r of the plane between the two pivots; such vectors are copied into cell h as
well. Each cell is then joined by itself: its own vectors in blocks against blocks of all its vectors. A block pair gives
back counts and a spanning set of links, never all pairs, so cells and clusters of any size have no cap.

Equal vectors are one node with a weight. The pivots are a bounded sample by hash order; how many is chosen on a bounded
sample so that a vector is copied into few cells. Where distances do not separate (random high-dimensional data) few
pivots are taken and the join is the exact blockwise comparison of all vectors.

Vectors that are null, zero, or hold a null or non-finite component link with nothing, as do rows of a null id; vectors
of different lengths never link. Repeated rows are linked copies. An empty table gives an empty result. Columns other
than the id and the vector are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import components, groups_of, small_batches, written

MAX_PIVOTS = 512
SAMPLE = 2_000
#: Cells a vector may be copied into on average when the number of pivots is chosen.
COPIES = 16
HOME_BLOCK, MEMBER_BLOCK = 4_096, 16_384
ARROW_ROWS = 4_096


def clean(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, nth, dim (0 if the vector links with nothing), vec (little-endian floats), same (id of equal vectors)."""
    element = table.schema[vec_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    wide = "array<float>" if kind == "<f4" else "array<double>"

    def packed(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            dims, vecs, same = [], [], []
            for ident, v in zip(batch.column(0).to_pylist(), batch.column(2)):
                raw = b""
                if ident is not None and v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(x).all() and x.any():
                        raw = (x.astype(kind) + np.zeros(1, kind)).tobytes()
                dims.append(len(raw) // int(kind[2]))
                vecs.append(raw)
                same.append(xxhash.xxh3_128_digest(raw))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary()), pa.array(same, pa.binary())],
                names=["vec_id", "nth", "dim", "vec", "same"],
            )

    small_batches(table.sparkSession, ARROW_ROWS)
    source = table.select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("nth"), F.col(vec_col).cast(wide).alias("v"))
    return source.mapInArrow(packed, "vec_id long, nth long, dim int, vec binary, same binary")


def units(column, kind: str, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_cells(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home of each vector, whether it must be in each cell)."""
    far = np.maximum(2 - 2 * (x @ pivots.T), 0)
    home = far.argmin(axis=1)
    own = far[np.arange(len(x)), home][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[home]
    into = np.sqrt(far) <= np.sqrt(own) + 2 * radius + 1e-9
    into &= far - own <= 2 * apart * radius + 1e-9
    into[np.arange(len(x)), home] = True
    return home, into


def choose_pivots(nodes: DataFrame, dim: int, kind: str, radius: float) -> np.ndarray:
    """The most pivots, by halving, with at most COPIES cells a vector on the sample; one pivot where none will do."""
    rows = nodes.where(F.col("dim") == dim).select("vec", F.xxhash64("same").alias("h")).orderBy("h").limit(SAMPLE + MAX_PIVOTS).collect()
    sample = units(_Listed([bytes(r["vec"]) for r in rows]), kind, dim)
    n = min(MAX_PIVOTS, max(1, len(sample) // 4))
    while n > 1:
        if near_cells(sample[n:], sample[:n], radius)[1].sum(axis=1).mean() <= COPIES:
            break
        n //= 2
    return sample[:n]


class _Listed(list):
    def to_pylist(self):
        return self


def join_blocks(kind: str, cosine: float):
    """Task function over groups (dim, cell, hb, mb): (a, b, n) with n the weight of a's links there and (a, b) a link."""

    def joined(batches):
        import pyarrow as pa

        for (dim, *_), rows in groups_of(batches, ["dim", "cell", "hb", "mb"]):
            x = units(rows.column("vec"), kind, dim)
            node, weight, mine = (rows.column(c).to_numpy() for c in ("node", "weight", "mine"))
            mine = mine.astype(bool)
            h, hid = x[mine], node[mine]
            m, mid, w = x[~mine], node[~mine], weight[~mine]
            if not len(h) or not len(m):
                continue
            found, label, a, b = np.zeros(len(h), np.int64), np.arange(len(h)), [], []
            for i in range(0, len(m), 1024):
                near = h @ m[i : i + 1024].T >= cosine
                found += near @ w[i : i + 1024]
                some = np.flatnonzero(near.any(axis=0))
                if not len(some):
                    continue
                first = near[:, some].argmax(axis=0)
                a.append(mid[i + some])
                b.append(hid[first])
                xs, ys = np.nonzero(near[:, some])
                pairs = np.unique(xs * len(h) + first[ys])
                one, two = pairs // len(h), pairs % len(h)
                while True:
                    before = label.copy()
                    np.minimum.at(label, one, before[two])
                    np.minimum.at(label, two, label[one])
                    if (before == label).all():
                        break
            a = np.concatenate([*a, hid])
            b = np.concatenate([*b, hid[label]])
            n = np.concatenate([np.zeros(len(a) - len(hid), np.int64), found])
            use = (a != b) | (n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(a[use]), pa.array(b[use]), pa.array(n[use])], names=["a", "b", "n"])

    return joined


def classes(table: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable) and kept, one row per input row."""
    spark = table.sparkSession
    kind = "<f4" if isinstance(table.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = written(clean(table, id_col, vec_col))
    first = rows.where("dim > 0").groupBy("same").agg(F.min(F.struct("vec_id", "nth")).alias("m"), F.count(F.lit(1)).alias("weight"))
    first = written(first.select("same", F.col("m.vec_id").alias("node"), F.col("m.nth").alias("nth"), "weight"))
    nodes = written(rows.select("nth", "dim", "vec").join(first, "nth").drop("nth"))
    pivots = {r["dim"]: choose_pivots(nodes, r["dim"], kind, radius) for r in nodes.select("dim").distinct().toLocalIterator()}
    held = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                home, into = near_cells(units(part.column("vec"), kind, int(dim)), held.value[int(dim)], radius)
                at, cell = np.nonzero(into)
                take = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*take.columns, pa.array(cell.astype(np.int32)), pa.array(home[at] == cell)], names=[*part.schema.names, "cell", "own"])

    placed = written(nodes.mapInArrow(assign, "dim int, vec binary, same binary, node long, weight long, cell int, own boolean").drop("same"))
    sizes = placed.groupBy("dim", "cell").agg(F.count_if("own").alias("h"), F.count(F.lit(1)).alias("m"))
    sizes = sizes.select("dim", "cell", F.ceil(F.col("h") / HOME_BLOCK).cast("int").alias("hs"), F.ceil(F.col("m") / MEMBER_BLOCK).cast("int").alias("ms"))
    blocks = placed.join(F.broadcast(sizes), ["dim", "cell"])  # a row per cell: at most MAX_PIVOTS a vector length
    hash_ = F.xxhash64("node")
    homes = blocks.where("own").select(
        "dim", "cell", F.pmod(hash_, "hs").cast("int").alias("hb"), F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("mb"), F.lit(1).alias("mine"), "node", "weight", "vec"
    )
    members = blocks.where("hs > 0").select(
        "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("hs") - 1)).alias("hb"), F.pmod(hash_, "ms").cast("int").alias("mb"), F.lit(0).alias("mine"), "node", "weight", "vec"
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["dim", "cell", "hb", "mb"]
    dealt = homes.unionByName(members).repartition(parts, *keys).sortWithinPartitions(*keys)
    links = written(dealt.mapInArrow(join_blocks(kind, cosine), "a long, b long, n long"))
    counts = links.where("n > 0").groupBy(F.col("a").alias("node")).agg((F.sum("n") - 1).alias("n_links"))
    label = components(links.where("a <> b").select("a", "b")).withColumnRenamed("label", "component_id")
    known = written(first.join(counts, "node", "left").join(label, "node", "left").select("same", "n_links", F.coalesce("component_id", "node").alias("component_id")))
    linked = F.col("dim") > 0
    return (
        rows.select("vec_id", "dim", "same").join(known, "same", "left")
        .select("vec_id", F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
