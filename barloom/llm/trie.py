"""Prefix trie of conversations: padded matrices of turn ids, sorted by numpy, every depth reduced at once.

A turn's id is a 128-bit hash of its place, role and text, in two lanes. Conversations are cut into chunks of ``CHUNK``
turns; chunks whose whole prefix is equal form a group (the exclusive or of the ids so far names it), so a matrix is
never wider than a chunk however long a conversation is, and one conversation's chunks spread over tasks. Chunks are
range-sharded by (chunk, group, ids, conversation): many equal conversations fall into several shards. In a shard numpy's
lexsort orders the rows, the changes between neighbours are OR-accumulated over the columns into marks of where nodes
start, and reduceat gives each depth's counts, least ids and sums. All sums over a subtree are sums over rows: a row adds
the texts that it starts, and witnesses a leaf if its successor does not extend it.

Nodes that hold a shard's first or last row, or conversations that go on in a later chunk, are recombined by their key;
a row that a shard took for a new start while its predecessor ended the shard before is corrected from the shards' edge
rows. All other nodes leave their task complete.

Defined cases: null role or text is the empty string; null turns come first, ties go by role, then by the SHA-256 of the
text; repeated rows are turns of their own. Rows without conv_id belong to no conversation. Very long texts are hashed
once and never shuffled. An empty table has no nodes. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import running, written

CHUNK = 32
#: Rows of a matrix.
SHARD_ROWS = 4096
BLOCK = 1024
#: Turns that a rebuilt conversation takes from the first of its hundred, at most.
MAX_HEAD = 5
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, t0, t1, chars): the only pass over the texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = written(conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"), F.sha2(text, 256).alias("h"), F.length(text).cast("long").alias("chars"),
        F.xxhash64(role, text).alias("t0"), F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.coalesce(F.floor(F.col("turn") / F.lit(BLOCK)).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("block"),
    ))
    placed = running(narrow, ["conv_id"], ["turn", "role", "h"], F.lit(1).cast("long"), "pos", F.col("block"))
    return placed.select("conv_id", "pos", "t0", "t1", "chars")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with their conversation's length, all conversations): heads come from the first conversation of the hundred."""
    counted = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    named = counted.withColumn("head", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MAX_HEAD + 1)))
    named = named.withColumn("base", F.expr("conv_id - conv_id % 100"))
    bases = counted.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("head", F.coalesce("n_base", F.lit(0)))
    sizes = named.join(bases, "base", "left").withColumn("k", taken).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    sizes = written(sizes.select("conv_id", "base", "head", "k", "length"))
    cols = ["conv_id", "pos", "t0", "t1", "chars", "length"]
    tails = own.join(sizes, "conv_id").where("pos >= head").withColumn("pos", F.col("pos") - F.col("head") + F.col("k")).select(*cols)
    first = own.where((F.col("pos") < MAX_HEAD) & (F.col("conv_id") % 100 == 0)).withColumnRenamed("conv_id", "base")
    heads = first.join(sizes, "base").where("pos < k").select(*cols)
    return tails.unionByName(heads), sizes.select("conv_id", "length")


def chunks(turns: DataFrame, convs: DataFrame, chunk: int) -> DataFrame:
    """(r, g0, g1, turns, more, conv_id): one row a chunk, its group, its ids, and whether the conversation goes on."""
    pos = F.col("pos")
    ids = turns.select(
        "conv_id", F.floor(pos / chunk).cast("int").alias("r"), "length",
        F.struct(pos, F.xxhash64(pos, "t0").alias("z0"), F.xxhash64(F.lit(1), pos, "t1").alias("z1"), "chars").alias("t"),
    )
    cut = written(ids.groupBy("conv_id", "r").agg(
        F.array_sort(F.collect_list("t")).alias("turns"), F.first("length").alias("length"),
        F.bit_xor("t.z0").alias("x0"), F.bit_xor("t.z1").alias("x1"),
    ))
    before = Window.partitionBy("conv_id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    later = cut.where(F.col("length") > chunk).select("conv_id", "r", F.bit_xor("x0").over(before).alias("g0"), F.bit_xor("x1").over(before).alias("g1"))
    more = ((F.col("r") + 1) * chunk < F.col("length")).alias("more")
    zero = F.lit(0).cast("long")
    cols = ["r", "g0", "g1", "turns", more, "conv_id"]
    head = cut.where("r = 0").withColumns({"g0": zero, "g1": zero}).select(*cols)
    rest = cut.where("r > 0").join(later.where("r > 0"), ["conv_id", "r"]).select(*cols)
    none = F.array().cast(cut.schema["turns"].dataType)
    bare = convs.where("length = 0").select(F.lit(0).alias("r"), zero.alias("g0"), zero.alias("g1"), none.alias("turns"), F.lit(False).alias("more"), "conv_id")
    return head.unionByName(rest).unionByName(bare)


#: Kinds of the rows that a shard gives.
CLOSED, OPEN, ENDER, EDGE, ROW, PATH = range(6)
FIELDS = [
    ("kind", "int"), ("shard", "int"), ("depth", "long"), ("k0", "long"), ("k1", "long"), ("conv_id", "long"),
    ("parent", "long"), ("p0", "long"), ("p1", "long"), ("n", "long"), ("children", "long"), ("leaves", "long"),
    ("saved", "long"), ("ends", "string"), ("r", "int"), ("g0", "long"), ("g1", "long"), ("more", "boolean"),
    ("a0", "array<long>"), ("a1", "array<long>"), ("chars", "array<long>"),
]
SCHEMA = ", ".join(f"{n} {t}" for n, t in FIELDS)


def _arrow_schema():
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in FIELDS])


def sorted_matrix(table):
    """The shard in order: r, g0, g1, conv, more, sizes and three padded matrices (both id lanes, lengths of texts)."""
    import numpy as np

    col = {n: table.column(n).combine_chunks() for n in ("r", "g0", "g1", "more", "conv_id", "turns")}
    r, g0, g1, more, conv = (np.asarray(col[n].to_numpy(zero_copy_only=False)) for n in ("r", "g0", "g1", "more", "conv_id"))
    sizes = np.asarray(col["turns"].value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = col["turns"].flatten()
    width = max(1, int(sizes.max(initial=0)))
    inside = np.arange(width) < sizes[:, None]
    low = np.iinfo(np.int64).min
    ids0, ids1, chars = np.full(inside.shape, low), np.full(inside.shape, low), np.zeros(inside.shape, np.int64)
    for made, name in ((ids0, "z0"), (ids1, "z1"), (chars, "chars")):
        made[inside] = flat.field(name).to_numpy(zero_copy_only=False)
    lanes = [lane for j in reversed(range(width)) for lane in (ids1[:, j], ids0[:, j])]
    order = np.lexsort([conv, more, *lanes, g1, g0, r])
    return [x[order] for x in (r, g0, g1, conv, more, sizes, ids0, ids1, chars)]


def shard_rows(table, shard: int, chunk: int):
    """All rows of one shard as dictionaries of columns."""
    import hashlib

    import numpy as np

    from barloom.llm import trie as T

    r, g0, g1, conv, more, sizes, ids0, ids1, chars = T.sorted_matrix(table)
    n, width = ids0.shape
    inside = np.arange(width) < sizes[:, None]
    group = np.ones(n, bool)
    group[1:] = (r[1:] != r[:-1]) | (g0[1:] != g0[:-1]) | (g1[1:] != g1[:-1])
    change = np.ones((n, width), bool)
    change[1:] = (ids0[1:] != ids0[:-1]) | (ids1[1:] != ids1[:-1])
    starts = np.logical_or.accumulate(change | group[:, None], axis=1)
    shared = np.minimum((~starts).sum(axis=1), sizes)
    tail = np.zeros((n, width + 1), np.int64)
    tail[:, :width] = chars[:, ::-1].cumsum(axis=1)[:, ::-1]
    fresh = np.take_along_axis(tail, np.maximum(np.arange(width + 1), shared[:, None]), axis=1)
    gain = tail - fresh
    last = np.append(group[1:], True)
    witness = ~more & (last | (np.append(shared[1:], 0) < sizes))
    key0 = g0[:, None] ^ np.bitwise_xor.accumulate(np.where(inside, ids0, 0), axis=1)
    key1 = g1[:, None] ^ np.bitwise_xor.accumulate(np.where(inside, ids1, 0), axis=1)
    up, up_conv, up_open = None, None, None
    for j in range(-1, width):
        at = np.flatnonzero(group if j < 0 else starts[:, j])
        stop = np.append(at[1:], n)
        k0, k1 = (g0, g1) if j < 0 else (key0[:, j], key1[:, j])
        count = stop - at
        least = np.minimum.reduceat(conv, at)
        children = np.add.reduceat((starts & inside)[:, j + 1].astype(np.int64), at) if j + 1 < width else np.zeros(len(at), np.int64)
        leaves, saved = np.add.reduceat(witness.astype(np.int64), at), np.add.reduceat(gain[:, max(j, 0)], at)
        opened = np.logical_or.reduceat(more, at) | (at == 0) | (stop == n)
        enders = (sizes == j + 1) & ~more & (j >= 0 or r == 0) if j >= 0 else (sizes == 0) & ~more & (r == 0)
        if j < 0:
            opened[:] = True
            later = r[at] > 0
            count, leaves, saved = (np.where(later, 0, x) for x in (count, leaves, saved))
            real = np.ones(len(at), bool)
        else:
            later, real = np.zeros(len(at), bool), inside[at, j]
        if j >= 0:
            mother = np.searchsorted(up, at, side="right") - 1
            parent, parent_open = up_conv[mother], up_open[mother]
            p0, p1 = (g0[at], g1[at]) if j == 0 else (key0[at, j - 1], key1[at, j - 1])
        else:
            parent, parent_open, p0, p1 = least, np.ones(len(at), bool), k0[at], k1[at]
        names = [T.EMPTY_SHA] * len(at)
        node_of = np.searchsorted(at, np.arange(n), side="right") - 1
        whole = np.flatnonzero(enders & ~opened[node_of])
        if len(whole):
            edges = np.flatnonzero(np.append(True, np.diff(node_of[whole]) != 0))
            for lo, hi in zip(edges, np.append(edges[1:], len(whole))):
                names[node_of[whole[lo]]] = hashlib.sha256(",".join(map(str, np.sort(conv[whole[lo:hi]]).tolist())).encode()).hexdigest()
        depth = r[at].astype(np.int64) * chunk + j + 1
        base = dict(depth=depth, k0=k0[at], k1=k1[at], conv_id=least, p0=p0, p1=p1, n=count, children=children, leaves=leaves, saved=saved)
        parents = np.ma.array(parent, mask=parent_open | (depth == 0))
        for kind, pick in ((T.CLOSED, real & ~opened), (T.OPEN, real & opened)):
            if pick.any():
                out = {k: v[pick] for k, v in base.items()} | {"kind": kind, "ends": [x for x, p in zip(names, pick) if p], "parent": parents[pick]}
                if kind == T.OPEN:
                    out["conv_id"] = np.ma.array(least[pick], mask=later[pick])
                yield out
        loose = np.flatnonzero(enders & opened[node_of])
        if len(loose):
            yield dict(kind=T.ENDER, depth=r[loose].astype(np.int64) * chunk + j + 1, k0=k0[loose], k1=k1[loose], conv_id=conv[loose])
        up, up_conv, up_open = at, least, opened
    ends = np.array([0, n - 1])
    lists = lambda m, rows: [m[i, : sizes[i]].tolist() for i in rows]
    yield dict(kind=T.EDGE, shard=np.full(2, shard), n=np.array([0, 1]), r=r[ends], g0=g0[ends], g1=g1[ends], more=more[ends], conv_id=conv[ends],
               a0=lists(ids0, ends), a1=lists(ids1, ends), chars=lists(chars, ends))
    deep = np.flatnonzero(r > 0)
    if len(deep):
        yield dict(kind=T.ROW, conv_id=conv[deep], r=r[deep], saved=gain[deep, 0], leaves=witness[deep].astype(np.int64))
    long = np.flatnonzero(more)
    if len(long):
        yield dict(kind=T.PATH, conv_id=conv[long], r=r[long], g0=g0[long], g1=g1[long], a0=lists(key0, long), a1=lists(key1, long))


def _columns(made: dict):
    import numpy as np
    import pyarrow as pa

    from barloom.llm import trie as T

    schema = T._arrow_schema()
    size = len(made["conv_id"])
    arrays = []
    for f in schema:
        v = made.get(f.name)
        if f.name == "kind":
            arrays.append(pa.array(np.full(size, v, np.int32)))
        elif v is None:
            arrays.append(pa.nulls(size, f.type))
        elif isinstance(v, np.ma.MaskedArray):
            arrays.append(pa.array(v.data, f.type, mask=np.ma.getmaskarray(v)))
        else:
            arrays.append(pa.array(v, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _shards(chunk: int):
    def run(batches):
        import pyarrow as pa

        from barloom.llm import trie as T

        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            for made in T.shard_rows(table, table.column("shard")[0].as_py(), chunk):
                yield T._columns(made)

    return run


def _corrections(chunk: int):
    """Edge rows in order to partial nodes and rows that undo what a shard could not know of its neighbour."""
    def run(batches):
        import numpy as np

        from barloom.llm import trie as T

        prior = None
        for batch in batches:
            for e in batch.to_pylist():
                if e["n"] == 1:
                    prior = e
                    continue
                if prior is None or any(prior[c] != e[c] for c in ("r", "g0", "g1")):
                    continue
                both = list(zip(zip(prior["a0"], prior["a1"]), zip(e["a0"], e["a1"])))
                common = next((i for i, (x, y) in enumerate(both) if x != y), len(both))
                first = e["r"] == 0
                tail = np.append(np.cumsum(np.array(e["chars"], np.int64)[::-1])[::-1], 0)
                steps = [(e, j, int(tail[max(j, 0)] - tail[common]), 0, -1 if j + 1 < common else 0) for j in range(-1, common)]
                unleaf = not prior["more"] and common >= len(prior["a0"])
                if unleaf:
                    steps += [(prior, j, 0, -1, 0) for j in range(-1, len(prior["a0"]))]
                rows = []
                for x, j, saved, leaf, child in steps:
                    if j < 0 and not first:
                        saved = leaf = 0
                    k0, k1 = x["g0"], x["g1"]
                    for a, b in zip(x["a0"][: j + 1], x["a1"][: j + 1]):
                        k0, k1 = k0 ^ a, k1 ^ b
                    rows.append((x["r"] * chunk + j + 1, k0, k1, 0, child, leaf, saved))
                made = dict(zip(("depth", "k0", "k1", "n", "children", "leaves", "saved"), zip(*rows)))
                yield T._columns(made | dict(kind=T.OPEN, conv_id=[None] * len(rows)))
                if not first:
                    made = dict(conv_id=[e["conv_id"]], r=[e["r"]], saved=[int(tail[0] - tail[common])], leaves=[0])
                    yield T._columns(made | dict(kind=T.ROW))
                    if unleaf:
                        yield T._columns(dict(kind=T.ROW, conv_id=[prior["conv_id"]], r=[prior["r"]], saved=[0], leaves=[-1]))

    return run


def _ends(batches):
    import hashlib

    import pyarrow as pa

    schema = pa.schema([("depth", pa.int64()), ("k0", pa.int64()), ("k1", pa.int64()), ("ends", pa.string())])
    key, sha, out = None, None, []
    for batch in batches:
        for d, a, b, c in zip(*(batch.column(n).to_pylist() for n in ("depth", "k0", "k1", "conv_id"))):
            if (d, a, b) != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (d, a, b), hashlib.sha256(str(c).encode())
            else:
                sha.update(b",%d" % c)
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=schema)
            out = []
    if key is not None:
        out.append((*key, sha.hexdigest()))
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=schema)


KEY = ["depth", "k0", "k1"]


def nodes(turns: DataFrame, convs: DataFrame, chunk: int = CHUNK, shard_size: int = SHARD_ROWS) -> DataFrame:
    """One row a node of the trie over ``turns(conv_id, pos, t0, t1, chars, length)`` and ``convs(conv_id, length)``."""
    rows = written(chunks(turns, convs, chunk))
    shards = max(1, -(-rows.count() // shard_size))
    ranged = rows.repartitionByRange(shards, "r", "g0", "g1", "turns", "more", "conv_id").withColumn("shard", F.spark_partition_id())
    made = written(ranged.mapInArrow(_shards(chunk), SCHEMA))
    # two rows a shard, in order; a chunk of turns is the widest of them
    edges = made.where(F.col("kind") == EDGE).repartition(1).sortWithinPartitions("shard", "n")
    fixes = written(edges.mapInArrow(_corrections(chunk), SCHEMA))
    part = ["n", "children", "leaves", "saved"]
    deep = made.where(F.col("kind") == ROW).unionByName(fixes.where(F.col("kind") == ROW)).groupBy("conv_id", "r").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    later = deep.select("conv_id", (F.col("r") - 1).alias("r"), F.sum("saved").over(after).alias("saved"), F.sum("leaves").over(after).alias("leaves"))
    keys = F.arrays_zip(F.concat(F.array("g0"), "a0").alias("k0"), F.concat(F.array("g1"), "a1").alias("k1"))
    path = made.where(F.col("kind") == PATH).select("conv_id", "r", F.posexplode(keys).alias("j", "k")).where("j > 0 OR r = 0")
    zero = F.lit(0).cast("long")
    passed = path.join(later.where("saved <> 0 OR leaves <> 0"), ["conv_id", "r"]).select(
        (F.col("r") * F.lit(chunk) + F.col("j")).cast("long").alias("depth"), F.col("k.k0").alias("k0"), F.col("k.k1").alias("k1"),
        F.lit(None).cast("long").alias("conv_id"), *[F.lit(None).cast("long").alias(c) for c in ("parent", "p0", "p1")],
        zero.alias("n"), zero.alias("children"), "leaves", "saved",
    )
    cols = [*KEY, "conv_id", "parent", "p0", "p1", *part]
    opened = made.where(F.col("kind") == OPEN).select(*cols).unionByName(fixes.where(F.col("kind") == OPEN).select(*cols)).unionByName(passed)
    # a chunk's first column may lie in another shard than its parent, but all parts of a node name the same parent key
    merged = opened.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.max(F.when(F.col("n") > 0, F.struct("p0", "p1"))).alias("p"), F.min("parent").alias("parent"),
        *[F.sum(c).alias(c) for c in part],
    ).select(*KEY, "conv_id", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"), "p.p0", "p.p1", *part)
    ender = made.where(F.col("kind") == ENDER).select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    ends = ender.mapInArrow(_ends, "depth long, k0 long, k1 long, ends string")
    merged = written(merged.join(ends, KEY, "left").withColumn("ends", F.coalesce("ends", F.lit(EMPTY_SHA))))
    closed = made.where(F.col("kind") == CLOSED).select(*merged.columns)
    every = closed.unionByName(merged)
    known = every.where("parent IS NOT NULL OR depth = 0")
    known = known.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent")))
    above = merged.select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    found = every.where("parent IS NULL AND depth > 0").join(above, ["depth", "p0", "p1"])
    out = ["conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
           F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    return known.select(*out).unionByName(found.select(*out))


def prefix_trie(conversations: DataFrame, chunk: int = CHUNK, shard_size: int = SHARD_ROWS) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    own = written(turn_ids(conversations))
    turns, convs = rebuilt(own)
    return nodes(turns, convs, chunk, shard_size)
