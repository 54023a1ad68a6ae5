"""Helpers shared by the operators: shared-folder tables, global ranks, components, token and shingle kernels."""

from __future__ import annotations

import sys
import uuid
from array import array
from contextlib import contextmanager
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.session import shared_dir

#: Buckets over which ranks and running sums of one group are spread.
RANK_BUCKETS = 1024
#: Rows an Arrow batch holds at most; documents can be very long.
BATCH_ROWS = 256
#: Entries of each half of a word memo.
MEMO_WORDS = 300_000
#: Bytes of text that are encoded together, unless one batch holds more.
TEXT_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_collected: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/barloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _collected:
        _collected[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def collected(paths: list[str]):
    """Note in ``paths`` the tables that are written inside, so that they can be dropped once nothing reads them."""
    _collected.append(paths)
    try:
        yield paths
    finally:
        _collected.pop()


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder and forget them."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def bucket_of(*cols, n: int = RANK_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def running(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, bucket: Column) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that come before this row.

    The order is (bucket, ``order``), any fixed order of the group. A group of any size is spread over its buckets;
    only the per-bucket totals of a group meet in one window.
    """
    keyed = df.withColumn("_b", bucket).withColumn("_v", value)
    w = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.withColumn("_in", F.sum("_v").over(w) - F.col("_v"))
    totals = keyed.groupBy(*group, "_b").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    starts = totals.withColumn("_o", F.sum("_t").over(before) - F.col("_t")).drop("_t")
    renamed = starts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_b").alias("_g_b"), "_o")
    on = reduce(lambda a, b: a & b, [local[c].eqNullSafe(renamed[f"_g_{c}"]) for c in group] + [local["_b"] == renamed["_g_b"]])
    joined = local.join(renamed, on).withColumn(out, F.col("_in") + F.col("_o"))
    return joined.drop("_b", "_v", "_in", "_o", "_g_b", *[f"_g_{c}" for c in group])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges(a, b)``; the label is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, jumps to the roots and contracts the edges, so at least half
    of the nodes go. Rounds are tables in the shared folder; nothing is gathered on the driver but counts.
    """
    live = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")))
        while True:
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = written(hook.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("q"), "p"))
            moved = not jumped.where("q <> p").isEmpty()
            hook = jumped.select("a", F.col("q").alias("p"))
            if not moved:
                break
        if labels is None:
            labels = hook.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            step = hook.select(F.col("a").alias("label"), "p")
            labels = written(labels.join(step, "label", "left").select("node", F.coalesce("p", "label").alias("label")))
        of_a, of_b = hook.select("a", F.col("p").alias("pa")), hook.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        live = written(
            live.join(of_a, "a").join(of_b, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
    if labels is None:
        labels = live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


class Memo(dict):
    """word -> value, computed once per task. When full, the older half is dropped unless used again, so memory is bounded."""

    def __init__(self, make, limit: int = MEMO_WORDS, longest: int = 64):
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: White space of the word pattern ``[^\\x20\\x09-\\x0D]+``.
SPACES = (32, 9, 10, 11, 12, 13)


def word_spans(text: str | bytes, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths) of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes, with A-Z lower-cased if asked."""
    raw = np.frombuffer(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass"), np.uint8)
    if fold:
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        raw = lower[raw]
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    edges = np.flatnonzero(np.diff(~space[raw], prepend=False, append=False))
    return raw, edges[::2], edges[1::2] - edges[::2]


def word_hashes(text: str, fold: bool = True) -> np.ndarray:
    """A 64-bit hash for each word, by one pass over the bytes."""
    return span_hashes(*word_spans(text, fold))


def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, and factors for 4,096 places of a word."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.cumprod(np.full(4096, np.uint64(0xD6E8FEB86659FD93)))


def span_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hashes of the words that ``word_spans`` gives."""
    if not len(starts):
        return np.empty(0, np.uint64)
    seeds, powers = kept(byte_tables)
    place = np.arange(len(raw)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(raw)]))))
    block = place >> 12
    value = seeds[raw] * powers[place & 4095]
    if block.any():
        value = mix64(value + block.astype(np.uint64))
    ends = starts + lengths
    cut = np.stack([starts, ends], 1).ravel()
    if cut[-1] == len(raw):
        cut = cut[:-1]
    return mix64(np.add.reduceat(value, cut)[::2] ^ lengths.astype(np.uint64))


def windows_hash(h: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each run of k word hashes, in order; the length is part of the hash."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15)) * np.uint64(k)
    for i in range(k):
        out = mix64(out * np.uint64(0x9FB21C651E98DF25) + h[i : i + n])
    return out


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; with fewer words the whole sequence is one shingle."""
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(windows_hash(h, min(k, len(h))))


BIG_ENDIAN = sys.byteorder != "little"
#: ASCII marks that end a word and form one token run with each other; the apostrophe is left to the library.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet of public byte-pair vocabularies: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def encoder(path: str, pad: bytes = b"", memo_words: int = MEMO_WORDS):
    """The encoder of ``made_encoder``, kept while the Python worker lives, so its tasks share one memo."""
    return kept(made_encoder, path, pad, memo_words)


def batch_encoder(path: str, pad: bytes, memo_words: int) -> Encoder:
    """An ``Encoder`` of whole batches, kept in the same way. It is faster, and takes more memory in a worker."""
    return kept(Encoder, path, pad, memo_words)


def kept(make, *key):
    """What ``make`` gives for ``key``, made once while a Python worker lives."""
    import types

    held = sys.modules.setdefault("_barloom_worker", types.ModuleType("_barloom_worker")).__dict__
    name = (make.__name__, *key)
    if name not in held:
        held[name] = make(*key)
    return held[name]


def made_encoder(path: str, pad: bytes = b"", memo_words: int = MEMO_WORDS):
    """text -> ids as little-endian uint32 bytes, by the tokenizers library through a memo of space-separated chunks.

    Both public vocabularies split a text before a single space between two non-space characters, so a text's ids are
    the ids of its chunks, each with its leading space, one after the other. A text with any other white space next to
    a space is encoded whole. Latin words with marks behind them go to the library's merge model directly, any other
    chunk through its whole chain. Special-token strings in a text are ordinary text.
    """
    import re

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    model, letters, folds = tok.model, byte_letters(), tok.normalizer is not None
    odd = re.compile(r"\s\s")

    def packed(ids) -> bytes:
        made = array("I", ids)
        if BIG_ENDIAN:
            made.byteswap()
        return made.tobytes()

    def whole(text: str) -> bytes:
        return packed(tok.encode(text, add_special_tokens=False).ids)

    def merged(piece: str) -> bytes:
        if piece.isascii():
            text = piece.replace(" ", letters[32])
        else:
            text = "".join(map(letters.__getitem__, piece.encode()))
        return packed([t.id for t in model.tokenize(text)])

    pieces = Memo(merged, memo_words)

    def chunk(space: str):
        lead = "" if folds else space

        def ids(text: str) -> bytes:
            word = text.rstrip(MARKS)
            if word.isalpha() and max(word) < "\u0100":
                low = word.lower() if folds else word
                end = text[len(word):]
                return pieces[lead + low] + (pieces[end] if end else b"")
            return whole(space + text)

        return ids

    first, rest = Memo(chunk(""), memo_words // 10), Memo(chunk(" "), memo_words)

    def encode(text: str | None) -> bytes:
        if not text:
            return pad
        if odd.search(text):
            return whole(text) + pad
        head, *tail = text.split(" ")
        return first[head] + b"".join(map(rest.__getitem__, tail)) + pad

    return encode


class Encoder:
    """As ``made_encoder``, for whole Arrow batches of texts.

    ``batch`` splits all texts of an Arrow batch and looks every distinct chunk up once. A chunk that comes again in a
    later batch moves from the fresh to the known ones. When full, the fresh are emptied and of the known those of the last
    batch stay, so memory is bounded and chunks that come once do not push out those that come often.
    """

    def __init__(self, path: str, pad: bytes, memo_words: int):
        import re

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model, self.letters, self.folds = self.tok.model, byte_letters(), self.tok.normalizer is not None
        self.pad, self.limit = pad, memo_words
        self.adjoining = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
        latin = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
        self.plain = re.compile(f"([{latin}]+)([{re.escape(MARKS)}]*)").fullmatch
        self.known, self.fresh, self.ends = {}, {}, {}
        self.line = self.whole("\n")

    def packed(self, ids) -> bytes:
        made = array("I", ids)
        if BIG_ENDIAN:
            made.byteswap()
        return made.tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tok.encode(text, add_special_tokens=False).ids)

    def merged(self, piece: str) -> bytes:
        if piece.isascii():
            text = piece if piece[:1] != " " else self.letters[32] + piece[1:]
        else:
            text = "".join(map(self.letters.__getitem__, piece.encode()))
        return self.packed([t.id for t in self.model.tokenize(text)])

    def mark(self, end: str) -> bytes:
        found = self.ends.get(end)
        if found is None:
            found = self.merged(end)
            if len(self.ends) < 10_000 and len(end) < 16:
                self.ends[end] = found
        return found

    def chunk(self, lead: str, text: str) -> bytes:
        """Ids of a chunk behind ``lead``, a space or nothing. A line end between two other characters stands alone."""
        if text.isalpha() and text.isascii():
            word, end = text, ""
        elif m := self.plain(text):
            word, end = m.groups()
        else:
            if "\n" not in text:
                return self.whole(lead + text) if lead or text else b""
            first, *rest = text.split("\n")
            return self.line.join([self.chunk(lead, first), *[self.chunk("", x) for x in rest]])
        low = word.lower() if self.folds else word
        key = low if self.folds or lead else (low,)
        made = self.known.get(key) or self.fresh.get(key)
        if made is None:
            made = self.merged(low if self.folds else lead + low)
            if len(low) <= 64:
                self.fresh[key] = made
        return made + self.mark(end) if end else made

    def looked_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct chunks that stand behind a space."""
        known, fresh, out = self.known, self.fresh, []
        for w in words:
            made = known.get(w)
            if made is None:
                made = fresh.pop(w, None)
                if made is not None:
                    known[w] = made
                else:
                    made = self.chunk(" ", w)
                    if len(w) <= 64:
                        fresh[w] = made
            out.append(made)
        return out

    def batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids a text with its end) of a string array; a null is an empty text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
        alone = pc.match_substring_regex(texts, self.adjoining)
        lists = pc.split_pattern(pc.if_else(alone, "", texts), " ")
        at = lists.offsets.to_numpy()
        at, heads = at - at[0], lists.flatten()
        coded = heads.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        words = coded.dictionary.to_pylist()
        made = self.looked_up(words)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = heads.take(pa.array(at[:-1])).to_pylist()
        odd = alone.to_numpy(zero_copy_only=False)
        for i in range(len(at) - 1):
            codes[at[i]] = len(made)
            made.append(self.whole(texts[i].as_py()) if odd[i] else self.chunk("", first[i]))
        codes = np.insert(codes, at[1:], len(made))
        made.append(self.pad)
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        pool = np.frombuffer(b"".join(made), "<u4")
        n = sizes[codes]
        ends = np.cumsum(n)
        place = np.repeat((np.cumsum(sizes) - sizes)[codes] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        starts = at[:-1] + np.arange(len(at) - 1)
        counts = np.add.reduceat(n, starts) if len(starts) else np.empty(0, np.int64)
        if len(self.known) > self.limit:
            self.known = {w: self.known[w] for w in words if w in self.known}
        if len(self.fresh) > self.limit:
            self.fresh.clear()
        return pool[place], counts

    def __call__(self, text: str | None) -> bytes:
        import pyarrow as pa

        return self.batch(pa.array([text], pa.string()))[0].tobytes()


def joined_batches(batches, column: int, bytes_: int = TEXT_BYTES):
    """Arrow batches put together until a text column holds ``bytes_``; a larger batch stays as it is."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= bytes_:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            held, size = [], 0
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        yield whole[0] if whole else held[0]
    pa.default_memory_pool().release_unused()


def groups_of(batches, key_cols: list[str]):
    """Yield (key, rows as a list of column lists) for sorted batches; a group may cross batches."""
    import pyarrow as pa

    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_pylist() for c in key_cols]
        keys = list(zip(*cols))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if key is not None and keys[start] != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = keys[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield key, pa.Table.from_batches(held)
