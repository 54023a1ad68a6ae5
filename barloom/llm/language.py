"""Language identification by unigrams marginalised over segmentations.

The pieces are those of a fixed public vocabulary, lower-cased, letters only. A word's probability in a language is the
sum over all ways to cut it into pieces of the product of their probabilities, by a forward pass; training counts are
expectations over the same lattice (forward-backward), so no segmentation is ever chosen. A text's score is the sum of
its words' log probabilities; the prediction is the best language and its posterior under equal priors.

Training reads the words of labelled rows, at most ``train_docs`` of each language in expectation (chosen by a hash of
the id; the bound is a parameter). The label, source and id are never inputs of a prediction. Words are runs of letters
of the lower-cased text; longer ones are scored in stretches of 64 letters.

Null texts and texts without a letter are ``und`` with score 0, as is everything where no label was learned. Ties go to
the first language by name. Rows with a null id are never trained on. Repeated rows are scored alike. An empty table
gives an empty result. Columns other than the id, text and label are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import mix64, small_batches, written

TRAIN_DOCS = 4_000
LONGEST_PIECE = 10
STRETCH = 64
#: Probability of a letter outside the vocabulary, in every language.
UNKNOWN = 1e-8
#: Keeps products of piece probabilities near one: factor a letter.
SCALE = 100.0
#: Words whose scores a task keeps.
KEPT_WORDS = 400_000


def vocabulary(model_file: str) -> list[str]:
    """Distinct lower-cased letter pieces of at most LONGEST_PIECE letters, sorted."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = {model.id_to_piece(i).lstrip("▁").lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p.isalpha() and len(p) <= LONGEST_PIECE)


def letters(text: str | None) -> list[str]:
    if not text:
        return []
    words = _WORD.findall(text.lower())
    if not all(map(str.isalpha, words)):
        words = [w for w in ("".join(filter(str.isalpha, w)) for w in words) if w]
    return words


_WORD = re.compile(r"[^\W\d_]+")


class Lattice:
    """Pieces found in words of one length, and the passes over them, for many words at once."""

    def __init__(self, pieces: list[str]):
        keys = np.array([self._key(np.array([[ord(c) for c in p]], np.uint64))[0] for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys, self.unknown = keys[self.order], len(pieces)

    @staticmethod
    def _key(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for i in range(codes.shape[1]):
            h = mix64(h + codes[:, i] + np.uint64(1))
        return h

    def arcs(self, words: list[str], n: int):
        """(start, length, piece of each word or -1) for all stretches of words of n letters."""
        codes = np.array(words, f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
        for start in range(n):
            h = np.zeros(len(words), np.uint64)
            for size in range(1, min(LONGEST_PIECE, n - start) + 1):
                h = mix64(h + codes[:, start + size - 1] + np.uint64(1))
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                piece = np.where(self.keys[at] == h, self.order[at], -1)
                if size == 1:
                    piece = np.where(piece < 0, self.unknown, piece)
                if (piece >= 0).any():
                    yield start, size, piece

    def scores(self, words: list[str], n: int, prob: np.ndarray) -> np.ndarray:
        """log probability of each word (rows) in each language (columns of ``prob``; its last two rows: unknown, none)."""
        ahead = [np.zeros((len(words), prob.shape[1])) for _ in range(n + 1)]
        ahead[0] += 1.0
        for start, size, piece in self.arcs(words, n):
            ahead[start + size] += ahead[start] * prob[piece] * SCALE**size
        return np.log(np.maximum(ahead[n], 1e-300)) - n * np.log(SCALE)

    def expected(self, words: list[str], counts: np.ndarray, n: int, prob: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, by forward and backward sums."""
        arcs = list(self.arcs(words, n))
        ahead, back = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
        ahead[0] = back[n] = 1.0
        for start, size, piece in arcs:
            ahead[start + size] += ahead[start] * prob[piece] * SCALE**size
        for start, size, piece in reversed(arcs):
            back[start] += back[start + size] * prob[piece] * SCALE**size
        whole = np.maximum(ahead[n], 1e-300)
        out = np.zeros(len(prob))
        for start, size, piece in arcs:
            use = np.where(piece >= 0, ahead[start] * prob[piece] * SCALE**size * back[start + size] / whole * counts, 0.0)
            out += np.bincount(np.where(piece >= 0, piece, len(prob) - 1), use, len(prob))
        return out


def by_length(words):
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    return groups.items()


def stretches(words: list[str]) -> list[str]:
    if all(len(w) <= STRETCH for w in words):
        return words
    return [w[i : i + STRETCH] for w in words for i in range(0, len(w), STRETCH)]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of ``docs(lang, text)``; tasks count first."""
    def count(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def flush():
            keys = list(held)
            made = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([held[k] for k in keys], pa.int64())], names=["lang", "word", "n"]
            )
            held.clear()
            return made

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(stretches(letters(text))).items():
                    held[lang, word] += n
            if len(held) > 200_000:
                yield flush()
        yield flush()

    return docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, pieces: list[str], train_docs: int = TRAIN_DOCS, rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities) from ``labelled(doc_id, lang, text)``. The model is vocabulary times languages."""
    spark = labelled.sparkSession
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row per language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(pieces) + 2, 0))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, train_docs / n)))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    words = written(word_counts(chosen))
    column = {k: i for i, k in enumerate(langs)}
    guess = np.array([0.5 ** len(p) for p in pieces] + [0.0, 0.0])
    prob = np.repeat((guess / guess.sum())[:, None], len(langs), 1)
    prob[-2] = UNKNOWN
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((pieces, prob, column))

        def expect(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            names, probs, columns = model.value
            lattice, sums = Lattice(names), {}
            for batch in batches:
                for lang in set(batch.column(0).to_pylist()):
                    mine = batch.filter(pc.equal(batch.column(0), lang))
                    n_of = dict(zip(mine.column(1).to_pylist(), mine.column(2).to_pylist()))
                    for n, group in by_length(n_of):
                        counts = np.array([n_of[w] for w in group], float)
                        sums[lang] = sums.get(lang, 0) + lattice.expected(group, counts, n, probs[:, columns[lang]])
            for lang, total in sums.items():
                at = np.flatnonzero(total[:-2])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["lang", "piece", "n"])

        small_batches(spark, 20_000)
        sums = words.mapInArrow(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((len(pieces) + 2, len(langs)), 0.1)
        np.add.at(counts, (sums["piece"].to_numpy(np.int64), sums["lang"].map(column).to_numpy(np.int64)), sums["n"].to_numpy(float))
        counts[-2:] = 0
        prob = counts / counts.sum(axis=0)
        prob[-2] = UNKNOWN
    return langs, prob


def predict(docs: DataFrame, langs: list[str], pieces: list[str], prob: np.ndarray, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with lang_pred and score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = source.columns[:-1]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    model = spark.sparkContext.broadcast((langs, pieces, prob))

    def score(batches):
        import pyarrow as pa

        found, names_of, probs = model.value
        lattice = Lattice(names_of) if found else None
        place: dict[str, int] = {}
        table = np.zeros((0, len(found)))
        for batch in batches:
            pred, sure = [], []
            docs_words = [stretches(letters(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            if found:
                fresh = {w for words in docs_words for w in words if w not in place}
                if len(place) + len(fresh) > KEPT_WORDS:
                    place, table = {}, np.zeros((0, len(found)))
                    fresh = {w for words in docs_words for w in words}
                made, rows = [table], len(table)
                for n, group in by_length(fresh):
                    place.update(zip(group, range(rows, rows + len(group))))
                    made.append(lattice.scores(group, n, probs))
                    rows += len(group)
                table = np.concatenate(made)
            for words in docs_words:
                if not words or not found:
                    pred.append("und")
                    sure.append(0.0)
                    continue
                total = table[np.fromiter(map(place.__getitem__, words), np.int64, len(words))].sum(axis=0)
                best = int(total.argmax())
                pred.append(found[best])
                sure.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(sure, pa.float64())], names=[*names, "lang_pred", "score"])

    return source.mapInArrow(score, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, model_file: str, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows whose id has crc32 remainder 2 of 4 are held out of training."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labelled = docs.where(~held & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string"))
    pieces = vocabulary(model_file)
    langs, prob = train(labelled, pieces, train_docs)
    return predict(docs, langs, pieces, prob, [F.col("doc_id"), held.alias("held_out")])
