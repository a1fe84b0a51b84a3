"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bound_batches, raw, slices

#: A-Z in lower case, ASCII punctuation and controls as blanks.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
BITS = 20
WIDTHS = (1, 2, 3)
FILTERS, DIMENSIONS = 8, 8
STEM = 5
CACHE = 200_000


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, lower-cased (A-Z) and parted by all ASCII that is neither letter nor digit."""
    return text.translate(PLAIN).split()


def two_hashes(word: bytes) -> int:
    """The buckets of a word and of its stem, the first STEM letters, in one integer."""
    stem = word.decode("utf-8", "replace")[:STEM].encode()
    return xxhash.xxh64_intdigest(word, 17) >> 64 - BITS | xxhash.xxh64_intdigest(stem, 18) >> 64 - BITS << BITS


def halves(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of words and of stems."""
    return codes & ((1 << BITS) - 1), codes >> BITS


class Hasher:
    """Words to bucket pairs, kept in a cache that is emptied when full."""

    def __init__(self, most: int = CACHE):
        self.most, self.cache = most, {}

    def __call__(self, parts: list[list[bytes]]) -> np.ndarray:
        cache = self.cache
        if len(cache) > self.most:
            cache.clear()
        for word in set(chain.from_iterable(parts)).difference(cache):
            cache[word] = two_hashes(word)
        return np.fromiter(map(cache.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))


class TextCnn:
    """Embeddings (the sum of a row hashed from the word and one hashed from its stem), filters of several widths, max pooling, a logistic output.

    Rows are kept for known buckets only; all others share row 0, which is zero. Filters pass a linear unit that
    cuts negatives. Texts are padded with width - 1 zero rows, so that short and empty texts have windows too;
    an empty text gets the score of the bias alone.
    """

    def __init__(self, known: list[np.ndarray], seed: int = 5):
        """known: the sorted buckets of words and those of stems that have rows."""
        rng = np.random.default_rng(seed)
        self.known = [np.asarray(k, np.int32) for k in known]
        self.tables = [0.02 * rng.standard_normal((len(k) + 1, DIMENSIONS), np.float32) for k in self.known]
        for t in self.tables:
            t[0] = 0
        self.filters = [0.4 * rng.standard_normal((w, DIMENSIONS, FILTERS), np.float32) for w in WIDTHS]
        self.offsets = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = 0.4 * rng.standard_normal(len(WIDTHS) * FILTERS, np.float32)
        self.bias = np.float32(-1)
        self.index()

    @classmethod
    def over(cls, texts: list[np.ndarray], least: int, seed: int = 5) -> TextCnn:
        """A model with rows for the buckets that occur in `least` of the texts or more."""
        seen = [np.zeros(1 << BITS, np.int32) for _ in range(2)]
        for t in texts:
            for k, part in enumerate(halves(np.unique(t))):
                seen[k][np.unique(part)] += 1
        return cls([np.flatnonzero(x >= least) for x in seen], seed)

    def index(self) -> None:
        """Row numbers by bucket, 4 MB for words and 4 MB for stems."""
        self.row = np.zeros((2, 1 << BITS), np.int32)
        for row, k in zip(self.row, self.known, strict=True):
            row[k] = np.arange(1, len(k) + 1)

    def embed(self, codes: np.ndarray) -> np.ndarray:
        return sum(t[row[part]] for t, row, part in zip(self.tables, self.row, halves(codes), strict=True))

    def pooled(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest filter values of each text and where they stand; rows: embeddings of all texts, each padded."""
        stops = np.cumsum(sizes + len(WIDTHS) - 1)
        starts = stops - (sizes + len(WIDTHS) - 1)
        top = np.zeros((len(sizes), len(WIDTHS) * FILTERS), np.float32)
        where = np.full(top.shape, -1, np.int64)
        for j, (w, f, b) in enumerate(zip(WIDTHS, self.filters, self.offsets, strict=True)):
            n = len(rows) - w + 1
            values = rows[:n] @ f[0]
            for k in range(1, w):
                values += rows[k : k + n] @ f[k]
            values += b
            some = np.flatnonzero(sizes > 0)
            if len(some):
                # Windows of a text begin at its rows; those over the padding end in zeros.
                bounds = np.stack((starts[some], np.minimum(stops[some] - w + 1, n)), axis=1).ravel()
                inner = bounds if bounds[-1] < n else bounds[:-1]
                best = np.maximum.reduceat(values, inner, axis=0)[::2]
                top[some, j * FILTERS : (j + 1) * FILTERS] = np.maximum(best, 0)
                if self.training:
                    for i, (a, z) in zip(some, bounds.reshape(-1, 2), strict=True):
                        where[i, j * FILTERS : (j + 1) * FILTERS] = a + values[a:z].argmax(axis=0)
        return top, where

    training = False

    def padded(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings with zero rows after each text, and the row of each word."""
        extra = len(WIDTHS) - 1
        place = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)) * extra, sizes)
        rows = np.zeros((len(codes) + len(sizes) * extra, DIMENSIONS), np.float32)
        rows[place] = self.embed(codes)
        return rows, place

    def logits(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        rows, _ = self.padded(codes, sizes)
        top, _ = self.pooled(rows, sizes)
        return top @ self.out + self.bias

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 5) -> None:
        """Adagrad on the logistic loss; positive texts weigh as much as negative ones in all."""
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        params = [*self.filters, *self.offsets, self.out]
        memory = [np.full(p.shape, 0.1, np.float32) for p in params]
        bias_memory, table_memory = 0.1, [np.full(t.shape, 0.1, np.float32) for t in self.tables]
        rng, self.training = np.random.default_rng(seed), True
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                ids = order[at : at + batch]
                sizes = np.array([len(texts[i]) for i in ids])
                codes = np.concatenate([texts[i] for i in ids]) if sizes.sum() else np.zeros(0, np.int64)
                grads, bias_grad, table_grads = self.gradients(codes, sizes, labels[ids], weight[ids] / len(ids), decay)
                for x, m, g in zip(params, memory, grads, strict=True):
                    m += g * g
                    x -= rate * g / np.sqrt(m)
                bias_memory += bias_grad**2
                self.bias -= np.float32(rate * bias_grad / np.sqrt(bias_memory))
                for table, m, (rows, g) in zip(self.tables, table_memory, table_grads, strict=True):
                    m[rows] += g * g
                    table[rows] -= rate * g / np.sqrt(m[rows])
        self.training = False

    def gradients(self, codes: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weight: np.ndarray, decay: float) -> tuple[list[np.ndarray], float, list[tuple[np.ndarray, np.ndarray]]]:
        """Gradients of the weighted logistic loss with decay: of filters, offsets and output; of the bias; of the rows of each table that the texts touch."""
        rows, place = self.padded(codes, sizes)
        top, where = self.pooled(rows, sizes)
        p = 1 / (1 + np.exp(-(top @ self.out + self.bias)))
        error = ((p - labels) * weight).astype(np.float32)
        grads = [np.zeros_like(x) for x in (*self.filters, *self.offsets, self.out)]
        grads[-1] = top.T @ error + decay * self.out
        back = (error[:, None] * self.out[None]) * (top > 0)
        row_grad = np.zeros_like(rows)
        for j, w in enumerate(WIDTHS):
            i, f = np.nonzero(back[:, j * FILTERS : (j + 1) * FILTERS])
            g, start = back[i, j * FILTERS + f], where[i, j * FILTERS + f]
            np.add.at(grads[len(WIDTHS) + j], f, g)
            for k in range(w):
                np.add.at(grads[j][k].T, f, g[:, None] * rows[start + k])
                np.add.at(row_grad, start + k, g[:, None] * self.filters[j][k].T[f])
            grads[j] += decay * self.filters[j]
        word_grad = row_grad[place]
        touched = np.flatnonzero(np.any(word_grad != 0, axis=1))
        table_grads = []
        for table, row, part in zip(self.tables, self.row, halves(codes[touched]), strict=True):
            unique, inverse = np.unique(row[part], return_inverse=True)
            g = np.zeros((len(unique), DIMENSIONS), np.float32)
            np.add.at(g, inverse, word_grad[touched])
            some = unique > 0  # row 0 stays zero
            table_grads.append((unique[some], g[some] + decay * table[unique[some]]))
        return grads, float(error.sum()), table_grads

    def packed(self) -> tuple:
        """The model, for sending: its known buckets and their rows."""
        return self.known, self.tables, self.filters, self.offsets, self.out, self.bias

    @classmethod
    def unpacked(cls, state: tuple) -> TextCnn:
        model = cls.__new__(cls)
        model.known, model.tables, model.filters, model.offsets, model.out, model.bias = state
        model.index()
        return model


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def best_threshold(scores: np.ndarray, labels: np.ndarray, prior: float = 3.0) -> float:
    """The score that parts the classes with the fewest errors, drawn to 0.5 as by `prior` rows of each class."""
    if not len(scores):
        return 0.5
    cuts = np.linspace(0.02, 0.98, 97)
    errors = np.array([((scores >= c) != (labels == 1)).sum() + prior * abs(c - 0.5) for c in cuts])
    return float(np.median(cuts[errors == errors.min()]))


def learnt(codes: list[np.ndarray], labels: np.ndarray, langs: np.ndarray, aside: np.ndarray, least: int | None = None) -> tuple[TextCnn, dict[str, float]]:
    """A model and thresholds from texts as codes; those aside set the output scale and the thresholds (see train())."""
    thresholds: dict[str, float] = {}
    if len(set(labels.tolist())) < 2:
        model = TextCnn([np.zeros(0, np.int32)] * 2)
        model.out[:] = 0
        model.bias = np.float32(5 if len(labels) and labels[0] else -5)
        return model, thresholds
    if least is None:
        least = max(2, min(8, int(np.bincount(labels).min()) // 25))

    def logits(m: TextCnn, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([m.logits(codes[i], np.array([len(codes[i])])) for i in ids]) if len(ids) else np.zeros(0)

    inside, outside = np.flatnonzero(~aside), np.flatnonzero(aside)
    shift = 0.0
    if len(set(labels[inside].tolist())) == 2 and len(set(labels[outside].tolist())) == 2:
        some = [codes[i] for i in inside]
        trial = TextCnn.over(some, least)
        trial.fit(some, labels[inside])
        z = logits(trial, outside)
        cut = best_threshold(1 / (1 + np.exp(-z)), labels[outside])
        shift = float(np.log(cut / (1 - cut)))
        scores = 1 / (1 + np.exp(-(z - shift)))
        thresholds = {g: best_threshold(scores[langs[outside] == g], labels[outside][langs[outside] == g]) for g in sorted(set(langs[outside].tolist()))}
    model = TextCnn.over(codes, least)
    model.fit(codes, labels)
    model.bias -= np.float32(shift)
    return model, thresholds


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 4000, most_words: int = 4000, most_bytes: int = 40_000, least: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> tuple[TextCnn, dict[str, float]]:
    """A model and a threshold for each language, learnt from labelled rows that aren't held out.

    At most most_rows rows of each class are taken, those with the smallest hashes of their ids, and of them the
    texts up to most_words words and most_bytes bytes. They are learnt from in one task of an executor, which
    holds them as 8 bytes a word; only the model comes to the driver. A fifth of the rows (fold 1) sets
    the output scale and the thresholds by language; then the model is fitted again on all of them.
    least: in how many training texts a word or stem must stand to count; None: a 25th of the rows of the
    smaller class, at least 2 and at most 8.
    Labels that are null or neither 0 nor 1, and rows without text, are left out. An id labelled both ways counts
    as toxic. Of rows that repeat an id, the smallest text is taken. With a single class the model says
    that class's share throughout; without rows, that nothing is toxic.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 0)
    pick = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    chosen = F.broadcast(pick(0).unionByName(pick(1)))  # 2 * most_rows rows of two numbers at most
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    texts = texts.where(F.octet_length("text") <= most_bytes).join(chosen, "doc_id").where(F.size(F.split(F.col("text"), "[ \n\t]")) <= most_words)
    texts = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("row"))
    rows = texts.select("doc_id", "toxic", (fold(F.col("doc_id")) == 1).alias("aside"), "row.*").repartition(1).sortWithinPartitions("doc_id")
    bound_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, codes, rest = Hasher(), [], []
        for part in batches:
            codes += [hasher([words_of(x)]) for x in raw(part.column("text"))]
            rest += zip(*(part.column(x).to_pylist() for x in ("toxic", "aside", "lang")), strict=True)
        toxic, aside, langs = (np.array([r[i] for r in rest], kind) for i, kind in enumerate((np.int64, bool, object)))
        model, thresholds = learnt(codes, toxic, langs, aside, least)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.packed(), thresholds))], pa.binary())], ["state"])

    found = rows.select("text", "lang", "toxic", "aside").mapInArrow(work, "state binary").collect()  # one row, or none without rows
    if not found:
        return learnt([], np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, bool))
    state, thresholds = pickle.loads(found[0]["state"])
    return TextCnn.unpacked(state), thresholds


def toxicity(docs: DataFrame, model: TextCnn, thresholds: dict[str, float], text_col: str = "text", lang_col: str = "lang", score_col: str = "toxic_score", flag_col: str = "toxic_flag") -> DataFrame:
    """All columns of docs, then score_col (0 to 1) and flag_col: score >= the threshold of the row's language.

    Scores come from whole texts alone. Null text counts as empty. Languages without a threshold, null
    included, use 0.5. The two new names must not be among the columns of docs. An empty table gives no rows.
    """
    spark = docs.sparkSession
    if clash := {score_col.lower(), flag_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has {sorted(clash)} already")
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model.packed())  # 40 bytes for each known bucket, 2 * 2^BITS of them at most
    state: dict = {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = state.setdefault("model", TextCnn.unpacked(sent.value))
        hasher = state.setdefault("hasher", Hasher())
        for part in slices(batches, text_col):
            parts = [words_of(x) for x in raw(part.column(text_col))]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            score = 1 / (1 + np.exp(-m.logits(hasher(parts), sizes).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, score_col])

    scored = docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
    limit = F.lit(0.5)
    for lang, t in thresholds.items():
        limit = F.when(F.col(lang_col) == lang, F.lit(t)).otherwise(limit)
    return scored.withColumn(flag_col, F.col(score_col) >= limit)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; learnt from the rows of labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, thresholds = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity(docs.select("doc_id", "text", "lang"), model, thresholds)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.col("toxic_flag").alias("flagged"))
