"""Quality classifier: regularised quadratic discriminant over document statistics.

Labels make three classes: clean (quality 1, not toxic), junk (quality 0) and
toxic.  Each class is a normal density over transformed statistics of the
text: lengths, the shares of kinds of bytes and words, repetition, and the
rate of words that the labels show to mark toxic texts.  A class covariance is
shrunk towards the pooled one and its diagonal, and kept as the inverse of its
Cholesky factor.  The score of a document is the log-density (with prior) of
the clean class less that of the likeliest other class; below 0 it is rejected.

The model is fitted on at most ``MAX_TRAIN`` labelled documents, those with the
lowest hash of ``doc_id``; all else covers every document.

Defined results: null texts and texts without a word are rejected (score null).
Labels with a null in ``doc_id``, ``quality`` or ``toxic`` are left out; of
several labels of a document the lowest quality and highest toxicity count.
Without labels of clean documents, or of no others, nothing is rejected but
texts without a word.  A row that repeats a ``doc_id`` is scored by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from paperlane.llm import arrays as A
from paperlane.llm.stored import settle

MAX_TRAIN = 20_000
MIN_MARKED = 5
MIN_ODDS = 12.0
STEMS = (4, 5, 6)  # bytes
SHRINK_POOLED = 0.10
SHRINK_DIAGONAL = 0.05
CLEAN, JUNK, TOXIC = 0, 1, 2

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 punctuation of prose, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 4
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 5
FEATURES = ("log_words", "word_length", "upper", "digit", "other", "prose_marks", "beyond_ascii", "distinct", "repeated_neighbour", "wordless", "line_words", "distinct_lines", "marked_words")


def statistics(texts: pa.Array, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, features) of transformed statistics, and which rows have a word.  ``lexicon``: sorted hashes of marked words."""
    rows = len(texts)
    raw, offsets = A.utf8(texts)
    start, end, row, first = A.split(raw, offsets, ~A._SPACE)
    words = np.diff(first).astype(float)
    many = np.maximum(words, 1)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    kinds = np.bincount(owner * 7 + _KIND[raw], minlength=rows * 7).reshape(rows, 7) / size[:, None]
    share = lambda hits, of: np.bincount(of[hits], minlength=rows)

    pieces = A.span_hash(raw, start, end)
    keyed = A.mix(pieces + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed)
    fresh = np.ones(len(keyed), bool)
    fresh[1:] = keyed[order][1:] != keyed[order][:-1]
    distinct = share(order[fresh], row)
    again = np.zeros(len(pieces), bool)
    again[1:] = (pieces[1:] == pieces[:-1]) & (row[1:] == row[:-1])
    letters = np.concatenate([[0], np.cumsum(np.isin(_KIND[raw], (1, 2, 6)))])
    bare = letters[end] == letters[start]

    a, b, line_row, line_first = A.split(raw, offsets, np.arange(256) != 10)
    lines = np.diff(line_first)
    line_key = A.mix(A.span_hash(raw, a, b) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    line_order = np.argsort(line_key)
    new_line = np.ones(len(line_key), bool)
    new_line[1:] = line_key[line_order][1:] != line_key[line_order][:-1]
    folded, forms = _forms(texts)
    mark = np.zeros(folded[-1] + 1, bool)
    for number, value in forms:
        mark[number[_member(value, lexicon)]] = True
    marked = np.diff(np.concatenate([[0], np.cumsum(mark)])[folded])
    root = lambda x: np.sqrt(np.clip(x, 0, None))
    out = np.stack(
        [
            np.log1p(words),
            np.log(size / many),
            root(kinds[:, 2]),
            root(kinds[:, 3]),
            root(kinds[:, 0]),
            root(kinds[:, 5]),
            root(kinds[:, 6]),
            distinct / many + 0.1 * np.log1p(words) - 0.1,  # falls with length alone; the second term takes most of that out
            root(share(np.flatnonzero(again), row) / many),
            root(share(np.flatnonzero(bare), row) / many),
            np.log1p(words / np.maximum(lines, 1)),
            np.bincount(line_row[line_order[new_line]], minlength=rows) / np.maximum(lines, 1),
            root(marked / np.maximum(np.diff(folded), 1)),
        ],
        axis=1,
    )
    return out, words > 0


def _forms(texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Row borders of the folded words, and (word number, hash) of the words and of their beginnings, by which inflected forms are known."""
    raw, offsets = A.utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    start, end, _, first = A.split(raw, offsets, A._WORD)
    every = np.arange(len(start))
    forms = [(every, A.span_hash(raw, start, end))]
    for k in STEMS:
        longer = every[end - start > k]
        forms.append((longer, A.mix(A.span_hash(raw, start[longer], start[longer] + k) + np.uint64(k))))
    return first, forms


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and constants of the classes that have labels, and the lexicon."""

    lexicon: np.ndarray
    classes: tuple[int, ...]
    mean: np.ndarray
    whiten: np.ndarray
    constant: np.ndarray

    def densities(self, x: np.ndarray) -> np.ndarray:
        """Log-density plus log-prior, (rows, classes)."""
        out = np.empty((len(x), len(self.classes)))
        for k in range(len(self.classes)):
            z = (x - self.mean[k]) @ self.whiten[k].T
            out[:, k] = self.constant[k] - 0.5 * (z * z).sum(axis=1)
        return out

    def score(self, texts: pa.Array) -> pa.Array:
        """Per text, null where it has no word."""
        parts = []
        for batch in A.slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text"):
            x, has = statistics(batch.column(0), self.lexicon)
            if CLEAN in self.classes and len(self.classes) > 1:
                d = self.densities(x)
                clean = self.classes.index(CLEAN)
                s = d[:, clean] - np.delete(d, clean, axis=1).max(axis=1)
            else:
                s = np.zeros(len(x))
            parts.append(pa.array(s, mask=~has))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.float64())


def quadratic(count: np.ndarray, total: np.ndarray, square: np.ndarray) -> tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]:
    """Class means, inverse Cholesky factors and constants from counts, sums and sums of outer products."""
    classes = tuple(int(k) for k in np.flatnonzero(count))
    mean = total[list(classes)] / count[list(classes), None]
    scatter = [square[k] - count[k] * np.outer(m, m) for k, m in zip(classes, mean, strict=True)]
    pooled = sum(scatter) / max(count.sum() - len(classes), 1)
    scale = np.maximum(np.diag(pooled), 1e-6)
    whiten, constant = [], []
    for k, s in zip(classes, scatter, strict=True):
        n = count[k]
        own = s / max(n - 1, 1)
        trust = n / (n + 2 * len(scale))  # few documents: nearly the pooled covariance
        cov = trust * own + (1 - trust) * pooled
        cov = (1 - SHRINK_POOLED) * cov + SHRINK_POOLED * pooled
        cov = (1 - SHRINK_DIAGONAL) * cov + SHRINK_DIAGONAL * np.diag(np.diag(cov)) + np.diag(1e-3 * scale + 1e-9)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        constant.append(np.log(n / count.sum()) - np.log(np.diag(factor)).sum())
    return classes, mean, np.array(whiten), np.array(constant)


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(class, text) of at most ``most`` labelled documents."""
    spark = docs.sparkSession
    one = labels.select(F.col("doc_id").cast("long").alias("__pl_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).dropna()
    one = one.groupBy("__pl_id").agg(F.min("q").alias("q"), F.max("t").alias("t")).orderBy(F.xxhash64("__pl_id"), "__pl_id").limit(most)
    kind = F.when(F.col("q") == 0, JUNK).when(F.col("t") == 1, TOXIC).otherwise(CLEAN)
    one = settle(spark, one.select("__pl_id", kind.alias("class"), F.col("t").alias("toxic")), "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("__pl_doc"), F.col("text").cast("string").alias("text")).filter("text is not null")
    # at most ``most`` rows of 16 bytes: a broadcast of bounded size
    return settle(spark, texts.join(F.broadcast(one), F.col("__pl_doc") == F.col("__pl_id")).select("class", "toxic", "text"), "labelled")


def lexicon_of(train: DataFrame) -> np.ndarray:
    """Hashes of words, and of beginnings of words, whose share among toxic documents is ``MIN_ODDS`` times that among others.

    Each stands in 1 of 100 toxic documents or more, of at most ``MAX_TRAIN``, which bounds what reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            first, forms = _forms(batch.column("text"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            toxic = batch.column("toxic").to_numpy().astype(np.int64)
            key = np.concatenate([np.stack([value.view(np.int64), row[number]], 1) for number, value in forms])
            key = key[np.lexsort((key[:, 1], key[:, 0]))]
            key = key[np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])] if len(key) else key
            words, at = np.unique(key[:, 0], return_index=True)
            if len(words):
                is_toxic = toxic[key[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.add.reduceat(is_toxic, at)), pa.array(np.add.reduceat(1 - is_toxic, at))], ["word", "yes", "no"])

    size = train.groupBy("toxic").count().collect()
    yes, no = (sum(r["count"] for r in size if r.toxic == k) for k in (1, 0))
    if not yes or not no:
        return np.zeros(0, np.uint64)
    odds = (F.col("yes") / yes) / ((F.col("no") + 0.5) / (no + 1.0))
    least = max(MIN_MARKED, yes // 100)
    counted = train.select("toxic", "text").mapInArrow(run, "word long, yes long, no long").groupBy("word").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    found = counted.filter((F.col("yes") >= least) & (odds >= MIN_ODDS)).select("word").toArrow()
    return np.sort(found.column("word").to_numpy().astype(np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """The model of ``labels`` over ``docs``; its sums are added up in Spark, only they reach the driver."""
    train = labelled(docs, labels, most)
    lexicon = lexicon_of(train)
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            x, has = statistics(batch.column("text"), lexicon)
            kind = batch.column("class").to_numpy()
            for k in np.unique(kind[has]):
                mine = x[has & (kind == k)]
                flat = np.concatenate([[len(mine)], mine.sum(axis=0), (mine.T @ mine).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), k, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["class", "at", "value"])

    sums = train.select("class", "text").mapInArrow(run, "class int, at int, value double").groupBy("class", "at").agg(F.sum("value").alias("value")).toArrow().to_pydict()
    flat = np.zeros((3, 1 + d + d * d))
    for k, at, value in zip(sums["class"], sums["at"], sums["value"], strict=True):
        flat[k, at] = value
    if not flat[:, 0].any():
        return Model(lexicon, (), np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0))
    return Model(lexicon, *quadratic(flat[:, 0], flat[:, 1 : 1 + d], flat[:, 1 + d :].reshape(3, d, d)))


def score(model: Model, text: Column) -> Column:
    """The score column; Arrow batches of the text alone go to Python."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return model.score(pc.cast(texts, pa.large_string()))

    return run(text.cast("string"))


def accepted(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """``docs`` that the classifier accepts, with ``__pl_score``."""
    model = fit(docs, labels, most)
    return docs.withColumn("__pl_score", score(model, F.col("text"))).filter("__pl_score >= 0")
