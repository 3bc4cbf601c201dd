"""Language-model scores from a weighted backoff automaton over words.

The model is of order three over folded words, from all n-grams of all
documents, so it grows with the corpus; none is dropped.  Counts are smoothed
by a Dirichlet prior on the history one word shorter (h'):

    p(w | h) = (c(hw) + PRIOR p(w | h')) / (c(h) + PRIOR)

c(h) counts the words after h; below all, a word has its count over all words
and one more, and a word that doesn't occur has that one.  A state is a history
of up to two words; it has an arc for each word that occurs after it, with its
log-probability, and a failure arc of weight log(PRIOR / (c(h) + PRIOR)) to the
history one word shorter.  A text is read from left to right: a state follows
from at most two words, so all words of a bucket move at once, and each takes
failure arcs until one of its states has an arc.  Texts of the corpus find an
arc at their longest history; others (``corpus``) back off.

Nothing is sent to all tasks, whatever the model's size.  Documents are
gathered in buckets of about ``BUCKET_BYTES``; a bucket sends its distinct
n-grams to the parts that own their histories, parts add up and answer each
bucket in the order in which it asked, and the bucket builds the automaton that
its own n-grams reach.  Words are owned by their own hash, so the empty history
is not in one place; all continuations of one other history are.  A bucket's
share of a hot history is one row, however often it occurs.  Asking and reading
use one shuffle of the texts.

Within a part a history is known by 40 bits of its hash, at any size of the
corpus, and a word after two others by 24: among a thousand words after the
same two, some two are taken for one with a chance of 3 %.
Defined results: a null text has a null score, a text without a word scores 0
with null bits.  Every row counts and is scored by itself, also one that repeats
a ``doc_id`` or has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from paperlane.llm import arrays as A

PRIOR = 4.0
BUCKET_BYTES = 4 << 20
HISTORY_BYTES = 5
WORD_BYTES = 3


@dataclass
class Grams:
    """The distinct words and bigrams of a bucket by hash, and trigrams by bigram: counts, counts with a word after them, and of each word its number (-1 for none)."""

    word: np.ndarray
    n1: np.ndarray
    c1: np.ndarray
    at1: np.ndarray
    pair: np.ndarray
    n2: np.ndarray
    c2: np.ndarray
    at2: np.ndarray
    many: np.ndarray
    last: np.ndarray
    n3: np.ndarray
    at3: np.ndarray


def grams(words: A.Words, counted: np.ndarray | None = None) -> Grams:
    """``counted`` says which texts count."""
    h, row = words.hash, words.row
    counts = (np.ones(len(h)) if counted is None else counted[row]).astype(float)
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = row[1:] == row[:-1]  # has a word before it in its text; shifted by one, a word after it
    second = np.flatnonzero(same[:-1])
    third = second[same[second - 1]] if len(second) else second
    value = A.mix(h + np.uint64(0x9E3779B97F4A7C15))
    word, at1 = np.unique(value, return_inverse=True)
    add = lambda at, by, size: np.bincount(at, by, size).astype(np.int64)
    pair, inner = np.unique(A.mix(value[second - 1] * np.uint64(0x9FB21C651E98DF25) + h[second]), return_inverse=True)
    at2 = np.full(len(h), -1)
    at2[second] = inner
    key = at2[third - 1] << 8 * WORD_BYTES | (value[third] & np.uint64((1 << 8 * WORD_BYTES) - 1)).astype(np.int64)
    both, inner = np.unique(key, return_inverse=True)
    at3 = np.full(len(h), -1)
    at3[third] = inner
    more = counts * same[1:]
    return Grams(
        word, add(at1, counts, len(word)), add(at1, more, len(word)), at1,
        pair, add(at2[second], counts[second], len(pair)), add(at2[second], more[second], len(pair)), at2,
        add(both >> 8 * WORD_BYTES, None, len(pair)), both & ((1 << 8 * WORD_BYTES) - 1), add(inner, counts[third], len(both)), at3,
    )


def _part(history: np.ndarray, parts: int) -> np.ndarray:
    """Rises with the history, so that the order by history is the order by part."""
    return ((history >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _of(table: pa.Table) -> A.Words:
    return A.folded_words(table.column("text").combine_chunks())


def _blobs(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """A binary for each stretch of ``values`` between the borders ``edge``."""
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer((edge * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _joined(rows: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows' binaries, and how many each row has."""
    column = rows.column(name)
    size = pc.binary_length(column).to_numpy() // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), size


def _numbers(name: str, values: np.ndarray, edge: np.ndarray) -> dict[str, pa.Array]:
    """Whole numbers as one byte each, and those from 255 on once more in full."""
    big = values >= 255
    above = np.concatenate([[0], np.cumsum(big)])[edge]
    return {name: _blobs(np.minimum(values, 255).astype(np.uint8), edge), f"{name}_big": _blobs(values[big].astype(np.int64), above)}


def _read(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    low, size = _joined(rows, name, np.uint8)
    out = low.astype(np.int64)
    out[low == 255] = _joined(rows, f"{name}_big", np.int64)[0]
    return out, size


_COUNTS = "{0} binary, {0}_big binary"
_ASKED = ", ".join(["part long, bucket long, k int, id binary, last binary", *map(_COUNTS.format, ("n", "c", "many", "n3"))])
_ANSWERED = ", ".join(["part long, bucket long, k int", *map(_COUNTS.format, ("n", "c", "n3"))])
_SCORES = "doc_id long, n_bytes long, logprob double, bits_per_byte double"


def _none(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    return pa.table({n: pa.array([], kinds[t]) for n, t in (c.split() for c in schema.split(", "))})


def _octets(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :width]


def _whole(octets: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(octets) // width, 8), np.uint8)
    out[:, :width] = octets.reshape(-1, width)
    return out.view(np.int64).ravel()


def _ask(table: pa.Table, parts: int) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    g = grams(_of(table), table.column("counted").to_numpy().astype(float))
    nothing = np.zeros(0, np.int64)
    found = []
    for k, (ids, n, c, many, last, n3) in enumerate(((g.word, g.n1, g.c1, nothing, nothing, nothing), (g.pair, g.n2, g.c2, g.many, g.last, g.n3)), 1):
        part, first = np.unique(_part(ids, parts), return_index=True)
        if not len(part):
            continue
        edge = np.append(first, len(ids))
        none = np.zeros(len(edge), np.int64)
        inner = none if k == 1 else np.concatenate([[0], np.cumsum(many)])[edge]
        found.append(
            pa.table({
                "part": part, "bucket": np.full(len(part), bucket), "k": np.full(len(part), k, np.int32),
                "id": _blobs(_octets(ids, HISTORY_BYTES), edge), "last": _blobs(_octets(last, WORD_BYTES), inner),
                **_numbers("n", n, edge), **_numbers("c", c, edge), **_numbers("many", many, none if k == 1 else edge), **_numbers("n3", n3, inner),
            })
        )
    return pa.concat_tables(found) if found else _none(_ASKED)


def _answer(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py()
    out = []
    for k in (1, 2):
        rows = table.filter(pc.equal(table.column("k"), k))
        if not rows.num_rows:
            continue
        (n, size), (c, _), (many, _), (n3, size3) = (_read(rows, x) for x in ("n", "c", "many", "n3"))
        distinct, own = np.unique(_whole(_joined(rows, "id", np.uint8)[0], HISTORY_BYTES), return_inverse=True)
        total = lambda by, to, most: np.bincount(to, by, most).astype(np.int64)[to]
        edge, inner = (np.concatenate([[0], np.cumsum(x)]) for x in (size, size3))
        if k == 2:
            key = np.repeat(own, many) << 8 * WORD_BYTES | _whole(_joined(rows, "last", np.uint8)[0], WORD_BYTES)
            both, at = np.unique(key, return_inverse=True)
            n3 = total(n3, at, len(both))
        answer = {**_numbers("n", total(n, own, len(distinct)), edge), **_numbers("c", total(c, own, len(distinct)), edge), **_numbers("n3", n3, inner)}
        out.append(pa.table({"part": np.full(rows.num_rows, part), "bucket": rows.column("bucket"), "k": rows.column("k"), **answer}))
    return pa.concat_tables(out)


def _weights(words: A.Words, answers: pa.Table, total: int) -> np.ndarray:
    """The weight of the path that each word of a bucket takes: failure arcs, then the arc of the word."""
    g = grams(words)
    one, two = (answers.filter(pc.equal(answers.column("k"), k)).sort_by("part") for k in (1, 2))
    (n1, c1), (n2, c2, n3) = (_read(one, x)[0] for x in ("n", "c")), (_read(two, x)[0] for x in ("n", "c", "n3"))
    arc = np.maximum(n1[g.at1], 1) / (total + 1)
    path = np.zeros(len(arc))
    second, third = np.flatnonzero(g.at2 >= 0), np.flatnonzero(g.at3 >= 0)
    for at, n, c in ((second, n2[g.at2[second]], c1[g.at1[second - 1]]), (third, n3[g.at3[third]], c2[g.at2[third - 1]])):
        back, has = PRIOR / (c + PRIOR), n > 0
        taken, left = at[has], at[~has]
        # an arc holds the smoothed probability, so the failure arcs below it are in the number already
        arc[taken] = n[has] / (c[has] + PRIOR) + back[has] * arc[taken] * np.exp(path[taken])
        path[taken] = 0.0
        path[left] += np.log(back[~has])
    return path + np.log(arc)


def _size(docs: DataFrame) -> tuple[int, int]:
    """Bytes of all texts, and words of those that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        octets = many = 0
        for batch in A.slices(batches, "text"):
            raw, offsets = A.utf8(pc.utf8_lower(batch.column("text").cast(pa.large_string())))
            octets += len(raw)
            many += int(np.diff(A.split(raw, offsets, A._WORD)[3])[batch.column("counted").to_numpy(zero_copy_only=False)].sum())
        yield pa.RecordBatch.from_arrays([pa.array([octets]), pa.array([many])], ["octets", "many"])

    found = docs.select("text", "counted").mapInArrow(run, "octets long, many long").agg(F.sum("octets"), F.sum("many")).first()
    return found[0] or 0, found[1] or 0


def scores(docs: DataFrame, bucket: int = BUCKET_BYTES, corpus: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_bytes, logprob, bits_per_byte) of every row under the model of ``corpus``, or of them all."""
    own = corpus is None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(own).alias("counted"), F.lit(True).alias("scored"))
    if not own:
        texts = texts.unionByName(corpus.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(True).alias("counted"), F.lit(False).alias("scored")))
    size, total = _size(texts)
    parts = max(1, -(-size // bucket))
    keyed = texts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _none(_SCORES)
        words = _of(rows)
        none = rows.column("text").is_null().to_numpy()
        octets = pc.binary_length(rows.column("text")).fill_null(0).to_numpy().astype(np.int64)
        weights = _weights(words, told, total) if len(words.hash) else np.zeros(0)
        logprob = np.bincount(words.row, weights, rows.num_rows).astype(float)
        bits = -logprob / np.log(2) / np.maximum(octets, 1)
        wordless = np.diff(words.first) == 0
        return pa.table({"doc_id": rows.column("doc_id"), "n_bytes": pa.array(octets, mask=none), "logprob": pa.array(logprob, mask=none), "bits_per_byte": pa.array(bits, mask=none | wordless)}).filter(rows.column("scored"))

    answers = keyed.groupBy("bucket").applyInArrow(lambda t: _ask(t, parts), _ASKED).groupBy("part").applyInArrow(_answer, _ANSWERED)
    return keyed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, _SCORES)
