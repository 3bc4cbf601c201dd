"""Substring deduplication by content-defined chunks.

A gear hash rolls over the words of a text: ``G = (G << 1) + gear(word)``.  A
word whose G has two given bits clear is a candidate; a candidate with no
candidate just before it ends a chunk; so does, where the ``QUIET`` words on
either side have no candidate, a word with the least G of them all, so text
that repeats a short line has a boundary in each line.  The rules look at
``QUIET`` + 2 words on either side at most, so inserting text moves no boundary
beyond that.  From each chunk
on, as many whole chunks as make ``MIN_WORDS`` words are one unit, named by
a 64-bit digest of its words; a unit whose digest occurred before (in the
order of ``doc_id``, then position) is a copy, and the union of copies is cut.
So every cut consists of passages of at least ``MIN_WORDS`` words that stay
elsewhere.  Of a passage of over 50 words that repeats, later copies lose what
lies in units; of 3 in 1,000 passages of 51 words no whole unit lies within.

Defined results: null texts and texts under ``MIN_WORDS`` words stay as they
are.  A row that repeats a ``doc_id`` and its text is the same document and is
cut alike; other ties go to the lower ``doc_id`` (null last), then to the lower
hash of the text.  White space does not count; the blanks around a cut become
one.  Text with a period of one word is one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paperlane.llm import arrays as A
from paperlane.llm.stored import settle

MIN_WORDS = 20
QUIET = 16
BITMAP_BITS = 25
_MASK = np.uint64(0b110)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_QINV = np.uint64(pow(int(_Q), -1, 1 << 64))


def chunk_ends(words: A.Words) -> np.ndarray:
    """For each word, whether a chunk ends with it."""
    n = len(words.hash)
    g = words.hash
    roll = g.copy()
    for back in (1, 2):  # bits 1 and 2 of G depend on three words
        shifted = np.zeros(n, np.uint64)
        shifted[back:] = g[:-back] << np.uint64(back)
        same = np.zeros(n, bool)
        same[back:] = words.row[back:] == words.row[:-back]
        roll += np.where(same, shifted, np.uint64(0))
    hit = (roll & _MASK) == 0
    end = hit.copy()
    end[1:] &= ~(hit[:-1] & (words.row[1:] == words.row[:-1]))
    border = np.unique(np.concatenate([np.flatnonzero(hit), words.first - 0.5]))  # a row's end lies between words
    begin, stop = np.floor(border[:-1]).astype(np.int64) + 1, np.ceil(border[1:]).astype(np.int64)
    for a, b in zip(*(x[stop - begin > 2 * QUIET] for x in (begin, stop)), strict=True):
        low = np.lib.stride_tricks.sliding_window_view(roll[a:b], 2 * QUIET + 1).min(axis=1)
        middle = np.arange(a + QUIET, b - QUIET)
        end[middle[(roll[middle] == low) & (roll[middle] != roll[middle - 1])]] = True
    last = words.first[1:][np.diff(words.first) > 0] - 1
    end[last] = True
    return end


def units(words: A.Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last and digest of each unit."""
    n = len(words.hash)
    if not n:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(0, np.uint64)
    stop = np.flatnonzero(chunk_ends(words)) + 1
    begin = np.concatenate([[0], stop[:-1]])
    reach = np.searchsorted(stop, begin + least, "left")
    ok = reach < len(stop)
    begin, reach = begin[ok], reach[ok]
    end = stop[reach]
    same = words.row[begin] == words.row[end - 1]
    begin, end = begin[same], end[same]
    powers = np.full(n + 1, _Q, np.uint64)
    down = np.full(n + 1, _QINV, np.uint64)
    powers[0] = down[0] = 1
    powers, down = np.cumprod(powers, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * powers[:-1], dtype=np.uint64)])
    return begin, end, A.mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def unit_table(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(digest, doc, mark, a, b): each unit with its document and character span; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            raw, offsets, w = A.spaced_words(batch.column("text"))
            begin, end, digest = units(w, least)
            at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            row = w.row[begin]
            zero = at[offsets[row]]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    A.as_signed(digest),
                    batch.column("doc").take(take),
                    batch.column("mark").take(take),
                    pa.array((at[w.start[begin]] - zero).astype(np.int32)),
                    pa.array((at[w.end[end - 1]] - zero).astype(np.int32)),
                ],
                ["digest", "doc", "mark", "a", "b"],
            )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
    return keyed.filter("text is not null").mapInArrow(run, "digest long, doc long, mark long, a int, b int")


def _repeated(first: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A filter by a bitmap of fixed size that drops most units whose digest occurs once; the join with ``first`` decides.

    A digest that a large part of all units has is aggregated where it is read
    before the first shuffle, and in the join an adaptive plan splits it.
    """
    slot = F.shiftright(F.col("digest").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)), 6)
    found = first.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(digest & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    if found.num_rows:
        bits[found.column("slot").to_numpy()] = found.column("bits").to_numpy()
    sent = first.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = batch.column("digest").to_numpy()
            word = sent.value[(digest & ((1 << BITMAP_BITS) - 1)) >> 6]
            yield batch.filter(pa.array((word >> (digest & 63) & 1).astype(bool)))

    return run


def cuts(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc, mark, spans, kept_in): the merged spans to cut of each document, and the documents where these passages stay."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = batch.column("pairs")
            first = np.asarray(pairs.offsets).astype(np.int64)
            values = np.asarray(pairs.values)[first[0] : first[-1]]
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            a, b = values >> 32, values & 0xFFFFFFFF
            order = np.lexsort((a, row))
            a, b, row = a[order], b[order], row[order]
            lift = row * (1 << 33)  # a running maximum that starts again in each row
            top = np.maximum.accumulate(b + lift)
            new = np.ones(len(a), bool)
            new[1:] = (a + lift)[1:] > top[:-1]
            new[1:] |= row[1:] != row[:-1]
            at = np.flatnonzero(new)
            until = top[np.concatenate([at[1:], [len(a)]]) - 1] - lift[at]
            flat = np.stack([a[at], until], 1).ravel()
            bounds = np.searchsorted(row[at], np.arange(batch.num_rows + 1)) * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), A.lists(pa.array(flat.astype(np.int32)), bounds), batch.column("kept_in")], ["doc", "mark", "spans", "kept_in"])

    units_ = unit_table(docs, least)
    at = F.struct(F.col("doc").isNull().alias("none"), "doc", "mark", "a")
    first = units_.groupBy("digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    first = settle(docs.sparkSession, first, "first")
    seen = units_.mapInArrow(_repeated(first), "digest long, doc long, mark long, a int, b int").join(first, "digest")
    copy = seen.filter(at != F.col("first")).withColumn("doc0", F.col("first.doc"))
    packed = F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")
    grouped = copy.groupBy("doc", "mark").agg(F.collect_set(packed).alias("pairs"), F.array_sort(F.collect_set("doc0")).alias("kept_in"))
    return grouped.mapInArrow(merge, "doc long, mark long, spans array<int>, kept_in array<long>")


def _with_cuts(docs: DataFrame, least: int) -> DataFrame:
    """``docs`` with ``text`` cut, and __pl_cut (characters cut) and __pl_kept_in beside."""
    found = cuts(docs, least).withColumnsRenamed({n: f"__pl_{n}" for n in ("doc", "mark", "spans", "kept_in")})
    text = F.col("text").cast("string")
    spans = F.col("__pl_spans")
    many = (F.size(spans) / 2).cast("int")

    def piece(k: Column) -> Column:  # what stays before the k-th cut, or after the last
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get(spans, 2 * k - 1))
        end = F.when(k < many, F.get(spans, 2 * k)).otherwise(F.lit(2**31 - 1))
        return F.trim(F.substring(text, begin + 1, end - begin))

    cut = F.array_join(F.filter(F.transform(F.sequence(F.lit(0), many), piece), lambda p: p != ""), " ")
    removed = F.aggregate(F.sequence(F.lit(0), many - 1), F.lit(0), lambda acc, k: acc + F.get(spans, 2 * k + 1) - F.get(spans, 2 * k))
    has = spans.isNotNull()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__pl_doc")) & (F.xxhash64(text) == F.col("__pl_mark"))
    joined = docs.join(found.hint("shuffle_hash"), same, "left")
    return joined.select(
        *[F.when(has, cut).otherwise(text).alias("text") if n == "text" else F.col(f"`{n}`") for n in docs.columns],
        F.when(has, removed).otherwise(F.lit(0)).alias("__pl_cut"),
        F.coalesce(F.col("__pl_kept_in"), F.array().cast("array<bigint>")).alias("__pl_kept_in"),
    )


def dedup(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Each document with its ``text`` after the cuts, ``cut_chars`` and ``kept_in``; these two replace columns of such a name."""
    done = _with_cuts(docs, least)
    names = [n for n in docs.columns if n not in ("cut_chars", "kept_in")]
    return done.select(*[F.col(f"`{n}`") for n in names], F.col("__pl_cut").alias("cut_chars"), F.col("__pl_kept_in").alias("kept_in"))


def without_copies(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` after the cuts, in their own columns; documents of which nothing is left go, ``n_chars`` follows where it is there."""
    done = _with_cuts(docs, least)
    done = done.filter((F.col("__pl_cut") == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("__pl_cut") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{n}`") for n in docs.columns])
