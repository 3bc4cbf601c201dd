"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words; the masked-out positions are
ignored, so a hit survives a substitution there.  Hashes of all windows of the
test items and of all documents are joined on equal hash, and at each hit the
two texts are laid over each other without gaps: the overlap is the longest
stretch of which at least ``MIN_SAME`` of the words are equal.  It counts when
it covers ``MIN_OVERLAP`` words, or the whole item where that is shorter.

``MASKS`` miss no such overlap: each way of placing a quarter of other words
in 6 to 25 words leaves one of the masks a place, and of a longer stretch one
half or the other is such a stretch itself.

Before the join, a bitmap of fixed size built from the test hashes drops
document windows that can't match; it is correct for any number of test items
(a full bitmap drops nothing), so the join alone decides and its strategy is
left to the optimizer's size estimates.

Defined results: null and empty texts and items, and items of fewer words than
``MIN_ITEM``, give no overlap.  Items shorter than a mask are compared through
the masks cut to their length.  Rows that repeat a ``doc_id`` or an ``item_id``
give one row for each pair, of the best overlap (most equal words, then
longest).  A null ``doc_id`` or ``item_id`` is kept as null in the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paperlane.llm import arrays as A
from paperlane.llm.stored import settle

MASKS = ("11101", "100111", "1101001")
MIN_OVERLAP = 13
MIN_ITEM = 6
MIN_SAME = 0.75
BITMAP_BITS = 24


def _offsets(mask: str, n: int) -> np.ndarray:
    return np.array([i for i, c in enumerate(mask[:n]) if c == "1"])


def seeds(words: A.Words, mask: str, number: int, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of every window of one mask that lies within a row; ``length`` cuts the mask."""
    n = len(mask) if length is None else min(length, len(mask))
    h = words.hash
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.row[: len(h) - n + 1] == words.row[n - 1 :])
    value = np.full(len(at), 0x2545F4914F6CDD1D * (number * 32 + n + 1) % 2**64, np.uint64)
    for k, off in enumerate(_offsets(mask, n)):
        value = value * np.uint64(0x9FB21C651E98DF25) + h[at + off] * np.uint64(2 * k + 1)
    return at, A.mix(value)


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """(item, hash, at, words): the windows of each item, with the item's word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text", 1 << 18):
            w = A.folded_words(batch.column("text"))
            many = np.diff(w.first)
            for number, mask in enumerate(MASKS):
                for n in [None, *range(MIN_ITEM, len(mask))]:
                    at, value = seeds(w, mask, number, n)
                    fits = (many[w.row[at]] == n) if n else (many[w.row[at]] >= len(mask))
                    at, value = at[fits], value[fits]
                    row = w.row[at]
                    texts = A.lists(A.as_signed(w.hash), w.first)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("item_id").take(pa.array(row)), A.as_signed(value), pa.array((at - w.first[row]).astype(np.int32)), texts.take(pa.array(row))],
                        ["item", "hash", "at", "words"],
                    )

    src = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return src.mapInArrow(run, "item long, hash long, at int, words array<long>")


def _bitmap(tests: DataFrame) -> np.ndarray:
    """A bit for each of two parts of BITMAP_BITS of a test hash, gathered as at most 2**BITMAP_BITS / 64 words."""
    part = F.explode(F.array(F.col("hash"), F.shiftrightunsigned("hash", BITMAP_BITS))).alias("part")
    slot = F.shiftright(F.col("part").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)), 6).alias("slot")
    bit = F.expr("shiftleft(1L, cast(part & 63 as int))").alias("bit")
    found = tests.select(part).select(slot, bit).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    if found.num_rows:
        words[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


def document_regions(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """(doc, from, words, hits): stretches of documents around windows that the bitmap lets through.

    Windows less than two contexts apart share a stretch, so its words are
    held once for all of them; hits are (hash, at), from the stretch's first
    word.  The context is as long as the longest item, so no overlap is cut.
    """
    spark = docs.sparkSession
    lengths = sorted(r.n for r in tests.select(F.least(F.size("words"), F.lit(max(map(len, MASKS)))).alias("n")).distinct().collect())
    context = tests.agg(F.max(F.size("words"))).first()[0] or 0
    bitmap = spark.sparkContext.broadcast(_bitmap(tests))
    low = np.uint64((1 << BITMAP_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in A.slices(batches, "text"):
            w = A.folded_words(batch.column("text"))
            spots, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for number, mask in enumerate(MASKS):
                for n in [None, *(x for x in lengths if x < len(mask))]:
                    at, value = seeds(w, mask, number, n)
                    for shift in (0, BITMAP_BITS):
                        short = (value >> np.uint64(shift)) & low
                        pick = (bits[(short >> np.uint64(6)).astype(np.int64)] >> (short & np.uint64(63)) & np.uint64(1)).astype(bool)
                        at, value = at[pick], value[pick]
                    spots.append(at)
                    hashes.append(value)
            at, value = np.concatenate(spots), np.concatenate(hashes)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, value = at[order], value[order]
            row = w.row[at]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (np.diff(at) >= 2 * context)]))
            own = row[new]
            last = at[np.append(new[1:], len(at)) - 1]
            begin, end = np.maximum(w.first[own], at[new] - context), np.minimum(w.first[own + 1], last + context)
            first = np.concatenate([[0], np.cumsum(end - begin)])
            index = np.arange(first[-1]) + np.repeat(begin - first[:-1], end - begin)
            many = np.diff(np.append(new, len(at)))
            hit = pa.StructArray.from_arrays([A.as_signed(value), pa.array((at - np.repeat(begin, many)).astype(np.int32))], ["hash", "at"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(pa.array(own)),
                    pa.array((begin - w.first[own]).astype(np.int32)),
                    A.lists(A.as_signed(w.hash[index]), first),
                    A.lists(hit, np.append(new, len(at))),
                ],
                ["doc", "from", "words", "hits"],
            )

    src = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return src.mapInArrow(run, "doc long, from int, words array<long>, hits array<struct<hash:long,at:int>>")


def overlap(text: np.ndarray, item: np.ndarray, at: int, item_at: int) -> tuple[int, int, int]:
    """The longest stretch with enough equal words on the diagonal of a hit (then most equal, first): its first word in the text, length, equal words."""
    lead = min(at, item_at)
    tail = min(len(text) - at, len(item) - item_at)
    total = np.concatenate([[0], np.cumsum(text[at - lead : at + tail] == item[item_at - lead : item_at + tail])])
    spare = total - MIN_SAME * np.arange(len(total))  # a stretch has enough where this doesn't fall
    begin = np.searchsorted(-np.minimum.accumulate(spare), -spare)
    length = np.arange(len(total)) - begin
    same = total - total[begin]
    end = int(np.lexsort((-same, -length))[0])
    return at - lead + int(begin[end]), int(length[end]), int(same[end])


def counts(length: int, same: int, item_length: int) -> bool:
    return length > 0 and length >= min(MIN_OVERLAP, item_length) and same >= MIN_SAME * length


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_same): the best overlap of each document with each item it overlaps.

    Hits alone are joined with the test hashes; words come to the pairs of
    stretches and items that have a hit in common, with the diagonals they hit.
    """
    spark = docs.sparkSession
    tests = settle(spark, item_seeds(benchmark).withColumn("item_row", F.xxhash64("item", "words")), "seeds")
    regions = settle(spark, document_regions(docs, tests).withColumn("region", F.xxhash64("doc", "from", "words")), "regions")
    hits = regions.select("region", F.explode("hits").alias("h")).select("region", "h.hash", "h.at")
    pairs = hits.join(tests.select("hash", "item_row", F.col("at").alias("item_at")), "hash").groupBy("region", "item_row").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("diagonals"))
    items = tests.select("item_row", "item", F.col("words").alias("item_words")).dropDuplicates(["item_row"])
    texts = regions.select("region", "doc", "from", "words").dropDuplicates(["region"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, spans = [], []
            doc_words, item_words, starts = batch.column("words"), batch.column("item_words"), batch.column("diagonals").to_pylist()
            base = batch.column("from").to_numpy()
            for k in range(batch.num_rows):
                text, item = doc_words[k].values.to_numpy(), item_words[k].values.to_numpy()
                for d in starts[k]:
                    first, n, same = overlap(text, item, max(d, 0), max(-d, 0))
                    if counts(n, same, len(item)):
                        keep.append(k)
                        spans.append((int(base[k]) + first, n, same))
            a = np.array(spans, np.int32).reshape(-1, 3)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(take), batch.column("item").take(take), *(pa.array(a[:, c].copy()) for c in range(3))], ["doc_id", "item_id", "first_word", "n_words", "n_same"])

    both = pairs.join(items, "item_row").join(texts, "region").select("doc", "item", "from", "words", "item_words", "diagonals")
    found = both.mapInArrow(verify, "doc_id long, item_id long, first_word int, n_words int, n_same int")
    best = F.max(F.struct("n_same", "n_words", (-F.col("first_word")).alias("early"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.early")).alias("first_word"), F.col("best.n_words").alias("n_words"), F.col("best.n_same").alias("n_same"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that overlap an item; each row is judged by its own text."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    leaks = overlaps(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__pl_leak")).distinct()
    return docs.join(leaks, key == F.col("__pl_leak"), "left_anti")
