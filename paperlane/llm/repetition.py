"""Repetition rules from a suffix array of each document.

The words of all documents of a slice become one array of numbers in which
each document ends with a number of its own, so no common prefix crosses a
border.  Prefix doubling sorts the suffixes, Kasai's relation in array form
gives the longest common prefixes, and each interval of them is a maximal
repeated run of words.  The spans of repeats of at least ``MIN_WORDS`` words
are united; a document is rejected when they cover more than ``MAX_FRACTION``
of its characters in words, or when its longest repeat has more than
``MAX_REPEAT`` words.

Every occurrence counts as covered, the first too.  Occurrences may overlap,
as in a run of one word.

Defined results: null texts, texts without a word, and texts in which nothing
repeats have fraction 0 and longest repeat 0, and stay.  Words are compared as
folded (lower case, letters and digits).  Each row is judged by itself, so
rows that repeat a ``doc_id`` or have none stay or go alike.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from paperlane.llm import arrays as A

MIN_WORDS = 5
MAX_FRACTION = 0.50
MAX_REPEAT = 100


def suffix_array(symbol: np.ndarray) -> np.ndarray:
    """Start positions in the order of their suffixes; only groups that still tie are sorted again."""
    n = len(symbol)
    order = np.argsort(symbol, kind="stable")
    head = np.ones(n, bool)
    head[1:] = symbol[order][1:] != symbol[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    width = 1
    while True:
        place = np.flatnonzero(~(head & np.append(head[1:], True)))  # slots of groups of two or more
        if not len(place):
            return order
        at = order[place]
        after = np.where(at + width < n, rank[np.minimum(at + width, n - 1)], -1)
        group = rank[at]
        by = np.lexsort((after, group))
        at, after, group = at[by], after[by], group[by]
        order[place] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        head[place] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, place, 0))
        width *= 2


def common_prefixes(symbol: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each slot of the array, the words its suffix shares with the slot before; by doubling over hashes of runs."""
    n = len(symbol)
    left, right = np.concatenate([[0], order[:-1]]), order.copy()
    same = np.zeros(n, np.int64)
    if n < 2:
        return same
    powers = [A.mix(symbol.astype(np.uint64))]
    live = np.flatnonzero(symbol[left] == symbol[right])
    live = live[live > 0]
    k = 0
    while len(live) and (1 << k) <= n:  # runs of 2**k from each start, as long as some pair shares one
        w = 1 << k
        h = powers[k]
        ok = np.maximum(left[live], right[live]) + w <= n
        hit = np.zeros(len(live), bool)
        hit[ok] = h[left[live[ok]]] == h[right[live[ok]]]
        live = live[hit]
        if len(live):
            powers.append(A.mix(h[: n - 2 * w + 1] * np.uint64(0x9FB21C651E98DF25) + h[w : n - w + 1]) if n >= 2 * w else np.zeros(0, np.uint64))
        k += 1
    pair = np.arange(1, n)
    for k in range(len(powers) - 1, -1, -1):
        w = 1 << k
        h = powers[k]
        a, b = left[pair] + same[pair], right[pair] + same[pair]
        fits = np.maximum(a, b) < len(h)
        hit = np.zeros(len(pair), bool)
        hit[fits] = h[a[fits]] == h[b[fits]]
        same[pair[hit]] += w
    return same


def repeats(words: A.Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word position, the length of the longest repeated run that starts there; and the row of each position."""
    n = len(words.hash)
    rows = len(words.first) - 1
    number = np.unique(words.hash, return_inverse=True)[1]
    full = np.diff(words.first) > 0
    at = np.arange(n) + np.cumsum(full)[words.row] - 1  # one border symbol after each document with words
    symbol = np.empty(n + int(full.sum()), np.int64)
    symbol[at] = number + rows
    ends = words.first[1:][full] + np.arange(int(full.sum()))
    symbol[ends] = np.flatnonzero(full)
    order = suffix_array(symbol)
    shared = common_prefixes(symbol, order)
    # a suffix repeats as far as the longer of the prefixes it shares with its two neighbours
    longest = np.maximum(shared, np.append(shared[1:], 0))
    out = np.zeros(len(symbol), np.int64)
    out[order] = longest
    return out[at], words.row


def measure(texts: pa.Array, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the covered fraction of the characters of its words, and the longest repeat in words."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()))
    raw, offsets = A.utf8(lower)
    start, end, row, first = A.split(raw, offsets, A._WORD)
    rows = len(offsets) - 1
    fraction, longest = np.zeros(rows), np.zeros(rows, np.int64)
    if not len(start):
        return fraction, longest
    words = A.Words(start, end, row, A.span_hash(raw, start, end), first)
    # documents are told apart: the same word in two rows must not tie
    words.hash = A.mix(words.hash + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    length, _ = repeats(words)
    long = np.flatnonzero(length >= least)
    edge = np.zeros(len(start) + 1, np.int64)
    np.add.at(edge, long, 1)
    np.add.at(edge, long + length[long], -1)
    covered = np.cumsum(edge[:-1]) > 0
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    size = lead[end] - lead[start]
    total = np.bincount(row, size, rows)
    fraction = np.bincount(row[covered], size[covered], rows) / np.maximum(total, 1)
    np.maximum.at(longest, row[long], length[long])
    return fraction, longest


def measures(text: Column, least: int = MIN_WORDS) -> Column:
    """Struct (fraction, longest) of a text column; Arrow batches of the text alone go to Python."""

    @F.arrow_udf("fraction double, longest long")
    def run(texts: pa.Array) -> pa.Array:
        parts = [measure(b.column(0), least) for b in A.slices([pa.RecordBatch.from_arrays([pc.cast(texts, pa.large_string())], ["text"])], "text", 1 << 20)]
        fraction = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0)
        longest = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(fraction), pa.array(longest)], ["fraction", "longest"])

    return run(text.cast("string"))


def accepted(docs: DataFrame, max_fraction: float = MAX_FRACTION, max_repeat: int = MAX_REPEAT, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` within both limits, with ``__pl_rep`` (fraction, longest)."""
    found = docs.withColumn("__pl_rep", measures(F.col("text"), least))
    return found.filter((F.col("__pl_rep.fraction") <= max_fraction) & (F.col("__pl_rep.longest") <= max_repeat))
