"""Best-fit packing with a swap-based local search.

The length of a document is its number of words between white space.  Of a
document longer than a bin, full-bin pieces are cut off first.  Documents are
spread over groups of about ``GROUP`` by hash; each group is packed best-fit
decreasing, then its underfull bins are improved: the least filled bin gives
one document, or exchanges one or two for one, so that a fuller bin comes as
near to full as any exchange allows.  Each exchange raises the sum of squared
fills, which is bounded, so the search ends; it stops for a bin that becomes
empty or has no such exchange left.

Defined results: a null or empty text has no words and takes no place.  Every
row is packed, also one that repeats a ``doc_id`` or has none.  Ties go to the
longer document, then to the lower ``doc_id`` (null first) and text hash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paperlane.llm import arrays as A
from paperlane.llm.stored import settle

CAPACITY = 2048
GROUP = 2048


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes; ``sizes`` come in falling order and each goes where least room is left."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for k, size in enumerate(sizes):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(k)
        if left > size:
            insort(room, (left - size, b))
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges between underfull bins while the sum of squared fills rises."""
    bins = [list(b) for b in bins]
    fill = np.array([int(sizes[b].sum()) for b in bins], np.int64)
    stuck, moved = np.zeros(len(bins), bool), False
    # the documents of underfull bins side by side; a slot of size 0 in each bin makes a move an exchange for nothing
    while True:
        open_bins = np.flatnonzero((fill > 0) & (fill < capacity))
        givers = open_bins[~stuck[open_bins]]
        if len(givers) == 0 and moved:  # room that came up since may have freed a bin that was stuck
            stuck[:], moved = False, False
            continue
        if len(givers) == 0 or len(open_bins) < 2:
            break
        low = givers[np.argmin(fill[givers])]
        others = open_bins[open_bins != low]
        owner = np.concatenate([np.repeat(others, [len(bins[b]) for b in others]), others])
        item = np.concatenate([*(bins[b] for b in others), np.full(len(others), -1)]).astype(np.int64)
        item_size = np.where(item >= 0, sizes[item], 0)
        room = capacity - fill[owner]
        while fill[low] > 0:
            mine = np.array(bins[low])
            x, y = np.triu_indices(len(mine), 1)
            give = np.concatenate([sizes[mine], sizes[mine[x]] + sizes[mine[y]]])
            gain = give[:, None] - item_size[None]
            ok = (gain > 0) & (gain <= room[None]) & (gain > fill[low] - fill[owner][None])
            ok[len(mine) :, item < 0] = False  # two documents are moved one by one
            if not ok.any():
                stuck[low] = True
                break
            left = np.where(ok, room[None] - gain, capacity + 1)
            at = np.unravel_index(np.lexsort((np.broadcast_to(np.arange(left.shape[1]), left.shape).ravel(), -gain.ravel(), left.ravel()))[0], left.shape) if left.size < 64 else np.unravel_index(left.argmin(), left.shape)
            g, k = int(at[0]), int(at[1])
            given = [int(mine[g])] if g < len(mine) else [int(mine[x[g - len(mine)]]), int(mine[y[g - len(mine)]])]
            to, taken, delta = int(owner[k]), int(item[k]), int(gain[g, k])
            bins[low] = [i for i in bins[low] if i not in given] + ([taken] if taken >= 0 else [])
            bins[to] = [i for i in bins[to] if i != taken] + given
            fill[low] -= delta
            fill[to] += delta
            stuck[to], moved = False, True
            keep = owner != to
            owner, item, item_size, room = owner[keep], item[keep], item_size[keep], room[keep]
            if fill[to] < capacity:
                inside = np.array([*bins[to], -1])
                owner, item = np.concatenate([owner, np.full(len(inside), to)]), np.concatenate([item, inside])
                item_size = np.concatenate([item_size, np.where(inside >= 0, sizes[inside], 0)])
                room = np.concatenate([room, np.full(len(inside), capacity - fill[to])])
            if not len(owner):
                break
    return [b for b in bins if b]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indexes into ``sizes``, which come in falling order and fit a bin each."""
    return improve(best_fit(sizes, capacity), np.array(sizes, np.int64), capacity)


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n): words of each document; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text", 4 << 20):
            raw, offsets = A.utf8(batch.column("text"))
            first = A.split(raw, offsets, ~A._SPACE)[3]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(np.diff(first).astype(np.int64))], ["doc_id", "mark", "n"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
    return src.filter("text is not null").mapInArrow(run, "doc_id long, mark long, n long").filter("n > 0")


def placed(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(bin_id, slot, doc_id, first_word, n_words): where each document, or each piece of a long one, is placed."""
    spark = docs.sparkSession
    sized = settle(spark, lengths(docs), "lengths")
    groups = max(1, -(-sized.count() // group))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("n", "descending"), ("doc_id", "ascending"), ("mark", "ascending")])
        g, n = table.column("grp")[0].as_py(), table.column("n").to_numpy()
        full, rest = n // capacity, n % capacity
        index = np.flatnonzero(rest)
        index = index[np.argsort(-rest[index], kind="stable")]
        bins = pack(rest[index].tolist(), capacity)
        pieces = np.repeat(np.arange(len(n)), full)
        nth = np.arange(len(pieces)) - np.repeat(np.cumsum(full) - full, full)
        row = np.concatenate([pieces, index[np.concatenate(bins).astype(np.int64)] if bins else np.zeros(0, np.int64)]).astype(np.int64)
        slot = np.concatenate([np.zeros(len(pieces), np.int64), *(np.arange(len(b)) for b in bins)]).astype(np.int32)
        number = np.concatenate([np.arange(len(pieces)), len(pieces) + np.repeat(np.arange(len(bins)), [len(b) for b in bins])]).astype(np.int64)
        alone = np.arange(len(row)) < len(pieces)
        first = np.where(alone, np.pad(nth, (0, len(row) - len(nth))) * capacity, full[row] * capacity)
        return pa.table(
            {
                "bin_id": pa.array(number * groups + g),
                "slot": pa.array(slot),
                "doc_id": table.column("doc_id").take(pa.array(row)),
                "first_word": pa.array(first.astype(np.int64)),
                "n_words": pa.array(np.where(alone, capacity, rest[row]).astype(np.int64)),
            }
        )

    keyed = sized.withColumn("grp", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(groups)))
    return keyed.groupBy("grp").applyInArrow(run, "bin_id long, slot int, doc_id long, first_word long, n_words long")
