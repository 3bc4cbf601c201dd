import itertools
import random

import numpy as np
import pytest

from paperlane.llm import packing as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fills(bins, sizes):
    return [sum(sizes[i] for i in b) for b in bins]


def fewest(sizes, capacity):
    """The smallest number of bins, by trying every assignment."""
    for n in range(1, len(sizes) + 1):
        for where in itertools.product(range(n), repeat=len(sizes)):
            load = [0] * n
            for size, b in zip(sizes, where, strict=True):
                load[b] += size
            if max(load) <= capacity:
                return n
    return 0


@pytest.mark.parametrize("seed", range(25))
def test_against_every_assignment(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 10) for _ in range(rng.randint(1, 7))), reverse=True)
    bins = P.pack(sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert max(fills(bins, sizes)) <= 10
    assert fewest(sizes, 10) <= len(bins) <= len(P.best_fit(sizes, 10))


def test_search_raises_squared_fill_and_leaves_no_exchange():
    rng = random.Random(4)
    sizes = np.array(sorted((rng.randint(5, 700) for _ in range(300)), reverse=True))
    start = [[i] for i in range(len(sizes))]
    bins = P.improve(start, sizes, 1000)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    full = fills(bins, sizes)
    assert max(full) <= 1000 and len(bins) <= 1.02 * -(-sizes.sum() // 1000) + 1
    before = fills(P.best_fit(sizes.tolist(), 1000), sizes)
    after = fills(P.improve(P.best_fit(sizes.tolist(), 1000), sizes, 1000), sizes)
    assert sum(f * f for f in after) >= sum(f * f for f in before) and len(after) <= len(before)
    for a, b in itertools.permutations([k for k, f in enumerate(full) if f < 1000], 2):
        gives = [(i,) for i in bins[a]] + list(itertools.combinations(bins[a], 2))
        for give, take in itertools.product(gives, [None, *bins[b]]):
            if len(give) == 2 and take is None:
                continue
            gain = sum(sizes[list(give)]) - (sizes[take] if take is not None else 0)
            assert not (0 < gain <= 1000 - full[b] and gain > full[a] - full[b])


def test_placed_covers_every_word_once(spark):
    rows = [(i, "w " * (i * 37 % 900 + 1), "en", "s", 1) for i in range(500)]
    rows += [(None, "a b c", None, None, None), (1, "again", "en", "s", 1), (1, "again", "en", "s", 1), (600, None, "en", "s", 0), (601, "", "en", "s", 0), (602, " \n", "en", "s", 0), (603, "long " * 10300, "en", "s", 1), (604, "w " * 2048, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for d in (docs, docs.selectExpr("*", "1 AS grp", "2 AS n", "3 AS mark", "4 AS bin_id")):
        got = P.placed(d, group=100).toPandas()
        want = sum(len(r[1].split()) for r in rows if r[1])
        assert got.n_words.sum() == want
        assert got.groupby("bin_id").n_words.sum().max() <= P.CAPACITY
        assert not got.duplicated(["bin_id", "slot"]).any()
        long = got[got.doc_id == 603].sort_values("first_word")
        assert long.first_word.tolist() == [0, 2048, 4096, 6144, 8192, 10240] and long.n_words.sum() == 10300
        assert not set(got.doc_id.dropna()) & {600, 601, 602} and (got.doc_id == 1).sum() == 3
        assert got.bin_id.nunique() <= 1.03 * want / P.CAPACITY + 8
    assert P.placed(docs.limit(0)).count() == 0


def exchange_left(bins, sizes, capacity):
    """Whether giving one or two documents for one, or one for none, still raises the sum of squared fills."""
    fill = [int(sizes[b].sum()) for b in bins]
    for i, mine in enumerate(bins):
        if fill[i] == capacity:
            continue
        one = {int(sizes[x]) for x in mine}
        two = {int(sizes[x] + sizes[y]) for n, x in enumerate(mine) for y in mine[:n]}
        for j, other in enumerate(bins):
            if i != j and fill[j] < capacity:
                gains = {g - s for g in one for s in [0, *map(int, sizes[other])]} | {g - int(s) for g in two for s in sizes[other]}
                if any(0 < g <= capacity - fill[j] and g > fill[i] - fill[j] for g in gains):
                    return True
    return False


def test_no_exchange_is_left_for_any_seed():
    for seed in range(60):
        sizes = np.sort(np.random.RandomState(seed).randint(20, 200, 60))[::-1].copy()
        bins = P.pack(sizes.tolist(), 300)
        assert not exchange_left(bins, sizes, 300), seed
