import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from paperlane.llm import arrays as A, decontaminate as D

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs, items):
    """All overlaps of at least the needed length on any diagonal, from every equal seed of whole-text comparison."""
    out = {}
    for item_id, item in items:
        item = np.array(item, np.uint64)
        if len(item) < D.MIN_ITEM:
            continue
        for doc_id, text in docs:
            text = np.array(text, np.uint64)
            for shift in range(-len(item) + 1, len(text)):
                lead = max(0, -shift)
                same = text[max(shift, 0) : shift + len(item)] == item[lead : lead + len(text) - max(shift, 0)]
                if same.sum() < D.MIN_ITEM - 2:
                    continue
                for mask in D.MASKS:
                    offs = D._offsets(mask, min(len(mask), len(item)))
                    span = min(len(mask), len(item))
                    for k in range(len(same) - span + 1):
                        if same[k + offs].all():
                            first, n, eq = D.overlap(text, item, max(shift, 0) + k, lead + k)
                            if D.counts(n, eq, len(item)):
                                out[doc_id, item_id] = max(out.get((doc_id, item_id), (0, 0, 0)), (eq, n, -first))
    return out


def test_against_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").slice(0, 200)
    bench = pq.read_table(f"{SF}/benchmark.parquet")
    fold = lambda t: A.fold_list(t.column("text").combine_chunks())
    short = [(d, w) for d, w in zip(docs.column("doc_id").to_pylist(), fold(docs), strict=True) if len(w) < 900]
    want = brute(short, list(zip(bench.column("item_id").to_pylist(), fold(bench), strict=True)))
    got = D.overlaps(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    ids = {d for d, _ in short}
    assert {(r.doc_id, r.item_id): (r.n_same, r.n_words, -r.first_word) for r in got if r.doc_id in ids} == want
    assert want


def test_substituted_passages_are_caught_and_clean_ones_are_not(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    items = [[word() for _ in range(rng.randint(14, 60))] for _ in range(40)]
    rows = []
    for i, item in enumerate(items):
        leak = list(item)
        for at in rng.sample(range(len(leak)), len(leak) // 12):
            leak[at] = word()
        rows.append((i, " ".join([word() for _ in range(50)] + leak + [word() for _ in range(50)]).upper() + ".", "en", "s", 1))
        rows.append((1000 + i, " ".join(word() for _ in range(150)), "en", "s", 1))
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.overlaps(docs, bench).collect()}
    assert got <= {(i, i) for i in range(40)} and len(got) >= 38
    kept = {r.doc_id for r in D.without_leaks(docs, bench).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in got}


def test_edges_of_data(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, "x y " + item + " z", "en", "a", 1), (1, item, "en", "a", 1), (None, item.upper(), None, None, None), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (4, "short item of only six words", "en", "a", 1), (5, "filler " * 50000 + item, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (10, "Short item of only six words!"), (11, "too short"), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi")], "item_id long, text string")
    for d in (docs, docs.selectExpr("*", "1 AS hash", "2 AS at", "3 AS words", "4 AS item_id", "5 AS doc", "6 AS item")):
        got = {(r.doc_id, r.item_id, r.n_words) for r in D.overlaps(d, bench).collect()}
        assert got == {(1, 7, 15), (None, 7, 15), (5, 7, 15), (4, 10, 6)}
        kept = D.without_leaks(d, bench)
        assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {2, 3}
    assert D.overlaps(docs.limit(0), bench).count() == D.overlaps(docs, bench.limit(0)).count() == 0
    assert D.without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_long_items_overlap_beyond_the_context():
    h = np.arange(400, dtype=np.uint64)
    assert D.overlap(h, h, 200, 200) == (0, 400, 400)
    assert A.folded_words(pa.array(["É é", None])).first.tolist() == [0, 2, 2]


def exact(text, item):
    """The best overlap of a pair by the documented limit: every stretch of every diagonal, without seeds or overlap()."""
    best = None
    for shift in range(-len(item) + 1, len(text)):
        span = range(max(shift, 0), min(shift + len(item), len(text)))
        same = np.concatenate([[0], np.cumsum([text[i] == item[i - shift] for i in span])]).astype(int)
        found = [(b - a, same[b] - same[a], -(span[0] + a)) for a in range(len(span)) for b in range(a + 1, len(span) + 1) if 4 * (same[b] - same[a]) >= 3 * (b - a)]
        if found and max(found)[0] >= min(13, len(item)):
            n, eq, early = max(found)
            best = max(best or (0, 0, 0), (eq, n, early))
    return best


def test_masks_miss_no_placing_of_other_words():
    for n in range(6, 26):
        other = np.array(list(itertools.combinations(range(n), n // 4)))
        word = np.full(len(other), (1 << n) - 1) - (1 << other).sum(axis=1)
        masks = [(int(m[::-1], 2), len(m)) for m in D.MASKS]
        assert np.logical_or.reduce([(word >> at) & m == m for m, span in masks for at in range(n - span + 1)]).all()


def test_any_placing_of_substitutions_against_all_diagonals(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    items, rows, want = [], [], {}
    for i in range(400):
        item = [word() for _ in range(rng.choice([6, 7, 8, 9, 11, 13, 13, 15, 18, 20, 40, 300]))]
        leak, part = list(item), rng.choice([len(item), max(13, len(item) // 2)])
        for at in rng.sample(range(len(leak)), rng.choice([len(leak) // 4, len(leak) // 5, len(leak) // 3])):
            leak[at] = word()
        text = [word() for _ in range(rng.randint(0, 9))] + leak[:part] + [word() for _ in range(rng.randint(0, 9))]
        items.append((i, " ".join(item)))
        rows.append((i, " ".join(text), "en", "s", 1))
        if i % 4 == 0 or len(item) < 100:
            want[i] = exact(text, item)
    got = {r.doc_id: (r.n_same, r.n_words, -r.first_word) for r in D.overlaps(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect() if r.doc_id == r.item_id}
    assert {i: got.get(i) for i in want} == want
    assert sum(x is not None for x in want.values()) > 150


def test_a_changed_word_at_the_end_and_changes_close_together():
    item = np.arange(15)
    for changed in ([0], [14], [1, 13], [11, 12, 13]):
        text = item.copy()
        text[changed] = 99
        assert D.overlap(text, item, 5, 5) == (0, 15, 15 - len(changed))


def test_rows_without_or_with_the_same_id_are_judged_one_by_one(spark):
    item = " ".join(f"word{i}" for i in range(20))
    rows = [(None, "see " + item), (None, "a clean text of its own"), (1, item), (1, "another clean text"), (None, None), (2, "clean")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = D.without_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {(r.doc_id, r.text) for r in kept.collect()} == set(rows) - {rows[0], rows[2]}
