import numpy as np
import pyarrow.parquet as pq
import pytest

from paperlane.llm import arrays as A, simhash as S
from paperlane.llm.graph import components

DATA = "/root/testdata/sf0.01/documents.parquet"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def exact_groups(code):
    forest = S.Forest(len(code))
    for a in range(0, len(code), 64):
        x, y = np.nonzero(np.bitwise_count(code[a : a + 64, None] ^ code[None]).sum(axis=2) <= S.RADIUS)
        forest.join(a + x, y)
    return forest


def test_code_is_the_weighted_vote_of_its_bigrams():
    column = pq.read_table(DATA, columns=["text"]).column("text").combine_chunks().slice(0, 30)
    w = A.folded_words(column)
    code, count = S.codes(w, len(column))
    for row in range(len(column)):
        h = w.hash[w.first[row] : w.first[row + 1]]
        feature = A.mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0xD6E8FEB86659FD93)) if len(h) > 1 else A.mix(h)
        assert count[row] == len(feature)
        for half, value in enumerate((feature, A.mix(feature ^ np.uint64(0x5851F42D4C957F2D)))):
            ones = ((value[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
            bits = 2 * ones > len(feature)
            assert int(code[row, half]) == sum(1 << i for i in range(64) if bits[i])


def apart(rng, base, least, most):
    """Copies of ``base`` with ``least`` to ``most`` bits changed."""
    out = base.copy()
    for row in out:
        for bit in rng.choice(128, rng.randint(least, most + 1), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return out


@pytest.mark.parametrize("n", [300, 3000, 7000, 20_000])
def test_graph_recall_of_isolated_pairs_and_groups(n):
    rng = np.random.RandomState(n)
    base = rng.randint(0, 2**63, (n, 2), dtype=np.int64).view(np.uint64)
    pairs, group = apart(rng, base[: n // 10], 20, 28), apart(rng, np.repeat(base[-1:], n // 10, axis=0), 1, 12)
    code = np.concatenate([base, pairs, group])
    edges = np.array(S.shard_edges(code, seed=n))
    assert (S.distance(code[edges[:, 0]], code[edges[:, 1]]) <= S.RADIUS).all()
    found = S.Forest(len(code))
    found.join(*edges.T)
    label = found.labels()
    assert np.mean(label[: n // 10] == label[n : n + len(pairs)]) >= 0.9
    assert np.mean(label[n + len(pairs) :] == label[n - 1]) == 1


def test_walk_meets_a_part_of_a_large_shard_only():
    rng = np.random.RandomState(1)
    code = rng.randint(0, 2**63, (12_000, 2), dtype=np.int64).view(np.uint64)
    met, keys = [0], S.SmallWorld._keys
    try:
        S.SmallWorld._keys = lambda self, hi, lo, nodes: met.__setitem__(0, met[0] + len(hi) * nodes.shape[1]) or keys(self, hi, lo, nodes)
        S.shard_edges(code)
    finally:
        S.SmallWorld._keys = keys
    assert met[0] < len(code) * 5000


@pytest.mark.parametrize("shard", [S.SHARD, 300, 60])
def test_near_duplicates_against_brute_force(spark, shard):
    table = pq.read_table(DATA)
    w = A.folded_words(table.column("text").combine_chunks())
    code, count = S.codes(w, len(table))
    ids = np.array(table.column("doc_id").to_pylist())[count > 0]
    forest = exact_groups(code[count > 0])
    want = {}
    for i in range(len(ids)):
        want.setdefault(forest.root(i), []).append(int(ids[i]))
    expected = {(x, min(g)) for g in want.values() for x in g if x != min(g)}
    rows = S.near_duplicates(spark.read.parquet(DATA), shard=shard).collect()
    got = {(r.doc_id, r.kept_doc_id) for r in rows}
    if shard > len(ids):
        assert got == expected
    assert len(got & expected) >= 0.95 * len(expected) and len(got - expected) <= 0.05 * len(expected)
    assert all(r.audited_recall >= S.RECALL for r in rows)


def test_hot_shards_are_split_and_no_node_is_lost(spark):
    rng = np.random.RandomState(2)
    hot = apart(rng, np.repeat(rng.randint(0, 2**63, (1, 2), dtype=np.int64).view(np.uint64), 900, axis=0), 1, 9)
    code = np.unique(np.concatenate([hot, rng.randint(0, 2**63, (1100, 2), dtype=np.int64).view(np.uint64)]), axis=0).view(np.int64)
    nodes = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(code)], "id long, hi long, lo long")
    got = S.sharded(nodes, range(3, 5), 4, 500).groupBy("shard").count().collect()
    assert sum(r["count"] for r in got) == 2 * len(code) and max(r["count"] for r in got) <= 500
    roots = components(S.edges(nodes, len(code), range(3, 6), 4, shard=125))
    groups = {r.id: r.root for r in roots.collect()}
    members = [i for i, c in enumerate(code.view(np.uint64)) if S.distance(c, hot[0]) <= 18]
    assert np.mean([groups.get(i) == groups[members[0]] for i in members]) > 0.98
    assert S.audit(nodes, roots) > 0.9 and S.audit(nodes, roots.limit(0)) == 0 and S.audit(nodes.limit(0), roots) == 1


def test_edges_of_data(spark):
    long = "alpha beta gamma delta " * 20000
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1),
        (2, "The quick brown fox, jumps over the lazy dog!", None, None, None),
        (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " ... ", "en", "a", 0),
        (None, "the quick brown fox jumps over the lazy dog", "en", "a", 1),
        (6, long, "en", "b", 1), (7, long + "omega", "en", "b", 1), (8, "single", "en", "b", 1), (9, "Single", "en", "b", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    for extra in (docs, docs.selectExpr("*", "1 AS id", "2 AS hi", "3 AS a", "4 AS root", "5 AS shard")):
        got = {(r.doc_id, r.kept_doc_id) for r in S.near_duplicates(extra).collect()}
        assert got == {(2, 1), (7, 6), (9, 8)}
        assert S.near_duplicates(extra, shard=2).columns == ["doc_id", "kept_doc_id", "audited_recall"]
        kept = S.keep_one(extra)
        assert kept.columns == extra.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "None", "6", "8"])
    assert S.keep_one(docs.limit(0)).count() == 0
    assert S.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("pairs,want", [([], {}), ([(1, 1), (None, 2)], {}), ([(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (50, 99)], {**{i: 0 for i in range(41)}, 50: 50, 99: 50, 100: 50})])
def test_components(spark, pairs, want):
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.id: r.root for r in got} == want and len(got) == len(want)


def test_rows_that_share_an_id_are_decided_by_their_own_texts(spark):
    rng = np.random.RandomState(1)
    a, b, c = (" ".join(f"w{x}" for x in rng.randint(0, 10**6, 300)) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (4, b + " end"), (6, a + " end"), (7, c), (7, "..."), (7, "..."), (None, "unlike"), (None, None)]
    kept = S.keep_one(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS))
    want = [(4, b + " end"), (5, a), (7, c), (7, "..."), (7, "..."), (None, "unlike"), (None, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))
