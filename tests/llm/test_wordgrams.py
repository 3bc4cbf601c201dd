import math
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from paperlane.llm import arrays as A, queries, wordgrams as M

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


class Brute:
    """The definition, with dictionaries of tuples of words and recursion."""

    def __init__(self, texts):
        self.n, self.c = Counter(), Counter()
        for w in texts:
            for k in (1, 2, 3):
                self.n.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        for g, n in self.n.items():
            self.c[g[:-1]] += n

    def p(self, h, w):
        if not h:
            return max(self.n[(w,)], 1) / (self.c[()] + 1)
        return (self.n[(*h, w)] + M.PRIOR * self.p(h[1:], w)) / (self.c[h] + M.PRIOR)

    def score(self, w):
        return sum(math.log(self.p(tuple(w[max(0, i - 2) : i]), w[i])) for i in range(len(w)))


@pytest.mark.parametrize("held_out", [False, True])
def test_against_brute_force(spark, held_out):
    table = pq.read_table(f"{SF}/documents.parquet")
    words = dict(zip(table.column("doc_id").to_pylist(), A.fold_list(table.column("text").combine_chunks()), strict=True))
    brute = Brute(w for d, w in words.items() if not held_out or d % 3)
    assert sum(brute.p((), g[0]) for g in brute.n if len(g) == 1) + brute.p((), "unknown") == pytest.approx(1)
    h = next(g for g in brute.n if len(g) == 2 and brute.c[g] > 1)
    assert sum(brute.p(h, g[0]) for g in brute.n if len(g) == 1) + brute.p(h, "unknown") == pytest.approx(1)
    want = {d: brute.score(w) for d, w in words.items() if not held_out or d % 3 == 0}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for bucket in (M.BUCKET_BYTES, 30000):
        got = (M.scores(docs.filter("doc_id % 3 = 0"), bucket, docs.filter("doc_id % 3 <> 0")) if held_out else M.scores(docs, bucket)).collect()
        assert len(got) == len(want)
        assert all(r.logprob == pytest.approx(want[r.doc_id], abs=1e-6) for r in got)


def test_texts_are_shuffled_once(spark):
    scored = M.scores(spark.read.parquet(f"{SF}/documents.parquet"))
    scored.collect()
    assert "ReusedExchange" in scored._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_counts_beyond_a_byte(spark):
    docs = spark.createDataFrame([(i, "a b c d " * 90, "en", "s", 1) for i in range(9)], DOCS)
    brute = Brute([("a", "b", "c", "d") * 90] * 9)
    for bucket in (M.BUCKET_BYTES, 700):
        assert all(r.logprob == pytest.approx(brute.score(("a", "b", "c", "d") * 90), abs=1e-6) for r in M.scores(docs, bucket).collect())


def test_order_of_words_matters_and_the_query_uses_it(spark, tmp_path):
    line = "the old miller carried seven heavy sacks of grain across a narrow wooden bridge".split()
    rows = [(i, " ".join(line), "en", "s", 1) for i in range(20)] + [(99, " ".join(sorted(line)), "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.bits_per_byte for r in queries.op3_backoff_automaton(spark, str(tmp_path)).collect()}
    assert got[99] > 3 * got[0]


def test_grams_grow_with_the_corpus():
    text = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").combine_chunks()
    few, all_ = (len(M.grams(A.folded_words(t)).n3) for t in (text.slice(0, len(text) // 5), text))
    assert all_ > 3 * few


def test_edges_of_data(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (5, " ... ", "en", "a", 0), (3, "Orre " * 40000, "en", "a", 1), (None, "some text", None, None, None), (4, "some text", "en", "a", 1), (4, "some text", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for d in (docs, docs.selectExpr("*", "1 AS part", "2 AS n", "3 AS bucket", "4 AS k")):
        for bucket in (M.BUCKET_BYTES, 1000):
            got = [(r.doc_id, r.n_bytes, r.logprob, r.bits_per_byte) for r in M.scores(d, bucket).collect()]
            by = {g[0]: g for g in got}
            assert len(got) == 7 and by[1] == (1, None, None, None) and by[2] == (2, 0, 0.0, None) and by[5] == (5, 5, 0.0, None)
            assert by[None][2] == pytest.approx(by[4][2]) and by[4][2] < 0 and by[3][1] == 200000
    assert M.scores(docs.limit(0)).count() == M.scores(docs.filter("doc_id IN (1, 2, 5)")).filter("logprob < 0").count() == 0
    assert pa.types.is_float64(M.scores(docs).toArrow().schema.field("logprob").type)
