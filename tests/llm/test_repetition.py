import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paperlane.llm import repetition as R

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text, least=R.MIN_WORDS):
    """Every pair of positions, extended word by word."""
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    covered, longest = set(), 0
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            n = 0
            while j + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            if n >= least:
                longest = max(longest, n)
                covered.update(range(i, i + n), range(j, j + n))
    return sum(len(words[k]) for k in covered) / max(1, sum(map(len, words))), longest


def test_suffix_array_and_prefixes():
    rng = np.random.RandomState(0)
    for n in (1, 2, 7, 60, 300):
        for kinds in (1, 2, 5, 50):
            s = rng.randint(0, kinds, n)
            order = R.suffix_array(s)
            assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
            for k, got in enumerate(R.common_prefixes(s, order)[1:], 1):
                a, b = s[order[k - 1] :], s[order[k] :]
                m = min(len(a), len(b))
                diff = np.flatnonzero(a[:m] != b[:m])
                assert got == (diff[0] if len(diff) else m)


@pytest.mark.parametrize("seed", range(12))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    texts = [None, "", "one", "a b c d e a b c d e"]
    texts += [" ".join(rng.choice(["é", "bb", "c", "dd.", "E"][: rng.randint(1, 5)]) for _ in range(rng.randint(0, 90))) for _ in range(25)]
    fraction, longest = R.measure(pa.array(texts))
    for k, t in enumerate(texts):
        want = brute(t)
        assert fraction[k] == pytest.approx(want[0]) and longest[k] == want[1]


def test_real_texts_against_brute_force(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = [r for r in pq.read_table(path).to_pylist() if len(r["text"]) < 2500][:90]
    want = {r["doc_id"]: brute(r["text"]) for r in rows}
    got = spark.read.parquet(path).select("doc_id", R.measures(F.col("text")).alias("m")).collect()
    for r in got:
        if r.doc_id in want:
            assert (r.m.fraction, r.m.longest) == (pytest.approx(want[r.doc_id][0]), want[r.doc_id][1])
    kept = {r.doc_id for r in R.accepted(spark.read.parquet(path)).collect()}
    assert {d for d, (f, n) in want.items() if f <= R.MAX_FRACTION and n <= R.MAX_REPEAT} == kept & set(want)


def test_edges_of_data(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "Orre " * 40000, "en", "a", 1), (None, "a plain line of text", "en", "a", 1), (4, "x y z w v u " * 3, None, None, None), (4, "x y z w v u " * 3, None, None, None), (5, " ".join(f"w{i}" for i in range(60000)), "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for d in (docs, docs.selectExpr("*", "1 AS fraction", "2 AS longest", "3 AS rep")):
        kept = R.accepted(d).drop("__pl_rep")
        assert kept.columns == d.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "None"]
    assert R.accepted(docs.limit(0)).count() == 0
