import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperlane.llm import quality as Q

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_densities_are_those_of_the_normal_law():
    rng = np.random.RandomState(1)
    x = [rng.normal(k, 1 + k, (200, 4)) for k in range(3)]
    count = np.array([len(a) for a in x], float)
    classes, mean, whiten, constant = Q.quadratic(count, np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]))
    model = Q.Model(np.zeros(0, np.uint64), classes, mean, whiten, constant)
    point = rng.normal(0, 3, (5, 4))
    for k in range(3):
        cov = np.linalg.inv(whiten[k].T @ whiten[k])
        gap = point - mean[k]
        want = np.log(count[k] / 600) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap)
        assert np.allclose(model.densities(point)[:, k], want)


def test_statistics_do_not_depend_on_the_batch():
    texts = ["Some plain text, twice.\nSome plain text, twice.", None, "", "A!! B!! 33 ###", "é " * 50, "x" * 5000]
    lexicon = np.zeros(0, np.uint64)
    whole, has = Q.statistics(pa.array(texts), lexicon)
    for k, t in enumerate(texts):
        one, own = Q.statistics(pa.array([t], pa.string()), lexicon)
        assert np.allclose(one[0], whole[k]) and own[0] == has[k]
    assert has.tolist() == [True, False, False, True, True, True]
    at = dict(zip(Q.FEATURES, whole[0], strict=True))
    assert at["log_words"] == pytest.approx(np.log1p(8)) and at["distinct_lines"] == 0.5


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.fit(docs, labels.filter("pmod(xxhash64(doc_id), 2) = 0"))
    rows = docs.join(labels.filter("pmod(xxhash64(doc_id), 2) = 1"), "doc_id").select("quality", "toxic", Q.score(model, F.col("text")).alias("s")).toPandas()
    clean = (rows.quality == 1) & (rows.toxic == 0)
    kept = rows.s >= 0
    assert kept[clean].mean() > 0.96
    assert kept[rows.quality == 0].mean() < 0.03 and kept[rows.toxic == 1].mean() < 0.06


def test_edges_of_data(spark):
    plain = "this is plain prose about number {} and its many uses in the world, said calmly."
    rows = [(i, plain.format(f"item{i}") * (1 + i % 5), "en", "s", 1) for i in range(60)]
    rows += [(100 + i, "$$$ ### " * (5 + i), "en", "s", 1) for i in range(20)]
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, " \n ", "en", "s", 0), (None, plain, "en", "s", 1), (0, plain.format("item0"), "en", "s", 1), (203, plain * 20000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(15)] + [(None, 1, 1), (3, None, 0), (4, 1, None), (0, 1, 0), (9999, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for d in (docs, docs.selectExpr("*", "1 AS class", "2 AS toxic", "3 AS score", "4 AS q")):
        kept = Q.accepted(d, labels).drop("__pl_score")
        assert kept.columns == d.columns
        ids = [r.doc_id for r in kept.collect()]
        assert not set(ids) & {*range(100, 120), 200, 201, 202} and len(set(range(60)) & set(ids)) >= 58 and ids.count(0) == 2
    none = Q.accepted(docs, labels.limit(0))
    assert none.count() == len(rows) - 3
    assert Q.accepted(docs, labels.filter("quality = 1")).count() == len(rows) - 3
    assert Q.accepted(docs.limit(0), labels).count() == 0
