"""The pipeline's stages against brute force, each on its own input."""

import re
import shutil

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from paperlane.llm import arrays as A, quality as Q, simhash as S
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_simhash import exact_groups
from tests.llm.test_substring import brute as brute_cuts

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_after_the_other(spark):
    assert [name for name, _ in P.STAGES] == ["quality_classifier", "near_dedup", "substring_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs.toPandas()
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == COLUMNS and out.schema == docs.schema
        pandas = out.toPandas()
        kept[name] = pandas
        if name == "quality_classifier":
            model = Q.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            x, has = Q.statistics(pa.array(at.text), model.lexicon)
            d = model.densities(x)
            best = np.array(model.classes)[d.argmax(axis=1)]
            assert set(pandas.doc_id) == set(at.doc_id[has & (best == Q.CLEAN)])
        if name == "near_dedup":
            w = A.folded_words(pa.array(at.text))
            code, _ = S.codes(w, len(at))
            forest = exact_groups(code)
            groups = {}
            for i, doc_id in enumerate(at.doc_id):
                groups.setdefault(forest.root(i), []).append(doc_id)
            gone, want = set(at.doc_id) - set(pandas.doc_id), set(at.doc_id) - {min(g) for g in groups.values()}
            assert gone == want and want
        if name == "substring_dedup":
            want = brute_cuts(list(zip(at.doc_id, at.text, strict=True)))
            assert {i: re.findall(r"[^\t-\r\x1c-\x20]+", t) for i, t in zip(pandas.doc_id, pandas.text, strict=True)} == {i: w for i, w in want.items() if w}
            assert (pandas.n_chars == pandas.text.str.len()).all()
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
            fold = lambda t: A.fold_list(pa.array(t))
            leaks = brute_leaks(list(zip(at.doc_id, fold(at.text), strict=True)), list(zip(bench.item_id, fold(bench.text), strict=True)))
            assert set(pandas.doc_id) == set(at.doc_id) - {d for d, _ in leaks}
        if name == "packing":
            words = at.text.str.split(r"[\t-\r\x1c-\x20]+", regex=True).map(lambda x: sum(map(bool, x)))
            assert pandas.groupby("doc_id").n_words.sum().to_dict() == dict(zip(at.doc_id, words, strict=True))
            assert pandas.groupby("bin_id").n_words.sum().max() <= 2048
        docs = spark.createDataFrame(pandas, docs.schema) if name != "packing" else None
        at = pandas
    ran = P.run(spark, SF).toPandas()
    order = ["bin_id", "slot"]
    assert ran.sort_values(order).values.tolist() == kept["packing"].sort_values(order).values.tolist()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 30000, "en", "s", 1)]])
def test_edges_of_data(spark, tmp_path, rows):
    for table in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{table}.parquet", tmp_path / f"{table}.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == ({2} if rows else set())
