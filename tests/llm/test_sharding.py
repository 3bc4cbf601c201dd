import copy

import duckdb
import pytest
from pyspark.sql import functions as F

from paperlane.llm import sharding as H

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_against_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{DOCS}'")
    want = sorted(db.sql(H.oracle("documents")).fetchall())
    got = sorted(tuple(r) for r in H.assign(spark.read.parquet(DOCS).select("doc_id")).collect())
    assert got == want and len(got) == 1000


def place(spark, tree, n=6000):
    return {r.doc_id: (r.region, r.rack, r.shard) for r in H.assign(spark.range(n).withColumnRenamed("id", "doc_id"), tree=tree).collect()}


def test_shares_follow_weights(spark):
    at = place(spark, H.TREE)
    total = H.weight(H.TREE)
    for region, racks in H.TREE.items():
        assert sum(p[0] == region for p in at.values()) / 6000 == pytest.approx(H.weight(racks) / total, abs=0.03)


def test_movement_stays_in_the_changed_subtrees(spark):
    before = place(spark, H.TREE)
    more = copy.deepcopy(H.TREE)
    more["north"]["rack1"]["shard2"] += 4
    after = place(spark, more)
    moved = {k for k in before if before[k] != after[k]}
    assert moved
    for k in moved:
        was, now = before[k], after[k]
        level = next(i for i in range(3) if was[i] != now[i])
        assert now[: level + 1] == ("north", "rack1", "shard2")[: level + 1]
    less = copy.deepcopy(H.TREE)
    less["east"]["rack0"]["shard5"] = 0
    for k, now in place(spark, less).items():
        level = next((i for i in range(3) if before[k][i] != now[i]), None)
        assert level is None or before[k][: level + 1] == ("east", "rack0", "shard5")[: level + 1]


def test_edges_of_data(spark):
    rows = spark.createDataFrame([(None, "x"), (1, None), (1, "y")], "doc_id long, shard string")
    got = H.assign(rows).collect()
    assert len(got) == 3 and rows.columns[:2] == ["doc_id", "shard"] and len({r.shard for r in got if r.doc_id == 1}) == 1
    assert all(r.region and r.rack and r.shard for r in got)
    assert H.assign(rows.limit(0)).count() == 0


@pytest.mark.parametrize("key", ["region", "rack", "shard"])
def test_a_key_named_like_a_level(spark, key):
    rows = spark.range(500).select("id", F.col("id").cast("string").alias(key))
    want = {str(k): p for k, p in place(spark, H.TREE, 500).items()}
    got = {str(r.id): (r.region, r.rack, r.shard) for r in H.assign(rows, key).collect()}
    assert got == want


def test_ties_go_to_the_first_name(spark, monkeypatch):
    monkeypatch.setattr(H, "_draw", lambda key, path, w: F.lit(0.5))
    assert set(place(spark, H.TREE, 20).values()) == {("east", "rack0", "shard0")}
