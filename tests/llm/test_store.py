import random

import numpy as np
from pyspark.sql import functions as F

from paperlane.llm import store as S

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_chunks(ids):
    """Id by id."""
    ends, begin, last_hit = [], 0, None
    for i in range(len(ids)):
        g = sum(int(S._GEAR[ids[i - k]]) << k for k in range(min(S.MASK_BITS, i + 1))) % 2**64
        hit = g % 2**S.MASK_BITS == 0
        cut = hit and (last_hit is None or i - last_hit > S.MIN_IDS)
        if hit:
            last_hit = i
        if cut or i + 1 - begin == S.MAX_IDS or i + 1 == len(ids):
            ends.append(i + 1)
            begin = i + 1
    return ends


def test_chunks_against_the_definition():
    rng = np.random.RandomState(0)
    rows = [rng.randint(0, 50000, n) for n in (0, 1, 40, 3000)] + [np.full(2500, k) for k in range(3)] + [np.tile(rng.randint(0, 50000, 7), 500)]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    ends = S.chunk_ends(np.concatenate(rows), first)
    want = [int(f) + e for r, f in zip(rows, first, strict=False) for e in brute_chunks(r.tolist())]
    assert ends.tolist() == want


def test_an_insertion_changes_few_chunks():
    ids = np.random.RandomState(1).randint(0, 50000, 20000)
    with_one = np.insert(ids, 777, [5, 6, 7])
    cut = lambda x: {tuple(c) for c in np.split(x, S.chunk_ends(x, np.array([0, len(x)])))}
    assert len(cut(ids) - cut(with_one)) <= 3


def test_merkle_root_depends_on_every_part_and_their_order():
    parts = [bytes([k]) * S.WIDTH for k in range(7)]
    roots = {S.merkle_root(parts[:n], None) for n in range(8)} | {S.merkle_root(parts, 3), S.merkle_root(parts[::-1], None)}
    assert len(roots) == 10


def test_round_trip_of_the_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    objects = S.settle(spark, S.build(docs), "test")
    chunks = objects.filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("address").distinct().count()
    back = S.rebuild(objects)
    assert back.filter("intact").count() == docs.count()
    assert back.join(docs.withColumnRenamed("text", "was"), "doc_id").filter("text = was").count() == docs.count()
    assert S.check_manifests(objects).filter("intact").count() == objects.filter("kind IN ('manifest', 'root')").count() == 2
    encode = S.encoding(S.VOCABULARY).encode_ordinary
    distinct = set()
    for r in docs.collect():
        ids = encode(r.text)
        distinct |= {tuple(c) for c in np.split(np.array(ids), brute_chunks(ids)) if len(c)}
    got = {tuple(np.frombuffer(r.ids, "<u2").tolist()) for r in chunks.collect()}
    assert got == {tuple(map(int, c)) for c in distinct}


def test_changes_are_seen(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(str(rng.random()) for _ in range(40)), "en", "s", 1) for i in range(6)], DOCS)
    objects = S.settle(spark, S.build(docs), "test")
    victim = objects.filter("kind = 'chunk'").orderBy("address").first().address
    is_victim = (F.col("kind") == "chunk") & (F.col("address") == F.lit(bytes(victim)))
    changed = objects.withColumn("ids", F.when(is_victim, F.expr("concat(ids, X'0000')")).otherwise(F.col("ids")))
    for broken in (changed, objects.filter(~is_victim)):
        assert sum(not r.intact for r in S.rebuild(broken).collect()) == 1
    fewer = objects.filter("kind <> 'recipe' OR doc_id <> 3")
    assert S.check_manifests(fewer).filter("not intact").count() == 2


def test_edges_of_data(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "é😀 \n\n <|endoftext|>", "en", "a", 1), (None, "same text", None, None, None), (4, "same text", "en", "a", 1), (4, "same text", "en", "a", 1), (5, "Orre " * 40000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for d in (docs, docs.selectExpr("*", "1 AS kind", "2 AS address", "3 AS parts", "4 AS ids", "5 AS grp")):
        objects = S.settle(spark, S.build(d), "test")
        got = S.rebuild(objects).collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(r[0]), str(r[1])) for r in rows)
        assert all(r.intact for r in got)
        recipes = {(r.doc_id): r for r in objects.filter("kind = 'recipe'").collect()}
        assert recipes[1].n_ids is None and recipes[2].n_ids == 0 and recipes[None].address == recipes[4].address
    empty = S.build(docs.limit(0)).collect()
    assert [(r.kind, r.parts) for r in empty] == [("root", [])]
    assert S.rebuild(S.build(docs.limit(0))).count() == 0


def test_manifests_are_a_tree_of_fixed_fan(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 4)
    recipe = S._objects(S.VOCABULARY, spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")).filter("kind = 'recipe'")
    made = S.manifests(recipe, fan=3).collect()
    by = {bytes(r.address): r for r in made}
    root = [r for r in made if r.kind == "root"]
    assert len(root) == 1 and len(root[0].parts) <= 3

    def leaves(r):
        assert bytes(r.address) == S.merkle_root([bytes(p) for p in r.parts], len(r.parts))
        return sum(([bytes(p)] if bytes(p) not in by else leaves(by[bytes(p)]) for p in r.parts), [])

    assert sorted(leaves(root[0])) == sorted(bytes(r.address) for r in recipe.collect())
