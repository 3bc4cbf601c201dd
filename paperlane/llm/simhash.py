"""SimHash near-duplicate groups through navigable small-world graphs.

Every document gets a 128-bit SimHash over its word bigrams, weighted by their
number.  Two documents are near duplicates when their codes differ in at most
``radius`` bits; groups are the connected components of that relation.

Search is sharded: each table orders the bits of the code in its own way and
takes the first of them as shard number, so many that a shard has ``SHARD``
codes at most on average; a shard that stays too large is split by further
bits, so no task holds a hot one.  Tables are as many as it takes for ``CAUGHT``
of the pairs at the radius to share a shard.  (Sending every query to every
shard would be quadratic, as all documents are queries.)  In a shard of any
size a navigable small-world graph holds the nodes: waves of queries walk it
with beams that expand, link to what they met, and are inserted.  Only edges
whose distance was computed and holds are emitted, as a spanning forest of
each shard; the union runs in Spark.

Recall is audited in each run: ``AUDIT`` codes are sent to all tasks and
compared with every node.  While less than ``RECALL`` of what is near them is
in their groups, as many tables again follow, up to ``ROUNDS`` times; the
recall reached is in the result.

Defined results: null texts, texts without a word and rows with a null
``doc_id`` are in no group.  A text of one word uses that word as its only
feature.  In the pairs, rows that repeat a ``doc_id`` count as one document
that has all of their texts; ``keep_one`` decides on each row.  Equal codes
collapse before the search, so thousands of exact copies cost one node.  Ties
go to the smallest ``doc_id``, which each group keeps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from paperlane.llm import arrays as A
from paperlane.llm.graph import components
from paperlane.llm.stored import settle

RADIUS = 28
SHARD = 16_384  # codes that a shard has at most on average; one of twice that is split further
CAUGHT = 0.93  # of pairs at the radius that share a shard in some table
RECALL = 0.95  # of audited pairs; below it more tables follow
ROUNDS = 3
AUDIT = 256  # queries that are held against exact search
DEGREE = 12
LINKS = 36
BEAM = 16
POOL = 64
GROWS = 8_192  # beam and pool are as many times these as the graph has times so many nodes
STEPS = 4
ENTRIES = 512
WAVE = 256
FAR = 255
BITS = 23  # of a pool number, for the node and whether it is open
NODE = (1 << (BITS - 1)) - 1

_LANES = np.zeros(256, np.uint64)
for _b in range(256):
    _LANES[_b] = sum(1 << (8 * i) for i in range(8) if _b >> i & 1)


def codes(words: A.Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit codes as (rows, 2) uint64, and the number of features of each row."""
    h, row, first = words.hash, words.row, words.first
    last = np.zeros(len(h), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    many = np.diff(first)
    pair = A.mix(h * np.uint64(3) + np.roll(h, -1) * np.uint64(0xD6E8FEB86659FD93))
    single = many[row] == 1
    use = ~last | single
    feature = np.where(single, A.mix(h), pair)[use]
    owner = row[use]
    count = np.maximum(many - 1, (many == 1).astype(many.dtype))
    out = np.zeros((rows, 2), np.uint64)
    if not len(feature):
        return out, count
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    local = np.arange(len(feature)) - begin[owner]
    seg = np.flatnonzero(local % 255 == 0)
    doc_of_seg = owner[seg]
    new_doc = np.flatnonzero(np.concatenate([[True], doc_of_seg[1:] != doc_of_seg[:-1]]))
    have = doc_of_seg[new_doc]
    halves = []
    for half in range(2):
        value = feature if half == 0 else A.mix(feature ^ np.uint64(0x5851F42D4C957F2D))
        octets = value.view(np.uint8).reshape(-1, 8)
        ones = np.empty((len(have), 64), np.int64)
        for k in range(8):
            part = np.add.reduceat(_LANES[octets[:, k]], seg)
            ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), new_doc, axis=0)
        bits = (2 * ones > count[have][:, None]).astype(np.uint8)
        halves.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel())
    out[have, 0], out[have, 1] = halves
    return out, count


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo) of every document that has a word; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.slices(batches, "text"):
            w = A.folded_words(b.column("text"))
            code, count = codes(w, b.num_rows)
            t = pa.RecordBatch.from_arrays([b.column("doc_id"), A.as_signed(code[:, 0].copy()), A.as_signed(code[:, 1].copy())], ["doc_id", "hi", "lo"])
            yield t.filter(pa.array(count > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, hi long, lo long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[..., 0] ^ b[..., 0]) + np.bitwise_count(a[..., 1] ^ b[..., 1])


class Forest:
    """Union by smaller root with path halving over node numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def labels(self) -> np.ndarray:
        up = np.array(self.up, np.int64)
        while not np.array_equal(up, above := up[up]):
            up = above
        return up

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        if len(left) > 512:  # of dense groups nearly all pairs are joined already
            label = self.labels()
            apart = label[left] != label[right]
            left, right = left[apart], right[apart]
        for x, y in zip(left.tolist(), right.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                if p > q:
                    p, q = q, p
                self.up[q] = p
                self.edges.append((x, y))


class SmallWorld:
    """A graph over codes in which every inserted node links to near nodes that its search met, and these back.

    Many queries walk in lock-step.  Each holds a pool of the nearest nodes it
    met as sorted numbers: distance, node, and whether the node is still to be
    expanded.  Its beam is the front of the pool; when all of that is expanded
    the beam doubles, as long as the last doubling brought a nearer node or
    more nodes within the radius, and beyond the pool's end while all of the
    pool lies within the radius.
    """

    def __init__(self, room: int, radius: int = RADIUS) -> None:
        self.hi, self.lo = np.zeros(room + 1, np.uint64), np.zeros(room + 1, np.uint64)
        self.none = np.int32(room)  # stands for no node
        self.links = np.full((room + 1, LINKS), room, np.int32)
        self.fill = np.zeros(room, np.int64)
        self.radius, self.size = radius, 0

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``width`` near nodes by distance: ids (``none`` where there is none) and distances."""
        many, empty = len(queries), np.int32(FAR << BITS)
        hi, lo = queries[:, :1], queries[:, 1:]
        entry = np.unique(np.random.RandomState(self.size).randint(0, self.size, ENTRIES)) if self.size > ENTRIES else np.arange(self.size)
        entry = entry.astype(np.int32)
        pool = np.full((many, max(width, len(entry)) + 1), empty, np.int32)
        pool[:, : len(entry)] = self._keys(hi, lo, entry[None])
        pool = np.sort(pool, axis=1)[:, : width + 1].copy()
        pool[:, width] = empty  # beyond the pool, so that a pick of nothing has a place
        beam, reached = np.full(many, BEAM * (1 + self.size // GROWS)), np.full(many, -1)
        spots, active = np.arange(width), np.arange(many)
        while len(active):
            p = pool[active]
            front = np.where((p[:, :width] & 1 == 1) & (spots < beam[active, None]), spots, width)
            front = np.partition(front, STEPS - 1, axis=1)[:, :STEPS]
            has = front < width
            going = has.any(axis=1)
            if not going.all():
                still = active[~going]
                worth = ((p[~going] >> BITS) <= self.radius).sum(axis=1) * 1000 + FAR - (p[~going, 0] >> BITS)
                more = (worth > reached[still]) & (beam[still] < width)
                reached[still] = worth
                beam[still[more]] *= 2
                going[~going] = more
                active = active[going]
                continue
            here = np.take_along_axis(p, front, 1)
            np.put_along_axis(p, front, here & ~np.int32(1), 1)
            node = np.where(has, here >> 1 & NODE, self.none)
            met = self.links[node].reshape(len(active), -1)
            found = np.concatenate([p, self._keys(hi[active], lo[active], met)], 1)
            found.sort(axis=1)
            # a node met again follows itself, expanded first
            found[:, 1:][found[:, 1:] >> 1 == found[:, :-1] >> 1] = empty
            found.sort(axis=1)
            pool[active, :width] = found[:, :width]
        ids, dist = pool[:, :width] >> 1 & NODE, pool[:, :width] >> BITS
        return np.where(dist < FAR, ids, self.none), dist

    def _keys(self, hi: np.ndarray, lo: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        d = np.bitwise_count(self.hi[nodes] ^ hi) + np.bitwise_count(self.lo[nodes] ^ lo)  # at most 128
        return np.where(nodes == self.none, np.int32(FAR << BITS), d.astype(np.int32) << BITS | nodes << 1 | np.int32(1))

    def within(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (query numbers, ids, distances) of searches whose pool reaches beyond the radius; others go again with twice the pool."""
        rest, width = np.arange(len(queries)), POOL * (1 + self.size // GROWS)
        while len(rest):
            ids, dist = self.search(queries[rest], width)
            over = (dist[:, -1] > self.radius) | (width >= self.size)
            yield rest[over], ids[over], dist[over]
            rest, width = rest[~over], 2 * width

    def insert(self, codes: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        """Add nodes, each linked to the nearest ``DEGREE`` of ``ids`` and of the nodes added with it, and these back."""
        new = self.size + np.arange(len(codes))
        self.hi[new], self.lo[new] = codes.T
        own = distance(codes[:, None, :], codes[None]).astype(np.int64)
        np.fill_diagonal(own, FAR)
        near = np.sort(np.concatenate([dist.astype(np.int64) << 32 | ids, own << 32 | new[None]], 1), axis=1)[:, :DEGREE]
        real = near >> 32 < FAR
        near = np.where(real, near & 0xFFFFFFFF, self.none)
        self.links[new, : near.shape[1]] = near
        self.fill[new] = DEGREE
        self.size += len(new)
        to, back = near[real], np.repeat(new, near.shape[1])[real.ravel()]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        start = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        spot = self.fill[to] + np.arange(len(to)) - np.repeat(start, np.diff(np.append(start, len(to))))
        # full: in place of another link back, never of a node's own first links
        spot = np.where(spot < LINKS, spot, DEGREE + (back * 2654435761 >> 7) % (LINKS - DEGREE))
        self.links[to, spot] = back
        self.fill = np.minimum(self.fill + np.bincount(to, minlength=len(self.fill)), LINKS)


def shard_edges(code: np.ndarray, radius: int = RADIUS, seed: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of verified edges between the distinct codes of one shard, as index pairs.

    Waves of queries walk the graph and are compared among themselves.  Nodes
    near an already inserted one are linked to it and not inserted: the graph
    holds centres, so a group of thousands of near copies costs few nodes.
    Pairs that involve a node which was not inserted are then found exactly,
    see ``_join_members``.
    """
    n = len(code)
    forest = Forest(n)
    centre_of = np.arange(n)
    order = np.random.RandomState(seed).permutation(n)
    shuffled = np.ascontiguousarray(code[order])
    held = np.empty(n + 1, np.int64)  # the graph's node -> position in ``shuffled``
    graph = SmallWorld(n, radius)
    for a in range(0, n, WAVE):
        spots = np.arange(a, min(a + WAVE, n))
        q = shuffled[spots]
        fresh = np.ones(len(spots), bool)
        near_ids = np.full((len(spots), DEGREE), graph.none)
        near_d = np.full((len(spots), DEGREE), FAR)
        if graph.size:
            for rows, ids, dist in graph.within(q):
                x, y = np.nonzero(dist <= radius)
                forest.join(order[spots[rows[x]]], order[held[ids[x, y]]])
                hit = dist[:, 0] <= radius
                fresh[rows[hit]] = False
                centre_of[spots[rows[hit]]] = held[ids[hit, 0]]
                near_ids[rows], near_d[rows] = ids[:, :DEGREE], dist[:, :DEGREE]
        left = np.flatnonzero(fresh)
        if not len(left):
            continue
        d = distance(q[left][:, None, :], q[left][None])
        owner, taken = np.full(len(left), -1), []  # greedily, so that copies inside a wave also share a centre
        for i in np.flatnonzero((d <= radius).sum(axis=1) > 1).tolist():
            if owner[i] < 0:
                owner[(d[i] <= radius) & (owner < 0)] = i
        owner = np.where(owner < 0, np.arange(len(left)), owner)
        taken = left[np.unique(owner)]
        x, y = np.nonzero(np.triu(d <= radius, 1))
        forest.join(order[spots[left[x]]], order[spots[left[y]]])
        centre_of[spots[left]] = spots[left[owner]]
        held[graph.size + np.arange(len(taken))] = spots[taken]
        graph.insert(q[taken], near_ids[taken], near_d[taken])
    _join_members(shuffled, order, centre_of, radius, forest)
    return forest.edges


def _join_members(code: np.ndarray, order: np.ndarray, centre_of: np.ndarray, radius: int, forest: Forest) -> None:
    """Exact part: the nodes that were not inserted are compared with all of the shard, in blocks."""
    members = np.flatnonzero(centre_of != np.arange(len(code)))
    step = max(1, (1 << 18) // len(code))
    for a in range(0, len(members), step):
        some = members[a : a + step]
        x, y = np.nonzero(distance(code[some, None, :], code[None]) <= radius)
        forest.join(order[some[x]], order[y])


def _shard(hi: Column, lo: Column, table: int, bits: int) -> Column:
    """A hash of the table's number and of the first ``bits`` of its own order of the code's positions."""
    spots = np.random.RandomState(71 + table).permutation(128)[:bits]
    masks = np.zeros(2, np.uint64)
    np.bitwise_or.at(masks, spots // 64, np.uint64(1) << (spots % 64).astype(np.uint64))
    own = [word.bitwiseAND(F.lit(int(m)).cast("long")) for word, m in zip((hi, lo), masks.view(np.int64), strict=True)]
    return F.xxhash64(F.lit(table), F.lit(bits), *own)


def sharded(nodes: DataFrame, tables: range, bits: int, most: int) -> DataFrame:
    """(shard, id, hi, lo) of every node once in each table; shards of more than ``most`` are split by further bits until none is left."""
    spark = nodes.sparkSession
    at = lambda bits: F.array(*[F.struct(F.lit(t).alias("table"), _shard(F.col("hi"), F.col("lo"), t, bits).alias("shard")) for t in tables])
    left = nodes.select(F.explode(at(bits)).alias("key"), "id", "hi", "lo").select("key.table", "key.shard", "id", "hi", "lo")
    done = None
    while True:
        full = settle(spark, left.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("shard"), "full")
        split = bits < 128 and not full.isEmpty()
        fit = left.join(full, "shard", "left_anti") if split else left
        done = fit if done is None else done.unionByName(fit)
        if not split:
            return done.select("shard", "id", "hi", "lo")
        bits = min(bits + 2, 128)
        left = left.join(full, "shard", "left_semi").withColumn("shard", F.get(at(bits)["shard"], F.col("table") - tables.start))


def edges(nodes: DataFrame, many: int, tables: range, bits: int, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Verified edges (a, b) between the ids of ``nodes`` (id, hi, lo), ``many`` of them, that share a shard in one of ``tables``."""

    def flush(part: list[np.ndarray]) -> pa.RecordBatch | None:
        block = np.concatenate(part)
        cut = np.flatnonzero(np.concatenate([[True], block[1:, 0] != block[:-1, 0], [True]]))
        left, right = [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            ids = block[a:b, 1]
            for x, y in shard_edges(np.ascontiguousarray(block[a:b, 2:]).view(np.uint64), radius, int(block[a, 0]) % (1 << 32)):
                left.append(ids[x])
                right.append(ids[y])
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"]) if left else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            block = np.stack([b.column(k).to_numpy() for k in ("shard", "id", "hi", "lo")], axis=1)
            whole = np.searchsorted(block[:, 0], block[-1, 0], "left")
            if whole or kept and kept[-1][-1, 0] != block[0, 0]:
                done = flush([*kept, block[:whole]])
                kept = []
                if done is not None:
                    yield done
            kept.append(block[whole:])
        if kept and (done := flush(kept)) is not None:
            yield done

    parts = -(-many * len(tables) // (2 * shard)) or 1  # said, as the time goes by nodes and not by bytes
    return sharded(nodes, tables, bits, 4 * shard).repartition(parts, "shard").sortWithinPartitions("shard", "id").mapInArrow(run, "a long, b long").distinct()


def audit(nodes: DataFrame, roots: DataFrame, radius: int = RADIUS, queries: int = AUDIT) -> float:
    """Recall against exact search: of the nodes near each of ``queries`` nodes (the lowest by hash), the mean part in its group; 1 where nothing is near.

    The queries are rows of fixed size and number, sent to all tasks, and are compared with every node; each task sends two sums a query.
    """
    spark = nodes.sparkSession
    known = settle(spark, nodes.join(roots.dropDuplicates(["id"]), "id", "left").select("hi", "lo", F.coalesce("root", "id").alias("root")), "audited")
    asked = np.array([tuple(r) for r in known.orderBy(F.xxhash64("hi", "lo"), "hi", "lo").limit(queries).collect()], np.int64).reshape(-1, 3)
    code = np.ascontiguousarray(asked[:, :2]).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, same = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        for b in batches:
            block = np.stack([b.column(k).to_numpy() for k in ("hi", "lo", "root")], axis=1)
            for a in range(0, len(block), 512):
                d = distance(code[:, None, :], np.ascontiguousarray(block[a : a + 512, :2]).view(np.uint64)[None])
                x, y = np.nonzero((d <= radius) & (d > 0))
                near += np.bincount(x, minlength=len(asked))
                same += np.bincount(x[asked[x, 2] == block[a + y, 2]], minlength=len(asked))
        at = np.flatnonzero(near)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(near[at]), pa.array(same[at])], ["query", "near", "same"])

    sums = known.mapInArrow(run, "query long, near long, same long").groupBy("query").agg((F.sum("same") / F.sum("near")).alias("part"))
    mean = sums.agg(F.avg("part")).first()[0] if len(asked) else None
    return 1.0 if mean is None else mean


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """One row for each document that is not the kept one of its group: (doc_id, kept_doc_id, audited_recall)."""
    spark = docs.sparkSession
    sig = settle(spark, signatures(docs), "signatures")
    nodes = settle(spark, sig.groupBy("hi", "lo").agg(F.min("doc_id").alias("id")), "nodes")
    many = nodes.count()
    bits = max(0, math.ceil(math.log2(max(many, 1) / shard)))
    tables = math.ceil(math.log(1 - CAUGHT) / math.log(1 - (1 - radius / 128) ** bits)) if bits and radius else 1
    links = settle(spark, sig.join(nodes, ["hi", "lo"]).filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")), "links")
    for k in range(ROUNDS):
        links = links.unionByName(settle(spark, edges(nodes, many, range(k * tables, (k + 1) * tables), bits, radius, shard), "links"))
        roots = components(links)
        recall = audit(nodes, roots, radius)
        if recall >= RECALL:
            break
    return roots.filter("id <> root").select(F.col("id").alias("doc_id"), F.col("root").alias("kept_doc_id"), F.lit(recall).alias("audited_recall"))


def keep_one(docs: DataFrame, **how: int) -> DataFrame:
    """``docs`` with one row for each near-duplicate group, of the smallest ``doc_id``; rows with a null ``doc_id`` or without a word all stay.

    Each row is compared by its own text, also where it shares its ``doc_id``
    with others; of rows equal in both, one stays.
    """
    spark = docs.sparkSession
    ids = F.col("doc_id").cast("long")
    key = F.when(ids.isNotNull() & F.col("text").isNotNull(), F.xxhash64(ids, F.col("text").cast("string")))
    near = near_duplicates(docs.select(key.alias("doc_id"), "text"), **how).select(F.col("doc_id").alias("__pl_key"), F.col("kept_doc_id").alias("__pl_root"))
    members = settle(spark, near.unionByName(near.select(F.col("__pl_root").alias("__pl_key"), "__pl_root").distinct()), "members")
    owned = settle(spark, docs.select(key.alias("__pl_key"), ids.alias("__pl_id")).join(members, "__pl_key").distinct(), "owned")
    best = owned.groupBy("__pl_root").agg(F.min(F.struct("__pl_id", "__pl_key")).alias("__pl_best"))
    gone = settle(spark, owned.join(best, "__pl_root").filter("__pl_key <> __pl_best.__pl_key").select("__pl_key").distinct(), "gone")
    worded = docs.select(key.alias("__pl_key"), F.regexp_like("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")).alias("__pl_word")).filter("__pl_word and __pl_key is not null")
    twice = settle(spark, worded.groupBy("__pl_key").count().filter("count > 1").select("__pl_key"), "twice")
    if twice.isEmpty():
        return docs.join(gone, key == F.col("__pl_key"), "left_anti")
    once = docs.join(gone.unionByName(twice).distinct(), key == F.col("__pl_key"), "left_anti")
    again = docs.join(twice.join(gone, "__pl_key", "left_anti"), key == F.col("__pl_key"), "left_semi")
    order = W.partitionBy("doc_id", "text").orderBy(F.lit(0))
    return once.unionByName(again.withColumn("__pl_n", F.row_number().over(order)).filter("__pl_n = 1").drop("__pl_n"))
