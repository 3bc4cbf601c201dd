"""A content-addressed store of token ids.

Texts become ids of a byte-level vocabulary.  A gear hash rolls over the ids:
``G = (G << 1) + gear(id)``; an id whose G has its low ``MASK_BITS`` bits clear
ends a chunk, unless one of the ``MIN_IDS`` ids before it would (the rule looks
back a fixed number of ids, so an insertion moves no boundary beyond that), and
a run of ``MAX_IDS`` ids without a boundary is cut there.  The store is one
table of objects, each under the BLAKE2b digest of what it holds:

* ``chunk``: ``ids`` holds up to ``MAX_IDS`` little-endian 16-bit ids.  Each
  distinct chunk is stored once, whatever number of documents have it.
* ``recipe``: one for each document; ``parts`` are the addresses of its chunks
  in order and ``address`` is the root of the Merkle tree over them.
* ``manifest``: one for each group of documents; ``parts`` are the sorted
  recipe addresses of the group, ``address`` their Merkle root.
* where there are more than ``GROUP`` manifests, a ``manifest`` over each
  ``GROUP`` of them in order, and so on, so that no row grows with the corpus.
* ``root``: one; ``parts`` are the addresses of the topmost manifests in order.

``rebuild`` turns recipes back into texts and says for each whether every
digest on the way holds; ``check_manifests`` does so for the groups.

Defined results: a null text has a recipe with null ``n_ids`` and no parts, an
empty text one with 0 ids; rows that repeat a ``doc_id`` have a recipe each,
and rows without a ``doc_id`` too.  An empty table gives a root without parts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paperlane.llm import arrays as A
from paperlane.llm.stored import settle

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MASK_BITS = 6
MIN_IDS = 32
MAX_IDS = 1024
GROUP = 8192
WIDTH = 16
_GEAR = A.mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
SCHEMA = "kind string, address binary, doc_id long, n_ids long, ids binary, parts array<binary>"


def digest(content: bytes, kind: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=WIDTH, person=kind).digest()


def merkle_root(parts: list[bytes], n: int | None) -> bytes:
    """Root over ``parts``; an odd node moves up as it is.  ``n`` (the number of ids, or none) is part of the root."""
    level = parts
    while len(level) > 1:
        above = [digest(level[k] + level[k + 1], b"node") for k in range(0, len(level) - 1, 2)]
        level = above + level[len(level) - len(level) % 2 :]
    return digest((level[0] if level else b"") + (b"" if n is None else n.to_bytes(8, "little")), b"root")


@cache
def encoding(path: str):
    """The encoder of a vocabulary of ranks, once for each worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids don't fit 16 bits")
    return tiktoken.Encoding("store", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def chunk_ends(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The position after each chunk's last id; ``first`` has the row borders (rows + 1 entries)."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    gear = _GEAR[ids]
    roll = gear.copy()
    for back in range(1, MASK_BITS):  # the low bits of G depend on that many ids
        same = row[back:] == row[:-back]
        roll[back:] += np.where(same, gear[:-back] << np.uint64(back), np.uint64(0))
    hit = np.flatnonzero((roll & np.uint64((1 << MASK_BITS) - 1)) == 0)
    alone = np.ones(len(hit), bool)
    alone[1:] = (np.diff(hit) > MIN_IDS) | (row[hit[1:]] != row[hit[:-1]])
    borders = first[1:][np.diff(first) > 0]
    ends = np.union1d(hit[alone] + 1, borders)
    begin = np.concatenate([[0], ends[:-1]])
    many = -(-(ends - begin) // MAX_IDS)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.minimum(np.repeat(begin, many) + (step + 1) * MAX_IDS, np.repeat(ends, many))


def _objects(vocabulary: str, docs: DataFrame) -> DataFrame:
    """Recipes of all documents, and the chunks that are new within a task; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        seen: set[bytes] = set()
        for batch in A.slices(batches, "text", 1 << 20):
            coded = [None if t is None else np.array(encode(t), "<u2") for t in batch.column("text").to_pylist()]
            sizes = np.array([0 if c is None else len(c) for c in coded], np.int64)
            first = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.concatenate([c for c in coded if c is not None] or [np.zeros(0, "<u2")])
            ends = chunk_ends(flat, first)
            raw, content, names = memoryview(flat.tobytes()), [], []
            begin = 0
            for end in (2 * ends).tolist():
                piece = raw[begin:end]
                begin = end
                name = digest(piece, b"chunk")
                names.append(name)
                if name not in seen:
                    seen.add(name)
                    content.append((name, piece))
            at = np.searchsorted(ends, first, "right")
            at[0] = 0
            parts = [names[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            lengths = [None if c is None else len(c) for c in coded]
            roots = [merkle_root(p, n) for p, n in zip(parts, lengths, strict=True)]
            k, c = batch.num_rows, len(content)
            none = pa.nulls
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["recipe"] * k + ["chunk"] * c),
                    pa.array(roots + [name for name, _ in content], pa.binary()),
                    pa.concat_arrays([batch.column("doc_id"), none(c, pa.int64())]),
                    pa.array(lengths + [len(p) // 2 for _, p in content], pa.int64()),
                    pa.array([None] * k + [p for _, p in content], pa.binary()),
                    pa.array(parts + [None] * c, pa.list_(pa.binary())),
                ],
                ["kind", "address", "doc_id", "n_ids", "ids", "parts"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _distinct_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by address: the first of each."""
    last = None
    for batch in batches:
        if batch.num_rows:
            names = np.array(batch.column("address").to_pylist(), dtype=f"V{WIDTH}")
            keep = np.ones(len(names), bool)
            keep[1:] = names[1:] != names[:-1]
            keep[0] = names[0] != last
            last = names[-1]
            yield batch.filter(pa.array(keep))


def build(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """All objects of the store for ``docs``."""
    spark = docs.sparkSession
    made = settle(spark, _objects(vocabulary, docs), "objects", by="kind")
    chunk = made.filter("kind = 'chunk'").select("address", "n_ids", "ids")
    chunk = chunk.repartition("address").sortWithinPartitions("address").mapInArrow(_distinct_chunks, "address binary, n_ids long, ids binary")
    recipe = made.filter("kind = 'recipe'").select("kind", "address", "doc_id", "n_ids", "ids", "parts")
    above = manifests(recipe)
    whole = chunk.select(F.lit("chunk").alias("kind"), "address", F.lit(None).cast("long").alias("doc_id"), "n_ids", "ids", F.lit(None).cast("array<binary>").alias("parts"))
    return whole.unionByName(recipe).unionByName(above)


def _group(groups: int) -> Column:
    """The group of a recipe address: equal documents go to one group."""
    return F.pmod(F.xxhash64("address"), F.lit(groups)).cast("long")


def _top(table: pa.Table, kind: str = "root", group: int | None = None) -> pa.Table:
    """The object over manifests in the order of their groups."""
    table = table.sort_by("doc_id")
    names = table.column("address").to_pylist()
    return _above(kind, group, names, len(names))


def _above(kind: str, group: int | None, names: list[bytes], n: int) -> pa.Table:
    columns = [[kind], [merkle_root(names, n)], [group], [n], [None], [names]]
    types = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "address", "doc_id", "n_ids", "ids", "parts"])


def manifests(recipe: DataFrame, fan: int = GROUP) -> DataFrame:
    """Manifest objects (``n_ids``: parts; ``doc_id``: null) of groups of about ``GROUP`` recipes, those over ``fan`` manifests each, and the root."""
    spark = recipe.sparkSession
    groups = max(1, -(-recipe.count() // GROUP))

    def of_group(table: pa.Table) -> pa.Table:
        names = sorted(table.column("address").to_pylist())
        return _above("manifest", table.column("grp")[0].as_py(), names, len(names))

    def of_level(table: pa.Table) -> pa.Table:
        return _top(table, "manifest", table.column("grp")[0].as_py())

    level = settle(spark, recipe.select("address", _group(groups).alias("grp")).groupBy("grp").applyInArrow(of_group, SCHEMA), "manifests")
    made = level
    while groups > fan:
        groups = -(-groups // fan)
        above = level.select("address", "doc_id", F.floor(F.col("doc_id") / fan).alias("grp"))
        level = settle(spark, above.groupBy("grp").applyInArrow(of_level, SCHEMA), "manifests")
        made = made.unionByName(level)
    heads = level.select("address", "doc_id")

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        names = pa.Table.from_batches(found) if found else pa.table({"address": pa.array([], pa.binary()), "doc_id": pa.array([], pa.int64())})
        yield from _top(names).to_batches()

    return made.withColumn("doc_id", F.lit(None).cast("long")).unionByName(heads.coalesce(1).mapInArrow(top, SCHEMA))


def rebuild(objects: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text, intact) for each recipe: the text from its chunks, and whether all digests and lengths hold.

    A recipe of which a chunk is missing or altered has ``intact`` false and a null text.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        doc, n, parts = (table.column(c)[0].as_py() for c in ("doc_id", "n_ids", "parts"))
        found = table.column("content").to_pylist()
        if n is None:
            ok, text = not parts and table.column("address")[0].as_py() == merkle_root([], None), None
        else:
            pieces = found if parts else []
            ok = all(p is not None and digest(p, b"chunk") == name for p, name in zip(pieces, parts, strict=True))
            ok = ok and sum(map(len, pieces)) == 2 * n and merkle_root(parts, n) == table.column("address")[0].as_py()
            text = encoding(vocabulary).decode_bytes(np.frombuffer(b"".join(pieces), "<u2").tolist()).decode() if ok else None
        return pa.table({"doc_id": pa.array([doc], pa.int64()), "text": pa.array([text], pa.string()), "intact": pa.array([ok])})

    recipe = objects.filter("kind = 'recipe'").select("address", "doc_id", "n_ids", "parts").withColumn("row", F.monotonically_increasing_id())
    recipe = settle(objects.sparkSession, recipe, "recipes")
    chunk = objects.filter("kind = 'chunk'").select(F.col("address").alias("name"), F.col("ids").alias("content"))
    wanted = recipe.select("row", F.posexplode_outer("parts").alias("at", "name")).join(chunk, "name", "left").select("row", "at", "content")
    return wanted.join(recipe, "row").groupBy("row").applyInArrow(run, "doc_id long, text string, intact boolean")


def check_manifests(objects: DataFrame) -> DataFrame:
    """(address, intact) of the manifests and the root: whether their parts give their address and are what the store holds."""
    found = manifests(objects.filter("kind = 'recipe'")).select("address", F.col("kind").alias("as"))
    there = objects.filter("kind IN ('manifest', 'root')").select("address", "kind", "n_ids", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [merkle_root(p, n) == a and known for a, n, p, known in zip(*(batch.column(c).to_pylist() for c in ("address", "n_ids", "parts", "known")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("address"), pa.array(ok, pa.bool_())], ["address", "intact"])

    return there.join(found, "address", "left").select("address", "n_ids", "parts", F.col("as").isNotNull().alias("known")).mapInArrow(run, "address binary, intact boolean")
