"""Sharding by a hierarchical weighted hash tree.

A key descends from region to rack to shard.  At each level every child draws
``-ln(u) / weight`` with u from a hash of the key and the child's path, and the
least draw wins, so a child is chosen in proportion to its weight.  The weight
of a region or rack is the sum of its shards.  A draw depends on nothing but
the key, the path and the weight: raising a weight moves keys only into the
subtrees that hold it, lowering it only out of them.

Defined results: a null key is one key of its own.  Rows that repeat a key go
to the same shard.  A child of weight 0 or less takes no key; ties go to the
name that sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

Tree = dict[str, dict[str, dict[str, float]]]

TREE: Tree = {
    region: {f"rack{r}": {f"shard{s}": float(1 + (r + s) % 3) for s in range(shards)} for r in range(racks)}
    for region, racks, shards in (("east", 4, 6), ("north", 3, 4), ("south", 2, 8), ("west", 3, 5))
}
LEVELS = ("region", "rack", "shard")


def weight(node: dict | float) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else max(float(node), 0.0)


def _draw(key: Column, path: str, w: float) -> Column:
    """-ln(u) / w, where u comes from the first 13 hexadecimal digits of the MD5 of key and path."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"|{path}")).cast("binary")), 1, 13)
    return -F.log((F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(w)


def _choose(key: Column, prefix: str, node: dict) -> Column:
    open_children = sorted((name, weight(child)) for name, child in node.items() if weight(child) > 0)
    if not open_children:
        return F.lit(None).cast("string")
    return F.array_min(F.array(*[F.struct(_draw(key, prefix + name, w).alias("d"), F.lit(name).alias("n")) for name, w in open_children]))["n"]


def assign(rows: DataFrame, key: str = "doc_id", tree: Tree = TREE) -> DataFrame:
    """``rows`` with region, rack and shard, which replace columns of such a name; no shuffle and no Python."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))

    def below(own: Column, prefix: str, node: dict) -> Column:
        """The level under the node that ``own`` names."""
        out = F.lit(None).cast("string")
        for name, child in node.items():
            out = F.when(own == name, _choose(text, f"{prefix}{name}/", child)).otherwise(out)
        return out

    # under names that no column has, as the key may be named like a level
    done = rows.withColumn("__pl_region", _choose(text, "", tree))
    done = done.withColumn("__pl_rack", below(F.col("__pl_region"), "", tree))
    shard = F.lit(None).cast("string")
    for r, racks in tree.items():
        shard = F.when(F.col("__pl_region") == r, below(F.col("__pl_rack"), f"{r}/", racks)).otherwise(shard)
    done = done.withColumn("__pl_shard", shard)
    return done.withColumns({n: F.col(f"__pl_{n}") for n in LEVELS}).drop(*[f"__pl_{n}" for n in LEVELS])


def oracle(table: str, key: str = "doc_id", tree: Tree = TREE) -> str:
    """The same assignment as SQL over a table of nodes."""
    nodes = []
    for r, racks in tree.items():
        nodes.append(("", r, weight(racks)))
        for k, shards in racks.items():
            nodes.append((f"{r}/", k, weight(shards)))
            nodes += [(f"{r}/{k}/", s, w) for s, w in shards.items()]
    values = ", ".join(f"('{p}', '{n}', {float(w)!r})" for p, n, w in nodes if w > 0)
    draw = f"-ln((CAST('0x' || substr(md5(coalesce(CAST(k AS VARCHAR), 'null') || '|' || n.prefix || n.name), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52)!r}) / n.w"
    return f"""
WITH nodes(prefix, name, w) AS (VALUES {values}),
keys AS (SELECT DISTINCT {key} AS k FROM {table}),
r AS (SELECT k, arg_min(n.name, {draw}) AS region FROM keys, nodes n WHERE n.prefix = '' GROUP BY k),
a AS (SELECT r.k, r.region, arg_min(n.name, {draw.replace("CAST(k ", "CAST(r.k ")}) AS rack FROM r JOIN nodes n ON n.prefix = r.region || '/' GROUP BY r.k, r.region),
s AS (SELECT a.k, a.region, a.rack, arg_min(n.name, {draw.replace("CAST(k ", "CAST(a.k ")}) AS shard FROM a JOIN nodes n ON n.prefix = a.region || '/' || a.rack || '/' GROUP BY a.k, a.region, a.rack)
SELECT d.{key}, s.region, s.rack, s.shard FROM {table} d JOIN s ON d.{key} IS NOT DISTINCT FROM s.k
"""
