"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperlane.llm.stored import settle


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every end of ``links`` (a, b): root is the smallest id of its component.

    Alternating large-star and small-star rounds: the number of rounds grows
    with the logarithm of the longest chain and each is two aggregations over
    at most as many edges as there were.  Null ends, loops and repeated edges
    do nothing; an empty table gives an empty result.
    """
    spark = links.sparkSession
    now = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = settle(spark, now, "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = small.unionByName(small_low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = settle(spark, nxt, "edges")
        state = now.agg(F.count("*"), F.sum(F.col("b").cast("decimal(20)")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
