"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node in `edges` (a, b: long); component is the smallest node it
    reaches. Null ends and loops link nothing. An empty table gives an empty table.

    Each step joins the edges with a written table of one row per node, so that adaptive execution
    broadcasts it when it is small and otherwise splits the partition of a node with very many edges.
    """
    pairs = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    state = _state(pairs)
    while True:
        around = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = stored(
            around.groupBy("u").agg(F.min("v").alias("m"))
            .select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        )
        large = stored(pairs.join(lowest, "v").select("u", F.col("m").alias("v")).distinct())
        first = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        pairs = stored(
            large.join(first, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .union(first.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = _state(pairs)
        if now == state:
            break
        state = now
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def _state(pairs: DataFrame) -> tuple:
    """One row: as many edges with the same sum of hashes are taken as the same edges."""
    hashed = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    return tuple(pairs.agg(F.count(F.lit(1)), hashed).first())
