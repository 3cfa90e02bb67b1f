"""Joining rows, of which very many may share one key, with a table that has one row per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import cut, size_in_bytes, written

# Parts a hot key is split into. Adaptive execution splits a part further when it is still too large.
PARTS = 16


def join_lookup(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """`rows` joined with `lookup`, which has at most one row per `on`.

    The lookup is written first. If its files are within Spark's own limit it is broadcast, and no row
    moves. Otherwise: a lookup made by aggregation is already partitioned by its key, so Spark would send every
    row of a hot key to that one partition, and adaptive execution could not split it. So the rows are
    written too, once, and keys with more rows than an average partition are found by a count of the key
    columns alone; there are fewer of them than partitions, which bounds what is broadcast. Only their rows are
    dealt to `PARTS` parts, one after the other, and only their lookup rows are copied. Rows with a null key
    meet nothing and are dealt out as well.
    """
    on = list(on)
    lookup = written(lookup)
    spark = rows.sparkSession
    if size_in_bytes(lookup) <= broadcast_limit(spark):
        return rows.join(lookup, on, how)
    rows = written(rows)
    counts = cut(rows.dropna(subset=on).groupBy(*on).count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(counts.where(F.col("count") > total / partitions).select(*on, F.lit(True).alias("is_hot")))
    part, turn = "part_of_key", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))
    some_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    mine = rows.withColumn("turn_of_row", turn).join(hot, on, "left").withColumn(
        part, F.when(F.col("is_hot") | some_null, F.col("turn_of_row")).otherwise(F.lit(0).cast("long"))
    )
    last = F.when(F.col("is_hot"), F.lit(PARTS - 1)).otherwise(F.lit(0)).cast("long")
    theirs = lookup.join(hot, on, "left").withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return mine.drop("is_hot", "turn_of_row").join(theirs.drop("is_hot"), [*on, part], how).drop(part)


def broadcast_limit(spark) -> int:
    """Bytes; -1 if broadcasts are off. Spark gives the setting as a number or with a unit."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
