"""Embedding near-dedup with a pivot-permutation index.

Every vector is described by its nearest reference points (pivots), in order of nearness. Inverted
lists hold, for each label and pivot, the vectors that name the pivot. Two vectors are candidates if
they share `shared` of their `near` pivots; they are compared in the list of their smallest shared
pivot only, so that each pair is verified once. Sorted by pivot number, sets that share s of k have a
pivot in common among their first k - s + 1, so only those are listed. Pivots are a sample of the
vectors, 4 x the root of their number and at most `MOST_PIVOTS`, thinned so that no two are closer than
twice the angle of a link: else a large group holds so many pivots that its members name different ones
and never meet. Every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.components import components
from shelfmark.llm.tables import smallest_labels, sorted_chunks, stored, tidy

THRESHOLD = 0.93
NEAR = 8
SHARED = 2
MOST_PIVOTS = 16_384
#: Rows of a list that one task compares with each other; a longer list is split into pairs of parts.
PART = 512

LIST = ["label", "size", "pivot", "low", "high"]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(-1, width)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(embedding: str, label: str):
    """Whether a row can link at all."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(e, lambda x: x != 0)
    return F.coalesce(F.col(label).isNotNull() & e.isNotNull() & finite & some, F.lit(False))


def apart(points: np.ndarray, threshold: float) -> np.ndarray:
    """Of unit vectors, in their order, those farther from all kept before than twice the link angle."""
    cosine = 2 * min(max(threshold, 0.0), 1.0) ** 2 - 1
    free = np.ones(len(points), dtype=bool)
    kept = []
    for at in range(len(points)):
        if free[at]:
            kept.append(at)
            free[at + 1 :] &= points[at + 1 :] @ points[at] < cosine
    return points[kept]


def _pivots(classes: DataFrame, count: int, threshold: float) -> dict[int, np.ndarray]:
    """At most `count` vectors, by their hash, thinned: the bound is the parameter, not the data."""
    picked = classes.orderBy(F.xxhash64("cid"), "cid").limit(count).select("embedding").collect()
    by_size: dict[int, list] = {}
    for (vector,) in picked:
        by_size.setdefault(len(vector), []).append(vector)
    return {size: apart(unit(np.array(rows, dtype=np.float64)), threshold) for size, rows in by_size.items()}


def _describe(pivots: dict[int, np.ndarray], near: int, shared: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                points = pivots.get(int(size))
                if points is None:  # no pivot has this length: one list, split like any long one
                    named = np.full((part.num_rows, 1), -1, dtype=np.int32)
                else:
                    closeness = unit(_matrix(part.column("embedding"), int(size))) @ points.T
                    k = min(near, len(points))
                    named = np.argsort(-closeness, axis=1, kind="stable")[:, :k].astype(np.int32)
                listed = np.sort(named, axis=1)[:, : max(1, named.shape[1] - shared + 1)]
                columns = [part.column(c) for c in ("cid", "label", "size", "copies", "embedding")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(list(named)), pa.array(list(listed))],
                    names=["cid", "label", "size", "copies", "embedding", "named", "listed"],
                )

    return run


def _compare(threshold: float, shared: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, starts in sorted_chunks(batches, LIST, 4_000):
            ids, copies = chunk.column("cid").to_numpy(), chunk.column("copies").to_numpy()
            own, pivot = chunk.column("own").to_numpy(), chunk.column("pivot").to_numpy()
            split = chunk.column("low").to_numpy() != chunk.column("high").to_numpy()
            sizes = chunk.column("size").to_numpy()
            out_a, out_b, out_n = [], [], []
            for at, end in zip(starts, [*starts[1:], len(ids)]):
                if end - at < 2:
                    continue
                rows = chunk.slice(at, end - at)
                vectors = unit(_matrix(rows.column("embedding"), int(sizes[at])))
                named = _matrix(rows.column("named"), len(rows.column("named")[0]))
                values, place = np.unique(named, return_inverse=True)
                holds = np.zeros((len(named), len(values)), dtype=np.float32)
                holds[np.arange(len(named))[:, None], place.reshape(named.shape)] = 1
                enough = min(shared, named.shape[1])
                before = holds[:, values < pivot[at]]
                candidate = np.triu(holds @ holds.T >= enough, 1) & (before @ before.T == 0)
                if split[at]:
                    candidate &= own[at:end, None] != own[None, at:end]
                i, j = np.nonzero(candidate)
                for k in range(0, len(i), 100_000):
                    a, b = i[k : k + 100_000], j[k : k + 100_000]
                    far = np.einsum("ij,ij->i", vectors[a], vectors[b]) < threshold
                    candidate[a[far], b[far]] = False
                i, j = np.nonzero(candidate)
                if not len(i):
                    continue
                linked = np.bincount(i, copies[at + j], end - at) + np.bincount(j, copies[at + i], end - at)
                label = smallest_labels(end - at, i, j)
                mine = np.flatnonzero(linked)
                out_a.append(ids[at + mine])
                out_b.append(ids[at + label[mine]])
                out_n.append(linked[mine].astype(np.int64))
            if out_a:
                arrays = [pa.array(np.concatenate(x)) for x in (out_a, out_b, out_n)]
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "n"])

    return run


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD, near: int = NEAR, shared: int = SHARED, part: int = PART,
) -> DataFrame:
    """One row per row of `vectors`: (vec_id, n_links, component_id, kept).

    Links join rows of equal label, equal length and a cosine of at least `threshold`. A null label,
    a null, empty or zero vector and null or non-finite parts link with nothing: 0 links, a component
    of their own. Equal vectors are one class with a count; each row counts, repeated rows too. A
    null id is never the smallest and never kept. Other columns are ignored; an empty table gives an
    empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
        F.col(embedding).cast("array<double>").alias("embedding"), usable(embedding, label).alias("usable"),
    )
    classes = stored(
        rows.where("usable").groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .select(F.monotonically_increasing_id().alias("cid"), "*", F.size("embedding").alias("size"))
    )
    count = classes.count()
    pivots = _pivots(classes, min(MOST_PIVOTS, 4 * isqrt(count) + 1), threshold)
    kind = dict(classes.dtypes)["label"]
    listed = stored(
        classes.select("cid", "label", "size", "copies", "embedding")
        .mapInArrow(
            tidy(_describe(pivots, near, shared)),
            f"cid long, label {kind}, size int, copies long, embedding array<double>, "
            "named array<int>, listed array<int>",
        )
        .withColumn("pivot", F.explode("listed"))
        .drop("listed")
    )
    long_lists = stored(
        listed.groupBy("label", "size", "pivot").count().where(F.col("count") > part)
        .select("label", "size", "pivot", F.ceil(F.col("count") / part).alias("parts"))
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.coalesce(F.pmod(F.xxhash64("cid"), F.col("parts")), F.lit(0))
    found = stored(
        listed.join(long_lists, ["label", "size", "pivot"], "left")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .select(*LIST, "own", "cid", "copies", "named", "embedding")
        .repartition(tasks, *LIST)
        .sortWithinPartitions(*LIST)
        .mapInArrow(tidy(_compare(threshold, shared)), "a long, b long, n long")
    )
    linked = found.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    grouped = stored(
        classes.join(components(found), F.col("cid") == F.col("node"), "left")
        .join(linked, "cid", "left")
        .select(
            "label", "embedding", "first_id", F.coalesce("component", "cid").alias("component"),
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        )
    )
    smallest = stored(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")))
    named = stored(grouped.join(smallest, "component").select("label", "embedding", "n_links", "component_id"))
    component = F.coalesce("component_id", "vec_id")
    joined = rows.where("usable").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return joined.unionByName(alone).select(
        "vec_id", "n_links", component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), smallest AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), counted AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, s.component_id, e.vec_id = s.component_id AS kept
FROM embeddings e JOIN smallest s USING (vec_id) LEFT JOIN counted c USING (vec_id)
"""
