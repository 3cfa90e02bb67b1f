"""Byte-identical copies: groups, copies, totals, and which files could be hashed cheaply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.hot_keys import join_lookup

ALLOCATION = ("dev", "ino")


def has_bytes() -> Column:
    """True for a file whose content is known by a full digest."""
    return F.coalesce(
        (F.col("hash_state") == "full") & F.col("sha256").isNotNull(), F.lit(False)
    )


def duplicate_groups(files: DataFrame, alloc_cols: Sequence[str] = ALLOCATION) -> DataFrame:
    """One row per digest with more than one present copy, sorted by digest.

    Copies that share an allocation (hard links) free nothing, so `reclaimable_files` is the number
    of allocations less one. Counting goes in two steps, by allocation and then by digest; both
    combine before they shuffle, so a digest with very many copies reaches its task as a few
    partial rows, and no list of copies is ever built.
    """
    present = files.where(
        (F.col("hash_state") == "full")
        & F.col("sha256").isNotNull()
        & (F.col("state") == "present")
    ).dropna(subset=list(alloc_cols))
    allocations = present.groupBy("sha256", *alloc_cols).agg(
        F.count(F.lit(1)).alias("n"), F.max("size").alias("size")
    )
    groups = (
        allocations.groupBy("sha256")
        .agg(
            F.max("size").alias("size"),
            F.sum("n").alias("copies"),
            F.count(F.lit(1)).alias("allocations"),
        )
        .where(F.col("copies") > 1)
    )
    return (
        groups.withColumn("reclaimable_files", F.col("allocations") - 1)
        .withColumn("reclaimable_bytes", F.col("reclaimable_files") * F.col("size"))
        .orderBy("sha256")
    )


def duplicate_copies(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Every copy of every duplicate group, one row per path.

    The groups have one row per digest, so a digest with very many copies is large on one side of
    the join only, which adaptive execution splits.
    """
    groups = duplicate_groups(files).select("sha256", "copies")
    present = files.where(
        (F.col("hash_state") == "full") & (F.col("state") == "present")
    ).dropna(subset=["sha256", *ALLOCATION])
    names = roots.select("root_id", F.col("name").alias("root_name"))
    return (
        join_lookup(present, groups, ["sha256"], "inner")
        .join(names, "root_id")
        .select("sha256", "root_id", "root_name", "rel_path", *ALLOCATION, "copies", "size")
    )


def duplicate_totals(files: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return duplicate_groups(files).agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("reclaimable_files"), zero).alias("reclaimable_files"),
        F.coalesce(F.sum("reclaimable_bytes"), zero).alias("reclaimable_bytes"),
    )


def have_bytes(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Answers each request row `(root_id, rel_path)`; an unknown path is answered with false."""
    owned = files.where(has_bytes()).select("root_id", "rel_path", F.lit(True).alias("owned"))
    return requests.join(owned, ["root_id", "rel_path"], "left").select(
        *requests.columns, F.coalesce("owned", F.lit(False)).alias("have_bytes")
    )


def blob_refcount(blobs: DataFrame, files: DataFrame) -> DataFrame:
    """Files that hold each blob; blobs without files count zero."""
    held = (
        files.where(F.col("sha256").isNotNull())
        .groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("refcount"))
    )
    return blobs.join(held, "sha256", "left").select(
        "sha256", "size", F.coalesce("refcount", F.lit(0).cast("long")).alias("refcount")
    )


def hash_gate(files: DataFrame, by: Sequence[str] = ("size", "partial_digest")) -> DataFrame:
    """Adds `collides`: another file has the same size and partial digest, so only a full digest
    can tell them apart. A file without a known size or partial digest collides with none. The keys that
    collide are aggregated and joined back, so a common size does not gather its files in one task."""
    known = files.dropna(subset=list(by))
    seen = known.groupBy(*by).count().where(F.col("count") > 1).select(*by, F.lit(True).alias("collides"))
    return join_lookup(files, seen, list(by)).withColumn("collides", F.coalesce("collides", F.lit(False)))


#: A file of at most twice this size is read whole for its partial digest, which then is the full one.
EDGE_BYTES = 64 << 10


def open_after_size(files: DataFrame, known: DataFrame) -> DataFrame:
    """First pass of the staged digests: adds `open`, whether another file, or something `known`, has the size.

    `files` has one row per file with `size`; `known` has `size, partial_digest` of what is stored already
    or can't be read now (a null digest is not known). Files of unknown size, and those whose column
    `needs_hash`, if there, is false, are closed and count for no other file.
    """
    return _met(files, known, ["size"])


def open_after_edges(files: DataFrame, known: DataFrame) -> DataFrame:
    """Second pass: `open` stays true only where the partial digest is the same as well. Something known by its
    size alone keeps all files of that size open, since it may be equal; so does a file that could not be read
    for its partial digest, which stays open itself."""
    by_size = known.where(F.col("partial_digest").isNull()).select("size").distinct().withColumn("blind", F.lit(True))
    met = _met(files, known, ["size", "partial_digest"])
    return join_lookup(met, by_size, ["size"]).withColumn(
        "open", F.col("asked") & (F.col("open") | F.coalesce("blind", F.lit(False)) | F.col("partial_digest").isNull())
    ).drop("blind")


def _met(files: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """Adds `open`: a second file, or a known one, has the same values; of files that are open so far (`asked`)."""
    asked = F.col("needs_hash") if "needs_hash" in files.columns else F.lit(True)
    asked = F.coalesce(asked & F.col("size").isNotNull(), F.lit(False))
    if "open" in files.columns:
        asked = F.col("open")
    marked = files.withColumn("asked", asked)
    one = F.lit(1).cast("long")
    every = marked.where("asked").select(*by, one.alias("n")).unionByName(known.select(*by, (one + 1).alias("n")))
    several = every.dropna(subset=by).groupBy(*by).agg(F.sum("n").alias("n")).where("n > 1")
    found = join_lookup(marked.drop("open"), several.select(*by, F.lit(True).alias("several")), by)
    return found.withColumn("open", F.col("asked") & F.coalesce("several", F.lit(False))).drop("several")
