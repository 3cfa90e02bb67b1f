"""Comparing a new listing with the stored files: what is new, changed, unchanged or gone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas

FILE_KEY = ["root_id", "rel_path"]
_STATE_COLUMNS = [c for c in schemas.FILES.names if c not in FILE_KEY]
# A listing is compared on these; equal values never allow the stored digest to be reused.
_STAT_COLUMNS = ["size", "mtime", "ino"]
INGESTED = ("new", "changed", "unchanged")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def compare_listings(previous: DataFrame, current: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per path of either side, with the row to store next and its `change`.

    `previous` has the columns of `schemas.FILES`; `current` has them too, plus `readable`.
    `roots` has `root_id` and `present`, one row per root of this scan. Files of a root that is
    absent or not part of the scan keep their rows (`offline`), because being away is a property of
    the root. A path seen in the listing without a readable target (`readable` false, for instance a
    broken link) is neither stored anew nor gone (`seen`).
    """
    old = previous.select(*FILE_KEY, F.struct(*_STATE_COLUMNS).alias("old"))
    new = current.select(*FILE_KEY, "readable", F.struct(*_STATE_COLUMNS).alias("new"))
    online = roots.where("present").select("root_id", F.lit(True).alias("online"))
    pairs = old.join(new, FILE_KEY, "full_outer").join(online, "root_id", "left")

    known, listed = F.col("old").isNotNull(), F.col("new").isNotNull()
    same = _all([F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in _STAT_COLUMNS])
    change = (
        F.when(F.col("online").isNull(), "offline")
        .when(~listed & (F.col("old.state") == "present"), "gone")
        .when(~listed, "missing")
        .when(~F.col("readable"), "seen")
        .when(~known, "new")
        .when(same, "unchanged")
        .otherwise("changed")
    )
    ingested, gone = F.col("change").isin(*INGESTED), F.col("change") == "gone"

    def stored(column: str) -> Column:
        kept = F.when(ingested, F.col(f"new.{column}")).otherwise(F.col(f"old.{column}"))
        overrides = {
            "state": F.when(ingested, "present").when(gone, "missing").otherwise(kept),
            "sha256": F.when(~gone, kept),
            "hash_state": F.when(gone, "none").otherwise(kept),
        }
        return overrides.get(column, kept).alias(column)

    # Paths that make no row ("seen" or "offline" without a stored one) stay in the result for the
    # scan counters; `next_files` drops them.
    return pairs.withColumn("change", change).select(
        *FILE_KEY, *[stored(c) for c in _STATE_COLUMNS], known.alias("was_known"), "change"
    )


def next_files(changes: DataFrame) -> DataFrame:
    """The file table after the scan."""
    makes_row = F.col("change").isin(*INGESTED) | F.col("was_known")
    return changes.where(makes_row).select(*schemas.FILES.names)


def gone_files(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("change") == "gone").select(*FILE_KEY)


def drop_roles_of_missing(roles: DataFrame, files: DataFrame) -> DataFrame:
    missing = files.where(F.col("state") == "missing").select(*FILE_KEY)
    return roles.join(missing, FILE_KEY, "left_anti")


def needs_hash(listing: DataFrame, quick: bool = False) -> DataFrame:
    """Adds `needs_hash`: every readable regular file of a full scan, whatever its stat says."""
    return listing.withColumn(
        "needs_hash", F.col("readable") & ~F.col("is_symlink") & F.lit(not quick)
    )


def scan_report(
    changes: DataFrame,
    roots: DataFrame,
    skips: DataFrame | None = None,
    new_families: DataFrame | None = None,
) -> DataFrame:
    """The scan counters of each root, in one pass over the compared rows.

    `skips` has `root_id` and `reason` for every listing entry left out; `new_families` has
    `root_id`, the root whose file made the family. Both become counted rows beside the files, so
    one partial aggregation per task is all that is shuffled.
    """
    ingested = F.col("change").isin(*INGESTED)
    flags = {
        "files_seen": ingested | (F.col("change") == "seen"),
        "files_new": F.col("change") == "new",
        "files_changed": F.col("change") == "changed",
        "files_gone": F.col("change") == "gone",
        "files_unsupported": ingested
        & (F.col("parse_state") == "unsupported")
        & ~F.coalesce(F.col("is_symlink"), F.lit(False)),
        "files_unverified": ingested & (F.col("hash_state") != "full"),
    }
    labels = ["families_new", "skipped_symlink_dirs", "skipped_non_utf8", "dirs_unreadable",
              "skipped_deep"]
    counted = changes.groupBy("root_id").agg(
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()],
        *[F.lit(0).cast("long").alias(n) for n in labels],
    )
    extras = []
    if skips is not None:
        extras.append(skips.select("root_id", F.col("reason").alias("label")))
    if new_families is not None:
        extras.append(new_families.select("root_id", F.lit("families_new").alias("label")))
    for extra in extras:
        per_root = extra.groupBy("root_id").agg(
            *[F.lit(0).cast("long").alias(n) for n in flags],
            *[F.count_if(F.col("label") == n).alias(n) for n in labels],
        )
        counted = counted.unionByName(per_root)
    totals = counted.groupBy("root_id").agg(*[F.sum(n).alias(n) for n in [*flags, *labels]])
    zero = F.lit(0).cast("long")
    return roots.select("root_id", (~F.col("present")).alias("root_offline")).join(
        totals, "root_id", "left"
    ).select(
        "root_id",
        "root_offline",
        *[F.coalesce(n, zero).alias(n) for n in [*flags, "families_new"]],
        zero.alias("duplicates"),
        *[F.coalesce(n, zero).alias(n) for n in labels[1:]],
    )


def scan_runs_rows(report: DataFrame, started: int, finished: int) -> DataFrame:
    """History rows of one scan, ready to be appended to `scan_runs`."""
    timed = report.withColumns(
        {
            "started": F.lit(started).cast("long"),
            "finished": F.lit(finished).cast("long"),
            "ok": ~F.col("root_offline"),
        }
    )
    return timed.select(*schemas.SCAN_RUNS.names)


def upsert_blobs(existing: DataFrame, found: DataFrame) -> DataFrame:
    """One row per digest: the newest size, and the newest partial digest that is not null.

    `found` has the columns of `schemas.BLOBS` and `seq`, the order in which they were written.
    """
    rows = existing.withColumn("seq", F.lit(-1).cast("long")).unionByName(
        found.select("sha256", "size", "partial_digest", F.col("seq").cast("long"))
    )
    partial_seq = F.when(F.col("partial_digest").isNotNull(), F.col("seq"))
    return (
        rows.where(F.col("sha256").isNotNull())
        .groupBy("sha256")
        .agg(
            F.max_by("size", "seq").alias("size"),
            F.max_by("partial_digest", partial_seq).alias("partial_digest"),
        )
    )


def remove_roots(
    roots: DataFrame, files: DataFrame, roles: DataFrame, removed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roots, files and roles without those of the removed roots; all other tables stay."""
    gone = removed.select("root_id").distinct()
    return tuple(t.join(gone, "root_id", "left_anti") for t in (roots, files, roles))


def with_presence(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files with the presence they inherit from their root (never probed counts as absent)."""
    at = roots.select("root_id", F.coalesce("present", F.lit(False)).alias("root_present"))
    return files.join(at, "root_id", "left").withColumn(
        "root_present", F.coalesce("root_present", F.lit(False))
    )
