"""Listing folder trees as a distributed job.

Folders are listed level by level: each round is one job over all folders of that depth, dealt to
tasks by a hash of their path. A root or a branch that holds most folders is therefore spread like
any other, and file stats are read in a job of their own, so one huge flat folder is only a long
list of names for its task. Spark's own file index is not used because it leaves out names that
start with ``.`` or ``_``.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.session import cut

_ENTRY = "root_id long, root_path string, rel_path string, what string, is_symlink boolean"


def _list_folder(root_path: str, rel: str) -> Iterator[tuple[str, str, bool]]:
    """Names in one folder: `(rel_path, what, is_symlink)`; what is left out carries its reason."""
    try:
        entries = os.scandir(os.path.join(root_path, rel))
    except OSError:
        yield rel, "dirs_unreadable", False
        return
    with entries:
        while True:
            try:
                entry = next(entries, None)
            except OSError:  # what a network mount lists may break off; what came before counts
                yield rel, "dirs_unreadable", False
                return
            if entry is None:
                return
            path = f"{rel}{entry.name}"
            try:
                path.encode("utf-8")
            except UnicodeEncodeError:
                yield rel, "skipped_non_utf8", False
                continue
            try:
                found = _what(entry)
            except OSError:
                yield path, "dirs_unreadable", False
                continue
            if found is not None:
                what, is_link = found
                yield f"{path}/" if what == "folder" else path, what, is_link


def _what(entry: os.DirEntry) -> tuple[str, bool] | None:
    if entry.is_symlink():
        try:
            to_folder = entry.is_dir()
        except OSError:
            to_folder = False
        return "skipped_symlink_dirs" if to_folder else "file", True
    if entry.is_dir(follow_symlinks=False):
        return "folder", False
    return ("file", False) if entry.is_file(follow_symlinks=False) else None


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["root_id", "root_path", "rel_path", "what", "is_symlink"]
    for batch in batches:
        for root_id, root_path, rel in zip(batch.root_id, batch.root_path, batch.rel_path):
            rows = []
            for found in _list_folder(root_path, rel):
                rows.append((root_id, root_path, *found))
                if len(rows) == 10_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)


def _tasks(df: DataFrame, tasks: int | None) -> int:
    """An explicit number, since adaptive execution would merge tasks by the bytes of mere names."""
    return tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def walk(roots: DataFrame, max_depth: int | None = None, tasks: int | None = None) -> DataFrame:
    """All entries below the given roots (`root_id, path`): files and what was left out, by `what`.

    The walk ends when no folder is left; `max_depth` ends it earlier and counts what it leaves out.

    Each round is checkpointed, so later steps see the same names even if folders change meanwhile.
    """
    folders = roots.select(
        "root_id", F.col("path").alias("root_path"), F.lit("").alias("rel_path")
    )
    levels: list[DataFrame] = []
    for depth in count():
        if max_depth is not None and depth > max_depth:
            levels.append(
                folders.select(
                    "root_id", "root_path", "rel_path", F.lit("skipped_deep").alias("what"),
                    F.lit(False).alias("is_symlink"),
                )
            )
            break
        found = cut(
            folders.repartition(_tasks(roots, tasks), "root_id", "rel_path").mapInPandas(_list_folders, _ENTRY)
        )
        is_folder = F.col("what") == "folder"
        levels.append(found.where(~is_folder))
        folders = found.where(is_folder).select("root_id", "root_path", "rel_path")
        if folders.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def _signed64(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _stat_row(root_path: str, rel: str, is_symlink: bool) -> tuple:
    path = os.path.join(root_path, rel)
    target = None
    try:
        if is_symlink:
            target = os.readlink(path).encode("utf-8", "replace").decode("utf-8")
        info = os.stat(path)
    except OSError:
        return (None,) * 5 + (target, False)
    if not stat.S_ISREG(info.st_mode):
        return (None,) * 5 + (target, False)
    mtime = max(0, info.st_mtime_ns // 1_000_000_000)
    born = getattr(info, "st_birthtime", None)
    ctime = mtime if born is None else max(0, int(born))
    return info.st_size, mtime, ctime, _signed64(info.st_dev), _signed64(info.st_ino), target, True


def _stat_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["size", "mtime", "ctime", "dev", "ino", "symlink_target", "readable"]
    for batch in batches:
        rows = [
            _stat_row(*row) for row in zip(batch.root_path, batch.rel_path, batch.is_symlink)
        ]
        stats = pd.DataFrame(rows, columns=columns, dtype=object)
        whole = {c: "Int64" for c in columns[:5]}
        stats = stats.astype(whole)
        named = batch[["root_id", "root_path", "rel_path", "is_symlink"]].reset_index(drop=True)
        yield pd.concat([named, stats], axis=1)[list(schemas.LISTING.names)]


def list_files(entries: DataFrame, tasks: int | None = None) -> DataFrame:
    """The files among `entries` (of `walk`) with their stat, as `schemas.LISTING`.

    A link is followed for size and times but stays marked; one without a regular file behind it is
    kept as not `readable`, which the comparison counts as seen.
    """
    files = entries.where(F.col("what") == "file").drop("what")
    dealt = files.repartition(_tasks(entries, tasks), "root_id", "rel_path")
    return dealt.mapInPandas(_stat_files, schemas.LISTING)


def skipped(entries: DataFrame) -> DataFrame:
    """What the walk left out, one row per entry: `root_id, rel_path, reason`."""
    return entries.where(F.col("what") != "file").select(
        "root_id", "rel_path", F.col("what").alias("reason")
    )


def _probe_roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(present=[os.path.isdir(path) for path in batch.path])


def probe(roots: DataFrame, now: int) -> DataFrame:
    """Roots with `present` as the executors see their folders now."""
    rest = [c for c in roots.columns if c not in ("present", "last_present_check")]
    seen = roots.select("root_id", "path").mapInPandas(
        _probe_roots, "root_id long, path string, present boolean"
    )
    checked = roots.select(*rest).join(seen.drop("path"), "root_id")
    return checked.withColumn("last_present_check", F.lit(now).cast("long"))
