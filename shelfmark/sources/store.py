"""Catalogue tables as Parquet snapshots.

A writer first claims a number, by a file that only one can create, so no two write into one folder. It
writes its tables, appends one row to the `snapshots` table, and publishes by a second such file, named
after the snapshot it started from: of two writers that started from the same one, only the first
publishes. Readers take the newest published row, so a job that dies half-way leaves the previous snapshot
in place, and a scan can read one snapshot while writing the next.

The row says which folders make up each table: a table that did not change keeps the folders it had; one
that only grows (evidence, scan runs) gets a folder with its new rows; and of one that is kept by root, the
roots that a scan did not reach keep theirs.
"""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shelfmark import FAMILY_KEY_ALGO, SCHEMA_VERSION, schemas

_LOG = (
    "snapshot long, schema_version string, family_key_algo string, written_at long, "
    "folders map<string,array<string>>, base long"
)
_NONE = -1  # base of the first snapshot


class SnapshotConflict(RuntimeError):
    """Another writer has published a snapshot since this one's was read."""


class CatalogueTables(dict):
    """Tables by name; `appended` has the new rows of those that only grow, `touched` the roots whose rows
    may have changed, of tables kept by root."""

    def __init__(
        self, *args, appended: dict[str, DataFrame] | None = None, touched: dict[str, list[int]] | None = None
    ):
        super().__init__(*args)
        self.appended = appended or {}
        self.touched = touched or {}

    def __setitem__(self, name: str, table: DataFrame) -> None:
        super().__setitem__(name, table)
        # a table put in place later is written as it is
        self.appended.pop(name, None)
        self.touched.pop(name, None)


class CatalogueStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        self._handed_out: tuple[int, dict[str, DataFrame]] | None = None

    def newest(self) -> int | None:
        """Number of the newest complete snapshot, or None for a new catalogue."""
        log = self._log()
        return None if log is None else log[0]

    def _log(self, snapshot: int | None = None) -> tuple[int, dict[str, list[str]]] | None:
        """Number and folders of the newest (or the given) snapshot."""
        try:
            log = self.spark.read.schema(_LOG).parquet(f"{self.base}/snapshots")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        if snapshot is not None:
            log = log.where(F.col("snapshot") == snapshot)
        log = log.where(F.col("base").isNull() | F.col("snapshot").isin(self._published()))
        row = log.agg(
            F.max("snapshot").alias("snapshot"),
            F.max_by(F.struct("schema_version", "family_key_algo"), "snapshot").alias("v"),
            F.max_by("folders", "snapshot").alias("folders"),
        ).first()
        if row.snapshot is not None and tuple(row.v) != (SCHEMA_VERSION, FAMILY_KEY_ALGO):
            raise ValueError(f"catalogue has versions {tuple(row.v)}; migrate it first")
        if row.snapshot is None:
            return None
        whole = {name: [f"snapshot={row.snapshot}/{name}"] for name in schemas.TABLES}
        return row.snapshot, whole | (row.folders or {})

    def read(self, snapshot: int | None = None) -> dict[str, DataFrame]:
        """All tables of a snapshot (the newest by default); empty tables for a new catalogue."""
        log = self._log(snapshot)
        if log is None:
            return {n: self.spark.createDataFrame([], s) for n, s in schemas.TABLES.items()}
        number, folders = log
        tables = {name: self._table(name, folders[name]) for name in schemas.TABLES}
        self._handed_out = (number, tables)
        return dict(tables)

    def _table(self, name: str, folders: list[str]) -> DataFrame:
        """A table from its folders; those of single roots are read below the folder they were written in."""
        schema, column = schemas.TABLES[name], schemas.PARTITIONED_BY.get(name)
        tops: dict[str, list[str]] = {}
        for folder in folders:
            top = folder.rsplit("/", 1)[0] if column and f"/{column}=" in folder else folder
            tops.setdefault(top if column else "", []).append(f"{self.base}/{folder}")
        parts = []
        for top, paths in tops.items():
            reader = self.spark.read.schema(schema)
            if column:
                reader = reader.option("basePath", f"{self.base}/{top}")
            parts.append(reader.parquet(*paths).select(*schema.names))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    # -- files that only one can create --

    def _where(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{path}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _create(self, path: str, text: str) -> bool:
        """Creates a file, unless it is there."""
        files, where = self._where(path)
        files.mkdirs(where.getParent())
        if files.getUri().getScheme() == "file":  # Hadoop's check and its creation are two steps there
            try:
                with open(where.toUri().getPath(), "x") as out:
                    out.write(text)
            except FileExistsError:
                return False
            return True
        try:
            out = files.create(where, False)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _listed(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        files, where = self._where(path)
        return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []

    def _published(self) -> list[int]:
        if not self._listed("published"):
            return []
        return [int(r.value) for r in self.spark.read.text(f"{self.base}/published").collect()]  # one a snapshot

    def _claim(self, base: int) -> int:
        """A number that no other writer has or had."""
        taken = [int(n) for n in self._listed("claims")]
        number = max([base, *taken]) + 1
        while not self._create(f"claims/{number}", ""):
            number += 1
        return number

    def _untouched(self, folders: list[str], column: str, touched: list[int]) -> list[str]:
        """Of a table kept by root, the folders of the roots that were not touched."""
        gone = {f"{column}={value}" for value in touched}
        each: list[str] = []
        for folder in folders:
            if f"/{column}=" in folder:
                each.append(folder)
            else:
                each += [f"{folder}/{name}" for name in self._listed(folder) if name.startswith(f"{column}=")]
        return [f for f in each if f.rsplit("/", 1)[1] not in gone]

    def write(self, tables: dict[str, DataFrame], written_at: int) -> int:
        """Publishes a new snapshot and returns its number.

        Tables that are not given, or are the ones read from the newest snapshot, keep their folders; of
        those in `tables.appended` (`CatalogueTables`) only the new rows are written, and of those in
        `tables.touched` only the rows of these roots, if the rest was read from the newest snapshot; all others
        are written whole. Raises `SnapshotConflict` if another writer has published since.
        """
        log = self._log()
        if self._handed_out and (log is None or log[0] != self._handed_out[0]):
            raise SnapshotConflict(f"read snapshot {self._handed_out[0]}, newest is {log and log[0]}")
        base = _NONE if log is None else log[0]
        number = self._claim(base)
        before = {} if log is None else log[1]
        handed_out = self._handed_out[1] if log and self._handed_out and self._handed_out[0] == log[0] else {}
        appended = getattr(tables, "appended", {}) if handed_out else {}
        touched = getattr(tables, "touched", {}) if handed_out else {}
        folders: dict[str, list[str]] = {}
        for name, schema in schemas.TABLES.items():
            table = tables.get(name)
            if name in before and (table is None or table is handed_out.get(name)):
                folders[name] = before[name]
                continue
            own = f"snapshot={number}/{name}"
            if name in appended and name in before:
                table, folders[name] = appended[name], [*before[name], own]
            else:
                folders[name] = [own]
            table = table.select(*schema.names)
            column = schemas.PARTITIONED_BY.get(name)
            if column and name in touched and name in before:
                table = table.where(F.col(column).isin(touched[name]))
                folders[name] = [*self._untouched(before[name], column, touched[name]), own]
            if column:
                # Even-sized files per value: a value that holds most rows gets several writers.
                writer = table.hint("rebalance", column).write.partitionBy(column)
            else:
                writer = table.hint("rebalance").write
            writer.mode("overwrite").parquet(f"{self.base}/{own}")
        log = self.spark.createDataFrame(
            [(number, SCHEMA_VERSION, FAMILY_KEY_ALGO, written_at, folders, base)], _LOG
        )
        log.coalesce(1).write.mode("append").parquet(f"{self.base}/snapshots")
        if not self._create(f"published/after={base}", str(number)):
            raise SnapshotConflict(f"another writer has published after snapshot {base}")
        self._handed_out = None
        return number


def difference(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows that differ between two snapshots of a table: `key, change, columns`.

    `change` is `added`, `removed` or `changed`; `columns` are the names of a changed row's columns that differ,
    in their order. `key` names at most one row of either side; null parts of a key are equal.
    """
    rest = [c for c in new.columns if c not in key]
    side = lambda df, name: df.select(
        *[F.struct(F.col(c)).alias(c) for c in key], F.struct(F.lit(1).alias("_"), *rest).alias(name)
    )
    both = side(old, "old").join(side(new, "new"), key, "full")
    differs = [F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in rest]
    columns = F.array_compact(F.array(*differs)) if rest else F.array().cast("array<string>")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.size("columns") > 0, "changed")
    return (
        both.withColumn("columns", columns).withColumn("change", change).where("change is not null")
        .select(*[F.col(c)[c].alias(c) for c in key], "change", F.when(F.col("change") == "changed", F.col("columns")).alias("columns"))
    )
