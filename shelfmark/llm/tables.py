"""Shared helpers of the operators: written intermediate tables, text settings, sorted runs."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from shelfmark.session import shared_dir, tune

#: Rows of one Arrow batch where a row holds a whole text; keeps a batch at some tens of MB.
TEXT_ROWS = 500


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the library, and small Arrow batches, since rows hold whole texts."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: cuts lineage, is shared by later
    steps, and gives Spark the true size. The folder is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_kept: dict = {}  # of a Python worker: what its last operator keeps from task to task


def kept_in_worker(key, make):
    """What `make()` gives, made once in a worker and kept for later tasks with that key; tasks of
    another operator drop it."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def give_back(keep: bool = False) -> None:
    """Called at the end of a task: a worker lives on, and what it no longer needs would stay with it,
    beside the executor's own memory."""
    if not keep:
        _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def tidy(run):
    """`run`, a function of batches, with `give_back` when it has ended."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def sorted_chunks(
    batches: Iterable[pa.RecordBatch], keys: list[str], rows: int
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cuts the sorted rows of a partition into chunks of about `rows` rows that never part the rows
    of one key; with each chunk come the positions at which a key begins."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(table, keys)
        last = int(starts[-1])
        if last == 0:
            held = table.to_batches()
            continue
        yield table.slice(0, last), starts[:-1]
        rest = table.slice(last)
        held, count = rest.to_batches(), rest.num_rows
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _starts(table, keys)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def smallest_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For n nodes and undirected edges: the smallest node that each node reaches."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def quoted(name: str) -> str:
    """A column's name, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def mapped(
    df: DataFrame, column: str | Column, kept: list[str], made: list[tuple[str, str]], make, keep: bool = False
) -> DataFrame:
    """`kept` columns of `df` and `made` (name, type) ones, which `make()(values of column)` returns as
    Arrow arrays, batch by batch. Kept columns of a made name are replaced. With `keep`, what the worker
    has from `kept_in_worker` stays for the next task."""
    kept = [c for c in kept if c not in {name for name, _ in made}]
    names = [*kept, *(name for name, _ in made)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for batch in batches:
            one = one or make()
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *one(batch.column(0).to_pylist())], names=names)
        give_back(keep)

    source = df[quoted(column)] if isinstance(column, str) else column
    # numbered names inside: mapInArrow can't take every name
    frame = df.select(source.alias("c"), *[df[quoted(c)].alias(f"c{i}") for i, c in enumerate(kept)])
    kinds = [f"{quoted(c)} {f.dataType.simpleString()}" for c, f in zip(kept, frame.schema[1:])]
    return frame.mapInArrow(run, ", ".join([*kinds, *(f"{quoted(name)} {kind}" for name, kind in made)]))
