"""Session settings the jobs rely on, and the shared folder of the cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Adaptive execution picks broadcast joins from measured sizes and splits the partition of a hot key.
# "force" keeps that split when the next step has to shuffle again because of it.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM does not compile methods beyond 8000 bytes; wide projections are split below that.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per session's context; it need not be installed there."""
    context = spark.sparkContext
    if getattr(context, "_shelfmark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="shelfmark-code-")) / "shelfmark.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._shelfmark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a local one in single-machine runs."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    existing = spark.sparkContext.getCheckpointDir()
    return existing if existing else _own_dir(spark)


def _own_dir(spark: SparkSession) -> str:
    path = tempfile.mkdtemp(prefix="shelfmark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)  # a folder of this single-machine run
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df):
    """Writes `df` to the checkpoint folder and continues from there, so that a lost executor does
    not re-run file reads and a loop does not grow its plan."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df):
    """`df` written as Parquet to the shared folder and read back: computed once however often it is used,
    without the old plan's partitioning, and of a size that Spark knows. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df, *keys):
    """`df` dealt by a hash of `keys` to as many tasks as a shuffle has, whatever number of tasks read it: a small
    file is read by one, however many rows it holds."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def size_in_bytes(df) -> int:
    """The size by which Spark decides on a broadcast; of a table just read, that of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
