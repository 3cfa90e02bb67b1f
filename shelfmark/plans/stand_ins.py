"""Model files made by Spark from the test tables: header bytes as a column, and a small file tree."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.plans.views import table
from shelfmark.session import shared_dir


def _le32(n: Column) -> Column:
    """Hex of a number below 2**31 as four little-endian bytes."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)])


def _le64(n: Column) -> Column:
    return F.concat(_le32(n), F.lit("00000000"))


def _text(s: Column) -> Column:
    return F.concat(_le64(F.octet_length(s)), F.hex(s.cast("binary")))


def gguf_hex(
    arch: Column, basename: Column, file_type: Column, context: Column, dims: list[Column],
    version: Column,
) -> Column:
    """Hex of a GGUF header with four key-value pairs and one tensor."""
    text_tag, number_tag = _le32(F.lit(8)), _le32(F.lit(4))
    return F.concat(
        F.lit("47475546"), _le32(version), _le64(F.lit(1)), _le64(F.lit(4)),
        _text(F.lit("general.architecture")), text_tag, _text(arch),
        _text(F.lit("general.basename")), text_tag, _text(basename),
        _text(F.lit("general.file_type")), number_tag, _le32(file_type),
        _text(F.concat(arch, F.lit(".context_length"))), number_tag, _le32(context),
        _text(F.lit("w")), _le32(F.lit(len(dims))), *[_le64(d) for d in dims],
        _le32(F.lit(0)), _le64(F.lit(0)),
    )


def gguf_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header per part: whole, of a wrong version, cut off, or not a model at all."""
    key, size = F.col("p_partkey"), F.col("p_size")
    version = F.when(key % 13 == 0, 9).otherwise(3)
    whole = gguf_hex(
        F.col("p_type"), F.col("p_name"), size % 40, size * 64, [size, F.lit(1000) + key % 7], version
    )
    kept = F.when(key % 17 == 0, F.substring(whole, F.lit(1), F.length(whole) - 8)).otherwise(whole)
    content = F.when(key % 19 == 0, F.hex(F.col("p_name").cast("binary"))).otherwise(kept)
    ending = F.when(key % 38 == 0, ".onnx").otherwise(".gguf")
    return table(spark, sf_dir, "part").select(
        key.alias("file_id"),
        F.concat(F.lit("m"), key.cast("string"), ending).alias("rel_path"),
        F.unhex(content).alias("content"),
    )


def safetensors_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header per part: with tensors, empty, or broken."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    arch = F.when(key % 3 == 0, F.lit('"QwenForCausalLM"')).when(
        key % 3 == 1, F.concat(F.lit('["'), F.col("p_type"), F.lit('VisionModel","x"]'))
    ).otherwise(F.lit("7"))
    full = F.concat(
        F.lit('{"__metadata__":{"architectures":'), arch,
        F.lit('},"w":{"dtype":"F32","shape":['), size, F.lit(',128],"data_offsets":[0,1]},'),
        F.lit('"b":{"dtype":"F32","shape":[]},"n":{"dtype":"F32"}}'),
    )
    text = F.when(key % 11 == 0, "{}").when(key % 13 == 0, '{"w":').otherwise(full)
    return table(spark, sf_dir, "part").select(
        key.alias("file_id"),
        F.concat(F.lit("m"), key.cast("string"), F.lit(".safetensors")).alias("rel_path"),
        F.unhex(F.concat(_text(text))).alias("content"),
    )


def _write_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch.path, batch.content):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            # A repeated task writes the same bytes again and swaps them in whole.
            draft = f"{path}.{uuid.uuid4().hex}~"
            with open(draft, "wb") as out:
                out.write(content)
            os.replace(draft, path)
        yield pd.DataFrame({"files": [len(batch)]})


def model_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per part; its size is the model's tensor shape."""
    models = table(spark, sf_dir, "part").withColumns(
        {"n": F.lit(1).cast("long"), "total": F.col("p_size").cast("long")}
    )
    brand = F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))
    header = gguf_hex(
        F.col("p_type"), F.col("p_name"), F.lit(15), F.lit(4096), [F.col("n"), F.col("total")], F.lit(3)
    )
    return models.select(
        F.concat(
            brand, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), "p_type",
            F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".gguf"),
        ).alias("rel_path"),
        F.unhex(header).alias("content"),
    )


def model_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the models as files into the shared folder; returns the root table (`root_id, path`)."""
    base = shared_dir(spark).removeprefix("file:")
    if "://" in base:
        raise RuntimeError("files are read with open(); spark.checkpoint.dir must be a mounted folder")
    root = os.path.join(base, f"models-{uuid.uuid4().hex}")
    os.makedirs(root, exist_ok=True)
    placed = model_contents(spark, sf_dir).select(
        F.concat(F.lit(root + "/"), "rel_path").alias("path"), "content"
    )
    placed.mapInPandas(_write_files, "files long").agg(F.sum("files")).first()
    return spark.range(1).select(F.lit(1).cast("long").alias("root_id"), F.lit(root).alias("path"))
