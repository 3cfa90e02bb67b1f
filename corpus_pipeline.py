"""The corpus pipeline: good documents, one of each group of near copies, without benchmark leaks and
secrets, as byte-level BPE ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; what it returns is written as Parquet and
read again as the next one's docs. All but the last keep the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, decontaminate, quality, secrets, simhash
from shelfmark.llm.tables import quoted, read, ready, stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: all their columns, repeated rows and null ids too.
    A null text is scored as an empty one; equal texts fare alike; of no documents none are left."""
    ready(spark)
    machine = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, machine, docs.columns, into="_shelfmark_score")
    return scored.where(F.col("_shelfmark_score") >= quality.THRESHOLD).select(*map(quoted, docs.columns))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, with all its columns. Null, empty
    and wordless texts are one group; of rows equal in id and text any stays; of no documents none are left."""
    ready(spark)
    return simhash.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: all their columns, repeated rows and null ids too. Null and empty
    texts hold none and stay; without a benchmark all documents do."""
    ready(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with all their columns; reported secrets are masked, and n_chars follows (null for a null text).
    Equal texts are masked alike."""
    ready(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*map(quoted, docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (little-endian unsigned 32 bits), with digests of them and of what they decode to: a row for
    each row. A null text has no ids and the digests of nothing; columns beyond those of `documents` are left out."""
    ready(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN).select(
        "doc_id", "lang", "source", "n_chars",
        F.floor(F.length("ids") / 4).alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", good),
    ("simhash near-dedup", distinct),
    ("benchmark decontamination", uncontaminated),
    ("secret scan", without_secrets),
    ("byte-level bpe", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(ready(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
