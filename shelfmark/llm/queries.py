"""The operators as queries over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import bpe, decontaminate, langid, lm, pages, phrases, pivots, quality, rules, secrets, simhash, urls, whitening
from shelfmark.llm.tables import read, ready

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(ready(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


@query
def op1_latent_leaks(spark, sf):
    found = decontaminate.leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.drop("text_hash")


@query
def op2_main_text(spark, sf):
    return pages.main_text(read(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op3_byte_bpe(spark, sf):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(read(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op4_url_rules(spark, sf):
    return urls.judge(read(spark, sf, "pages"))


@query
def op5_cross_entropy(spark, sf):
    return lm.scored(read(spark, sf, "documents"), lm.good_ids(read(spark, sf, "labels")))


@query
def op6_byte_language(spark, sf):
    return langid.judged(read(spark, sf, "documents"))


@query
def op7_pivot_dedup(spark, sf):
    return pivots.near_duplicates(read(spark, sf, "embeddings"))


ORACLE["op7_pivot_dedup"] = pivots.ORACLE_SQL


@query
def op8_simhash_dedup(spark, sf):
    return simhash.near_duplicates(read(spark, sf, "documents"))


@query
def op9_secret_scan(spark, sf):
    return secrets.scan(read(spark, sf, "documents"))


@query
def op10_quality(spark, sf):
    return quality.judged(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query
def op11_quality_rules(spark, sf):
    return rules.judged(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query
def op12_collocations(spark, sf):
    return phrases.collocations(read(spark, sf, "documents"))


ORACLE["op12_collocations"] = phrases.ORACLE_SQL


@query
def op13_whitening(spark, sf):
    return whitening.whitened(read(spark, sf, "embeddings"))
