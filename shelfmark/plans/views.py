"""The test tables seen as catalogue inputs.

The test data holds no model files, so these views map its rows to listings, files, probes and
remote offers by integer arithmetic. Each view is one SQL text that Spark and DuckDB both read;
`sha_of(x)` and `epoch_of(t)` stand for the two functions that are spelled differently. Every view
covers its whole table, but for `v_prev` and `v_curr`: listings that are compared differ in their rows.
`v_prev_whole` and `v_curr_whole` have all rows of `orders`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_MODEL_NAME = """concat(replace(p_name, ' ', '-'), '-', CAST(p_size AS STRING), 'B',
    CASE p_partkey % 4 WHEN 0 THEN '-A3B' WHEN 1 THEN '-UD' ELSE '' END,
    CASE p_partkey % 6 WHEN 0 THEN '-Q4_K_M' WHEN 1 THEN '-Q5_K_M' WHEN 2 THEN '-q8_0'
                       WHEN 3 THEN '-IQ4_XS' WHEN 4 THEN '-BF16' ELSE '' END,
    CASE p_partkey % 7 WHEN 0 THEN '-bartowski' WHEN 1 THEN '-TheBloke' WHEN 2 THEN '-Instruct'
                       WHEN 3 THEN '-reranker' ELSE '' END,
    CASE WHEN p_partkey % 11 = 0 THEN '-00001-of-00002' WHEN p_partkey % 13 = 0 THEN '-mmproj'
         WHEN p_partkey % 19 = 0 THEN '-lora' ELSE '' END,
    CASE WHEN p_partkey % 3 = 0 THEN '.safetensors' ELSE '.gguf' END)"""

VIEWS = {
    "v_roots": """
SELECT CAST(r_regionkey AS BIGINT) AS root_id, lower(r_name) AS name,
  concat('/mnt/', lower(r_name)) AS path,
  CASE r_regionkey % 3 WHEN 0 THEN 'internal' WHEN 1 THEN 'nas' ELSE 'removable' END AS kind,
  'catalogue' AS mode, concat('uuid-', CAST(r_regionkey AS STRING)) AS mount_id,
  r_regionkey % 2 = 1 AS present, false AS cold, false AS writable,
  CAST(0 AS BIGINT) AS last_present_check, CAST(0 AS BIGINT) AS last_scan_at
FROM {region}""",
    "v_scan_roots": """
SELECT CAST(r_regionkey AS BIGINT) AS root_id, r_regionkey <> 2 AS present FROM {region}""",
    "v_files": f"""
SELECT CAST(p_partkey % 5 AS BIGINT) AS root_id,
  concat('p', CAST(p_partkey AS STRING), '/', {_MODEL_NAME}) AS rel_path,
  CAST(p_size AS BIGINT) * 1000 + p_partkey % 997 AS size,
  1700000000 + p_partkey % 100000 AS mtime, 1700000000 + p_partkey % 100000 AS ctime,
  CAST(0 AS BIGINT) AS dev, p_partkey % 1000 AS ino, false AS is_symlink,
  CAST(NULL AS STRING) AS symlink_target,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE sha_of(concat(p_name, '|', p_brand, '|', p_type)) END
    AS sha256,
  CASE WHEN p_partkey % 9 = 0 THEN 'none' ELSE 'full' END AS hash_state,
  CASE WHEN p_partkey % 17 = 0 THEN 'unsupported' ELSE 'ok' END AS parse_state,
  CASE WHEN p_partkey % 17 = 0 THEN 'unsupported' END AS parse_error,
  CASE WHEN p_partkey % 41 = 0 THEN 'missing' ELSE 'present' END AS state,
  CASE WHEN p_partkey % 3 = 0 THEN 'safetensors' ELSE 'gguf' END AS format,
  CASE WHEN p_partkey % 10 = 4 THEN concat(p_name, ' Chat') END AS general_name,
  CASE WHEN p_partkey % 10 = 3 THEN p_name END AS basename, CAST(NULL AS STRING) AS finetune,
  CASE WHEN p_partkey % 23 <> 0 AND p_partkey % 37 <> 0 THEN p_type END AS arch,
  CASE WHEN p_partkey % 29 <> 0 AND p_partkey % 37 <> 0 THEN CAST(p_size AS DOUBLE) END
    AS params_total,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) / CAST(16 AS DOUBLE) END AS params_active,
  CASE WHEN p_partkey % 8 = 0 THEN CAST(4096 AS BIGINT) END AS context_len,
  CASE WHEN p_partkey % 5 = 2 THEN CAST(p_size % 40 AS BIGINT) END AS file_type
FROM {{part}}""",
    "v_docs": """
SELECT CAST(doc_id % 5 AS BIGINT) AS root_id, concat('d', CAST(doc_id AS STRING)) AS rel_path,
  CAST(bytes_of(text) AS BIGINT) AS size, 1700000000 + doc_id AS mtime, CAST(0 AS BIGINT) AS dev,
  CAST(doc_id % 7 AS BIGINT) AS ino, false AS is_symlink,
  CASE WHEN doc_id % 19 = 0 THEN NULL ELSE sha_of(text) END AS sha256,
  CASE WHEN doc_id % 19 = 0 THEN 'none' ELSE 'full' END AS hash_state,
  CASE WHEN doc_id % 23 = 0 THEN 'missing' ELSE 'present' END AS state, 'ok' AS parse_state
FROM {documents}""",
    "v_prev_whole": """
SELECT CAST(o_orderkey % 5 AS BIGINT) AS root_id, concat('o', CAST(o_orderkey AS STRING)) AS rel_path,
  o_custkey * 100 + o_orderkey % 7 AS size, 1600000000 + o_orderkey AS mtime,
  1600000000 + o_orderkey AS ctime, CAST(0 AS BIGINT) AS dev, o_orderkey AS ino,
  false AS is_symlink, CAST(NULL AS STRING) AS symlink_target,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE sha_of(CAST(o_orderkey AS STRING)) END AS sha256,
  CASE WHEN o_orderkey % 31 = 0 THEN 'none' ELSE 'full' END AS hash_state, 'ok' AS parse_state,
  CAST(NULL AS STRING) AS parse_error,
  CASE WHEN o_orderkey % 31 = 0 THEN 'missing' ELSE 'present' END AS state
FROM {orders}""",
    "v_curr_whole": """
SELECT CAST(o_orderkey % 5 AS BIGINT) AS root_id, concat('o', CAST(o_orderkey AS STRING)) AS rel_path,
  o_custkey * 100 + o_orderkey % 7 + CASE WHEN o_orderkey % 30 = 3 THEN 1 ELSE 0 END AS size,
  1600000000 + o_orderkey + CASE WHEN o_orderkey % 10 = 2 THEN 1 ELSE 0 END AS mtime,
  1600000000 + o_orderkey AS ctime, CAST(0 AS BIGINT) AS dev, o_orderkey AS ino,
  o_orderkey % 47 = 0 AS is_symlink, CAST(NULL AS STRING) AS symlink_target,
  CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE sha_of(concat('n', CAST(o_orderkey % 900 AS STRING))) END
    AS sha256,
  CASE WHEN o_orderkey % 47 = 0 THEN 'none' ELSE 'full' END AS hash_state,
  CASE WHEN o_orderkey % 47 = 0 OR o_orderkey % 11 = 0 THEN 'unsupported' ELSE 'ok' END AS parse_state,
  CASE WHEN o_orderkey % 47 = 0 THEN 'symlink' WHEN o_orderkey % 11 = 0 THEN 'unsupported' END
    AS parse_error,
  'present' AS state, o_orderkey % 43 <> 0 AS readable
FROM {orders}""",
    "v_evidence": """
SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'variant' ELSE 'family' END AS subject_type,
  concat('u', CAST(user_id AS STRING)) AS subject_key, event_type AS field, props AS value,
  CASE event_id % 5 WHEN 0 THEN 'known' WHEN 1 THEN 'detected' WHEN 2 THEN 'inferred'
                    WHEN 3 THEN 'external' ELSE 'manual' END AS level,
  concat('s', CAST(event_id % 4 AS STRING)) AS source, epoch_of(ts) AS recorded_at
FROM {events}""",
    "v_probe": """
SELECT user_id AS root_id, epoch_of(ts) AS at, event_id AS seq,
  event_type IN ('error', 'view') AS failed
FROM {events}""",
    "v_provenance": """
SELECT CASE event_id % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'variant' ELSE 'family' END AS subject_type,
  concat('u', CAST(user_id AS STRING)) AS subject_key, event_type AS event, 'user' AS source_kind,
  CAST(NULL AS STRING) AS url, concat('r', CAST(event_id % 11 AS STRING)) AS repo,
  CAST(NULL AS STRING) AS author, CAST(NULL AS STRING) AS licence, CAST(NULL AS STRING) AS revision,
  epoch_of(ts) AS at, CAST(event_id AS STRING) AS checksum
FROM {events}""",
    "v_remote": """
SELECT 'hub' AS provider, concat('r', CAST(o_custkey AS STRING)) AS repo,
  concat('rev-', o_orderstatus) AS revision,
  concat('m', CAST(o_orderkey AS STRING), '-',
    CASE o_orderkey % 4 WHEN 0 THEN 'Q4_K_M' WHEN 1 THEN 'Q5_K_M' WHEN 2 THEN 'Q8_0' ELSE 'Q3_K_S' END,
    CASE o_orderkey % 3 WHEN 0 THEN '-bartowski' WHEN 1 THEN '-mradermacher' ELSE '' END,
    CASE WHEN o_orderkey % 5 = 0 THEN '.safetensors' ELSE '.gguf' END) AS filename,
  o_orderkey * 1000 AS size,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE sha_of(CAST(o_orderkey AS STRING)) END AS sha256
FROM {orders}""",
    "v_monitors": """
SELECT c_custkey AS monitor_id, concat('f', CAST(c_custkey AS STRING)) AS family_key,
  CASE c_custkey % 50 WHEN 7 THEN 'another' WHEN 8 THEN concat('f', CAST(c_custkey AS STRING)) END
    AS variant_family_key,
  CASE c_custkey % 50 WHEN 8 THEN 'Q5_K_M' END AS variant_quant,
  c_mktsegment AS profile, c_custkey % 10 <> 3 AS enabled
FROM {customer}""",
    "v_repos": """
SELECT concat('f', CAST(c_custkey AS STRING)) AS family_key, 'hub' AS provider,
  concat('r', CAST(c_custkey AS STRING)) AS repo
FROM {customer}""",
    "v_owned_files": """
SELECT CAST(o_orderkey % 5 AS BIGINT) AS root_id, concat('o', CAST(o_orderkey AS STRING)) AS rel_path,
  sha_of(CAST(o_orderkey AS STRING)) AS sha256,
  CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 9 = 0 THEN 'none' ELSE 'full' END AS hash_state
FROM {orders}""",
    "v_local_variants": """
SELECT concat(CASE WHEN o_orderkey % 6 = 1 THEN 'f' ELSE 'other' END, CAST(o_custkey AS STRING)) AS family_key,
  concat('rev-', o_orderstatus) AS rev_label,
  CASE o_orderkey % 4 WHEN 0 THEN 'Q4_K_M' WHEN 1 THEN 'Q5_K_M' WHEN 2 THEN 'Q8_0' ELSE 'Q3_K_S' END
    AS quant
FROM {orders}""",
    "v_tasks": """
SELECT concat('hub|r', CAST(o_custkey AS STRING), '|rev-', o_orderstatus, '|m',
    CAST(o_orderkey AS STRING), '-',
    CASE o_orderkey % 4 WHEN 0 THEN 'Q4_K_M' WHEN 1 THEN 'Q5_K_M' WHEN 2 THEN 'Q8_0' ELSE 'Q3_K_S' END,
    CASE o_orderkey % 3 WHEN 0 THEN '-bartowski' WHEN 1 THEN '-mradermacher' ELSE '' END,
    CASE WHEN o_orderkey % 5 = 0 THEN '.safetensors' ELSE '.gguf' END) AS remote_key,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'done' WHEN o_orderkey % 5 = 1 THEN 'queued'
       WHEN o_orderkey % 5 = 2 THEN 'running' ELSE 'done' END AS state
FROM {orders}""",
    "v_shards": """
SELECT CAST(o_orderkey % 5 AS BIGINT) AS root_id,
  concat('c', CAST(o_custkey AS STRING), '/model-', o_orderstatus, '-0000',
    CAST(1 + o_orderkey % 3 AS STRING), '-of-00003-', CAST(o_orderkey AS STRING), '.gguf') AS rel_path,
  o_custkey * 10 + o_orderkey % 10 AS size
FROM {orders}""",
    "v_trust": """
SELECT doc_id,
  CASE doc_id % 5 WHEN 0 THEN concat('blobs/sha256-', sha_of(text))
    WHEN 1 THEN concat('m/', CAST(doc_id AS STRING), '.gguf.part')
    WHEN 2 THEN concat('m/', CAST(doc_id AS STRING), '.CRDOWNLOAD')
    ELSE concat('m/', CAST(doc_id AS STRING), '.gguf') END AS rel_path
FROM {documents}""",
}

# The two listings that a scan compares: each lacks some rows of the other.
VIEWS["v_prev"] = VIEWS["v_prev_whole"] + " WHERE o_orderkey % 10 <> 0"
VIEWS["v_curr"] = VIEWS["v_curr_whole"] + " WHERE o_orderkey % 10 <> 1 AND o_orderkey % 5 <> 2"

_SPELLING = {
    "spark": {
        r"sha_of\(": "sha256_hex(",
        r"epoch_of\((\w+)\)": r"unix_timestamp(\1)",
        r"bytes_of\((\w+)\)": r"octet_length(\1)",
    },
    "duckdb": {
        r"sha_of\(": "sha256(",
        r"epoch_of\((\w+)\)": r"CAST(floor(epoch(\1)) AS BIGINT)",
        r"bytes_of\((\w+)\)": r"strlen(\1)",
    },
}


def _spelled(text: str, dialect: str) -> str:
    for pattern, replacement in _SPELLING[dialect].items():
        text = re.sub(pattern, replacement, text)
    return text


def _sha_with_length(text: str) -> str:
    """Spark's sha2 takes the length as its second argument: closes each `sha256_hex(` call."""
    while (start := text.find("sha256_hex(")) >= 0:
        at, depth = start + len("sha256_hex("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[at], 0)
            at += 1
        inner = text[start + len("sha256_hex(") : at - 1]
        text = f"{text[:start]}sha2({inner}, 256){text[at:]}"
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = _sha_with_length(_spelled(VIEWS[name], "spark"))
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def duckdb_view(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", _spelled(VIEWS[name], "duckdb"))
