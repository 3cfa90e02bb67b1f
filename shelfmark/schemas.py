"""Column lists of every catalogue table. All keys are natural keys; times are epoch seconds."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

_TYPES = {
    "long": LongType(),
    "double": DoubleType(),
    "string": StringType(),
    "boolean": BooleanType(),
    "strings": ArrayType(StringType()),
    "field": StructType([StructField(n, StringType()) for n in ("value", "level")]),
}


def table(columns: str) -> StructType:
    """Schema from a list like ``"root_id long, name string"``; needs no session, unlike DDL."""
    pairs = [column.split() for column in columns.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


ROOTS = table(
    "root_id long, name string, path string, kind string, mode string, mount_id string, "
    "present boolean, cold boolean, writable boolean, last_present_check long, last_scan_at long"
)
LISTING = table(
    "root_id long, root_path string, rel_path string, size long, mtime long, ctime long, dev long, "
    "ino long, is_symlink boolean, symlink_target string, readable boolean"
)
FILES = table(
    "root_id long, rel_path string, size long, mtime long, ctime long, dev long, ino long, "
    "is_symlink boolean, symlink_target string, sha256 string, hash_state string, "
    "parse_state string, parse_error string, state string"
)
BLOBS = table("sha256 string, size long, partial_digest string")
FAMILIES = table(
    "family_key string, name string, arch string, params_total double, params_active double, "
    "context_len long, kind string, first_root_id long, first_rel_path string, algo_version string"
)
REVISIONS = table("family_key string, rev_kind string, rev_label string")
VARIANTS = table(
    "family_key string, rev_label string, format string, quant string, subflavour string, "
    "publisher string, quant_raw string"
)
FILE_ROLES = table(
    "root_id long, rel_path string, role string, family_key string, rev_label string, "
    "format string, quant string, subflavour string, publisher string"
)
EVIDENCE = table(
    "seq long, subject_type string, subject_key string, field string, value string, "
    "level string, source string, recorded_at long"
)
DECLINED_MERGES = table(
    "family_a_key string, family_b_key string, algo_version string, declined_at long"
)
FAMILY_ALIASES = table("family_key string, alias string, source string")
SCAN_RUNS = table(
    "root_id long, started long, finished long, root_offline boolean, files_seen long, "
    "files_new long, files_changed long, files_gone long, files_unsupported long, "
    "files_unverified long, families_new long, duplicates long, skipped_symlink_dirs long, "
    "skipped_non_utf8 long, dirs_unreadable long, skipped_deep long, ok boolean"
)
PROVENANCE = table(
    "subject_type string, subject_key string, event string, source_kind string, url string, "
    "repo string, author string, licence string, revision string, at long, checksum string"
)
PROFILES = table(
    "profile string, formats strings, quants strings, publishers strings, "
    "exclude_name strings, cutoff string, max_bytes long"
)
MONITORS = table(
    "monitor_id long, family_key string, variant_family_key string, variant_quant string, "
    "profile string, enabled boolean"
)
WANTED = table(
    "remote_key string, provider string, repo string, revision string, filename string, "
    "size long, sha256 string, status string, local_root_id long, swept_at long"
)
ENRICHMENTS = table(
    "subject_type string, subject_key string, provider string, repo string, filename string, "
    "payload_json string, level string, fetched_at long"
)
FETCH_TASKS = table(
    "remote_key string, dest_root_id long, dest_rel_path string, bytes_done long, "
    "bytes_total long, state string, error string"
)
TAGS = table("tag string, entity_type string, entity_key string")

HEADER_FACTS = table(
    "format string, general_name string, basename string, finetune string, arch string, "
    "params_total double, params_active double, context_len long, file_type long, "
    "quant_from_header string, kind field, parse_error string"
)

# Key columns of a variant, in the order they appear in `VARIANTS`.
VARIANT_KEY = ["family_key", "rev_label", "format", "quant", "subflavour", "publisher"]

TABLES = {
    "roots": ROOTS,
    "files": FILES,
    "blobs": BLOBS,
    "families": FAMILIES,
    "revisions": REVISIONS,
    "variants": VARIANTS,
    "file_roles": FILE_ROLES,
    "evidence": EVIDENCE,
    "declined_merges": DECLINED_MERGES,
    "family_aliases": FAMILY_ALIASES,
    "provenance": PROVENANCE,
    "profiles": PROFILES,
    "monitors": MONITORS,
    "wanted": WANTED,
    "enrichments": ENRICHMENTS,
    "fetch_tasks": FETCH_TASKS,
    "tags": TAGS,
    "scan_runs": SCAN_RUNS,
}
# Column that spreads a table over directories; the others are written without partition columns.
PARTITIONED_BY = {"files": "root_id"}

# ---- fixed values ---------------------------------------------------------------------------
ROOT_KINDS = ("internal", "nas", "removable", "discovery", "fetch")
KINDS = ("llm", "vision", "audio", "embeddings", "rerank", "adapter", "diffusion", "unknown")
ROLES = ("weights", "shard", "tokenizer", "config", "mmproj", "lora", "sidecar")
FORMATS = ("gguf", "safetensors", "onnx", "pytorch", "mlx", "diffusers", "unknown")
LEVELS = ("known", "detected", "inferred", "external", "manual")
# ---- end of fixed values --------------------------------------------------------------------
