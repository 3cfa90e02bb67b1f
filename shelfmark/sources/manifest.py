"""Export and import of the catalogue as JSON lines: one row per catalogue row, by section."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import FAMILY_KEY_ALGO, schemas
from shelfmark.operators.duplicates import blob_refcount

FORMAT, FORMAT_VERSION = "shelfmark.export", 1
# Section -> columns that give its rows their order and identity.
SECTIONS = {
    "roots": ["root_id"],
    "families": ["family_key"],
    "blobs": ["sha256"],
    "family_aliases": ["alias"],
    "declined_merges": ["family_a_key", "family_b_key", "algo_version"],
    "files": ["root_id", "rel_path"],
    "revisions": ["family_key", "rev_kind", "rev_label"],
    "variants": schemas.VARIANT_KEY,
    "file_roles": ["root_id", "rel_path"],
    "evidence": ["seq", "subject_type", "subject_key", "field", "value"],
    "provenance": ["subject_type", "subject_key", "at", "event"],
    "profiles": ["profile"],
    "monitors": ["monitor_id"],
    "wanted": ["remote_key"],
    "tags": ["tag", "entity_type", "entity_key"],
}
REQUIRED = ("family_aliases", "declined_merges")


def _key_text(columns: list[str]) -> Column:
    """Key columns as one text."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def export_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """The manifest as rows `(section, key, payload)`; blobs carry their live reference count."""
    contents = dict(tables)
    if "blobs" in contents and "files" in contents:
        counts = blob_refcount(contents["blobs"], contents["files"]).select("sha256", "refcount")
        contents["blobs"] = contents["blobs"].join(counts, "sha256")
    parts = [
        contents[section].select(
            F.lit(section).alias("section"),
            _key_text(key).alias("key"),
            F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload"),
        )
        for section, key in SECTIONS.items()
        if section in contents
    ]
    return reduce(DataFrame.unionByName, parts)


def write_export(tables: dict[str, DataFrame], path: str, exported_at: int) -> None:
    """Writes the manifest: a `header` section with the versions, and one folder per section."""
    rows = export_rows(tables)
    head = rows.sparkSession.range(1).select(
        F.lit("header").alias("section"),
        F.lit("").alias("key"),
        F.to_json(
            F.struct(
                F.lit(FORMAT).alias("format"),
                F.lit(FORMAT_VERSION).alias("format_version"),
                F.lit(FAMILY_KEY_ALGO).alias("family_key_algo"),
                F.lit(exported_at).cast("long").alias("exported_at"),
                F.array(*[F.lit(s) for s in SECTIONS if s in tables]).alias("sections"),
            )
        ).alias("payload"),
    )
    # Sorted by range inside each section, so the written files are in the stated order.
    ordered = rows.unionByName(head).repartitionByRange("section", "key")
    ordered.sortWithinPartitions("section", "key").write.partitionBy("section").mode(
        "errorifexists"
    ).json(path)


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a manifest, or an error: `export.algo_mismatch` when its family keys follow another
    rule (their text must not be matched), `export.incomplete` when decisions are missing."""
    rows = spark.read.schema("section string, key string, payload string").json(path)
    header_type = (
        "format string, format_version int, family_key_algo string, sections array<string>"
    )
    header = rows.where(F.col("section") == "header").select(
        F.from_json("payload", header_type).alias("h")
    )
    found = [r.h for r in header.limit(2).collect()]
    if len(found) != 1 or found[0].format != FORMAT or found[0].format_version != FORMAT_VERSION:
        raise ValueError("export.incomplete: no readable header")
    if found[0].family_key_algo != FAMILY_KEY_ALGO:
        raise ValueError(f"export.algo_mismatch: {found[0].family_key_algo}")
    missing = [s for s in REQUIRED if s not in (found[0].sections or [])]
    if missing:
        raise ValueError(f"export.incomplete: {', '.join(missing)}")
    return {
        section: rows.where(F.col("section") == section)
        .select(F.from_json("payload", schemas.TABLES[section]).alias("row"))
        .select("row.*")
        for section in found[0].sections
        if section in SECTIONS
    }


def map_roots(imported: DataFrame, own: DataFrame) -> DataFrame:
    """Which own root each imported root is, by mount id alone (`root_id, own_root_id, problem`).

    A root without a mount id is never matched by its path (`root.no_mount_id`).
    """
    mounts = own.where(F.col("mount_id").isNotNull()).select(
        "mount_id", F.col("root_id").alias("own_root_id")
    )
    matched = imported.select("root_id", "mount_id").join(mounts, "mount_id", "left")
    problem = F.when(F.col("mount_id").isNull(), "root.no_mount_id").when(
        F.col("own_root_id").isNull(), "root.not_found"
    )
    return matched.select("root_id", "own_root_id", problem.alias("problem"))


def import_section(
    existing: DataFrame, imported: DataFrame, section: str, roots: DataFrame | None = None
) -> DataFrame:
    """`existing` with the imported rows put over it by natural key.

    Sections keyed by root need `roots` of `map_roots`; rows of unmatched roots are left out.
    """
    key = SECTIONS[section]
    names = existing.columns
    rows = imported
    if "root_id" in key:
        here = roots.where(F.col("own_root_id").isNotNull()).select("root_id", "own_root_id")
        rows = rows.join(here, "root_id").withColumn("root_id", F.col("own_root_id"))
    values = [c for c in names if c not in key]
    both = existing.select(*names, F.lit(0).alias("age")).unionByName(
        rows.select(*names, F.lit(1).alias("age"))
    )
    if not values:
        return both.select(*names).distinct()
    return (
        both.groupBy(*key)
        .agg(F.max_by(F.struct(*values), "age").alias("row"))
        .select(*key, "row.*")
        .select(*names)
    )
