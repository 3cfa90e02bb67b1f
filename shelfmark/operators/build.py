"""Catalogue tables from identified files: families, revisions, variants, roles.

`identified` is the result of `with_identity` plus `root_id`, `format`, `sha256` and `hash_state`,
one row per file that was parsed. Where several files describe the same thing, the first one by
`(root_id, rel_path)` wins, and rows stored earlier win over new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import FAMILY_KEY_ALGO, schemas
from shelfmark.functions.identity import COMPANION_ROLES, MODEL_ROLES
from shelfmark.operators.hot_keys import join_lookup
from shelfmark.operators.reconcile import FILE_KEY


def model_files(identified: DataFrame) -> DataFrame:
    """Files that define families and variants, with their revision label."""
    hashed = (F.col("hash_state") == "full") & F.col("sha256").isNotNull()
    label = F.when(hashed, F.concat(F.lit("local:"), F.col("sha256"))).otherwise("local:none")
    # Every file that is not unknown has a key; asking for the key itself would make the optimizer
    # compute it a second time inside the pushed-down filter.
    return identified.where(
        F.col("role").isin(*MODEL_ROLES) & ~F.col("is_unknown")
    ).withColumn("rev_label", label)


def _merge_first(existing: DataFrame | None, found: DataFrame, key: list[str]) -> DataFrame:
    """One row per key out of both tables; `found` carries its order in the struct `at`.

    Both tables meet in one aggregation, so there is one shuffle and no join, and the partial
    aggregation keeps a key that holds a large share of all files to one row per task.
    """
    values = [c for c in found.columns if c not in key and c != "at"]
    rows = found.select(*key, *values, F.struct(F.lit(1).alias("age"), "at").alias("at"))
    if existing is not None:
        no_order = F.lit(None).cast(found.schema["at"].dataType).alias("at")
        rows = rows.unionByName(
            existing.select(*key, *values, F.struct(F.lit(0).alias("age"), no_order).alias("at"))
        )
    if not values:
        return rows.select(*key).distinct()
    first = F.min_by(F.struct(*values), "at").alias("first")
    return rows.groupBy(*key).agg(first).select(*key, "first.*")


def _file_order() -> Column:
    return F.struct(*FILE_KEY).alias("at")


def build_families(identified: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    found = model_files(identified).select(
        "family_key",
        F.col("name.value").alias("name"),
        F.col("arch.value").alias("arch"),
        F.col("params_total.value").cast("double").alias("params_total"),
        F.col("params_active.value").cast("double").alias("params_active"),
        F.col("context_len.value").cast("long").alias("context_len"),
        F.col("kind.value").alias("kind"),
        F.col("root_id").alias("first_root_id"),
        F.col("rel_path").alias("first_rel_path"),
        F.lit(FAMILY_KEY_ALGO).alias("algo_version"),
        _file_order(),
    )
    return _merge_first(existing, found, ["family_key"])


def build_revisions(identified: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    found = model_files(identified).select(
        "family_key", F.lit("local").alias("rev_kind"), "rev_label", _file_order()
    )
    return _merge_first(existing, found, schemas.REVISIONS.names)


def build_variants(identified: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Distinct family, revision, format, quantisation, subflavour and publisher.

    A variant stays when its last file goes.
    """
    found = model_files(identified).select(
        "family_key",
        "rev_label",
        "format",
        F.col("quant.value").alias("quant"),
        F.col("subflavour.value").alias("subflavour"),
        F.col("publisher.value").alias("publisher"),
        F.col("quant_raw.value").alias("quant_raw"),
        _file_order(),
    )
    return _merge_first(existing, found, schemas.VARIANT_KEY)


def assign_roles(
    identified: DataFrame, families: DataFrame, previous: DataFrame | None = None
) -> DataFrame:
    """One role row per file.

    Weights and shards point to their variant, whose key is made of their own columns, so they need
    no join. A companion points to the family with its key if there is one. Files that have no
    identity now (unreadable, unsupported or unknown) keep their earlier row.
    """
    weights = model_files(identified).select(
        *FILE_KEY,
        "role",
        "family_key",
        "rev_label",
        "format",
        *[F.col(f"{c}.value").alias(c) for c in ("quant", "subflavour", "publisher")],
    )
    known = families.select("family_key", F.lit(True).alias("in_catalogue"))
    none = F.lit(None).cast("string")
    named = identified.where(F.col("role").isin(*COMPANION_ROLES)).select(
        *FILE_KEY, "role", "family_key"
    )
    companions = join_lookup(named, known, ["family_key"]).select(
        *FILE_KEY,
        "role",
        F.when(F.col("in_catalogue"), F.col("family_key")).alias("family_key"),
        *[none.alias(c) for c in schemas.VARIANT_KEY[1:]],
    )
    roles = weights.unionByName(companions)
    if previous is not None:
        kept = previous.join(roles.select(*FILE_KEY), FILE_KEY, "left_anti")
        roles = roles.unionByName(kept)
    return roles.select(*schemas.FILE_ROLES.names)


def variant_subject() -> Column:
    """The six key columns of a variant as one text, for use as an evidence subject."""
    return F.concat_ws("#", *schemas.VARIANT_KEY)
