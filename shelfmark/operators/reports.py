"""Questions the catalogue answers: counts, family list, variants, inbox, storage, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions import names
from shelfmark.functions.identity import FILE_TYPE_QUANTS
from shelfmark.functions.names import QUANT_TAGS
from shelfmark.operators.duplicates import duplicate_groups, has_bytes
from shelfmark.operators.evidence import latest_evidence
from shelfmark.operators.hot_keys import join_lookup
from shelfmark.operators.reconcile import FILE_KEY


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def home_counts(
    families: DataFrame, evidence: DataFrame, files: DataFrame, roles: DataFrame
) -> DataFrame:
    """One row: families, families whose name is only guessed, bytes, unverified and unnamed files.

    Missing files count too, and a NULL hash state counts nowhere.
    """
    named = evidence.where(
        (F.col("subject_type") == "family")
        & (F.col("field") == "name")
        & F.col("level").isin("known", "manual")
    ).select(F.col("subject_key").alias("family_key"), F.lit(1).alias("is_named")).distinct()
    of_families = families.join(named, "family_key", "left").agg(
        F.count(F.lit(1)).alias("families"),
        F.count_if(F.col("is_named").isNull()).alias("families_inferred"),
        *[_long(0).alias(c) for c in ("bytes", "unverified_files", "unknown_files")],
    )
    of_files = files.join(
        roles.select(*FILE_KEY, F.lit(1).alias("has_role")), FILE_KEY, "left"
    ).agg(
        *[_long(0).alias(c) for c in ("families", "families_inferred")],
        F.coalesce(F.sum("size"), _long(0)).alias("bytes"),
        F.count_if(F.col("hash_state") != "full").alias("unverified_files"),
        F.count_if(
            F.col("has_role").isNull() & (F.col("parse_state") == "ok")
        ).alias("unknown_files"),
    )
    both = of_families.unionByName(of_files)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def root_counts(roots: DataFrame) -> DataFrame:
    return roots.agg(
        F.count(F.lit(1)).alias("roots"),
        F.count_if(F.col("present")).alias("present_roots"),
    )


def files_of_families(files: DataFrame, roles: DataFrame) -> DataFrame:
    """Files with the family they belong to, as weights or as a companion."""
    return roles.where(F.col("family_key").isNotNull()).join(
        files.select(*FILE_KEY, "size", "mtime"), FILE_KEY
    )


def family_list(
    families: DataFrame,
    variants: DataFrame,
    roles: DataFrame,
    files: DataFrame,
    roots: DataFrame,
    evidence: DataFrame,
) -> DataFrame:
    """One row per family with its bytes, quantisations and places, sorted by name.

    Sizes are first summed per family and root; what is gathered in lists afterwards are the
    distinct roots and the distinct quantisations of a family, never its files.
    """
    places = files_of_families(files, roles).groupBy("family_key", "root_id").agg(
        F.sum("size").alias("bytes")
    )
    named = roots.select(
        "root_id", F.struct("name", F.coalesce("present", F.lit(False)).alias("present")).alias("r")
    )
    held = (
        places.join(named, "root_id", "left")
        .groupBy("family_key")
        .agg(F.sum("bytes").alias("bytes"), F.sort_array(F.collect_set("r")).alias("roots"))
    )
    quants = variants.groupBy("family_key").agg(
        F.sort_array(F.collect_set("quant")).alias("quants")
    )
    levels = latest_evidence(
        evidence.where((F.col("subject_type") == "family") & (F.col("field") == "name"))
    ).select(F.col("subject_key").alias("family_key"), F.col("level").alias("name_level"))
    return (
        families.join(levels, "family_key", "left")
        .join(quants, "family_key", "left")
        .join(held, "family_key", "left")
        .select(
            "family_key",
            "name",
            "name_level",
            "kind",
            "params_total",
            "params_active",
            F.concat_ws(",", "quants").alias("quants"),
            F.coalesce("bytes", _long(0)).alias("bytes"),
            F.coalesce(
                "roots", F.array().cast("array<struct<name:string,present:boolean>>")
            ).alias("roots"),
        )
        .orderBy(F.coalesce("name", "family_key"), "family_key")
    )


def find_families(requests: DataFrame, families: DataFrame) -> DataFrame:
    """The family each request text means, by key or by name; of several the one stored first.

    Two equi joins, one per way of asking, instead of one join on either column.
    """
    order = F.struct("first_root_id", "first_rel_path", "family_key")
    known = families.select("family_key", "name", order.alias("at"))
    hits = (
        requests.join(known, F.col("request") == F.col("family_key"))
        .select("request", "family_key", "at")
        .unionByName(
            requests.join(known, F.col("request") == F.col("name")).select(
                "request", "family_key", "at"
            )
        )
    )
    first = hits.groupBy("request").agg(F.min_by("family_key", "at").alias("family_key"))
    return requests.join(first, "request", "left")


def variant_view(
    variants: DataFrame, roles: DataFrame, files: DataFrame, roots: DataFrame
) -> DataFrame:
    """Every variant with its bytes, one root, that root's presence and its newest file.

    Variants whose files are all gone stay, with 0 bytes and not present.
    """
    key = schemas.VARIANT_KEY
    held = (
        files_of_families(files, roles.where(F.col("rev_label").isNotNull()))
        .groupBy(*key)
        .agg(
            F.sum("size").alias("bytes"),
            F.min(F.struct(*FILE_KEY)).getField("root_id").alias("root_id"),
            F.max("mtime").alias("last_file_mtime"),
        )
    )
    names_of_roots = roots.select("root_id", F.col("name").alias("root"), "present")
    return (
        variants.join(held, key, "left")
        .join(names_of_roots, "root_id", "left")
        .select(
            *key,
            F.coalesce("bytes", _long(0)).alias("bytes"),
            F.coalesce("root", F.lit("")).alias("root"),
            F.coalesce("present", F.lit(False)).alias("present"),
            "last_file_mtime",
        )
        .orderBy("family_key", "quant", *key[1:3], *key[4:])
    )


def unknown_inbox(files: DataFrame, roles: DataFrame) -> DataFrame:
    """Hashed files that belong to no model yet."""
    return (
        files.where(F.col("sha256").isNotNull())
        .join(roles.select(*FILE_KEY), FILE_KEY, "left_anti")
        .select(*FILE_KEY, "size", "parse_state", "hash_state")
    )


def storage_by_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files, bytes and reclaimable bytes of each root; an absent root can free nothing now.

    Copies are counted within the root: `reclaimable` is what removing extra allocations of the same
    bytes on that root would free.
    """
    present = F.coalesce("present", F.lit(False))
    shown = files.where(F.col("state") == "present")
    totals = shown.groupBy("root_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )
    allocations = (
        shown.where(has_bytes())
        .dropna(subset=["dev", "ino"])
        .groupBy("root_id", "sha256", "dev", "ino")
        .agg(F.max("size").alias("size"))
    )
    spare = (
        allocations.groupBy("root_id", "sha256")
        .agg(((F.count(F.lit(1)) - 1) * F.max("size")).alias("spare"))
        .groupBy("root_id")
        .agg(F.sum("spare").alias("spare"))
    )
    return (
        roots.select("root_id", "name", present.alias("present"))
        .join(totals, "root_id", "left")
        .join(spare, "root_id", "left")
        .select(
            "root_id",
            "name",
            "present",
            F.coalesce("files", _long(0)).alias("files"),
            F.coalesce("bytes", _long(0)).alias("bytes"),
            F.when(F.col("present"), F.coalesce("spare", _long(0)))
            .otherwise(_long(0))
            .alias("reclaimable"),
        )
    )


def storage_rollup(files: DataFrame, roles: DataFrame) -> DataFrame:
    """Bytes by root and family, by root, and in total (`level` 0, 1, 2).

    `unique_bytes` counts each blob once at its level. Each level starts from rows that are already
    distinct by digest, so no level expands the file rows again.
    """
    family = roles.select(*FILE_KEY, "family_key")
    by_blob = (
        files.where(F.col("state") == "present")
        .join(family, FILE_KEY, "left")
        .groupBy("root_id", "family_key", "sha256")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("size").alias("bytes"),
            # Bytes without a digest are all counted.
            F.when(F.col("sha256").isNull(), F.sum("size"))
            .otherwise(F.max("size"))
            .alias("unique_bytes"),
        )
    )

    def step(rows: DataFrame, keep: list[str]) -> DataFrame:
        return rows.groupBy(*keep, "sha256").agg(
            F.sum("files").alias("files"),
            F.sum("bytes").alias("bytes"),
            F.when(F.col("sha256").isNull(), F.sum("unique_bytes"))
            .otherwise(F.max("unique_bytes"))
            .alias("unique_bytes"),
        )

    def level(rows: DataFrame, number: int, keys: list[str]) -> DataFrame:
        shown = {"root_id": "long", "family_key": "string"}
        sums = rows.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in ("files", "bytes", "unique_bytes")]
        )
        blank = [F.lit(None).cast(t).alias(c) for c, t in shown.items() if c not in keys]
        return sums.select(
            F.lit(number).alias("level"), *[F.col(k) for k in keys], *blank,
            "files", "bytes", "unique_bytes",
        )

    by_root = step(by_blob, ["root_id"])
    overall = step(by_root, [])
    return (
        level(by_blob, 0, ["root_id", "family_key"])
        .unionByName(level(by_root, 1, ["root_id"]))
        .unionByName(level(overall, 2, []))
    )


def search_tokens(
    families: DataFrame, aliases: DataFrame, tags: DataFrame, provenance: DataFrame
) -> DataFrame:
    """The words under which each family is found: name, alias, architecture, kind, tag and repo."""
    texts = (
        families.select("family_key", F.explode(F.array("name", "arch", "kind")).alias("text"))
        .unionByName(aliases.select("family_key", F.col("alias").alias("text")))
        .unionByName(
            tags.where(F.col("entity_type") == "family").select(
                F.col("entity_key").alias("family_key"), F.col("tag").alias("text")
            )
        )
        .unionByName(
            provenance.where(F.col("subject_type") == "family").select(
                F.col("subject_key").alias("family_key"), F.col("repo").alias("text")
            )
        )
    )
    words = F.explode(F.split(names.slug("text"), "-")).alias("token")
    return texts.select("family_key", words).where(F.col("token") != "").distinct()


def search(
    families: DataFrame,
    tokens: DataFrame,
    query: str = "",
    variants: DataFrame | None = None,
    quant: str | None = None,
    min_params: float | None = None,
    max_params: float | None = None,
    kind: str | None = None,
    chips: DataFrame | None = None,
    offline: bool | None = None,
    dups: bool | None = None,
    have_bytes: bool | None = None,
    source: str | None = None,
) -> DataFrame:
    """Families that hold every word of `query` and pass the given filters.

    The words of the query are cut by the same rule as the words of the families. `offline`, `dups`,
    `have_bytes` and `source` (a kind of root) ask the `family_chips`; a family without files has none of
    them and passes where the wanted value is false.
    """
    found = families
    cut_words = F.array_distinct(F.filter(F.split(names.slug(F.lit(query)), "-"), lambda w: w != ""))
    words = families.sparkSession.range(1).select(cut_words).first()[0]
    if words:
        hits = (
            tokens.where(F.col("token").isin(words))
            .groupBy("family_key")
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == len(words))
        )
        found = found.join(hits.select("family_key"), "family_key", "left_semi")
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    if min_params is not None:
        found = found.where(F.col("params_total") >= min_params)
    if max_params is not None:
        found = found.where(F.col("params_total") <= max_params)
    if quant is not None:
        having = variants.where(F.col("quant") == quant).select("family_key").distinct()
        found = found.join(having, "family_key", "left_semi")
    for chip, wanted in (("offline", offline), ("dups", dups), ("have_bytes", have_bytes)):
        if wanted is not None:
            marked = chips.where(F.col(chip)).select("family_key")
            found = found.join(marked, "family_key", "left_semi" if wanted else "left_anti")
    if source is not None:
        there = chips.where(F.array_contains(F.split("sources", ","), source)).select("family_key")
        found = found.join(there, "family_key", "left_semi")
    return found


def family_chips(files: DataFrame, roles: DataFrame, roots: DataFrame) -> DataFrame:
    """What the list filters ask of a family: any copy offline, any duplicate, all bytes verified,
    and the kinds of root it lies on (`source`)."""
    in_groups = duplicate_groups(files).select("sha256", F.lit(True).alias("duplicated"))
    at = roots.select("root_id", F.coalesce("present", F.lit(False)).alias("present"), "kind")
    rows = (
        roles.where(F.col("family_key").isNotNull())
        .select(*FILE_KEY, "family_key")
        .join(files.select(*FILE_KEY, "sha256", has_bytes().alias("verified")), FILE_KEY)
    )
    # One row per family, root and digest is all that meets the two lookups.
    small = rows.groupBy("family_key", "root_id", "sha256").agg(
        F.bool_and("verified").alias("verified")
    )
    shared = join_lookup(small, in_groups, ["sha256"])
    return (
        shared.join(at, "root_id", "left")
        .groupBy("family_key")
        .agg(
            F.bool_or(~F.coalesce("present", F.lit(False))).alias("offline"),
            F.bool_or(F.coalesce("duplicated", F.lit(False))).alias("dups"),
            F.bool_and("verified").alias("have_bytes"),
            F.concat_ws(",", F.sort_array(F.collect_set("kind"))).alias("sources"),
        )
    )


def shard_sets(files: DataFrame) -> DataFrame:
    """Models stored as numbered parts: one row per folder, base name and announced count."""
    stem = names.stem("rel_path")
    pattern = r"-([0-9]{1,5})-of-([0-9]{1,5})(?:-[^/]*)?\z"
    parts = (
        files.select(
            "root_id",
            F.regexp_extract("rel_path", r"\A(?:(.*)/)?[^/]*\z", 1).alias("dir"),
            stem.alias("stem"),
            "size",
        )
        .where(names.is_shard("stem"))
        .select(
            "root_id",
            "dir",
            names.unsharded("stem").alias("base"),
            F.regexp_extract("stem", pattern, 1).cast("long").alias("part"),
            F.regexp_extract("stem", pattern, 2).cast("long").alias("parts_announced"),
            "size",
        )
    )
    key = ["root_id", "dir", "base", "parts_announced"]
    by_part = parts.groupBy(*key, "part").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )
    inside = (F.col("part") >= 1) & (F.col("part") <= F.col("parts_announced"))
    return by_part.groupBy(*key).agg(
        F.count_if(inside).alias("parts_found"),
        F.sum("files").alias("files"),
        F.sum("bytes").alias("bytes"),
        (F.count_if(inside) == F.col("parts_announced")).alias("complete"),
    )


#: Every quantisation that a name or a header can give.
LADDER = tuple(dict.fromkeys((*QUANT_TAGS, *FILE_TYPE_QUANTS.values(), "unknown")))


def quant_ladder(
    variants: DataFrame,
    wanted: DataFrame | None = None,
    quants: Sequence[str] = LADDER,
) -> DataFrame:
    """One row per family, one column per quantisation: `have`, `wanted` (an open hole) or null.

    By default the columns are all quantisations that names and headers can give.

    `wanted` has `family_key`, `quant` and `status`.
    """
    steps = variants.select("family_key", "quant", F.lit("have").alias("step"))
    if wanted is not None:
        steps = steps.unionByName(
            wanted.where(F.col("status") == "open").select(
                "family_key", "quant", F.lit("wanted").alias("step")
            )
        )
    # "have" sorts before "wanted", so a quantisation that is there hides the hole.
    return steps.groupBy("family_key").pivot("quant", list(quants)).agg(F.min("step"))
