"""Remote listings against quality profiles: what matches, what is owned, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions import names
from shelfmark.operators.duplicates import has_bytes
from shelfmark.operators.hot_keys import join_lookup
from shelfmark.session import cut

# ---- fixed values ---------------------------------------------------------------------------
ACTIVE_TASK_STATES = ("queued", "running", "paused")
# ---- end of fixed values --------------------------------------------------------------------


def remote_key() -> Column:
    return F.concat_ws("|", "provider", "repo", "revision", "filename")


def remote_facts(remote: DataFrame) -> DataFrame:
    """Adds what the file names of a remote listing say: `format`, `quant`, `publisher`.

    `remote` has `provider, repo, revision, filename, size, sha256`; a `publisher` column of its own
    is kept.
    """
    stem = names.stem("filename")
    extension = F.lower(F.regexp_extract("filename", r"\.([^./]+)\z", 1))
    named = remote.withColumns(
        {
            "format": F.when(extension.isin("gguf", "safetensors", "onnx"), extension)
            .when(extension.isin("pt", "pth", "bin"), "pytorch")
            .otherwise("unknown"),
            "quant": F.coalesce(names.quant_tag(stem), F.lit("unknown")),
        }
    )
    if "publisher" in remote.columns:
        return named
    return named.withColumn("publisher", F.coalesce(names.publisher(stem), F.lit("unknown")))


def _any_or_listed(values: str, value: str) -> Column:
    return (F.size(values) == 0) | F.array_contains(values, F.col(value))


def profile_match(
    monitors: DataFrame, profiles: DataFrame, identities: DataFrame, remote: DataFrame
) -> DataFrame:
    """Remote files each enabled monitor accepts, before a publisher is chosen.

    `identities` maps `family_key` to `provider, repo`. Monitors and profiles meet first; the remote
    listing, the only large table, is joined once. A monitor pinned to a variant of another family
    is rejected, and one pinned to a variant takes only its quantisation. A file of unknown size
    does not pass a size limit.
    """
    watched = (
        monitors.where(
            F.col("enabled")
            & (
                F.col("variant_family_key").isNull()
                | (F.col("variant_family_key") == F.col("family_key"))
            )
        )
        .join(profiles, "profile")
        .join(identities, "family_key")
    )
    excluded = F.exists("exclude_name", lambda part: F.contains(F.col("filename"), part))
    return (
        remote.join(watched, ["provider", "repo"])
        .where(
            _any_or_listed("formats", "format")
            & _any_or_listed("quants", "quant")
            & (F.col("max_bytes").isNull() | (F.col("size") <= F.col("max_bytes")))
            & ~excluded
            & (F.col("variant_quant").isNull() | (F.col("variant_quant") == F.col("quant")))
        )
        .select(
            "monitor_id", "family_key", "profile", "quants", "cutoff", "publishers",
            "provider", "repo", "revision", "filename", "size", "sha256", "quant", "publisher",
        )
    )


def choose_publisher(matches: DataFrame) -> DataFrame:
    """Files of the most preferred publisher that has any, per monitor; no preference keeps all.

    The best position is aggregated per monitor and joined back, so a monitor with very many files
    is not sorted in one task. The matches are used twice, so they are written once: the remote listing
    is not scanned and joined again.
    """
    matches = cut(matches)
    listed = F.array_position("publishers", F.col("publisher"))
    position = F.when(F.size("publishers") == 0, F.lit(0).cast("long")).when(listed > 0, listed)
    placed = matches.withColumn("position", position).where(F.col("position").isNotNull())
    best = placed.groupBy("monitor_id").agg(F.min("position").alias("best"))
    return (
        join_lookup(placed, best, ["monitor_id"], "inner")
        .where(F.col("position") == F.col("best"))
        .drop("position", "best")
    )


def owned_blobs(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Digests held by verified files and one root that holds each, a present one if there is any."""
    at = roots.select("root_id", F.coalesce("present", F.lit(False)).alias("present"))
    held = files.where(has_bytes()).groupBy("sha256", "root_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        held.join(at, "root_id", "left")
        .groupBy("sha256")
        .agg(F.min(F.struct(~F.coalesce("present", F.lit(False)), F.col("root_id"))).alias("best"))
        .select(
            "sha256",
            F.col("best.root_id").alias("local_root_id"),
            F.col("best.col1").alias("only_offline"),
        )
    )


def wanted_status(chosen: DataFrame, owned: DataFrame, local_variants: DataFrame) -> DataFrame:
    """Status of each chosen remote file, judged within its own revision.

    Owned bytes give `skipped_have_bytes` with the root; a local variant of the same family and
    revision that meets the cutoff gives `satisfied`; anything else is `open`. A quantisation meets
    the cutoff when it is the cutoff or stands after it in the profile's list.
    `local_variants` has `family_key, rev_label, quant`.
    """
    have = local_variants.select(
        "family_key", F.col("rev_label").alias("revision"), F.col("quant").alias("local_quant")
    ).distinct()
    at, cut_at = (
        F.array_position("quants", F.col(c)) for c in ("local_quant", "cutoff")
    )
    meets = (F.col("local_quant") == F.col("cutoff")) | ((cut_at > 0) & (at > cut_at))
    asked = chosen.groupBy("monitor_id", "family_key", "revision").agg(
        F.first("quants").alias("quants"), F.first("cutoff").alias("cutoff")
    )
    satisfied = (
        asked.join(have, ["family_key", "revision"])
        .where(meets)
        .select("monitor_id", "revision", F.lit(True).alias("cutoff_met"))
        .distinct()
    )
    judged = join_lookup(
        join_lookup(chosen, owned, ["sha256"]), satisfied, ["monitor_id", "revision"]
    )
    status = (
        F.when(F.col("local_root_id").isNotNull(), "skipped_have_bytes")
        .when(F.col("cutoff_met"), "satisfied")
        .otherwise("open")
    )
    return judged.select(
        "monitor_id", "family_key", "quant",
        remote_key().alias("remote_key"),
        "provider", "repo", "revision", "filename", "size", "sha256",
        status.alias("status"),
        "local_root_id",
        F.coalesce("only_offline", F.lit(False)).alias("only_offline"),
    )


def upsert_wanted(existing: DataFrame, swept: DataFrame, swept_at: int) -> DataFrame:
    """Wanted items after a sweep, one row per remote file; the newest sweep wins. Where one sweep judges
    a file for several monitors, owned bytes count first, then an open hole, then what is satisfied: a
    hole that one monitor has is not hidden by another that has none."""
    found = swept.withColumn("swept_at", F.lit(swept_at).cast("long"))
    names_ = schemas.WANTED.names
    values = [c for c in names_ if c != "remote_key"]
    rows = existing.select(*names_, F.lit(0).alias("age")).unionByName(
        found.select(*names_, F.lit(1).alias("age"))
    )
    rank = F.when(F.col("status") == "skipped_have_bytes", 3).when(F.col("status") == "open", 2)
    rank = rank.when(F.col("status") == "satisfied", 1).otherwise(0)
    newest = F.struct("swept_at", "age", rank, "status")
    return (
        rows.groupBy("remote_key")
        .agg(F.max_by(F.struct(*values), newest).alias("row"))
        .select("remote_key", "row.*")
    )


def owned_offline(wanted: DataFrame, roots: DataFrame) -> DataFrame:
    """Wanted items whose bytes are here, but only on a root that is away."""
    away = roots.where(~F.coalesce("present", F.lit(False))).select(
        F.col("root_id").alias("local_root_id"), F.col("name").alias("root")
    )
    return wanted.where(F.col("status") == "skipped_have_bytes").join(away, "local_root_id")


def fetch_eligibility(
    wanted: DataFrame,
    owned: DataFrame,
    tasks: DataFrame,
    destination: str = "filename",
    force: bool = False,
) -> DataFrame:
    """Which rules forbid fetching each wanted item (`failed`), and whether none does (`eligible`)."""
    path = F.col(destination)
    unsafe = (
        path.isNull()
        | (path == "")
        | path.rlike(r"\A[/\\]")
        | path.rlike(r"\A[A-Za-z]:")
        | path.rlike(r"(?:\A|[/\\])\.\.(?:[/\\]|\z)")
    )
    active = (
        tasks.where(F.col("state").isin(*ACTIVE_TASK_STATES))
        .select("remote_key", F.lit(True).alias("active"))
        .distinct()
    )
    have = owned.select("sha256", F.lit(True).alias("owned"))
    judged = join_lookup(wanted, have, ["sha256"]).join(
        active, "remote_key", "left"
    )
    rules = {
        "wanted.no_sha256": F.col("sha256").isNull(),
        "fetch.path_invalid": unsafe,
        "fetch.already_owned": F.coalesce("owned", F.lit(False)) & F.lit(not force),
        "fetch.task_active": F.coalesce("active", F.lit(False)),
    }
    failed = F.array_compact(F.array(*[F.when(c, code) for code, c in rules.items()]))
    return judged.select(
        "remote_key", destination, "sha256", "status", failed.alias("failed")
    ).withColumn("eligible", F.size("failed") == 0)
