"""One scan: list the roots, read new facts, and derive the next snapshot of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions.identity import with_identity
from shelfmark.functions.names import digest_in_name, is_partial_download
from shelfmark.operators import build, duplicates, evidence, reconcile
from shelfmark.session import cut
from shelfmark.sources import contents, listing
from shelfmark.sources.store import CatalogueTables


def parse_state(examined: DataFrame) -> DataFrame:
    """Adds what the file table keeps about reading a file: `hash_state, parse_state, parse_error`.

    Unfinished downloads are `partial`; links are never read.
    """
    link = F.col("is_symlink")
    partial = is_partial_download("rel_path") & ~link
    error = F.when(link, "symlink").when(~partial, F.col("parse_error"))
    state = (
        F.when(partial, "partial").when(error.isNotNull(), "unsupported").otherwise("ok")
    )
    return examined.withColumns(
        {
            "hash_state": F.when(F.col("sha256").isNotNull(), "full").otherwise("none"),
            "parse_state": state,
            "parse_error": error,
            "state": F.lit("present"),
        }
    )


def trust_names(listed: DataFrame, blobs: DataFrame) -> DataFrame:
    """Adds `trusted_sha256`: the digest that a content-addressed store put into the name, if a blob
    with that digest is known and has the file's size. Such a file need not be read for its digest."""
    known = blobs.where(F.col("sha256").isNotNull()).select(
        F.col("sha256").alias("trusted_sha256"), F.col("size").alias("blob_size")
    ).distinct()
    named = F.when(F.col("readable") & ~F.col("is_symlink"), digest_in_name("rel_path"))
    found = listed.withColumn("named", named)
    same = (F.col("named") == F.col("trusted_sha256")) & (F.col("size") == F.col("blob_size"))
    return found.join(known, same, "left").drop("named", "blob_size")


def known_contents(catalogue: dict[str, DataFrame], roots: DataFrame) -> DataFrame:
    """`size, partial_digest` of what a file may be a copy of without being listed beside it: stored blobs, and
    files without a digest on roots that are away (`roots` says which are present)."""
    away = roots.where(~F.col("present")).select("root_id")
    unread = catalogue["files"].where("sha256 is null and state = 'present' and not is_symlink")
    return (
        catalogue["blobs"].select("size", "partial_digest")
        .unionByName(unread.join(away, "root_id", "left_semi").select("size", F.lit(None).cast("string").alias("partial_digest")))
        .distinct()
    )


def staged_digests(listed: DataFrame, known: DataFrame, tasks: int | None = None) -> DataFrame:
    """Digests in three passes, each of which reads only what the one before left open: `root_id, rel_path, stage,
    partial_digest, sha256, needs_hash, bytes_read`, a row for each row of `listed` (with `needs_hash`).

    By size: a file whose size nothing else has is closed unread. By edges: at most 128 KiB are read; a file
    whose partial digest nothing of its size has is closed, and one of at most 128 KiB has its digest by now.
    What is left has `needs_hash`: it must be read whole (by `examine_files`). `bytes_read` includes that.
    """
    key = ["root_id", "rel_path"]
    sized = cut(duplicates.open_after_size(listed.select(*listed.columns), known))
    edges = cut(contents.edge_digests(sized.where("open"), tasks))
    met = sized.select(*key, "size", "open").join(edges, key, "left")
    left = duplicates.open_after_edges(met.where("open"), known).select(*key, F.col("open").alias("still_open"))
    full = F.coalesce(F.col("still_open"), F.lit(False)) & F.col("sha256").isNull()
    stage = F.when(full, "full").when(F.col("open"), "edges").otherwise("size")
    return cut(
        met.join(left, key, "left").withColumn("needs_hash", full).select(
            *key, stage.alias("stage"), "partial_digest", "sha256", "needs_hash",
            (F.coalesce("bytes_read", F.lit(0)) + F.when(full, F.col("size")).otherwise(F.lit(0))).alias("bytes_read"),
        )
    )


def scan(
    catalogue: dict[str, DataFrame],
    scan_seq: int,
    now: int,
    quick: bool = False,
    trust_digest_names: bool = False,
    active_key: str = "",
    max_depth: int | None = None,
    tasks: int | None = None,
    gate: bool = False,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The next snapshot's tables and the scan report.

    Roots are probed first; the files of a root that is away keep their rows. `scan_seq` numbers the
    scans of a catalogue. A full scan reads every file again, since equal stats do not prove equal
    bytes. With `gate` it reads digests in stages (`staged_digests`): whole files only where copies are
    possible, so the same copies are found, but other files get no digest. The file pass is checkpointed: everything after it is joins and aggregations that may be
    repeated when an executor is lost, without reading a file twice.
    """
    roots = cut(listing.probe(catalogue["roots"], now))
    entries = listing.walk(roots.where("present").select("root_id", "path"), max_depth, tasks)
    listed = reconcile.needs_hash(cut(listing.list_files(entries, tasks)), quick)
    if trust_digest_names:
        listed = cut(trust_names(listed, catalogue["blobs"]))
        listed = listed.withColumn("needs_hash", F.col("needs_hash") & F.col("trusted_sha256").isNull())
    key = ["root_id", "rel_path"]
    if gate and not quick:
        staged = staged_digests(listed, known_contents(catalogue, roots), tasks)
        listed = listed.drop("needs_hash").join(staged.select(*key, "needs_hash"), key)
    examined = contents.examine_files(listed, active_key=active_key, tasks=tasks)
    if gate and not quick:
        edges = staged.select(*key, F.col("sha256").alias("edge_sha256"), F.col("partial_digest").alias("edge_digest"))
        examined = examined.join(edges, key, "left").withColumns(
            {"sha256": F.coalesce("sha256", "edge_sha256"), "partial_digest": F.coalesce("partial_digest", "edge_digest")}
        ).drop("edge_sha256", "edge_digest")
    if trust_digest_names:
        trusted = listed.where("trusted_sha256 is not null").select(*key, "trusted_sha256")
        examined = examined.join(trusted, key, "left").withColumn("sha256", F.coalesce("sha256", "trusted_sha256"))
        examined = examined.drop("trusted_sha256")
    current = cut(parse_state(examined))

    # roots that are away keep their rows, and in a stored catalogue their folders
    reached = [r.root_id for r in roots.where("present").select("root_id").distinct().collect()]
    before = catalogue["files"].where(F.col("root_id").isin(reached))
    away = catalogue["files"].where(F.col("root_id").isNull() | ~F.col("root_id").isin(reached))
    changes = cut(reconcile.compare_listings(before, current, roots))
    files = reconcile.next_files(changes).unionByName(away.select(*schemas.FILES.names))
    found = current.where("readable").select(
        "sha256", "size", "partial_digest", F.lit(scan_seq).alias("seq")
    )
    blobs = reconcile.upsert_blobs(catalogue["blobs"], found)

    parsed = current.where(F.col("readable") & (F.col("parse_state") == "ok"))
    identified = cut(with_identity(parsed))
    families = build.build_families(identified, catalogue["families"])
    revisions = build.build_revisions(identified, catalogue["revisions"])
    variants = build.build_variants(identified, catalogue["variants"])
    earlier = reconcile.drop_roles_of_missing(catalogue["file_roles"], files)
    roles = build.assign_roles(identified, families, earlier)
    facts = evidence.evidence_rows(identified)
    log = evidence.append_evidence(facts, catalogue["evidence"], scan_seq, now)

    fresh = families.join(catalogue["families"].select("family_key"), "family_key", "left_anti")
    report = reconcile.scan_report(
        changes,
        roots,
        listing.skipped(entries),
        fresh.select(F.col("first_root_id").alias("root_id")),
    )
    scanned_at = F.when(F.col("present"), F.lit(now).cast("long")).otherwise(F.col("last_scan_at"))
    runs = reconcile.scan_runs_rows(report, now, now)
    tables = CatalogueTables(
        catalogue, appended={"evidence": log, "scan_runs": runs}, touched={"files": reached}
    )
    tables.update(
        roots=roots.withColumn("last_scan_at", scanned_at).select(*schemas.ROOTS.names),
        files=files,
        blobs=blobs.select(*schemas.BLOBS.names),
        families=families.select(*schemas.FAMILIES.names),
        revisions=revisions.select(*schemas.REVISIONS.names),
        variants=variants.select(*schemas.VARIANTS.names),
        file_roles=roles,
        evidence=catalogue["evidence"].unionByName(log),
        scan_runs=catalogue["scan_runs"].unionByName(runs),
    )
    return tables, report


def identify_files(paths: DataFrame, active_key: str = "", tasks: int | None = None) -> DataFrame:
    """What is in each file of a listing: format, error, role, name, key, quantisation, digests."""
    examined = parse_state(contents.examine_files(paths, active_key=active_key, tasks=tasks))
    identified = with_identity(examined)
    return identified.select(
        "root_id", "rel_path", "size", "format", "parse_error", "role", "name", "arch", "kind",
        "quant", "params_total", "params_active", "context_len", "publisher", "subflavour",
        "is_unknown", "family_key", "sha256", "partial_digest",
    )
