"""The append-only evidence log, and what readers derive from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions.identity import COMPANION_ROLES, level_source, round1
from shelfmark.operators.build import model_files
from shelfmark.operators.hot_keys import join_lookup
from shelfmark.operators.reconcile import FILE_KEY
from shelfmark.session import spread, written

SUBJECT = ["subject_type", "subject_key", "field"]
_FACT = [*SUBJECT, "value", "level", "source"]
# Which level wins when all evidence for a field is weighed, best first.
LEVEL_RANK = ("manual", "known", "detected", "inferred", "external")


def _fact(kind: str, subject: Column, field: str, value: Column, level: Column, source: Column):
    return F.struct(
        F.lit(kind).alias("subject_type"),
        subject.alias("subject_key"),
        F.lit(field).alias("field"),
        value.alias("value"),
        level.alias("level"),
        source.alias("source"),
    )


def evidence_rows(identified: DataFrame) -> DataFrame:
    """The distinct facts the identified files give, and the last file that gave each (`last_at`).

    A file gives up to seven facts, and a task sorts all of its files' facts before they meet those of others.
    So the files are dealt out first: a task's share does not depend on how many tasks read them.
    """
    known, content, by_name = F.lit("known"), F.lit("content"), F.lit("filename")
    family = F.col("family_key")
    variant = F.concat_ws(
        "#", "family_key", "rev_label", "format", "quant.value", "subflavour.value",
        "publisher.value",
    )
    name_source = level_source(F.col("name.level"))
    described = (
        F.col("arch").isNotNull()
        | F.col("params_total").isNotNull()
        | F.col("context_len").isNotNull()
    )
    total = round1(F.col("params_total.value").cast("double"))
    model_facts = F.array(
        _fact("family", family, "name", F.when(described, F.col("name.value")),
              F.col("name.level"), name_source),
        _fact("family", family, "arch", F.col("arch.value"), known, content),
        _fact("family", family, "params_total", total, known, content),
        _fact("family", family, "kind", F.col("kind.value"), F.col("kind.level"), name_source),
        _fact("variant", variant, "quant", F.col("quant.value"), F.col("quant.level"),
              level_source(F.col("quant.level"))),
        _fact("variant", variant, "publisher", F.col("publisher.value"),
              F.col("publisher.level"), by_name),
        _fact("variant", variant, "subflavour", F.col("subflavour.value"),
              F.col("subflavour.level"), by_name),
    )
    of_models = spread(model_files(identified), *FILE_KEY).select(*FILE_KEY, F.inline(model_facts))
    file_subject = F.concat_ws(":", F.col("root_id").cast("string"), "rel_path")
    of_companions = identified.where(F.col("role").isin(*COMPANION_ROLES)).select(
        *FILE_KEY,
        F.inline(
            F.array(
                _fact("file", file_subject, "role", F.col("role"), F.lit("inferred"), by_name)
            )
        ),
    )
    return (
        of_models.unionByName(of_companions)
        .where(F.col("value") != "")
        .groupBy(*_FACT)
        .agg(F.max(F.struct(*FILE_KEY)).alias("last_at"))
    )


def append_evidence(
    found: DataFrame, existing: DataFrame, scan_seq: int, recorded_at: int
) -> DataFrame:
    """Rows to append for one scan: facts never logged before, and the newest one of a field when
    it differs from the newest one logged.

    `scan_seq` grows with every scan. The facts of one field in one scan are numbered below it; they
    are distinct values of one field, so their number does not grow with the number of files.
    """
    of_field = Window.partitionBy(*SUBJECT)
    newest_first = of_field.orderBy(F.col("last_at").desc(), F.col("value").desc())
    history = existing.select(*_FACT).distinct().withColumn("logged", F.lit(True))
    newest = latest_evidence(existing).select(
        *SUBJECT, F.struct("value", "level", "source").alias("newest_logged")
    )
    numbered = found.withColumn("back", F.row_number().over(newest_first))
    compared = numbered.join(history, _FACT, "left").join(newest, SUBJECT, "left")
    is_newest = F.col("back") == 1
    differs = is_newest & ~F.col("newest_logged").eqNullSafe(F.struct("value", "level", "source"))
    compared = compared.withColumn("fresh", F.col("logged").isNull())
    field_moves = F.max((F.col("fresh") | differs).cast("int")).over(of_field) == 1
    kept = compared.withColumn("moves", field_moves).where(
        F.col("fresh") | (is_newest & F.col("moves"))
    )
    block = F.lit(scan_seq).cast("long") * F.lit(2**32) - F.col("back")
    return kept.withColumns(
        {"seq": block, "recorded_at": F.lit(recorded_at).cast("long")}
    ).select(*schemas.EVIDENCE.names)


def latest_evidence(evidence: DataFrame) -> DataFrame:
    """The newest row of each subject and field, by partial aggregation instead of a window."""
    rest = [c for c in evidence.columns if c not in SUBJECT]
    return (
        evidence.groupBy(*SUBJECT)
        .agg(F.max_by(F.struct(*rest), "seq").alias("newest"))
        .select(*SUBJECT, "newest.*")
    )


def resolve_truth(evidence: DataFrame) -> DataFrame:
    """The value that counts for each subject and field: best level first, newest within a level.

    External facts therefore never override what is known, detected or inferred locally.
    """
    ranks = F.array(*[F.lit(level) for level in LEVEL_RANK])
    position = F.array_position(ranks, F.col("level"))
    rank = F.when(position > 0, position).otherwise(len(LEVEL_RANK) + 1)
    rest = ["value", "level", "source", "seq"]
    return (
        evidence.groupBy(*SUBJECT)
        .agg(F.min_by(F.struct(*rest), F.struct(rank, -F.col("seq"))).alias("best"))
        .select(*SUBJECT, "best.*")
    )


def provenance_timeline(provenance: DataFrame) -> DataFrame:
    """All events, subject by subject in time order.

    A range sort over subject and time spreads one subject with many events over several tasks.
    """
    return provenance.orderBy("subject_type", "subject_key", "at", "event")


def presence_with_patience(probes: DataFrame, patience: int = 3) -> DataFrame:
    """Present or absent for each root: absent only after `patience` failed probes in a row.

    `probes` has `root_id`, `at`, `seq` and `failed`. The last success is found by aggregation and
    the failures after it are counted, so no root's probe log is sorted in one task.
    """
    order = F.struct("at", "seq")
    stats = probes.groupBy("root_id").agg(
        F.count(F.lit(1)).alias("probes"),
        F.max(F.when(~F.col("failed"), order)).alias("last_ok"),
    )
    failed = probes.where("failed")
    failures = (
        join_lookup(failed, stats.select("root_id", "last_ok"), ["root_id"])
        .where(F.col("last_ok").isNull() | (order > F.col("last_ok")))
        .groupBy("root_id")
        .agg(F.count(F.lit(1)).alias("failures"))
    )
    in_a_row = F.coalesce("failures", F.lit(0).cast("long"))
    return stats.join(failures, "root_id", "left").select(
        "root_id",
        "probes",
        in_a_row.alias("failures_in_a_row"),
        F.col("last_ok.at").alias("last_ok_at"),
        (in_a_row < patience).alias("present"),
    )


def presence_states(probes: DataFrame, patience: int = 3, blocks: int | None = None) -> DataFrame:
    """The state after every probe: `root_id, at, seq, failed, failures_in_a_row, present, changed`.

    A root counts as present until `patience` probes in a row have failed, and again with the next success.
    The log is sorted into `blocks` by root and time, so a root with very many probes lies in many blocks. Each
    block counts from its own last success; a summary of one row per block and root gives what is carried
    into a block by those before it (rows since the last success there). Only summaries meet in a window
    over a whole root, and they are no more than the blocks.
    """
    count = blocks or int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["root_id", "at", "seq"]
    # written, since another run of the sort may cut the log elsewhere
    log = written(
        probes.select(*order, "failed").repartitionByRange(count, *order).withColumn("block", F.spark_partition_id())
    )
    here = Window.partitionBy("block", "root_id").orderBy("at", "seq")
    counted = log.withColumn("place", F.row_number().over(here)).withColumn(
        "last_ok", F.last(F.when(~F.col("failed"), F.col("place")), ignorenulls=True).over(here)
    )
    summary = (
        log.groupBy("block", "root_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.when(~F.col("failed"), F.struct("at", "seq"))).alias("ok"))
    )
    after_ok = (
        log.join(summary.where("ok is not null").select("block", "root_id", "ok"), ["block", "root_id"])
        .where(F.struct("at", "seq") > F.col("ok"))
        .groupBy("block", "root_id").agg(F.count(F.lit(1)).alias("trailing"))
    )
    earlier = Window.partitionBy("root_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy("root_id").orderBy("block")
    # the number of the root's last success among all its rows, as far as earlier blocks go
    reset = F.when(F.col("ok").isNotNull(), F.col("upto") - F.coalesce("trailing", F.lit(0)))
    carried = (
        summary.join(after_ok, ["block", "root_id"], "left")
        .withColumn("upto", F.sum("n").over(through))
        .withColumn("reset", reset)
        .select(
            "block", "root_id",
            (F.coalesce(F.sum("n").over(earlier), F.lit(0))
             - F.coalesce(F.last("reset", ignorenulls=True).over(earlier), F.lit(0))).alias("carry"),
        )
    )
    run = F.col("place") - F.coalesce("last_ok", F.lit(0))
    in_a_row = run + F.when(F.col("last_ok").isNull(), F.col("carry")).otherwise(F.lit(0))
    before = F.lag("failures_in_a_row").over(here)
    present = F.col("failures_in_a_row") < patience
    return (
        counted.join(carried, ["block", "root_id"])
        .withColumn("failures_in_a_row", in_a_row.cast("long"))
        .withColumn("present", present)
        .withColumn("changed", F.col("present") != (F.coalesce(before, F.col("carry")) < patience))
        .select(*order, "failed", "failures_in_a_row", "present", "changed")
    )


def enrich_from_index(blobs: DataFrame, index: DataFrame, provider: str, fetched_at: int):
    """External facts about known digests from a local index of `sha256, repo, filename`."""
    hits = blobs.select("sha256").join(index, "sha256")
    return hits.select(
        F.lit("blob").alias("subject_type"),
        F.col("sha256").alias("subject_key"),
        F.lit(provider).alias("provider"),
        "repo",
        "filename",
        F.to_json(F.struct("repo", "filename")).alias("payload_json"),
        F.lit("external").alias("level"),
        F.lit(fetched_at).cast("long").alias("fetched_at"),
    )
