"""Rules the tables must keep, as one table of violations (`rule, subject, detail`).

Parquet enforces nothing, so the constraints of the catalogue are checked here. Keys are reduced to
their distinct values before they are compared, so the size of one group does not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators.wanted import ACTIVE_TASK_STATES
from shelfmark.session import written

# Columns that identify a row, by table.
UNIQUE = {
    "roots": ["path"],
    "files": ["root_id", "rel_path"],
    "blobs": ["sha256"],
    "families": ["family_key"],
    "family_aliases": ["alias"],
    "declined_merges": ["family_a_key", "family_b_key", "algo_version"],
    "revisions": ["family_key", "rev_kind", "rev_label"],
    "variants": schemas.VARIANT_KEY,
    "file_roles": ["root_id", "rel_path"],
    "wanted": ["remote_key"],
    "profiles": ["profile"],
}
# (table, its columns, table they point to, columns there)
REFERENCES = [
    ("files", ["root_id"], "roots", ["root_id"]),
    ("files", ["sha256"], "blobs", ["sha256"]),
    ("revisions", ["family_key"], "families", ["family_key"]),
    ("variants", ["family_key", "rev_label"], "revisions", ["family_key", "rev_label"]),
    ("file_roles", ["root_id", "rel_path"], "files", ["root_id", "rel_path"]),
    ("file_roles", ["family_key"], "families", ["family_key"]),
    ("file_roles", schemas.VARIANT_KEY, "variants", schemas.VARIANT_KEY),
    ("family_aliases", ["family_key"], "families", ["family_key"]),
    ("monitors", ["family_key"], "families", ["family_key"]),
    ("monitors", ["profile"], "profiles", ["profile"]),
    ("wanted", ["local_root_id"], "roots", ["root_id"]),
    ("fetch_tasks", ["remote_key"], "wanted", ["remote_key"]),
    ("fetch_tasks", ["dest_root_id"], "roots", ["root_id"]),
]
# (table, column, allowed values); NULL is allowed everywhere.
ENUMS = [
    ("roots", "kind", schemas.ROOT_KINDS, "root.bad_kind"),
    ("families", "kind", schemas.KINDS, "families.bad_kind"),
    ("file_roles", "role", schemas.ROLES, "file_roles.bad_role"),
    ("variants", "format", schemas.FORMATS, "variants.bad_format"),
    ("evidence", "level", schemas.LEVELS, "evidence.bad_level"),
]


def _subject(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("subject")


def _violation(rows: DataFrame, rule: str, subject: list[str], detail: Column) -> DataFrame:
    return rows.select(
        F.lit(rule).alias("rule"), _subject(subject), detail.cast("string").alias("detail")
    )


def duplicate_keys(table: DataFrame, name: str, key: list[str], rule: str | None = None):
    repeated = table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return _violation(repeated, rule or f"{name}.not_unique", key, F.col("n"))


def orphans(child: DataFrame, name: str, key: list[str], parent: DataFrame, parent_key: list[str]):
    """Key values that point nowhere, with the number of rows that hold them."""
    held = child.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    there = parent.select(*[F.col(p).alias(k) for p, k in zip(parent_key, key)]).distinct()
    lost = held.join(there, key, "left_anti")
    return _violation(lost, f"{name}.{'_'.join(key[:2])}_orphan", key, F.col("n"))


def bad_values(table: DataFrame, column: str, allowed: Sequence[str], rule: str) -> DataFrame:
    bad = table.where(~F.col(column).isin(*allowed)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return _violation(bad, rule, [column], F.col("n"))


def _clean_path() -> Column:
    bare = F.rtrim(F.col("path"), F.lit("/"))
    return F.when(bare == "", "/").otherwise(bare).alias("path")


def nested_roots(roots: DataFrame) -> DataFrame:
    """Roots inside other roots, found by joining each root's parent folders to the root paths.

    Folders are compared whole, so `/data/models2` does not lie in `/data/models`.
    """
    paths = roots.select(_clean_path()).distinct()
    parts = F.split("path", "/")
    depth = F.size(parts)
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))),
        lambda n: F.concat_ws("/", F.slice(parts, 1, n)),
    )
    inner = paths.where(F.col("path") != "/").select(
        F.col("path").alias("inner"), F.explode(parents).alias("path")
    )
    inner = inner.withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.col("path")))
    hits = inner.where(F.col("inner") != F.col("path")).join(paths, "path")
    return _violation(hits, "root.overlap", ["inner"], F.col("path"))


def root_rules(roots: DataFrame) -> list[DataFrame]:
    fetch = F.col("kind") == "fetch"
    consistent = (fetch & (F.col("mode") == "fetch") & F.col("writable")) | (
        ~fetch & (F.col("mode") == "catalogue") & ~F.col("writable")
    )
    fetch_roots = roots.where(fetch).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return [
        _violation(
            roots.where(~F.coalesce(consistent, F.lit(False))),
            "root.mode_mismatch", ["root_id"], F.concat_ws("/", "kind", "mode"),
        ),
        _violation(fetch_roots.where(F.col("n") > 1), "root.fetch_exists", ["kind"], F.col("n")),
        nested_roots(roots),
    ]


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """All violations in the given tables; rules about tables that are not given are left out."""
    found: list[DataFrame] = []
    for name, key in UNIQUE.items():
        if name in tables:
            if name == "roots":
                same_place = tables[name].select(_clean_path())
                found.append(duplicate_keys(same_place, name, key, "root.duplicate"))
            else:
                found.append(duplicate_keys(tables[name], name, key))
    for name, key, parent, parent_key in REFERENCES:
        if name in tables and parent in tables:
            found.append(orphans(tables[name], name, key, tables[parent], parent_key))
    for name, column, allowed, rule in ENUMS:
        if name in tables:
            found.append(bad_values(tables[name], column, allowed, rule))
    return reduce(DataFrame.unionByName, found + other_rules(tables))


def other_rules(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """Violations of the rules that are neither keys, references nor allowed values; their tables are small."""
    found: list[DataFrame] = []
    if "roots" in tables:
        found += root_rules(tables["roots"])
    if "declined_merges" in tables:
        pairs = tables["declined_merges"]
        unsorted = pairs.where(F.col("family_a_key") >= F.col("family_b_key"))
        found.append(
            _violation(unsorted, "declined_merges.unsorted", ["family_a_key", "family_b_key"],
                       F.col("algo_version"))
        )
    if "monitors" in tables:
        foreign = tables["monitors"].where(F.col("variant_family_key") != F.col("family_key"))
        found.append(
            _violation(foreign, "radar.variant_family_mismatch", ["monitor_id"],
                       F.col("variant_family_key"))
        )
    if "fetch_tasks" in tables:
        active = tables["fetch_tasks"].where(F.col("state").isin(*ACTIVE_TASK_STATES))
        found.append(
            duplicate_keys(active, "fetch_tasks", ["remote_key"], "fetch_tasks.two_active")
        )
        if "wanted" in tables:
            no_digest = tables["wanted"].where(F.col("sha256").isNull()).select("remote_key")
            blind = tables["fetch_tasks"].join(no_digest, "remote_key", "left_semi")
            found.append(
                _violation(blind, "wanted.no_sha256", ["remote_key"], F.col("dest_rel_path"))
            )
    return found


# ---- after changes --------------------------------------------------------------------------


def row_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct rows that one side has more often than the other."""
    names = [f.name for f in after.schema.fields if f.dataType.typeName() != "void"]
    both = before.select(*names, F.lit(-1).alias("_side")).unionByName(after.select(*names, F.lit(1).alias("_side")))
    return both.groupBy(*names).agg(F.sum("_side").alias("_side")).where("_side <> 0").drop("_side")


def audit_changes(
    before: dict[str, DataFrame], after: dict[str, DataFrame], violations: DataFrame
) -> DataFrame:
    """The `audit` of the tables `after`, from the `violations` of those `before`.

    A rule about keys, references or values is checked again only for the subjects that stand in rows which
    differ (for references, on either side); all other violations are carried over. So a key with very
    many rows is counted again only when one of them changed. `before` and `after` may leave out rows that are the
    same in both if they leave out all rows of a subject: see `CatalogueStore.changes`.
    """
    changed = {n: written(row_changes(before[n], t) if n in before else t) for n, t in after.items()}
    found: list[DataFrame] = []

    def again(rule: str, touched: DataFrame, check: Callable[[Callable], DataFrame]) -> None:
        """`touched` has the subjects to check; `check` gets a function that keeps a table's rows of these."""
        subjects = written(touched.select("subject").distinct())

        def only(table: DataFrame, key: list[str]) -> DataFrame:
            marked = table.select("*", _subject(key).alias("_subject"))
            return marked.join(subjects.withColumnRenamed("subject", "_subject"), "_subject", "left_semi").drop("_subject")

        kept = violations.where(F.col("rule") == rule).join(subjects, "subject", "left_anti")
        found.extend([check(only), kept.select("rule", "subject", "detail")])

    for name, key in UNIQUE.items():
        if name in after:
            roots = name == "roots"
            rule = "root.duplicate" if roots else f"{name}.not_unique"
            shown = (lambda t: t.select(_clean_path())) if roots else (lambda t: t)
            again(
                rule, shown(changed[name]).select(_subject(key)),
                lambda only, n=name, k=key, r=rule, f=shown: duplicate_keys(only(f(after[n]), k), n, k, r),
            )
    for name, key, parent, parent_key in REFERENCES:
        if name in after and parent in after:
            again(
                f"{name}.{'_'.join(key[:2])}_orphan",
                changed[name].select(_subject(key)).union(changed[parent].select(_subject(parent_key))),
                lambda only, n=name, k=key, p=parent, pk=parent_key: orphans(only(after[n], k), n, k, only(after[p], pk), pk),
            )
    for name, column, allowed, rule in ENUMS:
        if name in after:
            again(
                rule, changed[name].where(~F.col(column).isin(*allowed)).select(_subject([column])),
                lambda only, n=name, c=column, a=allowed, r=rule: bad_values(only(after[n], [c]), c, a, r),
            )
    return reduce(DataFrame.unionByName, found + other_rules(after))
