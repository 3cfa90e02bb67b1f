"""Every operator as a query over the test tables: name -> (spark, sf_dir) -> DataFrame.

Nested results are flattened to plain columns so that they can be compared with SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions import identity, names
from shelfmark.operators import (
    audit,
    build,
    duplicates,
    evidence,
    merge,
    reconcile,
    reports,
    wanted,
)
from shelfmark.plans import stand_ins
from shelfmark.plans.scan import identify_files
from shelfmark.plans.views import table, view
from shelfmark.session import cut, shared_dir, spread, tune, written
from shelfmark.sources import contents, listing, manifest, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = 1_800_000_000


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tune(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


def _text_field(name: str) -> list[Column]:
    return [F.col(f"{name}.value").alias(name), F.col(f"{name}.level").alias(f"{name}_level")]


# ---- copies (documents as files) ------------------------------------------------------------


@query
def dup_plan(spark, sf):
    return duplicates.duplicate_groups(view(spark, sf, "v_docs"))


@query
def dup_copies(spark, sf):
    return duplicates.duplicate_copies(view(spark, sf, "v_docs"), view(spark, sf, "v_roots"))


@query
def dup_totals(spark, sf):
    return duplicates.duplicate_totals(view(spark, sf, "v_docs"))


@query
def have_bytes(spark, sf):
    asked = table(spark, sf, "documents").select(
        (F.col("doc_id") % 6).alias("root_id"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("rel_path"),
    )
    return duplicates.have_bytes(asked, view(spark, sf, "v_docs"))


def _doc_blobs(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("size")
    ).distinct()


@query
def blob_refcount(spark, sf):
    return duplicates.blob_refcount(_doc_blobs(spark, sf), view(spark, sf, "v_docs"))


@query
def hash_gate(spark, sf):
    files = table(spark, sf, "documents").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("size"),
        contents.digests_of_bytes(F.col("text").cast("binary"))[1].alias("partial_digest"),
    )
    return duplicates.hash_gate(files).select("doc_id", "size", "collides")


@query
def staged_digests(spark, sf):
    """Documents as files: by size, by edges of 64 bytes, then whole. Every third blob is stored already, and of
    every fifteenth only the size."""
    data = F.col("text").cast("binary")
    full, partial = contents.digests_of_bytes(data, window=64)
    files = table(spark, sf, "documents").withColumn("size", F.octet_length("text").cast("long"))
    known = files.where(F.col("doc_id") % 3 == 0).select(
        (F.col("size") + F.col("doc_id") % 2).alias("size"), F.when(F.col("doc_id") % 15 != 0, partial).alias("partial_digest")
    ).distinct()
    sized = duplicates.open_after_size(files.select("doc_id", "text", "size"), known)
    edged = sized.withColumn("partial_digest", F.when(F.col("open"), partial))
    left = duplicates.open_after_edges(edged, known)
    stage = F.when(F.col("open"), "full").when(F.col("partial_digest").isNotNull(), "edges").otherwise("size")
    return left.select(
        "doc_id", "size", stage.alias("stage"), "partial_digest", F.when(F.col("open"), full).alias("sha256")
    )


@query
def digest_tree(spark, sf):
    """Pieces of 256 bytes, eight digests to a parent."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pieces = contents.piece_digests_of_bytes(docs, F.col("text").cast("binary"), 256).drop("text")
    return contents.root_digests(pieces, ["doc_id"], 8)


@query
def broken_ranges(spark, sf):
    """Every seventh text has another letter in the middle, every eleventh has lost its last hundred bytes."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    data, middle = F.col("text").cast("binary"), F.floor(F.octet_length("text") / 2).cast("int")
    size = F.octet_length("text")
    changed = F.concat(F.substring(data, F.lit(1), middle), F.lit(b"~"), F.substring(data, middle + 2, size))
    shorter = F.substring(data, F.lit(1), F.greatest(F.lit(0), size - 100))
    now = F.when(F.col("doc_id") % 7 == 0, changed).when(F.col("doc_id") % 11 == 0, shorter).otherwise(data)
    stored, again = (contents.piece_digests_of_bytes(docs, d, 256).drop("text") for d in (data, now))
    return contents.broken_ranges(again, stored, ["doc_id"])


@query
def content_digest(spark, sf):
    full, partial = contents.digests_of_bytes(F.col("text").cast("binary"), window=256)
    return table(spark, sf, "documents").select(
        "doc_id", full.alias("sha256"), partial.alias("partial_digest")
    )


@query
def trusted_names(spark, sf):
    return view(spark, sf, "v_trust").select(
        "doc_id",
        names.digest_in_name("rel_path").alias("sha256"),
        names.is_partial_download("rel_path").alias("is_partial"),
    )


# ---- names and identity (parts as model files) ----------------------------------------------


@query
def name_facts(spark, sf):
    facts = identity.with_name_facts(view(spark, sf, "v_files"))
    return facts.select(
        "rel_path", "name_stem", "name_role", "name_quant", "name_publisher", "name_subflavour",
        "name_kind", names.params_tag("name_stem").alias("name_params"),
    )


@query
def display_stem(spark, sf):
    return view(spark, sf, "v_files").select(
        "rel_path", names.display_stem(names.stem("rel_path")).alias("display_stem")
    )


@query
def shard_strip(spark, sf):
    stem = names.stem("rel_path")
    return view(spark, sf, "v_files").select(
        "rel_path",
        names.is_shard(stem).alias("is_shard"),
        names.shard_strip(stem).alias("stripped"),
    )


@query
def url_slug(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", names.stem("url").alias("stem"), names.slug("url").alias("slug")
    )


@query
def name_tokens(spark, sf):
    key = names.slug(names.stem("rel_path"))
    return view(spark, sf, "v_files").select(
        "rel_path", F.concat_ws(" ", names.name_tokens(key)).alias("tokens")
    )


@query
def name_similarity(spark, sf):
    one = names.name_tokens(names.slug("p_name"))
    two = names.name_tokens(names.slug(F.concat_ws(" ", "p_type", "p_name", "p_brand", "p_type")))
    return table(spark, sf, "part").select(
        "p_partkey",
        names.shared_tokens(two, one).alias("shared_tokens"),
        names.similarity_score(two, one).alias("score"),
    )


@query
def family_key(spark, sf):
    total = F.col("p_retailprice") / F.lit(16.0)
    return table(spark, sf, "part").select(
        "p_partkey",
        identity.round1(total).alias("rounded"),
        identity.family_key(
            F.col("p_name"), F.col("p_type"), total, F.when(F.col("p_size") % 2 == 0, total)
        ).alias("family_key"),
    )


@query
def file_type_quants(spark, sf):
    number = F.col("p_size") % 40
    quant = identity.quant_of_file_type(number)
    return table(spark, sf, "part").select(
        "p_partkey", quant.alias("quant"),
        identity.file_type_of_quant(quant).cast("long").alias("file_type"),
    )


def _identified(spark, sf) -> DataFrame:
    # One small file holds very many parts, so that few tasks read them: names take most of the time.
    files = spread(view(spark, sf, "v_files").where(F.col("parse_state") == "ok"), *reconcile.FILE_KEY)
    facts = files.withColumns(
        {
            "quant_from_header": identity.quant_of_file_type(F.col("file_type")),
            "kind": F.when(F.col("format") == "gguf", identity.kind_of_gguf(F.col("arch"))).otherwise(
                identity.kind_of_safetensors(F.col("arch"))
            ),
        }
    )
    return identity.with_identity(facts)


@query
def identify(spark, sf):
    return _identified(spark, sf).select(
        "rel_path", "role", "is_unknown", "family_key", *_text_field("name"),
        *_text_field("quant"), *_text_field("quant_raw"), *_text_field("kind"),
        *_text_field("subflavour"), *_text_field("publisher"),
        identity.level_source(F.col("name.level")).alias("name_source"),
    )


@query
def unknown_flag(spark, sf):
    return (
        _identified(spark, sf)
        .groupBy("role", "is_unknown")
        .agg(F.count(F.lit(1)).alias("files"))
    )


# ---- building the catalogue -----------------------------------------------------------------


def _logged(found: DataFrame) -> DataFrame:
    """Evidence with a sequence number taken from the file that gave it."""
    return found.select(
        F.regexp_extract("last_at.rel_path", r"\Ap([0-9]+)/", 1).cast("long").alias("seq"),
        "subject_type", "subject_key", "field", "value", "level", "source",
        F.lit(NOW).cast("long").alias("recorded_at"),
    )


class _Catalogue:
    """Tables built from the identified parts. Several tables come from the same rows, so those are
    identified once and written to the checkpoint folder, not computed again for each table."""

    def __init__(self, spark: SparkSession, sf: str):
        self.files = view(spark, sf, "v_files")
        self.identified = cut(_identified(spark, sf))
        self.families = build.build_families(self.identified)
        self.variants = build.build_variants(self.identified)
        self.roles = reconcile.drop_roles_of_missing(
            build.assign_roles(self.identified, self.families), self.files
        )
        self.logged = _logged(evidence.evidence_rows(self.identified))


@query
def families(spark, sf):
    return build.build_families(cut(_identified(spark, sf)))


@query
def revisions(spark, sf):
    return build.build_revisions(cut(_identified(spark, sf)))


@query
def variants(spark, sf):
    return build.build_variants(cut(_identified(spark, sf)))


@query
def file_roles(spark, sf):
    return _Catalogue(spark, sf).roles


@query
def evidence_rows(spark, sf):
    return evidence.evidence_rows(cut(_identified(spark, sf))).select(
        "subject_type", "subject_key", "field", "value", "level", "source",
        F.col("last_at.root_id").alias("root_id"), F.col("last_at.rel_path").alias("rel_path"),
    )


@query
def evidence_append(spark, sf):
    """A second scan whose log already holds two thirds of the facts."""
    found = cut(evidence.evidence_rows(cut(_identified(spark, sf))))
    logged = _logged(found).where(F.col("seq") % 3 != 0)
    return evidence.append_evidence(found, logged, scan_seq=1, recorded_at=NOW).drop("seq")


# ---- reports --------------------------------------------------------------------------------


@query
def home_counts(spark, sf):
    c = _Catalogue(spark, sf)
    return reports.home_counts(c.families, c.logged, c.files, c.roles)


@query
def root_counts(spark, sf):
    """Counts of the roots that hold documents."""
    used = view(spark, sf, "v_docs").select("root_id").distinct()
    return reports.root_counts(view(spark, sf, "v_roots").join(used, "root_id", "left_semi"))


@query
def family_list(spark, sf):
    c = _Catalogue(spark, sf)
    roots = view(spark, sf, "v_roots")
    listed = reports.family_list(c.families, c.variants, c.roles, c.files, roots, c.logged)
    place = F.transform("roots", lambda r: F.concat_ws(":", r["name"], r["present"].cast("string")))
    return listed.withColumn("roots", F.concat_ws(",", place))


@query
def family_lookup(spark, sf):
    known = cut(build.build_families(cut(_identified(spark, sf))))
    requests = (
        table(spark, sf, "part")
        .select(F.explode(F.array("p_name", F.concat("p_name", F.lit(" Chat")), "p_type")).alias("request"))
        .unionByName(known.select(F.col("family_key").alias("request")))
        .distinct()
    )
    return reports.find_families(requests, known)


@query
def variant_view(spark, sf):
    c = _Catalogue(spark, sf)
    return reports.variant_view(c.variants, c.roles, c.files, view(spark, sf, "v_roots"))


@query
def unknown_inbox(spark, sf):
    c = _Catalogue(spark, sf)
    return reports.unknown_inbox(c.files, c.roles)


@query
def storage_by_root(spark, sf):
    return reports.storage_by_root(view(spark, sf, "v_docs"), view(spark, sf, "v_roots"))


@query
def storage_rollup(spark, sf):
    c = _Catalogue(spark, sf)
    rolled = reports.storage_rollup(c.files, c.roles)
    return rolled.withColumn("level", F.col("level").cast("long"))


@query
def catalogue_search(spark, sf):
    """Red families of a size range that have a given quantisation."""
    c = _Catalogue(spark, sf)
    known = cut(c.families)
    aliases = known.select("family_key", F.concat(F.lit("alias "), "name").alias("alias"))
    tags = known.select(
        F.concat(F.lit("tag-"), "kind").alias("tag"), F.lit("family").alias("entity_type"),
        F.col("family_key").alias("entity_key"),
    )
    provenance = known.select(
        F.lit("family").alias("subject_type"), F.col("family_key").alias("subject_key"),
        F.concat(F.lit("repo/"), "arch").alias("repo"),
    )
    tokens = reports.search_tokens(known, aliases, tags, provenance)
    return reports.search(
        known, tokens, query="tag RED repo", variants=c.variants, quant="Q4_K_M",
        min_params=5.0, max_params=40.0,
    ).select("family_key", "name", "params_total")


@query
def filtered_search(spark, sf):
    """Families on a network root that have copies elsewhere, all digests, and no copy on a root that is away."""
    c = _Catalogue(spark, sf)
    chips = cut(reports.family_chips(c.files, c.roles, view(spark, sf, "v_roots")))
    none = c.families.limit(0).select("family_key", F.lit("").alias("token"))
    filters = {"a": {"offline": False, "source": "nas"}, "b": {"dups": True, "have_bytes": True}, "c": {"offline": True, "dups": False}}
    known = cut(c.families)
    found = [
        reports.search(known, none, chips=chips, **chosen).select(F.lit(name).alias("filter"), "family_key")
        for name, chosen in filters.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def family_chips(spark, sf):
    c = _Catalogue(spark, sf)
    return reports.family_chips(c.files, c.roles, view(spark, sf, "v_roots"))


@query
def shard_sets(spark, sf):
    return reports.shard_sets(view(spark, sf, "v_shards"))


_LADDER = ("Q3_K_S", "Q4_K_M", "Q5_K_M", "Q8_0")


@query
def quant_ladder(spark, sf):
    holes = view(spark, sf, "v_local_variants").select(
        "family_key", F.lit("Q5_K_M").alias("quant"), F.lit("open").alias("status")
    )
    return reports.quant_ladder(view(spark, sf, "v_local_variants"), holes, _LADDER)


# ---- two listings (orders as files) ---------------------------------------------------------


def _changes(spark, sf) -> DataFrame:
    return reconcile.compare_listings(
        view(spark, sf, "v_prev"), view(spark, sf, "v_curr"), view(spark, sf, "v_scan_roots")
    )


@query
def listing_diff(spark, sf):
    return _changes(spark, sf).select("root_id", "rel_path", "change")


@query
def next_files(spark, sf):
    return reconcile.next_files(_changes(spark, sf)).drop("ctime", "dev", "symlink_target")


@query
def missing_files(spark, sf):
    return reconcile.gone_files(_changes(spark, sf))


@query
def offline_guard(spark, sf):
    """Rows of roots that are away, before and after."""
    return (
        reconcile.next_files(_changes(spark, sf))
        .join(view(spark, sf, "v_scan_roots").where("not present"), "root_id", "left_semi")
        .select("root_id", "rel_path", "size", "sha256", "hash_state", "state")
    )


def _report(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders")
    skipped = F.col("o_orderkey") % 97 == 0
    skips = orders.select(
        (F.col("o_orderkey") % 5).alias("root_id"),
        F.when(skipped & (F.col("o_orderkey") % 2 == 0), "skipped_symlink_dirs")
        .when(skipped, "dirs_unreadable").alias("reason"),
    )
    fresh = orders.select(
        F.when(F.col("o_orderkey") % 89 == 0, F.col("o_orderkey") % 5).alias("root_id")
    )
    return reconcile.scan_report(
        _changes(spark, sf), view(spark, sf, "v_scan_roots"), skips, fresh
    )


@query
def scan_report(spark, sf):
    return _report(spark, sf)


@query
def scan_history(spark, sf):
    return reconcile.scan_runs_rows(_report(spark, sf), started=NOW, finished=NOW + 60).select(
        "root_id", "started", "finished", "files_new", "files_changed", "files_gone", "ok"
    )


@query
def hash_decision(spark, sf):
    return reconcile.needs_hash(view(spark, sf, "v_curr_whole")).select("root_id", "rel_path", "needs_hash")


@query
def blob_upsert(spark, sf):
    old = view(spark, sf, "v_prev_whole").where(F.col("sha256").isNotNull()).select(
        "sha256", "size", F.concat(F.lit("p"), "rel_path").alias("partial_digest")
    )
    key = F.substring("rel_path", 2, 20).cast("long")
    new = view(spark, sf, "v_curr_whole").select(
        F.when(key % 4 == 0, F.sha2(key.cast("string"), 256)).otherwise(F.col("sha256")).alias("sha256"),
        "size",
        F.when(key % 3 != 0, F.concat(F.lit("n"), key.cast("string"))).alias("partial_digest"),
        key.alias("seq"),
    )
    return reconcile.upsert_blobs(old, new)


@query
def root_removal(spark, sf):
    """What is left of the three tables when the absent roots are removed."""
    roots = view(spark, sf, "v_roots")
    c = _Catalogue(spark, sf)
    kept = reconcile.remove_roots(roots, c.files, c.roles, roots.where("not present"))
    counts = [
        t.groupBy("root_id").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(n).alias("kept"), "root_id", "rows")
        for n, t in zip(("roots", "files", "file_roles"), kept)
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def inherited_presence(spark, sf):
    return reconcile.with_presence(view(spark, sf, "v_files"), view(spark, sf, "v_roots")).select(
        "rel_path", "root_id", "root_present"
    )


# ---- evidence (events) ----------------------------------------------------------------------


@query
def latest_evidence(spark, sf):
    return evidence.latest_evidence(view(spark, sf, "v_evidence"))


@query
def truth_resolve(spark, sf):
    return evidence.resolve_truth(view(spark, sf, "v_evidence"))


@query
def provenance_timeline(spark, sf):
    return evidence.provenance_timeline(view(spark, sf, "v_provenance"))


@query
def presence_hysteresis(spark, sf):
    return evidence.presence_with_patience(view(spark, sf, "v_probe"), patience=2)


@query
def presence_states(spark, sf):
    return evidence.presence_states(view(spark, sf, "v_probe"), patience=2)


@query
def index_enrichment(spark, sf):
    """The index knows every third document; its other entries have digests that no blob has."""
    known = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("not "), "text"))
    index = table(spark, sf, "documents").select(
        F.sha2(known, 256).alias("sha256"), F.col("source").alias("repo"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"),
    )
    return evidence.enrich_from_index(_doc_blobs(spark, sf), index, "index", NOW)


# ---- merging --------------------------------------------------------------------------------


def _decisions(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declined and merged pairs between families of the same name and architecture."""
    pair = known.where(F.col("arch").isNotNull()).groupBy("name", "arch").agg(
        F.min("family_key").alias("low"), F.max("family_key").alias("high")
    ).where(F.col("low") != F.col("high"))
    even = F.length("low") % 2 == 0
    declined = pair.where(even).select(
        F.col("high").alias("a_key"), F.col("low").alias("b_key"), F.lit("1").alias("algo_version")
    )
    none = declined.limit(0).select(
        F.col("a_key").alias("family_a_key"), F.col("b_key").alias("family_b_key"),
        "algo_version", F.lit(0).cast("long").alias("declined_at"),
    )
    aliases = pair.where(~even).select(
        F.col("low").alias("family_key"), F.col("high").alias("alias"), F.lit("user").alias("source")
    )
    return merge.decline_pairs(none, declined, NOW), aliases


@query
def declined_pairs(spark, sf):
    orders = table(spark, sf, "orders")
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    asked = orders.select(
        F.when(F.col("o_orderkey") % 2 == 0, customer).otherwise(F.col("o_orderstatus")).alias("a_key"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(customer).alias("b_key"),
        F.lit("1").alias("algo_version"),
    )
    rule = F.when(F.col("o_orderkey") % 50 == 0, "1").otherwise("0")
    stored = orders.select(
        F.least(key, customer).alias("family_a_key"), F.greatest(key, customer).alias("family_b_key"),
        rule.alias("algo_version"), F.col("o_orderkey").alias("declined_at"),
    )
    return merge.decline_pairs(stored, asked, NOW)


@query
def merge_suggestions(spark, sf):
    known = cut(build.build_families(cut(_identified(spark, sf))))
    return merge.merge_suggestions(known, *_decisions(known))


@query
def asked_suggestions(spark, sf):
    """Pairs of the families whose keys have a length divisible by four."""
    known = cut(build.build_families(cut(_identified(spark, sf))))
    asked = known.where(F.length("family_key") % 4 == 0)
    return merge.merge_suggestions(known, *_decisions(known), asked=asked)


@query
def close_suggestions(spark, sf):
    known = cut(build.build_families(cut(_identified(spark, sf))))
    return merge.merge_suggestions(known, *_decisions(known), least_score=0.6)


@query
def followed_suggestions(spark, sf):
    """Stored pairs of an earlier state (families missing, others of another size, some since gone), followed to now."""
    now = cut(build.build_families(cut(_identified(spark, sf))))
    size = F.length("family_key")
    gone = now.where(size % 9 == 1).withColumn("family_key", F.concat(F.lit("old-"), "family_key"))
    before = cut(
        now.where(size % 7 != 3)
        .withColumn("params_total", F.when(size % 5 == 0, F.col("params_total") * 3).otherwise(F.col("params_total")))
        .unionByName(gone)
    )
    pairs = written(merge.likely_pairs(before))
    return merge.undecided(merge.follow_pairs(pairs, before, now), *_decisions(now), stay=True)


@query
def merged_families(spark, sf):
    """Families of some key lengths are merged into one of their architecture, which has no row of its own."""
    known = cut(build.build_families(cut(_identified(spark, sf))))
    aliases = known.where((F.length("family_key") % 5 == 0) & F.col("arch").isNotNull()).select(
        F.concat(F.lit("into|"), "arch").alias("family_key"), F.col("family_key").alias("alias"), F.lit("user").alias("source")
    )
    into_own = _decisions(known)[1].where(F.length("alias") % 5 != 0)
    resolved = merge.resolve_aliases(cut(aliases.unionByName(into_own)))
    return merge.merged_families(known, resolved).select("family_key", "name", "arch", "params_total")


@query
def import_decisions(spark, sf):
    """Customers as families: links of two catalogues, with circles, second targets and declined pairs."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k)
    name = lambda n: F.concat(F.lit("f"), n.cast("string"))
    half = F.floor(k / 2)
    links = lambda df, into, source: df.select(
        name(into).alias("family_key"), name(k).alias("alias"), F.lit(source).alias("source")
    )
    own = links(rows.where(k % 3 == 0), half, "user")
    target = (
        F.when(k % 50 == 20, k + 1).when(k % 50 == 21, k - 1).when((k % 3 == 0) & (k % 5 == 0), k + 3).when(k % 3 == 1, half)
    )
    other = links(rows.where(target.isNotNull()), target, "import")
    pair = lambda df, n, at: df.select(
        F.least(name(k), name(n)).alias("family_a_key"), F.greatest(name(k), name(n)).alias("family_b_key"),
        F.lit("1").alias("algo_version"), F.lit(at).cast("long").alias("declined_at"),
    )
    mine = pair(rows.where(k % 11 == 0), k + 1, 10).unionByName(pair(rows.where(k % 17 == 0), half, 20))
    theirs = pair(rows.where(k % 13 == 0), half, 5).unionByName(pair(rows.where(k % 11 == 0), k + 1, 3))
    aliases, declined, conflicts = merge.import_decisions(own, mine, other, theirs, "1")
    return (
        aliases.select(F.lit("alias").alias("section"), F.col("alias").alias("a"), F.col("family_key").alias("b"), F.col("source").alias("c"))
        .unionByName(declined.select(F.lit("declined").alias("section"), F.col("family_a_key").alias("a"), F.col("family_b_key").alias("b"),
                                     F.col("declined_at").cast("string").alias("c")))
        .unionByName(conflicts.select(F.lit("conflict").alias("section"), F.col("key").alias("a"), F.col("other").alias("b"), F.col("problem").alias("c")))
    )


def _alias_chain(spark, sf) -> DataFrame:
    """Customer n merged into n/2, rounded down, every seventh into itself: chains of many lengths."""
    key = F.col("c_custkey")
    into = F.when(key % 7 == 0, key).otherwise(F.floor(key / 2))
    return table(spark, sf, "customer").select(
        F.concat(F.lit("f"), into.cast("string")).alias("family_key"),
        F.concat(F.lit("f"), key.cast("string")).alias("alias"),
        F.lit("user").alias("source"),
    )


@query
def alias_applied(spark, sf):
    resolved = merge.resolve_aliases(_alias_chain(spark, sf))
    variants_ = view(spark, sf, "v_local_variants").withColumn("was", F.col("family_key"))
    return (
        merge.apply_aliases(variants_, resolved)
        .groupBy("was", "family_key")
        .agg(F.count(F.lit(1)).alias("variants"))
    )


# ---- wanted (orders as a remote listing) ----------------------------------------------------


def _profiles(spark, sf) -> DataFrame:
    """One profile per market segment."""
    segment = F.col("c_mktsegment")
    strings = "array<string>"
    listed = lambda *values: F.array(*[F.lit(v) for v in values]).cast(strings)
    return table(spark, sf, "customer").select("c_mktsegment").distinct().select(
        segment.alias("profile"),
        F.when(segment == "MACHINERY", listed()).otherwise(listed("gguf")).alias("formats"),
        F.when(segment == "BUILDING", listed("Q4_K_M", "Q5_K_M"))
        .otherwise(listed("Q3_K_S", "Q4_K_M", "Q5_K_M", "Q8_0")).alias("quants"),
        F.when(segment == "FURNITURE", listed()).otherwise(listed("mradermacher", "bartowski"))
        .alias("publishers"),
        F.when(segment == "AUTOMOBILE", listed("-Q8")).otherwise(listed("m77")).alias("exclude_name"),
        F.when(segment == "HOUSEHOLD", "Q8_0").otherwise("Q4_K_M").alias("cutoff"),
        F.when(segment == "BUILDING", F.lit(10_000_000).cast("long")).alias("max_bytes"),
    )


def _matches(spark, sf) -> DataFrame:
    return wanted.profile_match(
        view(spark, sf, "v_monitors"), _profiles(spark, sf), view(spark, sf, "v_repos"),
        wanted.remote_facts(view(spark, sf, "v_remote")),
    )


def _owned(spark, sf) -> DataFrame:
    return wanted.owned_blobs(view(spark, sf, "v_owned_files"), view(spark, sf, "v_roots"))


def _statuses(spark, sf) -> DataFrame:
    chosen = wanted.choose_publisher(_matches(spark, sf))
    return wanted.wanted_status(chosen, _owned(spark, sf), view(spark, sf, "v_local_variants"))


def _wanted(spark, sf) -> DataFrame:
    stored = view(spark, sf, "v_remote").select(
        wanted.remote_key().alias("remote_key"), "provider", "repo", "revision", "filename", "size",
        "sha256", F.lit("fetched").alias("status"), F.lit(None).cast("long").alias("local_root_id"),
        F.lit(NOW - 1000).cast("long").alias("swept_at"),
    )
    return wanted.upsert_wanted(stored, _statuses(spark, sf), NOW)


@query
def profile_match(spark, sf):
    return _matches(spark, sf).select("monitor_id", "repo", "revision", "filename", "quant", "publisher")


@query
def publisher_choice(spark, sf):
    return wanted.choose_publisher(_matches(spark, sf)).select("monitor_id", "filename", "publisher")


@query
def owned_blobs(spark, sf):
    return _owned(spark, sf)


@query
def wanted_status(spark, sf):
    return _statuses(spark, sf).select(
        "monitor_id", "remote_key", "status", "local_root_id", "only_offline"
    )


@query
def wanted_upsert(spark, sf):
    return _wanted(spark, sf)


@query
def wanted_offline(spark, sf):
    return wanted.owned_offline(_wanted(spark, sf), view(spark, sf, "v_roots")).select(
        "remote_key", "root"
    )


@query
def fetch_eligibility(spark, sf):
    key = F.regexp_extract("filename", r"\Am([0-9]+)", 1).cast("long")
    placed = _wanted(spark, sf).withColumn(
        "dest",
        F.when(key % 8 == 0, F.concat(F.lit("/"), "filename"))
        .when(key % 8 == 1, F.concat(F.lit("a/../"), "filename"))
        .when(key % 8 == 2, F.concat(F.lit("C:"), "filename"))
        .when(key % 8 == 3, F.concat(F.lit("\\\\host\\"), "filename"))
        .otherwise(F.concat(F.lit("a..b/"), "filename")),
    )
    judged = wanted.fetch_eligibility(
        placed, _owned(spark, sf), view(spark, sf, "v_tasks"), destination="dest"
    )
    return judged.select(
        "remote_key", F.concat_ws(",", "failed").alias("failed"), "eligible"
    )


# ---- audit ----------------------------------------------------------------------------------


def _audited(spark, sf) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables with violations of many rules; file roles apart, since they have no variants here."""
    nations, parts = table(spark, sf, "nation"), table(spark, sf, "part")
    number = F.col("n_nationkey").cast("long")
    name = F.concat(F.lit("/mnt/n"), number.cast("string"))
    above = F.concat(F.lit("/mnt/n"), (number - 1).cast("string"))
    roots = nations.select(
        number.alias("root_id"),
        F.when(number % 6 == 5, F.concat(above, F.lit("/inner/deep")))
        .when(number % 9 == 8, F.concat(above, F.lit("/"))).otherwise(name).alias("path"),
        F.when(number % 7 == 3, "floppy").when(number % 10 == 0, "fetch").otherwise("nas").alias("kind"),
        F.when(number % 20 == 0, "fetch").otherwise("catalogue").alias("mode"),
        ((number % 20 == 0) | (number % 12 == 5)).alias("writable"),
    )
    key = F.col("p_partkey")
    digest = F.sha2(F.col("p_name"), 256)
    files = parts.select(
        (key % 30).alias("root_id"),
        F.concat(F.lit("p"), (key - F.when(key % 100 == 31, 30).otherwise(0)).cast("string")).alias("rel_path"),
        digest.alias("sha256"),
    )
    blobs = parts.where(F.col("p_size") > 1).select(digest.alias("sha256")).distinct().where(
        F.col("sha256") > "1"
    )
    families_ = parts.select(
        F.col("p_name").alias("family_key"), F.when(F.col("p_size") == 50, "lim").otherwise("llm").alias("kind")
    ).distinct()
    roles = parts.select(
        (key % 30).alias("root_id"), F.concat(F.lit("p"), key.cast("string")).alias("rel_path"),
        F.when(key % 50 == 9, "boss").otherwise("weights").alias("role"),
        F.when(key % 40 == 3, "none").otherwise(F.col("p_name")).alias("family_key"),
    )
    declined = table(spark, sf, "customer").select(
        F.col("c_name").alias("family_a_key"),
        F.concat(F.lit("Customer#"), F.lpad((F.lit(2000) - F.col("c_custkey")).cast("string"), 9, "0")).alias("family_b_key"),
        F.lit("1").alias("algo_version"),
    )
    audited = {
        "roots": roots,
        "files": files,
        "blobs": blobs,
        "families": families_,
        "declined_merges": declined,
        "evidence": view(spark, sf, "v_evidence").select(
            F.when(F.col("seq") % 500 == 0, "guess").otherwise(F.col("level")).alias("level")
        ),
        "monitors": view(spark, sf, "v_monitors").drop("profile").withColumn("profile", F.lit(None)),
        "wanted": view(spark, sf, "v_remote").select(
            wanted.remote_key().alias("remote_key"), "sha256", F.lit(None).cast("long").alias("local_root_id")
        ),
        "fetch_tasks": view(spark, sf, "v_tasks").select(
            "remote_key", "state", F.lit("d").alias("dest_rel_path"),
            (F.length("remote_key") % 20).cast("long").alias("dest_root_id"),
        ),
    }
    return audited, roles


@query
def audit_followed(spark, sf):
    """The audit now, from that of an earlier state: files of other roots and digests, fewer families and blobs, other levels."""
    now, _ = _audited(spark, sf)
    number = F.substring("rel_path", 2, 20).cast("long")
    before = now | {
        "files": now["files"].where(number % 10 != 3).withColumns(
            {"root_id": F.when(number % 8 == 1, F.lit(77).cast("long")).otherwise(F.col("root_id")),
             "sha256": F.when(number % 6 == 1, F.lit("gone")).otherwise(F.col("sha256"))}
        ),
        "roots": now["roots"].where(F.col("root_id") % 4 != 1),
        "blobs": now["blobs"].where(F.col("sha256") > "8"),
        "families": now["families"].where(F.col("kind") == "llm"),
        "evidence": now["evidence"].withColumn("level", F.when(F.col("level") == "known", "hunch").otherwise(F.col("level"))),
        "declined_merges": now["declined_merges"].unionByName(now["declined_merges"]),
    }
    violations = cut(audit.audit(before))
    return audit.audit_changes(before, now, violations)


@query
def integrity_audit(spark, sf):
    audited, roles = _audited(spark, sf)
    files, families_ = audited["files"], audited["families"]
    lost_files = audit.orphans(
        roles, "file_roles", ["root_id", "rel_path"], files, ["root_id", "rel_path"]
    )
    lost_families = audit.orphans(roles, "file_roles", ["family_key"], families_, ["family_key"])
    return audit.audit(audited).unionByName(lost_files).unionByName(lost_families)


# ---- header bytes and files -----------------------------------------------------------------


def _facts_columns(facts: DataFrame) -> DataFrame:
    return facts.select(
        "file_id", "format", "basename", "arch", "params_total", "context_len", "file_type",
        "quant_from_header", F.col("kind.value").alias("kind"),
        F.col("kind.level").alias("kind_level"), "parse_error",
    )


@query
def header_facts(spark, sf):
    made = stand_ins.gguf_bytes(spark, sf)
    return _facts_columns(contents.header_facts_of_bytes(made, "content", "rel_path"))


@query
def safetensors_facts(spark, sf):
    made = stand_ins.safetensors_bytes(spark, sf)
    return _facts_columns(contents.header_facts_of_bytes(made, "content", "rel_path"))


def _listed(spark, sf) -> DataFrame:
    return listing.list_files(listing.walk(stand_ins.model_tree(spark, sf)))


@query
def listing_source(spark, sf):
    return _listed(spark, sf).select("rel_path", "size", "is_symlink", "readable")


@query
def batch_identify(spark, sf):
    return identify_files(_listed(spark, sf)).select(
        "rel_path", "size", "format", "role", "family_key", "is_unknown", *_text_field("quant"),
        *_text_field("name"), F.col("params_total.value").alias("params_total"),
        F.col("context_len.value").alias("context_len"), "sha256",
    )


@query
def verify_digests(spark, sf):
    """Every fifth model's stored digest is wrong."""
    stored = stand_ins.model_contents(spark, sf).select(
        F.lit(1).cast("long").alias("root_id"),
        "rel_path",
        F.when(F.length("rel_path") % 5 == 0, F.sha2(F.col("rel_path").cast("binary"), 256))
        .otherwise(F.sha2("content", 256)).alias("sha256"),
    )
    return contents.verify_digests(_listed(spark, sf), stored).select(
        "rel_path", "stored_sha256", "sha256", "verdict"
    )


# ---- snapshots ------------------------------------------------------------------------------


@query
def snapshot_difference(spark, sf):
    """Two stored snapshots of the files: all, and after a scan that reached the roots with an even number."""
    import uuid

    catalogue = store.CatalogueStore(spark, f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}")
    stored, listed = view(spark, sf, "v_prev"), view(spark, sf, "v_curr").drop("readable")
    catalogue.write({n: stored if n == "files" else t for n, t in catalogue.read().items()}, NOW)
    first = catalogue.read()
    reached = [0, 2, 4]
    tables = store.CatalogueTables(first, touched={"files": reached})
    tables.update(files=listed.where(F.col("root_id").isin(reached)))
    catalogue.write(tables, NOW + 1)
    old, new = (catalogue.read(n)["files"] for n in (0, 1))
    found = store.difference(old, new, ["root_id", "rel_path"])
    return found.select("root_id", "rel_path", "change", F.array_join("columns", ",").alias("columns"))


# ---- manifest -------------------------------------------------------------------------------


def _export_tables(spark, sf) -> dict[str, DataFrame]:
    c = _Catalogue(spark, sf)
    files, known = c.files, cut(c.families)
    blobs = files.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(
        F.max("size").alias("size"), F.lit(None).cast("string").alias("partial_digest")
    )
    declined, aliases = _decisions(known)
    return {
        "roots": view(spark, sf, "v_roots").select(*schemas.ROOTS.names),
        "families": known,
        "blobs": blobs,
        "family_aliases": aliases,
        "declined_merges": declined,
        "files": files.select("root_id", "rel_path", "size", "sha256", "hash_state", "parse_state", "state"),
        "variants": c.variants,
        "file_roles": c.roles,
    }


@query
def export_manifest(spark, sf):
    """The sections whose columns JSON writes the same way everywhere."""
    tables = _export_tables(spark, sf)
    kept = ("roots", "blobs", "family_aliases", "declined_merges", "files")
    return manifest.export_rows({n: tables[n] for n in kept})


@query
def import_manifest(spark, sf):
    """Exports, reads back, maps roots by mount id and puts the files over a changed catalogue."""
    import uuid

    tables = _export_tables(spark, sf)
    path = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    manifest.write_export(tables, path, NOW)
    found = manifest.read_export(spark, path)
    own = view(spark, sf, "v_roots").where(F.col("root_id") != 4).withColumn(
        "root_id", F.col("root_id") + 10
    )
    mapped = manifest.map_roots(found["roots"], own)
    existing = tables["files"].where(F.col("root_id") == 1).select(
        F.lit(11).cast("long").alias("root_id"), "rel_path", F.lit(0).cast("long").alias("size"),
        F.lit(None).cast("string").alias("sha256"), F.lit("none").alias("hash_state"),
        F.lit("ok").alias("parse_state"), F.lit("present").alias("state"),
    )
    return manifest.import_section(existing, found["files"], "files", mapped)
