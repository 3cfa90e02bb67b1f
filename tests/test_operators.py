"""Operators on small tables: hot keys, brute force, and rules the query twins do not reach."""

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions.names import STOP_TOKENS
from shelfmark.operators import audit, duplicates, evidence, merge, reports, wanted
from shelfmark.operators.hot_keys import join_lookup
from shelfmark.plans import queries
from shelfmark.session import cut
from shelfmark.sources import listing, manifest
from tests import payloads as p

FILE = "root_id long, rel_path string, size long, dev long, ino long, sha256 string, hash_state string, state string"


def hot_files(spark, n=30_000):
    """A third of all files are copies of one blob."""
    digest = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), F.col("id")))
    return spark.range(0, n, 1, 8).select(
        (F.col("id") % 5).alias("root_id"), F.concat(F.lit("f"), F.col("id")).alias("rel_path"),
        F.lit(7).cast("long").alias("size"), F.lit(0).cast("long").alias("dev"),
        (F.col("id") % 1000).alias("ino"), digest.alias("sha256"),
        F.lit("full").alias("hash_state"), F.lit("present").alias("state"),
    )


def roots_table(spark):
    return spark.range(5).select(F.col("id").alias("root_id"), F.concat(F.lit("r"), "id").alias("name"),
                                 (F.col("id") < 3).alias("present"))


def test_hot_digest_is_counted_whole(spark):
    group = duplicates.duplicate_groups(hot_files(spark)).collect()
    assert [(g.sha256, g.copies, g.allocations, g.reclaimable_bytes) for g in group] == [
        ("hot", 10_000, 1000, 999 * 7)]
    plan = duplicates.duplicate_groups(hot_files(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") and "collect_list" not in plan and "Window" not in plan


def test_hot_digest_is_split_in_the_join(spark):
    """Without a broadcast, the rows of the hot digest still arrive in many partitions."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        groups = duplicates.duplicate_groups(hot_files(spark)).select("sha256", "copies")
        joined = join_lookup(hot_files(spark), groups, ["sha256"], "inner")
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 10_000
        assert max(r["count"] for r in sizes) < 4_000
        copies = duplicates.duplicate_copies(hot_files(spark), roots_table(spark))
        assert copies.count() == 10_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def brute_force(families):
    def tokens(key):
        parts = key.split("|")[0].split("-")
        return [t for t in parts if t and t not in STOP_TOKENS
                and not (t.endswith("b") and t[:-1].replace(".", "", 1).isdigit() and t[0] != ".")]

    found = set()
    for i, (ka, arch_a, pa) in enumerate(families):
        for kb, arch_b, pb in families[i + 1 :]:
            ta, tb = tokens(ka), tokens(kb)
            shared = sum(t in tb for t in ta)
            if arch_a != arch_b or not shared:
                continue
            near = pa is not None and pb is not None and max(pa, pb) > 0 and abs(pa - pb) / max(pa, pb) <= 0.15
            score = shared / (len(ta) + sum(t not in ta for t in tb))
            found.add((ka, kb, "params" if near else "name", shared, round(score, 9)))
    return found


def test_merge_suggestions_equal_all_pairs(spark):
    words = ["red", "blue", "big", "red-red", "base", "7b", "ring-7.5b", "", "big-blue-red"]
    families = []
    for i, word in enumerate(w + x for w in words for x in ("", "-chat", "-ring", "-red-blue")):
        arch = (None, "llama", "qwen")[i % 3] if i % 5 else "llama"
        families.append((f"{word}|{arch}|t{i}|a", arch, (None, 0.0, float(i), 10.0)[i % 4]))
    rows = [(k, "n", a, t, None, None, "llm", 1, f"{i:04d}", "1") for i, (k, a, t) in enumerate(families)]
    df = spark.createDataFrame(rows, schemas.FAMILIES).repartition(7)
    none = (spark.createDataFrame([], schemas.DECLINED_MERGES), spark.createDataFrame([], schemas.FAMILY_ALIASES))
    got = merge.merge_suggestions(df, *none).collect()
    assert len(got) == len({frozenset((r.a_key, r.b_key)) for r in got})
    assert {(r.a_key, r.b_key, r.reason, r.shared_tokens, round(r.score, 9)) for r in got} == brute_force(families)


def test_alias_chains_end_and_circles_are_reported(spark):
    links = [(f"k{i + 1}", f"k{i}", "user") for i in range(40)] + [("x", "y", "u"), ("y", "x", "u"), ("x", "z", "u")]
    aliases = spark.createDataFrame(links, schemas.FAMILY_ALIASES)
    resolved = merge.resolve_aliases(aliases)
    assert {r.alias: r.family_key for r in resolved.collect()} == {f"k{i}": "k40" for i in range(40)}
    assert {r.alias for r in merge.alias_circles(aliases, resolved).collect()} == {"x", "y", "z"}
    rows = [(f"k{i}", f"n{i}", None, None, None, None, "llm", 1, str(i), "1") for i in (0, 5, 40)]
    families = spark.createDataFrame(rows, schemas.FAMILIES)
    assert [(r.family_key, r.name) for r in merge.merged_families(families, resolved).collect()] == [("k40", "n40")]


def test_nested_roots(spark):
    paths = ["/data/models", "/data/models2", "/data/models/deep/er", "/mnt", "/srv/x/", "/srv/x/y"]
    df = spark.createDataFrame([(x,) for x in paths], "path string")
    found = {(r.subject, r.detail) for r in audit.nested_roots(df).collect()}
    assert found == {("/data/models/deep/er", "/data/models"), ("/srv/x/y", "/srv/x")}
    root = df.unionByName(spark.createDataFrame([("/",)], "path string"))
    assert audit.nested_roots(root).where("detail = '/'").count() == len(paths)


@pytest.mark.parametrize("log, absent", [("ff", False), ("fff", True), ("fffo", False), ("offf", True),
                                         ("ffof", False), ("fofff", True), ("o", False)])
def test_patience(spark, log, absent):
    rows = [(1, 100 + i, i, c == "f") for i, c in enumerate(log)]
    probes = spark.createDataFrame(rows, "root_id long, at long, seq long, failed boolean")
    assert evidence.presence_with_patience(probes, 3).first().present == (not absent)


def test_external_never_overrides(spark):
    rows = [(1, "family", "k", "name", "a", "inferred", "filename", 1), (2, "family", "k", "name", "b", "external", "hub", 2),
            (3, "family", "k", "arch", "x", "known", "content", 3), (4, "family", "k", "arch", "y", "manual", "user", 4)]
    best = evidence.resolve_truth(spark.createDataFrame(rows, schemas.EVIDENCE))
    assert {r.field: r.value for r in best.collect()} == {"name": "a", "arch": "y"}


def test_manifest_refuses_other_keys_and_missing_decisions(spark, tmp_path):
    tables = {n: spark.createDataFrame([], schemas.TABLES[n]) for n in ("family_aliases", "declined_merges", "roots")}
    good = str(tmp_path / "good")
    manifest.write_export(tables, good, 1)
    assert set(manifest.read_export(spark, good)) == set(tables)
    del tables["declined_merges"]
    manifest.write_export(tables, str(tmp_path / "short"), 1)
    with pytest.raises(ValueError, match="export.incomplete"):
        manifest.read_export(spark, str(tmp_path / "short"))
    head = spark.read.schema("section string, key string, payload string").json(good)
    other = head.withColumn("payload", F.replace("payload", F.lit('"family_key_algo":"1"'), F.lit('"family_key_algo":"0"')))
    other.write.partitionBy("section").json(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="export.algo_mismatch"):
        manifest.read_export(spark, str(tmp_path / "other"))


def test_roots_are_matched_by_mount_only(spark):
    old = spark.createDataFrame([(1, "u1"), (2, None), (3, "u3")], "root_id long, mount_id string")
    own = spark.createDataFrame([(11, "u1"), (12, None)], "root_id long, mount_id string")
    rows = {r.root_id: (r.own_root_id, r.problem) for r in manifest.map_roots(old, own).collect()}
    assert rows == {1: (11, None), 2: (None, "root.no_mount_id"), 3: (None, "root.not_found")}


def test_walk_depth_and_names(spark, tmp_path):
    p.write(tmp_path, {"a/b/c.gguf": b"1", "a/_x": b"2", ".hid/y": b"3", "top": b"4"})
    with open(tmp_path.as_posix().encode() + b"/bad\xff", "wb") as out:
        out.write(b"5")
    roots = spark.createDataFrame([(1, str(tmp_path))], "root_id long, path string")
    entries = listing.walk(roots, max_depth=1)
    assert sorted(r.rel_path for r in listing.list_files(entries).collect()) == [".hid/y", "a/_x", "top"]
    assert sorted(r.reason for r in listing.skipped(entries).collect()) == ["skipped_deep", "skipped_non_utf8"]


def test_force_lifts_only_ownership(spark):
    row = ("h|r|v|a.gguf", "h", "r", "v", "a.gguf", 1, "d", "open", None, 1)
    items = spark.createDataFrame([row, ("h|r|v|b", "h", "r", "v", "../b", 1, "d", "open", None, 1)], schemas.WANTED)
    owned = spark.createDataFrame([("d",)], "sha256 string")
    tasks = spark.createDataFrame([], schemas.FETCH_TASKS)
    failed = {r.remote_key: r.failed for r in wanted.fetch_eligibility(items, owned, tasks, force=True).collect()}
    assert failed == {"h|r|v|a.gguf": [], "h|r|v|b": ["fetch.path_invalid"]}


def test_ladder_shows_holes(spark):
    have = spark.createDataFrame([("f", "Q4_K_M")], "family_key string, quant string")
    holes = spark.createDataFrame([("f", "Q4_K_M", "open"), ("f", "Q8_0", "open"), ("f", "Q5_0", "satisfied")],
                                  "family_key string, quant string, status string")
    row = reports.quant_ladder(have, holes).first()
    assert (row["Q4_K_M"], row["Q8_0"], row["Q5_0"]) == ("have", "wanted", None)


def test_reports_ignore_order_and_partitions(spark):
    files = hot_files(spark, 3000)
    one = duplicates.duplicate_copies(files.coalesce(1), roots_table(spark)).collect()
    many = duplicates.duplicate_copies(files.repartition(13), roots_table(spark)).collect()
    assert sorted(one) == sorted(many)
    totals = duplicates.duplicate_totals(files).first()
    assert totals.reclaimable_bytes <= 3000 * 7


def test_gate_keeps_every_file(spark):
    rows = [(1, 5, "a"), (2, 5, "a"), (3, 5, "b"), (4, None, "a"), (5, 5, None), (6, None, None)]
    got = duplicates.hash_gate(spark.createDataFrame(rows, "id long, size long, partial_digest string"))
    assert {r.id: r.collides for r in got.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_ladder_has_every_quantisation(spark):
    rows = [("m", "Q4_1_SOME_F16"), ("m", "unknown"), ("n", "Q4_K_M")]
    got = {r.family_key: r.asDict() for r in reports.quant_ladder(spark.createDataFrame(rows, "family_key string, quant string")).collect()}
    assert got["m"]["Q4_1_SOME_F16"] == got["m"]["unknown"] == "have" and got["n"]["Q4_K_M"] == "have"


def test_search_cuts_words_like_the_catalogue(spark):
    families = spark.createDataFrame(
        [("modele-x", "Mod\u00e8le X", "llama", "llm", 1.0)], "family_key string, name string, arch string, kind string, params_total double")
    none = lambda schema: spark.createDataFrame([], schema)
    tokens = reports.search_tokens(
        families, none("family_key string, alias string"), none("entity_type string, entity_key string, tag string"),
        none("subject_type string, subject_key string, repo string"))
    for query, n in (("Mod\u00e8le", 1), ("mod\u00e8le x!", 1), ("--", 1), ("other", 0)):
        assert reports.search(families, tokens, query).count() == n, query


def test_open_hole_is_not_hidden_by_another_monitor(spark):
    values = {f.name: None for f in schemas.WANTED.fields}
    row = lambda key, status: tuple((values | {"remote_key": key, "status": status})[f.name] for f in schemas.WANTED.fields)
    swept = spark.createDataFrame(
        [row("a", "satisfied"), row("a", "open"), row("b", "open"), row("b", "skipped_have_bytes"), row("c", "satisfied")], schemas.WANTED)
    stored = spark.createDataFrame([row("c", "open")], schemas.WANTED)
    got = {r.remote_key: r.status for r in wanted.upsert_wanted(stored, swept.drop("swept_at"), 9).collect()}
    assert got == {"a": "open", "b": "skipped_have_bytes", "c": "satisfied"}


def test_suggestions_for_asked_families_only(spark):
    rows = [("foo-bar|x", "x", 1.0, 1, "a"), ("foo-baz|x", "x", 1.1, 1, "b"), ("foo-qux|x", "x", 9.0, 1, "c"), ("foo-bar-baz|x", "x", 1.0, 1, "d")]
    families = spark.createDataFrame(rows, "family_key string, arch string, params_total double, first_root_id long, first_rel_path string")
    no = spark.createDataFrame([], schemas.DECLINED_MERGES)
    aliases = spark.createDataFrame([], "family_key string, alias string")
    pairs = lambda df: {(r.a_key, r.b_key, r.reason) for r in df.collect()}
    every = pairs(merge.merge_suggestions(families, no, aliases))
    asked = spark.createDataFrame([("foo-qux|x",), ("none",)], "family_key string")
    assert pairs(merge.merge_suggestions(families, no, aliases, asked=asked)) == {p for p in every if "foo-qux|x" in p[:2]}
    assert len(every) == 6


def test_files_of_one_task_are_dealt_out_before_they_give_facts(spark, tmp_path):
    parts = [(i, f"red ring {i}", "Brand#1", "LARGE", 7, 1.0) for i in range(200)]
    columns = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(parts, columns).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    identified = queries._identified(spark, str(tmp_path))
    tasks = identified.select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = cut(identified.coalesce(1))
    found = evidence.evidence_rows(one)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.rfind("hashpartitioning(root_id") > plan.rfind("SortAggregate") > 0  # below the first sort of facts
    rows = {tuple(r) for r in found.collect()}
    assert rows == {tuple(r) for r in evidence.evidence_rows(cut(identified)).collect()} and len(rows) > 200
