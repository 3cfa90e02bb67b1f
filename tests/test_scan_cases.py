"""The identity case book, end to end: one folder per case, scanned together as roots of one catalogue.

Every case uses its own architecture, so its families can be told apart. Between the first and the
second scan some folders change.
"""

import os

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import duplicates, merge, reports
from shelfmark.plans.scan import scan
from shelfmark.session import cut
from shelfmark.sources.store import CatalogueStore
from tests import payloads as p

CASES = ("f1", "f2", "f3", "f5", "h3", "r2", "r3", "r4", "s1", "s2", "s3", "s4", "u1", "u2", "u3",
         "m2", "calm", "drive", "role")
ROOT = {case: i for i, case in enumerate(CASES, start=1)}


def salt(n: int):
    return [("n", 4, bytes([n, 0, 0, 0]))]


def files_before() -> dict[str, dict[str, bytes]]:
    same, copy = p.model("f2", basename="qwen"), p.model("f3", basename="Qwen3-8B", tensors=[(4, 2)])
    return {
        "f1": {f"{n}.gguf": p.model("f1", basename="Qwen3-Coder", file_type=q) for n, q in
               [("qwen3-coder-q4", 15), ("Qwen3-Coder-30B-Q5_K_M", 17), ("Qwen3-Coder-30B-Q8", 7)]},
        "f2": {"a/qwen.gguf": same, "b/qwen-copy.gguf": same},
        "f3": {"hub/models--x/snapshots/1/a.gguf": copy, "models/renamed.gguf": copy},
        "f5": {"qwen3-coder-q4.gguf": p.model("f5", basename="q", file_type=15),
               "qwen3-coder-q5.gguf": p.model("f5", basename="q", file_type=17)},
        "h3": {"model.gguf": p.model("h3", basename="aaaa")},
        "r2": {f"m/big-Q4_K_M-0000{i}-of-00002.gguf": p.model("r2", extra=salt(i)) for i in (1, 2)},
        "r3": {f"qwen3-coder-30b-{n}.gguf": p.model("r3", basename="qwen3-coder", extra=salt(i))
               for i, n in enumerate(("q4", "mmproj"))},
        "r4": {"style-lora.gguf": p.model("r4", basename="style")},
        "s1": {"Qwen3-30B-A3B-Q4_K_M.gguf": p.model("s1", basename="qwen3-30b", active=3.0),
               "Qwen3-32B-Q4_K_M.gguf": p.model("s1", basename="qwen3-32b", active=32.0)},
        "s2": {f"{n}-8B-Instruct-Q4_K_M.gguf": p.model("s2", basename=f"{n}-8B-Instruct")
               for n in ("Foo", "Bar")},
        "s3": {f"{n}.gguf": p.model("s3", basename=b) for n, b in
               [("Foo-Instruct", "Foo"), ("Foo-Base", "Foo"), ("Bar-Base", "Bar-Base")]},
        "s4": {"qwen3-coder-30b-q4_k_m-bartowski.gguf": p.model("s4", basename="q"),
               "qwen3-coder-30b-q4_k_m.gguf": p.model("s4", basename="q", extra=salt(1))},
        "u1": {"random.safetensors": p.safetensors(b"{}")},
        "u2": {"a.bin": b"\x80\x04pickle", "b.log": b"hello", "c-Q4_K_M.pt": b"x" * 20},
        "u3": {"m.gguf.part": p.model("u3", basename="m"), "x.crdownload": b"1"},
        "m2": {f"q-{i}.gguf": p.model("m2", basename=f"qwen-{i}") for i in ("one", "two", "three")},
        "calm": {"x/m.gguf": p.model("calm", basename="m"), "z.txt": b"z",
                 ".hidden/_n.gguf": p.model("calm", basename="n")},
        "drive": {"m.gguf": p.model("drive", basename="m"), "n.gguf": p.model("drive", basename="n")},
        "role": {"m.gguf": p.model("role", basename="m")},
    }


def change_folders(top) -> None:
    os.remove(top / "f5/qwen3-coder-q5.gguf")
    os.remove(top / "f2/b/qwen-copy.gguf")
    os.link(top / "f2/a/qwen.gguf", top / "f2/b/qwen-copy.gguf")
    before = os.stat(top / "h3/model.gguf")
    with open(top / "h3/model.gguf", "r+b") as f:
        f.write(p.model("h3", basename="bbbb"))
    os.utime(top / "h3/model.gguf", ns=(before.st_atime_ns, before.st_mtime_ns))
    (top / "role/m.gguf").write_bytes(b"GGUF\1\0\0\0")
    (top / "drive").rename(top / "unplugged")


class Catalogue:
    def __init__(self, tables, report):
        self.tables = {n: cut(t) if n != "roots" else t for n, t in tables.items() if n in
                       ("roots", "files", "blobs", "families", "variants", "revisions", "file_roles",
                        "evidence", "scan_runs", "declined_merges", "family_aliases")}
        self.reports = {r.root_id: r.asDict() for r in report.collect()}

    def __getattr__(self, name):
        return self.tables[name]

    def report(self, case):
        return self.reports[ROOT[case]]

    def of(self, table, case):
        """Rows of one case: by root where a table has roots, else by architecture in the key."""
        df = self.tables[table]
        if "root_id" in df.columns:
            return df.where(F.col("root_id") == ROOT[case])
        return df.where(F.split("family_key", r"\|")[1] == case)


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def scans(spark, tmp_path_factory):
    quick = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN",
             "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k, None) for k in quick}
    for k, v in quick.items():
        spark.conf.set(k, v)
    top = tmp_path_factory.mktemp("roots")
    for case, files in files_before().items():
        p.write(top / case, files)
    os.symlink(top / "calm/x/m.gguf", top / "calm/link.gguf")
    os.symlink(top / "calm/x", top / "calm/dirlink")
    os.symlink(top / "nowhere", top / "calm/broken")
    rows = [(ROOT[c], c, str(top / c), "internal", "catalogue", f"uuid-{c}", None, False, False, None, None)
            for c in CASES]
    store = CatalogueStore(spark, str(tmp_path_factory.mktemp("catalogue")))
    assert store.newest() is None
    empty = store.read()
    empty["roots"] = spark.createDataFrame(rows, schemas.ROOTS).coalesce(1)
    assert store.write(empty, written_at=0) == 0
    found = []
    for seq in (1, 2):
        if seq == 2:
            change_folders(top)
        tables, report = scan(store.read(), scan_seq=seq, now=1000 + seq, active_key=p.ACTIVE_KEY)
        assert store.write(tables, written_at=1000 + seq) == seq
        found.append(Catalogue(store.read(), report))
    # A snapshot that was never published is not seen.
    store.read()["files"].write.parquet(f"{store.base}/snapshot=3/files")
    assert store.newest() == 2 and store.read(1)["scan_runs"].count() == len(CASES)
    # what did not change keeps its folder, and what only grows gets its new rows
    _, folders = store._log()
    assert folders["monitors"] == ["snapshot=0/monitors"]
    # the root that was away keeps its folder too
    assert folders["files"] == [f"snapshot=1/files/root_id={ROOT['drive']}", "snapshot=2/files"]
    assert folders["evidence"] == [f"snapshot={n}/evidence" for n in range(3)]
    for name in ("evidence", "scan_runs"):
        parts = [spark.read.parquet(f"{store.base}/{f}").count() for f in folders[name]]
        assert store.read()[name].count() == sum(parts) and sum(parts) > parts[-1]
    yield found
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_f1_three_quants_one_family(scans):
    one, _ = scans
    assert values(one.of("families", "f1"), "name", "family_key") == [
        ("Qwen3-Coder", "qwen3-coder|f1|t0|aunk")]
    assert values(one.of("variants", "f1"), "quant") == [("Q4_K_M",), ("Q5_K_M",), ("Q8_0",)]
    report = one.report("f1")
    assert (report["files_new"], report["families_new"], report["files_gone"]) == (3, 1, 0)
    quants = one.evidence.where("field = 'quant' and subject_key like '%|f1|%'")
    assert values(quants, "value", "level", "source") == [
        (q, "known", "content") for q in ("Q4_K_M", "Q5_K_M", "Q8_0")]


def test_f2_same_bytes_and_hard_link(scans):
    one, two = scans
    assert one.of("families", "f2").count() == 1 and one.of("files", "f2").count() == 2
    size = len(files_before()["f2"]["a/qwen.gguf"])
    total = duplicates.duplicate_totals(one.of("files", "f2")).first()
    assert (total.groups, total.reclaimable_files, total.reclaimable_bytes) == (1, 1, size)
    group = duplicates.duplicate_groups(two.of("files", "f2")).first()
    assert (group.copies, group.allocations, group.reclaimable_bytes) == (2, 1, 0)


def test_f3_cache_copy_is_one_family(scans):
    one, _ = scans
    assert one.of("families", "f3").count() == 1 and one.of("variants", "f3").count() == 1
    assert values(one.of("families", "f3"), "params_total") == [(8.0,)]


def test_f5_deleted_file(scans):
    _, two = scans
    assert two.report("f5")["files_gone"] == 1
    assert values(two.of("files", "f5"), "rel_path", "state") == [
        ("qwen3-coder-q4.gguf", "present"), ("qwen3-coder-q5.gguf", "missing")]
    gone = two.of("files", "f5").where("state = 'missing'").first()
    assert (gone.sha256, gone.hash_state) == (None, "none")
    assert two.of("file_roles", "f5").count() == 1
    view = reports.variant_view(two.of("variants", "f5"), two.file_roles, two.files, two.roots)
    assert [(r.quant, r.present, r.bytes > 0) for r in view.collect()] == [
        ("Q4_K_M", True, True), ("Q5_K_M", False, False)]


def test_h1_h2_quick_scan_owns_nothing_unless_the_name_is_trusted(spark, scans, tmp_path):
    digest = "ab" * 32
    p.write(tmp_path, {"model.gguf": p.model(basename="m"), f"blobs/sha256-{digest}": b"GGUF"})
    tables = {n: spark.createDataFrame([], s) for n, s in schemas.TABLES.items()}
    row = (1, "r", str(tmp_path), "internal", "catalogue", "u", None, False, False, None, None)
    tables["roots"] = spark.createDataFrame([row], schemas.ROOTS)
    unknown, _ = scan(tables, 1, 1, quick=True, trust_digest_names=True)
    assert unknown["files"].where("sha256 is not null").count() == 0
    blob = schemas.BLOBS
    for size, owned in ((5, 0), (4, 1)):
        row = {f.name: None for f in blob.fields} | {"sha256": digest, "size": size}
        tables["blobs"] = spark.createDataFrame([tuple(row[f.name] for f in blob.fields)], blob)
        after, report = scan(tables, 1, 1, quick=True, trust_digest_names=True)
        assert after["files"].where("sha256 is not null").count() == owned
    asked = after["files"].select("root_id", "rel_path")
    assert values(duplicates.have_bytes(asked, after["files"]), "rel_path", "have_bytes") == [
        (f"blobs/sha256-{digest}", True), ("model.gguf", False)]
    assert values(after["files"], "hash_state", "sha256") == [("full", digest), ("none", None)]
    assert values(after["families"], "family_key") == [("m|qwen3|t0|aunk",)]
    assert values(after["revisions"], "rev_label") == [("local:none",)]
    assert report.first().files_unverified == 1


def test_h3_stale_stat_is_hashed_again(scans):
    one, two = scans
    before, after = one.of("files", "h3").first(), two.of("files", "h3").first()
    assert (before.size, before.mtime, before.ino) == (after.size, after.mtime, after.ino)
    assert two.report("h3")["files_changed"] == 0 and before.sha256 != after.sha256
    assert two.blobs.where(F.col("sha256").isin(before.sha256, after.sha256)).count() == 2


def test_r2_split_gguf_is_one_shard_set(scans):
    one, _ = scans
    assert values(one.of("families", "r2"), "family_key") == [("big|r2|tunk|aunk",)]
    row = reports.shard_sets(one.of("files", "r2")).first()
    assert (row.dir, row.base, row.parts_found, row.complete) == ("m", "big-Q4_K_M", 2, True)


def test_r3_mmproj_rides_the_family(scans):
    one, _ = scans
    key = one.of("families", "r3").first().family_key
    assert values(one.of("file_roles", "r3"), "role", "family_key") == [("mmproj", key), ("weights", key)]


def test_r4_lora_without_base_is_no_family(scans):
    one, _ = scans
    assert one.of("families", "r4").isEmpty()
    assert values(one.of("file_roles", "r4"), "role", "family_key") == [("lora", None)]


def test_s1_s2_suggestions(scans):
    one, _ = scans
    none = one.declined_merges, one.family_aliases
    found = merge.merge_suggestions(one.of("families", "s1"), *none).collect()
    assert [(r.a_key, r.b_key, r.reason, r.shared_tokens, r.score) for r in found] == [
        ("qwen3-30b|s1|t0|a3", "qwen3-32b|s1|t0|a32", "name", 1, 1.0)]
    assert one.of("families", "s2").count() == 2
    assert merge.merge_suggestions(one.of("families", "s2"), *none).isEmpty()


def test_s3_s4_variant_axes(scans):
    one, _ = scans
    assert one.of("families", "s3").count() == 2
    foo = one.of("variants", "s3").where("family_key like 'foo|%'")
    assert values(foo, "subflavour") == [("base",), ("instruct",)]
    assert one.of("families", "s4").count() == 1
    assert values(one.of("variants", "s4"), "publisher") == [("bartowski",), ("unknown",)]


def test_u1_unknown_safetensors(scans):
    one, _ = scans
    files, roles = one.of("files", "u1"), one.of("file_roles", "u1")
    inbox = reports.unknown_inbox(files, roles)
    assert values(inbox, "rel_path", "parse_state") == [("random.safetensors", "ok")]
    home = reports.home_counts(one.of("families", "u1"), one.evidence, files, roles).first()
    assert (home.families, home.unknown_files, home.unverified_files) == (0, 1, 0)


def test_u2_pickles_are_never_opened_as_models(scans):
    one, _ = scans
    assert values(one.of("files", "u2"), "rel_path", "parse_state") == [
        ("a.bin", "ok"), ("b.log", "unsupported"), ("c-Q4_K_M.pt", "ok")]
    assert one.report("u2")["files_unsupported"] == 1
    assert values(one.of("file_roles", "u2"), "rel_path", "family_key") == [
        ("c-Q4_K_M.pt", "c-pt|unk|tunk|aunk")]


def test_u3_partial_downloads(scans):
    one, _ = scans
    assert values(one.of("files", "u3"), "parse_state") == [("partial",), ("partial",)]
    assert one.of("families", "u3").isEmpty()


def test_m1_m2_decided_pairs_are_silent(spark, scans):
    one, _ = scans
    keys = {i: f"qwen-{i}|m2|t0|aunk" for i in ("one", "two", "three")}
    asked = spark.createDataFrame([(keys["two"], keys["one"], "1"), (keys["one"], keys["two"], "1")],
                                  "a_key string, b_key string, algo_version string")
    declined = merge.decline_pairs(one.declined_merges, asked, 5)
    assert values(declined, "family_a_key", "family_b_key") == [(keys["one"], keys["two"])]
    aliases = spark.createDataFrame([(keys["one"], keys["three"], "user")], schemas.FAMILY_ALIASES)
    families = one.of("families", "m2")
    found = merge.merge_suggestions(families, declined, aliases)
    assert [{r.a_key, r.b_key} for r in found.collect()] == [{keys["two"], keys["three"]}]
    assert merge.merge_suggestions(families, declined, aliases, algo_version="2").count() == 2


def test_offline_root_changes_no_file_row(scans):
    one, two = scans
    report = two.report("drive")
    assert report["root_offline"] and report["files_gone"] == 0
    columns = schemas.FILES.names
    assert values(two.of("files", "drive"), *columns) == values(one.of("files", "drive"), *columns)
    assert values(two.of("roots", "drive"), "present", "last_scan_at") == [(False, 1001)]


def test_second_scan_changes_nothing(scans):
    one, two = scans
    first, report = one.report("calm"), two.report("calm")
    assert (first["files_seen"], first["files_new"], first["skipped_symlink_dirs"]) == (5, 4, 1)
    assert (first["files_unverified"], first["files_unsupported"]) == (1, 1)
    link = one.of("files", "calm").where("is_symlink").first()
    assert (link.hash_state, link.parse_error) == ("none", "symlink")
    assert [report[c] for c in ("files_new", "files_changed", "files_gone", "families_new")] == [0] * 4
    for name in ("files", "families", "revisions", "variants", "file_roles"):
        columns = one.tables[name].columns
        assert values(one.of(name, "calm"), *columns) == values(two.of(name, "calm"), *columns), name
    about = "subject_key like '%|calm|%'"
    assert one.evidence.where(about).count() == two.evidence.where(about).count() > 0


def test_file_that_stops_parsing_keeps_its_role(scans):
    one, two = scans
    row = two.of("files", "role").first()
    assert (row.parse_state, row.parse_error) == ("unsupported", "gguf.unsupported_version")
    assert two.report("role")["files_changed"] == 1
    assert values(one.of("file_roles", "role"), "role") == values(two.of("file_roles", "role"), "role")
