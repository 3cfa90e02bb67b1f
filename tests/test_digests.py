"""Staged digests, digest trees and broken ranges of real files, and the state after every probe."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import duplicates, evidence
from shelfmark.plans.scan import scan, staged_digests
from shelfmark.session import written
from shelfmark.sources import contents

EDGE = contents.PARTIAL_WINDOW


def listing_of(spark, root, files):
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    rows = [(1, str(root), n, len(d), 0, 0, 0, 0, False, None, True) for n, d in files.items()]
    return spark.createDataFrame(rows, schemas.LISTING)


def noise(seed, size):
    return random.Random(seed).randbytes(size)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Copies, equal sizes with other edges, equal edges with another middle, lone files, small and empty ones."""
    big = noise(1, 4 * EDGE)
    other_middle = big[: 2 * EDGE] + b"!" + big[2 * EDGE + 1 :]
    files = {
        "a/big": big, "a/copy": big, "a/middle": other_middle, "a/edge": b"!" + big[1:], "a/lone": noise(2, 5 * EDGE),
        "b/small": b"small", "b/twin": b"small", "b/other": b"smell", "b/single": b"of its own size", "b/none": b"", "b/void": b"",
        "b/limit": noise(3, 2 * EDGE), "b/limit2": noise(4, 2 * EDGE), "b/over": noise(5, 2 * EDGE + 1),
    }
    return tmp_path_factory.mktemp("tree"), files


KNOWN = "size long, partial_digest string"


def test_each_pass_reads_only_what_is_open(spark, tree):
    root, files = tree
    listed = listing_of(spark, root, files).withColumn("needs_hash", F.lit(True))
    got = {r.rel_path: r for r in staged_digests(listed, spark.createDataFrame([], KNOWN)).collect()}
    assert {n: r.stage for n, r in got.items()} == {
        "a/big": "full", "a/copy": "full", "a/middle": "full", "a/edge": "edges", "a/lone": "size",
        "b/small": "edges", "b/twin": "edges", "b/other": "edges", "b/single": "size", "b/none": "edges", "b/void": "edges",
        "b/limit": "edges", "b/limit2": "edges", "b/over": "size",
    }
    for name, r in got.items():
        data = files[name]
        whole = hashlib.sha256(data).hexdigest()
        assert r.sha256 == (whole if r.stage == "edges" and len(data) <= 2 * EDGE else None)
        assert r.needs_hash == (r.stage == "full")
        assert r.bytes_read == {"size": 0, "edges": min(len(data), 2 * EDGE), "full": 2 * EDGE + len(data)}[r.stage]
    assert sum(r.bytes_read for r in got.values()) < 1.1 * sum(map(len, files.values()))


def test_stored_blobs_keep_files_open(spark, tree):
    root, files = tree
    listed = listing_of(spark, root, files).withColumn("needs_hash", F.col("rel_path") != "a/copy")
    edges = hashlib.sha256(files["a/lone"][:EDGE] + files["a/lone"][-EDGE:]).hexdigest()
    known = spark.createDataFrame([(len(files["a/lone"]), edges), (len(files["b/over"]), None), (None, "x"), (4 * EDGE, "y")], KNOWN)
    stage = {r.rel_path: r.stage for r in staged_digests(listed, known).collect()}
    assert (stage["a/lone"], stage["b/over"], stage["a/copy"]) == ("full", "full", "size")
    assert (stage["a/big"], stage["a/middle"], stage["b/single"]) == ("full", "full", "size")
    no_partial = spark.createDataFrame([(4 * EDGE, None)], KNOWN)
    assert {r.rel_path: r.stage for r in staged_digests(listed, no_partial).collect()}["a/edge"] == "full"


def test_unreadable_file_stays_open(spark, tree):
    root, files = tree
    listed = listing_of(spark, root, files).withColumn("needs_hash", F.lit(True))
    gone = listed.where("rel_path = 'a/big'").withColumn("rel_path", F.lit("a/gone"))
    got = {r.rel_path: r for r in staged_digests(listed.unionByName(gone), spark.createDataFrame([], KNOWN)).collect()}
    assert got["a/gone"].stage == "full" and got["a/gone"].partial_digest is None


def test_gated_scan_finds_the_same_copies(spark, tmp_path):
    big = noise(7, 3 * EDGE)
    files = {"x/m.gguf": big, "y/m.gguf": big, "x/n.gguf": noise(8, 3 * EDGE), "x/lone.gguf": noise(9, 7 * EDGE), "s": b"1", "t": b"1"}
    listing_of(spark, tmp_path, files)
    empty = {n: spark.createDataFrame([], s) for n, s in schemas.TABLES.items()}
    root = [(1, "r", str(tmp_path), "internal", "catalogue", None, True, False, False, 0, 0)]
    empty["roots"] = spark.createDataFrame(root, schemas.ROOTS)
    (full, _), (gated, _) = (scan(dict(empty), 1, 100, gate=g) for g in (False, True))
    groups = [sorted(map(tuple, duplicates.duplicate_groups(t["files"]).drop("dev").collect())) for t in (full, gated)]
    assert groups[0] == groups[1] and len(groups[0]) == 2
    state = {r.rel_path: (r.hash_state, r.sha256) for r in gated["files"].collect()}
    assert state["x/lone.gguf"] == ("none", None) and state["x/n.gguf"] == ("none", None) and state["s"][0] == "full"
    # a copy that comes later meets the file that was not read before
    (tmp_path / "late.gguf").write_bytes(files["x/lone.gguf"])
    again, _ = scan(gated, 2, 200, gate=True)
    assert {r.copies for r in duplicates.duplicate_groups(again["files"]).where("size = 458752").collect()} == {2}


# ---- digest trees ----------------------------------------------------------------------------


def plain_root(data, piece, fan_out):
    level = [hashlib.sha256(b"\0" + data[i : i + piece]).digest() for i in range(0, max(1, len(data)), piece)]
    while len(level) > 1:
        level = [
            level[i] if i == 0 and len(level[:fan_out]) == 1 else hashlib.sha256(b"\1" + b"".join(level[i : i + fan_out])).digest()
            for i in range(0, len(level), fan_out)
        ]
    return level[0].hex()


@pytest.mark.parametrize(("piece", "fan_out"), [(1, 2), (7, 3), (64, 2), (1000, 64), (1 << 20, 64)])
def test_root_equals_a_single_pass(spark, tmp_path, piece, fan_out):
    files = {f"f{n}": noise(n, n) for n in (0, 1, 6, 7, 8, 21, 63, 64, 65, 343)}
    listed = listing_of(spark, tmp_path, files)
    got = contents.root_digests(contents.piece_digests(listed, piece), ["rel_path"], fan_out).collect()
    assert {r.rel_path: r.root_digest for r in got} == {n: plain_root(d, piece, fan_out) for n, d in files.items()}
    assert {r.rel_path: r.pieces for r in got} == {n: max(1, -(-len(d) // piece)) for n, d in files.items()}


def test_one_file_uses_many_tasks(spark, tmp_path):
    listed = listing_of(spark, tmp_path, {"huge": noise(1, 100_000)})
    pieces = contents.piece_digests(listed, 1000, tasks=8)
    assert pieces.select(F.spark_partition_id().alias("p")).distinct().count() >= 6
    assert pieces.count() == 100


def test_broken_ranges_are_named(spark, tmp_path):
    data = noise(1, 10_000)
    listed = listing_of(spark, tmp_path, {"f": data, "g": data, "h": data, "same": data})
    stored = written(contents.piece_digests(listed, 1000))
    (tmp_path / "f").write_bytes(data[:2500] + b"!!" + data[2502:3100] + b"!" + data[3101:7000] + b"?" + data[7001:])
    (tmp_path / "g").write_bytes(data[:6500])
    (tmp_path / "h").unlink()
    got = {(r.rel_path, r.verdict, r.start, r.end, r.pieces) for r in contents.verify_pieces(listed, stored, 1000).collect()}
    assert got == {
        ("f", "different", 2000, 4000, 2), ("f", "different", 7000, 8000, 1),
        ("g", "unreadable", 6000, 10_000, 4), ("h", "unreadable", 0, 10_000, 10),
    }
    short = contents.piece_digests(listed.where("rel_path = 'g'").withColumn("size", F.lit(6500).cast("long")), 1000)
    only = stored.where("rel_path = 'g'")
    ranges = {(r.verdict, r.start, r.end) for r in contents.broken_ranges(short, only, ["rel_path"]).collect()}
    assert ranges == {("different", 6000, 6500), ("missing", 7000, 10_000)}
    assert contents.root_digests(contents.piece_digests(listed, 1000), ["rel_path"]).where("root_digest is null").count() == 2


# ---- probes ----------------------------------------------------------------------------------

PROBES = "root_id long, at long, seq long, failed boolean"


def plain_states(rows, patience):
    out, runs = [], {}
    for root, at, seq, failed in sorted(rows):
        before = runs.get(root, 0)
        runs[root] = before + 1 if failed else 0
        out.append((root, at, seq, failed, runs[root], runs[root] < patience, (before < patience) != (runs[root] < patience)))
    return out


@pytest.mark.parametrize("blocks", [1, 3, 50])
def test_state_after_every_probe(spark, blocks):
    rng = random.Random(blocks)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(40), i, rng.random() < 0.8) for i in range(400)]
    rows += [(4, i, 1000 + i, True) for i in range(90)] + [(5, 7, 2000, False)]
    got = evidence.presence_states(spark.createDataFrame(rows, PROBES), 3, blocks).collect()
    assert sorted(map(tuple, got)) == plain_states(rows, 3)
    assert evidence.presence_states(spark.createDataFrame([], PROBES), 3, blocks).collect() == []


def test_hot_root_lies_in_many_blocks(spark):
    rows = spark.range(40_000).select(
        F.lit(1).cast("long").alias("root_id"), (F.col("id") % 977).alias("at"), F.col("id").alias("seq"), (F.col("id") % 500 != 3).alias("failed")
    )
    states = evidence.presence_states(rows, 3, 16)
    last = evidence.presence_with_patience(rows, 3).first()
    final = states.orderBy(F.desc("at"), F.desc("seq")).first()
    assert (final.failures_in_a_row, final.present) == (last.failures_in_a_row, last.present)
    sizes = states.groupBy(F.spark_partition_id()).count().collect()
    assert states.count() == 40_000
    ok = {(r.at, r.seq): (r.failures_in_a_row, r.changed) for r in states.where("failures_in_a_row < 4").collect()}
    want = {(a, s): (n, c) for _, a, s, _, n, _, c in plain_states([(1, i % 977, i, i % 500 != 3) for i in range(40_000)], 3) if n < 4}
    assert ok == want and len(sizes) >= 1
