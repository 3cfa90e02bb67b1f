"""Snapshots: folders by root, two writers, differences."""

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.sources.store import CatalogueStore, CatalogueTables, SnapshotConflict, difference


def files_of(spark, roots, size=1, each=3):
    rows = [(r, f"f{i}", size, 0, 0, 0, i, False, None, None, "none", "ok", None, "present") for r in roots for i in range(each)]
    return spark.createDataFrame(rows, schemas.FILES)


def first_snapshot(spark, base, roots=(1, 2, 3)):
    store = CatalogueStore(spark, str(base))
    tables = store.read()
    tables["files"] = files_of(spark, roots)
    assert store.write(tables, 0) == 0
    return store


def after_scan(spark, store, roots, size):
    tables = CatalogueTables(store.read(), touched={"files": list(roots)})
    tables.update(files=files_of(spark, roots, size))
    return tables


def test_a_scan_of_one_root_writes_its_folder_only(spark, tmp_path):
    store = first_snapshot(spark, tmp_path)
    assert store.write(after_scan(spark, store, [2], 7), 1) == 1
    assert [p.name for p in (tmp_path / "snapshot=1").iterdir()] == ["files"]
    assert [p.name for p in (tmp_path / "snapshot=1/files").glob("root_id=*")] == ["root_id=2"]
    _, folders = store._log()
    assert folders["files"] == ["snapshot=0/files/root_id=1", "snapshot=0/files/root_id=3", "snapshot=1/files"]
    sizes = lambda n: {(r.root_id, r.size) for r in store.read(n)["files"].collect()}
    assert sizes(1) == {(1, 1), (2, 7), (3, 1)} and sizes(0) == {(1, 1), (2, 1), (3, 1)}
    # a root that is emptied, then a new one; single folders stay as they are
    empty = CatalogueTables(store.read(), touched={"files": [3]})
    empty.update(files=files_of(spark, []))
    assert store.write(empty, 2) == 2 and sizes(2) == {(1, 1), (2, 7)}
    assert store.write(after_scan(spark, store, [5], 9), 3) == 3
    assert sizes(3) == {(1, 1), (2, 7), (5, 9)} and store.read()["files"].count() == 9
    assert store._log()[1]["files"][0] == "snapshot=0/files/root_id=1"
    plan = store.read()["files"].where("root_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(root_id" in plan


def test_only_the_first_of_two_writers_publishes(spark, tmp_path):
    first_snapshot(spark, tmp_path)
    one, two = (CatalogueStore(spark, str(tmp_path)) for _ in range(2))
    mine, theirs = after_scan(spark, one, [1], 11), after_scan(spark, two, [2], 22)
    assert one.write(mine, 1) == 1
    with pytest.raises(SnapshotConflict):
        two.write(theirs, 1)
    got = {(r.root_id, r.size) for r in two.read()["files"].collect()}
    assert got == {(1, 11), (2, 1), (3, 1)}
    assert two.write(after_scan(spark, two, [2], 22), 2) == 2


def test_writers_at_the_same_time(spark, tmp_path, monkeypatch):
    """The other writer publishes after this one has looked, while it writes: no folder is shared."""
    first_snapshot(spark, tmp_path)
    one, two = (CatalogueStore(spark, str(tmp_path)) for _ in range(2))
    mine, theirs = after_scan(spark, one, [1], 11), after_scan(spark, two, [2], 22)
    claim = one._claim

    def other_first(base):
        number = claim(base)
        assert two.write(theirs, 1) == number + 1
        return number

    monkeypatch.setattr(one, "_claim", other_first)
    with pytest.raises(SnapshotConflict):
        one.write(mine, 1)
    assert one.newest() == 2
    assert {(r.root_id, r.size) for r in one.read()["files"].collect()} == {(1, 1), (2, 22), (3, 1)}
    with pytest.raises(Exception):  # never published
        CatalogueStore(spark, str(tmp_path)).read(1)["files"].where("size = 11").first().size
    assert two.write(after_scan(spark, two, [3], 3), 3) == 3


def test_a_writer_that_dies_leaves_the_newest_in_place(spark, tmp_path, monkeypatch):
    store = first_snapshot(spark, tmp_path)
    dying = CatalogueStore(spark, str(tmp_path))
    tables = after_scan(spark, dying, [1], 5)
    monkeypatch.setattr(dying, "_create", lambda path, text: path.startswith("claims") and CatalogueStore._create(dying, path, text))
    with pytest.raises(SnapshotConflict):
        dying.write(tables, 1)  # after the log row, before publishing
    assert store.newest() == 0
    assert store.write(after_scan(spark, store, [1], 6), 2) == 2 and store.newest() == 2


ROWS = "k long, j string, v string, w int"


def test_difference_equals_the_plain_one(spark):
    old = [(1, "a", "x", 1), (2, None, "x", None), (None, "b", None, 2), (4, "d", "y", 1), (5, "e", None, None)]
    new = [(1, "a", "x", 1), (2, None, "z", 3), (None, "b", None, 3), (5, "e", None, None), (6, None, None, None)]
    tables = [spark.createDataFrame(rows, ROWS) for rows in (old, new)]
    got = {(r.k, r.j): (r.change, r.columns) for r in difference(*tables, ["k", "j"]).collect()}
    assert got == {
        (2, None): ("changed", ["v", "w"]), (None, "b"): ("changed", ["w"]), (4, "d"): ("removed", None), (6, None): ("added", None),
    }
    assert difference(tables[0], tables[0], ["k", "j"]).count() == 0
    keys = [t.select("k").where(F.col("k").isNotNull()) for t in tables]
    assert {(r.k, r.change) for r in difference(*keys, ["k"]).collect()} == {(4, "removed"), (6, "added")}
