"""Pivot index: exact links where it claims them, recall on vectors near the threshold."""

import math

import duckdb
import numpy as np

from shelfmark.llm import pivots
from tests.llm.helpers import table

SCHEMA = "vec_id long, embedding array<float>, label int, cid string, n_links string"


def frame(spark, rows):
    return table(spark, [(i, None if v is None else [None if x is None else float(x) for x in v], k, "x", "y") for i, v, k in rows], SCHEMA)


def brute(rows, threshold=0.93):
    ok = lambda v, k: k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    good = [ok(v, k) for _, v, k in rows]
    unit = [np.array(v, dtype=np.float32).astype(float) / np.linalg.norm(np.array(v, dtype=np.float32).astype(float)) if g else None for (_, v, _), g in zip(rows, good)]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                if unit[i] @ unit[j] >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    return links


def component(links, rows, i):
    seen, todo = {i}, [i]
    while todo:
        for j in links[todo.pop()] - seen:
            seen.add(j)
            todo.append(j)
    return min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)


def test_clusters_copies_and_odd_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    center = rng.normal(size=16)
    rows = [(i, (center + rng.normal(size=16) * 0.05).tolist(), 1) for i in range(40)]  # a long list
    rows += [(100 + i, center.tolist(), 1 + i % 2) for i in range(30)]  # copies, in two labels
    rows += [(200 + i, rng.normal(size=16).tolist(), i % 3) for i in range(60)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [], 1), (303, [math.nan] + [1.0] * 15, 1),
             (304, [math.inf] + [1.0] * 15, 1), (305, [None] + [1.0] * 15, 1), (306, center.tolist(), None),
             (307, center[:8].tolist(), 1), (308, (center * 1e3).tolist(), 1), (308, (center * 1e3).tolist(), 1)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]
    links = brute(rows)
    got = pivots.near_duplicates(frame(spark, rows), part=16).collect()
    mine = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got)
    wanted = sorted((rows[i][0], len(links[i]), c := component(links, rows, i), c == rows[i][0]) for i in links)
    assert mine == wanted


def test_recall_near_the_threshold(spark):
    """Pairs at cosines of 0.93 to 0.97, the hardest for the index, in a noise of other vectors."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=64).tolist(), 0) for i in range(1500)]
    for i in range(300):
        a = np.array(rows[i][1])
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.931, 0.97)
        rows.append((2000 + i, (c * a + math.sqrt(1 - c * c) * b).tolist(), 0))
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(frame(spark, rows)).collect()}
    links = brute(rows)
    true = sum(map(len, links.values()))
    found = sum(got.values())
    assert all(got[rows[i][0]] <= len(links[i]) for i in links)
    assert found >= 0.9 * true and true >= 600


def test_empty_and_null_ids(spark):
    assert pivots.near_duplicates(frame(spark, [])).collect() == []
    got = pivots.near_duplicates(frame(spark, [(None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (None, None, 1)])).collect()
    assert sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in got) == [
        (-1, 0, None, False), (-1, 1, 4, False), (4, 1, 4, True)]


def test_sql_twin_runs():
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings AS SELECT 1::BIGINT AS vec_id, [1, 0]::FLOAT[] AS embedding, 1 AS label")
    assert con.execute(pivots.ORACLE_SQL).fetchall() == [(1, 0, 1, True)]


def test_a_group_of_a_third_of_the_rows_is_whole(spark):
    """Near, not equal, copies around one centre, at two sizes."""
    for n in (600, 2400):
        rng = np.random.default_rng(n)
        center = rng.normal(size=64)
        rows = [(i, (center + rng.normal(size=64) * 0.23).tolist(), 0) for i in range(n // 3)]
        rows += [(n + i, rng.normal(size=64).tolist(), 0) for i in range(n - n // 3)]
        unit = np.array([np.float32(v) for _, v, _ in rows], dtype=float)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        true = (unit @ unit.T >= 0.93).sum(axis=1) - 1
        got = {r.vec_id: r for r in pivots.near_duplicates(frame(spark, rows)).collect()}
        assert all(got[i].n_links <= k for (i, _, _), k in zip(rows, true))
        assert sum(r.n_links for r in got.values()) >= 0.99 * true.sum() > 0
        assert {got[i].component_id for i in range(n // 3) if true[i]} == {0}
