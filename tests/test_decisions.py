"""Merge pairs that follow changes, a lower score bound, imported decisions, and search filters."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import merge, reports
from shelfmark.plans import queries
from tests.test_operators import brute_force

FAMILY = "family_key string, name string, arch string, params_total double, first_root_id long, first_rel_path string"
WORDS = ["red", "blue", "chat", "code", "mini", "vision", "tiny", "model", "model", "model"]


def families_of(seed, n=60):
    rng = random.Random(seed)
    rows = {}
    for i in range(n):
        name = "-".join(rng.choices(WORDS, k=rng.randint(1, 5)))
        arch = rng.choice(["llama", "qwen", None])
        rows[f"{name}|{arch}|t{i % 4}|a{i}"] = (name, arch, rng.choice([None, 0.0, 7.0, 7.5, 30.0]), i % 3, f"p{i}")
    return rows


def table(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], FAMILY)


def pairs(df):
    return sorted((r.a_key, r.b_key, r.reason, r.shared_tokens, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("least", [None, 0.5])
def test_followed_pairs_equal_a_full_sweep_after_three_changes(spark, least):
    rng = random.Random(3)
    rows = families_of(1)
    stored = merge.likely_pairs(table(spark, rows), least_score=least)
    for step in range(3):
        now = dict(rows)
        for key in rng.sample(sorted(now), 8):
            del now[key]
        for key in rng.sample(sorted(now), 8):
            name, arch, total, root, path = now[key]
            now[key] = rng.choice([(name, "gemma", total, root, path), (name, arch, 99.0, root, path), (name, arch, total, root + 5, path)])
        now |= {k + "x": v for k, v in families_of(10 + step, 10).items()}
        before, after = table(spark, rows), table(spark, now)
        stored = spark.createDataFrame(
            merge.follow_pairs(stored, before, after, least).collect(), stored.schema
        )
        assert pairs(stored) == pairs(merge.likely_pairs(after, least_score=least)) and len(pairs(stored)) > 10
        rows = now
    assert merge.changed_families(table(spark, rows), table(spark, rows)).count() == 0


@pytest.mark.parametrize("least", [0.2, 0.5, 0.75, 1.0])
def test_score_bound_loses_no_pair(spark, least):
    families = table(spark, families_of(5, 120))
    whole = [p for p in pairs(merge.likely_pairs(families)) if p[4] >= least - 1e-12]
    assert pairs(merge.likely_pairs(families, least_score=least)) == whole


ALIAS = "family_key string, alias string, source string"


def imported(spark, own, declined, other, other_declined):
    tables = [
        spark.createDataFrame([(b, a, "s") for a, b in links], ALIAS) for links in (own, other)
    ] + [
        spark.createDataFrame([(*sorted(p), "1", at) for p, at in said], schemas.DECLINED_MERGES) for said in (declined, other_declined)
    ]
    aliases, no, conflicts = merge.import_decisions(tables[0], tables[2], tables[1], tables[3], "1")
    return (
        {(r.alias, r.family_key) for r in aliases.collect()},
        {(r.family_a_key, r.family_b_key): r.declined_at for r in no.collect()},
        {(r.problem, r.key, r.other) for r in conflicts.collect()},
    )


def test_imported_decisions(spark):
    aliases, declined, conflicts = imported(
        spark,
        own=[("a", "b"), ("m", "n"), ("z", "z")],
        declined=[(("p", "q"), 5), (("x", "y"), 7)],
        other=[("b", "c"), ("a", "d"), ("m", "o"), ("n", "o"), ("c", "a"), ("p", "q"), ("k", "k"), ("t", "u"), ("u", "v"), ("v", "t"), ("w", "t"), ("x", "h"), ("y", "h")],
        other_declined=[(("y", "x"), 3), (("r", "s"), 9)],
    )
    # b -> c -> a -> b is a circle; m leads to o either way; x and y are merged into h although declined
    assert aliases == {("a", "b"), ("m", "n"), ("n", "o"), ("w", "t"), ("x", "h"), ("y", "h")}
    assert declined == {("p", "q"): 5, ("x", "y"): 3, ("r", "s"): 9}
    assert conflicts == {
        ("alias.two_targets", "a", "d"), ("alias.declined", "p", "q"), ("merge.declined", "x", "y"),
        ("alias.circle", "b", "c"), ("alias.circle", "c", "a"), ("alias.circle", "t", "u"), ("alias.circle", "u", "v"), ("alias.circle", "v", "t"),
    }
    assert imported(spark, [], [], [], []) == (set(), {}, set())


def test_circle_members_are_those_on_the_circle(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("t1", "t2"), ("t2", "a"), ("x", "y"), ("l", "k"), ("k", "l")]
    df = spark.createDataFrame([(b, a, "s") for a, b in links], ALIAS)
    assert {r.alias for r in merge.circle_members(df).collect()} == {"a", "b", "c", "k", "l"}
    assert {r.alias for r in merge.resolve_aliases(df).collect()} == {"x"}


def test_search_filters_ask_the_chips(spark):
    families = spark.createDataFrame([(k,) for k in "abcd"], "family_key string")
    chips = spark.createDataFrame(
        [("a", True, False, True, "nas,removable"), ("b", False, True, True, "nas"), ("c", False, False, False, "internal")],
        "family_key string, offline boolean, dups boolean, have_bytes boolean, sources string",
    )
    tokens = families.limit(0).select("family_key", F.lit("").alias("token"))
    found = lambda **chosen: "".join(sorted(r[0] for r in reports.search(families, tokens, chips=chips, **chosen).collect()))
    assert found() == "abcd" and found(offline=True) == "a" and found(offline=False) == "bcd"
    assert found(dups=True) == "b" and found(have_bytes=False) == "cd" and found(source="nas") == "ab"
    assert found(source="nas", offline=False, have_bytes=True) == "b" and found(source="na") == ""


def test_pairs_meet_decisions_either_way_round_and_unsorted(spark):
    pairs_ = spark.createDataFrame([(a, b, 1) for a in "abcd" for b in "abcd" if a != b], "a_key string, b_key string, x long")
    declined = spark.createDataFrame([("b", "a", "1", 0), ("c", "d", "0", 0)], schemas.DECLINED_MERGES)
    aliases = spark.createDataFrame([("d", "b", "u")], schemas.FAMILY_ALIASES)
    left = merge.undecided(pairs_, declined, aliases, "1")
    assert left.columns == pairs_.columns
    gone = [{"a", "b"}, {"b", "d"}]
    assert sorted((r.a_key, r.b_key) for r in left.collect()) == sorted((a, b) for a in "abcd" for b in "abcd" if a != b and {a, b} not in gone)
    assert "ShuffledHashJoin" in left._jdf.queryExecution().sparkPlan().toString()


def shuffles_above_pairs(df):
    """Shuffles in the plan above the step that makes pairs, which moved every pair."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate")]
    return re.findall(r"\bExchange\b.*", above)


@pytest.mark.parametrize("block", [2, 1000])
def test_pairs_made_in_blocks_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(merge, "BLOCK", block)
    rows = families_of(7, 90) | {f"red-red-mini|qwen|t{i}|a": ("n", "qwen", 7.0 + i, i % 2, f"q{i}") for i in range(12)}
    twice = table(spark, rows).unionByName(table(spark, rows).where("params_total is null")).repartition(5)
    in_order = sorted(rows, key=lambda k: (rows[k][3], rows[k][4], k))
    whole = brute_force([(k, rows[k][1], rows[k][2]) for k in in_order])
    once = pairs(merge.likely_pairs(table(spark, rows)))
    assert len(once) == len(whole) > 500 and set(once) == whole
    copies = {k: 2 if rows[k][2] is None else 1 for k in rows}
    assert pairs(merge.likely_pairs(twice)) == sorted(p for p in whole for _ in range(copies[p[0]] * copies[p[1]]))
    asked = spark.createDataFrame([(k,) for k in sorted(rows)[::9]] + [("none",)], "family_key string")
    of_asked = {p for p in whole if set(p[:2]) & set(sorted(rows)[::9])}
    assert pairs(merge.likely_pairs(table(spark, rows), asked=asked)) == sorted(of_asked)


def test_suggested_pairs_do_not_move(spark):
    rows = families_of(11, 60)
    keys = sorted(rows)
    declined = spark.createDataFrame([(*sorted((a, b)), "1", 0) for a, b in zip(keys[::2], keys[1::2])], schemas.DECLINED_MERGES)
    aliases = spark.createDataFrame([(keys[0], keys[2], "u")], schemas.FAMILY_ALIASES)
    found = merge.merge_suggestions(table(spark, rows), declined, aliases, "1")
    assert shuffles_above_pairs(found) == []
    settled = {frozenset(p) for p in zip(keys[::2], keys[1::2])} | {frozenset((keys[0], keys[2]))}
    every = pairs(merge.likely_pairs(table(spark, rows)))
    assert pairs(found) == [p for p in every if frozenset(p[:2]) not in settled] and len(pairs(found)) < len(every)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert pairs(merge.merge_suggestions(table(spark, rows), declined, aliases, "1")) == pairs(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_followed_pairs_are_stored_compactly_and_do_not_move(spark, tmp_path):
    sizes = ["SMALL", "LARGE", "PROMO"]
    parts = [(i, f"{WORDS[i % 6]} {WORDS[i % 5]}", "Brand#1", sizes[i % 3], 1 + i % 9, 1.0) for i in range(150)]
    columns = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame(parts, columns).write.parquet(f"{tmp_path}/part.parquet")
    found = queries.followed_suggestions(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    stored = plan[: plan.index("Generate")]
    assert re.search(r"FileScan parquet \[a_key", stored) and "ExistingRDD" not in stored
    assert shuffles_above_pairs(found) == []
    assert pairs(found) == pairs(queries.merge_suggestions(spark, str(tmp_path))) and len(pairs(found)) > 500
