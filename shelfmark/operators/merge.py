"""Which families may be the same model, and what people decided about it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import FAMILY_KEY_ALGO, schemas
from shelfmark.functions.names import name_tokens, shared_tokens, similarity_score
from shelfmark.operators.hot_keys import broadcast_limit, join_lookup
from shelfmark.session import cut, size_in_bytes, spread, written

# Fixed value: two parameter counts closer than this share of the larger one count as alike.
PARAMS_RATIO = 0.15

# Families of a block. Pairs are made from two blocks in one row, so that each family moves once for every block it
# meets and not once for every family.
BLOCK = 1000

_PAIR = ["family_a_key", "family_b_key"]


def _sorted_pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("family_a_key"), F.greatest(a, b).alias("family_b_key")]


def decline_pairs(existing: DataFrame, requests: DataFrame, declined_at: int) -> DataFrame:
    """Declined pairs after `requests` (`a_key, b_key, algo_version`); the earlier decision stays.

    A pair is stored in sorted order, so both ways round are the same row.
    """
    a, b = F.col("a_key"), F.col("b_key")
    found = requests.where(a != b).select(
        *_sorted_pair(a, b), "algo_version", F.lit(declined_at).cast("long").alias("declined_at")
    )
    rows = existing.withColumn("age", F.lit(0)).unionByName(found.withColumn("age", F.lit(1)))
    return (
        rows.groupBy(*_PAIR, "algo_version")
        .agg(F.min_by("declined_at", F.struct("age", "declined_at")).alias("declined_at"))
        .select(*schemas.DECLINED_MERGES.names)
    )


def settled_pairs(
    declined: DataFrame, aliases: DataFrame, algo_version: str = FAMILY_KEY_ALGO
) -> DataFrame:
    """Pairs that must not be suggested: declined under this key rule, or already merged."""
    no = declined.where(F.col("algo_version") == algo_version).select(
        *_sorted_pair(F.col("family_a_key"), F.col("family_b_key"))
    )
    yes = aliases.select(*_sorted_pair(F.col("family_key"), F.col("alias")))
    return no.unionByName(yes).distinct()


def merge_suggestions(
    families: DataFrame,
    declined: DataFrame,
    aliases: DataFrame,
    algo_version: str = FAMILY_KEY_ALGO,
    asked: DataFrame | None = None,
    least_score: float | None = None,
) -> DataFrame:
    """The `likely_pairs` of families about which nothing is decided."""
    return undecided(likely_pairs(families, asked, least_score), declined, aliases, algo_version, stay=True)


def undecided(
    pairs: DataFrame,
    declined: DataFrame,
    aliases: DataFrame,
    algo_version: str = FAMILY_KEY_ALGO,
    stay: bool = False,
) -> DataFrame:
    """`pairs` without the `settled_pairs`.

    There are far more pairs than decisions. So these are listed both ways round, that no pair has to carry its
    sorted keys too, and are hashed, so that the pairs are not sorted. With `stay`, for pairs too many to move, the
    decisions are written first: within Spark's own limit they are broadcast and no pair moves.
    """
    settled = settled_pairs(declined, aliases, algo_version)
    one = settled.select(F.col("family_a_key").alias("a_key"), F.col("family_b_key").alias("b_key"))
    other = settled.select(F.col("family_b_key").alias("a_key"), F.col("family_a_key").alias("b_key"))
    decided = one.unionByName(other)
    if stay:
        decided = written(decided)
    if not stay or size_in_bytes(decided) > broadcast_limit(pairs.sparkSession):
        decided = decided.hint("shuffle_hash")
    return pairs.join(decided, ["a_key", "b_key"], "left_anti").select(*pairs.columns)


# What of a family decides its pairs, beside its key.
_DECISIVE = ["arch", "params_total", "first_root_id", "first_rel_path"]


def changed_families(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys of families added, removed, or changed in what decides their pairs (`family_key`)."""
    side = lambda df, name: df.select("family_key", F.struct(*_DECISIVE).alias(name))
    both = side(before, "old").join(side(after, "new"), "family_key", "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("family_key")


def follow_pairs(
    pairs: DataFrame, before: DataFrame, after: DataFrame, least_score: float | None = None
) -> DataFrame:
    """The `likely_pairs` of the families `after`, from the stored `pairs` of those `before` (with the same
    `least_score`): pairs of families that changed go, and only the changed ones are compared anew."""
    changed = written(changed_families(before, after))
    stay = pairs
    for side in ("a_key", "b_key"):
        stay = stay.join(changed.select(F.col("family_key").alias(side)), side, "left_anti")
    return stay.select(*pairs.columns).unionByName(likely_pairs(after, changed, least_score))


def _likeness(tokens_1: Column, tokens_2: Column) -> list[Column]:
    """The likeness of two names as seen from either."""
    seen = lambda a, b: F.struct(
        shared_tokens(a, b).alias("shared_tokens"), similarity_score(a, b).alias("score")
    )
    return [seen(tokens_1, tokens_2).alias("forward"), seen(tokens_2, tokens_1).alias("backward")]


def _met_in_blocks(members: DataFrame) -> DataFrame:
    """(f1, f2, same, forward, backward): families of one architecture that share a token, each two once, or both
    ways round if `same`.

    The families of a token are dealt to blocks of about `BLOCK`, and every two blocks of which one has a family
    asked for meet in one row, dealt to all tasks. There names meet names, at their smallest shared token
    alone, and only then families. Nothing moves after that. A name with many families is split into parts.
    """
    name = ["arch_mark", "signature"]
    blocks = lambda families: F.ceil(families / BLOCK).cast("long")
    parts = members.groupBy(*name).agg(blocks(F.count(F.lit(1))).alias("parts"))
    part = F.pmod(F.xxhash64("family.family_key"), F.col("parts")).alias("part")
    groups = written(
        join_lookup(members, parts, name)
        .groupBy(*name, part, F.col("family.asked").alias("asked"))
        .agg(F.collect_list("family").alias("families"))
    )
    tokens = F.split("signature", "-")
    by_token = groups.select(
        "arch_mark", "asked", F.size("families").alias("n"), F.xxhash64("signature", "part").alias("turn"),
        F.struct(tokens.alias("tokens"), "asked", "families").alias("group"),
        F.explode(F.array_distinct(tokens)).alias("token"),
    )
    place = ["arch_mark", "token"]
    count = lambda which: blocks(F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)))
    counts = by_token.groupBy(*place).agg(
        count(F.col("asked")).alias("asked_blocks"), count(~F.col("asked")).alias("other_blocks")
    )
    # Names asked for fill the first blocks and meet every block, the others meet only the first ones.
    at_block = lambda n: F.pmod("turn", F.greatest(F.col(n), F.lit(1)))
    block = F.when(F.col("asked"), at_block("asked_blocks")).otherwise(F.col("asked_blocks") + at_block("other_blocks"))
    meets = F.col("asked_blocks") + F.when(F.col("asked"), F.col("other_blocks")).otherwise(0)
    dealt = (
        join_lookup(by_token, counts, place)
        .where(F.col("asked_blocks") > 0)
        .select(*place, "group", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), meets - 1)).alias("other"))
        .select(*place, "group", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    unit = [*place, "low", "high"]
    alone, first = F.col("low") == F.col("high"), F.col("block") == F.col("low")
    side = lambda which: F.collect_list(F.when(which, F.col("group")))
    units = (
        spread(dealt, *unit)
        .groupBy(*unit)
        .agg(side(first).alias("one"), side(~first).alias("two"))
        .select("token", alone.alias("alone"), "one", F.when(alone, F.col("one")).otherwise(F.col("two")).alias("two"))
    )
    tokens_1, tokens_2 = F.col("g1.tokens"), F.col("g2.tokens")
    names = (
        units.select("token", "alone", "two", F.posexplode("one").alias("p1", "g1"))
        .select("token", "alone", "p1", "g1", F.posexplode("two").alias("p2", "g2"))
        .where(~F.col("alone") | (F.col("p1") <= F.col("p2")))
        .where(F.col("g1.asked") | F.col("g2.asked"))
        .where(F.col("token") == F.array_min(F.array_intersect(tokens_1, tokens_2)))
    )
    alike = names.select(
        (F.col("alone") & (F.col("p1") == F.col("p2"))).alias("same"), *_likeness(tokens_1, tokens_2),
        F.col("g1.families").alias("families_1"), F.col("g2.families").alias("families_2"),
    )
    return alike.select("same", "forward", "backward", "families_2", F.explode("families_1").alias("f1")).select(
        "same", "forward", "backward", "f1", F.explode("families_2").alias("f2")
    )


def _met_by_score(members: DataFrame, least_score: float) -> DataFrame:
    """As `_met_in_blocks`, without the pairs of a lower score."""
    signatures = members.groupBy("arch_mark", "signature").agg(F.bool_or("family.asked").alias("asked"))
    by_token = signatures.select(
        "arch_mark", "signature", "asked", F.explode(F.array_distinct(F.split("signature", "-"))).alias("token")
    )
    met = _close_signatures(by_token, least_score)
    alike = met.select(
        "arch_mark", "signature_1", "signature_2", *_likeness(F.split("signature_1", "-"), F.split("signature_2", "-"))
    ).where(F.greatest("forward.score", "backward.score") >= least_score)
    first = members.select(
        "arch_mark", F.col("signature").alias("signature_1"), F.col("family").alias("f1")
    )
    second = members.select(
        "arch_mark", F.col("signature").alias("signature_2"), F.col("family").alias("f2")
    )
    return (
        alike.join(first, ["arch_mark", "signature_1"])
        .join(second, ["arch_mark", "signature_2"])
        .select("f1", "f2", (F.col("signature_1") == F.col("signature_2")).alias("same"), "forward", "backward")
    )


def _close_signatures(by_token: DataFrame, least_score: float) -> DataFrame:
    """Pairs of signatures that may have the score, before any is compared.

    Of the tokens of a name, those that another name lacks are at most the share `1 - least_score` of its length.
    So of its rarest tokens, as many as go beyond that share, the other has at least one: only these
    look for partners, and a token that most names have is seldom among them. Names without repeated
    tokens must also be of like length.
    """
    often = by_token.groupBy("arch_mark", "token").agg(F.count(F.lit(1)).alias("often"))
    ranked = join_lookup(by_token, often, ["arch_mark", "token"]).groupBy("arch_mark", "signature", "asked").agg(
        F.array_sort(F.collect_list(F.struct("often", "token"))).alias("rarest")  # the tokens of one name
    )
    tokens = F.split("signature", "-")
    length = F.size(tokens)
    times = F.transform("rarest", lambda t: F.size(F.filter(F.split(F.col("signature"), "-"), lambda x: x == t["token"])))
    before = lambda i: F.aggregate(F.slice("times", 1, i), F.lit(0), lambda a, b: a + b)
    rest = (1.0 - least_score) * F.col("length") + 1e-9
    prefixed = ranked.withColumns({"times": times, "length": length}).select(
        "arch_mark", "signature", "asked", F.posexplode("rarest").alias("at", "t"), "times", "length"
    )
    seekers = prefixed.where(before(F.col("at")) <= rest).select(
        "arch_mark", F.col("t.token").alias("token"), F.col("signature").alias("s"), F.col("asked").alias("s_asked")
    )
    others = by_token.select("arch_mark", "token", F.col("signature").alias("o"), F.col("asked").alias("o_asked"))
    met = seekers.join(others, ["arch_mark", "token"]).where(F.col("s_asked") | F.col("o_asked"))
    pairs = met.select("arch_mark", F.least("s", "o").alias("signature_1"), F.greatest("s", "o").alias("signature_2")).distinct()
    sizes = [F.size(F.split(c, "-")) for c in ("signature_1", "signature_2")]
    repeats = reduce(
        lambda a, b: a | b,
        [F.size(F.array_distinct(F.split(c, "-"))) < F.size(F.split(c, "-")) for c in ("signature_1", "signature_2")],
    )
    return pairs.where(repeats | (F.least(*sizes) >= least_score * F.greatest(*sizes) - 1e-9))


def likely_pairs(
    families: DataFrame, asked: DataFrame | None = None, least_score: float | None = None
) -> DataFrame:
    """All pairs of families with a name token in common and the same architecture; with `asked`
    (`family_key`) the pairs that have one of those families, as for the families new in a scan; with
    `least_score` (above 0) those of that score or more, most others never being made.

    Families with the same tokens and architecture form one signature; tokens are compared between
    signatures, not between families. Two signatures meet at each token they share, and the smallest
    shared token alone reports them, which needs no distinct afterwards. Only then are signatures
    opened into families, so every pair that is made is a row of the answer, and without `least_score` no pair
    moves between tasks. The family stored first is `a`. The whole answer grows with the square of a popular token;
    with `asked` it grows with the families asked for.
    """
    order = F.struct("first_root_id", "first_rel_path", "family_key")
    if asked is None:
        families = families.withColumn("asked", F.lit(True))
    else:
        mark = asked.select("family_key").distinct().withColumn("asked", F.lit(True))
        families = families.join(mark, "family_key", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    members = (
        families.withColumn("tokens", name_tokens("family_key"))
        .where(F.size("tokens") > 0)
        .select(
            # Unknown architectures are alike; the mark keeps them apart from any real name.
            F.coalesce(F.concat(F.lit("="), "arch"), F.lit("?")).alias("arch_mark"),
            F.concat_ws("-", "tokens").alias("signature"),
            F.struct(order.alias("at"), "family_key", "params_total", "asked").alias("family"),
        )
    )
    met = _met_in_blocks(members) if least_score is None else _met_by_score(members, least_score)
    in_order = F.col("f1.at") < F.col("f2.at")
    pairs = (
        met.where(~F.col("same") | in_order)
        .where(F.col("f1.asked") | F.col("f2.asked"))
        .select(
            F.when(in_order, F.col("f1")).otherwise(F.col("f2")).alias("a"),
            F.when(in_order, F.col("f2")).otherwise(F.col("f1")).alias("b"),
            F.when(in_order, F.col("forward")).otherwise(F.col("backward")).alias("likeness"),
        )
    )
    total_a, total_b = F.col("a.params_total"), F.col("b.params_total")
    near = F.try_divide(F.abs(total_a - total_b), F.greatest(total_a, total_b)) <= PARAMS_RATIO
    # Two zero totals have no ratio and are not alike; greatest() skips nulls, so ask for both.
    near = near & total_a.isNotNull() & total_b.isNotNull()
    suggested = pairs.select(
        F.col("a.family_key").alias("a_key"),
        F.col("b.family_key").alias("b_key"),
        F.when(near, "params").otherwise("name").alias("reason"),
        "likeness.shared_tokens",
        "likeness.score",
    )
    return suggested if least_score is None else suggested.where(F.col("score") >= least_score)


def _followed(aliases: DataFrame) -> DataFrame:
    """Every alias with the key that following it leads to, by more steps than there are aliases.

    Each round doubles the distance an alias looks ahead, so a chain of n links takes log2(n) rounds.
    """
    links = cut(
        aliases.where(F.col("alias") != F.col("family_key"))
        .groupBy("alias")
        .agg(F.min("family_key").alias("family_key"))
    )
    count = links.count()
    ahead = links
    for _ in range(max(count, 1).bit_length() + 1):
        onward = ahead.select(F.col("alias").alias("family_key"), F.col("family_key").alias("next"))
        if ahead.join(onward, "family_key", "left_semi").isEmpty():
            break
        ahead = cut(
            ahead.join(onward, "family_key", "left").select(
                "alias", F.coalesce("next", "family_key").alias("family_key")
            )
        )
    return ahead


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """Final family of every alias, chains followed to their end (`alias, family_key`). Aliases that lead in
    a circle have no end and are left out (`alias_circles`)."""
    ahead = _followed(aliases)
    ends = ahead.select(F.col("alias").alias("family_key"))
    return ahead.join(ends, "family_key", "left_anti").select("alias", "family_key")


def circle_members(aliases: DataFrame) -> DataFrame:
    """Aliases that lead back to themselves (`alias`), without those that only lead into a circle: after that
    many steps an alias without an end stands on its circle, and steps along a circle miss none of it."""
    ahead = _followed(aliases)
    ends = ahead.select(F.col("alias").alias("family_key"))
    return ahead.join(ends, "family_key", "left_semi").select(F.col("family_key").alias("alias")).distinct()


def alias_circles(aliases: DataFrame, resolved: DataFrame) -> DataFrame:
    """Aliases without an end to follow."""
    return aliases.join(resolved.select("alias"), "alias", "left_anti")


def import_decisions(
    aliases: DataFrame,
    declined: DataFrame,
    other_aliases: DataFrame,
    other_declined: DataFrame,
    algo_version: str = FAMILY_KEY_ALGO,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Aliases and declined pairs after those of another catalogue are taken over, and the conflicts.

    Own decisions stay; links of a key to itself are none. A link of the other side is left out, and a row of `conflicts` (`problem, key, other`) says
    so, if its alias has another family here (`alias.two_targets`, unless both lead to the same end), if its two
    keys are declined here under this key rule (`alias.declined`), or if it would close a circle (`alias.circle`).
    Declined pairs are united, the earliest date of each counting. Pairs that are declined and, by chains of links,
    merged are kept and reported (`merge.declined`).
    """
    aliases = aliases.where(F.col("alias") != F.col("family_key"))
    own = aliases.groupBy("alias").agg(F.min(F.struct("family_key", "source")).alias("own"))
    theirs = (
        other_aliases.where(F.col("alias") != F.col("family_key"))
        .groupBy("alias").agg(F.min(F.struct("family_key", "source")).alias("link"))
        .select("alias", "link.*")
    )
    refused = declined.where(F.col("algo_version") == algo_version).select(
        *_sorted_pair(F.col("family_a_key"), F.col("family_b_key"))
    ).distinct()
    offered = written(
        theirs.join(own, "alias", "left")
        .withColumns(dict(zip(_PAIR, _sorted_pair(F.col("alias"), F.col("family_key")))))
        .join(refused.withColumn("refused", F.lit(True)), _PAIR, "left")
    )
    fresh = offered.where("own is null and refused is null").select("family_key", "alias", "source")
    united = written(aliases.select("family_key", "alias", "source").unionByName(fresh))
    circles = circle_members(united).join(fresh.select("alias"), "alias", "left_semi")
    circles = written(circles)
    merged = written(united.join(circles, "alias", "left_anti").select("family_key", "alias", "source"))

    resolved = written(resolve_aliases(merged))
    end = lambda df, column, into: df.join(
        resolved.select(F.col("alias").alias(column), F.col("family_key").alias("_end")), column, "left"
    ).withColumn(into, F.coalesce("_end", column)).drop("_end")
    taken = offered.where("own is not null").select("alias", "family_key", F.col("own.family_key").alias("own_key"))
    twice = end(end(taken, "family_key", "theirs"), "own_key", "ours").where("theirs <> ours")
    both = declined.unionByName(other_declined)
    all_declined = both.groupBy(*_PAIR, "algo_version").agg(F.min("declined_at").alias("declined_at"))
    decided = all_declined.where(F.col("algo_version") == algo_version).select(*_PAIR)
    joined = end(end(decided, "family_a_key", "end_a"), "family_b_key", "end_b").where("end_a = end_b")
    row = lambda df, problem, key, other: df.select(
        F.lit(problem).alias("problem"), F.col(key).alias("key"), F.col(other).alias("other")
    )
    conflicts = reduce(
        DataFrame.unionByName,
        [
            row(twice, "alias.two_targets", "alias", "family_key"),
            row(offered.where("own is null and refused"), "alias.declined", "alias", "family_key"),
            row(fresh.join(circles, "alias", "left_semi"), "alias.circle", "alias", "family_key"),
            row(joined, "merge.declined", "family_a_key", "family_b_key"),
        ],
    )
    return merged, all_declined.select(*schemas.DECLINED_MERGES.names), conflicts


def apply_aliases(table: DataFrame, resolved: DataFrame) -> DataFrame:
    """`table` with merged families under the key they were merged into."""
    target = resolved.select(F.col("alias").alias("family_key"), F.col("family_key").alias("into"))
    merged = join_lookup(table, target, ["family_key"]).withColumn(
        "family_key", F.coalesce("into", "family_key")
    )
    return merged.select(*table.columns)


def merged_families(families: DataFrame, resolved: DataFrame) -> DataFrame:
    """The family table as read after merges: the target's own row, or the first one merged into it."""
    own = F.col("original_key") != F.col("family_key")
    values = [c for c in families.columns if c != "family_key"]
    renamed = apply_aliases(families.withColumn("original_key", F.col("family_key")), resolved)
    return (
        renamed.groupBy("family_key")
        .agg(F.min_by(F.struct(*values), F.struct(own, "original_key")).alias("row"))
        .select("family_key", "row.*")
    )
