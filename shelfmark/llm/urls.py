"""URL filter: given rules first, and rules mined by FP-growth where none fits.

Each url is a basket of tokens: parts of the host, of the path (numbers as one token), keys of the
query. Urls that a given rule judges are the labels. FP-growth over (tokens, label) gives association
rules; those that conclude a label, pruned by support and confidence, judge the other urls.

Tokens that stand in exactly the same labelled urls are one class, and classes are what is mined: k such
tokens would be 2^k frequent sets, all of the same support and confidence. A rule of classes stands for the
rules of all choices of tokens from each; the longest that fits a basket has all its tokens of these classes.
A mined rule is filed under its rarest class (inverted index) and fits a basket that has all its classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tables import stored

#: (rule, host, path, verdict)
RULES = (
    ("org/", "org", "/", "allow"),
    ("example.org/es/", "example.org", "/es/", "block"),
    ("example.org/en/1", "example.org", "/en/1", "block"),
    ("com/fr/", "com", "/fr/", "allow"),
    ("com/de/", "com", "/de/", "block"),
)
SUPPORT = 0.01
CONFIDENCE = 0.7
DEFAULT = "allow"
LABEL = "label="


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no `://`."""
    rest = F.coalesce(F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, on, prefix, verdict in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0])):
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url, sorted; no token begins like a label."""
    whole = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "#")
    some = lambda array, mark: F.transform(
        F.filter(array, lambda x: x != ""), lambda x: F.concat(F.lit(mark), whole(x))
    )
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_sort(
        F.array_distinct(
            F.concat(some(F.split(host, r"\."), "h:"), some(F.split(path, "[/.]"), "p:"), some(keys, "q:"))
        )
    )


def token_classes(baskets: DataFrame, support: float) -> DataFrame:
    """(token, cls) of the tokens that are frequent in `baskets` (tokens, verdict): those in exactly the same
    baskets have the same class, the first of its tokens. Sets of baskets are compared by 128 bits."""
    whole = F.xxhash64("tokens", "verdict"), F.xxhash64(F.lit(1), "tokens", "verdict")
    # equal baskets hold the same tokens, so each counts once in the sets
    distinct = baskets.groupBy("tokens", "verdict").agg(F.count(F.lit(1)).alias("n")).withColumns({"x": whole[0], "y": whole[1]})
    seen = distinct.select(F.explode("tokens").alias("token"), "n", "x", "y").groupBy("token").agg(
        F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")
    )
    rows = distinct.agg(F.sum("n")).first()[0] or 0
    often = seen.where(F.col("n") >= rows * support - 1e-6)
    firsts = often.groupBy("n", "x", "y").agg(F.min("token").alias("cls"))
    return stored(often.join(firsts, ["n", "x", "y"]).select("token", "cls"))


def _in_classes(baskets: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct `tokens` of the baskets that have a class, with `pairs`, their tokens and classes."""
    return (
        baskets.select("tokens", F.explode("tokens").alias("token")).join(classes, "token")
        .groupBy("tokens").agg(F.collect_set(F.struct("token", "cls")).alias("pairs"))
    )


def mine(baskets: DataFrame, classes: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (id, items, rarest, verdict, confidence, support) over the classes, from `baskets` (tokens, verdict)."""
    found = _in_classes(baskets.select("tokens").distinct(), classes)
    own = F.coalesce(F.array_distinct(F.col("pairs.cls")), F.array().cast("array<string>"))
    labelled = baskets.join(found, "tokens", "left").select(
        F.concat(own, F.array(F.concat(F.lit(LABEL), F.col("verdict")))).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(labelled)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    concluding = model.associationRules.where(
        F.col("consequent")[0].startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL))
    ).select(
        F.array_sort("antecedent").alias("items"), "confidence", "support",
        F.substring(F.col("consequent")[0], len(LABEL) + 1, 1000).alias("verdict"),
    )
    numbered = stored(concluding.select(F.monotonically_increasing_id().alias("id"), "*"))
    rarest = (
        numbered.select("id", F.explode("items").alias("item"))
        .join(single, "item")
        .groupBy("id")
        .agg(F.min(F.struct("freq", "item"))["item"].alias("rarest"))
    )
    return stored(numbered.join(rarest, "id"))


def judge(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple] = RULES,
    support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = DEFAULT,
) -> DataFrame:
    """One row per row of `pages`: (page_id, host, path, rule, verdict, mined).

    `rule` is the given rule that fits (else null), `mined` the tokens of the mined rule that decided
    (else null). Where neither fits, also for null urls, the verdict is `default`. Of several mined
    rules the most confident decides, then the longer, better supported, first by its tokens.
    Repeated rows and null ids are kept; other columns are ignored; an empty table gives an empty one.
    """
    host, path = host_and_path(F.col(url))
    parsed = stored(
        pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
        .withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
        .select("page_id", "host", "path", "fit", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    )
    labelled = parsed.where("fit is not null").select("tokens", F.col("fit.verdict").alias("verdict"))
    open_ = stored(parsed.where("fit is null").select("tokens").distinct())
    if labelled.isEmpty():
        best = parsed.limit(0).select("tokens", F.lit("").alias("found"), F.array(F.lit("")).alias("items"))
    else:
        classes = token_classes(labelled, support)
        index = mine(labelled, classes, support, confidence)
        mine_of = F.array_distinct(F.col("pairs.cls"))
        chosen = F.transform(F.filter("pairs", lambda p: F.array_contains("classes", p["cls"])), lambda p: p["token"])
        fitting = (
            _in_classes(open_, classes)
            .withColumn("rarest", F.explode(mine_of))
            .join(index.withColumnRenamed("items", "classes"), "rarest")
            .where(F.size(F.array_except("classes", mine_of)) == 0)
            .withColumn("items", F.array_sort(chosen))
        )
        order = F.struct("confidence", F.size("items"), "support", F.concat_ws(" ", "items"))
        best = stored(
            fitting.groupBy("tokens")
            .agg(F.max_by(F.struct("verdict", "items"), order).alias("best"))
            .select("tokens", F.col("best.verdict").alias("found"), F.col("best.items").alias("items"))
        )
    fit = parsed.where("fit is not null").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"),
        F.lit(None).cast("string").alias("mined"),
    )
    rest = parsed.where("fit is null").join(best, "tokens", "left").select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
        F.coalesce("found", F.lit(default)).alias("verdict"), F.concat_ws(" ", "items").alias("mined"),
    )
    return fit.unionByName(rest.withColumn("mined", F.nullif("mined", F.lit(""))))
