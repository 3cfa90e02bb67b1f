"""Secret scans: exact patterns, and multipart credentials linked by interval joins.

Base kinds are found on their own. The method adds weak candidates - identifiers, unlabelled keys and
endpoints - which mean nothing alone: an identifier and a key are reported when they lie within one
scope, at most `SCOPE` code points apart; an endpoint when such a linked part lies in its scope.
Strong spans (an access number; an assignment or hex run) count as parts. Weak candidates that
overlap a strong span are that span.

All of it is DataFrame operations. Texts are scanned once, leaving only the lengths of what lies
between and in the matches; running sums of those give the positions. The interval joins meet on
(document, bin of `SCOPE` code points), so a long document is spread over its bins, and the spans in a
bin are bounded by its width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.tables import quoted, stored

SCOPE = 200
MASK = "[SECRET]"

#: kind, pattern with the value as group 1, least length of the value, part played (strong kinds first)
KINDS = (
    (
        "assign",
        r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        "key",
    ),
    ("access", r"(AKIA[A-Z0-9]{16,})", 20, "id"),
    ("hex", r"([0-9a-f]{24,})", 24, "key"),
    (
        "ident",
        r"""(?i)(?:user(?:_?name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})""",
        3,
        "id",
    ),
    (
        "blob",
        r"(?<![A-Za-z0-9+/=_-])((?=[a-z+/_-]*[A-Z0-9])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2})",
        20,
        "key",
    ),
    ("endpoint", r"""(?<![A-Za-z0-9])([A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]{4,})""", 4, "place"),
)
STRONG = [k for k, _, _, _ in KINDS[:3]]


def _measure(text: Column, pattern: str) -> Column:
    """(gap before, length, length of the value) of every match, in order."""
    parsed = F.zip_with(
        F.split(text, pattern, -1),
        F.arrays_zip(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("value"),
        ),
        lambda gap, match: F.struct(
            F.length(gap).alias("gap"),
            F.length(match["whole"]).alias("whole"),
            F.length(match["value"]).alias("value"),
        ),
    )
    return F.when(text.rlike(pattern), F.filter(parsed, lambda x: x["whole"].isNotNull()))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One written row per row of `docs`: row number, doc_id, hash of the text, lengths by kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.xxhash64(whole).alias("text_hash"),
            *[_measure(whole, pattern).alias(kind) for kind, pattern, _, _ in KINDS],
        )
    )


def _spans(rows: DataFrame) -> DataFrame:
    """(row, rank, kind, part, start, end) of every match that is long enough."""
    each = None
    for rank, (kind, _, least, part) in enumerate(KINDS):
        found = rows.where(F.col(kind).isNotNull()).select(
            "row", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.lit(part).alias("part"),
            F.lit(least).alias("least"), F.posexplode(kind).alias("place", "m"),
        )
        each = found if each is None else each.unionByName(found)
    before = W.partitionBy("row", "rank").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum((F.col("m.gap") + F.col("m.whole")).cast("long")).over(before)
    return (
        each.withColumn("end", end)
        .where("m.value >= least")
        .select("row", "rank", "kind", "part", (F.col("end") - F.col("m.whole")).alias("start"), "end")
    )


def _near(left: DataFrame, right: DataFrame, within: int, how: str) -> DataFrame:
    """Rows of `left` for which `right` has (left_semi) or lacks (left_anti) a span of the same
    document at most `within` code points away; -1: one that overlaps."""
    width = SCOPE
    reach = max(within, 0)
    bins = lambda low, high: F.explode(
        F.sequence(F.floor(F.greatest(low, F.lit(0)) / width), F.floor(high / width))
    )
    there = right.select(
        F.col("row").alias("there"), F.col("start").alias("from"), F.col("end").alias("to"),
        bins(F.col("start"), F.col("end")).alias("bin"),
    )
    here = left.withColumn("bin", bins(F.col("start") - reach, F.col("end") + reach))
    gap = F.greatest("start", "from") - F.least("end", "to")
    met = here.join(there, (here.row == there.there) & (here.bin == there.bin) & (gap <= within), "left_semi")
    own = ["row", "rank", "kind", "part", "start", "end"]
    met = met.select(*own).distinct()
    return met if how == "left_semi" else left.join(met, own, "left_anti")


def spans(rows: DataFrame) -> DataFrame:
    """Strong spans, and the weak ones whose complementary parts co-occur: (row, rank, kind, start, end)."""
    every = stored(_spans(rows))
    strong = every.where(F.col("kind").isin(STRONG))
    weak = stored(_near(every.where(~F.col("kind").isin(STRONG)), strong, -1, "left_anti"))
    ids = strong.where("part = 'id'").unionByName(weak.where("part = 'id'"))
    keys = strong.where("part = 'key'").unionByName(weak.where("part = 'key'"))
    linked = stored(_near(ids, keys, SCOPE, "left_semi").unionByName(_near(keys, ids, SCOPE, "left_semi")))
    places = _near(weak.where("part = 'place'"), linked, SCOPE, "left_semi")
    added = linked.where(~F.col("kind").isin(STRONG)).unionByName(places)
    return strong.unionByName(added).select("row", "rank", "kind", "start", "end")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc_id, n_assign, n_access, n_hex, base_sha256, spans).

    Spans are `kind:start:end` in code points, end exclusive, by start, then kind, comma-joined. A
    null text is empty: no spans, the digest of nothing. Repeated rows, also with null ids, each give
    their row. Other columns are ignored; an empty table gives an empty table.
    """
    rows = measured(docs, doc_id, text)
    listed = spans(rows).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("s"))
    s = F.coalesce("s", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))
    named = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter(s, lambda x: x["rank"] < len(STRONG))
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("row", "doc_id").join(listed, "row", "left").select(
        "doc_id", *[count(k) for k in STRONG],
        F.sha2(F.concat_ws(",", F.transform(base, named)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(s, named)).alias("spans"),
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mask: str = MASK) -> DataFrame:
    """`docs`, all rows and columns, with every reported span in `text` replaced by `mask`;
    overlapping spans become one. Null texts stay null."""
    rows = measured(docs, doc_id, text)
    found = spans(rows)
    sofar = W.partitionBy("row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    run = W.partitionBy("row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)
    merged = (
        found.withColumn("reached", F.max("end").over(sofar))
        .withColumn("run", F.sum(F.when(F.col("start") < F.col("reached"), 0).otherwise(1)).over(run))
        .groupBy("row", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    before = F.coalesce(F.lag("end").over(W.partitionBy("row").orderBy("start")), F.lit(0))
    cuts = (
        merged.withColumn("from", before)
        .groupBy("row")
        .agg(
            F.array_sort(F.collect_list(F.struct("start", "from", "end"))).alias("cuts"),
            F.max("end").alias("rest"),
        )
    )
    lookup = stored(
        rows.join(cuts, "row").groupBy(F.col("doc_id").alias("_shelfmark_id"), F.col("text_hash").alias("_shelfmark_hash"))
        .agg(F.any_value("cuts").alias("_shelfmark_cuts"), F.any_value("rest").alias("_shelfmark_rest"))
    )
    t = docs[text]
    kept = F.transform("_shelfmark_cuts", lambda c: F.substring(t, c["from"] + 1, c["start"] - c["from"]))
    tail = F.substring(t, F.col("_shelfmark_rest") + 1, F.length(t))
    clean = F.when(F.col("_shelfmark_cuts").isNotNull(), F.concat(F.concat_ws(mask, kept), F.lit(mask), tail)).otherwise(t)
    same = docs[doc_id].eqNullSafe(lookup["_shelfmark_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == lookup["_shelfmark_hash"])
    return docs.join(lookup, same, "left").select(
        *[clean.alias(text) if c == text else docs[quoted(c)] for c in docs.columns]
    )
