"""Phrase collocations from the flow of a weighted de Bruijn graph, language by language.

Texts are cut into pieces, pieces into words. A node of the graph is a run of three words, an edge a run of
four, from its first three words to its last three; the weight is how often it occurs. The last words of
a piece lead to its end: behind `u v w` that is one unary path (`u v w $`, `v w $`, `w $`), of which only the
first edge is kept (of a piece of one or two words, its only one). All shorter counts follow from the
longest edges, level by level: what flows out of a node plus what ends there,

    f(u v w) = sum of f(u v w x) + ends of u v w
    f(v w)   = sum of f(v w x)   + ends of v w      f(w) = sum of f(w x) + ends of w

and what ends at `u v w` also ends at `v w` and at `w`, its path's other nodes.

A block of texts adds up its edges by itself (so a passage that stands everywhere is one edge for each block)
and sends them, with the words they use, to parts dealt by node. A part completes edges and nodes, and
sends the flow into each pair to parts dealt by pair; these complete pairs, and words are added up at last.
Counts are exact and all words are compared whole; hashes only deal.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.tables import give_back, stored

WIDTH = 4
LEAST = 30
MOST = 2000
UNKNOWN = "und"
#: A phrase goes if a longer one holds so many hundredths of its occurrences.
WITHIN = 80
SCALE = 2_000_000
#: Words of a block, pieces and bytes read at once, and bytes of text for each part.
BLOCK = 3 << 18
PIECES = 20_000
BYTES = 1 << 20
PART_BYTES = 4 << 20
#: Parts of a language in which the first `MOST` phrases are looked for before they meet.
BUCKETS = 64

_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * 10 + b" abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[^ ]+")
END = b""

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SENT = "part long, words binary, edges binary, n binary, found array<struct<lang:string,k:int,phrase:string,f:bigint>>"
_FOUND = pa.struct([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
_COUNTED = "lang string, k int, phrase string, f long"


# ---- numbers -----------------------------------------------------------------------------------


def packed(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One number for each row of the columns (values below `size`), in the order of the rows."""
    key, span = columns[0].astype(np.uint64), size
    for column in columns[1:]:
        if span * size > 1 << 64:
            order = np.argsort(key)
            new = np.append(False, key[order[1:]] != key[order[:-1]])
            key = np.empty(len(order), np.uint64)
            key[order] = np.cumsum(new)
            span = len(order)
        key = key * np.uint64(size) + column.astype(np.uint64)
        span *= size
    return key


def added(columns: list[np.ndarray], n: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows in order, and the sum of `n` of each."""
    key = packed(columns, size)
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    rows = order[starts]
    return [c[rows] for c in columns], np.add.reduceat(n[order], starts) if len(starts) else n[:0]


def _squeezed(data: bytes) -> bytes:
    """Compressed, behind its length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _whole(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _kind(words: int) -> str:
    """How numbers of so many words are sent."""
    return "<u2" if words <= 1 << 16 else "<i4"


def _part(hashes: list[np.ndarray], parts: int) -> np.ndarray:
    h = hashes[0]
    for other in hashes[1:]:
        h = (h ^ (h >> np.uint64(29))) * _ODD + other
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def sent(columns: list[np.ndarray], n: np.ndarray, words: list[bytes], parts: int, dealt: int) -> Iterator[pa.RecordBatch]:
    """The rows, dealt to parts by their first `dealt` words: for each part the words its rows use, the rows
    as numbers of these, and `n`."""
    hashes = _hashes(words)
    part = _part([hashes[c] for c in columns[:dealt]], parts)
    order = np.argsort(part, kind="stable")
    columns, n, part = [c[order] for c in columns], n[order], part[order]
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for at in range(0, len(starts), 16):
        out = {name: [] for name in ("part", "words", "edges", "n")}
        some = starts[at : at + 16]
        for begin, end in zip(some.tolist(), [*some[1:].tolist(), int(starts[at + 16]) if at + 16 < len(starts) else len(n)]):
            used, own = np.unique(np.concatenate([c[begin:end] for c in columns]), return_inverse=True)
            out["part"].append(int(part[begin]))
            out["words"].append(_squeezed(b"\n".join([words[i] for i in used.tolist()])))
            out["edges"].append(_squeezed(own.astype(_kind(len(used))).tobytes()))
            out["n"].append(_squeezed(n[begin:end].astype("<i8").tobytes()))
        yield _batch(
            pa.array(out["part"], pa.int64()),
            *(pa.array(out[name], pa.binary()) for name in ("words", "edges", "n")),
            pa.array([None] * len(some), pa.list_(_FOUND)),
        )


def _batch(*arrays: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(arrays), names=["part", "words", "edges", "n", "found"])


def received(rows: pa.Table, width: int) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
    """All rows of a part, added up, and its words. Word 0 is the end of a piece."""
    numbers: defaultdict = defaultdict(count().__next__)
    numbers[END]
    columns: list[list[np.ndarray]] = [[] for _ in range(width)]
    counts = []
    for words, edges, n in zip(*(rows.column(name) for name in ("words", "edges", "n"))):
        if not words.is_valid:
            continue
        texts = _whole(words.as_py()).split(b"\n")
        codes = np.fromiter(map(numbers.__getitem__, texts), np.int64, len(texts))
        for column, own in zip(columns, np.frombuffer(_whole(edges.as_py()), _kind(len(texts))).reshape(width, -1)):
            column.append(codes[own])
        counts.append(np.frombuffer(_whole(n.as_py()), "<i8"))
    if not counts:
        return [np.zeros(0, np.int64)] * width, np.zeros(0, np.int64), [END]
    return *added([np.concatenate(c) for c in columns], np.concatenate(counts), len(numbers)), list(numbers)


def _found(columns: list[np.ndarray], n: np.ndarray, words: list[bytes]) -> pa.Array:
    """Phrases of these words with their counts."""
    used, own = np.unique(np.concatenate(columns), return_inverse=True)
    texts = [words[i].split(b"\t", 1) for i in used.tolist()]
    names = [t[-1].replace(b"%0A", b"\n").replace(b"%25", b"%").decode() for t in texts]
    plain = [t[0].decode() for t in texts]
    rows = own.reshape(len(columns), -1).T.tolist()
    return pa.StructArray.from_arrays(
        [
            pa.array([names[r[0]] for r in rows], pa.string()),
            pa.array(np.full(len(rows), len(columns)), pa.int32()),
            pa.array([" ".join([plain[w] for w in r]) for r in rows], pa.string()),
            pa.array(n, pa.int64()),
        ],
        fields=list(_FOUND),
    )


# ---- blocks ------------------------------------------------------------------------------------


class Block:
    """Words of one block as numbers: a word of a language is `word TAB language`, and 0 the end of a piece."""

    def __init__(self):
        self.next = count(1)
        self.numbers: dict[str, defaultdict] = {}
        self.words: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.size = 0

    def read(self, text: str | None, lang: str | None) -> Iterator[None]:
        """Takes a text in, and pauses where the block may end, which is never within a piece."""
        lang = UNKNOWN if lang is None else lang
        pieces = iter((text or "").encode().translate(_CUT).split(b"\n"))
        while some := list(islice(pieces, PIECES)):
            number = self.numbers.setdefault(lang, defaultdict(self.next.__next__)).__getitem__
            lists = [p.split() if len(p) < BYTES else _WORD.findall(p) for p in some]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            self.words.append(np.fromiter(map(number, chain.from_iterable(lists)), np.int64, int(lengths.sum())))
            self.lengths.append(lengths[lengths > 0])
            self.size += len(self.words[-1])
            yield

    def edges(self) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
        """Distinct edges, how often each occurs, and the words."""
        words, lengths = np.concatenate(self.words), np.concatenate(self.lengths)
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(words))
        first = np.zeros(len(words), dtype=bool)
        first[ends - lengths] = True
        at = np.flatnonzero((left >= WIDTH - 1) | first)
        left = left[at]
        padded = np.append(words, np.zeros(WIDTH, np.int64))
        columns = [np.where(left > j, padded[at + j], 0) for j in range(WIDTH)]
        texts = [END] * next(self.next)
        for lang, numbers in self.numbers.items():
            name = b"\t" + lang.encode().replace(b"%", b"%25").replace(b"\n", b"%0A")  # lines part the words
            for word, i in numbers.items():
                texts[i] = word + name
        return *added(columns, np.ones(len(at), np.int64), len(texts)), texts


def _blocks(parts: int, most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                for _ in block.read(text.as_py(), lang.as_py()):
                    if block.size >= most:
                        yield from sent(*block.edges(), parts, WIDTH - 1)
                        block = Block()
        if block.size:
            yield from sent(*block.edges(), parts, WIDTH - 1)
        give_back()

    return run


def by_part(rows: DataFrame, of: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """`of` each part's rows. Parts are dealt in turn, so that no task gets more than its share of them, as a hash
    of their numbers would give some."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            parts = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for begin, end in zip(cuts, cuts[1:]):
                if held and held[0].column(0)[0].as_py() != parts[begin]:
                    yield from of(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from of(pa.Table.from_batches(held)).to_batches()
        give_back()

    turn = F.pmod("part", F.lit(tasks)).cast("int")
    dealt = rows.withColumn("turn", turn).repartitionById(tasks, "turn").drop("turn").sortWithinPartitions("part")
    return dealt.mapInArrow(run, schema)


# ---- levels ------------------------------------------------------------------------------------


def _nodes(parts: int, least: int):
    """Completes edges and nodes; gives the frequent ones, the ends of words, and the flow into pairs."""

    def run(rows: pa.Table) -> pa.Table:
        (a, b, c, d), n, words = received(rows, WIDTH)
        full = d > 0
        often = full & (n >= least)
        found = [_found([x[often] for x in (a, b, c, d)], n[often], words)]
        (x, y, z), flow = added([a, b, c], n, len(words))
        node = z > 0
        often = node & (flow >= least)
        found.append(_found([v[often] for v in (x, y, z)], flow[often], words))
        # what ends at three words ends at the last two and at the last one as well
        stops = ~full
        last = np.where(c > 0, c, np.where(b > 0, b, a))[stops]
        (word,), ended = added([last], n[stops], len(words))
        found.append(_found([word], ended, words))
        three, two = stops & (c > 0), stops & (c == 0) & (b > 0)
        left = np.concatenate([x[node], b[three], a[two]])
        right = np.concatenate([y[node], c[three], b[two]])
        pair, through = added([left, right], np.concatenate([flow[node], n[three], n[two]]), len(words))
        done = pa.concat_arrays(found)
        out = [_batch(
            rows.column("part").combine_chunks()[:1] if rows.num_rows else pa.array([], pa.int64()),
            *(pa.array([None], pa.binary()) for _ in range(3)),
            pa.ListArray.from_arrays(pa.array([0, len(done)], pa.int32()), done),
        )]
        if len(through):
            out += sent(pair, through, words, parts, 2)
        return pa.Table.from_batches(out)

    return run


def _pairs(least: int):
    """Completes pairs; gives the frequent ones, and for each word what flows out of it here."""

    def run(rows: pa.Table) -> pa.Table:
        (a, b), n, words = received(rows, 2)
        lists = rows.column("found").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(_FOUND))
        often = n >= least
        (word,), flow = added([a], n, len(words))
        every = [lists.flatten().cast(_FOUND), _found([a[often], b[often]], n[often], words), _found([word], flow, words)]
        return pa.Table.from_batches([pa.RecordBatch.from_struct_array(x) for x in every])

    return run


def _parts(docs: DataFrame, text: str) -> int:
    """As many parts as the text needs, at least twice the shuffle's."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def counted(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", block: int = BLOCK) -> DataFrame:
    """(lang, k, phrase, f) of every word (k = 1), and of every phrase of 2 to `WIDTH` words of a piece that
    occurs `least` times or more. A null text is empty, a null language `UNKNOWN`."""
    parts = _parts(docs, text)
    blocks = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).mapInArrow(_blocks(parts, block), _SENT)
    pairs = by_part(by_part(blocks, _nodes(parts, least), _SENT), _pairs(least), _COUNTED)
    return pairs.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


# ---- collocations ------------------------------------------------------------------------------


def _of_parts(words: str, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates of `counts` that no longer one holds."""
    often = stored(counts.where(F.col("f") >= least).withColumn("words", F.split("phrase", " ")))
    candidates = often.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k", "words")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut",
        _of_parts("words", F.lit(1), F.col("cut")).alias("first"),
        _of_parts("words", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"),
    )
    left = often.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = often.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    # decimals: the product may pass 64 bits
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0))) div cast(l + r as decimal(19,0))")
    best = (
        cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
        .withColumn("score", score)
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("at"))
    )
    inner = F.expr(
        "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(words, i, m), ' '))))"
    )
    longer = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    held = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    whole = F.coalesce(100 * F.col("longer") < WITHIN * F.col("a"), F.lit(True))
    return best.join(held, ["lang", "phrase"], "left").where(whole).select("lang", "phrase", "a", "at.l", "at.r", "at.score")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, text: str = "text", lang: str = "lang") -> DataFrame:
    """The first `most` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    A-Z are lower-cased; pieces end at `.,;:!?` and at U+000A to U+000D; words are what spaces and tabs part. A
    candidate has 2 to 4 words and occurs `a` >= `least` times. Of its cuts the one with the lowest score
    floor(2000000 a / (l + r)) counts, of equal ones the first. A candidate inside a longer one with 80% of
    its occurrences goes. Order: score and a falling, phrase in UTF-8 order; so there are no ties.
    Null texts and texts without words give nothing, a null language is `und`; repeated rows count each time;
    other columns are ignored; an empty table gives an empty table.
    """
    counts = stored(counted(docs, least, text, lang))
    totals = counts.where("k = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # no task ranks a whole language: the first of each bucket, then the first of these
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    some = (
        scored(counts, least).withColumn("bucket", bucket)
        .withColumn("place", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order)))
        .where(F.col("place") <= most)
    )
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


#: Slow and plain: every run of words of every piece.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM listed, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k)),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, c.k, c.cut, l.f AS l, r.f AS r,
         CAST((CAST(2000000 AS HUGEINT) * c.f) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM often WHERE k > 1) c
  JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, w, f, k, m, unnest(range(1, k - m + 2)) AS i FROM often, (VALUES (2), (3)) AS t(m) WHERE k > m)
  GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase
  WHERE h.longer IS NULL OR 100 * h.longer < 80 * b.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, CAST(t.n AS BIGINT) AS n, k.score
FROM ranked k JOIN totals t ON t.lang = k.lang WHERE k.rank <= 2000
"""
