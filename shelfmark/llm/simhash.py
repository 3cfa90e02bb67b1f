"""SimHash near-dedup with keys from the perfect binary Golay code (23, 12, 7).

A fingerprint has 64 bits in three segments of 22, 21 and 21 bits, each read as a word of the Golay
code (missing bits are 0). A word has as keys the codewords that it and its one-bit neighbours decode
to (1 or 6 of them). Two words that differ in two bits or fewer share a key: some word lies within one
bit of both.

Pigeonhole for at most four differing bits e1 + e2 + e3:
* some segment has none: one of the other two has at most two. Keys: that segment exactly, with the
  Golay keys of another one (6 ordered pairs of segments).
* none is free of them: they are 1, 1, 1 or 1, 1, 2 in some order. Two segments have exactly one, so
  that one half of each is equal; the third has at most two. Keys: a half of each of the two, with the
  Golay keys of the third (3 x 2 x 2 combinations).
So no link is lost, and a key holds 33 to 34 fixed bits. Every pair that meets is verified by its bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.components import components
from shelfmark.llm.tables import mapped, quoted, smallest_labels, sorted_chunks, stored, tidy

SEED = 42
WIDTH = 4
BITS = 4
#: Rows of a key that one task compares at once; a key with more is split into pairs of parts.
PART = 512
#: Near copies of the corpus: words of a shingle, Jaccard similarity, keys a text, least hashes a key.
COPY_WIDTH = 5
SIMILARITY = 0.8
COPY_BANDS = 16
COPY_ROWS = 4
#: Of these keys, the first ones that are tried; the others meet only what these have not connected.
COPY_FIRST = 4
#: In place of a band's number: the key is a group of near fingerprints.
GROUP = -1
#: Sets, and bytes of sets, of a key that one task compares at once.
COPY_PART = 512
COPY_BYTES = 4 << 20

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code.
GENERATOR = 0b110001110101


# ---- fingerprints ---------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _lanes() -> np.ndarray:
    """For each byte, its 8 bits in the 8 bytes of a word, lowest bit in the lowest byte."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8").ravel()


def shingle_hashes(text: bytes, width: int = WIDTH) -> list[int]:
    """XXH64 of every shingle of `width` words, repeats included; of all words if there are fewer."""
    words = text.lower().split()  # bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]


def fingerprints(texts: Iterable[bytes | None], width: int = WIDTH) -> np.ndarray:
    """One 64-bit fingerprint per text: a bit is 1 if over half of the shingle hashes have it."""
    hashes: list[int] = []
    counts: list[int] = []
    for text in texts:
        own = shingle_hashes(text or b"", width)
        hashes += own
        counts.append(len(own))
    return majorities(np.array(hashes, dtype="<u8"), np.array(counts, dtype=np.int64))


def majorities(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of n[0], n[1], ... hashes; of none: 0."""
    out = np.zeros(len(n), dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    ends = np.cumsum(n[full])
    begins = ends - n[full]
    # pieces of at most 255 hashes, so that the byte lanes can't overflow
    pieces = np.maximum(1, -(-n[full] // 255))
    owner = np.repeat(np.arange(len(full)), pieces)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    at = begins[owner] + 255 * (np.arange(len(owner)) - first[owner])
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        summed = np.add.reduceat(_lanes()[octets[:, k]], at)
        ones = np.add.reduceat(summed.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = 2 * ones > n[full][:, None]
        for j in range(8):
            out[full] |= over[:, j].astype(np.uint64) << np.uint64(8 * k + j)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fp", keep_text: bool = False) -> DataFrame:
    """`docs`, without its text unless asked, with the fingerprint as a long; null or wordless texts get 0."""

    kept = [c for c in docs.columns if keep_text or c != text]
    make = lambda: lambda texts: [pa.array(fingerprints(texts).view(np.int64))]
    return mapped(docs, docs[quoted(text)].cast("binary"), kept, [(into, "long")], make)


# ---- Golay keys -----------------------------------------------------------------------------


@lru_cache(maxsize=1)
def golay_decoder() -> tuple[np.ndarray, np.ndarray]:
    """Parity of each 12-bit message, and the word of weight <= 3 that each syndrome stands for."""
    parity = np.zeros(4096, dtype=np.int64)
    for message in range(4096):
        rest = message << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        parity[message] = rest
    errors = np.zeros(2048, dtype=np.int64)
    ones = [1 << i for i in range(23)]
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                word = ones[a] | ones[b] | ones[c]
                errors[parity[word >> 11] ^ (word & 2047)] = word
    return parity, errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """Number of the codeword nearest to each 23-bit word; one always lies within three bits."""
    parity, errors = golay_decoder()
    return (words ^ errors[parity[words >> 11] ^ (words & 2047)]) >> 11


def golay_keys(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(n x 6) codewords of each word and its neighbours within `bits` bits, and which of them count."""
    near = np.concatenate([np.zeros(1, np.int64), 1 << np.arange(bits, dtype=np.int64)])
    found = np.sort(golay_index(words[:, None] ^ near), axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    place = np.cumsum(new, axis=1) - 1
    keys = np.zeros((len(words), 6), dtype=np.int64)
    valid = np.zeros((len(words), 6), dtype=bool)
    rows, columns = np.nonzero(new)
    keys[rows, place[rows, columns]] = found[rows, columns]
    valid[rows, place[rows, columns]] = True
    return keys, valid


def _exact_parts(parts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, int]]:
    """The 18 combinations of the proof: the bits that must be equal, and the segment that gives the Golay keys."""
    halves = [(p & 2047, p >> 11) for p in parts]
    for same in range(3):
        for other in range(3):
            if same != other:
                yield parts[same], other
    for third in range(3):
        i, j = (k for k in range(3) if k != third)
        for one in halves[i]:
            for two in halves[j]:
                yield one << 11 | two, third


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    words = fps.view(np.uint64)
    return [((words >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]


def fingerprint_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints (int64), with the position of the fingerprint each belongs to."""
    parts = _segments(fps)
    golay = [golay_keys(p, b) for p, (_, b) in zip(parts, SEGMENTS)]
    rows, keys = [], []
    for kind, (exact, third) in enumerate(_exact_parts(parts)):
        values, valid = golay[third]
        row, column = np.nonzero(valid)
        rows.append(row)
        keys.append((np.int64(kind) << 40) | (exact[row] << 12) | values[row, column])
    return np.concatenate(keys), np.concatenate(rows)


def _keys_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for at in range(0, len(fps), 2000):
            keys, rows = fingerprint_keys(fps[at : at + 2000])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[at + rows])], names=["key", "fp"])


def _exact_keys_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        keys = [(np.int64(kind) << 28) | exact for kind, (exact, _) in enumerate(_exact_parts(_segments(fps)))]
        for own in keys:
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(fps)], names=["key", "fp"])


# ---- links ----------------------------------------------------------------------------------


def _links(bits: int, exact: bool = False):
    """Of the fingerprints of each key, edges that connect what chains of links connect. With `exact`, keys
    are those of `_exact_keys_of`, and only fingerprints that share a Golay key too are compared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, starts in sorted_chunks(batches, ["key", "low", "high"], 50_000 if exact else 200_000):
            fps = chunk.column("fp").to_numpy().view(np.uint64)  # bitwise_count takes magnitudes
            ends = np.append(starts[1:], len(fps))
            at = np.arange(len(fps))
            if exact:
                group = np.repeat(np.arange(len(starts)), ends - starts)
                at, code = _golay_codes(fps, group, chunk.column("key").to_numpy() >> 28)
                ends = np.append(np.flatnonzero(code[1:] != code[:-1]) + 1, len(code))
                starts = np.append(0, ends[:-1])
            end = np.repeat(ends, ends - starts)
            rows = np.arange(len(at))
            left, right, step = [], [], 0
            while len(rows):
                step += 1
                rows = rows[rows + step < end[rows]]
                differ = np.bitwise_count(fps[at[rows]] ^ fps[at[rows + step]])
                linked = rows[differ <= bits]
                left.append(at[linked])
                right.append(at[linked + step])
            label = smallest_labels(len(fps), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(label != np.arange(len(fps)))
            if len(moved):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fps[x].view(np.int64)) for x in (moved, label[moved])], names=["a", "b"]
                )

    return run


def _golay_codes(fps: np.ndarray, group: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint's place once for every Golay key, and the number of its group with that key, in that order."""
    thirds = np.array([third for _, third in _exact_parts(_segments(fps[:0]))])[kind]
    places, codes = [], []
    for third, (segment, (_, bits)) in enumerate(zip(_segments(fps), SEGMENTS)):
        own = np.flatnonzero(thirds == third)
        values, valid = golay_keys(segment[own], bits)
        row, column = np.nonzero(valid)
        places.append(own[row])
        codes.append(group[own[row]] << 12 | values[row, column])
    place, code = np.concatenate(places), np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    return place[order], code[order]


def fingerprint_links(distinct: DataFrame, bits: int = BITS, part: int = PART, exact: bool = False) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints `fp` that chains of links of at most
    `bits` <= 4 differing bits connect: each task gives a forest, not all pairs.

    With `exact`, rows travel by the equal bits of a key alone, 18 times for up to 88, and meet by Golay keys
    in the task: a fifth of the shuffle."""
    spark = distinct.sparkSession
    keyed = distinct.select("fp").mapInArrow(tidy(_exact_keys_of if exact else _keys_of), "key long, fp long")
    hot = stored(
        keyed.groupBy("key").count().where(F.col("count") > part)
        .select("key", F.ceil(F.col("count") / part).alias("parts"))
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    dealt = (
        keyed.join(hot, "key", "left")
        .withColumn("own", F.when(F.col("parts").isNotNull(), own).otherwise(F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    )
    return (
        dealt.repartition(tasks, "key", "low", "high")
        .sortWithinPartitions("key", "low", "high")
        .mapInArrow(tidy(_links(bits, exact)), "a long, b long")
    )


def _groups(marked: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(fp, component, component_id) for every fingerprint in `marked` (doc_id, fp)."""
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(fingerprint_links(distinct) if links is None else links)
    grouped = stored(
        distinct.join(found, F.col("fp") == F.col("node"), "left")
        .select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    )
    smallest = stored(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")))
    return stored(grouped.join(smallest, "component").select("fp", "component", "component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc_id, fingerprint, component_id).

    Null, empty and wordless texts have fingerprint zero and link like any other; repeated rows give
    repeated rows; a null id takes part, but is never the smallest of its component unless all are
    null. Columns beyond the two are ignored. An empty table gives an empty table.
    """
    marked = stored(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    return marked.join(_groups(marked), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# ---- near copies for the corpus ---------------------------------------------------------------


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = COPY_BANDS * COPY_ROWS
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted, distinct hashes of the shingles of `COPY_WIDTH` words."""
    return np.unique(np.array(shingle_hashes(text or b"", COPY_WIDTH), dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band: the band's number and the least values of the set under its permutations."""
    scale, shift = _permutations()
    least = np.full(len(scale), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096, None] * scale + shift).min(axis=0))
    rows = least.reshape(COPY_BANDS, COPY_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], dtype=np.uint64).view(np.int64)


def _copy_keys(prints: bool = False):
    """Of each text: a hash of its shingle set, the set's size, its band keys, and if asked its fingerprint."""

    def run(texts):
        sets = [shingle_set(t) for t in texts]
        own = [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]
        keys = [band_keys(s).tolist() if len(s) else [] for s in sets]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        made = [pa.array(np.array(own, dtype=np.uint64).view(np.int64)), pa.array(sizes), pa.array(keys, pa.list_(pa.int64()))]
        if prints:
            made.append(pa.array(majorities(np.concatenate([np.zeros(0, "<u8"), *sets]), sizes).view(np.int64)))
        return made

    return run


def _copy_links(similarity: float):
    """Of the sets of each key, edges that connect what chains of pairs with that Jaccard similarity
    connect: each set is compared exactly with all that are not reached yet."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, starts in sorted_chunks(batches, ["key", "low", "high"], 4_000):
            ids, column = chunk.column("fp").to_numpy(), chunk.column("shingles").combine_chunks()
            left, right = [], []
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                part = column.slice(at, end - at)
                flat = np.unique(part.flatten().to_numpy(), return_inverse=True)[1]
                sizes = np.diff(part.offsets.to_numpy())
                begins = np.cumsum(sizes) - sizes
                mark = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
                free = np.ones(end - at, dtype=bool)
                todo: list[int] = []
                while free.any():
                    if not todo:
                        todo.append(int(np.argmax(free)))
                        free[todo[0]] = False
                    one = todo.pop()
                    rest = np.flatnonzero(free)
                    # sets too small or too large for the similarity are out without a look
                    small, large = np.minimum(sizes[rest], sizes[one]), np.maximum(sizes[rest], sizes[one])
                    rest = rest[small >= similarity * large]
                    if not len(rest):
                        continue
                    own = flat[begins[one] : begins[one] + sizes[one]]
                    mark[own] = True
                    n = sizes[rest]
                    first = np.cumsum(n) - n
                    places = np.arange(int(n.sum())) + np.repeat(begins[rest] - first, n)
                    both = np.add.reduceat(mark[flat[places]].astype(np.int64), first)
                    mark[own] = False
                    linked = rest[both >= similarity * (n + sizes[one] - both)]
                    free[linked] = False
                    todo += linked.tolist()
                    left.append(np.full(len(linked), ids[at + one]))
                    right.append(ids[at + linked])
            if left:
                arrays = [pa.array(np.concatenate(x)) for x in (left, right)]
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    return run


def _links_of_keys(met: DataFrame, sets: DataFrame, similarity: float, part: int, every: bool) -> DataFrame:
    """Edges between the sets (fp, shingles) that share a key of `met` (fp, n, component, key).

    A key all of whose sets are of one component already tells nothing; of keys with the same sets one is
    enough. A key with more sets than a part holds is cut into parts: with `every`, each pair of parts meets;
    else each part by itself, with the key's first set in all of them, which connects most of a group of
    copies at a cost that grows with its size only.
    """
    tasks = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = met.groupBy("key").agg(
        F.count("*").alias("c"), F.sum("n").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.min("fp").alias("first"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"),
    )
    parts = F.greatest(F.ceil(F.col("c") / part), F.ceil(8 * F.col("size") / COPY_BYTES))
    shared = stored(
        groups.where("c > 1 and low <> high").withColumn("parts", parts)
        .groupBy("c", "x", "y").agg(F.min(F.struct("key", "parts", "first")).alias("k")).select("k.*")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    all_parts = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    dealt = met.select("fp", "key").join(shared, "key").withColumn("own", own)
    if every:
        dealt = dealt.withColumn("other", F.explode(all_parts))
    else:
        places = F.when(F.col("fp") == F.col("first"), all_parts).otherwise(F.array("own"))
        dealt = dealt.withColumn("own", F.explode(places)).withColumn("other", F.col("own"))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    return (
        dealt.join(sets, "fp").select("key", "low", "high", "fp", "shingles")
        .repartition(tasks, "key", "low", "high")
        .sortWithinPartitions("key", "low", "high")
        .mapInArrow(tidy(_copy_links(similarity)), "a long, b long")
    )


def print_groups(marked: DataFrame) -> DataFrame:
    """(fp, key) of the sets of `marked` (fp, n, print) whose SimHash fingerprints chains of `BITS` differing bits
    connect with another set's: sets of one key have fingerprints of one component."""
    prints = stored(marked.where("n > 0").select("fp", "print").distinct())
    found = components(fingerprint_links(prints.select(F.col("print").alias("fp")).distinct(), exact=True))
    keyed = stored(
        prints.join(found, F.col("print") == F.col("node"), "left").select("fp", F.coalesce("component", "print").alias("key"))
    )
    return keyed.join(keyed.groupBy("key").count().where("count > 1").select("key"), "key").select("fp", "key")


def copy_links(
    texts: DataFrame, marked: DataFrame, similarity: float = SIMILARITY, part: int = COPY_PART, groups: DataFrame | None = None
) -> DataFrame:
    """Edges (a, b) between the sets `fp` of `marked` (doc_id, text_hash, fp, n, bands), which connect exactly
    what chains of similar sets that share a band key, or a key of `groups` (fp, key), connect. `texts` has
    (doc_id, text_hash, text).

    The sets that share a key with another are made again from their texts, once. First the sets of a group
    meet, in parts; then, of those that are not connected yet, the parts of `COPY_FIRST` band keys; at last
    all keys of either kind whose sets these have not connected, whole.
    """
    rows = stored(
        marked.groupBy("fp", "text_hash", "doc_id")
        .agg(F.first("n").alias("n"), F.first("bands").alias("bands"), (F.count("*") > 1).alias("repeated"))
        .groupBy("fp").agg(F.min_by(F.struct("n", "bands", "repeated", "text_hash", "doc_id"), F.struct("text_hash", "doc_id")).alias("r"))
        .select("fp", "r.*")
    )
    keyed = rows.select("fp", "n", F.posexplode("bands").alias("band", "key"))
    shared = stored(keyed.groupBy("key").count().where("count > 1").select("key"))
    met = keyed.join(shared, "key").select("fp", "n", "band", "key")
    if groups is not None:
        met = met.unionByName(rows.join(groups, "fp").select("fp", "n", F.lit(GROUP).alias("band"), "key"))
    met = stored(met)
    asked = stored(
        rows.join(met.select("fp").distinct(), "fp", "left_semi")
        .select("fp", F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), "repeated")
    )
    found = texts.join(asked, texts["doc_id"].eqNullSafe(asked["id"]) & (texts["text_hash"] == asked["h"])).select("fp", "repeated", "text")
    if not asked.where("repeated").isEmpty():
        found = found.where("not repeated").unionByName(found.where("repeated").dropDuplicates(["fp"]))
    sets = stored(
        mapped(
            found, found["text"].cast("binary"), ["fp"], [("shingles", "array<long>")],
            lambda: lambda some: [pa.array([shingle_set(t).view(np.int64) for t in some], pa.list_(pa.int64()))],
        )
    )
    links = None
    for tried in ([F.col("band") == GROUP] if groups is not None else []) + [F.col("band").between(0, COPY_FIRST - 1)]:
        new = stored(_links_of_keys(_open(met.where(tried), links), sets, similarity, part, every=False))
        links = new if links is None else links.unionByName(new)
    return links.unionByName(_links_of_keys(_open(met, links), sets, similarity, part, every=True))


def _open(met: DataFrame, links: DataFrame | None) -> DataFrame:
    """`met` with the component of each set by the `links` so far."""
    if links is None:
        return met.withColumn("component", F.col("fp"))
    joined = stored(components(links))
    return met.join(joined, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs`, with all its columns, of each group of near copies: of those with the smallest
    id (null if no row has one) the one with the least text hash; of rows equal in both, any.

    Near copies share `SIMILARITY` of their distinct shingles of `COPY_WIDTH` words (of all words if there
    are fewer), and chains of them are one group. Texts with equal shingles are equal; so are null, empty
    and wordless ones. Candidates are first the sets whose SimHash fingerprints lie within `BITS` bits, found by
    their Golay keys without loss; each is compared exactly. But sets at the similarity differ in about 10 of 64
    bits. So sets that share one of `COPY_BANDS` keys of `COPY_ROWS` least hashes are candidates too, as far as
    the fingerprints have not connected them; a pair at the similarity has none in (1 - 0.8 ** 4) ** 16 = 0.02%
    of cases.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    made = [("fp", "long"), ("n", "long"), ("bands", "array<long>"), ("print", "long")]
    marked = stored(mapped(named, named["text"].cast("binary"), ["doc_id", "text_hash"], made, lambda: _copy_keys(prints=True)))
    groups = _groups(marked, copy_links(named, marked, groups=print_groups(marked)))
    once = marked.groupBy("doc_id", "fp", "text_hash").agg((F.count("*") > 1).alias("many"))
    kept = stored(
        once.join(groups, "fp").where("doc_id <=> component_id")
        .groupBy("component").agg(F.min_by(F.struct("doc_id", "text_hash", "many"), "text_hash").alias("k"))
        .select(F.col("k.doc_id").alias("_shelfmark_id"), F.col("k.text_hash").alias("_shelfmark_kept"), "k.many")
    )
    rows = docs.withColumn("_shelfmark_hash", F.xxhash64(docs[text]))
    same = rows[doc_id].eqNullSafe(kept["_shelfmark_id"]) & (rows["_shelfmark_hash"] == kept["_shelfmark_kept"])
    left = rows.join(kept, same, "left_semi")
    if not kept.where("many").isEmpty():  # else no row that stays is repeated, and the texts need not move again
        left = left.dropDuplicates([doc_id, "_shelfmark_hash"])
    return left.select(*map(quoted, docs.columns))
