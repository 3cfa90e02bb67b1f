"""Benchmark decontamination by latent semantic retrieval.

1. The vocabulary is the benchmark's own words: no other word can take part in a match. Texts become
   numbers of words (0: another word), in one pass over them, and are written as such.
2. A passage is `PASSAGE` words. Word weights are inverse passage frequencies over the whole corpus.
3. A distributed randomised SVD gives the latent space of the TF-IDF passages A: with a random block G
   of words x (`RANK` + `EXTRA`), every task adds up its part of Z = A'(AG) over all its passages, and
   A'A is about Z (G'Z)^-1 Z' (Nystrom), whose leading eigenvectors are the right singular vectors. Z has
   as many rows as the vocabulary, so its size is the benchmark's, not the corpus's. Coordinates are
   divided by their singular values; else what all texts of a language share decides the cosine. Then
   each word's vector is brought to the length of its weight: their own lengths differ about tenfold, and
   an item of short ones beside words of long ones would be lost in the sum.
4. Two neighbouring passages are a window. Windows and items meet in the latent space: a window is a
   candidate for every item with a cosine of at least `COSINE` (a stated query set against all rows), if
   its words that the item has weigh `MASS` of what a passage (or a shorter item) of the item's words does.
5. Around a candidate, the longest common subsequence of words with the item is measured. The document
   is contaminated by the item if that is `SHARE` of the item's words; or, for paraphrases, if it is
   `PARAPHRASE` and the item's answer is there too (a column, else the last `ANSWER` words), also in order.
   An item of fewer than `SHORT` words has to stand in the text unbroken.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tables import mapped, stored, tidy

PASSAGE = 16
RANK = 128
EXTRA = 16
COSINE = 0.4
MASS = 0.4
SHARE = 0.8
PARAPHRASE = 0.6
ANSWER = 6
ANSWER_SHARE = 0.8
SHORT = 8
#: Slots for the words of an item; words that share one can only add candidates.
SLOTS = 4096
#: Passages whose latent vectors a task holds at once, in the sketch and (whole documents) in the search.
BLOCK = 8192
HELD = 40_000

#: ASCII other than letters and digits parts words.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PLAIN).split()


def word_masks(words: np.ndarray) -> dict[int, int]:
    """For each word, the places it has, as bits."""
    out: dict[int, int] = {}
    for i, word in enumerate(words.tolist()):
        out[word] = out.get(word, 0) | 1 << i
    return out


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    answer: np.ndarray

    def __post_init__(self):
        self.masks, self.answer_masks = word_masks(self.words), word_masks(self.answer)


@dataclass
class Questions:
    """The benchmark: a stated query set, held by every task. Items without words match nothing."""

    vocabulary: dict[bytes, int]
    items: list[Item]

    @classmethod
    def of(cls, rows: Iterable) -> Questions:
        vocabulary: dict[bytes, int] = {}
        items = []
        for item_id, text, answer in rows:
            words, told = words_of(text), words_of(answer)
            for word in (*words, *told):
                vocabulary.setdefault(word, len(vocabulary) + 1)
            number = lambda some: np.array([vocabulary[w] for w in some], dtype=np.int32)
            if words:
                items.append(Item(item_id, number(words), number(told or words[-ANSWER:])))
        return cls(vocabulary, items)


def passages(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' word numbers as rows of `PASSAGE`, filled up with 0, and the text of each row."""
    numbers = [np.frombuffer(e, "<i4") for e in encoded]
    rows = np.array([-(-len(n) // PASSAGE) for n in numbers], dtype=np.int64)
    out = np.zeros((int(rows.sum()), PASSAGE), dtype=np.int32)
    at = 0
    for n, count in zip(numbers, rows):
        out[at : at + count].reshape(-1)[: len(n)] = n
        at += count
    return out, np.repeat(np.arange(len(numbers)), rows)


def _encoded(docs: DataFrame, doc_id: str, text: str, questions) -> DataFrame:
    """(doc_id, text_hash, words): little-endian int32 numbers of all words of each text that has one of
    the vocabulary."""

    def make():
        known = questions.value.vocabulary.get

        def run(texts):
            out = []
            for t in texts:
                words = words_of(t)
                numbers = np.fromiter((known(w, 0) for w in words), "<i4", len(words))
                out.append(numbers.tobytes() if numbers.any() else None)
            return [pa.array(out, pa.binary())]

        return run

    named = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")
    )
    return mapped(named, "text", ["doc_id", "text_hash"], [("words", "binary")], make).where("words is not null")


def _frequencies(words: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many passages each word stands, and the number of passages with any."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(size + 1, dtype=np.int64), 0
        for batch in batches:
            rows, _ = passages(batch.column(0).to_pylist())
            rows = np.sort(rows[rows.any(axis=1)], axis=1)
            new = np.ones(rows.shape, dtype=bool)
            new[:, 1:] = rows[:, 1:] != rows[:, :-1]
            counts += np.bincount(rows[new], minlength=size + 1)
            total += len(rows)
        counts[0] = total
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["word", "n"])

    summed = words.select("words").mapInArrow(tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = np.zeros(size + 1, dtype=np.int64)
    for word, n in summed.collect():  # at most one row per word of the benchmark
        counts[word] = n
    return counts, int(counts[0])


def _latent(rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sum of the vectors of each passage's words."""
    out = np.empty((len(rows), vectors.shape[1]), dtype=np.float32)
    for at in range(0, len(rows), 2048):
        part = rows[at : at + 2048]
        out[at : at + 2048] = np.take(vectors, part.ravel(), axis=0).reshape(*part.shape, -1).sum(axis=1)
    return out


def _sketch(words: DataFrame, weighted: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Z = A'(AG) over all passages: rows by word, summed in Spark word by word."""
    shared = words.sparkSession.sparkContext.broadcast((weighted, weights))
    width = weighted.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, scale = shared.value
        total = np.zeros(vectors.shape, dtype=np.float64)
        for batch in batches:
            rows, _ = passages(batch.column(0).to_pylist())
            for at in range(0, len(rows), BLOCK):
                part = rows[at : at + BLOCK]
                latent = _latent(part, vectors)
                flat = part.ravel()
                order = np.argsort(flat, kind="stable")
                order = order[np.searchsorted(flat[order], 1) :]
                if not len(order):
                    continue
                found = flat[order]
                starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                total[found[starts]] += np.add.reduceat(latent[order // PASSAGE], starts, axis=0)
        total *= scale[:, None]
        some = np.flatnonzero(np.abs(total).sum(axis=1))
        values = pa.FixedSizeListArray.from_arrays(pa.array(total[some].ravel()), width).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(some), values], names=["word", "z"])

    parts = words.select("words").mapInArrow(tidy(run), "word long, z array<double>")
    summed = parts.groupBy("word").agg(*[F.sum(F.col("z")[k]).alias(f"z{k}") for k in range(width)])
    out = np.zeros(weighted.shape, dtype=np.float64)
    for row in summed.collect():  # at most one row per word of the benchmark
        out[row[0]] = row[1:]
    return out


def latent_space(words: DataFrame, size: int, rank: int = RANK, extra: int = EXTRA, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each word number, its weight times its row of the right singular vectors; and its weight."""
    counts, total = _frequencies(words, size)
    weights = np.log((1.0 + total) / (1.0 + counts))
    weights[0] = 0
    block = np.random.default_rng(seed).normal(size=(size + 1, rank + extra))
    block[0] = 0
    z = _sketch(words, (block * weights[:, None]).astype(np.float32), weights)
    # eigenvectors of Z (G'Z)^-1 Z', from a small shift for stability
    shift = 1e-6 * max(np.linalg.norm(z), 1e-12)
    z = z + shift * block
    middle = block.T @ z
    values, turns = np.linalg.eigh((middle + middle.T) / 2)
    half = turns / np.sqrt(np.maximum(values, shift))
    u, lengths, _ = np.linalg.svd(z @ half, full_matrices=False)
    k = min(rank, u.shape[1])
    whole = np.maximum(lengths[:k], 1e-6 * max(lengths[0], 1e-12))
    return (u[:, :k] / whole * weights[:, None]).astype(np.float32), weights.astype(np.float32)


def even(space: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The words' latent vectors with their directions, each as long as the word's weight."""
    lengths = np.linalg.norm(space.astype(np.float64), axis=1)
    return (space * (weights / np.where(lengths == 0, 1, lengths))[:, None]).astype(np.float32)


def common_subsequence(masks: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence with the `size` words whose places `masks` has."""
    full = (1 << size) - 1
    row = full
    for word in text:
        mask = masks.get(word)
        if mask:
            both = row & mask
            row = ((row + both) | (row - both)) & full
    return size - row.bit_count()


def unbroken(item: np.ndarray, text: np.ndarray) -> bool:
    if len(text) < len(item):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(text, len(item)) == item).all(axis=1).any())


def judged(item: Item, text: np.ndarray) -> tuple[float, bool, bool]:
    """(share of the item in the text, whether its answer is there, whether it counts)."""
    if len(item.words) < SHORT:
        found = unbroken(item.words, text)
        return float(found), found, found
    words = text.tolist()
    share = common_subsequence(item.masks, len(item.words), words) / len(item.words)
    if share < min(PARAPHRASE, SHARE):
        return share, False, False
    answered = common_subsequence(item.answer_masks, len(item.answer), words) >= ANSWER_SHARE * len(item.answer)
    return share, answered, share >= SHARE or (share >= PARAPHRASE and answered)


def _in_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut between documents into parts of about `HELD` passages."""
    for batch in batches:
        start = held = 0
        for i, words in enumerate(batch.column(2)):
            if held > HELD:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += len(words.as_buffer()) // (4 * PASSAGE) + 1
        yield batch.slice(start)


def _matches(space, questions, cosine: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (vectors, weights), items = space.value, questions.value.items
        if not items:
            return
        targets = np.stack([vectors[i.words].sum(axis=0) for i in items])
        norms = np.linalg.norm(targets, axis=1)
        lengths = np.array([len(i.words) for i in items])
        # no direction, or too few words for one: such items are candidates by their words alone
        blind = np.flatnonzero((norms == 0) | (lengths < SHORT))
        targets = targets / np.where(norms == 0, 1, norms)[:, None]
        holds = np.zeros((len(items), SLOTS + 1), dtype=bool)
        for q, item in enumerate(items):
            holds[q, item.words % SLOTS] = True
        mean = np.array([weights[i.words].mean() for i in items])
        needed = MASS * mean * np.minimum(lengths, PASSAGE)
        for batch in _in_parts(batches):
            encoded = batch.column(2).to_pylist()
            rows, owner = passages(encoded)
            slots = np.where(rows > 0, rows % SLOTS, SLOTS)
            mass = weights[rows]
            latent = _latent(rows, vectors)
            first = np.append(True, owner[1:] != owner[:-1])
            last = np.append(owner[1:] != owner[:-1], True)
            starts = np.flatnonzero(~last | first)  # windows of two passages; of one in texts that have one
            window = latent[starts] + np.where(last[starts, None], 0, latent[np.minimum(starts + 1, len(rows) - 1)])
            size = np.linalg.norm(window, axis=1)
            seen: dict[tuple[int, int], list[int]] = {}
            step = max(1, 4_000_000 // len(items))
            for at in range(0, len(starts), step):
                near = window[at : at + step] @ targets.T >= cosine * size[at : at + step, None]
                near[size[at : at + step] == 0] = False
                near[:, blind] = True
                here, asked = np.nonzero(near)
                for k in range(0, len(here), 50_000):
                    q, place = asked[k : k + 50_000], starts[at + here[k : k + 50_000]]
                    after = np.minimum(place + 1, len(rows) - 1)
                    shared = (holds[q[:, None], slots[place]] * mass[place]).sum(axis=1)
                    follows = (holds[q[:, None], slots[after]] * mass[after]).sum(axis=1)
                    kept = shared + np.where(last[place], 0, follows) >= needed[q]
                    for p, x in zip(place[kept].tolist(), q[kept].tolist()):
                        seen.setdefault((int(owner[p]), x), []).append(p)
            offset = np.searchsorted(owner, np.arange(len(encoded)))
            out: list[list] = [[], [], [], [], []]
            for (doc, q), places in seen.items():
                text = np.frombuffer(encoded[doc], "<i4")
                item, best, until = items[q], None, -1
                reach = len(item.words)
                for place in places:
                    low = max(0, (place - offset[doc]) * PASSAGE - reach)
                    high = (place - offset[doc] + 2) * PASSAGE + reach
                    if high <= until:
                        continue
                    until = high
                    share, answered, counts = judged(item, text[low:high])
                    if counts and (best is None or share > best[0]):
                        best = (share, answered)
                if best:
                    row = (batch.column(0)[doc].as_py(), batch.column(1)[doc].as_py(), item.item_id, *best)
                    for values, v in zip(out, row):
                        values.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            names = ["doc_id", "text_hash", "item_id", "share", "answered"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    return run


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    question: str = "text", answer: str | None = None, cosine: float = COSINE,
) -> DataFrame:
    """(doc_id, text_hash, item_id, share, answered): one row for each row of `docs` and item that
    contaminates it; `text_hash` is Spark's xxhash64 of the text.

    `share` is the part of the item's words found in order, the best in the document. Null and empty
    texts match nothing; rows that repeat an item or a document repeat the pairs; null ids are
    carried along; other columns are ignored; an empty table gives an empty table. The benchmark is
    the query set and is held by the driver and each task; `docs` is not.
    """
    spark = docs.sparkSession
    columns = [F.col(item_id).cast("long"), F.col(question), F.col(answer) if answer else F.lit(None).cast("string")]
    own = Questions.of(sorted(map(tuple, benchmark.select(*columns).collect()), key=repr))
    shared = spark.sparkContext.broadcast(own)
    words = stored(_encoded(docs, doc_id, text, shared))
    space, weights = latent_space(words, len(own.vocabulary))
    space = spark.sparkContext.broadcast((even(space, weights), weights))
    return words.select("doc_id", "text_hash", "words").mapInArrow(
        tidy(_matches(space, shared, cosine)),
        "doc_id long, text_hash long, item_id long, share double, answered boolean",
    )


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that no item contaminates, with all their columns. Rows are told apart by id
    and text, so rows without an id are judged by their own text."""
    found = leaks(docs, benchmark, doc_id, text).select(F.col("doc_id").alias("_shelfmark_id"), F.col("text_hash").alias("_shelfmark_hash"))
    spotted = stored(found.distinct())
    same = docs[doc_id].cast("long").eqNullSafe(spotted["_shelfmark_id"]) & (F.xxhash64(docs[text]) == spotted["_shelfmark_hash"])
    return docs.join(spotted, same, "left_anti")
