"""Quality rules: fixed thresholds on counts, and a calibrated logistic regression on hashed n-grams.

    p = sigmoid(A s + B),   s = b + sum_g SCALE * mean of w[slot] over the n-grams of group g

The groups are words, pairs of words, and bytes in runs of `BYTE_GRAMS`; every n-gram of a whole text has
one of `SLOTS` slots of its group. Means, not counts, are added up: the score does not grow with the
length of a text, and scoring needs neither a sort nor a vector per text.

The weights are learned on labelled rows outside the held-out fold (a bounded sample, `SAMPLE`), by L-BFGS
whose loss and slope are summed over the sample's rows in Spark. A and B (Platt's calibration) are fitted on
the part of these rows (`CALIBRATION` of 8) that the weights never saw.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.held import held_out
from shelfmark.llm.tables import mapped, stored

# ---- fixed values: the rules -------------------------------------------------------------------
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
WINDOW = 3
SYMBOLS = b"#*$%&|<>"
LEAST_PROBABILITY = 0.5
# ---- end of fixed values -----------------------------------------------------------------------

SPACE = b" \t\n\r\x0b\x0c"
BYTE_GRAMS = (2, 3, 4, 5)
BITS = 15
SLOTS = 1 << BITS
GROUPS = 2 + len(BYTE_GRAMS)
SCALE = 12.0
#: Rows of label 0, and of label 1 for each of them, that the model is learned from.
SAMPLE = 1000
PER_BAD = 3
CALIBRATION = 2
DECAY = 1e-4
#: Of the search for the weights: steps at most, and the relative fall of the loss that ends it.
STEPS = 25
LEAST_FALL = 3e-3
MEMORY = 8
#: Parts of the sample.
PARTS = 8
#: Bytes hashed at once.
SEGMENT = 1 << 22

_ODD = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F))


# ---- n-grams -----------------------------------------------------------------------------------


def _slot(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _ODD[1]
    return (h ^ (h >> np.uint32(13))) * _ODD[2] >> np.uint32(32 - BITS)


def word_slots(words: list[bytes]) -> list[np.ndarray]:
    """Slots of the words, and of the pairs of neighbours."""
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    return [_slot(h), _slot(h[:-1] * _ODD[0] + (h[1:] ^ (h[1:] >> np.uint32(7))) * _ODD[3])]


def byte_slots(data: np.ndarray, n: int) -> np.ndarray:
    """Slot of the n bytes that start at each place but the last n - 1."""
    length = max(0, len(data) - n + 1)
    h = np.zeros(length, dtype=np.uint32)
    for j in range(n):
        h = h * _ODD[0] + data[j : j + length]
    return _slot(h)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the features of one text; a text without n-grams has none."""
    data = (text or "").encode()
    lists = word_slots(data.split())
    padded = np.frombuffer(data + bytes(max(BYTE_GRAMS)), dtype=np.uint8)
    lists += [byte_slots(padded[: len(data) + n - 1], n) for n in BYTE_GRAMS] if data else []
    numbers, values = [], []
    for group, slots in enumerate(lists):
        if len(slots):
            counts = np.bincount(slots, minlength=SLOTS)
            here = np.flatnonzero(counts)
            numbers.append(here + group * SLOTS)
            values.append(counts[here] * (SCALE / len(slots)))
    if not numbers:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    return np.concatenate(numbers), np.concatenate(values)


# ---- counts ------------------------------------------------------------------------------------


def counts_of(texts: list[str | None]) -> tuple[np.ndarray, list[list[bytes]], list[bytes]]:
    """Per text: words, code points in words, symbols, repeated lines, words in repeated windows. And the
    words and bytes of each text."""
    out = np.zeros((len(texts), 5), dtype=np.int64)
    every, raw, numbers = [], [], []
    last = 0
    for i, text in enumerate(texts):
        text = text or ""
        data = text.encode()
        words = data.split()
        lines = [line for line in data.split(b"\n") if line.strip(SPACE)]
        out[i, :4] = (
            len(words),
            len(text) - len(data) + len(data.translate(None, SPACE)),
            len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)),
        )
        own = dict(zip(dict.fromkeys(words), range(last, last + len(words))))  # numbers of one text only
        last += len(own)
        numbers.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
        every.append(words)
        raw.append(data)
    out[:, 4] = _in_repeats(np.concatenate([np.zeros(0, np.int64), *numbers]), out[:, 0], max(1, last))
    return out, every, raw


def _in_repeats(words: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """How many words of each text stand in a window of `WINDOW` words that it has twice or more."""
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(words))  # words from here to the end of the text
    begins = np.flatnonzero(left >= WINDOW)
    key = words[begins]
    for j in range(1, WINDOW):
        key = np.unique(key, return_inverse=True)[1] * size + words[begins + j]
    _, which, often = np.unique(key, return_inverse=True, return_counts=True)
    twice = begins[often[which] > 1] if len(begins) else begins
    covered = np.zeros(len(words) + WINDOW, dtype=np.int64)
    for j in range(WINDOW):
        covered[twice + j] = 1
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[ends] - total[ends - lengths]


# ---- the model ---------------------------------------------------------------------------------


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, words: list[list[bytes]], texts: list[bytes]) -> np.ndarray:
        """The score s of each text."""
        total = np.full(len(texts), self.bias)
        kinds = self.weights.reshape(GROUPS, SLOTS)
        slots = word_slots(list(chain.from_iterable(words)))
        n = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(n) - n
        total += SCALE * _means(kinds[0][slots[0]], starts, n)
        total += SCALE * _means(kinds[1][slots[1]], starts, np.maximum(n - 1, 0))
        width = max(BYTE_GRAMS)
        data = np.frombuffer(b"".join([t + bytes(width) for t in texts]), dtype=np.uint8)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(n + width) - n - width
        for group, size in enumerate(BYTE_GRAMS, 2):
            summed = np.zeros(len(texts))
            for at in range(0, len(data), SEGMENT):
                part = kinds[group][byte_slots(data[at : at + SEGMENT + size - 1], size)]
                inside = np.clip(starts - at, 0, len(part)), np.clip(starts + n - at, 0, len(part))
                summed += _sums(part, inside[0], inside[1] - inside[0])
            total += SCALE * summed / np.maximum(n, 1)
        return total

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * scores + self.shift, -30, 30)))


def _sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts))
    full = np.flatnonzero(lengths)
    if len(full):
        # between the end of one and the start of the next lie values of none
        bounds = np.stack([starts[full], starts[full] + lengths[full]], 1).ravel()
        out[full] = np.add.reduceat(np.append(values, 0.0), bounds)[::2]
    return out


def _means(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return _sums(values, starts, lengths) / np.maximum(lengths, 1)


def minimised(
    start: np.ndarray, loss: Callable[[np.ndarray], tuple[float, np.ndarray]], steps: int, least_fall: float
) -> np.ndarray:
    """L-BFGS with halved steps; `loss` gives value and slope."""
    x, (value, slope) = start, loss(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way = slope.copy()
        pulls = []
        for s, y in reversed(moves):
            pulls.append((s @ way) / (s @ y))
            way -= pulls[-1] * y
        if moves:
            s, y = moves[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), pull in zip(moves, reversed(pulls)):
            way += (pull - (y @ way) / (s @ y)) * s
        step = 1.0 if moves else 1.0 / max(1.0, float(np.abs(slope).sum()))
        fall = float(slope @ way)
        if fall < 1e-9:
            break
        for _ in range(20):
            there, (new, bent) = x - step * way, loss(x - step * way)
            if new <= value - 1e-4 * step * fall:
                break
            step /= 2
        else:
            break
        if (there - x) @ (bent - slope) > 1e-12:
            moves = [*moves[1 - MEMORY :], (there - x, bent - slope)]
        done = value - new < least_fall * max(1e-3, value)
        x, value, slope = there, new, bent
        if done:
            break
    return x


def platt(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope s + shift) the share of label 1; with the counts smoothed by
    one of each label, as Platt does. Without both labels (1, 0): no calibration."""
    good, bad = float((labels == 1).sum()), float((labels == 0).sum())
    if not good or not bad:
        return 1.0, 0.0
    wanted = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))

    def loss(x):
        z = np.clip(x[0] * scores + x[1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        return float(np.mean(np.logaddexp(0, z) - wanted * z)), np.array([np.mean((p - wanted) * scores), np.mean(p - wanted)])

    slope, shift = minimised(np.array([1.0, 0.0]), loss, 200, 1e-9)
    return (float(slope), float(shift)) if slope > 0 else (1.0, 0.0)


# ---- Spark -------------------------------------------------------------------------------------


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(fold, label, numbers, x): features of at most `sample` texts of label 0 and `PER_BAD` times as many
    of label 1, outside the held-out fold. Ids without one clear label 0 or 1 and null ids are not used; of
    rows that repeat an id, the text with the least hash is."""
    clear = (
        labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    )
    first = lambda label, n: clear.where(F.col("low") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = first(0, sample).unionByName(first(1, PER_BAD * sample)).select("doc_id", F.col("low").cast("int").alias("label"))
    found = (
        docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # (1 + PER_BAD) * sample rows at most
        .groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(8)).cast("int"))
        .repartition(PARTS)
    )

    def make():
        def run(texts):
            pairs = [features(t) for t in texts]
            return [
                pa.array([numbers.astype("<i4").tobytes() for numbers, _ in pairs], pa.binary()),
                pa.array([x.astype("<f4").tobytes() for _, x in pairs], pa.binary()),
            ]

        return run

    made = mapped(found, "text", ["fold", "label"], [("numbers", "binary"), ("x", "binary")], make)
    return stored(made).coalesce(PARTS)  # each part sends a slope of the size of the model


def _rows(batch: pa.RecordBatch):
    """Numbers, values, lengths and labels of a batch of features."""
    numbers = [np.frombuffer(b, "<i4") for b in batch.column("numbers").to_pylist()]
    x = [np.frombuffer(b, "<f4") for b in batch.column("x").to_pylist()]
    n = np.fromiter(map(len, numbers), np.int64, len(numbers))
    flat = np.concatenate([np.zeros(0, "<i4"), *numbers]).astype(np.int64), np.concatenate([np.zeros(0), *x])
    return *flat, n, batch.column("label").to_numpy().astype(float)


def _scores(numbers, x, n, weights) -> np.ndarray:
    return _sums(weights[numbers] * x, np.cumsum(n) - n, n)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from `sample_of`; without both labels every text gets the share of label 1 (0.5 if none).

    Both labels weigh the same in the loss; calibration brings their shares back."""
    spark = docs.sparkSession
    size = GROUPS * SLOTS
    rows = sample_of(docs, labels, sample)
    counted = {(r.label, r.learn): r.n for r in rows.groupBy("label", (F.col("fold") >= CALIBRATION).alias("learn")).agg(F.count("*").alias("n")).collect()}
    total = sum(counted.values())
    good = sum(n for (label, _), n in counted.items() if label == 1)
    if not 0 < good < total:
        share = good / total if total else 0.5
        return Model(30.0 * (2 * share - 1), np.zeros(size))
    whole = not all(counted.get((label, True)) for label in (0, 1))  # too few to part: learn from all of them
    learned = rows if whole else rows.where(F.col("fold") >= CALIBRATION)
    n = [sum(n for (label, learn), n in counted.items() if label == k and (whole or learn)) for k in (0, 1)]
    share = np.array([0.5 / n[0], 0.5 / n[1]])

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(at)

        def run(batches):
            bias, weights = sent.value[0], sent.value[1:]
            value, slope = 0.0, np.zeros(size + 1)
            for batch in batches:
                numbers, x, n, label = _rows(batch)
                z = np.clip(_scores(numbers, x, n, weights) + bias, -30, 30)
                weight = share[label.astype(np.int64)]
                value += float((weight * (np.logaddexp(0, z) - label * z)).sum())
                pull = weight * (1 / (1 + np.exp(-z)) - label)
                slope[0] += pull.sum()
                slope[1:] += np.bincount(numbers, np.repeat(pull, n) * x, size)
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([slope.tobytes()])], names=["value", "slope"])

        got = learned.mapInArrow(run, "value double, slope binary").collect()  # one row for each part of the sample
        sent.unpersist()
        value = sum(r.value for r in got) + DECAY / 2 * float(at[1:] @ at[1:])
        slope = np.sum([np.frombuffer(r.slope) for r in got], axis=0)
        slope[1:] += DECAY * at[1:]
        return value, slope

    best = minimised(np.zeros(size + 1), loss, STEPS, LEAST_FALL)
    model = Model(float(best[0]), best[1:].astype(np.float32))
    seen = rows if whole else rows.where(F.col("fold") < CALIBRATION)
    sent = spark.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            numbers, x, n, label = _rows(batch)
            s = _scores(numbers, x, n, sent.value.weights) + sent.value.bias
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(label)], names=["s", "label"])

    pairs = seen.mapInArrow(scored, "s double, label double").collect()  # a part of the sample
    order = sorted((r.s, r.label) for r in pairs)
    slope, shift = platt(np.array([s for s, _ in order]), np.array([label for _, label in order]))
    return replace(model, slope=slope, shift=shift)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_rules(docs: DataFrame, model: Model, kept: list[str], text: str = "text") -> DataFrame:
    """`kept` columns (those named as a made one are replaced), the counts of `COUNTS`, and `probability` that
    the text is of good quality. A null text counts as empty; an empty one gets a probability as well."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def run(texts):
            counts, words, data = counts_of(texts)
            return [*(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(own.probability(own.raw(words, data)))]

        return run

    return mapped(docs, text, kept, [*((name, "long") for name in COUNTS), ("probability", "double")], make)


def judged(docs: DataFrame, labels: DataFrame, least: float = LEAST_PROBABILITY) -> DataFrame:
    """One row per row of `docs`: (doc_id, the counts, base_failed, probability, kept).

    Words stand between ASCII white space; a line is repeated if it has a word and equals an earlier one of
    its text. `base_failed`: fewer than `LEAST_WORDS` words, or more than `MOST_REPEATED` per cent of them in
    windows of `WINDOW` words found twice or more. `kept`: not failed, and a probability of `least` or more.
    Null and empty texts have no words and fail; repeated rows and null ids stay; equal texts get equal
    rows; other columns are ignored; an empty table gives an empty table.
    """
    rows = docs.select("doc_id", F.col("text").alias("text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        with_rules(rows, train(docs, labels), ["doc_id"])
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= least))
        .select("doc_id", *COUNTS, "base_failed", "probability", "kept")
    )
