"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The last sum is all pairwise interactions at a cost linear in the features that a text has. Features of
a whole text: its distinct words, hashed, together of length one; and statistics of its structure, each
in one of `STEPS` steps: case, digits, symbols, repeats of words and lines, lengths. The model is learned
on a bounded sample of labelled rows (`SAMPLE` of label 0 and three times as many of label 1, about
their shares among rows, the first by a hash of the id) and is of fixed size.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.held import held_out
from shelfmark.llm.tables import mapped

WORD_SLOTS = 1 << 14
STEPS = 12
STATISTICS = 13
RANK = 8
SAMPLE = 1500
PER_BAD = 3
THRESHOLD = 0.7
WINDOW = 50
EPOCHS = 12
LEAST_STEPS = 600
RATE = 0.02
DECAY = 1e-4

_SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]|\\_=+/", dtype=np.uint8)


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Shares of the text's structure, each from 0 to 1."""
    data = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    size, n = max(1, int(data.sum())), max(1, len(words))
    letters = max(1, int(data[65:91].sum() + data[97:123].sum() + data[192:].sum()))
    windows = [len(set(words[i : i + WINDOW])) / len(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]
    lines = text.split("\n")
    return [
        data[65:91].sum() / letters,
        min(1.0, 5 * data[48:58].sum() / size),
        min(1.0, 10 * data[_SYMBOLS].sum() / size),
        min(1.0, 10 * data[33] / size),
        min(1.0, 10 * (data[44] + data[46]) / size),
        min(1.0, 2 * data[32] / size),
        counts["|"] / n,
        sum(windows) / max(1, len(windows)),
        max(counts.values(), default=0) / n,
        1 - len(set(lines)) / len(lines),
        min(1.0, size / n / 20),
        min(1.0, math.log2(1 + len(words)) / 16),
        min(1.0, 20 * (len(lines) - 1) / n),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the features that a text has; a null or wordless one has statistics only."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    crc = zlib.crc32
    slots = np.fromiter((crc(w.encode()) for w in counts), np.int64, len(counts)) % WORD_SLOTS
    steps = np.minimum((np.array(statistics(text, words, counts)) * STEPS).astype(np.int64), STEPS - 1)
    steps += WORD_SLOTS + STEPS * np.arange(STATISTICS)
    value = 1 / math.sqrt(len(slots)) if len(slots) else 0.0
    numbers = np.concatenate([slots, steps])
    return numbers, np.concatenate([np.full(len(slots), value), np.full(STATISTICS, STATISTICS**-0.5)])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, text: str | None) -> float:
        numbers, x = features(text)
        mixed = self.factors[numbers] * x[:, None]
        pairs = (mixed.sum(0) ** 2 - (mixed**2).sum(0)).sum() / 2
        total = self.bias + float(self.weights[numbers] @ x) + float(pairs)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> Machine:
    """Adam on the logistic loss, in small batches; without both labels, the share of label 1."""
    size = WORD_SLOTS + STEPS * STATISTICS
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        return Machine(30.0 * (2 * share - 1), np.zeros(size), np.zeros((size, RANK)))
    state = {"b": np.zeros(1), "w": np.zeros(size), "v": rng.normal(0, 0.05, (size, RANK))}
    first = {k: np.zeros_like(x) for k, x in state.items()}
    second = {k: np.zeros_like(x) for k, x in state.items()}
    step = 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * 64 // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 64):
            batch = order[at : at + 64]
            numbers = np.concatenate([rows[i][0] for i in batch])
            x = np.concatenate([rows[i][1] for i in batch])
            lengths = np.array([len(rows[i][0]) for i in batch])
            starts, owner = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(batch)), lengths)
            mixed = state["v"][numbers] * x[:, None]
            summed = np.add.reduceat(mixed, starts)
            pairs = (summed**2 - np.add.reduceat(mixed**2, starts)).sum(1) / 2
            total = state["b"] + np.add.reduceat(state["w"][numbers] * x, starts) + pairs
            error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - labels[batch]) / len(batch)
            pull = error[owner] * x
            each = pull[:, None] * (summed[owner] - mixed)
            slope = {
                "b": np.array([error.sum()]),
                "w": np.bincount(numbers, pull, size) + DECAY * state["w"],
                "v": np.stack([np.bincount(numbers, each[:, f], size) for f in range(RANK)], 1) + DECAY * state["v"],
            }
            step += 1
            for k, g in slope.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                bent = np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8
                state[k] -= RATE * first[k] / (1 - 0.9**step) / bent
    return Machine(float(state["b"][0]), state["w"], state["v"])


# ---- Spark ----------------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learns from at most `sample` ids of label 0 and `PER_BAD` times as many of label 1, outside the
    held-out fold. Ids without one clear
    label, null ids and labels other than 0 and 1 are not used."""
    clear = (
        labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    )
    first = lambda label, n: clear.where(F.col("low") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    bound = (1 + PER_BAD) * sample
    picked = first(0, sample).unionByName(first(1, PER_BAD * sample)).select("doc_id", F.col("low").alias("quality"))
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # `bound` rows at most

    def make():
        def run(texts):
            pairs = [features(t) for t in texts]
            return [
                pa.array([numbers.astype("<i4").tobytes() for numbers, _ in pairs], pa.binary()),
                pa.array([values.astype("<f4").tobytes() for _, values in pairs], pa.binary()),
            ]

        return run

    made = mapped(joined, "text", ["doc_id", "quality"], [("numbers", "binary"), ("x", "binary")], make)
    # ids are unique as a rule; rows that repeat an id must not break the bound
    rows = sorted(made.limit(bound).collect(), key=lambda r: (r.doc_id, bytes(r.numbers)))
    return learn(
        [(np.frombuffer(r.numbers, "<i4").astype(np.int64), np.frombuffer(r.x, "<f4").astype(float)) for r in rows],
        np.array([r.quality for r in rows], dtype=float),
    )


def with_score(docs: DataFrame, machine: Machine, kept: list[str], text: str = "text", into: str = "score") -> DataFrame:
    """`kept` columns and the score of each whole text; null and empty texts get one as well. A kept column named
    as `into` is replaced."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        own = model.value
        return lambda texts: [pa.array([own.score(t) for t in texts], pa.float64())]

    return mapped(docs, text, kept, [(into, "double")], make)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs`: (doc_id, held_out, score, predicted). Repeated rows and null ids stay
    (a null id is not held out); other columns are ignored; an empty table gives an empty table."""
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
