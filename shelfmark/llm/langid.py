"""Language identification by a bidirectional gated recurrent network over bytes.

The network is learned in numpy by backpropagation through time on a bounded sample of labelled rows:
`SAMPLE` documents a language (the first by a hash of the id), `PIECES` windows of each, spread over the
whole text. It reads every byte of a text, in windows of `WINDOW`, labels every position from what
stands before and after it, and the mean of the labels' probabilities is the document's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.held import held_out
from shelfmark.llm.tables import mapped

WINDOW = 64
HIDDEN = 8
SAMPLE = 300
PIECES = 8
EPOCHS = 12
BATCH = 256
RATE = 0.01
#: Windows read side by side.
WIDTH = 1024
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _run(inputs: np.ndarray, keep: np.ndarray, w: np.ndarray, u: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (time, hidden, windows) of one direction. `inputs`: bytes (time, windows); `keep`: 1 where
    a byte stands, 0 where a window is filled up."""
    steps, width = inputs.shape
    hidden = u.shape[1] - 1
    states = np.empty((steps, hidden, width), dtype=np.float32)
    h = np.zeros((hidden + 1, width), dtype=np.float32)
    h[hidden] = 1  # for the bias
    for t in range(steps):
        x = np.take(w, inputs[t], axis=1)
        y = u @ h
        zr = _sigmoid(x[: 2 * hidden] + y[: 2 * hidden])
        z, r = zr[:hidden], zr[hidden:]
        n = np.tanh(x[2 * hidden :] + r * y[2 * hidden :])
        change = (1 - z) * (n - h[:hidden]) * keep[t]
        if trace is not None:
            trace.append((h[:hidden].copy(), z, r, n, y[2 * hidden :]))
        h[:hidden] += change
        states[t] = h[:hidden]
    return states


def _back(inputs, keep, u, trace, outer, slopes_w, slopes_u) -> None:
    """Adds the slopes of one direction; `outer`: slope of each state from the output."""
    hidden = u.shape[1] - 1
    flow = np.zeros_like(outer[0])
    for t in range(len(inputs) - 1, -1, -1):
        before, z, r, n, inner = trace[t]
        flow = flow + outer[t]
        d = flow * keep[t]
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (before - n) * z * (1 - z)
        dr = dn * inner * r * (1 - r)
        dx = np.concatenate([dz, dr, dn])
        dy = np.concatenate([dz, dr, dn * r])
        ones = np.ones((1, before.shape[1]), dtype=np.float32)
        slopes_u += dy @ np.concatenate([before, ones]).T
        for k in range(3 * hidden):
            slopes_w[k] += np.bincount(inputs[t], dx[k], 256)
        flow = flow - d * (1 - z) + u[:, :hidden].T @ dy


@dataclass
class Network:
    languages: list[str]
    wf: np.ndarray
    uf: np.ndarray
    wb: np.ndarray
    ub: np.ndarray
    out: np.ndarray

    def positions(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities (time, languages, windows) of every position."""
        inputs = np.ascontiguousarray(windows.T)
        keep = (np.arange(len(inputs))[:, None] < lengths).astype(np.float32)
        forth = _run(inputs, keep, self.wf, self.uf)
        back = _run(inputs[::-1], keep[::-1], self.wb, self.ub)[::-1]
        hidden = forth.shape[1]
        logits = self.out[:, :hidden] @ forth + self.out[:, hidden : 2 * hidden] @ back + self.out[:, -1:]
        np.exp(logits - logits.max(axis=1, keepdims=True), out=logits)
        logits *= keep[:, None] / logits.sum(axis=1, keepdims=True)
        return logits

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its probability; `und` and 0 for null texts and texts without letters."""
        data = [prepared(t).encode() if t and any(map(str.isalpha, t)) else b"" for t in texts]
        total = np.zeros((len(texts), len(self.languages)))
        rows, owners, sizes, held = [], [], [], 0

        def flush():
            nonlocal held
            flat = np.concatenate(rows)
            sums = self.positions(flat, np.concatenate(sizes)).sum(axis=0).T
            np.add.at(total, np.concatenate(owners), sums)
            rows.clear(), owners.clear(), sizes.clear()
            held = 0

        if self.languages:
            for i, text in enumerate(data):
                cut, lengths = windows_of(text)
                for at in range(0, len(cut), WIDTH):
                    part = cut[at : at + WIDTH]
                    rows.append(part)
                    sizes.append(lengths[at : at + WIDTH])
                    owners.append(np.full(len(part), i))
                    held += len(part)
                    if held >= WIDTH:
                        flush()
            if rows:
                flush()
        names, scores = [], []
        for text, sums in zip(data, total):
            if not text or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
            else:
                best = int(sums.argmax())
                names.append(self.languages[best])
                scores.append(float(min(1.0, sums[best] / sums.sum())))
        return names, scores


def prepared(text: str) -> str:
    return text.lower()


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) bytes of a whole text, and how many bytes of each count."""
    count = -(-len(data) // WINDOW)
    padded = np.zeros(count * WINDOW, dtype=np.uint8)
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    lengths = np.full(count, WINDOW)
    if count:
        lengths[-1] = len(data) - WINDOW * (count - 1)
    return padded.reshape(count, WINDOW), lengths


def learn(languages: list[str], windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, seed: int = 1) -> Network:
    """Adam on the cross-entropy of every position."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    h, k = HIDDEN, len(languages)
    net = Network(languages, draw(3 * h, 256), draw(3 * h, h + 1), draw(3 * h, 256), draw(3 * h, h + 1), draw(k, 2 * h + 1))
    names = ["wf", "uf", "wb", "ub", "out"]
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    step, steps = 0, EPOCHS * -(-len(windows) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(windows), BATCH):
            batch = order[at : at + BATCH]
            inputs = np.ascontiguousarray(windows[batch].T)
            keep = (np.arange(len(inputs))[:, None] < lengths[batch]).astype(np.float32)
            there, back_there = [], []
            forth = _run(inputs, keep, net.wf, net.uf, there)
            back = _run(inputs[::-1], keep[::-1], net.wb, net.ub, back_there)[::-1]
            logits = net.out[:, :h] @ forth + net.out[:, h : 2 * h] @ back + net.out[:, -1:]
            np.exp(logits - logits.max(axis=1, keepdims=True), out=logits)
            logits /= logits.sum(axis=1, keepdims=True)
            logits[:, labels[batch], np.arange(len(batch))] -= 1
            error = logits * keep[:, None] / keep.sum()
            slope = {n: np.zeros_like(getattr(net, n)) for n in names}
            slope["out"][:, :h] = np.einsum("tkb,thb->kh", error, forth)
            slope["out"][:, h : 2 * h] = np.einsum("tkb,thb->kh", error, back)
            slope["out"][:, -1] = error.sum(axis=(0, 2))
            _back(inputs, keep, net.uf, there, net.out[:, :h].T @ error, slope["wf"], slope["uf"])
            _back(inputs[::-1], keep[::-1], net.ub, back_there, (net.out[:, h : 2 * h].T @ error)[::-1], slope["wb"], slope["ub"])
            norm = np.sqrt(sum(float((g**2).sum()) for g in slope.values()))
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            for n, g in slope.items():
                g *= min(1.0, 1.0 / (norm + 1e-9))
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.01 * (g * g - second[n])
                bent = np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8
                setattr(net, n, getattr(net, n) - (rate / (1 - 0.9**step) * first[n] / bent).astype(np.float32))
    return net


# ---- Spark ----------------------------------------------------------------------------------


def _pieces(texts: list[str | None]) -> list[pa.Array]:
    """Windows of a text, spread evenly over all of it."""
    out = []
    for text in texts:
        data = prepared(text or "").encode()
        last = max(0, len(data) - WINDOW)
        starts = sorted({last * i // max(1, PIECES - 1) for i in range(PIECES)})
        out.append([data[s : s + WINDOW] for s in starts if data])
    return [pa.array(out, pa.list_(pa.binary()))]


def train(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """Learns from at most `sample` ids of each language outside the held-out fold, with text and lang.
    Ids that occur with several languages count for the least one."""
    usable = docs.where(~held_out("doc_id") & F.expr("doc_id is not null and text is not null and lang is not null"))
    ids = usable.select("doc_id", "lang")
    languages = sorted(r.lang for r in ids.select("lang").distinct().collect())
    if not languages:
        return Network([], *[np.zeros((1, 1), np.float32)] * 5)
    picked = None
    for lang in languages:
        some = (
            ids.where(F.col("lang") == lang).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        )
        picked = some if picked is None else picked.unionByName(some)
    bound = sample * len(languages)
    joined = usable.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])  # `bound` rows
    made = mapped(joined, "text", ["doc_id", "lang"], [("pieces", "array<binary>")], lambda: _pieces)
    rows = sorted(made.limit(bound).collect(), key=lambda r: (r.doc_id, r.lang, r.pieces))
    pieces = [(bytes(p), r.lang) for r in rows for p in r.pieces]
    if not pieces:
        return Network([], *[np.zeros((1, 1), np.float32)] * 5)
    windows, lengths = zip(*(windows_of(p) for p, _ in pieces))
    labels = np.array([languages.index(lang) for _, lang in pieces])
    return learn(languages, np.concatenate(windows), np.concatenate(lengths), labels)


def with_language(docs: DataFrame, network: Network, kept: list[str], text: str = "text") -> DataFrame:
    """`kept` columns with lang_pred and score of each whole text; kept columns of these names are replaced. Of
    languages with equal scores the first in the order of names counts."""
    model = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        own = model.value

        def run(texts):
            names, scores = own.judge(texts)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return run

    return mapped(docs, text, kept, [("lang_pred", "string"), ("score", "double")], make)


def judged(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: (doc_id, held_out, lang_pred, score). Null texts and texts without
    letters are `und` with score 0, as is everything if no row can be learned from. Repeated rows and
    null ids stay; other columns are ignored; an empty table gives an empty table."""
    marked = with_language(docs.select("doc_id", "text"), train(docs), ["doc_id"])
    return marked.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
