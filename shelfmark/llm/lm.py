"""LM scoring by cross-entropy difference of two matched bigram models.

The target model counts the target documents, the background model all documents; both have one
vocabulary, every word of the corpus, and the same smoothing:

    P_b(w)   = c_b(w) / N_b                    P_t(w) = (c_t(w) + L P_b(w)) / (N_t + L)
    P_m(w|v) = (c_m(v w) + M P_m(w)) / (c_m(v) + M)

A text is read as  # w1 ... wn #  (the border is a word of the vocabulary). Its score is the mean over
its n + 1 predictions of the target's loss less the background's, in bits: the lower, the more like the
target.

How the counts meet the texts: documents are dealt to blocks of about `BLOCK` bytes, once. A block
counts its n-grams (64-bit hashes, sorted) and sends them to key ranges; a range adds up the counts of
all blocks and sends each block the totals of its own n-grams, in the block's order; the block, which
meets its documents again, needs no keys for that. So what is shuffled is one entry per block and
n-gram, never one per occurrence, and no table of the model is held in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIGRAM_WEIGHT = 1000.0
BIGRAM_WEIGHT = 20.0
#: Bytes of text in a block; fewer where that would give less than `LEAST_BLOCKS`.
BLOCK = 16 << 20
LEAST_BLOCKS = 64

#: Bits of an n-gram's hash: a billion different ones give about seven that share theirs with another.
KEY_BITS = 56

BORDER = np.uint64(xxhash.xxh64_intdigest(b"#border", 7))
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, in lower case."""
    return (text or "").lower().encode().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    return x ^ (x >> np.uint64(29))


def sequence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, with a border before, between and after, and the words of each text."""
    digest = xxhash.xxh64_intdigest
    parts, lengths = [np.array([BORDER])], []
    for text in texts:
        words = words_of(text)
        part = np.empty(len(words) + 1, dtype=np.uint64)
        part[:-1] = np.fromiter(map(digest, words), np.uint64, len(words))
        part[-1] = BORDER
        parts.append(part)
        lengths.append(len(words))
    return np.concatenate(parts), np.array(lengths, dtype=np.int64)


def ngrams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, of 56 bits, of the unigram and of the bigram that end at each word but the first."""
    spare = np.uint64(64 - KEY_BITS)
    return _mixed(words[1:] * _ODD[1]) >> spare, _mixed(_mixed(words[:-1]) * _ODD[2] + words[1:]) >> spare


def packed_keys(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // KEY_BITS, 8), dtype=np.uint8)
    out[:, : KEY_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BITS // 8)
    return out.view("<u8").ravel()


def packed(counts: np.ndarray) -> bytes:
    """Counts in 16 bits each; the places and values of those too large for that come first."""
    large = np.flatnonzero(counts >= 0xFFFF)
    head = np.concatenate([[len(large)], large, counts[large]]).astype("<u8")
    return head.tobytes() + np.minimum(counts, 0xFFFF).astype("<u2").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    head = np.frombuffer(data, "<u8", 1 + 2 * n)[1:].astype(np.int64)
    out = np.frombuffer(data, "<u2", offset=8 * (1 + 2 * n)).astype(np.int64)
    out[head[:n]] = head[n:]
    return out


def _ranges(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys, the key ranges that have any, and where each begins and the last ends."""
    range_ = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, range_[1:] != range_[:-1]))
    return range_[starts], np.append(starts, len(keys))


def _split(table: pa.Table) -> tuple[list, list, np.ndarray]:
    """Ids and texts of a block's documents, and which are of the target."""
    label = table.column("is_label").to_numpy()
    documents = table.filter(pa.array(~label))
    target = set(table.filter(pa.array(label)).column("doc_id").to_pylist())
    ids = documents.column("doc_id").to_pylist()
    return ids, documents.column("text").to_pylist(), np.array([i in target for i in ids], dtype=bool)


def _count(bits: int):
    def run(table: pa.Table) -> pa.Table:
        _, texts, target = _split(table)
        names = ["range", "block", "keys", "n_all", "n_target"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        if not texts:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        block = table.column("block")[0].as_py()
        words, lengths = sequence(texts)
        unigrams, bigrams = ngrams(words)
        keys, n_all = np.unique(np.concatenate([unigrams, bigrams]), return_counts=True)
        mine = np.repeat(target, lengths + 1)
        some, n = np.unique(np.concatenate([unigrams[mine], bigrams[mine]]), return_counts=True)
        n_target = np.zeros(len(keys), dtype=np.int64)
        n_target[np.searchsorted(keys, some)] = n
        ranges, cuts = _ranges(keys, bits)
        pieces = lambda x, pack: pa.array([pack(x[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())
        counted = [pieces(keys, packed_keys), pieces(n_all, packed), pieces(n_target, packed)]
        return pa.Table.from_arrays([pa.array(ranges), pa.array(np.full(len(ranges), block)), *counted], names=names)

    return run


def _total(table: pa.Table) -> pa.Table:
    """Totals of one key range, for each block in the order of its keys."""
    parts = [unpacked_keys(k) for k in table.column("keys").to_pylist()]
    keys, place = np.unique(np.concatenate(parts), return_inverse=True)
    cuts = np.cumsum([0, *map(len, parts)])
    out = []
    for name in ("n_all", "n_target"):
        n = np.concatenate([unpacked(x) for x in table.column(name).to_pylist()])
        total = np.bincount(place, n, len(keys)).astype(np.int64)[place]
        out.append(pa.array([packed(total[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()))
    return pa.Table.from_arrays(
        [table.column("block").combine_chunks(), table.column("range").combine_chunks(), *out],
        names=["block", "range", "n_all", "n_target"],
    )


def losses(
    unigram: np.ndarray, bigram: np.ndarray, context: np.ndarray,
    own: tuple[np.ndarray, np.ndarray, np.ndarray], n_all: float, n_target: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Bits of every prediction in the target and the background model, from their counts: (unigram,
    bigram, context) of all documents, and `own` of the target."""
    p_all = unigram / n_all
    p_target = (own[0] + UNIGRAM_WEIGHT * p_all) / (n_target + UNIGRAM_WEIGHT)
    background = (bigram + BIGRAM_WEIGHT * p_all) / (context + BIGRAM_WEIGHT)
    target = (own[1] + BIGRAM_WEIGHT * p_target) / (own[2] + BIGRAM_WEIGHT)
    return -np.log2(target), -np.log2(background)


def _score(n_all: float, n_target: float):
    def run(table: pa.Table, totals: pa.Table) -> pa.Table:
        ids, texts, _ = _split(table)
        names = ["doc_id", "n_tokens", "target_loss", "background_loss"]
        if not texts:
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        words, lengths = sequence(texts)
        unigrams, bigrams = ngrams(words)
        _, place = np.unique(np.concatenate([unigrams, bigrams]), return_inverse=True)
        order = np.argsort(totals.column("range").to_numpy())
        count = lambda name: np.concatenate([unpacked(totals.column(name)[int(i)].as_py()) for i in order])
        one, two = place[: len(unigrams)], place[len(unigrams) :]
        before = np.append(one[-1], one[:-1])  # the last word is a border, as is the one before the first
        every, own = count("n_all").astype(np.float64), count("n_target").astype(np.float64)
        lost = losses(every[one], every[two], every[before], (own[one], own[two], own[before]), n_all, n_target)
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        means = [np.add.reduceat(x, starts) / (lengths + 1) for x in lost]
        return pa.Table.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(lengths), pa.array(means[0]), pa.array(means[1])], names=names
        )

    return run


def scored(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_id: str = "doc_id"
) -> DataFrame:
    """One row per row of `docs`: (doc_id, n_tokens, target_loss, background_loss, score).

    `target` has the ids of the target's documents; null ids, repeated ids and ids without a document
    add nothing. A null or empty text has no words and predicts the border only. Rows that repeat an
    id are documents each; a null id is never in the target. With an empty target its model is the
    background's unigrams. Other columns are ignored; an empty table gives an empty table.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = target.select(F.col(target_id).cast("long").alias("doc_id")).where("doc_id is not null")
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)) + 1
    size, n_all = own.agg(F.sum(F.octet_length("text")), F.sum(tokens)).first()
    blocks = max(LEAST_BLOCKS, -(-int(size or 0) // BLOCK))
    # ids are spread by hash; rows without one by their text
    block = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(blocks))
    counted = own.select("doc_id", tokens.alias("n"))
    n_target = counted.join(ids.distinct(), "doc_id", "left_semi").agg(F.sum("n")).first()[0]
    labels = ids.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("is_label"))
    dealt = (
        own.withColumn("is_label", F.lit(False)).unionByName(labels)
        .select(block.alias("block"), "doc_id", "text", "is_label").repartition(blocks, "block")
    )
    bits = max(1, (blocks - 1).bit_length())
    totals = (
        dealt.groupBy("block")
        .applyInArrow(_count(bits), "range long, block long, keys binary, n_all binary, n_target binary")
        .groupBy("range")
        .applyInArrow(_total, "block long, range long, n_all binary, n_target binary")
    )
    found = dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        _score(float(n_all or 1), float(n_target or 0)),
        "doc_id long, n_tokens long, target_loss double, background_loss double",
    )
    return found.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def good_ids(labels: DataFrame) -> DataFrame:
    """Ids that are labelled good and never toxic or bad."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0")
