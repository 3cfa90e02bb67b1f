"""Cross-entropy difference against counts in plain dictionaries."""

import math
import random
from collections import Counter

import numpy as np

from shelfmark.llm import lm
from tests.llm.helpers import documents, empty, table


def slow(rows, target):
    reads = [["#", *lm.words_of(t), "#"] for _, t in rows]
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    for (i, _), words in zip(rows, reads):
        for m in (0, 1) if i in target else (0,):
            one[m].update(words[1:])
            two[m].update(zip(words, words[1:]))
    n = [sum(c.values()) for c in one]
    out = []
    for (i, _), words in zip(rows, reads):
        lost = [0.0, 0.0]
        for v, w in zip(words, words[1:]):
            p = one[0][w] / n[0]
            q = (one[1][w] + lm.UNIGRAM_WEIGHT * p) / (n[1] + lm.UNIGRAM_WEIGHT)
            lost[0] -= math.log2((two[1][v, w] + lm.BIGRAM_WEIGHT * q) / (one[1][v] + lm.BIGRAM_WEIGHT))
            lost[1] -= math.log2((two[0][v, w] + lm.BIGRAM_WEIGHT * p) / (one[0][v] + lm.BIGRAM_WEIGHT))
        k = len(words) - 1
        out.append((i if i is not None else -1, k - 1, lost[0] / k, lost[1] / k, (lost[0] - lost[1]) / k))
    return sorted(out)


def same(spark, rows, target, labels):
    got = lm.scored(documents(spark, rows), labels).collect()
    mine = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.target_loss, r.background_loss, r.score) for r in got)
    want = slow(rows, target)
    assert [x[:2] for x in mine] == [x[:2] for x in want]
    for a, b in zip(mine, want):
        assert all(math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-9) for x, y in zip(a[2:], b[2:])), (a, b)


def test_losses_equal_brute_force(spark):
    rng = random.Random(1)
    words = ["the", "The", "of", *(f"w{i}" for i in range(60)), "é x", "\x1cq"]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.randint(0, 120)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n"), (7, rows[7][1]), (None, "the of"), (None, "the of"), (503, "w1 " * 60_000)]
    target = {i for i in range(150) if i % 3 == 0}
    labels = table(spark, [(i, "z") for i in [*target, *target, 9999, None]], "doc_id long, text string")
    same(spark, rows, target, labels)


def test_without_target_and_empty(spark):
    labels = table(spark, [], "doc_id long, text string")
    same(spark, [(1, "a b a"), (2, None)], set(), labels)
    assert lm.scored(empty(spark), labels).collect() == []


def test_good_ids(spark):
    rows = [(1, 1, 0), (1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, None)]
    got = lm.good_ids(table(spark, rows, "doc_id long, quality int, toxic int")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "None"]


def test_packed_counts_and_keys_come_back():
    counts = np.array([0, 1, 65534, 65535, 65536, 1 << 40, 3])
    keys = np.array([0, 1, (1 << 56) - 1, 1 << 55], dtype=np.uint64)
    assert (lm.unpacked(lm.packed(counts)) == counts).all() and len(lm.unpacked(lm.packed(counts[:0]))) == 0
    assert (lm.unpacked_keys(lm.packed_keys(keys)) == keys).all()
