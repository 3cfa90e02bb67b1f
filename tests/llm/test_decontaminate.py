"""Decontamination: planted leaks are found, clean texts are left; parts against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate as d
from tests.llm.helpers import documents, empty, table


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_common_subsequence_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randint(1, 6) for _ in range(rng.randint(1, 70))]
        b = [rng.randint(0, 8) for _ in range(rng.randint(0, 90))]
        assert d.common_subsequence(d.word_masks(np.array(a)), len(a), b) == slow_lcs(a, b)


def test_sketch_finds_the_leading_space(spark):
    """Against an exact SVD of the same TF-IDF passages."""
    rng = np.random.default_rng(1)
    topics = rng.integers(1, 41, (8, 16))
    rows = [topics[rng.integers(8)] if rng.random() < 0.9 else rng.integers(0, 41, 16) for _ in range(600)]
    df = table(spark, [(bytearray(np.array(r, "<i4").tobytes()),) for r in rows], "words binary")
    space, weights = d.latent_space(df.repartition(5), 40, rank=6, extra=20)
    counts = np.zeros((600, 41))
    for i, r in enumerate(rows):
        np.add.at(counts[i], r, 1)
    counts[:, 0] = 0
    df_ = (counts > 0).sum(0)
    want = np.log(601 / (1 + df_))
    want[0] = 0
    assert np.allclose(weights, want, atol=1e-5)
    _, lengths, v = np.linalg.svd(counts * want, full_matrices=False)
    exact = counts * want @ v[:6].T / lengths[:6]
    mine = counts @ space
    cos = lambda x: (y := x / np.linalg.norm(x, axis=1, keepdims=True)) @ y.T
    assert np.abs(cos(mine) - cos(exact)).mean() < 0.05


def corpus(seed=1):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in", "it", "is"]
    rare = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(5000)]
    words = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n)]
    items = [(i, words(rng.randint(15, 60))) for i in range(40)]
    docs, leaked = [], set()
    for i in range(400):
        own = words(rng.randint(5, 400))
        kind = i % 8
        if kind in (0, 1):
            item, text = items[rng.randrange(40)]
            put = list(text)
            if kind == 1:  # a paraphrase: some words changed, some added, the end as it was
                for k in rng.sample(range(len(put) - 6), len(put) // 6):
                    put[k] = rng.choice(rare)
                put.insert(len(put) // 2, "indeed")
            at = rng.randint(0, len(own))
            own[at:at] = put
            leaked.add((i, item))
        docs.append((i, " ".join(own).capitalize() + ("." if i % 3 else "!!")))
    return docs, [(i, " ".join(t) + ".") for i, t in items], leaked


def test_planted_leaks(spark):
    docs, items, leaked = corpus()
    df = documents(spark, [*docs, (1000, None), (1001, ""), (None, "x " * 20_000 + items[3][1])])
    benchmark = table(spark, [*items, (77, None), (78, "...")], "item_id long, text string")
    got = d.leaks(df.repartition(4), benchmark).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs == leaked | {(None, 3)}
    assert all(r.share >= d.PARAPHRASE for r in got)
    clean = d.clean(df, benchmark)
    assert clean.columns == df.columns
    kept = {r.doc_id for r in clean.collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in leaked} | {1000, 1001}


def test_short_items_unbroken_answers_and_empty_tables(spark):
    texts = [(1, "say blue whale now"), (2, "blue big whale"), (3, "Blue, whale!"), (4, "other"), (3, "Blue, whale!")]
    benchmark = table(spark, [(9, "blue whale")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in d.leaks(documents(spark, texts), benchmark).collect())
    assert got == [(1, 9), (3, 9), (3, 9)]
    assert d.leaks(empty(spark), benchmark).collect() == []
    assert d.leaks(documents(spark, texts), benchmark.limit(0)).collect() == []
    assert d.clean(documents(spark, texts), benchmark.limit(0)).count() == 5
    long = " ".join(f"w{i}" for i in range(20))
    docs, items, _ = corpus()
    asked = table(spark, [(1, long, "forty two"), *[(100 + i, t, None) for i, t in items]], "item_id long, text string, answer string")
    part = " ".join(f"w{i}" for i in range(13))
    rows = documents(spark, [*[(100 + i, t) for i, t in docs], (1, f"{part} forty two"), (2, part), (3, long)])
    found = d.leaks(rows, asked, answer="answer").where("item_id = 1").select("doc_id", F.col("answered")).collect()
    assert sorted(map(tuple, found)) == [(1, True), (3, False)]


def test_item_of_short_vectors_beside_words_of_long_ones(spark, monkeypatch):
    """An item pasted word for word into a document of another language, whose words have long vectors."""
    own, other = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(40)]

    def uneven(words, size):
        space = np.random.default_rng(3).normal(size=(size + 1, 64)) / 8
        space *= np.where(np.arange(size + 1) <= 20, 0.02, 0.25)[:, None]
        space[0] = 0
        return space.astype(np.float32), np.append(0, np.ones(size)).astype(np.float32)

    monkeypatch.setattr(d, "latent_space", uneven)
    items = table(spark, [(1, " ".join(own)), (2, " ".join(other))], "item_id long, text string")
    docs = documents(spark, [(7, " ".join(other[:14][::-1] + own + other[14:30][::-1])), (8, " ".join(other[:30][::-1]))])
    assert [(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()] == [(7, 1)]
