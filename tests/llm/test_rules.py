"""Quality rules: counts against a plain version, the score against its features, held-out rows, odd rows."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import rules
from shelfmark.llm.held import held_out
from shelfmark.llm.tables import read
from tests.llm.helpers import documents, empty, table

SF = "/root/testdata/sf0.01"


def plain(text):
    """The contract, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return [
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(twice),
    ]


ODD = [
    None, "", " \n\t\x0b\x0c\r ", "a", "a b", "a a a a a", "a b c a b c", "x y  z\x1cq", "# * $ % & | < > é漢🎉",
    "one\n\none\none \n two\n", "a b c d a b c d e a b", "w " * 5_000, "l\n" * 3_000,
]


def test_counts_equal_the_plain_version():
    rng = np.random.default_rng(4)
    texts = ODD[:-2] + [" ".join(rng.choice(list("abc\n|"), rng.integers(0, 40))) for _ in range(60)]
    assert rules.counts_of(texts)[0].tolist() == [plain(t) for t in texts]
    assert rules.counts_of(ODD[-2:])[0].tolist() == [[5_000, 5_000, 0, 0, 5_000], [3_000, 3_000, 0, 2_999, 3_000]]
    assert rules.counts_of([])[0].shape == (0, 5)


def test_score_is_the_weighted_features_in_any_batch(monkeypatch):
    rng = np.random.default_rng(5)
    model = rules.Model(0.25, rng.normal(size=rules.GROUPS * rules.SLOTS), 1.5, -0.5)
    texts = [*ODD, *(" ".join(rng.choice(["Word", "é", "x!"], 30)) for _ in range(9))]
    expected = [0.25 + model.weights[numbers] @ x for numbers, x in map(rules.features, texts)]
    for segment in (rules.SEGMENT, 37):
        monkeypatch.setattr(rules, "SEGMENT", segment)
        _, words, data = rules.counts_of(texts)
        assert np.allclose(model.raw(words, data), expected)
    assert np.allclose([model.raw([t.split()], [t])[0] for t in data], expected)


def test_search_and_calibration():
    found = rules.minimised(np.array([3.0, -2.0]), lambda x: (float(x @ x + x[0]), 2 * x + [1, 0]), 50, 1e-12)
    assert np.allclose(found, [-0.5, 0], atol=1e-4)
    rng = np.random.default_rng(6)
    scores = rng.normal(size=20_000)
    labels = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * scores - 1)))).astype(float)
    slope, shift = rules.platt(scores, labels)
    assert abs(slope - 2) < 0.1 and abs(shift + 1) < 0.1
    assert rules.platt(scores, np.ones(20_000)) == (1.0, 0.0)


def test_held_out_rows(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    rows = rules.judged(docs, labels).join(labels, "doc_id").where(held_out("doc_id")).where("not base_failed").collect()
    assert len(rows) > 60
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) >= 0.97
    assert np.mean([r.kept for r in rows if r.quality == 1]) >= 0.97
    good = [r.probability for r in rows if r.quality == 1]
    assert abs(np.mean(good) - 1) < 0.1  # calibrated


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    prose = lambda i: " ".join(rng.choice(["fine", "prose", "is", "here", "today", "and"] if i % 2 else ["BAD!", "$$", "|", "X9"], 60))
    texts = [(i, prose(i)) for i in range(60)] + [(200 + i, t) for i, t in enumerate(ODD)] + [(None, prose(1)), (7, "other"), (300, prose(0) * 400)]
    docs = documents(spark, texts)
    labels = table(spark, [(i, i % 2, 0) for i in range(60)] + [(3, 0, 0), (None, 1, 0), (4, None, 0), (200, 7, 0)], "doc_id long, quality int, toxic int")
    got = rules.judged(docs, labels).collect()
    assert len(got) == len(texts)
    assert [tuple(r)[1:6] for r in sorted(got, key=lambda r: r.doc_id or 0) if r.doc_id and 200 <= r.doc_id < 300] == [tuple(rules.counts_of([t])[0][0]) for t in ODD]
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert r.kept == (not r.base_failed and r.probability >= 0.5) and 0 <= r.probability <= 1
    for label in (0, 1):
        alone = rules.judged(docs, labels.where(F.col("quality") == label)).collect()
        assert all((r.probability > 0.99) == (label == 1) for r in alone)
    assert {r.probability for r in rules.judged(docs, labels.limit(0)).collect()} == {0.5}
    assert rules.judged(empty(spark), labels).collect() == []


def test_repeated_ids_give_the_same_model(spark):
    docs = documents(spark, [(i % 20, f"text {i} " * 60) for i in range(60)])
    labels = table(spark, [(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    one, two = (rules.sample_of(d, labels).orderBy("numbers").collect() for d in (docs, docs.orderBy(F.desc("text"))))
    assert one == two and len(one) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(20))
