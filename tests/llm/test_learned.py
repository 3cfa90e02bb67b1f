"""Language identification and quality: gradients, identities, held-out accuracy, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import langid, quality
from shelfmark.llm.held import held_out
from shelfmark.llm.tables import read
from tests.llm.helpers import documents, empty, table

SF = "/root/testdata/sf0.01"


def test_fold(spark):
    rows = table(spark, [(i,) for i in (0, 5, 123456789, -3, None)], "doc_id long").select("doc_id", held_out("doc_id").alias("h"))
    for r in rows.collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_interactions_in_linear_time_equal_all_pairs():
    rng = np.random.default_rng(1)
    size = quality.WORD_SLOTS + quality.STEPS * quality.STATISTICS
    machine = quality.Machine(0.3, rng.normal(0, 0.1, size), rng.normal(0, 0.3, (size, quality.RANK)))
    text = "Some words, some WORDS | and 12 more!\nnew line"
    numbers, x = quality.features(text)
    total = machine.bias + machine.weights[numbers] @ x
    for i in range(len(x)):
        for j in range(i):
            total += machine.factors[numbers[i]] @ machine.factors[numbers[j]] * x[i] * x[j]
    assert np.isclose(machine.score(text), 1 / (1 + np.exp(-total)))


def test_statistics_are_shares():
    for text in (None, "", " ", "a", "!!!" * 50, "é漢🎉 " * 99, "w " * 30_000, "\n" * 500, "A|B " * 7):
        numbers, x = quality.features(text)
        assert len(numbers) == len(x) and numbers.min() >= 0
        assert numbers.max() < quality.WORD_SLOTS + quality.STEPS * quality.STATISTICS


def test_quality_on_held_out_rows(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    rows = quality.judged(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    assert np.mean([r.predicted for r in rows if r.quality == 1]) >= 0.95


def test_quality_of_odd_rows(spark):
    docs = documents(spark, [(i, "fine prose here" if i % 2 else "BAD!! BAD!!") for i in range(40)] + [(50, None), (None, ""), (1, "fine prose here")])
    labels = table(spark, [(i, i % 2, 0) for i in range(40)] + [(3, 0, 0), (None, 1, 0), (4, None, 0), (50, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == 43 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    alone = quality.judged(docs, labels.where("quality = 1")).collect()
    assert all(r.score > 0.99 for r in alone)
    assert all(r.score == 0.5 for r in quality.judged(docs, labels.limit(0)).collect())
    assert quality.judged(empty(spark), labels).collect() == []


def test_gradient_of_the_recurrent_network():
    """Backpropagation through time against differences of the loss."""
    rng = np.random.default_rng(1)
    h, steps, width = 3, 6, 4
    w, u = rng.normal(size=(3 * h, 256)).astype("f4"), rng.normal(size=(3 * h, h + 1)).astype("f4")
    inputs = rng.integers(0, 5, (steps, width)).astype(np.uint8)
    keep = (np.arange(steps)[:, None] < np.array([6, 3, 5, 1])).astype("f4")
    outer = rng.normal(size=(steps, h, width)).astype("f4")
    loss = lambda: float((langid._run(inputs, keep, w, u) * outer).sum())
    trace = []
    langid._run(inputs, keep, w, u, trace)
    slope_w, slope_u = np.zeros_like(w), np.zeros_like(u)
    langid._back(inputs, keep, u, trace, outer, slope_w, slope_u)
    for matrix, slope in ((w, slope_w), (u, slope_u)):
        for _ in range(25):
            i, j = rng.integers(matrix.shape[0]), rng.integers(min(5, matrix.shape[1]))
            old = matrix[i, j]
            matrix[i, j] = old + 1e-2
            up = loss()
            matrix[i, j] = old - 1e-2
            down = loss()
            matrix[i, j] = old
            assert abs((up - down) / 2e-2 - slope[i, j]) < 2e-2 * max(1, abs(slope[i, j]))


def test_language_on_held_out_rows(spark):
    docs = read(spark, SF, "documents")
    rows = langid.judged(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    docs = documents(spark, [(i, "aba bab " * 20 if i % 2 else "xyz zyx " * 20) for i in range(60)])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "one").otherwise("two"))
    odd = [(90, None), (91, ""), (92, "12 34 ½ !!"), (None, "aba bab " * 30_000), (93, "xyz zyx"), (93, "xyz zyx")]
    rows = docs.unionByName(documents(spark, odd).withColumn("lang", F.lit(None).cast("string")))
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in langid.judged(rows).where("doc_id is null or doc_id >= 90").collect()}
    assert got == {(90, "und", False), (91, "und", False), (92, "und", False), (None, "one", True), (93, "two", True)}
    nothing = langid.judged(rows.where("lang is null"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"} and nothing.count() == 6
    assert langid.judged(rows.limit(0)).collect() == []


def test_window_state_does_not_depend_on_the_batch():
    rng = np.random.default_rng(3)
    draw = lambda *shape: rng.normal(size=shape).astype("f4")
    net = langid.Network(["a", "b"], draw(24, 256), draw(24, 9), draw(24, 256), draw(24, 9), draw(2, 17))
    texts = ["some text " * n for n in (1, 7, 50, 900, 20_000)]
    names, scores = net.judge(texts)
    for text, name, score in zip(texts, names, scores):
        one = net.judge([text])
        assert one[0] == [name] and np.isclose(one[1][0], score, atol=1e-5)
