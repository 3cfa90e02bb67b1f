"""Collocations against counting every run of words, at every block size; odd rows; the SQL twin runs in test_queries."""

import random
import re
from collections import Counter

from shelfmark.llm import phrases
from tests.compare import connect, differences
from tests.llm.helpers import table

DOCS = "doc_id long, text string, lang string, part int, `a.b` string"


def docs_of(spark, rows):
    return table(spark, [(i, t, lang, 3, "x") for i, (t, lang) in enumerate(rows)], DOCS)


def plain_counts(rows):
    counts = Counter()
    for text, lang in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", k, " ".join(words[i : i + k])] += 1
    return counts


def plain(rows, least, most):
    counts = plain_counts(rows)
    often = {key: f for key, f in counts.items() if f >= least and key[1] > 1}
    total = Counter()
    for (lang, k, _), f in counts.items():
        total[lang] += f * (k == 1)
    out = []
    for (lang, k, phrase), a in often.items():
        words = phrase.split(" ")
        inside = [f for (o, m, p), f in often.items() if o == lang and m > k and f" {phrase} " in f" {p} "]
        if any(100 * f >= 80 * a for f in inside):
            continue
        cuts = []
        for cut in range(1, k):
            left, right = counts[lang, cut, " ".join(words[:cut])], counts[lang, k - cut, " ".join(words[cut:])]
            cuts.append((2_000_000 * a // (left + right), cut, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, score, a, phrase, left, right))
    rows = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))
        rows += [(lang, i, p, a, left, right, total[lang], s) for i, (_, s, a, p, left, right) in enumerate(own[:most], 1)]
    return sorted(rows)


def rows_of_words(seed):
    rng = random.Random(seed)
    words = ["a", "B", "b", "é", "漢", "\x1c", "a b", "don't", "x" * 40]
    breaks = [" "] * 12 + ["\t", "  ", ".", ", ", "\n", "\r\n", "!", "\x0b", ";:"]
    rows = []
    for _ in range(150):
        text = "".join(rng.choice(words[: rng.choice([3, 9])]) + rng.choice(breaks) for _ in range(rng.randrange(25)))
        rows.append((text, rng.choice(["en", "fr", None, "und", "t\tb", "%\n%0A"])))
    return rows + [(None, "en"), ("", "en"), (" .. \n", None)] + [("same words here again and again", "en")] * 40


def test_equal_the_plain_version(spark):
    rows = rows_of_words(1)
    got = phrases.collocations(docs_of(spark, rows), least=5).collect()
    assert sorted(map(tuple, got)) == plain(rows, 5, phrases.MOST) and len(got) > 50
    few = phrases.collocations(docs_of(spark, rows), least=5, most=7).collect()
    assert sorted(map(tuple, few)) == plain(rows, 5, 7)


def test_flow_gives_every_count_in_any_block(spark, monkeypatch):
    rows = rows_of_words(2)
    expected = {key: f for key, f in plain_counts(rows).items() if key[1] == 1 or f >= 2}
    for block, pieces, size in ((1, 1, 2), (40, 7, 1 << 20), (phrases.BLOCK, phrases.PIECES, phrases.BYTES)):
        monkeypatch.setattr(phrases, "PIECES", pieces)
        monkeypatch.setattr(phrases, "BYTES", size)
        numbers = []
        for at in range(0, len(rows), 50):
            one = phrases.Block()
            for text, lang in rows[at : at + 50]:
                for _ in one.read(text, lang):
                    if one.size >= block:
                        numbers.append(one)
                        one = phrases.Block()
            numbers.append(one)
        sent = []
        for one in (b for b in numbers if b.size):
            sent += phrases.sent(*one.edges(), 5, 3)
        assert counts_of(sent, 2) == expected


def counts_of(batches, least):
    """The levels by hand: rows by part, nodes, pairs."""
    import pyarrow as pa

    def by_part(tables):
        whole = pa.concat_tables(tables)
        return [whole.filter(pa.compute.equal(whole["part"], p)) for p in set(whole["part"].to_pylist())]

    nodes = [phrases._nodes(5, least)(t) for t in by_part([pa.Table.from_batches([b]) for b in batches])]
    total = Counter()
    for t in by_part(nodes):
        for r in phrases._pairs(least)(t).to_pylist():
            total[r["lang"], r["k"], r["phrase"]] += r["f"]
    return dict(total)


def test_long_texts_and_tables(spark):
    long = "one two three four five " * 60_000
    rows = [(long, "en"), (long.replace(" ", "."), "fr")]
    got = {(r.lang, r.phrase): (r.a, r.n) for r in phrases.collocations(docs_of(spark, rows)).collect()}
    assert got["en", "one two three four"] == (60_000, 300_000) and not any(lang == "fr" for lang, _ in got)
    assert phrases.collocations(docs_of(spark, [])).collect() == []
    assert phrases.collocations(docs_of(spark, [(None, None), ("", "en"), ("few words", "en")])).collect() == []


def test_product_beyond_64_bits(spark):
    big = 2**50
    counts = table(spark, [("en", 1, "a", 3 * big), ("en", 1, "b", 5 * big), ("en", 2, "a b", 2 * big)], "lang string, k int, phrase string, f long")
    (row,) = phrases.scored(counts).collect()
    assert row.score == 2_000_000 * 2 * big // (8 * big)


def test_large_keys_stay_distinct():
    import numpy as np

    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 1 << 31, 500) for _ in range(4)]
    columns = [np.concatenate([c, c]) for c in columns]
    rows, n = phrases.added(columns, np.ones(1000, np.int64), 1 << 31)
    assert len(n) == 500 and (n == 2).all() and sorted(zip(*rows)) == sorted(zip(*[c[:500] for c in columns]))


def test_equal_to_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = phrases.collocations(spark.read.parquet(f"{sf}/documents.parquet"))
    assert differences(df, connect(sf).sql(phrases.ORACLE_SQL)) is None
