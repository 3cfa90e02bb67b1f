"""SimHash: fingerprints and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import simhash
from shelfmark.llm.components import components
from tests.llm.helpers import by_id, documents, empty, table


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_the_definition():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "One two", "a b c d", "ÄÖ Äö x \x1c y\x0bz", "w " * 1000]
    texts += [" ".join(rng.choice(["ab", "Cd", "é"]) for _ in range(rng.randint(1, 700))) for _ in range(30)]
    made = simhash.fingerprints([t.encode() if t is not None else None for t in texts])
    assert made.tolist() == [slow_fingerprint(t) for t in texts]


def test_golay_code_is_perfect():
    parity, errors = simhash.golay_decoder()
    assert sorted(map(int.bit_count, errors.tolist())) == sorted([0] + [1] * 23 + [2] * 253 + [3] * 1771)
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    index = simhash.golay_index(words)
    nearest = (index << 11) | parity[index]
    assert (np.bitwise_count(words ^ nearest) <= 3).all()


def test_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 21, 3000)
    for differ in (1, 2):
        other = words.copy()
        for i in range(len(other)):
            for bit in rng.choice(21, differ, replace=False):
                other[i] ^= 1 << int(bit)
        (a, has_a), (b, has_b) = simhash.golay_keys(words, 21), simhash.golay_keys(other, 21)
        for i in range(len(words)):
            assert set(a[i][has_a[i]]) & set(b[i][has_b[i]])


def test_every_pair_within_four_bits_meets():
    rng = np.random.default_rng(4)
    fps = rng.integers(-(1 << 63), (1 << 63) - 1, 3000, dtype=np.int64)
    other = fps.view(np.uint64).copy()
    for i in range(len(other)):
        for bit in rng.choice(64, 4, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(bit)
    keys = [dict.fromkeys(zip(*map(np.ndarray.tolist, simhash.fingerprint_keys(x)))) for x in (fps, other.view(np.int64))]
    assert {row for _, row in keys[0] if (_, row) in keys[1]} == set(range(3000))


def slow_components(fps, bits=4):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_links_with_a_hot_key_equal_brute_force(spark):
    """A third lies within a few bits of one fingerprint, so that its keys are split into parts."""
    rng = random.Random(5)
    center = rng.getrandbits(64)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = [flip(center, rng.randint(0, 6)) for _ in range(120)] + [rng.getrandbits(64) for _ in range(200)]
    fps = list(dict.fromkeys(fps + [flip(f, 4) for f in fps[120:180]]))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = table(spark, [(f,) for f in signed], "fp long")
    found = by_id(components(simhash.fingerprint_links(df, part=8)), "node")
    group = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in labels}
    mine = [found[f]["component"] if f in found else f for f in signed]
    assert group(mine) == group(slow_components(fps))


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    near = text + " end"
    rows = [(5, text), (3, near), (3, near), (None, text), (8, None), (7, ""), (9, " \n"), (1, "quite another text here " * 30_000)]
    df = documents(spark, rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    print_of = lambda t: f"{slow_fingerprint(t):016x}"
    linked = (slow_fingerprint(text) ^ slow_fingerprint(near)).bit_count() <= 4
    assert linked
    zero = "0" * 16
    assert got == sorted([
        (False, 5, print_of(text), 3), (False, 3, print_of(near), 3), (False, 3, print_of(near), 3),
        (True, 0, print_of(text), 3), (False, 8, zero, 7), (False, 7, zero, 7), (False, 9, zero, 7),
        (False, 1, print_of(rows[-1][1]), 1),
    ])
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 7]


def test_one_of_each_finds_near_copies_at_the_similarity(spark):
    """Texts of 5-word similarity 0.8 and little more, one large group of them, against brute force."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for i in range(60):
        own = rng.choices(words, k=200)
        texts.append(own)
        for at in rng.sample(range(8, 190, 10), 4 if i % 2 else 6):  # 4: similarity 0.81; 6: 0.73
            own = [*own[:at], "new", *own[at + 1 :]]
        texts.append(own)
    center = rng.choices(words, k=200)
    for _ in range(100):  # keys of many texts
        at = rng.randrange(5, 190)
        texts.append([*center[:at], rng.choice(words), *center[at + 1 :]])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    rows = documents(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    assert len(set(label)) == 60 + 30 + 1
    assert sorted(r.doc_id for r in simhash.one_of_each(rows).collect()) == sorted(set(label))


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.one_of_each(empty(spark)).collect() == []


def test_components_of_paths_and_stars(spark):
    n = 60
    path = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(200, 700).select(F.lit(999).cast("long").alias("a"), F.col("id").alias("b"))
    odd = table(spark, [(None, 1), (5000, 5000), (7, None)], "a long, b long")
    found = {r.node: r.component for r in components(path.union(star).union(odd)).collect()}
    assert found == {i: 0 for i in range(n + 1)} | {i: 200 for i in (*range(200, 700), 999)}


def test_near_copies_in_small_parts_equal_brute_force(spark):
    """Chains of near copies, far ones that share keys, repeated rows: parts of two sets, and whole keys."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, texts = [], []
    for group in range(6):
        words = rng.choice(vocabulary, 120).tolist()
        for _ in range(14):
            words = list(words)
            for at in rng.integers(0, 120, rng.integers(0, 4)):
                words[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[5]), (200, None), (201, "")]
    df = documents(spark, rows)
    named = df.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    made = [("fp", "long"), ("n", "long"), ("bands", "array<long>")]
    marked = simhash.stored(simhash.mapped(named, named["text"].cast("binary"), ["doc_id", "text_hash"], made, simhash._copy_keys))
    sets = {r.fp: frozenset(simhash.shingle_set(r.text.encode()).tolist()) for r in marked.join(named, ["doc_id", "text_hash"]).collect() if r.text}
    keys = {r.fp: set(r.bands) for r in marked.collect()}

    def grouped(pairs):
        root = {fp: fp for fp in sets}
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {fp: find(fp) for fp in sets}

    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = grouped([(a, b) for a in sets for b in sets if a < b and keys[a] & keys[b] and like(sets[a], sets[b])])
    for part in (2, 512):
        got = simhash.copy_links(named, marked, part=part).collect()
        assert all(like(sets[r.a], sets[r.b]) for r in got)
        assert grouped([(r.a, r.b) for r in got]) == want
    assert 6 <= len(set(want.values())) < len(sets)


def test_near_fingerprints_bring_copies_together_without_band_keys(spark):
    """Near copies with no band key at all meet by their SimHash fingerprints; sets whose fingerprints are
    near but that are no copies are not linked."""
    rng = random.Random(11)
    texts = []
    for _ in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(words), " ".join([*words, "end"]), " ".join(rng.sample(words, len(words)))]
    named = documents(spark, list(enumerate(texts))).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    made = [("fp", "long"), ("n", "long"), ("bands", "array<long>"), ("print", "long")]
    make = lambda: simhash._copy_keys(prints=True)
    marked = simhash.stored(simhash.mapped(named, named["text"].cast("binary"), ["doc_id", "text_hash"], made, make))
    by = by_id(marked)
    for i, text in enumerate(texts):
        hashes = simhash.shingle_set(text.encode()).tolist()
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert by[i]["print"] % 2**64 == bits
    bare = marked.withColumn("bands", F.array().cast("array<long>"))
    near = {(i, i + 1) for i in range(0, 60, 3) if ((by[i]["print"] ^ by[i + 1]["print"]) % 2**64).bit_count() <= 4}
    assert len(near) > 15
    links = lambda groups, part=512: {
        frozenset((r.a, r.b)) for r in simhash.copy_links(named, bare, part=part, groups=groups).collect()
    }
    want = {frozenset((by[a]["fp"], by[b]["fp"])) for a, b in near}
    assert links(simhash.print_groups(marked)) == want
    one = marked.select("fp", F.lit(7).cast("long").alias("key"))  # all in one group: compared exactly, in parts too
    pairs = {frozenset((by[i]["fp"], by[i + 1]["fp"])) for i in range(0, 60, 3)}
    assert links(one) == pairs and links(one, part=4) == pairs


def test_one_of_each_asks_the_fingerprints(spark, monkeypatch):
    """Without band keys, the stage still finds what lies within four bits."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(reversed(words))]
    made = simhash._copy_keys

    def without_bands(*args, **named):
        run = made(*args, **named)

        def changed(texts):
            columns = run(texts)
            columns[2] = pa.array([[] for _ in texts], pa.list_(pa.int64()))
            return columns

        return changed

    monkeypatch.setattr(simhash, "_copy_keys", without_bands)
    kept = simhash.one_of_each(documents(spark, list(enumerate(texts))))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_links_by_equal_bits_equal_those_by_whole_keys(spark):
    rng = random.Random(6)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = [rng.getrandbits(64) for _ in range(150)]
    fps = list(dict.fromkeys(fps + [flip(f, 4) for f in fps] + [flip(fps[0], rng.randint(1, 6)) for _ in range(120)]))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = table(spark, [(f,) for f in signed], "fp long")
    want = slow_components(fps)
    for part in (8, 512):
        found = by_id(components(simhash.fingerprint_links(df, part=part, exact=True)), "node")
        mine = [found[f]["component"] if f in found else f for f in signed]
        group = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in labels}
        assert group(mine) == group(want)
