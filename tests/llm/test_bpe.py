"""BPE transducer against the public library, and the decoder against Python's."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from shelfmark.llm import bpe
from tests.llm.helpers import documents, empty

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(made):
    return np.frombuffer(made, "<u4").tolist()


def texts():
    rng = random.Random(1)
    alphabets = ["ab", "aAbeEtThHiIoOnNrR ", "abcdefghijklmnopqrstuvwxyz", "etaoin shrdlu.,;:!?\n\t'\"0123456789éüßñ漢字🎉"]
    for _ in range(600):
        yield "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([1, 5, 40, 300])))
    yield from ["", " ", "<|endoftext|>", "a" * 4000, " " * 3000 + "x", "\n" * 500, "Ab1" * 2000, "\x00\x1c\x85\u2028"]
    yield from (f"a{chr(c)}b {chr(c)}" for c in range(0, 0x11000, 7) if not 0xD800 <= c < 0xE000)


def test_encodes_like_the_library(ranks, library):
    machine = bpe.Transducer(ranks, PATTERN)
    for text in texts():
        made = machine.encode(text)
        assert ids(made) == library.encode_ordinary(text), text[:80]
        assert "".join(machine.decode(made)) == text


def test_small_bounds_change_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 5)
    monkeypatch.setattr(bpe, "MOST_PIECES", 3)
    monkeypatch.setattr(bpe, "CHUNK", 1)
    machine = bpe.Transducer(ranks, PATTERN)
    for text in ("the quick brown foxes jumped, it's über naïve 漢字🎉 " * 5, "hello" * 50):
        assert ids(machine.encode(text)) == library.encode_ordinary(text)
        assert "".join(machine.decode(machine.encode(text))) == text


def test_lookahead_is_bounded(ranks):
    machine = bpe.Transducer(ranks, PATTERN)
    machine.encode_match(bytes(random.Random(2).choice(b"etaoinshr") for _ in range(3000)))
    assert max(len(tail) for _, tail, _ in machine.states) <= machine.longest


def test_reader_cuts_anywhere():
    data = "aé漢🎉z".encode() + b"\xf0\x9f\xff\xe2\x82" + "ß".encode() + b"\xed\xa0\x80\xc0\xaf\xf4\x90\xe1\x80"
    for step in (1, 2, 3, 5):
        reader = bpe.Utf8Reader()
        out = [reader.feed(data[i : i + step]) for i in range(0, len(data), step)]
        assert "".join(out) + reader.close() == data.decode("utf-8", "replace")


def test_queries_rows(spark, library):
    rows = [(1, "Hello wörld 🎉"), (1, "Hello wörld 🎉"), (2, None), (3, ""), (None, "x" * 100_000)]
    got = sorted(((r.doc_id or 0), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(documents(spark, rows), PATH, PATTERN).collect())
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = []
    for i, text in rows:
        numbers = library.encode_ordinary(text or "")
        want.append(((i or 0), len(numbers), sha(np.array(numbers, "<u4").tobytes()), sha((text or "").encode())))
    assert got == sorted(want)
    made = bpe.encode(documents(spark, rows), PATH, PATTERN)
    assert set(made.columns) == {"doc_id", "text", "row", "fp", "ids", "a.b"} and made.count() == len(rows)
    back = bpe.decode(made.select("doc_id", "ids"), PATH, PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in rows)
    assert bpe.digests(empty(spark), PATH, PATTERN).collect() == []
