"""Byte-level BPE as a finite-state transducer, and streaming decoding.

The merges are compiled into a transducer that is determinised as it is used. A state holds the bytes that
are not settled yet; for every prefix of those bytes it knows the last token of the prefix's encoding. Of the
last settled token it holds only what can still matter: the right edges of its merge tree (see below) that
some token beginning with the open bytes could merge with, so states that behave alike are one. Reading a byte, the last token of the longer prefix is the one
suffix token that can stand beside the token before it. Only prefixes from which some longer token may
still begin stay open; what all their encodings share is emitted. So the lookahead is bounded by the
longest token, and the time is linear in the bytes, also for a match of any length.

Two tokens can stand side by side if no merge across their border would have been made: such a merge
needs a token on the right edge of the left one's merge tree and one on the left edge of the right
one's, both alive when the merge is due.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tables import kept_in_worker, mapped

#: Beyond these numbers, states and pairs of tokens are built anew; of twice this number of matches the ones not
#: met lately go.
MOST_STATES = 200_000
MOST_PIECES = 150_000
MOST_PAIRS = 200_000
#: Tokens decoded at once.
CHUNK = 65_536


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.matches = regex.compile(pattern).findall
        self.longest = max(map(len, ranks))
        self.beginnings = {t[:i] for t in ranks for i in range(1, len(t))}
        self.ids = {t: int(r).to_bytes(4, "little") for t, r in ranks.items()}
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.edges: dict[bytes, tuple | None] = {}
        #: Tokens that merges make.
        self.made = {t for t in ranks if self._edge(t) is not None}
        self.rights: dict[bytes, tuple] = {}
        self.lefts: dict[bytes, tuple] = {}
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[tuple, int] = {((), b"", (None,)): 0}
        self.states: list[tuple] = [((), b"", (None,))]
        self.opens: list[tuple] = [()]  # of each state, the places where a longer token may still begin
        self.borders: list[tuple] = [(1,)]  # of each prefix of its bytes, the borders of its tokens as bits
        self.moves: list[dict[int, tuple[int, bytes]]] = [{}]
        self.stops: list[dict[int, bytes]] = [{}]

    # -- merge trees --

    def _edge(self, token: bytes) -> tuple | None:
        """((left-edge tokens), (right-edge tokens)) of its merge tree, each as (token, made at, merged
        away at); None if the merges never make this token."""
        found = self.edges.get(token, 0)
        if found != 0:
            return found
        rank = self.ranks[token]
        if len(token) == 1:
            found = (((token, -1),), ((token, -1),))
        else:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                made = [self.ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
                least = min(made)
                if least >= rank:
                    break
                at = made.index(least)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            sides = [self._edge(p) if p in self.ranks else None for p in parts]
            if len(parts) != 2 or None in sides:
                found = None
            else:
                found = ((*sides[0][0], (token, rank)), (*sides[1][1], (token, rank)))
        self.edges[token] = found
        return found

    def _right(self, token: bytes) -> tuple:
        """Its right edges as (token, made at, merged away at)."""
        found = self.rights.get(token)
        if found is None:
            edges = self._edge(token)[1]
            gone = [*(rank for _, rank in edges[1:]), len(self.table)]
            found = self.rights[token] = tuple((a, made, g) for (a, made), g in zip(edges, gone))
        return found

    def _narrowed(self, rights: tuple, tail: bytes) -> tuple:
        """Those right edges that form a token with a prefix of `tail`, or with something it begins."""
        ranks, n = self.ranks, len(tail)
        return tuple(
            [r for r in rights if r[0] + tail in self.beginnings or any([r[0] + tail[:k] in ranks for k in range(1, n + 1)])]
        )

    def _left(self, token: bytes) -> tuple:
        """Its left edges, likewise."""
        found = self.lefts.get(token)
        if found is None:
            edges = self._edge(token)[0]
            gone = [*(rank for _, rank in edges[1:]), len(self.table)]
            found = self.lefts[token] = tuple((b, made, g) for (b, made), g in zip(edges, gone))
        return found

    def _beside(self, left: bytes, right: bytes) -> bool:
        known = self.beside.get((left, right))
        if known is None:
            if len(self.beside) >= MOST_PAIRS:
                self.beside.clear()
            known = self.beside[left, right] = self._side_by_side(self._right(left), right)
        return known

    def _side_by_side(self, rights: tuple, right: bytes) -> bool:
        ranks = self.ranks
        for b, made_b, gone_b in self._left(right) if rights else ():
            for a, made_a, gone_a in rights:
                due = ranks.get(a + b)
                # of equal merges the leftmost is made first, so `a` is gone at gone_a, and `b` is not at gone_b
                if due is not None and made_a < due < gone_a and made_b < due <= gone_b:
                    return False
        return True

    # -- states --

    def _last(self, before: tuple, tail: bytes, lasts: tuple, opens: tuple) -> tuple[int, bytes]:
        """Start of the last token of the encoding that ends with `tail`, and the token. It began at an open
        place or is the last byte alone."""
        for start in (*opens, len(tail) - 1):
            token = tail[start:]
            if token not in self.made:
                continue
            if self._beside(lasts[start], token) if start else self._side_by_side(before, token):
                break
        return start, token

    def _stop(self, state: int, byte: int) -> bytes:
        """What is still to be emitted if the match ends with this byte."""
        before, tail, lasts = self.states[state]
        start, token = self._last(before, tail + bytes((byte,)), lasts, self.opens[state])
        self.stops[state][byte] = emitted = self._ids(lasts, start) + self.ids[token]
        return emitted

    def _move(self, state: int, byte: int) -> tuple[int, bytes]:
        before, tail, lasts = self.states[state]
        opens, borders = self.opens[state], self.borders[state]
        tail += bytes((byte,))
        n = len(tail)
        start, token = self._last(before, tail, lasts, opens)
        lasts = (*lasts, token)
        borders = (*borders, borders[start] | 1 << n)
        opens = [k for k in (*opens, n - 1) if tail[k:] in self.beginnings]
        common = kept = borders[n]
        for k in opens:
            common &= borders[k]
            kept |= borders[k]
        settled = common.bit_length() - 1
        emitted = b""
        if settled:
            emitted = self._ids(lasts, settled)
            before = self._right(lasts[settled])
            tail = tail[settled:]
            opens = [k - settled for k in opens]
            kept >>= settled
            lasts = lasts[settled:]
            borders = [b >> settled for b in borders[settled:]]
        # where no token can begin at the border any more, what stands before it is all one
        before = self._narrowed(before, tail) if not tail or (opens and not opens[0]) else ()
        # the encodings of closed prefixes matter only where an open one rests on them
        lasts = (None, *[t if kept >> k & 1 else None for k, t in enumerate(lasts[1:], 1)])
        key = (before, tail, lasts)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.opens.append(tuple(opens))
            self.borders.append(tuple(borders))
            self.moves.append({})
            self.stops.append({})
        self.moves[state][byte] = made = (number, emitted)
        return made

    def _ids(self, lasts: tuple, k: int) -> bytes:
        """Ids of the first k open bytes."""
        out = []
        while k:
            out.append(self.ids[lasts[k]])
            k -= len(lasts[k])
        return b"".join(reversed(out))

    # -- use --

    def encode_match(self, data: bytes) -> bytes:
        """Ids of one match, each as little-endian unsigned 32 bits."""
        if len(self.states) > MOST_STATES:
            self._forget()
        if not data:
            return b""
        state, out, moves = 0, [], self.moves
        for byte in data[:-1]:
            move = moves[state].get(byte)
            if move is None:
                move = self._move(state, byte)
            state, emitted = move
            if emitted:
                out.append(emitted)
        out.append(self.stops[state].get(data[-1]) or self._stop(state, data[-1]))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        found = self.matches(text)
        out = list(map(self.pieces.get, found))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            out[i] = self._remembered(found[i])
        return b"".join(out)

    def _remembered(self, piece: str) -> bytes:
        """Ids of a match that was not met lately."""
        ids = self.pieces.get(piece) or self.earlier.get(piece) or self.encode_match(piece.encode())
        if len(piece) <= 64:
            if len(self.pieces) >= MOST_PIECES:
                self.earlier, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids

    def decode(self, ids: bytes) -> Iterator[str]:
        """Text of the ids, chunk by chunk; a character is given out once its last byte is read."""
        numbers, table, reader = np.frombuffer(ids, "<u4"), self.table, Utf8Reader()
        for at in range(0, len(numbers), CHUNK):
            yield reader.feed(b"".join([table[i] for i in numbers[at : at + CHUNK].tolist()]))
        yield reader.close()


class Utf8Reader:
    """Incremental UTF-8. Its states are the ranges that the next bytes of an open character may take;
    only the last character of a chunk can be open, so only its bytes go through the machine."""

    TAIL = (0x80, 0xBF)

    def __init__(self):
        self.open = b""

    @classmethod
    def start(cls, byte: int) -> tuple | None:
        """State after a first byte: ranges still to come; empty for ASCII, None if none may follow."""
        tail = cls.TAIL
        if byte < 0x80:
            return ()
        if 0xC2 <= byte <= 0xDF:
            return (tail,)
        if 0xE0 <= byte <= 0xEF:
            return ({0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F)}.get(byte, tail), tail)
        if 0xF0 <= byte <= 0xF4:
            return ({0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, tail), tail, tail)
        return None

    @classmethod
    def unfinished(cls, data: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            first = data[-back]
            if first & 0xC0 == 0x80:
                continue
            state = cls.start(first)
            for byte in data[len(data) - back + 1 :]:
                if not state or not state[0][0] <= byte <= state[0][1]:
                    return 0
                state = state[1:]
            return back if state else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data) - self.unfinished(data)
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


# ---- Spark ----------------------------------------------------------------------------------

def _transducer(ranks: dict[bytes, int], pattern: str) -> Transducer:
    """One per worker process; it keeps its states from task to task."""
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    return kept_in_worker(key, lambda: Transducer(ranks, pattern))


def _each(one):
    """A function of one value as one of the values of a batch."""
    return lambda values: [pa.array([one(x) for x in values], pa.binary())]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """`docs` with the ids of each whole text: binary, little-endian unsigned 32 bits each.

    `path` is a file of ranks (token in base64, rank), read by the driver: the vocabulary is a
    parameter of fixed size. A null text is empty; all rows and other columns stay.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def make():
        own = _transducer(ranks.value, pattern)
        return _each(lambda value: own.encode(value or ""))

    return mapped(docs, text, docs.columns, [(into, "binary")], make, keep=True)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`tokens` with the text of its ids in UTF-8, as binary; null ids are empty."""
    ranks = tokens.sparkSession.sparkContext.broadcast(load_ranks(path))

    def make():
        own = _transducer(ranks.value, pattern)
        return _each(lambda value: "".join(own.decode(value or b"")).encode())

    return mapped(tokens, ids, tokens.columns, [(into, "binary")], make, keep=True)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` with `ids` as in `encode` and `decoded` as in `decode`, made in one pass: a second one
    would need a second Python worker with a transducer of its own beside the first.

    A null text is empty, and so are its ids; repeated rows stay; columns named `ids` or `decoded` are
    replaced, all others kept; an empty table gives an empty table."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def make():
        own = _transducer(ranks.value, pattern)

        def run(texts):
            ids = [own.encode(t or "") for t in texts]
            decoded = ["".join(own.decode(i)).encode() for i in ids]
            return [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]

        return run

    return mapped(docs, text, docs.columns, [("ids", "binary"), ("decoded", "binary")], make, keep=True)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of `docs`: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    A null or empty text has no tokens and the digests of nothing; null ids and repeated rows stay; other
    columns are ignored; an empty table gives an empty table."""
    made = encode_and_decode(docs.select("doc_id", "text"), path, pattern)
    return made.select(
        "doc_id",
        F.floor(F.length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
