"""Byte-level BPE by a transducer that is made deterministic as texts are read.

Merges in rank order have a local form: a row of tokens is the encoding of its bytes exactly if no merge
comes about across any of its boundaries, and for a boundary that depends on the two tokens beside it
alone. So the vocabulary's trie, started again after each token that may stand beside the one before it,
is a transducer in which every prefix of a chunk has one complete path, and some that are inside a token.
Sets of such paths are the states here: a state is made when a text first needs it, a character leads
from one to the next, and the tokens on which all paths of a state agree are emitted as it is entered.
What is still open reaches back over a few tokens at most, whose paths stay inside one token each.

Decoding reads ids one by one through the automaton of UTF-8: the bytes of an unfinished character are
its state, so texts come out in pieces at any cut.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import math
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: So many states, paths of whole chunks, and pairs of tokens, are remembered by a Python worker. What is met beyond is
#: worked out where it is met; once that has happened as often, all is forgotten and learned anew. No id changes.
STATES, WHOLE, PAIRS = 400_000, 300_000, 1_000_000
#: Rows that are encoded before they are handed back.
ROWS = 128
#: So many tokens below a node are tried before its path is kept.
FEW = 32
_ROOT = 0
_CODERS: dict[tuple[str, str], Coder] = {}


class _State(dict):
    """From a character to the next state; `out` is emitted on entry, `end` where the chunk ends here."""

    __slots__ = ("coder", "paths", "out", "end")

    def __init__(self, coder: Transducer, paths: tuple, out: tuple) -> None:
        self.coder, self.paths, self.out = coder, paths, out
        # the complete path comes last
        self.end = paths[-1][0][1:]

    def __missing__(self, char: str) -> _State:
        return self.coder.follow(self, char)


class Transducer:
    """The merges of a table of ranks, as training makes them: single bytes, and tokens merged from two of lower ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the table of ranks must hold all single bytes")
        self.ranks = ranks
        halves = {t: self._halves(t) for t in ranks if len(t) > 1}
        if any(h is None or max(ranks[h[0]] if len(h[0]) > 1 else -1, ranks[h[1]] if len(h[1]) > 1 else -1) > ranks[t] for t, h in halves.items()):
            raise ValueError("each token must come about by merges of lower ranks")
        # what a token shows to its right, or its left, at one time or another: (part, rank at which it appears, rank at which it goes)
        self.right, self.left = ({rank: tuple(self._faces(t, halves, side)) for t, rank in ranks.items()} for side in (1, 0))
        #: The rank of each two tokens that make a third.
        self.pairs = {(ranks[t[:i]] << 32 | ranks[t[i:]]): rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        # the trie; the tokens below a node lie side by side in byte order
        self.child: dict[int, int] = {}
        self.token, self.first, self.last = [-1], [0], [0]
        self.sorted = [rank for _, rank in sorted(ranks.items())]
        for i, token in enumerate(sorted(ranks)):
            node = _ROOT
            for b in token:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.first.append(i)
                    self.last.append(i)
                node = self.child[key]
                self.last[node] = i + 1
            self.token[node] = ranks[token]
        self.clear()

    def clear(self) -> None:
        # states lead to one another: their memory comes back at once this way only
        for state in getattr(self, "states", {}).values():
            state.clear()
        #: No token stands before a chunk's first: -1 agrees with any.
        self.start = _State(self, (((-1,), _ROOT),), ())
        self.states = {(self.start.paths, ()): self.start}
        self.known: dict[int, bool] = {}
        self.beside: dict[int, bool] = {}
        self.missed = 0

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that a token is merged from."""
        parts, limit = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= limit:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def _faces(self, token: bytes, halves: dict, side: int) -> Iterable[tuple[int, float, float]]:
        goes = math.inf
        while len(token) > 1:
            yield self.ranks[token], self.ranks[token], goes
            goes, token = self.ranks[token], halves[token][side]
        yield self.ranks[token], -1, goes

    def may_follow(self, a: int, b: int) -> bool:
        """Whether no merge comes about across the boundary between two tokens."""
        if a < 0:
            return True
        key = a << 32 | b
        found = self.beside.get(key)
        if found is None:
            found = self.beside[key] = self._may_follow(a, b)
        return found

    def _may_follow(self, a: int, b: int) -> bool:
        pairs, left = self.pairs, self.left[b]
        for x, x_comes, x_goes in self.right[a]:
            x <<= 32
            for y, y_comes, y_goes in left:
                # of two equal merges the left one comes first
                if x | y in pairs and pairs[x | y] < x_goes and pairs[x | y] <= y_goes and x_comes < y_goes and y_comes < x_goes:
                    return False
        return True

    def leads_on(self, a: int, node: int) -> bool:
        """Whether some token below a node of the trie may follow a token; else the path is given up at once.

        Where many tokens are below, the path is kept: it costs a state, never a wrong id.
        """
        if self.last[node] - self.first[node] > FEW:
            return True
        key = a << 32 | node
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = any(self.may_follow(a, t) for t in self.sorted[self.first[node] : self.last[node]])
        return found

    def follow(self, state: _State, char: str) -> _State:
        paths, out = state.paths, ()
        for b in char.encode("utf-8", "surrogateescape"):
            paths, more = self._step(paths, b)
            out += more
        key = (paths, out)
        found = self.states.get(key)
        if found is None:
            found = _State(self, paths, out)
            if len(self.states) >= STATES:
                self.missed += 1
                return found
            self.states[key] = found
        # a state that isn't kept leads to no others that are
        if state is self.states.get((state.paths, state.out)):
            state[char] = found
        return found

    def _step(self, paths: tuple, b: int) -> tuple[tuple, tuple]:
        """The paths after one more byte, and the tokens on which they agree; each keeps the last of these as its first."""
        inside, whole = [], None
        for tokens, node in paths:
            node = self.child.get(node << 8 | b)
            if node is not None and self.leads_on(tokens[-1], node):
                inside.append((tokens, node))
                if whole is None and self.token[node] >= 0 and self.may_follow(tokens[-1], self.token[node]):
                    whole = (*tokens, self.token[node])
        # the prefix as it stands has just one encoding
        inside.append((whole, _ROOT))
        agreed = len(whole)
        for tokens, _ in inside:
            agreed = min(agreed, len(tokens))
            while tokens[:agreed] != whole[:agreed]:
                agreed -= 1
        return tuple((tokens[agreed - 1 :], node) for tokens, node in inside), whole[1:agreed]

    def stream(self, chars: Iterable[str]) -> Iterable[tuple[int, ...]]:
        """The tokens that each character of a chunk settles, then those that its end does."""
        state = self.start
        for char in chars:
            state = state[char]
            yield state.out
        yield state.end


class _Chunks(dict):
    """From a chunk to its ids: paths that were walked before are stepped over as a whole."""

    __slots__ = ("transducer", "missed")

    def __init__(self, transducer: Transducer) -> None:
        self.transducer, self.missed = transducer, 0

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        state, ids = self.transducer.start, []
        for char in chunk:
            state = state[char]
            ids += state.out
        found = (*ids, *state.end)
        if len(self) < WHOLE:
            self[chunk] = found
        else:
            self.missed += 1
        return found


class _Open(dict):
    """From an id to (text, next state); a state holds the bytes of an unfinished character."""

    __slots__ = ("decoder", "held")

    def __init__(self, decoder: Utf8Machine, held: bytes) -> None:
        self.decoder, self.held = decoder, held

    def __missing__(self, token: int) -> tuple[str, _Open]:
        text, held = self.decoder.follow(self.held, self.decoder.tokens[token])
        found = self[token] = (text, self.decoder.state(held))
        return found


class Utf8Machine:
    """Ids to text, piece by piece; bytes that are no UTF-8 become lone surrogates U+DC80 to U+DCFF, one each."""

    #: Continuation bytes after each lead byte, and the range of the first of them where it is narrower.
    NEEDS = {**dict.fromkeys(range(0xC2, 0xE0), 1), **dict.fromkeys(range(0xE0, 0xF0), 2), **dict.fromkeys(range(0xF0, 0xF5), 3)}
    SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens
        self.open: dict[bytes, _Open] = {}
        self.start = self.state(b"")

    def state(self, held: bytes) -> _Open:
        # unfinished characters are of three bytes at most, so there are few states
        if held not in self.open:
            self.open[held] = _Open(self, held)
        return self.open[held]

    def follow(self, held: bytes, data: bytes) -> tuple[str, bytes]:
        out = []
        for b in data:
            if held:
                low, high = self.SECOND.get(held[0], (0x80, 0xBF)) if len(held) == 1 else (0x80, 0xBF)
                if low <= b <= high:
                    held += bytes([b])
                    if len(held) > self.NEEDS[held[0]]:
                        point = held[0] & (0x3F >> self.NEEDS[held[0]])
                        for c in held[1:]:
                            point = point << 6 | c & 0x3F
                        out.append(chr(point))
                        held = b""
                    continue
                out += [chr(0xDC00 + c) for c in held]
                held = b""
            if b < 0x80:
                out.append(chr(b))
            elif b in self.NEEDS:
                held = bytes([b])
            else:
                out.append(chr(0xDC00 + b))
        return "".join(out), held

    def stream(self, pieces: Iterable[Iterable[int]]) -> Iterable[str]:
        """The text of each piece of a row of ids, as far as its characters are complete; the last piece ends the text."""
        state = self.start
        for piece in pieces:
            out = []
            for token in piece:
                text, state = state[token]
                out.append(text)
            yield "".join(out)
        yield "".join(chr(0xDC00 + b) for b in state.held)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream([ids]))


class Coder:
    """Chunks of a pattern, each encoded by the transducer, and the way back."""

    #: The public pattern for texts of ASCII alone, which the standard library reads faster.
    PLAIN = {
        r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
    }

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.transducer, self.machine = Transducer(ranks), Utf8Machine({rank: token for token, rank in ranks.items()})
        self.whole = _Chunks(self.transducer)
        self.chunks = regex.compile(pattern).findall
        self.plain = self.PLAIN[pattern].findall if pattern in self.PLAIN else self.chunks

    def encode(self, text: str) -> list[int]:
        if self.transducer.missed > STATES or len(self.transducer.beside) > PAIRS or len(self.transducer.known) > PAIRS:
            self.transducer.clear()
        if self.whole.missed > 4 * WHOLE:
            self.whole.clear()
            self.whole.missed = 0
        return list(chain.from_iterable(map(self.whole.__getitem__, self.plain(text) if text.isascii() else self.chunks(text))))


def coder(path: str, pattern: str) -> Coder:
    """The coder of a Python worker, made once."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def encode_bytes(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of each row of docs(doc_id, text).

    path names a file of ranks, `pattern` the chunks that are encoded each on its own; special tokens
    are ordinary text. ids_sha256 is taken over ids as little-endian unsigned 32-bit integers,
    decoded_sha256 over the bytes that the ids stand for.

    Null texts count as empty, with no ids; very long texts are read as a whole, in time linear in
    their length; a null doc_id stays null; equal rows stay; other columns are ignored; an empty table
    gives an empty result.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int64())), ("decoded", pa.string())] * with_ids
    schema = pa.schema(fields)

    def block(own: Coder, some: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in some.column("text"):
            ids = own.encode(text.as_py())
            back = own.machine.decode(ids)
            digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), back.encode("utf-8", "surrogateescape"))]
            rows.append((len(ids), *digests, *((ids, back) if with_ids else ())))
        return pa.record_batch([some.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:]))], schema=schema)

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                # the collector would go through all states again and again, and find nothing
                was = gc.isenabled()
                gc.disable()
                try:
                    out = block(own, batch.slice(i, ROWS))
                finally:
                    if was:
                        gc.enable()
                yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids)


def decode_bytes(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """rows with a column `decoded`: the text of the column `ids`, bytes that are no UTF-8 as U+FFFD.

    Null ids, or ids that hold a null or a number outside the vocabulary, give a null text; no ids
    give an empty one. A column of that name is replaced; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        own = coder(path, pattern)

        def one(row):
            row = None if row is None else list(row)
            if row is None or any(i is None or i != i or int(i) not in own.machine.tokens for i in row):
                return None
            return own.machine.decode(map(int, row)).encode("utf-8", "surrogateescape").decode("utf-8", "replace")

        return ids.map(one)

    return rows.withColumn("decoded", decoded("ids"))
