"""Edit distances and alignments of sequences, as Arrow-batched functions.

A column of the distance table differs from cell to cell by one at most, so it is kept as bits of long
integers, which work out a whole column in a few operations. The differences of all columns are enough
to trace an alignment back. Pairs of a batch that are about as long are worked out together, as arrays of
64-bit words; longer or lonely ones one by one, with Python's integers.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Sequence
from difflib import SequenceMatcher
from heapq import heappop, heappush
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of the table whose differences are kept at most, at half a byte each; of a larger table each √n-th column is
#: kept, and those between are worked out again on the way back.
CELLS = 1 << 28
DELETE, INSERT, SUBSTITUTE, CORRECT = range(4)
_NAMES = {DELETE: "deletion", INSERT: "insertion", SUBSTITUTE: "substitution", CORRECT: "correct"}


def _matches(a: Sequence) -> dict:
    """The places of each element of a, as bits."""
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    return {x: sum(1 << i for i in at) for x, at in places.items()}


def _columns(match: dict, full: int, vp: int, vn: int, b: Sequence):
    """(HP, HN, VP, VN) for each element of b: bit i says whether the cell of a's first i + 1 elements is one more or one less than the cell to its left, or above it.

    vp and vn are those of the column before; the first one's are full and 0.
    """
    for y in b:
        eq = match.get(y, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp, hn = (vn | ~(xh | vp)) & full, vp & xh
        up, down = hp << 1 | 1, hn << 1
        vp, vn = (down | ~(xv | up)) & full, up & xv & full
        yield hp, hn, vp, vn


class _Table:
    """The columns of a distance table from the last to the first, `block` of them at hand at a time."""

    def __init__(self, a: Sequence, b: Sequence, block: int | None = None) -> None:
        self.match, self.full, self.b = _matches(a), (1 << len(a)) - 1, b
        self.block = block or (len(b) if len(a) * len(b) <= CELLS else isqrt(len(b))) or 1
        #: (VP, VN) before each block.
        self.before = [(self.full, 0)]
        if self.block < len(b):
            for n, (_, _, vp, vn) in enumerate(_columns(self.match, self.full, self.full, 0, b), 1):
                if n % self.block == 0:
                    self.before.append((vp, vn))
        self.at, self.kept = -1, []

    def column(self, j: int) -> tuple[int, int, int, int]:
        n, place = divmod(j, self.block)
        if n != self.at:
            self.at, self.kept = n, list(_columns(self.match, self.full, *self.before[n], self.b[n * self.block : (n + 1) * self.block]))
        return self.kept[place]


def _distances(a: Sequence, b: Sequence) -> list[int]:
    """The distances of a to every prefix of b."""
    if not len(a):
        return list(range(len(b) + 1))
    last, full = len(a) - 1, (1 << len(a)) - 1
    return list(accumulate(((hp >> last) - (hn >> last) for hp, hn, _, _ in _columns(_matches(a), full, full, 0, b)), initial=len(a)))


def align_ops(a: Sequence, b: Sequence, order: tuple[int, ...], block: int | None = None) -> list[int]:
    """The operations of a cheapest alignment, traced back from the end; `order` ranks the moves that tie.

    block is the number of columns that are kept at a time, which changes nothing but memory and time.
    """
    out, i, j = [], len(a), len(b)
    # equal ends are correct in any order
    while order[0] == CORRECT and i and j and a[i - 1] == b[j - 1]:
        out.append(CORRECT)
        i, j = i - 1, j - 1
    table = _Table(a[:i], b[:j], block)

    def down(i: int, j: int) -> int:
        _, _, vp, vn = table.column(j - 1) if j else (0, 0, -1, 0)
        return (vp >> (i - 1) & 1) - (vn >> (i - 1) & 1)

    def right(i: int, j: int) -> int:
        hp, hn, _, _ = table.column(j - 1) if i else (-1, 0, 0, 0)
        return (hp >> max(i - 1, 0) & 1) - (hn >> max(i - 1, 0) & 1)

    while i or j:
        same = i and j and a[i - 1] == b[j - 1]
        for move in order:
            if move == CORRECT and same or move == SUBSTITUTE and i and j and not same and down(i, j) + right(i - 1, j) == 1:
                i, j = i - 1, j - 1
            elif move == DELETE and i and down(i, j) == 1:
                i -= 1
            elif move == INSERT and j and right(i, j) == 1:
                j -= 1
            else:
                continue
            out.append(move)
            break
    return out[::-1]


#: 64-bit words of a column, and numbers kept of a group of pairs, up to which pairs are worked out together.
WORDS = 16
KEPT = 1 << 21


class _Side:
    """Sequences of one side of a batch: their elements as numbers behind one another, and where each starts."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.sizes = ids, sizes
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.starts = self.ends - sizes

    def one(self, n: int) -> list[int]:
        return self.ids[self.starts[n] : self.ends[n]].tolist()

    def rows(self, rows: np.ndarray, width: int, pad: int) -> np.ndarray:
        """The sequences of these rows, padded to one width."""
        at = np.arange(width)
        inside = at < self.sizes[rows, None]
        out = np.full((len(rows), width), pad, self.ids.dtype)
        out[inside] = self.ids[(self.starts[rows, None] + at)[inside]]
        return out


def _sides(ids: np.ndarray, known: int, sizes: tuple[np.ndarray, np.ndarray]) -> tuple[_Side, _Side]:
    """Both sides, from the elements of the first and then of the second; the two highest numbers of the type stay free."""
    kind = np.uint8 if known < 255 else np.uint16 if known < 65535 else np.uint32
    ids, cut = ids.astype(kind), int(sizes[0].sum())
    return _Side(ids[:cut], sizes[0]), _Side(ids[cut:], sizes[1])


def _coded(ref: pa.Array, hyp: pa.Array) -> tuple[tuple[_Side, _Side], pa.Array]:
    """Both sides, and the words that their numbers stand for."""
    flat = [x.flatten() for x in (ref, hyp)]
    coded = pa.chunked_array(flat).combine_chunks().dictionary_encode("encode")
    sizes = tuple(np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64) for x in (ref, hyp))
    return _sides(np.asarray(coded.indices), len(coded.dictionary), sizes), coded.dictionary


def _word_sides(ref: pa.Array, hyp: pa.Array) -> tuple[_Side, _Side]:
    return _coded(ref, hyp)[0]


def _char_sides(a: list[str], b: list[str]) -> tuple[_Side, _Side]:
    points = np.frombuffer("".join([*a, *b]).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    sizes = tuple(np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    return _sides((np.cumsum(seen) - 1)[points], int(seen.sum()), sizes)


def _groups(a: _Side, b: _Side):
    """(rows, 64-bit words of a column): rows of about equal sizes, or one by one with 0 words."""
    words = np.maximum(-(-a.sizes // 64), 1)
    order = np.lexsort((b.sizes, words))
    order = order[(a.sizes[order] > 0) & (b.sizes[order] > 0)]
    at = 0
    while at < len(order):
        deep, wide = words[order[at]], b.sizes[order[at]]
        widest = wide + wide // 4 + 4
        fits = max(int(KEPT // (widest * deep)), 1)
        part = order[at : at + min(fits, 1024)]
        part = part[(words[part] == deep) & (b.sizes[part] <= widest)]
        if deep <= WORDS and len(part) >= 16 * deep:
            yield part, int(deep)
        else:
            for n in part:
                yield np.array([n]), 0
        at += len(part)


def _columns_of(x: np.ndarray, y: np.ndarray, deep: int):
    """(D0, VP, HP, HN) by column as `_columns` has them, each of `deep` rows of words, for many pairs; bits beyond a pair's own mean nothing.

    A bit of D0 says that the cell is the same as the one before it in the diagonal.
    """
    n, one, top = len(x), np.uint64(1), np.uint64(63)
    vp, vn = [np.full(n, ~np.uint64(0)) for _ in range(deep)], [np.zeros(n, np.uint64) for _ in range(deep)]
    for j in range(y.shape[1]):
        eqs = np.packbits(x == y[:, j, None], axis=1, bitorder="little").view(np.uint64)
        d0s, hps, hns = [], [], []
        carry, up, down = np.zeros(n, np.uint64), np.ones(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(deep):
            eq, p, q = np.ascontiguousarray(eqs[:, k]), vp[k], vn[k]
            both = eq & p
            added = both + p
            over = added < both
            if k:
                added += carry
                over |= added < carry
            carry = over.astype(np.uint64)
            d0 = (added ^ p) | eq | q
            hp, hn = q | ~(d0 | p), p & d0
            left, right = hp << one | up, hn << one | down
            up, down = hp >> top, hn >> top
            vp[k], vn[k] = right | ~(d0 | left), left & d0
            d0s.append(d0), hps.append(hp), hns.append(hn)
        yield d0s, vp, hps, hns


def _padded(rows: np.ndarray, deep: int, a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray]:
    free = np.iinfo(a.ids.dtype).max
    return a.rows(rows, 64 * deep, free), b.rows(rows, int(b.sizes[rows].max()), free - 1)


def _all_distances(a: _Side, b: _Side) -> np.ndarray:
    """The edit distance of each pair."""
    out = np.maximum(a.sizes, b.sizes)
    for rows, deep in _groups(a, b):
        if not deep:
            out[rows[0]] = distance(a.one(rows[0]), b.one(rows[0]))
            continue
        last, sizes = a.sizes[rows] - 1, b.sizes[rows]
        word, bit, far = last >> 6, (last & 63).astype(np.uint64), a.sizes[rows].copy()
        for j, (_, _, hp, hn) in enumerate(_columns_of(*_padded(rows, deep, a, b), deep)):
            one, less = (x[0] if deep == 1 else np.choose(word, x) for x in (hp, hn))
            step = (one >> bit & np.uint64(1)).astype(np.int64) - (less >> bit & np.uint64(1)).astype(np.int64)
            far += np.where(j < sizes, step, 0)
        out[rows] = far
    return out


def _traced(x: np.ndarray, y: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], deep: int, order: tuple[int, ...]) -> np.ndarray:
    """The operations of each pair, from the right; -1 in front of them."""
    n, width, (i, j) = len(x), y.shape[1], (s.copy() for s in sizes)
    diagonal = order[1] == SUBSTITUTE
    kept, right = (np.empty((width, deep, n), np.uint64) for _ in range(2))
    for c, (d0, vp, hp, _) in enumerate(_columns_of(x, y, deep)):
        kept[c], right[c] = d0 if diagonal else vp, hp
    kept, right, at = kept.reshape(-1), right.reshape(-1), np.arange(n)
    longest, one = int((i + j).max()), np.uint64(1)
    out = np.full((n, longest), -1, np.int8)
    for step in range(longest - 1, -1, -1):
        some = (i > 0) | (j > 0)
        if not some.any():
            break
        u, v = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        inner = (i > 0) & (j > 0)
        same = inner & (x[at, u] == y[at, v])
        place, bit = (v * deep + (u >> 6)) * n + at, (u & 63).astype(np.uint64)
        k, r = (kept[place] >> bit & one).astype(bool), (right[place] >> bit & one).astype(bool)
        insert = (j > 0) & ((i == 0) | r)
        if diagonal:
            move = np.where(inner & ~k, SUBSTITUTE, np.where(insert, INSERT, DELETE))
        else:
            move = np.where((i > 0) & ((j == 0) | k), DELETE, np.where(insert, INSERT, SUBSTITUTE))
        move = np.where(same, CORRECT, move)
        out[:, step] = np.where(some, move, -1)
        i -= some & (move != INSERT)
        j -= some & (move != DELETE)
    return out


def _all_ops(a: _Side, b: _Side, order: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(operations of all pairs behind one another, their number for each pair); order as in `align_ops`, correct first, a substitution second or last."""
    found, rows_of, places = [], [], []

    def put(rows: np.ndarray, ops: np.ndarray) -> None:
        inside = ops >= 0
        row, at = inside.nonzero()
        found.append(ops[inside]), rows_of.append(rows[row]), places.append(at)

    for rows, deep in _groups(a, b):
        if deep:
            put(rows, _traced(*_padded(rows, deep, a, b), (a.sizes[rows], b.sizes[rows]), deep, order))
        else:
            put(rows, np.array([align_ops(a.one(rows[0]), b.one(rows[0]), order)], np.int8))
    # an empty side leaves the other one's elements
    for side, other, op in ((a, b, DELETE), (b, a, INSERT)):
        rows = np.flatnonzero((other.sizes == 0) & (side.sizes > 0))
        many = np.repeat(rows, side.sizes[rows])
        found.append(np.full(len(many), op, np.int8)), rows_of.append(many), places.append(np.arange(len(many)))
    ops, rows, at = (np.concatenate(x) for x in (found, rows_of, places))
    sizes = np.bincount(rows, minlength=len(a.sizes))
    return ops[np.lexsort((at, rows))], sizes


def edit_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """(insertions, deletions, substitutions); ties prefer a deletion, then an insertion, then a substitution."""
    ops = align_ops(ref, hyp, (CORRECT, DELETE, INSERT, SUBSTITUTE))
    return ops.count(INSERT), ops.count(DELETE), ops.count(SUBSTITUTE)


def word_alignment(ref: list[str], hyp: list[str]) -> list[tuple[str, str | None, str | None]]:
    """(op, ref_word, hyp_word) in order; ties prefer a substitution, then an insertion, then a deletion."""
    out, i, j = [], 0, 0
    for op in align_ops(ref, hyp, (CORRECT, SUBSTITUTE, INSERT, DELETE)):
        r = ref[i] if op != INSERT else None
        h = hyp[j] if op != DELETE else None
        i, j = i + (op != INSERT), j + (op != DELETE)
        out.append((_NAMES[op], r, h))
    return out


def diff_pairs(trans: list[str], ref: list[str]) -> list[tuple[str | None, str | None]]:
    """Pairs of difflib's opcodes: equal words, replaced ones zipped and padded with null, one-sided rest."""
    out: list[tuple[str | None, str | None]] = []
    for _, a, b, c, d in SequenceMatcher(None, trans, ref).get_opcodes():
        x, y = list(trans[a:b]), list(ref[c:d])
        n = max(len(x), len(y))
        out += zip(x + [None] * (n - len(x)), y + [None] * (n - len(y)))
    return out


def edit_ops(ref: Column, hyp: Column) -> Column:
    """struct<insertions, deletions, substitutions, ref_words, hyp_words> of two arrays of words."""

    @F.arrow_udf("struct<insertions:int,deletions:int,substitutions:int,ref_words:int,hyp_words:int>")
    def run(r: pa.Array, h: pa.Array) -> pa.Array:
        sides = _word_sides(r, h)
        ops, sizes = _all_ops(*sides, (CORRECT, DELETE, INSERT, SUBSTITUTE))
        rows = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.bincount(rows * 4 + ops, minlength=4 * len(sizes)).reshape(-1, 4).astype(np.int32)
        columns = [*(counts[:, op] for op in (INSERT, DELETE, SUBSTITUTE)), *(x.sizes.astype(np.int32) for x in sides)]
        return pa.StructArray.from_arrays([pa.array(x) for x in columns], ["insertions", "deletions", "substitutions", "ref_words", "hyp_words"])

    return run(ref, hyp)


def _aligned(r: pa.Array, h: pa.Array, wrong: bool) -> pa.Array:
    """Lists of (position, op, ref_word, hyp_word), of all operations or those that aren't correct."""
    ops, sizes = _all_ops(*_word_sides(r, h), (CORRECT, SUBSTITUTE, INSERT, DELETE))
    # the operations use up all words of both sides in order
    sides = [(x.flatten(), ops != without) for x, without in ((r, INSERT), (h, DELETE))]
    rows, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    kept = np.flatnonzero(ops != CORRECT) if wrong else np.arange(len(ops))
    heard = [w.take(pa.array((np.cumsum(on) - 1)[kept], mask=~on[kept])) for w, on in sides]
    position = (kept - (ends - sizes)[rows[kept]]).astype(np.int32)
    names = pa.array([_NAMES[op] for op in range(4)]).take(pa.array(ops[kept]))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows[kept], minlength=len(sizes)))]).astype(np.int32)
    fields = {"position": pa.array(position), "op": names, "ref_word": heard[0], "hyp_word": heard[1]}
    if not wrong:
        del fields["position"]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def align_words(ref: Column, hyp: Column) -> Column:
    """array<struct<op, ref_word, hyp_word>> of two arrays of words."""

    @F.arrow_udf("array<struct<op:string,ref_word:string,hyp_word:string>>")
    def run(r: pa.Array, h: pa.Array) -> pa.Array:
        return _aligned(r, h, False)

    return run(ref, hyp)


def align_errors(ref: Column, hyp: Column) -> Column:
    """array<struct<position, op, ref_word, hyp_word>>: the rows of align_words that aren't correct, with their places."""

    @F.arrow_udf("array<struct<position:int,op:string,ref_word:string,hyp_word:string>>")
    def run(r: pa.Array, h: pa.Array) -> pa.Array:
        return _aligned(r, h, True)

    return run(ref, hyp)


#: Matching places of a pair above which the pair is left to difflib, which is slower and keeps none; and of pairs worked out together.
PLACES = 1 << 21
PLACES_TOGETHER = 1 << 20


def _placed(runs: list[tuple[int, int, int]], x: np.ndarray, y: np.ndarray, extend: bool) -> list[tuple[int, int, int]]:
    """difflib's matching blocks (i, j, size) from all runs of equal words (-size, i, j), sorted.

    The longest run comes first, then the one that starts first, and what overlaps it on either side is cut
    off from the others. A run is cut when its turn comes, and then waits for its new one. `extend` lets
    blocks grow over equal words that are in no run.
    """
    starts, blocks = [-1, len(x)], [(-1, -1, 1), (len(x), len(y), 0)]
    while runs:
        size, i, j = heappop(runs)
        size, n = -size, bisect(starts, i)
        (u, v, k), (p, q, _) = blocks[n - 1], blocks[n]
        if skip := max(0, u + k - i, v + k - j):
            if skip < size:
                heappush(runs, (skip - size, i + skip, j + skip))
            continue
        room = min(p - i, q - j)
        if room < size:
            if room > 0:
                heappush(runs, (-room, i, j))
            continue
        if extend:
            while i > u + k and j > v + k and x[i - 1] == y[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < p and j + size < q and x[i + size] == y[j + size]:
                size += 1
        starts.insert(n, i)
        blocks.insert(n, (i, j, size))
    return blocks[1:]


def _runs(a: _Side, b: _Side, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, -size, i, j) of the longest stretches of equal words, sorted; words that are too frequent for difflib are in none."""
    sizes = b.sizes[rows]
    flat = [np.repeat(np.arange(len(rows)), s.sizes[rows]) for s in (a, b)]
    at = [np.arange(len(f)) - np.repeat(np.cumsum(s.sizes[rows]) - s.sizes[rows], s.sizes[rows]) for f, s in zip(flat, (a, b))]
    known = int(max(a.ids.max(initial=0), b.ids.max(initial=0))) + 1
    keys = [f * known + s.ids[s.starts[rows][f] + p] for f, p, s in zip(flat, at, (a, b))]
    order = np.argsort(keys[1], kind="stable")
    held = keys[1][order]
    first = np.searchsorted(held, keys[0])
    count = np.searchsorted(held, keys[0], "right") - first
    wide = sizes[flat[0]]
    count[(wide >= 200) & (count > wide // 100 + 1)] = 0
    left = np.repeat(np.arange(len(count)), count)
    right = order[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(left))]
    row, i, j = flat[0][left], at[0][left], at[1][right]
    # a number for each diagonal of each row, and for the places along it
    wides = a.sizes[rows] + sizes + 2
    line = (np.cumsum(wides) - wides)[row] + j - i + a.sizes[rows][row]
    place = line * (int(a.sizes[rows].max(initial=0)) + 2) + i
    order = np.argsort(place)
    place = place[order]
    start = np.flatnonzero(np.diff(place, prepend=-2) != 1)
    size = np.diff(start, append=len(place))
    row, i, j = (z[order[start]] for z in (row, i, j))
    order = np.lexsort((j, i, -size, row))
    return row[order], -size[order], i[order], j[order]


def _diff_places(a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in a, place in b) of difflib's pairs, -1 for no word: equal words, replaced ones zipped and padded, one-sided rest."""
    blocks: list[list[tuple[int, int, int]]] = [[(int(x), int(y), 0)] for x, y in zip(a.sizes, b.sizes)]
    # at most so many places match
    places = a.sizes * np.where(b.sizes < 200, b.sizes, b.sizes // 100 + 1)
    for n in np.flatnonzero(places > PLACES):
        blocks[n] = [tuple(m) for m in SequenceMatcher(None, a.one(n), b.one(n)).get_matching_blocks()]
    some = np.flatnonzero((places > 0) & (places <= PLACES))
    for rows in np.split(some, np.flatnonzero(np.diff(np.cumsum(places[some]) // PLACES_TOGETHER)) + 1):
        row, *runs = _runs(a, b, rows)
        cuts = np.searchsorted(row, np.arange(len(rows) + 1)).tolist()
        runs = list(zip(*(z.tolist() for z in runs)))
        for n, low, high in zip(rows.tolist(), cuts, cuts[1:]):
            wide = b.sizes[n] >= 200
            blocks[n] = _placed(runs[low:high], *((s.one(n) if wide else range(s.sizes[n])) for s in (a, b)), wide)
    row = np.repeat(np.arange(len(blocks)), [len(z) for z in blocks])
    i, j, size = np.array([m for z in blocks for m in z], np.int64).reshape(-1, 3).T
    new = np.diff(row, prepend=-1) != 0
    before = [np.where(new, 0, np.concatenate([[0], (z + size)[:-1]])) for z in (i, j)]
    # a gap, then the block behind it
    gaps = [z - w for z, w in zip((i, j), before)]
    gap = np.maximum(*gaps)
    many = gap + size
    of = np.repeat(np.arange(len(many)), many)
    step = np.arange(len(of)) - (np.cumsum(many) - many)[of]
    found = []
    for low, g in zip(before, gaps):
        inside = np.where(step < g[of], low[of] + step, -1)
        found.append(np.where(step >= gap[of], low[of] + g[of] + step - gap[of], inside))
    return row[of], *found


def _taken(side: _Side, words: pa.Array, row: np.ndarray, place: np.ndarray) -> pa.Array:
    return words.take(pa.array(side.starts[row] + place, mask=place < 0))


def _offsets(row: np.ndarray, rows: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)


def diff_align(trans: Column, ref: Column) -> Column:
    """array<struct<trans, ref>> of two arrays of words: pairs of difflib's opcodes."""

    @F.arrow_udf("array<struct<trans:string,ref:string>>")
    def run(t: pa.Array, r: pa.Array) -> pa.Array:
        sides = _word_sides(t, r)
        row, *places = _diff_places(*sides)
        heard = [_taken(s, x.flatten(), row, p) for s, x, p in zip(sides, (t, r), places)]
        return pa.ListArray.from_arrays(_offsets(row, len(t)), pa.StructArray.from_arrays(heard, ["trans", "ref"]))

    return run(trans, ref)


def distance(a: Sequence, b: Sequence) -> int:
    """The edit distance of two sequences; equal ends are cut off first."""
    i, m, n = 0, len(a), len(b)
    while i < m and i < n and a[i] == b[i]:
        i += 1
    while m > i and n > i and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    return _distances(a[i:m], b[i:n])[-1]


def char_distances(a: Column, b: Column) -> Column:
    """The edit distance of two texts; nulls stay null."""

    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        missing = np.asarray(pc.or_(pc.is_null(x), pc.is_null(y)))
        sides = _char_sides(*([t or "" for t in z.to_pylist()] for z in (x, y)))
        return pa.array(_all_distances(*sides).astype(np.int32), mask=missing)

    return run(a, b)


def distances(ref: Column, hyp: Column) -> Column:
    """struct<errors, ref_words> of two arrays of words: their edit distance, and the first one's size, for which it is made once."""

    @F.arrow_udf("struct<errors:int,ref_words:int>")
    def run(r: pa.Array, h: pa.Array) -> pa.Array:
        a, b = _word_sides(r, h)
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (_all_distances(a, b), a.sizes)], ["errors", "ref_words"])

    return run(ref, hyp)


def error_rates(ref: Column, hyp: Column, empty_ref: str = "count") -> Column:
    """Edit distance over the reference's words; null for a null array, but 1 where the reference is empty and empty_ref is one."""

    @F.arrow_udf("double")
    def run(r: pa.Array, h: pa.Array) -> pa.Array:
        a, b = _word_sides(r, h)
        lost, unheard = (np.asarray(pc.is_null(x)) for x in (r, h))
        none = (a.sizes == 0) & ~lost
        empty = b.sizes.astype(float) if empty_ref == "count" else np.where((b.sizes == 0) & ~unheard, 0.0, 1.0)
        rates = np.where(none, empty, _all_distances(a, b) / np.maximum(a.sizes, 1))
        return pa.array(rates, mask=lost | (unheard & none & (empty_ref == "count")))

    return run(ref, hyp)
