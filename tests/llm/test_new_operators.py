"""Byte-level BPE, hard negatives and resampling against libraries and brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("lyricspark.llm.queries")


from lyricspark.llm import byte_bpe, hard_negatives, resampling  # noqa: E402
from lyricspark.llm.queries import vocabulary  # noqa: E402

from .test_operators import table, texts  # noqa: E402

P = pytest.importorskip("public_tokenizers")
RANKS = "byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    import tiktoken

    own = byte_bpe.coder(vocabulary(RANKS), P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.transducer.ranks, special_tokens={})


def odd_texts(n=400, seed=3):
    rng = random.Random(seed)
    parts = ["aA", "ab", "abcdefghijklmnop", "é中😀 ", "the and ing er", "\n \t ", "'stre", "0123456789", "\x00\x1c\x85\xa0 ", "<|endoftext|>"]
    return ["".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_bpe_is_the_library_s(spark, library):
    own, theirs = library
    rows = list(enumerate([*texts(groups=3, plain=5), *odd_texts(), "a" * 50_000, "<|endoftext|>", "x" * 3 + " " * 500]))
    docs = table(spark, [(i, t, "s") for i, t in rows] + [(None, "no id", "s"), (5, "again", None), (5, "again", None)])
    got = byte_bpe.encode_bytes(docs, vocabulary(RANKS), P.PATTERN, with_ids=True).collect()
    expected = Counter()
    for i, t in [*rows, (None, "no id"), (5, "again"), (5, "again")]:
        ids = theirs.encode_ordinary(t or "")
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids), t or ""] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in got) == expected


def test_bpe_of_rows_of_tokens(library):
    own, theirs = library
    rng = random.Random(1)
    tokens = [t.decode() for t in own.transducer.ranks if t.isascii() and t.isalpha()]
    for _ in range(3000):
        text = "".join(rng.choice(tokens) for _ in range(rng.randint(1, 6)))
        assert own.encode(text) == theirs.encode_ordinary(text)


def test_bpe_with_few_states_and_few_tries(library, monkeypatch):
    _, theirs = library
    own = byte_bpe.Coder(vocabulary(RANKS), P.PATTERN)
    for name, value in (("STATES", 50), ("WHOLE", 20), ("PAIRS", 300)):
        monkeypatch.setattr(byte_bpe, name, value)
    for few in (0, 10**9):
        monkeypatch.setattr(byte_bpe, "FEW", few)
        for text in odd_texts(60, seed=few % 7):
            assert own.encode(text) == theirs.encode_ordinary(text)
            assert [i for out in own.transducer.stream(text) for i in out] == (theirs._encode_single_piece(text) if text else [])


def trained(rng, merges):
    """A table of ranks from the most frequent pairs of random words."""
    words = [[bytes([rng.choice(b"abc")]) for _ in range(rng.randint(2, 14))] for _ in range(30)]
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 256 + merges:
        pairs = Counter(p for w in words for p in zip(w, w[1:]))
        if not pairs:
            break
        a, b = max(pairs, key=lambda p: (pairs[p], p))
        ranks.setdefault(a + b, len(ranks))
        for w in words:
            i = 0
            while i < len(w) - 1:
                if (w[i], w[i + 1]) == (a, b):
                    w[i : i + 2] = [a + b]
                i += 1
    return ranks


def test_bpe_of_small_vocabularies():
    import tiktoken

    rng, tried = random.Random(5), 0
    for _ in range(80):
        ranks = trained(rng, rng.randint(1, 40))
        try:
            chunks = byte_bpe._Chunks(byte_bpe.Transducer(ranks))
        except ValueError:
            continue
        tried += 1
        theirs = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(80):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 25)))
            assert list(chunks[text]) == theirs.encode_ordinary(text)
    assert tried > 20
    with pytest.raises(ValueError, match="lower ranks"):
        byte_bpe.Transducer({bytes([b]): b for b in range(256)} | {b"abc": 256})


def test_utf8_machine_at_any_cut():
    rng = random.Random(2)
    machine = byte_bpe.Utf8Machine({b: bytes([b]) for b in range(256)} | {256: "é".encode()[:1] + b"", 257: "中".encode()[1:] + b"a", 258: "😀".encode()[:3]})
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(256), rng.randrange(0xC0, 256), rng.randrange(0x80, 0xC0), 256, 257, 258]) for _ in range(rng.randint(0, 12))]
        data = b"".join(machine.tokens[i] for i in ids)
        cut = rng.randint(0, len(ids))
        assert machine.decode(ids) == "".join(machine.stream([ids[:cut], ids[cut:]])) == data.decode("utf-8", "surrogateescape")


def test_bpe_of_odd_tables(spark):
    path = vocabulary(RANKS)
    assert byte_bpe.encode_bytes(table(spark, []), path, P.PATTERN).collect() == []
    rows = spark.createDataFrame([(1, [220, 64]), (2, None), (3, []), (4, [99999999]), (5, [64, None])], "decoded int, ids array<long>")
    assert [r.decoded for r in byte_bpe.decode_bytes(rows, path, P.PATTERN).collect()] == [" a", None, "", None, None]


VEC = "vec_id long, embedding array<float>, label int, score string, rank int"


def brute_negatives(rows, every, n_pos, n_neg, scale, low, high):
    able = []
    for place, (i, v, y) in enumerate(rows):
        if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v):
            able.append((place, i, [math.floor(scale * float(np.float32(c))) for c in v], y))
    out = []
    for p, i, v, y in able:
        if i % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, z) for q, j, w, z in able if q != p and len(w) == len(v)), key=lambda s: s[:2])
            for s, j, _ in [s for s in scored if s[2] == y][:n_pos]:
                fits = [(-t, k) for t, k, z in scored if z != y and low * -s <= 100 * -t <= high * -s][:n_neg]
                out += [(i, j, r + 1, k, -s, t) for r, (t, k) in enumerate(fits)]
    return Counter(out)


def vectors(seed, n=260, dim=13):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=dim) * rng.choice([0.2, 1.0])
        rows.append((i, [float(c) for c in v * rng.choice([0.1, 1.0])], int(rng.integers(4))))
    rows[20] = (20, rows[21][1], rows[20][2])  # equal vectors
    rows += [rows[30], rows[40], (None, rows[3][1], 1), (900, None, 1), (910, [], 1), (920, [None] * dim, 1), (930, [math.nan] * dim, 1), (940, [math.inf] * dim, 1), (950, rows[1][1], None)]
    rows += [(960, [0.0] * dim, 1), (970, [1.0, 2.0], 1), (971, [1.0, 1.5], 1), (972, [0.5, 1.0], 2), (980, [5.0], 9)]
    return rows


@pytest.mark.parametrize(("anchors", "batch", "task"), [(1024, 4096, 16384), (3, 16, 50)])
def test_hard_negatives(spark, monkeypatch, anchors, batch, task):
    for name, value in (("ANCHORS", anchors), ("VECTORS", batch), ("TASK", task)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(anchors)
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], VEC).repartition(3)
    found = hard_negatives.hard_negatives(df, every=10)
    got = Counter(map(tuple, found.collect()))
    # of anchors that repeat, only equal rows are in the table
    assert got == brute_negatives(rows, 10, 5, 10, 256, 30, 90)
    assert sum(got.values()) > 300


def test_hard_negatives_of_an_empty_table(spark):
    df = spark.createDataFrame([], VEC)
    assert hard_negatives.hard_negatives(df).collect() == []


@pytest.mark.parametrize("ratio", [0.0, 15.0, 40.0])
def test_partial_index_loses_no_pair(ratio):
    rng = np.random.default_rng(7)
    x, q = np.floor(rng.normal(size=(300, 37)) * rng.uniform(0.1, 2, (300, 1)) * 10), np.floor(rng.normal(size=(20, 37)) * 10)
    t = ratio * np.sqrt((q * q).sum(1)) * rng.uniform(1, 1.5, 20)
    index = hard_negatives.PartialIndex(x, ratio)
    i, j, score = index.above(q, t)
    full = q @ x.T
    assert sorted(zip(i.tolist(), j.tolist())) == [tuple(p) for p in np.argwhere(full >= t[:, None]).tolist()]
    assert (full[i, j] == score).all()
    assert (index.omitted.max() > 0) == (ratio > 0)


def test_crc_matrices():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 300_000, dtype=np.uint8)
    lengths = np.array([0, 1, 2, 3, 3, 255, 256, 257, 512, 513, 1000, 100_000, 7, 256 * 5])
    starts = rng.integers(0, 200_000, len(lengths))
    assert resampling.crc32_of(data, starts, lengths).tolist() == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, lengths)]


FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = FEATURE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, percent, least, longest, buckets, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in side for f in features(text, longest)[1]) for side in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        words, found = features(text, longest)
        weight, score = sum(gain(bucket(f)) for f in found), None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, words])
    able = sorted((r for r in rows if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = n
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize(("longest", "piece"), [(1, 1 << 22), (3, 500)])
def test_resample(spark, monkeypatch, longest, piece):
    monkeypatch.setattr(resampling, "SLICE", piece)
    rows = list(enumerate([*texts(groups=6), *odd_texts(120), "w" * 3000 + " Z" * 30, "A-b_c.d"])) + [(None, "n " * 40), (8, "x " * 3000), (12, "other text " * 12)]
    docs = table(spark, [(i, t, "s") for i, t in rows]).repartition(3)
    target = ["a b c", None, "x é", "wWw " * 9]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, weight int")
    got = resampling.resample(docs, df, percent=25, least_words=5, longest=longest, buckets=97, seed=7).collect()
    assert Counter(map(tuple, got)) == brute_resample(rows, target, 25, 5, longest, 97, 7)


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(table(spark, []), none).collect() == []
    got = resampling.resample(table(spark, [(1, "a " * 20, "s"), (2, None, "s")]), none, percent=100).collect()
    assert {(r.doc_id, r.n_features, r["rank"]) for r in got} == {(1, 20, 1), (2, 0, None)}
