"""The classifiers against plain loops: a convolution written out, and a kernel by enumeration."""

import itertools
import math
import random

import numpy as np
import pytest

pytest.importorskip("lyricspark.llm.queries")

from lyricspark.llm import quality, toxicity  # noqa: E402
from lyricspark.llm.labelled import labelled_sample  # noqa: E402

from .test_operators import table, texts  # noqa: E402


def plain_score(net, data):
    """Every filter at every place, the largest response over zero, one probability."""
    width, filters = len(net.taps), net.taps.shape[2]
    best = [0.0] * filters
    for p in range(len(data) - width + 1):
        for f in range(filters):
            best[f] = max(best[f], float(sum(net.taps[j, data[p + j], f] for j in range(width))) + float(net.bias[f]))
    return 1 / (1 + math.exp(-(sum(b * float(o) for b, o in zip(best, net.out)) + net.shift)))


@pytest.mark.parametrize("chunk", [8192, 16])
def test_network_is_a_plain_convolution(spark, monkeypatch, chunk):
    monkeypatch.setattr(quality, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    net = quality.ByteNet.new(seed=9)
    net.bias += rng.normal(0, 0.2, net.bias.shape).astype(np.float32)
    rows = list(enumerate([None, "", "a", "abcde", "abcdef", "é中😀 " * 9, *[t for t in texts(groups=2, plain=6) if t and len(t) < 300]]))
    net.taps, pairs = net.taps.copy(), net.pairs()
    for i, t in rows:
        data = np.frombuffer((t or "").encode(), dtype=np.uint8)
        assert net.score(data, pairs) == pytest.approx(plain_score(net, data), abs=1e-5)
    if chunk == 8192:
        got = quality.score_quality(table(spark, [(i, t, "s") for i, t in rows]), net).collect()
        assert {r.doc_id: r.score for r in got} == pytest.approx({i: plain_score(net, (t or "").encode()) for i, t in rows}, abs=1e-5)
        # a score of the documents' own gave way
        assert all(isinstance(r.score, float) and r.predicted == int(r.score >= 0.3) for r in got)


def letter(c):
    o = ord(c)
    return o - 96 if 97 <= o <= 122 else o - 21 if 48 <= o <= 57 else 37 + o % 27


def features(word):
    """Weights of all three-character subsequences within SPAN characters, of unit length together."""
    found = {}
    for i, j, k in itertools.combinations(range(len(word)), 3):
        if k - i < toxicity.SPAN:
            code = letter(word[i]) * 4096 + letter(word[j]) * 64 + letter(word[k])
            found[code] = found.get(code, 0.0) + toxicity.DECAY ** (k - i + 1)
    norm = math.sqrt(sum(w * w for w in found.values())) or 1.0
    return {c: w / norm for c, w in found.items()}


def test_kernel_by_enumeration():
    rng = random.Random(3)
    words = ["", "a", "ab", "abc", "aaaa", "idiot", "i-d-i-o-t", "1d10t", "ééé中"] + ["".join(rng.choice("abc1é") for _ in range(rng.randint(1, toxicity.PIECE))) for _ in range(25)]
    words = [w for w in words if w]
    weights = np.random.default_rng(1).normal(size=64**3).astype(np.float32)
    weights[0] = 0
    model = toxicity.Toxicity(weights, -0.25, 1.0, 0.0)
    expected = [sum(float(weights[c]) * w for c, w in features(x).items()) - 0.25 for x in words]
    assert model.decide(words) == pytest.approx(expected, abs=1e-4)
    marks = toxicity._Landmarks(words[:8])
    kernel = [[sum(w * features(m).get(c, 0.0) for c, w in features(x).items()) for m in words[:8]] for x in words]
    assert marks.kernel(words) == pytest.approx(np.array(kernel), abs=1e-4)
    # of a long word the worst piece decides
    long_ = "".join(rng.choice("abc") for _ in range(3 * toxicity.PIECE))
    assert model.decide([long_])[0] == pytest.approx(max(sum(float(weights[c]) * w for c, w in features(p).items()) - 0.25 for p in toxicity._pieces(long_)), abs=1e-4)


LABELS = "doc_id long, quality int, toxic int"


def test_classifiers_on_empty_tables_and_without_labels(spark):
    none, labels = table(spark, []), spark.createDataFrame([], LABELS)
    docs = table(spark, [(1, "some text", "s"), (1, "some text", "s"), (None, None, None), (2, "", "s")])
    for fit, score in ((quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)):
        assert score(none, fit(none, labels)).collect() == []
        got = score(docs, fit(docs, labels)).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 1}) == 1


def test_sample_is_bounded_and_settled(spark):
    docs = table(spark, [(i, f"text {i // 2}", "s") for i in range(40)] + [(50, "x" * 100, "s")])
    labels = spark.createDataFrame([(i, int(i % 4 < 2), 0) for i in range(40)] + [(0, 1, 0), (50, 1, 1), (None, 1, 1), (60, None, None)], LABELS)
    got = labelled_sample(docs, labels, "quality", 5, 0, 8, 50)
    # equal texts have equal labels here; texts that are too long are left out
    assert len(got) <= 16 and got["text"].is_unique and "x" * 100 not in set(got["text"])
    assert got.equals(labelled_sample(docs.repartition(3), labels, "quality", 5, 0, 8, 50))
