"""Toxicity of texts by a support vector machine on a gap-weighted subsequence kernel.

The kernel counts subsequences of three characters that two words share, where each may be spread
over five characters and counts less the wider it is spread; so gapped insults and inserted characters
stay close to the plain word. The Nyström method turns words into similarities to landmark words,
decorrelated, and a linear SVM learns on these which words of labelled sentences make them toxic: a
sentence is as toxic as its worst word, and which word that is, is learned in turns. As the kernel is a
sum over subsequences, the SVM's decision becomes one table of weights by subsequence.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import fold_of, labelled_sample

#: Weight of a subsequence for each character that it spans; the widest span.
DECAY, SPAN = 0.6, 5
#: Longer words are scored in overlapping pieces of this length.
PIECE = 24
#: So many distinct words are remembered by a Python worker; then it starts anew.
REMEMBERED = 200_000
_SHAPES = [(i, j) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN)]
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_MARKS = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_MEMO: dict[bytes, dict[str, float]] = {}


def units(text: str) -> set[str]:
    """The distinct words of a text, in lower case and without ASCII punctuation; spelled-out words put together."""
    low = text.lower()
    found = set(low.translate(_MARKS).split())
    for m in _SPACED.findall(low):
        found.add(m.replace(" ", "").translate(_MARKS))
    found.discard("")
    return found


def _grams(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked[i : i + 5] for i in range(max(1, len(marked) - 4))}


def _pieces(word: str) -> list[str]:
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word) - SPAN + 1, PIECE - SPAN + 1)]


def _letters(words: list[str]) -> np.ndarray:
    """Characters as numbers from 1 to 63, 0 behind the end."""
    flat = np.frombuffer("".join(w.ljust(PIECE, "\0") for w in words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), PIECE)
    out = np.where(flat == 0, 0, 37 + flat % 27)
    out = np.where((flat >= 97) & (flat <= 122), flat - 96, out)
    return np.where((flat >= 48) & (flat <= 57), flat - 21, out).astype(np.int32)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the three-character subsequences of each word (0: none) and their weights, of unit length in kernel space."""
    x = np.pad(_letters(words), ((0, 0), (0, SPAN)))
    codes, weights = [], []
    first = x[:, :PIECE]
    for i, j in _SHAPES:
        a, b = x[:, i : i + PIECE], x[:, j : j + PIECE]
        codes.append(np.where((first > 0) & (a > 0) & (b > 0), first * 4096 + a * 64 + b, 0))
        weights.append(np.float32(DECAY ** (j + 1)))
    code = np.concatenate(codes, axis=1)
    weight = np.where(code > 0, np.repeat(np.array(weights, dtype=np.float32), PIECE)[None], 0)
    # equal subsequences of a word add up before they are squared
    order = np.argsort(code, 1)
    code, weight = np.take_along_axis(code, order, 1), np.take_along_axis(weight, order, 1)
    new = np.ones(code.shape, dtype=bool)
    new[:, 1:] = code[:, 1:] != code[:, :-1]
    sums = np.add.reduceat(weight.ravel(), np.flatnonzero(new.ravel()))
    square = np.zeros(len(words))
    np.add.at(square, np.nonzero(new)[0], sums.astype(np.float64) ** 2)
    return code, weight / np.sqrt(np.maximum(square, 1e-12))[:, None].astype(np.float32)


@dataclass
class Toxicity:
    """table: the SVM's weight of each subsequence; shift: of its decision; slope, level: from the worst word's decision to a probability."""

    table: np.ndarray
    shift: float
    slope: float
    level: float

    def decide(self, words: list[str]) -> np.ndarray:
        """The SVM's decision on each word, the worst of its pieces."""
        split = [_pieces(w) for w in words]
        flat = [p for s in split for p in s]
        out = np.empty(len(flat))
        for i in range(0, len(flat), 4096):
            code, weight = subsequences(flat[i : i + 4096])
            out[i : i + 4096] = (self.table[code] * weight).sum(1) + self.shift
        at = np.cumsum([0] + [len(s) for s in split])[:-1]
        return np.maximum.reduceat(out, at) if len(flat) else out

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.level, -30, 30)))


class _Landmarks:
    """Kernel values against a list of words, of PIECE characters at most."""

    def __init__(self, words: list[str]) -> None:
        code, weight = subsequences(words)
        self.used = np.unique(np.append(code, 0))
        self.rows = np.zeros((len(self.used), len(words)), dtype=np.float32)
        for i in range(len(words)):
            np.add.at(self.rows[:, i], np.searchsorted(self.used, code[i]), weight[i])
        self.rows[0] = 0
        self.place = np.zeros(64**3, dtype=np.int32)
        self.place[self.used] = np.arange(len(self.used))

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.rows.shape[1]))
        for i in range(0, len(words), 128):
            code, weight = subsequences(words[i : i + 128])
            for j in range(len(code)):
                at = self.place[code[j]]
                on = at > 0
                out[i + j] = weight[j][on] @ self.rows[at[on]]
        return out

    def table(self, alpha: np.ndarray) -> np.ndarray:
        """The weight of every subsequence in a sum of kernels with weights alpha."""
        out = np.zeros(64**3, dtype=np.float32)
        out[self.used] = self.rows @ alpha
        return out


def _svm(x: np.ndarray, y: np.ndarray, share: np.ndarray, cost: float = 1000.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by Newton steps on the active examples; both classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    s = np.where(y == 1, 1.0, -1.0)
    weight = share * np.where(y == 1, 0.5 / max(1e-9, share[y == 1].sum()), 0.5 / max(1e-9, share[y == 0].sum())) * cost
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        active = s * (x @ w) < 1
        a = x[active]
        new = np.linalg.solve(ridge + 2 * a.T @ (a * weight[active][:, None]), 2 * a.T @ (weight[active] * s[active]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def train(texts: list[str], y: np.ndarray, landmarks: int = 320, turns: int = 3, seed: int = 3) -> Toxicity:
    """Learns from texts labelled 1 or 0."""
    rng = np.random.default_rng(seed)
    # long words are learned from as they are scored, in pieces
    bags = [sorted({p for w in units(t) for p in _pieces(w)}) for t in texts]
    # five characters of a word, ends included, that set sentences labelled 1 apart
    n_bad, n_good = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    bad, good, often = Counter(), Counter(), Counter()
    for bag, label in zip(bags, y):
        (bad if label else good).update({g for w in bag for g in _grams(w)})
        if not label:
            often.update(w for w in bag if len(w) >= 3)
    lift = {g: c * np.log((c / n_bad) / ((good[g] + 0.5) / n_good)) for g, c in bad.items() if c >= 3}
    found: Counter = Counter()
    for bag, label in zip(bags, y):
        if label and bag:
            value, word = max((max((lift.get(g, 0.0) for g in _grams(w)), default=0.0), w) for w in bag)
            if value > 8:
                found[word] += 1
    suspects = sorted(found, key=lambda w: (-found[w], w))[:600]
    plain = sorted(often, key=lambda w: (-often[w], w))
    plain = plain[:500] + [plain[i] for i in rng.choice(len(plain), min(len(plain), 4000), replace=False)] if plain else []
    if not suspects or not plain:
        return Toxicity(np.zeros(64**3, np.float32), -1.0, 1.0, 0.0)
    every = sorted({u for bag in bags for u in bag})
    hard: list[str] = []
    positive, weight = suspects, [float(found[w]) for w in suspects]
    for _ in range(turns):
        random_ones = [plain[i] for i in rng.choice(len(plain), landmarks // 4)]
        marks = sorted({*suspects[: landmarks // 2], *random_ones, *hard[: landmarks // 4]})
        landmark = _Landmarks(marks)
        value, vector = np.linalg.eigh(landmark.kernel(marks))
        root = vector @ np.diag(np.where(value > 1e-4, 1 / np.sqrt(np.maximum(value, 1e-4)), 0)) @ vector.T
        words = positive + plain + hard
        labels = np.array([1] * len(positive) + [0] * (len(words) - len(positive)))
        share = np.array(weight + [1.0] * len(plain) + [4.0] * len(hard))
        w, b = _svm(landmark.kernel(words) @ root, labels, share)
        model = Toxicity(landmark.table(root @ w), b, 1.0, 0.0)
        decision = dict(zip(every, model.decide(every).tolist()))
        worst = [max(bag, key=decision.__getitem__) if bag else "" for bag in bags]
        # the words that make unmarked sentences look worst are learned from next
        hard = sorted({u for u, label in zip(worst, y) if not label and u and decision[u] > -1} | set(hard), key=lambda u: (-decision[u], u))[:2000]
    top = np.array([decision[u] if u else model.shift for u in worst])
    # a logistic curve over the worst words' decisions, slightly held back
    slope, level = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * top + level, -30, 30)))
        g = np.array([((y - p) * top).sum() - 0.01 * slope, (y - p).sum() - 0.01 * level])
        q = p * (1 - p)
        h = np.array([[(q * top * top).sum() + 0.05, (q * top).sum()], [(q * top).sum(), q.sum() + 0.05]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, level = max(0.1, slope + move[0]), level + move[1]
    return Toxicity(model.table, model.shift, float(slope), float(level))


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, each: int = 1500, longest: int = 20_000) -> Toxicity:
    """A model learned from up to `each` labelled texts of either class, without the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", folds, held_out, each, longest)
    if sample["y"].nunique() < 2:
        return Toxicity(np.zeros(64**3, np.float32), -1.0, 1.0, 0.0)
    return train(sample["text"].tolist(), sample["y"].to_numpy())


def score_toxicity(docs: DataFrame, model: Toxicity, folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """docs with held_out, score (0 to 1, higher: label 1 likelier) and predicted, for every row.

    Whole texts are scored by their worst word; null texts and texts without words score as a text
    with no likeness to any landmark. A null doc_id is not held out. Columns of docs named like the new
    ones are replaced; all others stay; equal rows get equal scores; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    key = model.table.tobytes()[:65536] + repr((model.shift, model.slope, float(model.table.sum()))).encode()

    @F.pandas_udf("double")
    def score(texts):
        tox = held.value
        known = _MEMO.get(key)
        if known is None or len(known) > REMEMBERED:
            _MEMO.clear()
            known = _MEMO[key] = {}
        worst = np.full(len(texts), tox.shift)
        for i in range(0, len(texts), 200):
            bags = [units(t) if t else set() for t in texts.iloc[i : i + 200]]
            new = [w for w in set().union(*bags) if w not in known]
            known.update(zip(new, tox.decide(new).tolist()))
            worst[i : i + 200] = [max(map(known.__getitem__, bag)) if bag else tox.shift for bag in bags]
        return type(texts)(tox.probability(worst))

    out = docs.drop("held_out", "score", "predicted").withColumn("score", score(F.col("text")))
    fold = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
    return out.withColumn("held_out", fold).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
