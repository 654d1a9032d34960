"""Steps that are worked out by batch, against plain forms of the same."""

import random
from functools import reduce
from operator import add

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lyricspark.functions import align, match, metrics, quality, rules, text
from lyricspark.operators import corpus, vocab
from lyricspark.streaming import stateful


def heard(words):
    """Words dropped, turned round and doubled, as in the queries' pairs."""
    return [y for i, w in enumerate(words) for y in ([] if i % 7 == 6 else [w[::-1]] if i % 5 == 4 else [w, w] if i % 11 == 10 else [w])]


def places(ts, rs):
    sides = align._word_sides(*(pa.array(x, pa.list_(pa.string())) for x in (ts, rs)))
    out = [[] for _ in ts]
    for n, i, j in zip(*(x.tolist() for x in align._diff_places(*sides))):
        out[n].append((ts[n][i] if i >= 0 else None, rs[n][j] if j >= 0 else None))
    return out


def test_pairs_are_difflibs(monkeypatch):
    some = random.Random(3)
    ts, rs = [["a"], None, [], ["x", "x", "a"]], [None, ["a"], [], ["x", "a", "x", "a"]]
    for _ in range(400):
        # words beyond one in a hundred of 200 or more are too frequent to start a block, yet extend it
        ref = [f"w{some.randrange(some.choice([2, 30, 3000]))}" for _ in range(some.choice([1, 5, 60, 199, 200, 450]))]
        rs.append(ref), ts.append(heard(ref) if some.random() < 0.7 else some.sample(ref, len(ref) // 2))
    want = [align.diff_pairs(t or [], r or []) for t, r in zip(ts, rs)]
    assert places(ts, rs) == want
    # pairs with too many places are left to difflib, and few fit into a part
    monkeypatch.setattr(align, "PLACES", 300), monkeypatch.setattr(align, "PLACES_TOGETHER", 100)
    assert places(ts, rs) == want


def test_matched_words_are_scored_as_pairs(spark):
    words = "bands pants runnin running thang thing xyz gnih the a dawgg dawg über".split()
    some = random.Random(4)
    rows = [(some.choices(words, k=some.randrange(9)), some.choices(words, k=some.randrange(9))) for _ in range(60)]
    df = spark.createDataFrame(rows, "t array<string>, r array<string>")
    for prefer in (True, False):
        out = df.select("t", "r", match.match_alignments(F.col("t"), F.col("r"), 0.4, prefer).alias("a"), match.match_words(F.col("t"), F.col("r"), 0.4, prefer).alias("m"))
        pairs = F.col("p.trans"), F.col("p.ref")
        one = metrics.score_pair(*pairs, metrics.phonetic_similarity(*pairs), 0.4, prefer)
        assert out.select(F.explode("a").alias("p")).filter(one["chosen"].eqNullSafe(F.col("p.s.chosen")) & (one["confidence"] == F.col("p.s.confidence")) & (one["source"] == F.col("p.s.source"))).count() == out.select(F.explode("a")).count() > 100
        for r in out.collect():
            both = bool(r.t and r.r)
            assert [(p.trans, p.ref) for p in r.a] == (align.diff_pairs(r.t, r.r) if both else [])
            chosen = [p.s.chosen for p in r.a] if both else r.t or r.r
            assert (r.m.matched, r.m.total, r.m.sure) == (" ".join(chosen), len(r.a), reduce(add, (p.s.confidence for p in r.a), 0.0))
            assert [r.m.exact, r.m.corrections, r.m.phonetic] == [sum(p.s.source == s for p in r.a) for s in ("exact", "reference", "phonetic")]
            assert r.m.uncertain == sum(p.s.confidence < 0.6 for p in r.a)
            assert (r.m.before, r.m.after) == (align.distance(r.t, r.r), align.distance(chosen, r.r))


def test_phrase_rules_are_tried_where_their_texts_stand(spark):
    # a long s, a dotless i and a Kelvin sign match letters of the patterns; a rule may need what one before it put
    texts = ["IT'S MY WATCH, it's my", "pantſ up", "w\u0131ll it's my wıll", "got new pants, got new bands", "xpants up pants upx", "i \u212aeeping", "the rain that rain", "", None, "not because i got my pants", "well jam us well"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.trim(F.lower("text"))
    for p, r in rules.PHRASE_RULES:
        plain = F.regexp_replace(plain, f"(?iU){p}", r)
    got = df.select("text", plain.alias("want"), rules.apply_phrase_rules(F.col("text")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got] and sum(r.got != r.text for r in got) > 6
    own = [(r"rain|snow", "sun"), (r"(a)b+", "$1"), (r"\bx*yz", "q"), (r"\bmore", "\\1")]
    same = df.sparkSession.createDataFrame([("snow abb xyz yz more",)], "text string").select(rules.apply_phrase_rules(F.col("text"), own).alias("t"))
    assert same.first().t == "sun $1 q q \\1"


def test_changes_name_each_step(spark):
    df = spark.createDataFrame([("Going, WELL jam us well. these her gon na try\tüber",)], "text string")
    got = rules.correct_with_changes(df, aggressive=True).first()
    assert got.corrected == "goin', well jam up 12. these hoes gon' nigga try über" or got.corrected == df.select(rules.correct(F.col("text"), True)).first()[0]
    assert got.n_changes == len(got.changes) and got.changes[-1].startswith(("explicit: ", "slang: ")) and "dialect: going → goin'" in got.changes


def test_songs_are_aligned_by_row_whatever_their_keys(spark):
    chunks = spark.createDataFrame([("a", 1, "d e f g h"), ("a", 0, "a b c d e"), (None, 0, "x y"), ("lost", 0, "x"), ("a", 2, None)], "song string, chunk_index int, transcript string")
    lyrics = spark.createDataFrame([("a", "A, b c d e f - g h i"), (None, "x y"), ("unheard", "z")], "song string, lyrics string")
    got = {(r.song, r.chunk_index): (r.text, r.score) for r in corpus.align_chunks(chunks, lyrics, "song").collect()}
    want = corpus.align_song(["a b c d e", "d e f g h", ""], "A, b c d e f - g h i")
    assert [got["a", i] for i in range(3)] == want and want[0] == ("A, b c d e", 1.0)
    assert got[None, 0] == ("x y", 1.0) and got["lost", 0] == ("", 0.0) and len(got) == 5
    assert "ArrowEvalPython" in corpus.align_chunks(chunks, lyrics, "song")._jdf.queryExecution().toString()


def test_overlaps_are_those_of_sets(spark):
    some = random.Random(6)
    rows = [(some.choices("abcd the in".split() + ["a"] * 3, k=some.randrange(30)), some.choices("abc the".split() + ["é"], k=some.randrange(9))) for _ in range(150)]
    rows += [(None, ["a"]), (["a"], None), ([], []), (list("ab") * 5, list("ab"))]
    df = spark.createDataFrame(rows, "p array<string>, r array<string>")

    def share(x, y):
        return len(x & y) / len(x | y) if x and y else 0.0

    repeated = set()
    for r in df.select("p", "r", quality.overlaps(F.col("p"), F.col("r")).alias("o")).collect():
        if r.p is not None:
            grams = [" ".join(r.p[i : i + n]) for n in (2, 3, 4) for i in range(len(r.p) - n + 1)]
            assert r.o.repetitive == (len(r.p) >= 10 and any(grams.count(g) >= 5 for g in grams))
            repeated.add(r.o.repetitive)
        if r.p is None or r.r is None:
            assert r.o.words is None and r.o.bigrams is None
            continue
        x, y = (set(w) - set(quality.STOPWORDS) for w in (r.p, r.r))
        assert (r.o.words, r.o.bigrams) == (share(x, y), share(set(zip(r.p, r.p[1:])), set(zip(r.r, r.r[1:]))))
    assert repeated == {True, False}
    odd = "a\x0bB\u00a0c_\u2028d{z}`q/0:\x1f\U0001f600\U0010ffff~9 \t\x08k"
    got = spark.createDataFrame([(odd,)], "t string").select(text.normalize_ascii(F.col("t")), text.tokenize(F.col("t"), "ascii")).first()
    assert tuple(got) == ("a bcdzq09 k", ["a", "bcdzq09", "k"])


def test_running_means_of_slices(monkeypatch):
    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, to):
            self.held = to

    monkeypatch.setattr(stateful, "SLICE", 3)
    means = stateful.RunningMeans(("model",), "seq", ("wer",))
    means.sums, out, n, total, known = Value(), [], 0, 0.0, 0
    for batch in ([(4, 0.1), (1, None)], [(0, 0.7)]), ([(9, None), (7, 0.2), (8, 0.3), (6, 0.25)],):
        frames = [pd.DataFrame({"model": ["m"] * len(rows), "seq": [s for s, _ in rows], "wer": [v for _, v in rows]}) for rows in batch]
        out += [tuple(r) for f in means.handleInputRows(("m",), iter(frames), None) for r in f.astype(object).itertuples(index=False)]
    want = []
    for seq, v in [(0, 0.7), (1, None), (4, 0.1), (6, 0.25), (7, 0.2), (8, 0.3), (9, None)]:
        n, known, total = n + 1, known + (v is not None), total + (v or 0.0)
        want.append(("m", seq, n, total / known))
    assert out == want and means.sums.held == (n, known, total)


def test_look_ups_make_no_objects(spark):
    lists = pa.array([["b", "zz"], [], ["a"]]).slice(1)
    assert vocab._looked_up(lists, {"a": 7, "b": 8}, pa.string(), pa.int32(), 1).to_pylist() == [[], [7]]
    ids = pa.array([[8, None, 9], []], pa.list_(pa.int32()))
    assert vocab._looked_up(ids, {7: "a", 8: "b"}, pa.int64(), pa.string(), "<unk>").to_pylist() == [["b", "<unk>", "<unk>"], []]
    assert vocab._looked_up(ids, {}, pa.int64(), pa.string(), "<unk>").to_pylist() == [["<unk>"] * 3, []]
