"""Curation of segments and manifests: audits, filters, windows, alignment, splits and plans."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyricspark.functions.clean import metadata_flags
from lyricspark.functions.constants import AUDIT_STOPWORDS, AUGMENTATIONS, STOPWORDS
from lyricspark.functions.signal import clipping_issues, format_checks, silence_issues
from lyricspark.functions.quality import alignment_score, combined_score, is_repetitive, word_jaccard
from lyricspark.functions.text import collapse_whitespace, words

from .ranking import global_rank, hash_order


# --- audits and filters -------------------------------------------------------------------------


def audit_metadata(segments: DataFrame, text: str = "text") -> DataFrame:
    """segments with issues: empty or short texts, and metadata flags."""
    size = F.char_length(F.trim(F.coalesce(F.col(text), F.lit(""))))
    own = F.filter(F.array(F.when(size == 0, F.lit("empty")), F.when((size > 0) & (size < 10), F.lit("short"))), lambda x: x.isNotNull())
    return segments.withColumn("issues", F.concat(own, metadata_flags(F.coalesce(F.col(text), F.lit("")))))


def audit_summary(audited: DataFrame) -> DataFrame:
    """Segments by issue; `contaminated` counts those with a metadata flag, `total` all."""
    flagged = F.size(F.array_except("issues", F.array(F.lit("empty"), F.lit("short")))) > 0
    names = F.concat("issues", F.array(F.lit("total")), F.when(flagged, F.array(F.lit("contaminated"))).otherwise(F.array().cast("array<string>")))
    return audited.select(F.explode(names).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def contaminated_examples(audited: DataFrame, ids: Sequence[str], k: int = 20) -> DataFrame:
    """The first k segments with a metadata flag."""
    return audited.filter(F.size(F.array_except("issues", F.array(F.lit("empty"), F.lit("short")))) > 0).orderBy(*ids).limit(k)


def audit_alignment(segments: DataFrame, predictions: DataFrame, key: str, text: str = "text") -> DataFrame:
    """segments with overlap (3 decimals) and status by the unrounded score: good, marginal, bad, or missing."""
    joined = segments.join(predictions.select(key, "prediction"), key, "left")
    score = word_jaccard(F.col("prediction"), F.col(text), AUDIT_STOPWORDS)
    status = F.when(F.col("prediction").isNull(), "missing").when(score > 0.1, "good").when(score < 0.05, "bad").otherwise("marginal")
    return joined.withColumn("overlap", F.when(F.col("prediction").isNotNull(), F.bround(score, 3))).withColumn("status", status)


def sample_segments(segments: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    return segments.orderBy(hash_order(id_col, seed), id_col).limit(n)


def quality_filter(segments: DataFrame, predictions: DataFrame, key: str, threshold: float = 0.08, text: str = "text") -> DataFrame:
    """segments with score and status: missing, empty_lyrics, good or bad; and whether the prediction repeats itself."""
    joined = segments.join(predictions.select(key, "prediction"), key, "left")
    joined = joined.withColumn("repetitive", F.coalesce(is_repetitive(F.col("prediction")), F.lit(False)))
    scored = joined.withColumn("score", combined_score(F.col("prediction"), F.col(text), F.col("repetitive")))
    status = F.when(F.col("prediction").isNull(), "missing").when(F.trim(F.col(text)) == "", "empty_lyrics").when(F.col("score") >= threshold, "good").otherwise("bad")
    return scored.withColumn("status", status).select(*joined.columns[:-1], "score", "status", "repetitive")


def filter_summary(filtered: DataFrame) -> DataFrame:
    out = filtered.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("missing", "empty_lyrics", "good", "bad")), F.count_if("repetitive").alias("repetitive"))
    return out.withColumn("survival_rate", F.col("good") / F.greatest(F.col("good") + F.col("bad"), F.lit(1)))


def filter_examples(filtered: DataFrame, ids: Sequence[str], worst: int = 20, best: int = 10) -> DataFrame:
    bad = filtered.filter("status = 'bad'").orderBy("score", *ids).limit(worst)
    return bad.unionByName(filtered.filter("status = 'good'").orderBy(F.desc("score"), *ids).limit(best))


def pending_predictions(segments: DataFrame, cache: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Segments with a text that have no prediction yet, or one that failed."""
    done = cache.filter(~F.coalesce(F.col("prediction").startswith("[ERROR"), F.lit(True))).select(key)
    return segments.filter(F.trim(F.col(text)) != "").join(done, key, "left_anti")


def remove_bad(segments: DataFrame, *bad: DataFrame, key: str) -> DataFrame:
    every = bad[0].select(key)
    for b in bad[1:]:
        every = every.union(b.select(key))
    return segments.join(every.distinct(), key, "left_anti")


def removal_report(segments: DataFrame, *bad: DataFrame, key: str, score: str = "alignment_score", digits: int = 4) -> DataFrame:
    """One row: segments before and after the bad ones go, how many went, the mean score before and after, and the share that stays.

    Bad sets may overlap and name what isn't there. Means are of the scores that aren't null, 0 without
    any; the share of no segments is 0.
    """
    every = bad[0].select(key)
    for b in bad[1:]:
        every = every.union(b.select(key))
    marked = segments.join(every.distinct().withColumn("_bad", F.lit(True)), key, "left").withColumn("_stays", F.col("_bad").isNull())
    mean = lambda c: F.bround(F.coalesce(F.avg(c), F.lit(0.0)), digits)
    out = marked.agg(
        F.count("*").alias("segments_before"), F.count_if("_stays").alias("segments_after"), F.count_if(~F.col("_stays")).alias("removed"),
        mean(F.col(score)).alias("mean_before"), mean(F.when(F.col("_stays"), F.col(score))).alias("mean_after"),
    )
    return out.withColumn("survival_rate", F.bround(F.col("segments_after") / F.greatest("segments_before", F.lit(1)), digits))


# --- windows and alignment of chunks ------------------------------------------------------------


def chunk_windows(df: DataFrame, duration: str, length: float = 30.0, overlap: float = 5.0, least: float = 10.0) -> DataFrame:
    """df with chunk_index, start and end: windows every length - overlap, until the first one under `least` that isn't the first."""
    step = length - overlap
    n = F.when(F.col(duration) > 0, F.greatest(F.lit(1), F.floor((F.col(duration) - least) / step) + 1)).otherwise(0).cast("int")
    out = df.withColumn("chunk_index", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    return out.withColumn("start", F.col("chunk_index") * step).withColumn("end", F.least(F.col("start") + length, F.col(duration)))


def full_windows(df: DataFrame, duration: str, length: float = 10.0, most: int = 5) -> DataFrame:
    """Back-to-back windows, only full ones, `most` of them at most."""
    n = F.least(F.floor(F.col(duration) / length), F.lit(most)).cast("int")
    out = df.withColumn("chunk_index", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    return out.withColumn("start", F.col("chunk_index") * length).withColumn("end", (F.col("chunk_index") + 1) * length)


class _Stretches:
    """The distinct items of stretches of a sequence of numbers, of which `counted` says which count."""

    def __init__(self, items: np.ndarray, counted: np.ndarray) -> None:
        self.items, self.counted = items, counted
        #: Where the same item stood last.
        order = np.argsort(items, kind="stable")
        again = np.diff(items[order], prepend=-1) == 0
        self.before = np.full(len(items), -1)
        self.before[order[again]] = order[np.flatnonzero(again) - 1]

    def shares(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, most: int) -> np.ndarray:
        """For stretches from low to high, both rising, how many of their items are wanted, over all of theirs and the `most` wanted ones together; wanted tells it of each item of the sequence from the first low to the last high."""
        if not most or not len(wanted):
            return np.zeros(len(low))
        first = low[0]
        at = np.arange(first, first + len(wanted))
        # an item counts where it first stands in a stretch: from the first stretch that starts behind its last place and reaches it, to the last one that starts at it
        begin = np.maximum(np.searchsorted(low, self.before[at], "right"), np.searchsorted(high, at, "right"))
        end = np.searchsorted(low, at, "right")
        begin = np.minimum(begin, end)

        def distinct(of: np.ndarray) -> np.ndarray:
            n = len(low) + 1
            return np.cumsum(np.bincount(begin[of], minlength=n) - np.bincount(end[of], minlength=n))[:-1]

        counted = self.counted[at]
        both, every = distinct(counted & wanted), distinct(counted)
        return np.where(every > 0, both / (most + every - both), 0.0)


def align_song(chunks: list[str], lyrics: str, length: float = 30.0, overlap: float = 5.0) -> list[tuple[str, float]]:
    """(text, score) for each transcript in order: the best stretch of the lyrics near a cursor that moves forward.

    Stretches near the end of the lyrics are shorter than the others.
    """
    stop, ratio = frozenset(STOPWORDS), (length - overlap) / length
    plain = lambda t: re.sub(r"[^a-z0-9\s]", "", t.lower())
    tokens = lyrics.split()
    # a token has one plain word or none
    bare = plain(" ".join(tokens)).split(" ") if tokens else []
    flat = [w for w in bare if w]
    at = np.concatenate([[0], np.cumsum([w != "" for w in bare], dtype=np.int64)])
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in flat), np.int64, len(flat))
    known = len(number) + 1
    single = _Stretches(ids, np.fromiter((w not in stop for w in flat), bool, len(flat)))
    two = ids[:-1] * known + ids[1:]
    double = _Stretches(two, np.ones(len(two), bool))
    n, cursor, out = len(tokens), 0, []
    for chunk in chunks:
        heard = plain(chunk or "").split()
        if not heard:
            out.append(("", 0.0))
            cursor = min(n, cursor + max(1, int(max(1, n / max(1, len(chunks))) * ratio)))
            continue
        window = max(5, min(len(heard), n))
        first, last = max(0, cursor - 15), min(n - 1, cursor + max(window, 25))
        best, start = -1.0, min(cursor, max(0, n - window))
        if first <= last:
            words_, pairs_ = set(heard) - stop, set(zip(heard, heard[1:]))
            starts = np.arange(first, last + 1)
            low, high = at[starts], at[np.minimum(starts + window, n)]
            part = ids[low[0] : high[-1]]
            of = [number.get(w, known - 1) for w in heard]
            coded = np.unique([p * known + q for p, q in zip(of, of[1:]) if p < known - 1 and q < known - 1] or [-1])
            has = np.zeros(known, bool)
            has[of] = True
            has[known - 1] = False
            ahead = np.maximum(low, high - 1)
            pairs_here = two[low[0] : ahead[-1]]
            found = coded[np.minimum(np.searchsorted(coded, pairs_here), len(coded) - 1)] == pairs_here
            score = 0.4 * single.shares(low, high, has[part], len(words_)) + 0.6 * double.shares(low, ahead, found, len(pairs_))
            start = int(starts[np.argmax(score)])
            best = float(score.max())
        out.append((" ".join(tokens[start : start + window]), round(best, 4) if n else 0.0))
        cursor = min(start + max(1, int(window * ratio)), n)
    return out


def align_chunks(chunks: DataFrame, lyrics: DataFrame, song: str, length: float = 30.0, overlap: float = 5.0) -> DataFrame:
    """(song, chunk_index, text, score): chunks(song, chunk_index, transcript) against lyrics(song, lyrics), one song in one row."""

    @F.arrow_udf("array<struct<text:string,score:double>>")
    def run(transcripts: pa.Array, texts: pa.Array) -> pa.Array:
        # song by song, so that few are Python's at a time
        found = (align_song(c.as_py(), t.as_py() or "", length, overlap) for c, t in zip(transcripts, texts))
        kind = pa.list_(pa.struct([("text", pa.string()), ("score", pa.float64())]))
        return pa.array(([{"text": t, "score": s} for t, s in song_] for song_ in found), kind)

    both = chunks.select(song, F.struct(F.col("chunk_index").cast("int").alias("chunk_index"), F.coalesce("transcript", F.lit("")).alias("transcript")).alias("c"), F.lit(None).cast("string").alias("lyrics"))
    both = both.unionByName(lyrics.select(song, "lyrics"), allowMissingColumns=True)
    songs = both.groupBy(song).agg(F.array_sort(F.collect_list("c")).alias("c"), F.first("lyrics", ignorenulls=True).alias("lyrics")).filter(F.size("c") > 0)
    aligned = songs.select(song, F.col("c.chunk_index").alias("n"), run(F.col("c.transcript"), F.col("lyrics")).alias("a"))
    return aligned.select(song, F.explode(F.arrays_zip("n", "a")).alias("r")).select(song, F.col("r.n").alias("chunk_index"), "r.a.text", "r.a.score")


def keep_short(df: DataFrame, duration: str, prediction: str, lyrics: str, length: float = 30.0) -> DataFrame:
    """Samples of at most length + 5 seconds, whole, with their score against all lyrics."""
    return df.filter(F.col(duration) <= length + 5).withColumn("score", alignment_score(F.col(prediction), F.col(lyrics)))


def segment_summary(segments: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    return segments.groupBy(*keys).agg(F.count("*").alias("segments"), F.bround(F.avg(score), 4).alias("mean_score"), F.count_if(F.col(score) >= 0.12).alias("aligned"))


def resume_pending(samples: DataFrame, done: DataFrame, key: str, done_key: str) -> DataFrame:
    return samples.join(done.select(F.col(done_key).alias(key)).distinct(), key, "left_anti")


# --- requests, manifests, splits ----------------------------------------------------------------


def dedup_requests(requests: DataFrame, manifest: DataFrame, order: Sequence[str]) -> DataFrame:
    """Requests not in the manifest and first of their batch, by artist and song in lower case."""
    pair = (F.lower("artist"), F.lower("song"))
    first = requests.withColumn("_n", F.row_number().over(Window.partitionBy(*pair).orderBy(*order))).filter("_n = 1").drop("_n")
    known = manifest.select(pair[0].alias("_a"), pair[1].alias("_s")).distinct()
    return first.join(known, (F.lower(first["artist"]) == F.col("_a")) & (F.lower(first["song"]) == F.col("_s")), "left_anti")


def collectable(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.char_length(F.trim(F.col(text))) >= 20).withColumn("word_count", F.size(words(F.col(text))))


def sample_id(artist: Column, song: Column, salt: str = "") -> Column:
    return F.concat(F.lit("train_"), F.substring(F.md5(F.concat(artist, F.lit("_"), song, F.lit(salt))), 1, 6))


def collection_status(samples: DataFrame, target: int = 50) -> DataFrame:
    out = samples.agg(F.count("*").alias("samples"), F.bround(F.sum("duration_seconds") / 60, 1).alias("minutes"), F.sum("word_count").alias("words"))
    return out.withColumn("progress", F.col("samples") / target)


def counts_by(df: DataFrame, column: Column, name: str) -> DataFrame:
    return df.select(column.alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def filter_duration(df: DataFrame, least: float, most: float, duration: str = "duration") -> DataFrame:
    return df.filter(F.col(duration).between(least, most))


def filter_artist(df: DataFrame, part: str, artist: str = "artist") -> DataFrame:
    return df.filter(F.contains(F.lower(artist), F.lit(part.lower())))


def manifest_stats(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    d = F.col("duration")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count("*").alias("entries"), zero(F.sum(d) / 3600).alias("hours"), zero(F.avg(d)).alias("avg_duration"), zero(F.min(d)).alias("min_duration"), zero(F.max(d)).alias("max_duration"),
        F.count_distinct(F.nullif(F.col("artist"), F.lit(""))).alias("artists"),
    )


def shuffle(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Rows with their position in a seeded random order."""
    return global_rank(df, hash_order(id_col, seed), [id_col], "position")


def split_rows(df: DataFrame, id_col: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """df with split: train, val or test, cut exactly by position in a seeded random order."""
    if abs(sum(ratios) - 1) > 0.001:
        raise ValueError(f"ratios must sum to 1, not {sum(ratios)}")
    ranked = global_rank(df, hash_order(id_col, seed), [id_col], "_rank")
    total = df.agg(F.count("*").alias("_total"))
    ranked = ranked.crossJoin(F.broadcast(total))
    first, second = F.floor(F.col("_total") * ratios[0]), F.floor(F.col("_total") * (ratios[0] + ratios[1]))
    return ranked.withColumn("split", F.when(F.col("_rank") <= first, "train").when(F.col("_rank") <= second, "val").otherwise("test")).drop("_rank", "_total")


def split_groups(segments: DataFrame, group: str, val: float = 0.15, seed: int = 42, text: str = "text") -> DataFrame:
    """segments with split: whole groups to one side; rows with a text under 5 characters are left out."""
    usable = segments.filter(F.char_length(F.trim(F.col(text))) >= 5)
    groups = global_rank(usable.select(group).distinct(), hash_order(group, seed), [group], "_rank")
    total = usable.select(group).agg(F.count_distinct(group).alias("_total"))
    sides = groups.crossJoin(F.broadcast(total)).select(group, F.when(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_total") * val)), "val").otherwise("train").alias("split"))
    return usable.join(sides, group)


def exclude_leaks(augmented: DataFrame, val: DataFrame, source: str = "source_id", key: str = "id") -> DataFrame:
    return augmented.join(val.select(F.col(key).alias(source)).distinct(), source, "left_anti")


def augmentation_plan(samples: DataFrame, configs: Iterable[tuple[str, str]] = AUGMENTATIONS, multiplier: int | None = None) -> DataFrame:
    """Each sample with each configuration, or the first `multiplier` of them."""
    chosen = list(configs)[:multiplier]
    config = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind")) for n, k in chosen)))
    out = samples.withColumn("_c", config)
    name = F.concat(F.lit("aug_"), F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("_"), F.col("_c.name"))), 1, 6), F.lit("_"), F.col("_c.name"))
    return out.select(name.alias("id"), "artist", F.concat("song", F.lit(" ["), "_c.name", F.lit("]")).alias("song"), F.col("_c.name").alias("augmentation"), F.col("id").alias("source_id"), F.lit(True).alias("augmented"))


def load_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts trimmed and collapsed; empty ones dropped."""
    return df.withColumn(text, collapse_whitespace(F.col(text))).filter(F.col(text) != "")


def pick_best_match(requests: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Per request the first candidate of the best tier: exact title and artist, title within and artist, artist within, any.

    requests(key, title, artist), candidates(key, rank, c_title, c_artist).
    """
    j = requests.join(candidates, key)
    t, a, ct, ca = (F.lower(c) for c in ("title", "artist", "c_title", "c_artist"))
    artist = F.contains(ca, a) | F.contains(a, ca)
    tier = F.when((t == ct) & artist, 1).when((F.contains(ct, t) | F.contains(t, ct)) & artist, 2).when(artist, 3).otherwise(4)
    order = Window.partitionBy(key).orderBy("tier", "rank")
    return j.withColumn("tier", tier).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def validate_audio(df: DataFrame, samples: str = "samples", rate: str = "rate", shortest: float = 0.5, longest: float = 30.0, least_rate: int = 16000, window: int = 1600, quiet: float = 0.01, silent_share: float = 0.5, clip_level: float = 0.99) -> DataFrame:
    """df with issues and is_valid: format checks, and, only where these find nothing, silence and clipping."""
    x = F.col(samples)
    out = df.withColumn("_format", format_checks(x, F.col(rate), shortest, longest, least_rate))
    fine = F.size("_format") == 0
    # clips that fail already aren't looked into
    out = out.withColumn("_silence", silence_issues(F.when(fine, x), window, quiet, silent_share))
    out = out.withColumn("issues", F.when(fine, F.concat("_silence", clipping_issues(x, clip_level))).otherwise(F.col("_format")))
    return out.withColumn("is_valid", F.size("issues") == 0).drop("_format", "_silence")


def validation_summary(checked: DataFrame, issues: str = "issues") -> DataFrame:
    out = checked.agg(F.count("*").alias("total"), F.count_if(F.size(issues) == 0).alias("valid"), F.count_if(F.size(issues) > 0).alias("invalid"))
    return out.withColumn("ratio", F.col("valid") / F.greatest("total", F.lit(1)))


def issue_counts(checked: DataFrame, issues: str = "issues") -> DataFrame:
    return checked.select(F.explode(issues).alias("i")).groupBy(F.split("i", ":")[0].alias("issue")).agg(F.count("*").alias("n"))


def lexicon_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), "word string, canonical array<string>, variants array<array<string>>, definition string, examples array<string>")
