"""Readers and writers: manifests, lyric files, song lists, lexicons, datasets, vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .json_array import read_elements
from .json_sink import JsonSink
from .lexicon_store import load_buckets, override_words, save_buckets

__all__ = ["load_buckets", "load_lexicon", "load_vocab", "override_words", "pair_by_stem", "parse_song_list", "read_elements", "read_lexicon", "read_lyrics_corpus", "read_manifest", "save_buckets", "save_lexicon", "save_vocab", "write_dataset"]

ENTRY = "audio_path string, audio string, audio_file string, text string, lyrics string, transcript_file string, duration double, duration_seconds double, phonemes string, artist string, song string, song_title string, genre string, has_adlibs boolean, id string, source_id string, augmentation string, challenge_tags array<string>, tags array<string>, alignment_score double, chunk_index int, start double, `end` double, original_sample_id string, word_count int, metadata struct<artist:string,song:string,duration_seconds:double,word_count:int>"


def read_manifest(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Rows of a JSON manifest: an envelope with entries, samples, segments or augmented_samples, or a bare list.

    Aliases of a field are merged, nested metadata stand in for missing flat fields, and a missing
    has_adlibs is false. Files are divided among tasks, whatever their size.
    """
    entry = F.from_json("element", ENTRY)
    rows = read_elements(spark, path).select(entry.alias("e")).filter("e is not null").select("e.*")
    merged = {
        "audio_path": ("audio_path", "audio", "audio_file"), "text": ("text", "lyrics"), "duration": ("duration", "duration_seconds", "metadata.duration_seconds"),
        "artist": ("artist", "metadata.artist"), "song": ("song", "song_title", "metadata.song"), "word_count": ("word_count", "metadata.word_count"), "tags": ("tags", "challenge_tags"),
    }
    kept = ("id", "transcript_file", "phonemes", "genre", "source_id", "augmentation", "alignment_score", "chunk_index", "start", "end", "original_sample_id")
    return rows.select(*(F.coalesce(*cols).alias(n) for n, cols in merged.items()), *kept, F.coalesce("has_adlibs", F.lit(False)).alias("has_adlibs"))


def read_lyrics_corpus(spark: SparkSession, path: str, collapse: bool = False) -> DataFrame:
    """(sample_id, text) of every .txt file below a folder; the id is the file's stem."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    text = F.trim(F.regexp_replace("value", r"(?U)\s+", " ")) if collapse else F.col("value")
    return raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("sample_id"), text.alias("text"))


def _stem(path: str):
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def pair_by_stem(audio: DataFrame, texts: DataFrame, extensions: Sequence[str] = ("wav", "mp3", "flac", "m4a", "ogg"), audio_path: str = "audio_path", text_path: str = "text_path") -> tuple[DataFrame, DataFrame]:
    """(pairs, unmatched): files of either side with the same stem; audio files by allowed extension."""
    a = audio.filter(F.lower(F.regexp_extract(audio_path, r"\.([^./\\]*)$", 1)).isin(list(extensions))).withColumn("stem", _stem(audio_path))
    t = texts.withColumn("stem", _stem(text_path))
    lost = a.join(t, "stem", "left_anti").select("stem", F.lit("audio").alias("side"))
    return a.join(t, "stem"), lost.union(t.join(a, "stem", "left_anti").select("stem", F.lit("text").alias("side")))


def parse_song_list(lines: DataFrame, default_tags: Sequence[str] = ("heavy_slang",), line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(requests, rejects) of lines `artist - song | tag tag`; empty lines and comments are skipped."""
    used = lines.withColumn("_l", F.trim(line)).filter((F.col("_l") != "") & ~F.col("_l").startswith("#"))
    halves, names = F.split("_l", r"\|", 2), F.split(F.trim(F.split("_l", r"\|", 2)[0]), " - ", 2)
    tags = F.filter(F.split(F.trim(F.get(halves, F.lit(1))), r"\s+"), lambda x: x != "")
    parsed = used.withColumn("_n", names).withColumn("_t", tags)
    good = parsed.filter(F.size("_n") == 2).select(*(c for c in lines.columns if c != line), F.trim(F.col("_n")[0]).alias("artist"), F.trim(F.col("_n")[1]).alias("song"), F.when(F.size("_t") > 0, F.col("_t")).otherwise(F.array(*(F.lit(t) for t in default_tags))).alias("tags"))
    return good, parsed.filter(F.size("_n") != 2).select(*lines.columns)


def read_lexicon(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Entries of word maps in JSON; a later file's entry replaces an earlier one's."""
    entry = "struct<canonical:array<string>,variants:array<array<string>>,definition:string,examples:array<string>>"
    every = None
    for i, path in enumerate(paths):
        raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("word", "e")).select(F.lit(i).alias("_source"), "word", "e.*")
        every = raw if every is None else every.union(raw)
    last = Window.partitionBy("word").orderBy(F.desc("_source"))
    return every.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_source")


#: Splits that are written as files of their own at most.
SPLITS = 1000


def write_dataset(df: DataFrame, path: str, fmt: str = "json", split: str | None = None) -> None:
    """The dataset as JSON lines or Parquet, in folders by split where it has one, or as one JSON array.

    `array` writes one file, `path`, or with a split one file `path/<split>.json` for each, at most SPLITS of
    them; `lines` writes a folder of JSON lines. Both appear at once, in the rows' order, after all tasks
    have ended, whatever attempts failed before. An array's bytes go through one process, piece by piece.
    """
    if fmt in ("array", "lines"):
        df.sparkSession.dataSource.register(JsonSink)
        if split is None:
            df.write.format(JsonSink.name()).mode("overwrite").option("layout", fmt).save(path)
            return
        values = [r[0] for r in df.select(split).distinct().limit(SPLITS + 1).collect()]
        if len(values) > SPLITS:
            raise ValueError(f"more than {SPLITS} splits")
        for value in values:
            write_dataset(df.filter(F.col(split).eqNullSafe(F.lit(value))).drop(split), f"{path.rstrip('/')}/{value}.json" if fmt == "array" else f"{path.rstrip('/')}/{value}", fmt)
        return
    writer = df.write.mode("overwrite")
    (writer.partitionBy(split) if split else writer).format(fmt).save(path)


def save_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int, token string").parquet(path)


def save_lexicon(lexicon: DataFrame, path: str) -> None:
    """One JSON object by word a line, as read_lexicon's map form."""
    entry = F.struct("canonical", "variants", "definition", "examples")
    lexicon.select(F.to_json(F.map_from_entries(F.array(F.struct("word", entry)))).alias("value")).write.mode("overwrite").text(path)


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    entry = "struct<canonical:array<string>,variants:array<array<string>>,definition:string,examples:array<string>>"
    return spark.read.text(path).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("word", "e")).select("word", "e.*")
