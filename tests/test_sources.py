"""Manifests read by many tasks and written at once, and lexicons in buckets."""

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lyricspark.sources import load_buckets, override_words, read_elements, read_manifest, save_buckets, write_dataset


def random_value(rng, depth=0):
    kind = rng.random()
    if kind < 0.4 or depth > 2:
        return "".join(rng.choice('a{}[]"\\,: é\n') for _ in range(rng.randint(0, 8)))
    if kind < 0.6:
        return rng.randint(0, 99)
    if kind < 0.8:
        return {random_value(rng, 3) if rng.random() < 0.5 else "samples": random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def random_manifest(rng):
    """(manifest, elements that count)."""
    elements = [{"id": j, "x": random_value(rng), "metadata": random_value(rng)} for j in range(rng.randint(0, 6))]
    if rng.random() < 0.4:
        return elements, elements
    out = {}
    if rng.random() < 0.5:
        out["failed"] = [{"no": 1}]
    if rng.random() < 0.5:
        out["meta"] = {"samples": [{"deep": 1}], "q": '}"{', "entries": "["}
    out[rng.choice(["samples", "segments"])] = elements
    if rng.random() < 0.3:
        out["entries"] = [{"id": "e", "y": "}"}]
    if rng.random() < 0.5:
        out["definitions"] = {"a": {"b": 1}}
    return out, next(out[k] for k in ("entries", "samples", "segments") if k in out)


@pytest.mark.parametrize("size", ["40", "300", "1m"])
def test_elements_at_any_split(spark, tmp_path, size):
    rng, expected = random.Random(size), {}
    for i in range(16):
        manifest, elements = random_manifest(rng)
        text = json.dumps(manifest, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n"])
        (tmp_path / f"{i}.json").write_text(text)
        expected[f"{i}.json"] = sorted(json.dumps(e, sort_keys=True) for e in elements)
    for name, text in (("empty", " "), ("number", "12"), ("none", ""), ("bare", "[]"), ("strings", '["{", "}"]')):
        (tmp_path / f"{name}.json").write_text(text)
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {}
        for r in read_elements(spark, str(tmp_path)).collect():
            got.setdefault(os.path.basename(r.file), []).append(json.dumps(json.loads(r.element), sort_keys=True))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in expected.items() if v}


def test_one_manifest_by_many_tasks(spark, tmp_path):
    rows = [{"id": str(i), "audio_file": f"{i}.wav", "lyrics": "la } la " * 20, "metadata": {"artist": f"A{i}", "duration_seconds": i}} for i in range(5000)]
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "samples": rows, "total": {"n": 5000}}))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        df = read_manifest(spark, str(tmp_path / "m.json")).withColumn("task", F.spark_partition_id())
        got = df.agg(F.count_distinct("task").alias("tasks"), F.count_distinct("id").alias("ids"), F.count("*").alias("n"), F.sum("duration").alias("d"), F.count_if(F.col("artist") == F.concat(F.lit("A"), "id")).alias("same")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got.tasks > 10 and (got.ids, got.n, got.d, got.same) == (5000, 5000, 5000 * 4999 / 2, 5000)


def test_dataset_as_an_array(spark, tmp_path):
    df = spark.range(100).repartition(5).select(F.col("id").cast("string").alias("id"), F.concat(F.lit('x.wav}"'), "id").alias("audio_path"), F.lit("é\n{").alias("text"), F.array(F.lit("a"), F.lit(None)).alias("tags"), F.when(F.col("id") < 50, F.lit(1.5)).alias("duration"), F.when(F.col("id") % 10 == 0, "validation").otherwise("train").alias("split"))
    path = str(tmp_path / "out" / "m.json")
    for _ in range(2):
        write_dataset(df.drop("split"), path, "array")
    assert len(json.load(open(path))) == 100 and os.listdir(tmp_path / "out") == ["m.json"]
    back = read_manifest(spark, path).select("id", "audio_path", "text", "tags", "duration")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select(*back.columns).collect()))
    write_dataset(df, str(tmp_path / "splits"), "array", split="split")
    assert {n: len(json.load(open(tmp_path / "splits" / n))) for n in os.listdir(tmp_path / "splits")} == {"train.json": 90, "validation.json": 10}
    write_dataset(df.limit(0).drop("split"), path, "array")
    assert json.load(open(path)) == []
    write_dataset(df.drop("split"), str(tmp_path / "lines"), "lines")
    assert spark.read.json(str(tmp_path / "lines")).count() == 100


_FAILING = """
import os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from lyricspark.sources import write_dataset
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()

always = sys.argv[2] == "always"

def rows(batches):
    context = TaskContext.get()
    for n, batch in enumerate(batches):
        yield batch
        if context.partitionId() == 1 and (context.attemptNumber() == 0 or always):
            raise RuntimeError("this attempt fails")

spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
write_dataset(spark.range(0, 90, 1, 3).mapInArrow(rows, "id long"), sys.argv[1], "array")
"""


@pytest.mark.parametrize("fails", ["once", "always"])
def test_dataset_after_failed_attempts(tmp_path, fails):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "out").mkdir()
    path = tmp_path / "out" / "m.json"
    path.write_text("[]")
    run = subprocess.run([sys.executable, "-c", _FAILING, str(path), fails], env=os.environ | {"PYTHONPATH": root}, capture_output=True, timeout=240)
    assert (run.returncode == 0) == (fails == "once")
    assert "this attempt fails" in run.stderr.decode()
    # all rows once, in order; or what was there before
    assert [r["id"] for r in json.loads(path.read_text())] == (list(range(90)) if fails == "once" else [])
    assert os.listdir(tmp_path / "out") == ["m.json"]


def test_an_override_rewrites_one_bucket(spark, tmp_path):
    path = str(tmp_path / "lexicon")
    lexicon = spark.range(300).select(F.concat(F.lit("Word"), "id").alias("word"), F.array(F.col("id").cast("string")).alias("canonical"), F.lit("old").alias("definition"))
    save_buckets(lexicon, path, 16)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}
    before = files()
    new = spark.createDataFrame([("word7", ["x"], "new"), ("WORD7", ["y"], "newer")], lexicon.schema)
    touched = override_words(spark, path, new)
    after = files()
    changed = {os.path.dirname(f) for f, _ in set(before.items()) ^ set(after.items())}
    assert len(touched) == 1 and [os.path.basename(d) for d in changed] == [f"bucket={touched[0]}"]
    spark.catalog.refreshByPath(path)
    got = {r.word: r.definition for r in load_buckets(spark, path).collect()}
    assert len(got) == 300 and got.pop("word7") == "new" and set(got.values()) == {"old"}
    override_words(spark, path, spark.createDataFrame([("brand", ["b"], "new")], lexicon.schema))
    assert override_words(spark, path, new.limit(0)) == []
    assert load_buckets(spark, path).count() == 301
    plan = load_buckets(spark, path).filter("bucket = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_an_override_may_keep_several_entries_of_a_word(spark, tmp_path):
    path = str(tmp_path / "lexicon")
    rows = [("As", "1"), ("as", "1"), ("ß", "1"), ("stays", "1")]
    save_buckets(spark.createDataFrame(rows, "word string, definition string"), path, 4)
    override_words(spark, path, spark.createDataFrame([("AS", "new"), ("AS", "new"), ("ẞ", "new")], "word string, definition string"), several=True)
    got = sorted((r.word, r.definition) for r in load_buckets(spark, path).collect())
    assert got == [("AS", "new"), ("AS", "new"), ("stays", "1"), ("ẞ", "new")]
