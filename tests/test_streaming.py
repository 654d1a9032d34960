"""Streams over several micro-batches against batches over the same rows."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lyricspark.streaming import assemble_sessions, clean_stream, final_windows, indexed_chunks, running_rows, start_stream

EPOCH = datetime(2024, 1, 1)


def at(seconds):
    return EPOCH + timedelta(seconds=seconds)


def stream_of(spark, folder, batches, schema):
    """A stream that gets each list of rows as a micro-batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def answers(spark, tmp_path, stream):
    run = start_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    ended = run.awaitTermination(120)
    run.stop()
    assert ended
    return spark.read.parquet(f"file://{tmp_path}/out")


def counted(df):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_indexed_chunks(spark, tmp_path):
    rng, schema = random.Random(1), "session string, ts timestamp, value double, n int"
    rows = [(s, at(t + s_at), v, 1) for s, s_at in (("a", 0.25), ("b", 3), ("c", 100)) for t, v in [(rng.uniform(0, 31), rng.choice([1.5, None])) for _ in range(40)] + [(70.0, 2.0), (70.0, 2.0)]]
    rows += [(None, at(1), 1.0, 1), ("d", None, 1.0, 1), ("e", at(5), 1.0, 1)]
    rows.sort(key=lambda r: (r[1] or EPOCH, str(r[0])))
    # rows of a micro-batch in any order, and none later than the delay
    parts = [rows[:50], rows[50:90], rows[90:]]
    for p in parts:
        rng.shuffle(p)
    late = [("a", at(2), 5.0, 1)]
    stream = stream_of(spark, tmp_path / "in", [*parts, [("end", at(10_000), 0.0, 1)], late + [("end", at(20_000), 0.0, 1)]], schema)
    got = answers(spark, tmp_path, indexed_chunks(stream, "session", late="5 seconds")).filter("session <> 'end'")
    batch = indexed_chunks(spark.createDataFrame(rows, schema), "session")
    assert counted(got) == counted(batch) and got.count() > 20
    first = batch.filter("session = 'a' and chunk = 0").first()
    assert first.start_time == min(r[1] for r in rows if r[0] == "a") and (first.end_time - first.start_time).total_seconds() == 5
    # by hand: chunk i holds what lies in [4.5 i, 4.5 i + 5) after the session's start
    for s in "abce":
        times = [(r[1] - min(q[1] for q in rows if q[0] == s)).total_seconds() for r in rows if r[0] == s]
        expected = {i: n for i in range(60) if (n := sum(4.5 * i <= t < 4.5 * i + 5 for t in times))}
        assert {r.chunk: r.n for r in batch.filter(F.col("session") == s).collect()} == expected
    with pytest.raises(ValueError):
        indexed_chunks(batch, "session", overlap=6.0)


MESSAGES = "session string, seq long, type string, data string"


def test_sessions(spark, tmp_path):
    rng, batches, seq = random.Random(2), [], 0
    for _ in range(3):
        rows = []
        for _ in range(60):
            seq += 1
            rows.append((rng.choice(["s", "t", "ü"]), seq, rng.choice(["audio"] * 5 + ["transcribe", "clear", "ping", "end", "what", None]), rng.choice(["ab", "é", "", None])))
        rng.shuffle(rows)
        batches.append(rows)
    stream = assemble_sessions(stream_of(spark, tmp_path / "in", batches, MESSAGES), timeout_ms=None)
    got = counted(answers(spark, tmp_path, stream))
    assert got == counted(assemble_sessions(spark.createDataFrame([r for b in batches for r in b], MESSAGES)))
    buffers, expected = {}, Counter()
    for s, n, kind, data in (r for b in batches for r in sorted(b, key=lambda r: r[1])):
        held = buffers.get(s, "")
        if kind == "audio":
            buffers[s] = held + (data or "")
            answer = ("ack", "", len(buffers[s]))
        elif kind == "transcribe":
            answer = ("transcript", held, len(held)) if held else ("error", "no audio", 0)
        else:
            answer = {"clear": ("cleared", "", 0), "ping": ("pong", "", len(held)), "end": ("closed", "", len(held))}.get(kind, ("error", f"unknown type: {kind}", len(held)))
        if kind in ("transcribe", "clear", "end"):
            buffers[s] = ""
        expected[s, n, *answer] += 1
    assert got == expected


def test_a_session_expires(spark, tmp_path):
    stream = assemble_sessions(stream_of(spark, tmp_path / "in", [[("s", 1, "audio", "ab")]], MESSAGES), timeout_ms=1000)
    run = start_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", available_now=False)
    try:
        deadline = time.time() + 90
        while time.time() < deadline and not any(p.stateOperators and p.numInputRows == 0 and p.batchId > 0 for p in run.recentProgress):
            time.sleep(0.5)
        time.sleep(2)
        spark.createDataFrame([("s", 2, "transcribe", None)], MESSAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        while time.time() < deadline and spark.read.schema("kind string").parquet(f"file://{tmp_path}/out").count() < 2:
            time.sleep(0.5)
    finally:
        run.stop()
    assert {r.kind for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {"ack", "error"}


def test_a_large_session(spark, tmp_path):
    piece, folder = "x" * (1 << 20), tmp_path / "in"
    for i in range(3):
        spark.range(i * 34, i * 34 + 34).select(F.lit("s").alias("session"), F.col("id").alias("seq"), F.lit("audio").alias("type"), F.concat(F.lit(piece), F.col("id").cast("string")).alias("data")).coalesce(1).write.mode("append").parquet(str(folder))
    spark.createDataFrame([("s", 500, "transcribe", None)], MESSAGES).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(str(folder))
    found = answers(spark, tmp_path, assemble_sessions(stream, timeout_ms=None)).filter("kind = 'transcript'").select("bytes", F.md5("detail"))
    assert counted(found) == counted(assemble_sessions(spark.read.parquet(str(folder))).filter("kind = 'transcript'").select("bytes", F.md5("detail")))
    assert found.first()["bytes"] > 100 << 20


def test_running_rows(spark, tmp_path):
    rng, schema = random.Random(3), "model string, seq long, wer double, cer double"
    rows = [(rng.choice(["m", "n", None]), i, rng.choice([rng.random(), None]), rng.random()) for i in range(90)]
    parts = [rows[:30], rows[30:60], rows[60:]]
    for p in parts:
        rng.shuffle(p)
    got = answers(spark, tmp_path, running_rows(stream_of(spark, tmp_path / "in", parts, schema), ("model",), "seq"))
    assert counted(got) == counted(running_rows(spark.createDataFrame(rows, schema), ("model",), "seq")) and got.count() == 90


def test_final_windows(spark, tmp_path):
    schema = "session string, turn int, ts timestamp, text string"
    first = [("a", 2, at(10), "two"), ("a", 1, at(5), "one"), ("b", 1, at(0), ""), ("a", 3, at(60), "four")]
    second = [("a", 4, at(35), "three"), ("b", 2, at(200), None), ("b", 3, at(201), "end")]
    # the watermark is at 201 - 60 then; the batch after the next one leaves out what is late by it
    third = [("c", 1, at(150), "in time")]
    fourth = [("a", 9, at(40), "late"), ("c", 2, at(160), "too")]
    last = [("z", 1, at(10_000), "x")]
    stream = stream_of(spark, tmp_path / "in", [first, second, third, fourth, last], schema)
    cleaned = clean_stream(stream)
    got = answers(spark, tmp_path, final_windows(cleaned, "session", "turn", late="60 seconds")).select("session", "start_time", "end_time", "partials", "text")
    assert {(r.session, r.partials, r.text) for r in got.collect()} == {("a", 4, "One Two Four Three"), ("b", 1, ""), ("b", 2, "End"), ("c", 2, "In time Too")}
    batch = final_windows(clean_stream(spark.createDataFrame(first + second + third + fourth[1:], schema)), "session", "turn")
    assert counted(got) == counted(batch)
