"""Streams: overlapping chunks, sessions, running metrics and cleaned partial transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyricspark.functions.text import postprocess_text

from .stateful import CHUNKS, Chunks, RunningMeans, Sessions, start_stream

__all__ = ["assemble_sessions", "clean_stream", "final_transcripts", "final_windows", "indexed_chunks", "overlapping_chunks", "running_metrics_stream", "running_rows", "start_stream"]


def overlapping_chunks(stream: DataFrame, time: str = "ts", seconds: float = 5.0, overlap: float = 0.5, late: str = "10 minutes", keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Counts and sums over windows of fixed length whose stride is the length less the overlap."""
    window = F.window(time, f"{round(seconds * 1000)} milliseconds", f"{round((seconds - overlap) * 1000)} milliseconds")
    out = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = out.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), "n", "total")


def indexed_chunks(rows: DataFrame, key: str, time: str = "ts", value: str = "value", seconds: float = 5.0, overlap: float = 0.5, late: str = "10 minutes") -> DataFrame:
    """(key, chunk, start_time, end_time, n, total): chunks of fixed length from each key's first row on, counted from 0.

    Chunks begin `seconds - overlap` apart; one without rows is left out, its index is not given again, and
    the last chunk stays, however little it holds. A stream gives out a chunk once the watermark, `late`
    behind the latest row of any key, has passed its end, and leaves out rows that come later than that;
    keys are strings. Rows without key or time take no part; null values count and add nothing.
    """
    length, stride = round(seconds * 1_000_000), round((seconds - overlap) * 1_000_000)
    if not 0 < stride <= length:
        raise ValueError("overlap must be shorter than a chunk, and not negative")
    used = rows.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").alias(time), F.col(value).cast("double").alias("value")).filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    if rows.isStreaming:
        at = F.unix_micros(time).alias("at")
        stream = used.withWatermark(time, late).select(key, time, at, "value")
        return stream.groupBy(key).transformWithStateInPandas(Chunks(key, length, stride), CHUNKS.format(key=key), "append", "eventTime")
    at = F.unix_micros(time)
    # one row a key; a key's rows meet in partial sums, chunk by chunk
    placed = used.select(key, at.alias("at"), "value").join(used.groupBy(key).agg(F.min(at).alias("first")), key).withColumn("off", F.col("at") - F.col("first"))
    lowest = F.greatest(F.lit(0), F.expr(f"(off - {length}) div {stride} + 1 - if(off < {length}, 1, 0)"))
    chunks = placed.withColumn("chunk", F.explode(F.sequence(lowest, F.expr(f"off div {stride}")))).filter(F.col("off") < F.col("chunk") * stride + length)
    out = chunks.groupBy(key, "first", "chunk").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(~F.isnan("value"), F.col("value"))), F.lit(0.0)).alias("total"))
    start = F.col("first") + F.col("chunk") * stride
    return out.select(key, "chunk", F.timestamp_micros(start).alias("start_time"), F.timestamp_micros(start + length).alias("end_time"), "n", "total")


def running_metrics_stream(stream: DataFrame, keys: tuple[str, ...] = (), values: tuple[str, ...] = ("wer", "cer")) -> DataFrame:
    """Count and means so far by key, for the update or complete mode."""
    return stream.groupBy(*keys).agg(F.count("*").alias("samples"), *(F.avg(v).alias(f"avg_{v}") for v in values))


def running_rows(rows: DataFrame, keys: tuple[str, ...], order: str, values: tuple[str, ...] = ("wer", "cer")) -> DataFrame:
    """Each row's keys, order, samples and avg_<value>: count and means of its key up to and with it.

    A stream, in append mode, counts a micro-batch's rows in that order, after all that came before; a
    batch counts all rows in that order. Null values don't enter a mean, and it is null before the first.
    `order` is a long; keys may be null.
    """
    kinds = dict(rows.dtypes)
    used = rows.select(*keys, F.col(order).cast("long").alias(order), *(F.col(v).cast("double").alias(v) for v in values))
    if rows.isStreaming:
        schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{order}` long", "samples long", *(f"`avg_{v}` double" for v in values)])
        return used.groupBy(*keys).transformWithStateInPandas(RunningMeans(keys, order, values), schema, "append", "none")
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return used.select(*keys, order, F.count("*").over(so_far).alias("samples"), *(F.avg(v).over(so_far).alias(f"avg_{v}") for v in values))


def clean_stream(stream: DataFrame, text: str = "text", **flags: bool) -> DataFrame:
    """Each partial transcript cleaned; no state."""
    return stream.withColumn(text, postprocess_text(F.col(text), **flags))


def final_transcripts(partials: DataFrame, session: str, order: str, text: str = "text") -> DataFrame:
    """A session's cleaned partials, joined by spaces in order."""
    parts = partials.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("p"))
    return parts.select(session, F.array_join(F.filter(F.transform("p", lambda x: x[text]), lambda t: t != ""), " ").alias("text"))


def final_windows(partials: DataFrame, session: str, order: str, time: str = "ts", gap: str = "30 seconds", late: str = "10 minutes", text: str = "text") -> DataFrame:
    """(session, start_time, end_time, partials, text): partials less than `gap` apart are one transcript, joined by spaces in order.

    A stream gives out a transcript once the watermark, `late` behind the latest partial of any session, has
    passed its last partial by the gap. A partial that comes after that is left out; one that comes in time
    may join what were two transcripts. Null and empty texts count as partials and add no words.
    """
    rows = partials.withWatermark(time, late) if partials.isStreaming else partials
    parts = rows.groupBy(session, F.session_window(time, gap).alias("w")).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("p"))
    joined = F.array_join(F.filter(F.transform("p", lambda x: x[text]), lambda t: t != ""), " ")
    return parts.select(session, F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), F.size("p").alias("partials"), joined.alias("text"))


OUT = "session string, seq long, kind string, detail string, bytes long"


def assemble_sessions(messages: DataFrame, timeout_ms: int | None = 3_600_000) -> DataFrame:
    """Answers to messages(session, seq, type, data): audio is buffered and acknowledged, transcribe returns the buffer and empties it, clear empties it, end closes.

    `bytes` is the buffer's size in characters. A stream keeps a session's pieces in a list, one for each
    message, until they are asked for, the session ends or nothing comes for `timeout_ms` (None: for ever; a
    timeout keeps a stream alive), and takes the messages of a micro-batch in the order of seq. A batch
    answers by windows, all in the order of seq; there is no timeout. Rows without session form one of their own; a null type is an unknown one.
    """
    used = messages.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), F.coalesce("type", F.lit("None")).alias("type"), "data")
    if messages.isStreaming:
        return used.groupBy("session").transformWithStateInPandas(Sessions(timeout_ms), OUT, "append", "none" if timeout_ms is None else "processingTime")
    kind, order = F.col("type"), Window.partitionBy("session").orderBy("seq")
    empties = kind.isin("transcribe", "clear", "end")
    # a run holds the pieces between two messages that empty the buffer
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    heard = F.when(kind == "audio", F.coalesce("data", F.lit(""))).otherwise("")
    runs = used.withColumn("heard", heard).withColumn("run", F.coalesce(F.count_if(empties).over(before), F.lit(0)))
    so_far = Window.partitionBy("session", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = runs.withColumn("size", F.sum(F.char_length("heard")).over(so_far))
    # only a transcript's own row gathers its pieces
    asked = sized.filter((kind == "transcribe") & (F.col("size") > 0)).select("session", "run")
    texts = sized.filter(kind == "audio").join(asked, sized["session"].eqNullSafe(asked["session"]) & (sized["run"] == asked["run"]), "left_semi").groupBy("session", "run").agg(F.array_sort(F.collect_list(F.struct("seq", "heard"))).alias("p"))
    texts = texts.select(F.col("session").alias("_s"), F.col("run").alias("_r"), F.array_join(F.transform("p", lambda x: x["heard"]), "").alias("held"))
    all_ = sized.join(texts, sized["session"].eqNullSafe(F.col("_s")) & (F.col("run") == F.col("_r")), "left")
    full = F.col("size") > 0
    answer = F.when(kind == "audio", "ack").when(kind == "transcribe", F.when(full, "transcript").otherwise("error")).when(kind == "clear", "cleared").when(kind == "ping", "pong").when(kind == "end", "closed").otherwise("error")
    detail = F.when(kind == "transcribe", F.when(full, F.col("held")).otherwise("no audio")).when(kind.isin("audio", "clear", "ping", "end"), "").otherwise(F.concat(F.lit("unknown type: "), kind))
    return all_.select("session", "seq", answer.alias("kind"), detail.alias("detail"), F.when(kind == "clear", F.lit(0)).otherwise(F.col("size")).cast("long").alias("bytes"))
