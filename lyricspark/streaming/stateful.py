"""Processors with state for streams: indexed chunks, sessions and running means.

They need a state store that keeps more than one value a key; `start_stream` sets it for the one query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Starts a stream into Parquet files at path; the session's own state store setting is put back at once."""
    spark = df.sparkSession
    was = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        writer = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        if was is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, was)


CHUNKS = "{key} string, chunk long, start_time timestamp, end_time timestamp, n long, total double"


class Chunks(StatefulProcessor):
    """Chunks of fixed length from a key's first row on, `stride` apart, each given out once the watermark has passed its end.

    State holds the rows that chunks to come may need, the start of the first chunk and the next index.
    The last chunk, whatever it holds, is given out like the others. Times are whole microseconds.
    """

    def __init__(self, key: str, length: int, stride: int) -> None:
        self.key, self.length, self.stride = key, length, stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at long, value double")
        self.place = handle.getValueState("place", "first long, next long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest = None
        for frame in rows:
            at, values = frame["at"].tolist(), [float(v) for v in frame["value"]]
            self.rows.appendList(list(zip(at, values)))
            earliest = min([*at, *([] if earliest is None else [earliest])])
        if earliest is not None and not self.place.exists():
            # until then an earlier row may come and be the first
            self._wake(earliest + self.length)
        return iter([])

    def _wake(self, end: int) -> None:
        due = -(-end // 1000)
        if due not in list(self.handle.listTimers()):
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, held, out = timerValues.getCurrentWatermarkInMs() * 1000, sorted((at, v) for at, v in self.rows.get()), []
        if not held:
            return
        first, index = self.place.get() if self.place.exists() else (held[0][0], 0)
        while held:
            start = first + index * self.stride
            if held[0][0] >= start + self.length:
                # a gap: the first chunk that reaches the next row
                index = max(index + 1, -(-(held[0][0] - first - self.length + 1) // self.stride))
                continue
            if start + self.length > now:
                break
            inside = [v for at, v in held if at < start + self.length]
            out.append((key[0], index, pd.Timestamp(start, unit="us"), pd.Timestamp(start + self.length, unit="us"), len(inside), sum(v for v in inside if v == v)))
            index += 1
            held = [(at, v) for at, v in held if at >= start + self.stride]
        self.place.update((first, index))
        if held:
            self.rows.put(held)
            self._wake(first + index * self.stride + self.length)
        else:
            self.rows.clear()
        if out:
            yield pd.DataFrame(out, columns=[self.key, "chunk", "start_time", "end_time", "n", "total"])

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """One list of pieces a session, joined where a transcript is asked for, and given up after `timeout_ms` without messages, or never where that is None."""

    def __init__(self, timeout_ms: int | None) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "data string")
        self.size = handle.getValueState("size", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        size, new, out, closed = (self.size.get()[0] if self.size.exists() else 0), [], [], False
        # messages of one micro-batch may come in any order
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            kind, detail, told = "ack", "", 0
            if r.type == "audio":
                new.append(r.data or "")
                size += len(r.data or "")
                told = size
            elif r.type == "transcribe":
                if size:
                    kind, detail, told = "transcript", "".join([*(p[0] for p in self.pieces.get()), *new]), size
                else:
                    kind, detail = "error", "no audio"
            elif r.type == "clear":
                kind = "cleared"
            elif r.type == "ping":
                kind, told = "pong", size
            elif r.type == "end":
                kind, told = "closed", size
            else:
                kind, detail, told = "error", f"unknown type: {r.type}", size
            if r.type in ("transcribe", "clear", "end"):
                self.pieces.clear()
                size, new = 0, []
            closed = r.type == "end"
            out.append((key[0], r.seq, kind, detail, told))
        if new:
            self.pieces.appendList([(p,) for p in new])
        if self.timeout_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
        if closed:
            self._forget()
        else:
            self.size.update((size,))
            if self.timeout_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield pd.DataFrame(out, columns=["session", "seq", "kind", "detail", "bytes"])

    def _forget(self) -> None:
        self.pieces.clear()
        self.size.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._forget()
        return iter([])

    def close(self) -> None:
        pass


#: Rows that running means give out at a time.
SLICE = 50_000


class RunningMeans(StatefulProcessor):
    """Each row with the count and means of its key so far, itself included, in the order of `order`."""

    def __init__(self, keys: tuple[str, ...], order: str, values: tuple[str, ...]) -> None:
        self.keys, self.order, self.values = keys, order, values

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, " + ", ".join(f"n{i} long, s{i} double" for i in range(len(self.values))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, *sums = self.sums.get() if self.sums.exists() else (0, *([0, 0.0] * len(self.values)))
        # numbers alone are kept of a micro-batch's rows, which may come in any order
        parts = [[r[c].to_numpy(np.int64 if c == self.order else float) for c in (self.order, *self.values)] for r in rows]
        order, *values = (np.concatenate(c) for c in zip(*parts))
        del parts
        at = np.argsort(order, kind="stable")
        for low in range(0, len(at), SLICE):
            part = at[low : low + SLICE]
            out = {**{k: [v] * len(part) for k, v in zip(self.keys, key)}, self.order: order[part], "samples": n + 1 + np.arange(len(part))}
            n += len(part)
            for i, (name, column) in enumerate(zip(self.values, values)):
                known = ~np.isnan(column[part])
                counts = sums[2 * i] + np.cumsum(known)
                # sums go on one by one, as those of single rows
                totals = np.cumsum(np.concatenate([[sums[2 * i + 1]], np.where(known, column[part], 0.0)]))[1:]
                sums[2 * i : 2 * i + 2] = int(counts[-1]), float(totals[-1])
                out[f"avg_{name}"] = pd.Series(np.where(counts > 0, totals / np.maximum(counts, 1), np.nan), dtype=object).where(counts > 0, None)
            yield pd.DataFrame(out)
        self.sums.update((n, *sums))

    def close(self) -> None:
        pass
