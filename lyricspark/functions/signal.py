"""Checks and features of waveforms in array columns, in numpy by Arrow batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_mono(channels: Column) -> Column:
    """The mean of the channels of array<array<float>>."""
    first = F.element_at(channels, 1)
    total = F.aggregate(F.slice(channels, 2, 1 << 30), F.transform(first, lambda x: x.cast("double")), lambda s, c: F.zip_with(s, c, lambda p, q: p + q))
    return F.transform(total, lambda x: x / F.size(channels))


def peak_normalize(samples: Column) -> Column:
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return F.when(peak > 0, F.transform(samples, lambda x: (x / peak).cast("double"))).otherwise(samples.cast("array<double>"))


def trim_or_pad(samples: Column, n: int) -> Column:
    return F.concat(F.slice(samples, 1, n), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(n - F.size(samples), F.lit(0))))


def format_checks(samples: Column, rate: Column, shortest: float = 0.5, longest: float = 30.0, least_rate: int = 16000) -> Column:
    seconds = F.size(samples) / rate
    return F.filter(F.array(
        F.when(seconds < shortest, F.concat(F.lit("too_short: "), F.format_number(seconds, 2))),
        F.when(seconds > longest, F.concat(F.lit("too_long: "), F.format_number(seconds, 2))),
        F.when(rate < least_rate, F.concat(F.lit("low_sample_rate: "), rate.cast("string"))),
    ), lambda x: x.isNotNull())


def _array(x) -> np.ndarray:
    return np.asarray(x if x is not None else [], dtype=np.float64)


def silence_issues(samples: Column, window: int = 1600, quiet: float = 0.01, ratio: float = 0.5) -> Column:
    @F.pandas_udf("array<string>")
    def run(clips: pd.Series) -> pd.Series:
        out = []
        for clip in map(_array, clips):
            found = []
            n = len(clip) // window
            if n:
                share = (np.sqrt((clip[: n * window].reshape(n, window) ** 2).mean(1)) < quiet).mean()
                if share > ratio:
                    found.append(f"high_silence: {share:.2f}")
            if len(clip) and np.sqrt((clip**2).mean()) < quiet:
                found.append("silent: overall level")
            out.append(found)
        return pd.Series(out)

    return run(samples)


def clipping_issues(samples: Column, level: float = 0.99, share: float = 0.001) -> Column:
    clipped = F.size(F.filter(samples, lambda x: F.abs(x) > level)) / F.size(samples)
    return F.when((F.size(samples) > 0) & (clipped > share), F.array(F.concat(F.lit("clipping: "), F.format_number(clipped, 4)))).otherwise(F.array().cast("array<string>"))


def signal_quality(samples: Column, rate: Column) -> Column:
    """struct<duration, rms, peak, dynamic_range_db, crest_factor, zero_crossing_rate>."""
    names = ["duration", "rms", "peak", "dynamic_range_db", "crest_factor", "zero_crossing_rate"]

    @F.pandas_udf("struct<" + ",".join(f"{n}:double" for n in names) + ">")
    def run(clips: pd.Series, rates: pd.Series) -> pd.DataFrame:
        out = []
        for x, r in zip(map(_array, clips), rates):
            rms, peak = (float(np.sqrt((x**2).mean())), float(np.abs(x).max())) if len(x) else (0.0, 0.0)
            ratio = peak / rms if rms > 0 else 0.0
            crossings = float((x[1:] * x[:-1] < 0).sum() / len(x)) if len(x) else 0.0
            out.append((len(x) / r, rms, peak, 20 * np.log10(ratio) if ratio > 0 else 0.0, ratio, crossings))
        return pd.DataFrame(out, columns=names)

    return run(samples, rate)


def add_noise(samples: Column, row_id: Column, snr_db: float = 25.0, seed: int = 0) -> Column:
    """Gaussian noise at a signal-to-noise ratio, drawn by the row's id (null as -1); peaks above 0.99 are scaled down to it."""

    @F.pandas_udf("array<double>")
    def run(clips: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for x, i in zip(map(_array, clips), ids):
            power = (x**2).mean() / 10 ** (snr_db / 10) if len(x) else 0.0
            y = x + np.random.default_rng([seed, 0 if i is None or pd.isna(i) else int(i) + 1]).normal(size=len(x)) * np.sqrt(power)
            peak = np.abs(y).max() if len(y) else 0.0
            out.append(y * (0.99 / peak) if peak > 0.99 else y)
        return pd.Series(out)

    return run(samples, row_id)


def mel_filters(mels: int = 80, n_fft: int = 400, rate: int = 16000, top: float = 8000.0) -> np.ndarray:
    """Triangular filters on the mel scale, one row each."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + top / 700), mels + 2) / 2595) - 1)
    freqs = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (freqs[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - freqs[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel_of(x: np.ndarray, filters: np.ndarray, n_fft: int = 400, hop: int = 160) -> np.ndarray:
    padded = np.pad(x, n_fft // 2, mode="reflect" if len(x) > n_fft // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop][: len(x) // hop + 1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    mel = np.log(filters @ (np.abs(np.fft.rfft(frames * window, axis=1)) ** 2).T + 1e-9)
    return (mel - mel.mean()) / (mel.std(ddof=1) + 1e-9)


def log_mel(samples: Column, mels: int = 80, n_fft: int = 400, hop: int = 160, rate: int = 16000) -> Column:
    """array<array<float>> of mels by frames, with mean 0 and deviation 1 over the clip."""
    filters = mel_filters(mels, n_fft, rate)

    @F.pandas_udf("array<array<float>>")
    def run(clips: pd.Series) -> pd.Series:
        return pd.Series([[r.astype(np.float32) for r in log_mel_of(_array(c), filters, n_fft, hop)] for c in clips])

    return run(samples)
