"""The rate of a movement from the last seconds of its samples, for every sample: in batches, and on streams.

A sample has a time and a step for each channel; steps add up to positions. A window's positions are put on an even grid
by linear interpolation, freed of drift by a moving mean, and correlated with themselves at each lag of the allowed
rates; a lag at which the parts hold next to nothing of the movement (FAINT) has a correlation of 0. The first peak near the highest one counts, or one at half its lag if that is clear; a parabola through it and its
neighbours refines the lag. The channel with the clearest peak wins; without a clear one there is no rate.

State is what lies in the window, so a key of any length needs constant memory: ``sliding_rates`` carries it through sorted Arrow
batches (``stateful.fold``), ``rate_stream`` in a stream's state, which leaves when the watermark passes the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evispark.operators.stateful import fold, micros


#: Share of a window's whole energy under which that of two parts counts as none: a still stretch, but for rounding.
FAINT = 1e-9


@dataclass(frozen=True)
class Rhythm:
    """Microseconds of the window, of its least length and of the grid's step; least share of samples; lags and thresholds."""

    window: int = 6_000_000
    span: int = 4_000_000
    grid: float = 1e6 / 30
    share: float = 0.6
    half: int = 15
    lags: tuple[int, int] = (10, 30)
    least_move: float = 0.35
    confidence: float = 0.6
    near_top: float = 0.85
    half_peak: float = 0.25
    half_room: int = 3

    @property
    def least_samples(self) -> float:
        return self.share * self.span / self.grid


def _lag(t: np.ndarray, steps: np.ndarray, how: Rhythm) -> tuple[float, float] | None:
    """(lag in grid steps, correlation) of one channel, or None."""
    at = t[0] + how.grid * np.arange(int((t[-1] - t[0]) / how.grid) + 1)
    if len(at) < how.span / how.grid:
        return None
    level = np.interp(at, t, np.cumsum(steps))
    sums = np.append(0.0, np.cumsum(level))
    low, high = np.maximum(np.arange(len(at)) - how.half, 0), np.minimum(np.arange(len(at)) + how.half + 1, len(at))
    x = level - (sums[high] - sums[low]) / (high - low)
    if x.std() < how.least_move:
        return None
    first, last = how.lags
    r, least = np.zeros(last + 2), FAINT * (x @ x)
    for lag in range(max(first - 1, 0), min(last + 2, len(x))):
        a, b = x[: len(x) - lag], x[lag:]
        size = np.sqrt((a @ a) * (b @ b))
        r[lag] = a @ b / size if size > least else 0.0
    lags = np.arange(first, last + 1)
    peaks = lags[(r[lags] >= r[lags - 1]) & (r[lags] >= r[lags + 1]) & (r[lags] > 0)]
    if not len(peaks):
        return None
    best = peaks[r[peaks] >= how.near_top * r[peaks].max()][0]
    while len(halves := peaks[(peaks < best) & (abs(peaks - best / 2) <= how.half_room) & (r[peaks] >= how.half_peak)]):
        best = halves[0]
    bend = r[best - 1] - 2 * r[best] + r[best + 1]
    shift = 0.5 * (r[best - 1] - r[best + 1]) / bend if bend < 0 else 0.0
    return float(best + shift), float(np.clip(r[best], 0, 1))


def rhythm_of(times: list[int], steps: list[tuple], how: Rhythm) -> tuple[float, float, int] | None:
    """(lag, confidence, channel) of a window of samples in order; None where nothing is clear or times don't grow."""
    t = np.array(times, float)
    if len(t) < max(2, how.least_samples) or t[-1] - t[0] < how.span or (np.diff(t) <= 0).any():
        return None
    best = None
    for channel, x in enumerate(np.nan_to_num(np.array(steps, float)).T):
        found = _lag(t, x, how)
        if found and (best is None or found[1] > best[1]):
            best = (*found, channel)
    return best if best and best[1] >= how.confidence else None


class _Window:
    """The samples of the last ``how.window`` microseconds."""

    def __init__(self, how: Rhythm, times=(), steps=()):
        self.how, self.times, self.steps = how, list(times), list(steps)

    def add(self, t: int, step: tuple) -> tuple[float, float, int] | None:
        self.times.append(t)
        self.steps.append(step)
        out = 0
        while self.times[out] < t - self.how.window:
            out += 1
        del self.times[:out], self.steps[:out]
        return rhythm_of(self.times, self.steps, self.how)


def _shown(found, how: Rhythm, minute: float):
    return (None, None, None) if found is None else (minute / (how.grid * found[0]), found[1], found[2])


def sliding_rates(samples: DataFrame, keys: list[str], time: str, id_col: str, channels: list[Column], *, how: Rhythm = Rhythm(), minute: float = 60e6) -> DataFrame:
    """(keys, id, rate, confidence, channel) of each sample from the window that ends at it; rate is in 1 / ``minute`` microseconds, all null without a clear rhythm.

    A null step is 0; samples without a time are left out.
    """

    def step(window: _Window, t, *steps):
        return window, _shown(window.add(t, steps), how, minute)

    known = samples.where(F.col(time).isNotNull())
    inputs = [micros(time), *[c.cast("double") for c in channels]]
    return fold(known, keys, [time, id_col], inputs, [*keys, id_col], "rate double, confidence double, channel long", lambda: _Window(how), step)


def rate_stream(samples: DataFrame, key: str, time: str, id_col: str, channels: list[Column], *, how: Rhythm = Rhythm(), minute: float = 60e6, late: str = "10 seconds") -> DataFrame:
    """As ``sliding_rates`` on a stream, for one key column: samples of a micro-batch are taken in order of time; one older than the state's last gives none."""
    names = [f"x{i}" for i in range(len(channels))]
    rows = samples.where(F.col(time).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), F.col(time).cast("timestamp").alias("ts"), micros(time).alias("t"), *[c.cast("double").alias(n) for c, n in zip(channels, names, strict=True)]
    )

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, flat = state.get if state.exists else ([], [])
        window = _Window(how, times, [tuple(flat[i : i + len(names)]) for i in range(0, len(flat), len(names))])
        pdf = pd.concat(list(frames)).sort_values(["t", "id"])
        out = []
        for t, *steps in pdf[["t", *names]].itertuples(index=False):
            late_one = window.times and t < window.times[-1]
            out.append((None, None, None) if late_one else _shown(window.add(int(t), tuple(steps)), how, minute))
        state.update((window.times, [0.0 if x is None or x != x else float(x) for s in window.steps for x in s]))
        ends = (window.times[-1] + how.window) // 1000
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)
        rate, confidence, channel = zip(*out, strict=True)
        yield pd.DataFrame({"key": k[0], "id": pdf["id"].to_numpy(), "rate": pd.array(rate, "Float64"), "confidence": pd.array(confidence, "Float64"), "channel": pd.array(channel, "Int64")})

    schema = "key string, id long, rate double, confidence double, channel long"
    return rows.withWatermark("ts", late).groupBy("key").applyInPandasWithState(run, schema, "times array<long>, steps array<double>", "append", GroupStateTimeout.EventTimeTimeout)
