"""Folds over ordered events, in batch form; streaming/ has the same rules for streams.

``fold`` deals events by key, sorts them by time, and carries one key's small state from Arrow batch to Arrow batch, so
that a key of any size costs constant memory. The rules below are its steps.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def fold(events: DataFrame, keys: list[str], order: list[str], inputs: list[Column], kept: list[str], outputs: str, start: Callable, step: Callable) -> DataFrame:
    """(kept, outputs) of each event: ``step(state, *inputs)`` gives the next state and the outputs; ``start()`` is a new key's state.

    Events of a key come in ascending order of ``order``; null keys are one key.
    """
    of_key, of_order = [f"__k{i}" for i in range(len(keys))], [f"__o{i}" for i in range(len(order))]
    rows = events.select(*(F.col(k).alias(a) for k, a in zip(keys, of_key, strict=True)), *(F.col(o).alias(a) for o, a in zip(order, of_order, strict=True)), *(c.alias(f"__x{i}") for i, c in enumerate(inputs)), *kept)
    dealt = rows.repartition(*of_key).sortWithinPartitions(*of_key, *of_order)
    names = [part.split()[0] for part in outputs.split(",")]
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    kinds = [types[part.split()[1]] for part in outputs.split(",")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.select(*kept).schema)
    first_input, first_kept = len(keys) + len(order), len(keys) + len(order) + len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            own = zip(*[batch.column(i).to_pylist() for i in range(len(keys))], strict=True)
            values = zip(*[batch.column(i).to_pylist() for i in range(first_input, first_kept)], strict=True)
            out = []
            for k, x in zip(own, values, strict=True):
                if k != key:
                    key, state = k, start()
                state, made = step(state, *x)
                out.append(made)
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[first_kept:], *columns], [*kept, *names])

    return dealt.mapInArrow(run, f"{schema}, {outputs}")


def replays(events: DataFrame, keys: list[str], time: str, id_col: str, seconds: int) -> DataFrame:
    """(id, fresh): an event is fresh if its key was not accepted in the ``seconds`` before; a refused one is not remembered."""
    span = seconds * 1_000_000

    def step(seen, t):
        fresh = seen is None or t - seen > span
        return (t if fresh else seen), (fresh,)

    return fold(events, keys, [time, id_col], [micros(time)], [id_col], "fresh boolean", lambda: None, step)


def replays_capped(events: DataFrame, by: list[str], nonce: str, time: str, id_col: str, *, seconds: int, most: int) -> DataFrame:
    """(id, fresh) as ``replays`` for the nonces of each group, of which ``most`` are remembered; when all of them are within the window, new ones are refused."""
    span = seconds * 1_000_000

    def step(seen: OrderedDict, t, name):
        while seen and next(iter(seen.values())) < t - span:
            seen.popitem(last=False)
        fresh = name not in seen and len(seen) < most
        if fresh:
            seen[name] = t
        return seen, (fresh,)

    return fold(events, by, [time, id_col], [micros(time), F.col(nonce).cast("string")], [id_col], "fresh boolean", OrderedDict, step)


def claims(events: DataFrame, keys: list[Column], time: str, id_col: str) -> DataFrame:
    """(id, claimed): the first event of each key claims it, for good."""
    names = [f"__c{i}" for i in range(len(keys))]
    keyed = events.select(id_col, time, *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    first = keyed.groupBy(*names).agg(F.min(F.struct(time, id_col))[id_col].alias(id_col)).select(id_col, F.lit(True).alias("claimed"))
    return events.select(id_col).join(first, id_col, "left").select(id_col, F.coalesce("claimed", F.lit(False)).alias("claimed"))


def quota(events: DataFrame, keys: list[str], time: str, ids: list[str], *, seconds: int, most: int) -> DataFrame:
    """(keys, ids, window_start, accepted): a window starts at a key's first event and, ``seconds`` later, anew at the
    next one; in each, the first ``most`` events are accepted. Windows follow the events, not the clock."""
    span = seconds * 1_000_000

    def step(state, t):
        begin, used = state
        if begin is None or t - begin >= span:
            begin, used = t, 0
        return (begin, used + 1), (begin, used < most)

    known = events.where(F.col(time).isNotNull())
    return fold(known, keys, [time, *ids], [micros(time)], [*keys, *ids], "window_start long, accepted boolean", lambda: (None, 0), step)


def byte_quota(events: DataFrame, keys: list[str], time: str, ids: list[str], size: Column, *, seconds: int, most: int) -> DataFrame:
    """(keys, ids, accepted): windows as in ``quota``; an event whose size doesn't fit any more is refused and counts nothing."""
    span = seconds * 1_000_000

    def step(state, t, n):
        begin, used = state
        if begin is None or t - begin >= span:
            begin, used = t, 0
        fits = used + n <= most
        return (begin, used + n * fits), (fits,)

    known = events.where(F.col(time).isNotNull() & size.isNotNull())
    return fold(known, keys, [time, *ids], [micros(time), size.cast("long")], [*keys, *ids], "accepted boolean", lambda: (None, 0), step)


def budget(events: DataFrame, keys: list[str], time: str, ids: list[str], units: Column, *, seconds: int, most: float) -> DataFrame:
    """(keys, ids, status, remaining): ok, invalid (null, negative or not finite units) or exhausted; only what is ok changes the
    window or starts a new one."""
    span = seconds * 1_000_000

    def step(state, t, n):
        if n is None or not math.isfinite(n) or n < 0:
            return state, ("invalid", None)
        begin, used = state
        if begin is None or t - begin >= span:
            begin, used = t, 0.0
        if used + n > most:
            return state, ("exhausted", None)
        return (begin, used + n), ("ok", most - (used + n))

    known = events.where(F.col(time).isNotNull())
    return fold(known, keys, [time, *ids], [micros(time), units.cast("double")], [*keys, *ids], "status string, remaining double", lambda: (None, 0.0), step)


def announcements(events: DataFrame, nonce: list[str], time: str, received: str, id_col: str, sound: Column, *, seconds: int) -> DataFrame:
    """(id, accepted): sound, received at most ``seconds`` from its own time, and the first such one with its nonce."""
    age = F.abs(micros(received) - micros(time))
    fit = F.coalesce(sound & (age <= seconds * 1_000_000), F.lit(False))
    marked = events.select(id_col, received, *nonce, fit.alias("__fit"))
    first = F.row_number().over(Window.partitionBy(*nonce).orderBy(received, id_col)) == 1
    passed = marked.where("__fit").select(id_col, first.alias("accepted"))
    return events.select(id_col).join(passed, id_col, "left").select(id_col, F.coalesce("accepted", F.lit(False)).alias("accepted"))


class Tracked(NamedTuple):
    """The last reading, what was accepted and when, and the readings in a row that wait since."""

    last: float | None = None
    accepted: float | None = None
    at: int = 0
    waiting: int = 0


def track_rate(samples: DataFrame, keys: list[str], time: str, id_col: str, rate: Column, *, hold: float = 2.0, memory: float = 4.0, near: float = 8.0) -> DataFrame:
    """(id, shown): the rate that two readings in a row agree on; what was accepted is held for ``hold`` seconds, and a jump to
    about half or twice of what was accepted in the last ``memory`` seconds is believed at its third reading."""

    def step(was: Tracked, t, x):
        recent = lambda seconds: was.accepted is not None and t - was.at <= seconds * 1e6
        octave = x is not None and recent(memory) and min(abs(x / r - was.accepted) for r in (0.5, 2)) <= 0.12 * was.accepted
        waits = octave and was.waiting < 2
        agrees = not waits and None not in (x, was.last) and abs(x - was.last) <= near
        taken = (math.floor((x + was.last) / 2 + 0.5), t) if agrees else (was.accepted, was.at)
        return Tracked(x, *taken, was.waiting + 1 if waits else 0), (float(taken[0]) if agrees or recent(hold) else None,)

    return fold(samples, keys, [time, id_col], [micros(time), rate.cast("double")], [id_col], "shown double", Tracked, step)


def cues(verdicts: DataFrame, keys: list[str], time: str, id_col: str, verdict: Column, *, repeat: dict[str, float], usual: float) -> DataFrame:
    """(id, cue): a verdict is said once three in a row agree on it, at once if it is new, else again after ``repeat`` (``usual``) seconds; a null forgets the row.

    Rows that end three equal verdicts are what can be said; neighbours among them with one verdict are a run. A run's first
    one is said, and then the first after each pause: that is a quota of one in windows that follow the events.
    """
    ordered = Window.partitionBy(*keys).orderBy(time, id_col)
    rows = verdicts.select(*keys, time, id_col, verdict.cast("string").alias("__v"))
    ripe = (F.lag("__v", 1).over(ordered) == F.col("__v")) & (F.lag("__v", 2).over(ordered) == F.col("__v"))
    agreed = rows.withColumn("__ripe", ripe).where("__ripe")
    fresh = F.coalesce((F.lag("__v").over(ordered) != F.col("__v")).cast("int"), F.lit(1))
    runs = agreed.withColumn("__run", F.sum(fresh).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    pause = F.lit(usual)
    for name, seconds in repeat.items():
        pause = F.when(F.col("__v") == name, seconds).otherwise(pause)

    def step(said, t, micros_between):
        due = said is None or t - said >= micros_between
        return (t if due else said), (due,)

    marked = fold(runs, [*keys, "__run"], [time, id_col], [micros(time), (pause * 1e6).cast("double")], [id_col, "__v"], "__due boolean", lambda: None, step)
    said = marked.where("__due").select(id_col, F.col("__v").alias("cue"))
    return verdicts.select(id_col).join(said, id_col, "left")


def final_state(events: DataFrame, keys: list[str], time: str, id_col: str, kind: str, moves: dict[tuple[str, str], str], initial: str) -> DataFrame:
    """(keys, state, n_moves): the state that the events lead to in order; events without a transition change nothing."""
    rows = events.select(*keys, kind, time, id_col)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, time, id_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    types = [None] * len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n, done = None, initial, 0, []

        def flush() -> pa.RecordBatch:
            columns = [pa.array([d[0][i] for d in done], types[i]) for i in range(len(keys))]
            out = pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], [*keys, "state", "n_moves"])
            done.clear()
            return out

        for batch in batches:
            for i, k in enumerate(keys):
                types[i] = batch.schema.field(k).type
            own = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys], strict=True))
            for k, event in zip(own, batch.column(batch.schema.get_field_index(kind)).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, state, n))
                    key, state, n = k, initial, 0
                to = moves.get((state, event))
                if to is not None:
                    state, n = to, n + 1
            if done:
                yield flush()
        if key is not None:
            done.append((key, state, n))
            yield flush()

    return dealt.mapInArrow(run, f"{schema}, state string, n_moves long")
