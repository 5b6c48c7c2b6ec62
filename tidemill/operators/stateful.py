"""Time-driven operators: a small state for each key, folded over its rows in time order.

The same step functions run over tables and over streams.  Over a table, rows are dealt by
key and sorted, by Spark, and flow through the fold in batches: a key's rows are never held
together, however many they are.  Over a stream, the state lives in the state store.

A step takes (state, time in microseconds, value) and gives (state, allowed, detail); state
is None for a new key, then a list of whole numbers or strings.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

Step = Callable[[list | None, int, object], tuple[list | None, bool, int]]
SECOND = 1_000_000


def cooldown(seconds: float) -> Step:
    """Allowed if the last allowed row is more than ``seconds`` ago: at the exact boundary it is suppressed."""
    span = int(seconds * SECOND)

    def step(state, t, _):
        if state is None or t - state[0] > span:
            return [t], True, 0
        return state, False, 0

    return step


def sliding_limit(limit: int, seconds: float) -> Step:
    """Allowed while fewer than ``limit`` allowed rows are younger than the window; refused rows do not count."""
    span = int(seconds * SECOND)

    def step(state, t, _):
        young = [x for x in state or [] if t - x < span]
        if len(young) >= limit:
            return young, False, len(young)
        return [*young, t], True, len(young) + 1

    return step


def fixed_limit(limit: int, seconds: float) -> Step:
    """Allowed up to ``limit`` rows in a window that starts at the first row after the last one; refused rows count."""
    span = int(seconds * SECOND)

    def step(state, t, _):
        start, n = state if state and t - state[0] < span else (t, 0)
        return [start, n + 1], n + 1 <= limit, n + 1

    return step


def breaker(threshold: int, seconds: float) -> Step:
    """Allowed unless ``threshold`` failures in a row opened the circuit less than ``seconds`` ago; value is true for success."""
    span = int(seconds * SECOND)

    def step(state, t, ok):
        failures, until = state or (0, 0)
        if failures >= threshold and t < until:
            return [failures, until], False, failures
        if ok:
            return [0, 0], True, 0
        failures += 1
        return [failures, t + span if failures >= threshold else until], True, failures

    return step


def throttle(seconds: float) -> Step:
    """All rows pass, spaced at least ``seconds`` apart; detail is the wait in microseconds."""
    span = int(seconds * SECOND)

    def step(state, t, _):
        at = t if state is None else max(t, state[0] + span)
        return [at], True, at - t

    return step


def budget(daily: int, monthly: int) -> Step:
    """Allowed while fewer than ``daily`` rows of the day and ``monthly`` of the month were allowed (UTC)."""

    def step(state, t, _):
        now = datetime.fromtimestamp(t // SECOND, UTC)
        day, month = now.strftime("%Y-%m-%d"), now.strftime("%Y-%m")
        was_day, used_day, was_month, used_month = state or (day, 0, month, 0)
        used_day, used_month = used_day if was_day == day else 0, used_month if was_month == month else 0
        ok = used_day < daily and used_month < monthly
        return [day, used_day + ok, month, used_month + ok], ok, used_day + ok

    return step


def digest(seconds: float) -> Step:
    """Allowed where a digest is sent: the interval since the last one has passed; detail is the number of rows in it."""
    span = int(seconds * SECOND)

    def step(state, t, _):
        last, pending = state or (None, 0)
        if last is None or t - last >= span:
            return [t, 0], True, pending + 1
        return [last, pending + 1], False, pending + 1

    return step


def lease(seconds: float) -> Step:
    """value is who asks: granted to the holder, or to anyone once the heartbeat is more than ``seconds`` old."""
    span = int(seconds * SECOND)

    def step(state, t, who):
        if state is None or state[0] == who or t - state[1] > span:
            return [who, t], True, int(state is not None and state[0] != who)
        return state, False, 0

    return step


def _plain(x: object) -> object:
    return x.item() if hasattr(x, "item") else x


def fold(df: DataFrame, key: str, at: str, tie: str, step: Callable[..., Step], *args, value: str | None = None) -> DataFrame:
    """df's key, at and tie with ``allowed`` and ``detail`` of the step over each key's rows, in order of (at, tie).

    Null keys are a key like any other; rows without a time are left out.
    """
    rows = df.where(F.col(at).isNotNull()).select(F.col(key), F.col(at), F.col(tie), F.unix_micros(F.col(at).cast("timestamp")).alias("__t"), (F.col(value) if value else F.lit(None).cast("string")).alias("__v"), F.to_json(F.struct(F.col(key))).alias("__k"))
    schema = StructType([rows.schema[c] for c in (key, at, tie)]).add("allowed", "boolean").add("detail", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, last, state = step(*args), None, None
        for b in batches:
            allowed, detail = [], []
            for k, t, v in zip(b["__k"], b["__t"], b["__v"], strict=True):
                if k != last:
                    last, state = k, None
                state, ok, n = one(state, int(t), _plain(v))
                allowed.append(ok)
                detail.append(n)
            yield b[[key, at, tie]].assign(allowed=allowed, detail=detail)

    return rows.repartition("__k").sortWithinPartitions("__k", "__t", tie).mapInPandas(run, schema)


def fold_stream(df: DataFrame, key: str, at: str, tie: str, step: Callable[..., Step], *args, value: str | None = None, keep: float | None = None, late: float = 0) -> DataFrame:
    """fold over a stream: rows of one micro-batch are ordered, and batches follow one another.

    With ``keep``, a key's state ends once the watermark, ``late`` seconds behind the latest row,
    is ``keep`` seconds past the key's last row: choose at least the step's own span, and no
    answer changes.  A row that comes after a later one of its key, from an earlier batch, is
    then no part of the fold: it comes out with ``late`` true and nothing else.  Rows behind the
    watermark are left out and counted by Spark.  Without ``keep`` state is kept for ever, and such
    a row is judged when it comes.
    """
    source = df if keep is None else df.withWatermark(at, f"{late} seconds")
    rows = source.where(F.col(at).isNotNull()).select(F.col(key), F.col(at), F.col(tie), F.unix_micros(F.col(at).cast("timestamp")).alias("__t"), (F.col(value) if value else F.lit(None).cast("string")).alias("__v"))
    schema = StructType([rows.schema[c] for c in (key, at, tie)]).add("allowed", "boolean").add("detail", "long")
    schema = schema if keep is None else schema.add("late", "boolean")

    def run(_, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        one = step(*args)
        state, last = json.loads(kept.get[0]) if kept.exists else (None, None)
        b = pd.concat(list(batches)).sort_values(["__t", tie], kind="stable")
        allowed, detail, behind = [], [], []
        for t, v in zip(b["__t"], b["__v"], strict=True):
            behind.append(keep is not None and last is not None and int(t) < last)
            if behind[-1]:
                allowed.append(None)
                detail.append(None)
                continue
            state, ok, n = one(state, int(t), _plain(v))
            last = int(t)
            allowed.append(ok)
            detail.append(n)
        kept.update((json.dumps([state, last]),))
        if keep is not None:
            kept.setTimeoutTimestamp(max(last // 1000 + int(keep * 1000), kept.getCurrentWatermarkMs()) + 1)
        out = b[[key, at, tie]].assign(allowed=pd.array(allowed, "boolean"), detail=pd.array(detail, "Int64"))
        yield out if keep is None else out.assign(late=behind)

    timeout = GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", timeout)


def due(df: DataFrame, now: str, next_run: str = "next_run_at", paused: str = "paused", running: str = "running", heartbeat: str = "lock_heartbeat_at", stale: int = 600) -> DataFrame:
    """Jobs to start now: due, not paused, and not running, or running with a heartbeat more than ``stale`` seconds old or none."""
    at = F.lit(now).cast("timestamp")
    old = F.coalesce(F.unix_micros(at) - F.unix_micros(F.col(heartbeat).cast("timestamp")) > stale * SECOND, F.lit(True))
    return df.where(~F.col(paused) & (F.col(next_run).cast("timestamp") <= at) & (~F.col(running) | old))


def reconciled(state: DataFrame, eligible: DataFrame, key: str, now: str, stale: int = 600) -> DataFrame:
    """State of all jobs: stale locks freed, missing states added, and paused exactly where a source is not eligible.

    state: key, paused, running, lock_heartbeat_at; eligible: key, ok.
    """
    old = F.coalesce(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("lock_heartbeat_at").cast("timestamp")) > stale * SECOND, F.lit(True))
    both = state.join(eligible, key, "full")
    held = F.coalesce(F.col("running"), F.lit(False)) & ~old
    return both.select(key, (~F.coalesce(F.col("ok"), F.lit(False))).alias("paused"), held.alias("running"), F.when(held, F.col("lock_heartbeat_at")).alias("lock_heartbeat_at"))


def attempts(df: DataFrame, job: str, number: str, ok: str, most: int, base: float, cap: float) -> DataFrame:
    """One row for each job: attempts made until the first success or the last allowed one, whether it succeeded, and seconds waited."""
    from tidemill.functions.dates import backoff

    tried = df.where(F.col(number) <= most)
    won = F.min(F.when(F.col(ok), F.col(number)))
    made = tried.groupBy(job).agg(won.alias("won"), F.max(number).alias("last"))
    n = F.coalesce("won", "last")
    waited = F.aggregate(F.transform(F.expr("sequence(1, greatest(n_attempts - 1, 1))"), lambda i: backoff(i, base, cap)), F.lit(0.0), lambda acc, x: acc + x)
    return made.select(job, n.cast("int").alias("n_attempts"), F.col("won").isNotNull().alias("succeeded")).withColumn("waited", F.when(F.col("n_attempts") > 1, waited).otherwise(0.0))
