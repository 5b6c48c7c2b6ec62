"""Recurring entries as bounded occurrences.

``regular_series`` expands daily, weekly, monthly and yearly rules in SQL functions;
``expand`` takes any rule of the iCalendar grammar, one small Python call for each parent,
with its exceptions, extra dates and moved or cancelled occurrences.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import occurrence_identity


@dataclass(frozen=True)
class Bounds:
    """Limits of an expansion: days ahead of the reference date, occurrences of one parent, characters of a rule."""

    horizon_days: int = 400
    per_parent: int = 200
    rule_length: int = 512


def regular_series(start: Column, freq: str, interval: int = 1, count: Column | None = None, until: Column | None = None, reference: str | None = None, bounds: Bounds | None = None) -> Column:
    """array of dates of a rule: months and years without that day are skipped, and the count counts only real dates.

    Dates before the reference are passed over, but count; the horizon's last day is included.
    """
    bounds = bounds or Bounds()
    unit = {"DAILY": 1, "WEEKLY": 7}.get(freq)
    low = F.lit(reference).cast("date") if reference else start
    high = F.date_add(low, bounds.horizon_days)
    high = F.least(high, until) if until is not None else high
    if unit:
        steps = F.greatest(F.floor(F.datediff(high, start) / (unit * interval)), F.lit(-1)).cast("int")
        dates = F.when(steps >= 0, F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), lambda i: F.date_add(start, (i * unit * interval).cast("int")))).otherwise(F.array().cast("array<date>"))
    else:
        months = interval * {"MONTHLY": 1, "YEARLY": 12}[freq]
        steps = F.greatest(F.floor(F.months_between(high, start) / months) + 1, F.lit(0)).cast("int")
        every = F.transform(F.sequence(F.lit(0), steps), lambda i: F.add_months(start, (i * months).cast("int")))
        dates = F.filter(every, lambda d: (F.day(d) == F.day(start)) & (d <= high))
    if count is not None:
        dates = F.slice(dates, F.lit(1), count)
    return F.slice(F.filter(dates, lambda d: d >= low), 1, bounds.per_parent)


_FINER = ("SECONDLY", "MINUTELY", "HOURLY")
_OUT = "start_date string, start_time string, end_date string, end_time string, recurrence_id string, source_occurrence_id string, cancelled boolean, detached boolean, title string, warning string"


def _moment(text: str | None) -> tuple[datetime, bool] | None:
    """Point in time of an ISO text, and whether it is a date alone."""
    text = (text or "").strip()
    try:
        if len(text) == 10:
            return datetime.combine(date.fromisoformat(text), time.min), True
        return datetime.fromisoformat(text).replace(tzinfo=None), False
    except ValueError:
        return None


def occurrences(start: str, end: str | None, spec: dict, reference: date, bounds: Bounds) -> Iterator[dict]:
    """Occurrences of one parent, in order; the parent alone, with a warning, where its rule is not to be expanded."""
    first = _moment(start)
    if first is None:
        return
    last, whole = _moment(end), bool(spec.get("all_day")) or first[1]
    span = last[0] - first[0] if last and last[0] >= first[0] else None

    def row(at: datetime, until: datetime | None, **more) -> dict:
        show = lambda t: None if t is None or whole else t.strftime("%H:%M:%S")
        return {"start_date": at.date().isoformat(), "start_time": show(at), "end_date": until.date().isoformat() if until else None, "end_time": show(until), "recurrence_id": None, "source_occurrence_id": None, "cancelled": False, "detached": False, "title": None, "warning": None} | more

    def alone(warning: str | None) -> Iterator[dict]:
        yield row(first[0], last[0] if last else None, warning=warning)

    rule = (spec.get("rrule") or "").strip().removeprefix("RRULE:")
    explicit = [(o, m) for o in spec.get("occurrences") or [] if (m := _moment(o.get("start")))]
    if spec.get("mode") == "parent_only":
        yield from alone(None)
        return
    slots: dict[tuple, dict] = {}
    if spec.get("mode") != "explicit_occurrences":
        if len(rule) > bounds.rule_length:
            yield from alone("rule_too_long")
            return
        if any(f in rule.upper() for f in _FINER):
            yield from alone("finer_than_a_day")
            return
        low, high = datetime.combine(reference, time.min), datetime.combine(reference + timedelta(days=bounds.horizon_days), time.max)
        found, cut = [], False
        if rule:
            from dateutil.rrule import rrulestr

            try:
                for at in rrulestr(rule, dtstart=first[0]):
                    at = at.replace(tzinfo=None)
                    if at > high:
                        break
                    if at >= low:
                        found.append(at)
                        if len(found) >= bounds.per_parent:
                            cut = True
                            break
            except (ValueError, TypeError):
                yield from alone("rule_unreadable")
                return
        elif not spec.get("rdate"):
            found.append(first[0])
        found += [m[0] for d in spec.get("rdate") or [] if (m := _moment(d)) and low <= m[0] <= high]
        out = {m[0].date() for d in spec.get("exdate") or [] if (m := _moment(d))}
        for at in found:
            if at.date() not in out:
                r = row(at, at + span if span is not None else None, warning="cut" if cut else None)
                slots[r["start_date"], r["start_time"]] = r
    for o, m in explicit:
        until, original = _moment(o.get("end")), _moment(o.get("recurrence_id"))
        r = row(m[0], until[0] if until else None, recurrence_id=o.get("recurrence_id"), source_occurrence_id=o.get("source_occurrence_id"), cancelled=bool(o.get("cancelled")), detached=bool(o.get("recurrence_id")), title=o.get("title"))
        place = original or m
        slots.pop((place[0].date().isoformat(), None if whole else place[0].strftime("%H:%M:%S")), None)
        slots[r["start_date"], r["start_time"]] = r
    yield from sorted(slots.values(), key=lambda r: (r["start_date"], r["start_time"] or ""))


def expand(parents: DataFrame, key: str, spec: str, start: str, end: str, reference: str, bounds: Bounds | None = None) -> DataFrame:
    """key, occurrence_id and all columns of an occurrence for every parent; spec is a JSON text.

    spec: mode, rrule, rdate, exdate, all_day, occurrences, source_parent_id.  A parent
    without a readable start has no occurrence.  No parent gives more than
    ``bounds.per_parent`` generated rows, so the expansion of a partition is bounded.
    """
    limits, day = bounds or Bounds(), date.fromisoformat(reference)
    kind = parents.schema[key].dataType.simpleString()
    rows = parents.select(F.col(key).alias("k"), F.col(spec).alias("spec"), F.col(start).cast("string").alias("start"), F.col(end).cast("string").alias("end"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, s, a, z in zip(b["k"], b["spec"], b["start"], b["end"], strict=True):
                try:
                    one = json.loads(s) if s else {}
                except ValueError:
                    one = {}
                parent = one.get("source_parent_id")
                out += [{"k": k, "source_parent_id": parent} | o for o in occurrences(a, z, one, day, limits)]
            yield pd.DataFrame(out, columns=["k", "source_parent_id", *(c.split()[0] for c in _OUT.split(", "))])

    found = rows.mapInPandas(run, f"k {kind}, source_parent_id string, {_OUT}")
    at = F.concat_ws("T", "start_date", "start_time")
    identity = occurrence_identity(F.col("k").cast("string"), F.col("source_parent_id"), F.col("source_occurrence_id"), F.col("recurrence_id"), at)
    return found.withColumn("occurrence_id", identity).withColumnRenamed("k", key)


def run_budget(df: DataFrame, order: Column, generated: Column, most: int = 5000) -> DataFrame:
    """df without generated rows beyond the first ``most`` in an order; other rows stay.

    The cut is found by a distributed top-k, so nothing is numbered in one task.
    """
    cut = df.where(generated).select(order.alias("__o")).orderBy("__o").limit(most).agg(F.max("__o").alias("__cut"))
    return df.join(F.broadcast(cut)).where(~generated | (order <= F.col("__cut"))).drop("__cut")
