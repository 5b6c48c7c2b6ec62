"""Predicates and small decisions of single rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import trimmed


def legacy_visible(day: Column, end: Column, today: str, sentinel: str = "Multiple Dates") -> Column:
    """Old listings: no date, the sentinel text, or a start or end that is not over; dates are ISO texts."""
    return day.isNull() | (day == sentinel) | (F.coalesce(day >= today, F.lit(False))) | F.coalesce(end >= today, F.lit(False))


def geocode_wanted(lat: Column, venue: Column, address: Column) -> Column:
    """Whether a row has no coordinates but a place to look up."""
    given = lambda c: F.coalesce(trimmed(c) != "", F.lit(False))
    return lat.isNull() & (given(venue) | given(address))


def geocode_skip(lat: Column, corrected: Column, address: Column, attempts: Column, most: int = 3) -> Column:
    """Why a row is not looked up, the first reason that holds; null if it is."""
    return F.when(corrected.isNotNull(), "corrected").when(lat.isNotNull(), "has_coordinates").when(~F.coalesce(trimmed(address) != "", F.lit(False)), "no_address").when(attempts >= most, "too_many_attempts")


def unresolved(override: Column, category: Column) -> Column:
    return F.coalesce(override, category).isNull()


def kept_by_tag(history: Column, drop: Sequence[str] = ("excluded", "missing_reject"), review: Sequence[str] = ("missing_review",), prefix: str = "geographic:") -> Column:
    """keep, drop or review by the last tag with a prefix; without one the row is kept."""
    from tidemill.functions.geo import last_outcome

    last = last_outcome(history, prefix)
    return F.when(last.isin(*drop), "drop").when(last.isin(*review), "review").otherwise("keep")


def card_filter(source: Column, category: Column, text: Column, start: Column, end: Column, sources: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = (), words: str = "", low: str | None = None, high: str | None = None) -> Column:
    """A client's filters: an empty list includes all, excluded categories go, every word must be in the text, dates overlap."""
    out = F.lit(True)
    if sources:
        out = out & source.isin(*sources)
    if include:
        out = out & category.isin(*include)
    if exclude:
        out = out & ~F.coalesce(category.isin(*exclude), F.lit(False))
    for w in words.lower().split():
        out = out & F.contains(F.lower(text), F.lit(w))
    if low is not None:
        out = out & (F.coalesce(end, start) >= F.lit(low).cast("date"))
    if high is not None:
        out = out & (start <= F.lit(high).cast("date"))
    return F.coalesce(out, F.lit(False))
