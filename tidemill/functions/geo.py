"""Places: distances, and the geographic filter as a decision column."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def coordinate(x: Column) -> Column:
    """A number, or null for what is none."""
    return F.nullif(x.cast("string"), F.lit("")).try_cast("double")


def has_word(text: Column, term: str) -> Column:
    """Whether a term stands in a lower-case text between non-word characters."""
    term = term.strip().lower()
    return text.rlike(rf"(?U)(?<![\w]){re.escape(term)}(?![\w])") if term else F.lit(False)


def _starting(prefix: str):
    return lambda token: token.startswith(prefix)


@dataclass(frozen=True)
class GeoFilter:
    """Groups of places; a candidate passes if any (or all) of the groups that can be judged match."""

    mode: str = "any"
    localities: Sequence[str] = ()
    regions: Sequence[str] = ()
    countries: Sequence[str] = ()
    postal_codes: Sequence[str] = ()
    postal_prefixes: Sequence[str] = ()
    address_contains: Sequence[str] = ()
    radius: tuple[float, float, float] | None = None  # latitude, longitude, kilometres
    box: tuple[float, float, float, float] | None = None  # latitudes, then longitudes, least first
    aliases: Mapping[str, Sequence[str]] = field(default_factory=dict)
    missing: str = "keep"  # or reject, needs_review

    def groups(self, text: Column, lat: Column, lon: Column) -> dict[str, Column]:
        """One column for each configured group: true, false, or null where it can not be judged."""
        out: dict[str, Column] = {}

        def any_of(found: list[Column]) -> Column:
            hit = F.lit(False)
            for c in found:
                hit = hit | c
            return hit

        for name in ("localities", "regions", "countries"):
            terms = [t for term in getattr(self, name) for t in (term, *self.aliases.get(term, ()))]
            if terms:
                out[name] = any_of([has_word(text, t) for t in terms])
        if self.postal_codes or self.postal_prefixes:
            tokens = F.regexp_extract_all(text, F.lit(r"[a-z0-9\-]+"), 0)
            starts = [F.exists(tokens, _starting(p)) for p in (p.strip().lower() for p in self.postal_prefixes) if p]
            out["postal"] = any_of([has_word(text, c) for c in self.postal_codes] + starts)
        if self.address_contains:
            out["address_contains"] = any_of([F.contains(text, F.lit(t.strip().lower())) for t in self.address_contains if t.strip()])
        known = lat.isNotNull() & lon.isNotNull()
        if self.radius:
            out["radius"] = F.when(known, haversine_km(lat, lon, F.lit(self.radius[0]), F.lit(self.radius[1])) <= self.radius[2])
        if self.box:
            out["bounding_box"] = F.when(known, lat.between(*self.box[:2]) & lon.between(*self.box[2:]))
        return out

    def decision(self, address: Column, venue: Column, lat: Column, lon: Column) -> Column:
        """struct(outcome, included, matched): included, excluded, or missing_keep, _reject or _review."""
        text = F.lower(F.concat_ws(" ", F.nullif(address, F.lit("")), F.nullif(venue, F.lit(""))))
        groups = self.groups(text, lat, lon)
        none = F.array().cast("array<string>")
        if not groups:
            return F.struct(F.lit("included").alias("outcome"), F.lit(True).alias("included"), none.alias("matched"))
        judged = F.array_compact(F.array(*groups.values()))
        nowhere = ~text.rlike(r"(?U)\S") & (lat.isNull() | lon.isNull())
        missing = nowhere | (F.size(judged) == 0)
        inside = F.forall(judged, lambda x: x) if self.mode == "all" else F.exists(judged, lambda x: x)
        label = {"reject": "missing_reject", "needs_review": "missing_review"}.get(self.missing, "missing_keep")
        outcome = F.when(missing, label).when(inside, "included").otherwise("excluded")
        matched = F.array_compact(F.array(*(F.when(c, name) for name, c in groups.items())))
        return F.struct(outcome.alias("outcome"), F.when(missing, self.missing != "reject").otherwise(inside).alias("included"), F.when(missing, none).otherwise(matched).alias("matched"))


def last_outcome(history: Column, prefix: str = "geographic:") -> Column:
    """The last tag with a prefix, without it; null without one."""
    tags = F.filter(history, lambda t: t.startswith(prefix))
    return F.substring(F.get(tags, F.size(tags) - 1), len(prefix) + 1, 10_000)
