"""All queries of the package, by theme."""

from __future__ import annotations

from tidemill.plans import bindings, discovery, engagement, geo_rules, inference, listing, onboarding, records, rules, sinks, structure, timed, values, writes  # noqa: F401
from tidemill.plans.registry import ORACLES, QUERIES  # noqa: F401
