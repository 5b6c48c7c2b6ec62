"""The closed set of extractors by name; what is not in it can not be configured."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidemill.sources import cards, records


@dataclass(frozen=True)
class Pattern:
    """An extractor with what a form has to show: its name, a label, its options and those it can not do without."""

    name: str
    label: str
    extract: Callable[..., DataFrame]
    options: tuple[str, ...] = ()
    required: tuple[str, ...] = ()


@dataclass
class Registry:
    patterns: dict[str, Pattern] = field(default_factory=dict)

    def add(self, pattern: Pattern) -> None:
        if pattern.name in self.patterns:
            raise ValueError(f"{pattern.name} is registered already")
        self.patterns[pattern.name] = pattern

    def get(self, name: str) -> Pattern:
        if name not in self.patterns:
            raise KeyError(f"no such pattern: {name}")
        return self.patterns[name]

    def extract(self, name: str, df: DataFrame, key: str, body: str, **options) -> DataFrame:
        """Records of the documents of df by a named pattern; options it does not know, or lacks, raise."""
        p = self.get(name)
        if unknown := set(options) - set(p.options):
            raise ValueError(f"{name} has no option {sorted(unknown)}")
        if missing := set(p.required) - set(options):
            raise ValueError(f"{name} needs {sorted(missing)}")
        return p.extract(df, key, body, **options)

    def choices(self) -> list[tuple[str, str]]:
        return sorted((p.name, p.label) for p in self.patterns.values())


REGISTRY = Registry()
for _p in (
    Pattern("wordpress_rest", "Posts of a content system", records.posts, ("paths",)), Pattern("the_events_calendar", "Calendar entries", records.calendar, ("paths",)), Pattern("livewhale_json", "Offset feed", records.offset_feed, ("paths",)),
    Pattern("simpleview_events", "Nested documents", records.nested_docs, ("root", "paths")), Pattern("algolia_search", "Search hits", records.hits, ("root", "paths")), Pattern("json_ld_event", "Linked data", records.linked_data, ("page_url", "offers_as_url", "paths")),
    Pattern("next_data", "Data of a rendered page", records.page_data, ("root", "element", "paths"), ("root",)), Pattern("nuxt_payload", "Data of a rendered page", lambda df, key, body, **o: records.page_data(df, key, body, element="__NUXT_DATA__", **o), ("root", "paths"), ("root",)),
    Pattern("embedded_json", "JSON scripts", records.script_json, ("root", "paths")), Pattern("ics_calendar", "iCalendar", records.calendar_file), Pattern("rss_atom_events", "RSS and Atom", records.feed, ("start_element", "end_element")),
    Pattern("generic_html_cards", "Repeated elements", lambda df, key, body, **o: cards.cards(df, key, body, **o), ("url", "container", "fields", "page_url_as_link"), ("url", "container", "fields")),
):
    REGISTRY.add(_p)
