"""Records from repeated elements of web pages, picked by CSS selectors.

One page is one small Python call: its elements are read with the standard parser, and a
closed subset of CSS finds cards and fields (names, .class, #id, [attribute] with = ^= $= *=,
descendants, > and commas).  Spark deals out the pages.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "canonical_url", "description", "start_datetime", "start_time", "end_datetime", "end_time", "venue", "address", "image", "source_category", "external_source_id", "detail_link")
LINKS = ("canonical_url", "image", "detail_link")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_PART = re.compile(r"(?P<name>\*|[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[*^$]?=)\s*(?:\"(?P<q1>[^\"]*)\"|'(?P<q2>[^']*)'|(?P<q3>[^\]\s]+))\s*)?\]")


class _Element:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: _Element | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def below(self) -> Iterator[_Element]:
        todo = [c for c in reversed(self.children) if isinstance(c, _Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [c for c in reversed(e.children) if isinstance(c, _Element)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out.append(e.strip())
            elif e.name not in ("script", "style"):
                todo += reversed(e.children)
        return " ".join(t for t in out if t)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        e = _Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        e = self.at
        while e.parent is not None and e.name != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parsed(selector: str) -> list[list[tuple[str, list[dict]]]]:
    """A selector as alternatives of steps (combinator, conditions); ValueError for what the subset lacks."""
    if not selector.strip() or len(selector) > 500:
        raise ValueError("a selector has 1 to 500 characters")
    out = []
    for one in selector.split(","):
        steps, joint, at, one = [], " ", 0, re.sub(r"\s*>\s*", ">", one.strip())
        if not one:
            raise ValueError(f"empty selector in {selector!r}")
        while at < len(one):
            if one[at] in " >":
                joint, at = (">" if one[at] == ">" else " "), at + 1
                continue
            tests = []
            while at < len(one) and one[at] not in " >":
                m = _PART.match(one, at)
                if not m:
                    raise ValueError(f"can not read {one[at:]!r}")
                tests.append({k: v for k, v in m.groupdict().items() if v is not None})
                at = m.end()
            steps.append((joint, tests))
            joint = " "
        out.append(steps)
    return out


def _meets(e: _Element, tests: list[dict]) -> bool:
    for t in tests:
        if "name" in t and t["name"] not in ("*", e.name):
            return False
        if "cls" in t and t["cls"] not in e.attrs.get("class", "").split():
            return False
        if "id" in t and e.attrs.get("id") != t["id"]:
            return False
        if "attr" in t:
            have, want = e.attrs.get(t["attr"]), t.get("q1") or t.get("q2") or t.get("q3") or ""
            op = t.get("op")
            if have is None or (op == "=" and have != want) or (op == "^=" and not have.startswith(want)) or (op == "$=" and not have.endswith(want)) or (op == "*=" and want not in have):
                return False
    return True


def _fits(e: _Element, steps: list, n: int) -> bool:
    """Whether e meets the last of the first n steps, and its ancestors the ones before."""
    joint, tests = steps[n - 1]
    if not _meets(e, tests):
        return False
    if n == 1:
        return True
    up = e.parent
    while up is not None and up.name:
        if _fits(up, steps, n - 1):
            return True
        if joint == ">":
            return False
        up = up.parent
    return False


def select(top: _Element, alternatives: list) -> Iterator[_Element]:
    return (e for e in top.below() if any(_fits(e, steps, len(steps)) for steps in alternatives))


def page_cards(html: str, url: str, container: list, fields: Mapping[str, tuple[list, str | None]]) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    out = []
    for i, card in enumerate(select(reader.root, container)):
        row: dict = {"idx": i}
        for name, (selector, attribute) in fields.items():
            found = next(select(card, selector), None)
            value = None if found is None else found.attrs.get(attribute) if attribute else found.text() or None
            row[name] = urljoin(url or "", value) if value and name in LINKS else value
        row["node_hash"] = hashlib.sha256(card.text().encode() + repr(sorted(card.attrs.items())).encode()).hexdigest()
        out.append(row)
    return out


def cards(df: DataFrame, key: str, html: str, url: str, container: str, fields: Mapping[str, str], page_url_as_link: bool = False) -> DataFrame:
    """key, idx, node_hash and a column for each field of every card; fields: name -> "selector" or "selector@attribute"."""
    boxes = parsed(container)
    wanted = {}
    for name, s in fields.items():
        if name not in FIELDS:
            raise ValueError(f"no such field: {name}")
        selector, _, attribute = s.partition("@")
        wanted[name] = parsed(selector), attribute or None
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"k": k} | r for k, h, u in zip(b["k"], b["h"], b["u"], strict=True) for r in page_cards(h, u, boxes, wanted)]
            yield pd.DataFrame(rows, columns=["k", "idx", "node_hash", *wanted])

    pages = df.select(F.col(key).alias("k"), F.col(html).alias("h"), F.col(url).alias("u"))
    out = pages.mapInPandas(run, f"k {kind}, idx int, node_hash string, " + ", ".join(f"{n} string" for n in wanted))
    if page_url_as_link and "canonical_url" in wanted:
        out = out.join(pages.select("k", "u"), "k").withColumn("canonical_url", F.coalesce(F.nullif("canonical_url", F.lit("")), "u")).drop("u")
    return out.withColumnRenamed("k", key)
