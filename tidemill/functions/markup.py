"""Structure of HTML pages in SQL functions: tags in one pass, elements with parents, depths and reaches.

``elements`` folds over the tags of a page with a stack of what is open.  Void elements hold
nothing; list items, cells, rows, options and paragraphs end where the next one, or for a
paragraph a block, begins; an end tag closes what it names and all that is open inside; what is
never closed ends with the page.  A slash at the end of a tag closes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import collapsed, let

_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\z)|<![^>]*>"
_TAG = r"""(?s)</?[a-zA-Z](?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+>[^<]*+"""
_NAME = r"^</?([a-zA-Z][^\s/>]*)"

# Element names by how they end.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var")
BLOCKS = ("address", "article", "aside", "blockquote", "dir", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")
#: What a new element ends, and what keeps it from looking further.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table", "thead", "tbody", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select", "datalist"))}

_OPEN = "array<struct<id:int,name:string>>"
_ELEMENT = "array<struct<id:int,parent:int,depth:int,tag:string,source:string,start:int>>"
_REACH = "array<struct<id:int,last:int,stop:int>>"


def tags(page: Column) -> Column:
    """array<struct(name, closing, source, text)> of all tags with the text after each; comments, scripts and styles are left out."""
    every = F.regexp_extract_all(F.regexp_replace(F.coalesce(page, F.lit("")), _HIDDEN, " "), F.lit(_TAG), F.lit(0))
    return F.transform(every, lambda t: F.struct(F.lower(F.regexp_extract(t, _NAME, 1)).alias("name"), t.startswith("</").alias("closing"), t.alias("source")))


def _ended(stack: Column, name: Column) -> Column:
    """How many open elements stay when an element of a name begins."""
    n = F.size(stack)

    def until(ends: tuple[str, ...], stops: Column | None) -> Column:
        place = lambda x, i: F.when(x["name"].isin(*ends), i + 1).when(stops(x) if stops else F.lit(False), -(i + 1))
        marks = F.array_compact(F.transform(stack, place))
        return let(F.element_at(F.concat(F.array(F.lit(-1)), marks), -1), lambda m: F.when(m > 0, m - 1).otherwise(n))

    out = F.when(name.isin(*BLOCKS), until(("p",), lambda x: ~x["name"].isin(*INLINE)))
    for opened, (ends, stops) in ENDS.items():
        out = out.when(name == opened, until(ends, lambda x, s=stops: x["name"].isin(*s)))
    return out.otherwise(n)


def _closed(stack: Column, name: Column) -> Column:
    """How many open elements stay after an end tag; all if it names none of them."""
    places = F.array_compact(F.transform(stack, lambda x, i: F.when(x["name"] == name, i)))
    return F.coalesce(F.get(places, F.size(places) - 1), F.size(stack))


def elements(every: Column) -> Column:
    """array<struct(id, parent, depth, tag, source, start, last, stop)> from an array of ``tags``.

    Ids count from 1 in page order, 0 is the parent of outermost elements; ``last`` is the last
    element inside, and the tags start .. stop - 1 are those inside, the element's own first.
    """
    begin = F.struct(F.array().cast(_OPEN).alias("stack"), F.array().cast(_ELEMENT).alias("out"), F.array().cast(_REACH).alias("ends"), F.lit(0).alias("at"))

    def step(acc: Column, t: Column) -> Column:
        stay = F.when(t["closing"], _closed(acc["stack"], t["name"])).otherwise(_ended(acc["stack"], t["name"]))
        return let(stay, lambda kept: _after(acc, t, kept))

    def _after(acc: Column, t: Column, kept: Column) -> Column:
        stack, out, at = acc["stack"], acc["out"], acc["at"]
        gone = F.transform(F.slice(stack, kept + 1, F.size(stack) - kept), lambda x: F.struct(x["id"].alias("id"), F.size(out).alias("last"), at.alias("stop")))
        left, number = F.slice(stack, F.lit(1), kept), F.size(out) + 1
        new = F.array(F.struct(number.alias("id"), F.coalesce(F.get(stack, kept - 1)["id"], F.lit(0)).alias("parent"), (kept + 1).alias("depth"), t["name"].alias("tag"), t["source"].alias("source"), at.alias("start")))
        void = t["name"].isin(*VOID)
        return F.struct(
            F.when(t["closing"] | void, left).otherwise(F.concat(left, F.array(F.struct(number.alias("id"), t["name"].alias("name"))))).cast(_OPEN).alias("stack"),
            F.when(t["closing"], out).otherwise(F.concat(out, new)).cast(_ELEMENT).alias("out"),
            F.concat(acc["ends"], gone, F.when(~t["closing"] & void, F.array(F.struct(number.alias("id"), number.alias("last"), at.alias("stop")))).otherwise(F.array().cast(_REACH))).cast(_REACH).alias("ends"),
            (at + 1).alias("at"),
        )

    def finished(acc: Column) -> Column:
        rest = F.transform(acc["stack"], lambda x: F.struct(x["id"].alias("id"), F.size(acc["out"]).alias("last"), acc["at"].alias("stop")))
        return let(F.array_sort(F.concat(acc["ends"], rest)), lambda ends: F.transform(acc["out"], lambda e, i: F.struct(e["id"].alias("id"), e["parent"].alias("parent"), e["depth"].alias("depth"), e["tag"].alias("tag"), e["source"].alias("source"), e["start"].alias("start"), F.get(ends, i)["last"].alias("last"), F.get(ends, i)["stop"].alias("stop"))))

    return F.aggregate(every, begin, step, finished)


def attribute(source: Column, name: str) -> Column:
    """The value of an attribute in a tag's source, quoted or not; null without one."""
    pattern = rf"""(?is)^</?[a-z][^\s/>]*+[\s/]*+(?:[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+[\s/]*+)*?(?<![^\s"'/]){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    return let(F.regexp_extract(source, pattern, 1), lambda v: F.when(v != "", F.regexp_replace(v, r"""^["']|["']$""", "")))


def classes(source: Column) -> Column:
    """Different class names of a tag, in order of name."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(attribute(source, "class"), F.lit("")), r"\s+"), lambda c: c != "")))


def shape(every: Column, e: Column) -> Column:
    """A hash of the subtree of an element: names and relative depths of all that it holds, in order."""
    inside = F.slice(every, e["id"], e["last"] - e["id"] + 1)
    return F.xxhash64(F.array_join(F.transform(inside, lambda x: F.concat_ws(":", (x["depth"] - e["depth"]).cast("string"), x["tag"])), " "))


def text_inside(every_tag: Column, e: Column) -> Column:
    """The text of an element, collapsed."""
    return collapsed(F.array_join(F.transform(F.slice(every_tag, e["start"] + 1, e["stop"] - e["start"]), lambda t: F.regexp_replace(t["source"], r"(?s)^<.*?>", " ")), " "))
