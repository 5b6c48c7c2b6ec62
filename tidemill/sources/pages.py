"""Paged sources: the next request of each page, what ends a run, and prose that holds dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import dates as D
from tidemill.functions.text import let
from tidemill.functions.urls import absolute, with_param
from tidemill.operators.relational import first_wins, until_stop
from tidemill.sources.records import kind_of, value


def next_page(kind: str, url: Column, page: Column, body: Column | None = None, total_pages: Column | None = None, param: str = "page", size: Column | None = None, size_param: str = "offset") -> Column:
    """The next request of a page, numbered from 0, or null at the end.

    none; query (page number); pages (until a header's total); link (rel=next in the page);
    body (next_rest_url of a JSON body); offset (by the number of records of the page).
    """
    if kind == "none":
        return F.lit(None).cast("string")
    if kind == "query":
        return with_param(url, param, page + 2)
    if kind == "pages":
        return F.when(page + 2 <= F.coalesce(total_pages, F.lit(0)), with_param(url, param, page + 2))
    if kind == "link":
        tag = F.regexp_extract(F.coalesce(body, F.lit("")), r"""(?is)<(?:a|link)\b[^>]*\brel\s*=\s*["']next["'][^>]*>""", 0)
        href = F.regexp_extract(tag, r"""(?is)href\s*=\s*["']([^"']+)["']""", 1)
        return F.when(href != "", absolute(url, href))
    if kind == "body":
        return value(F.try_parse_json(body), "next_rest_url")
    if kind == "offset":
        now = F.coalesce(F.regexp_extract(url, rf"[?&]{size_param}=(\d+)", 1).try_cast("bigint"), F.lit(0))
        return F.when(F.coalesce(size, F.lit(0)) > 0, with_param(url, size_param, now + size))
    raise ValueError(f"no such pagination: {kind}")


def total_at(body: Column, path: str) -> Column:
    """A whole number at a path of a JSON body; true and false are none."""
    doc = F.try_parse_json(body)
    return F.when(kind_of(doc, path).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), value(doc, path, "bigint"))


def run_records(records: DataFrame, source: str, page: str, idx: str, node_hash: str, most: int, page_size: int | None = None) -> DataFrame:
    """Records of a paged run in order: each once, up to the page that ends the run, and at most ``most`` of a source.

    A page ends the run if it has no new record or is shorter than ``page_size``.  Adds
    ``truncated``: whether the cap cut the source.
    """
    firsts = first_wins(records, [source, node_hash], [F.col(page), F.col(idx)])
    sizes = records.groupBy(source, page).agg(F.count("*").alias("__n"))
    fresh = firsts.groupBy(source, page).agg(F.count("*").alias("__new"))
    pages = sizes.join(fresh, [source, page], "left")
    stop = F.col("__new").isNull() | (F.col("__n") < (page_size or 0))
    open_pages = until_stop(pages, source, [F.col(page)], stop).select(source, page)
    kept = firsts.join(open_pages, [source, page], "left_semi")
    w = Window.partitionBy(source).orderBy(page, idx)
    ranked = kept.withColumn("__rank", F.row_number().over(w)).withColumn("truncated", F.count("*").over(Window.partitionBy(source)) > most)
    return ranked.where(F.col("__rank") <= most).drop("__rank")


def request_window(day: Column, zone: str, days: int) -> Column:
    """struct(start, end) of the window a recurring request asks for: local days in UTC, the end at its last millisecond."""
    return D.day_bounds_utc(day, zone, days)


def safe_headers(headers: Column, allowed: Sequence[str] = ("accept", "accept-language", "content-type", "origin", "referer", "x-requested-with")) -> Column:
    """Only the named headers of a map, in lower case: nothing that identifies a session."""
    return F.map_filter(F.transform_keys(headers, lambda k, _: F.lower(k)), lambda k, _: k.isin(*allowed))


def text_recurrence(text: Column, start: Column, today: Column | None = None) -> Column:
    """Dates of prose like "weekly until May 3": steps of a day, a week or a month from the start to the end, which is
    less than a year away; the start alone without such words.

    A month without the day takes its 28th, and so do all after it.  With ``today``, days before it
    are left out, and the start stands alone if none is left.
    """
    m = r"(?is)^.*?\b(daily|weekly|monthly)\b.*?\b(?:until|through|thru)\s+([A-Za-z]+)\.?\s+(\d{1,2}).*$"
    words = F.when(text.rlike(m), F.split(F.regexp_replace(text, m, "$1|$2|$3"), r"\|"))

    def dates(w: Column, end: Column) -> Column:
        unit, day = F.lower(F.get(w, 0)), F.day(start)
        first = F.trunc(start, "MM")
        months = F.transform(F.sequence(F.lit(0), F.months_between(F.trunc(end, "MM"), first).cast("int")), lambda i: F.add_months(first, i))
        short = F.array_position(F.transform(months, lambda x: F.day(F.last_day(x)) < day), F.lit(True))  # 0: no month is too short
        monthly = let(months, lambda ms: F.transform(ms, lambda x, i: F.date_add(x, F.when((short == 0) | (i + 1 < short), day - 1).otherwise(27))))
        every = F.when(unit == "daily", F.sequence(start, end, F.expr("INTERVAL 1 DAY"))).when(unit == "weekly", F.sequence(start, end, F.expr("INTERVAL 7 DAY"))).otherwise(F.filter(monthly, lambda x: x <= end))
        left = every if today is None else F.filter(every, lambda x: x >= today)
        return F.when(end >= start, let(left, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(start)))).otherwise(F.array(start))

    def ended(w: Column) -> Column:
        at = lambda years: D.built_date(F.year(start) + years, D.month_number(F.get(w, 1)), F.get(w, 2).try_cast("int"))
        leap = F.when(at(1) < F.add_months(start, 12), at(1))  # 29 February may stand in the next year only
        return let(at(0), lambda this: F.when(this >= start, this).when(this < start, F.add_months(this, 12)).otherwise(leap))  # a day before the start is one of next year

    return let(words, lambda w: let(ended(w), lambda end: F.coalesce(dates(w, end), F.array(start))))


def dated_lines(df: DataFrame, key: str, text: str, published: str) -> DataFrame:
    """key, line and day of every dated part of an article, parts cut at ; and line ends; undated parts give nothing."""
    parts = df.select(key, published, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"[;\n]")).alias("line", "part"))
    return parts.select(key, "line", F.explode(D.prose_dates(F.col("part"), F.col(published))).alias("day"))


def prose_day(text: Column) -> Column:
    """The date in prose like "on October 10, 2026"; null without one."""
    found = F.regexp_extract(text, r"(?i)\bon\s+([A-Za-z]+\.?\s+\d{1,2},\s*\d{4})", 1)
    return D.parse_range(F.nullif(found, F.lit(""))).getField("start")


def class_value(classes: Column, prefix: str) -> Column:
    """What follows a prefix in the first class that has it."""
    return F.substring(F.get(F.filter(classes, lambda c: c.startswith(prefix)), 0), len(prefix) + 1, 1000)


def local_place(town: Column, state: Column, towns: Sequence[str], wanted: str) -> Column:
    """Whether a place is local: a named town in the state; an unknown town passes."""
    known = F.nullif(F.trim(town), F.lit("")).isNotNull()
    return ~known | (F.lower(F.trim(town)).isin(*[t.lower() for t in towns]) & (F.coalesce(F.upper(F.trim(state)), F.lit(wanted)) == wanted))


def internal_event(title: Column, description: Column, group: Column, groups: Sequence[str], prefixes: Sequence[str], parts: Sequence[str], marks: Sequence[str], course: str = r"\b[A-Z]{2,5}-[A-Z]?\s?\d{3,4}\b") -> Column:
    """Whether an entry is for insiders: its group, the beginning or a part of its title, a course code, or a mark in its description."""
    low = F.lower(F.coalesce(title, F.lit("")))
    out = F.coalesce(group.isin(*groups), F.lit(False)) | F.coalesce(title.rlike(course), F.lit(False))
    for p in prefixes:
        out = out | low.startswith(p.lower())
    for p in parts:
        out = out | F.contains(low, F.lit(p.lower()))
    for m in marks:
        out = out | F.contains(F.lower(F.coalesce(description, F.lit(""))), F.lit(m.lower()))
    return out
