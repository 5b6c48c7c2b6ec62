"""From raw records to typed candidates: transforms, normalisation, validation, approval."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import dates as D
from tidemill.functions import text as T
from tidemill.functions import urls as U
from tidemill.functions.geo import coordinate


def unicode_normalized(x: Column, form: str = "NFKC") -> Column:
    """A Unicode normal form; Spark has no function for it, so texts go to Python in Arrow batches."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"no such form: {form}")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return run(x)


#: Named transforms: (column, parameters) -> column.  Null stays null.
TRANSFORMS = {
    "trim": lambda x, p: T.trimmed(x),
    "collapse_whitespace": lambda x, p: T.collapsed(x),
    "strip_html": lambda x, p: T.strip_tags(x),
    "unicode_normalize": lambda x, p: unicode_normalized(x, p.get("form", "NFKC")),
    "prepend": lambda x, p: F.concat(F.lit(str(p.get("text", ""))), x),
    "append": lambda x, p: F.concat(x, F.lit(str(p.get("text", "")))),
    "parse_date": lambda x, p: D.parse_date(x, p.get("formats") or ()).cast("string"),
    "parse_time": lambda x, p: D.parse_time(x, p.get("formats") or ()),
    "relative_to_absolute_url": lambda x, p: U.absolute(F.lit(p["base_url"]), x),
    "regex_extract_group": lambda x, p: T.extracted(x, p["pattern"], p.get("group", 1)),
    "literal_replace": lambda x, p: F.replace(x, F.lit(str(p["find"])), F.lit(str(p.get("replace", "")))) if p.get("find") else x,
    "exact_value_map": lambda x, p: F.coalesce(F.create_map(*(F.lit(str(v)) for kv in p["mapping"].items() for v in kv))[x], x) if p.get("mapping") else x,
    "lower": lambda x, p: F.lower(x),
    "upper": lambda x, p: F.upper(x),
}


def transformed(x: Column, rules: Sequence[tuple[str, dict]]) -> tuple[Column, list[str]]:
    """x after the named transforms in order, and their names; unknown names raise."""
    for kind, params in rules:
        x = TRANSFORMS[kind](F.substring(x.cast("string"), 1, T.MAX_INPUT), params)
    return x, [kind for kind, _ in rules]


def normalize(raw: DataFrame, page: str, rules: Mapping[str, Sequence[tuple[str, dict]]] = {}, date_formats: Sequence[str] = (), time_formats: Sequence[str] = (), timezone: str | None = None) -> DataFrame:
    """Typed candidates of raw records, in one projection: no row is added, lost or shuffled.

    Fields that raw lacks are null.  Texts are cleaned, links made absolute against the
    column ``page``, date and time cut apart, offsets dropped with a warning, and a start that is
    no single date is offered to the range grammar.  Adds ``history`` and ``warnings``.
    """
    names = ("title", "description", "venue", "address", "source_category", "external_source_id", "canonical_url", "image", "start_datetime", "end_datetime", "start_time", "end_time", "date_range", "latitude", "longitude")
    value, history = {}, []
    for n in names:
        x = F.col(n).cast("string") if n in raw.columns else F.lit(None).cast("string")
        value[n], ran = transformed(x, rules.get(n, ()))
        history += ran
    clean = {n: T.cleaned(value[n]) for n in ("title", "venue", "address", "source_category")}
    link = lambda n: F.when(value[n] != "", U.absolute(F.col(page), value[n])).otherwise(value[n])
    rest = [c for c in raw.columns if c not in names]
    cut = raw.select(*rest, *(c.alias(n) for n, c in clean.items()), T.html_text(value["description"]).alias("description"), F.nullif(T.trimmed(value["external_source_id"]), F.lit("")).alias("external_source_id"), link("canonical_url").alias("canonical_url"), link("image").alias("image_url"),
                     D.split_datetime(value["start_datetime"]).alias("__a"), D.split_datetime(value["end_datetime"]).alias("__b"), value["start_time"].alias("__at"), value["end_time"].alias("__bt"), value["date_range"].alias("__r"), value["latitude"].alias("__lat"), value["longitude"].alias("__lon"))
    time_a, time_b = F.coalesce(F.nullif("__at", F.lit("")), F.col("__a.time")), F.coalesce(F.nullif("__bt", F.lit("")), F.col("__b.time"))
    parsed = cut.withColumns({"__da": D.parse_date(F.col("__a.day"), date_formats), "__db": D.parse_date(F.col("__b.day"), date_formats), "__ta": time_a, "__tb": time_b})
    explicit = F.coalesce(T.trimmed(F.col("__r")) != "", F.lit(False))
    parsed = parsed.withColumn("__range", D.parse_range(F.when(explicit, F.col("__r")).when(F.col("__da").isNull(), F.col("__a.day"))))
    matched = F.col("__range.form").isNotNull()
    start, end = F.coalesce("__da", F.when(matched, F.col("__range.start"))), F.coalesce("__db", F.when(matched, F.col("__range.end")))
    warn = lambda c, text: F.when(c, text)
    told = F.lit(timezone)
    warnings = F.array_compact(F.array(
        warn(F.col("__range.ambiguous"), F.concat(F.lit("date_range_ambiguous:"), F.col("__range.reason"))),
        warn(F.col("__a.day").isNotNull() & start.isNull(), F.concat(F.lit("unparseable_start_date:"), F.col("__a.day"))), warn(F.col("__b.day").isNotNull() & end.isNull(), F.concat(F.lit("unparseable_end_date:"), F.col("__b.day"))),
        warn(D.has_offset(F.col("__ta")) & D.parse_time(F.col("__ta"), time_formats).isNotNull() & told.isNotNull(), F.lit("conflicting_timezone_info:start_time")), warn(D.has_offset(F.col("__tb")) & D.parse_time(F.col("__tb"), time_formats).isNotNull() & told.isNotNull(), F.lit("conflicting_timezone_info:end_time")),
        warn(F.col("__lat").isNotNull() & coordinate(F.col("__lat")).isNull(), F.concat(F.lit("unparseable_latitude:"), F.col("__lat"))), warn(F.col("__lon").isNotNull() & coordinate(F.col("__lon")).isNull(), F.concat(F.lit("unparseable_longitude:"), F.col("__lon"))),
    ))
    steps = F.array(*map(F.lit, history)) if history else F.array().cast("array<string>")
    past = F.when(matched, F.concat(steps, F.array(F.concat(F.lit("date_range:"), F.col("__range.form"))))).otherwise(steps)
    return parsed.select(
        *rest, "title", "description", "venue", "address", "source_category", "external_source_id", "canonical_url", "image_url", start.alias("start_date"), D.parse_time(F.col("__ta"), time_formats).alias("start_time"), end.alias("end_date"), D.parse_time(F.col("__tb"), time_formats).alias("end_time"),
        told.cast("string").alias("timezone"), coordinate(F.col("__lat")).alias("latitude"), coordinate(F.col("__lon")).alias("longitude"), past.alias("history"), warnings.alias("warnings"),
    )


def present(x: Column) -> Column:
    """Whether a field has a value: neither null nor the empty text."""
    return F.coalesce(x.cast("string") != "", F.lit(False))


def problems(title: Column, start_date: Column, end_date: Column | None = None, start_time: Column | None = None, end_time: Column | None = None, latitude: Column | None = None, longitude: Column | None = None, canonical_url: Column | None = None, description: Column | None = None, required: Mapping[str, Column] = {}) -> dict[str, Column]:
    """Checks of a candidate for ``reasons``: every one that fails is named, none hides another."""
    none = F.lit(None)
    end, lat, lon = (c if c is not None else none for c in (end_date, latitude, longitude))
    out = {"title": ~present(title), "start_date": start_date.isNull()}
    out |= {f"missing_{n}": ~present(c) for n, c in required.items() if n not in ("title", "start_date")}
    if canonical_url is not None:
        out["canonical_url"] = present(canonical_url) & U.public_url_problem(canonical_url).isNotNull()
    out["end_before_start"] = end < start_date
    if start_time is not None and end_time is not None:
        out["end_time_before_start_time"] = (end == start_date) & (end_time < start_time)
    out |= {"latitude": ~lat.between(-90.0, 90.0), "longitude": ~lon.between(-180.0, 180.0), "half_coordinates": lat.isNull() != lon.isNull()}
    if description is not None:
        out["script"] = F.contains(F.lower(description), F.lit("<script"))
    return out


def with_detail(records: DataFrame, details: DataFrame, link: str, fields: Sequence[str], most: int, order: Column) -> DataFrame:
    """records with fields of their detail pages, each distinct link once and only the first ``most`` links of the order; a page's value goes before the listing's.

    details: link, ok and the fields.  Adds ``detail``: used, failed, skipped or none.
    """
    first = records.where(F.col(link).isNotNull()).groupBy(link).agg(F.min(order).alias("__o")).orderBy("__o", link).limit(most).select(link, F.lit(True).alias("__in"))
    pages = details.select(link, F.col("ok").alias("__ok"), *(F.col(f).alias(f"__{f}") for f in fields))
    out = records.join(first, link, "left").join(pages, link, "left")
    used = F.coalesce(F.col("__in") & F.col("__ok"), F.lit(False))
    state = F.when(F.col(link).isNull(), "none").when(F.col("__in").isNull(), "skipped").when(used, "used").otherwise("failed")
    return out.withColumns({f: F.when(used, F.coalesce(F.col(f"__{f}"), F.col(f))).otherwise(F.col(f)) for f in fields} | {"detail": state}).drop("__in", "__ok", *(f"__{f}" for f in fields))
