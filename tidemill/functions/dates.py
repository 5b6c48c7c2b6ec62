"""Date and time functions as Column -> Column expressions.  None raises: what can not be read is null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import MAX_INPUT, collapsed, let, trimmed

# Month and weekday names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_SHORT_MONTHS = tuple(m[:3] for m in MONTHS) + ("sept",)
_SHORT_DAYS = tuple(d[:3] for d in WEEKDAYS) + ("tues", "thur", "thurs")
_MONTH = "|".join(sorted({*MONTHS, *_SHORT_MONTHS}, key=lambda m: (-len(m), m)))
_DAY = "|".join(sorted({*WEEKDAYS, *_SHORT_DAYS}, key=lambda d: (-len(d), d)))
_ISO = r"\d{4}-\d{2}-\d{2}"
_SIDE = rf"(?i)^\s*(?:(?:{_DAY})\.?\s*,?\s+)?(?:({_MONTH})\.?\s+)?(\d{{1,2}})(?:\s*[,/]?\s*(\d{{4}}))?\s*$"
_SPLIT = r"(?i)\s*[-–—]\s*|\s+to\s+"


def month_number(name: Column) -> Column:
    """1 to 12 for a full, three-letter or "sept" month name in any case, otherwise null."""
    at = F.array_position(F.array(*map(F.lit, (m[:3] for m in MONTHS))), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, at).cast("int")


def built_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is none."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull() & (year > 0), text.try_cast("date"))


def iso_date(x: Column) -> Column:
    """The date in the first ten characters, if these are exactly yyyy-mm-dd."""
    head = F.substring(trimmed(x), 1, 10)
    return F.when(head.rlike(rf"^{_ISO}$"), head.try_cast("date"))


# What each directive of a date format matches.
_DIRECTIVES = {
    "%Y": r"(?<Y>\d{4})", "%y": r"(?<y>\d{2})", "%m": r"(?<m>1[0-2]|0[1-9]|[1-9])", "%d": r"(?<d>3[01]|[12]\d|0[1-9]|[1-9])",
    "%B": "(?<B>" + "|".join(MONTHS) + ")", "%b": "(?<b>" + "|".join(m[:3] for m in MONTHS) + ")",
    "%A": "(?:" + "|".join(WEEKDAYS) + ")", "%a": "(?:" + "|".join(d[:3] for d in WEEKDAYS) + ")",
    "%H": r"(?<H>2[0-3]|[01]\d|\d)", "%I": r"(?<I>1[0-2]|0[1-9]|[1-9])", "%M": r"(?<M>[0-5]\d|\d)", "%S": r"(?<S>6[01]|[0-5]\d|\d)", "%p": "(?<p>am|pm)",
}


def _pattern(fmt: str) -> tuple[str, dict[str, int]]:
    """A format as a pattern, and the group of each directive in it."""
    out, groups, i = "", {}, 0
    while i < len(fmt):
        if fmt[i] == "%" and fmt[i : i + 2] in _DIRECTIVES:
            part = _DIRECTIVES[fmt[i : i + 2]]
            if "(?<" in part:
                groups[fmt[i + 1]] = len(groups) + 1
                part = "(" + part.split(">", 1)[1]
            out += part
            i += 2
        elif fmt[i].isspace():
            out += r"\s+"
            i += 1
        else:
            out += fmt[i] if fmt[i].isalnum() else "\\" + fmt[i]
            i += 1
    return f"(?i)^{out}$", groups


def _field(x: Column, pattern: str, groups: dict[str, int], name: str) -> Column | None:
    return F.regexp_extract(x, pattern, groups[name]) if name in groups else None


def _in_format(x: Column, fmt: str) -> Column:
    pattern, groups = _pattern(fmt)
    get = lambda n: _field(x, pattern, groups, n)
    year = get("Y").try_cast("int") if "Y" in groups else F.lit(1900)
    if "y" in groups:  # two digits: 69 to 99 are of the last century
        short = get("y").try_cast("int")
        year = short + F.when(short >= 69, 1900).otherwise(2000)
    month = month_number(get("B") if "B" in groups else get("b")) if groups.keys() & {"B", "b"} else get("m").try_cast("int") if "m" in groups else F.lit(1)
    day = get("d").try_cast("int") if "d" in groups else F.lit(1)
    return F.when(x.rlike(pattern), built_date(year, month, day))


def parse_date(x: Column, formats: Sequence[str] = ()) -> Column:
    """The date of a text by the first format that fits it whole, else as yyyy-mm-dd at its start."""
    text = trimmed(F.substring(x, 1, MAX_INPUT))
    return F.coalesce(*(_in_format(text, f) for f in formats), iso_date(text))


def parse_time(x: Column, formats: Sequence[str] = ()) -> Column:
    """HH:mm:ss of a text by the first format that fits it, else as an ISO time with or without an offset."""
    text = trimmed(F.substring(x, 1, MAX_INPUT))
    found = []
    for fmt in formats:
        pattern, groups = _pattern(fmt)
        get = lambda n, p=pattern, g=groups: F.coalesce(_field(text, p, g, n).try_cast("int"), F.lit(0)) if n in g else F.lit(0)
        if "I" in groups:
            pm = F.lower(_field(text, pattern, groups, "p")) == "pm" if "p" in groups else F.lit(False)
            hour = get("I") % 12 + F.when(pm, 12).otherwise(0)
        else:
            hour = get("H")
        found.append(F.when(text.rlike(pattern) & (get("S") < 60), F.format_string("%02d:%02d:%02d", hour, get("M"), get("S"))))
    iso = r"^T?([01]\d|2[0-3])(?::?([0-5]\d)(?::?([0-5]\d)(?:[.,]\d+)?)?)?(?:Z|[+-]([01]\d|2[0-3])(?::?[0-5]\d)?)?$"
    part = lambda n: F.coalesce(F.regexp_extract(text, iso, n).try_cast("int"), F.lit(0))
    found.append(F.when(text.rlike(iso), F.format_string("%02d:%02d:%02d", part(1), part(2), part(3))))
    return F.coalesce(*found)


def has_offset(x: Column) -> Column:
    return F.coalesce(trimmed(x).rlike(r"(?:Z|[+-]\d{2}(?::?\d{2})?)$"), F.lit(False))


def split_datetime(x: Column) -> Column:
    """struct(day, time): cut at a T right after yyyy-mm-dd, otherwise all of it is the day."""
    cut = rf"(?s)^({_ISO})T(.*)$"
    is_iso = x.rlike(cut)
    return F.struct(F.when(is_iso, F.regexp_extract(x, cut, 1)).otherwise(F.nullif(x, F.lit(""))).alias("day"), F.when(is_iso, F.nullif(F.regexp_extract(x, cut, 2), F.lit(""))).alias("time"))


def parse_range(x: Column) -> Column:
    """struct(start, end, form, ambiguous, reason) of one date or an explicit range.

    A part that neither side states is never made up: such values have a reason instead.
    The end may take the month of the start; the year is shared both ways.
    """
    return let(collapsed(F.coalesce(x.cast("string"), F.lit(""))), lambda t: let(_tokens(t), lambda p: let(_decision(t, p), lambda d: _range(p, d))))


_ISO_TWO = rf"(?i)^({_ISO})\s*(?:/|to|–|—|-)\s*({_ISO})$"


def _side(t: Column) -> Column:
    """struct(month, day, year) of one side of a range, each null if not stated; null if it is no day."""
    read = F.when(t.rlike(_SIDE), F.split(F.regexp_replace(t, _SIDE, "$1|$2|$3"), r"\|"))  # one capture for all groups
    get = lambda g, n: F.nullif(F.get(g, n), F.lit(""))
    return let(read, lambda g: F.when(g.isNotNull(), F.struct(month_number(get(g, 0)).alias("month"), get(g, 1).try_cast("int").alias("day"), get(g, 2).try_cast("int").alias("year"))))


def _tokens(text: Column) -> Column:
    """struct(kind, one, two, left, right, both): what a collapsed text is made of."""
    two = F.when(text.rlike(_ISO_TWO), F.split(F.regexp_replace(text, _ISO_TWO, "$1|$2"), r"\|"))
    sides = F.split(text, _SPLIT, 2)
    kind = lambda iso, parts: F.when(text == "", "empty").when(iso.isNotNull(), "iso_range").when(text.rlike(rf"^{_ISO}$"), "iso_single").when(F.size(parts) == 2, "two").otherwise("one")
    described = lambda s: F.struct(
        kind(s["iso"], s["parts"]).alias("kind"), F.coalesce(F.get(s["iso"], 0), text).try_cast("date").alias("first"), F.get(s["iso"], 1).try_cast("date").alias("second"), _side(F.get(s["parts"], 0)).alias("left"), _side(F.get(s["parts"], 1)).alias("right"),
    )
    return let(F.struct(two.alias("iso"), sides.alias("parts")), described)


def _decision(text: Column, p: Column) -> Column:
    """struct(start, end, month, year, other_year): the days of both sides with what they share."""
    left, right = p["left"], p["right"]
    shared = F.struct(left["month"].alias("lm"), F.coalesce(right["month"], left["month"]).alias("rm"), F.coalesce(left["year"], right["year"]).alias("ly"), F.coalesce(right["year"], left["year"]).alias("ry"))
    iso = p["kind"].isin("iso_range", "iso_single")
    return let(
        shared,
        lambda s: F.struct(
            F.when(iso, p["first"]).when(p["kind"] == "two", built_date(s["ly"], s["lm"], left["day"])).otherwise(built_date(left["year"], s["lm"], left["day"])).alias("start"),
            F.when(p["kind"] == "iso_range", p["second"]).when(p["kind"] == "two", built_date(s["ry"], s["rm"], right["day"])).alias("end"),
            s["lm"].alias("lm"), s["rm"].alias("rm"), s["ly"].alias("ly"), s["ry"].alias("ry"),
        ),
    )


def _range(p: Column, d: Column) -> Column:
    """One decision table over the kind of a text."""
    kind, reversed_ = p["kind"], d["end"] < d["start"]
    lost = d["start"].isNull() | (d["end"].isNull() & kind.isin("iso_range", "two"))
    two = F.when(p["left"].isNull() | p["right"].isNull(), "unparseable").when(d["lm"].isNull() | d["rm"].isNull(), "missing_month").when(d["ly"].isNull() | d["ry"].isNull(), "missing_year").when(lost, "invalid_date").when(reversed_, "reversed_range")
    one = F.when(p["left"].isNull(), "unparseable").when(d["lm"].isNull(), "missing_month").when(p["left"]["year"].isNull(), "missing_year").when(lost, "invalid_date")
    iso = F.when(lost, "invalid_iso_date").when(reversed_, "reversed_range")
    reason = F.when(kind == "empty", "empty").when(kind.isin("iso_range", "iso_single"), iso).when(kind == "two", two).otherwise(one)
    years = p["left"]["year"].isNotNull() & p["right"]["year"].isNotNull()
    form = F.when(kind == "two", F.when(years, "explicit_both").when(p["right"]["month"].isNull(), "shared_month_year").otherwise("shared_year")).when(kind == "one", "single").otherwise(kind)
    return let(reason, lambda r: F.struct(F.when(r.isNull(), d["start"]).alias("start"), F.when(r.isNull(), d["end"]).alias("end"), F.when(r.isNull(), form).alias("form"), (r.isNotNull() & ~r.isin("empty", "unparseable")).alias("ambiguous"), r.alias("reason")))


def weekend_of(day: Column) -> Column:
    """struct(saturday, sunday) of the weekend that a day is in or before; a Sunday looks back."""
    w = F.weekday(day)
    saturday = F.date_add(day, F.when(w == 6, -1).otherwise(5 - w).cast("int"))
    return F.struct(saturday.alias("saturday"), F.date_add(saturday, 1).alias("sunday"))


def day_bounds_utc(day: Column, zone: Column | str, days: int = 1) -> Column:
    """struct(start, end) in UTC with milliseconds of days local days; the end is the last millisecond."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    at = lambda d: F.to_utc_timestamp(d.cast("timestamp"), zone)
    shown = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.struct(shown(at(day)).alias("start"), shown(at(F.date_add(day, days)) - F.expr("INTERVAL 1 MILLISECOND")).alias("end"))


def epoch_iso(seconds: Column, all_day: Column | None = None) -> Column:
    """yyyy-MM-ddTHH:mm:ss of epoch seconds in UTC, or the date alone for all-day values."""
    t = F.timestamp_seconds(seconds.try_cast("double")).cast("timestamp_ntz")
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return whole if all_day is None else F.when(F.coalesce(all_day, F.lit(False)), F.date_format(t, "yyyy-MM-dd")).otherwise(whole)


def has_year(x: Column) -> Column:
    return x.rlike(r"\b(19|20)\d{2}\b")


def is_all_day(x: Column) -> Column:
    return x.rlike(r"(?i)\ball[\s-]?day\b")


def looks_dated(x: Column) -> Column:
    """Whether a text holds something like a date: numbers with hyphens or slashes, or a month name with a day."""
    return x.rlike(rf"(?i)\b{_ISO}\b|\b\d{{1,2}}/\d{{1,2}}(?:/\d{{2,4}})?\b|\b(?:{_MONTH})\.?\s+\d{{1,2}}\b|\b\d{{1,2}}\s+(?:{_MONTH})\b")


def prose_dates(x: Column, published: Column) -> Column:
    """Dates of all month-day mentions in a text, in order, each once; a missing year is that of publication."""
    whole = rf"(?i)\b(?:{_MONTH})\.?\s+\d{{1,2}}(?:,?\s+\d{{4}})?\b"
    one = rf"(?i)^({_MONTH})\.?\s+(\d{{1,2}})(?:,?\s+(\d{{4}}))?$"
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(whole), 0)
    parts = F.transform(found, lambda m: F.split(F.regexp_replace(m, one, "$1|$2|$3"), r"\|"))
    dates = F.transform(parts, lambda g: built_date(F.coalesce(F.get(g, 2).try_cast("int"), F.year(published)), month_number(F.get(g, 0)), F.get(g, 1).try_cast("int")))
    return F.array_distinct(F.array_compact(dates))


def human_date(day: Column) -> Column:
    return F.date_format(day, "EEE, MMM d")


def backoff(attempt: Column, base: float, cap: float) -> Column:
    """Seconds before an attempt, doubled each time up to the cap; attempts count from 1."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(float(cap)))


def split_range(x: Column) -> Column:
    """struct(start, end) of the two sides of a text, if both read as days with what they share; otherwise nulls."""
    r = parse_range(x)
    return F.struct(F.when(r.getField("end").isNotNull(), r.getField("start")).alias("start"), r.getField("end").alias("end"))


def zone_offset(zone: str, at: str) -> Column:
    """Seconds that a zone is ahead of UTC at a moment."""
    t = F.lit(at).cast("timestamp_ntz")
    return F.unix_seconds(F.convert_timezone(F.lit("UTC"), F.lit(zone), t).cast("timestamp")) - F.unix_seconds(t.cast("timestamp"))


def observes_dst(zone: str, year: int = 2026) -> Column:
    """Whether a zone's offset in January differs from that in July."""
    return zone_offset(zone, f"{year}-01-15 12:00:00") != zone_offset(zone, f"{year}-07-15 12:00:00")


def temporal(x: Column) -> Column:
    """struct(day, time) of an ISO text: a date of ten characters has no time; what is neither is null."""
    t = trimmed(x)
    cut = rf"^({_ISO})[T ](\d{{2}}:\d{{2}}(?::\d{{2}})?)(?:\.\d+)?(?:Z|[+-]\d{{2}}:?\d{{2}})?$"
    day = F.when(t.rlike(rf"^{_ISO}$"), t.try_cast("date")).when(t.rlike(cut), F.regexp_extract(t, cut, 1).try_cast("date"))
    return F.struct(day.alias("day"), F.when(day.isNotNull() & t.rlike(cut), parse_time(F.regexp_extract(t, cut, 2))).alias("time"))
