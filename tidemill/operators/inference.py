"""Inference of date and time formats, and of substrings that hold a date, from the values themselves.

No list of formats is given.  Each value is turned into its token shape (numbers by their
digits, words by what they name, signs as they are); a shape proposes every format that could
have written it, where a number of one or two digits may stand for a day or a month and a
year may have two digits.  Values are counted by shape and by what each proposal reads of
them, merged map-side, and formats are chosen by a greedy cover over bit masks of those
counts: as many rows as there are shapes, however many values.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.dates import MONTHS, WEEKDAYS, parse_date, parse_time
from tidemill.functions.text import collapsed, let

MAX_SHAPES = 2_000
MOST_DATES, MOST_TIMES = 4, 3  # fixed values: formats that are chosen at most

_NAMES = {"B": MONTHS, "b": tuple(m[:3] for m in MONTHS), "A": WEEKDAYS, "a": tuple(d[:3] for d in WEEKDAYS), "p": ("am", "pm")}
# Substrings that hold a date, from the most certain to the least.
SUBSTRINGS = (
    r"(\d{4}-\d{2}-\d{2})",
    r"([A-Z][a-z]{2,8} \d{1,2},? \d{4})",
    r"([A-Z][a-z]{2,8} [A-Z][a-z]{2,8} \d{1,2},? \d{4})",
    r"([A-Z][a-z]{2,8}\.? \d{1,2},? \d{4})",
    r"(\d{1,2}/\d{1,2}/\d{2,4})",
)


def shape(x: Column) -> Column:
    """The token shape of a collapsed text: ``9999`` for four digits, ``99`` for one or two, ``<B>`` for a month's name and so on.

    A name that is both a whole and a short one ("May") is the whole one; other words stay as ``<w>``.
    """
    alternatives = "|".join(f"({'|'.join(names)})" for names in _NAMES.values())
    token = rf"(?i)(?<![a-z])(?:{alternatives})(?![a-z])|([a-z]+)|([0-9]{{4}}(?![0-9]))|([0-9]{{1,2}}(?![0-9]))|([0-9]+)|([^a-z0-9]+)"

    def told(t: Column) -> Column:
        low = F.lower(t)
        out = F.when(t.rlike("^[0-9]{4}$"), "9999").when(t.rlike("^[0-9]{1,2}$"), "99").when(t.rlike("^[0-9]"), "<n>")
        for name, words in _NAMES.items():
            out = out.when(low.isin(*words), f"<{name}>")
        return out.when(t.rlike("^[A-Za-z]"), "<w>").otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(token), 0), told), "")


_PART = re.compile(r"9999|99|<[a-zA-Z]>|[^<9]+")


def proposals(form: str, time: bool = False) -> list[str]:
    """Formats that could have written texts of a shape, in a fixed order; none if it holds what no format reads."""
    parts = _PART.findall(form)
    if "".join(parts) != form or "<w>" in parts or "<n>" in parts:
        return []
    options = []
    for i, p in enumerate(parts):
        if p == "9999":
            options.append(("%Y",))
        elif p == "99" and time:
            options.append(("%H", "%I", "%M", "%S"))
        elif p == "99":
            options.append(("%m", "%d", "%y"))
        elif p == "<B>":
            # "May" is a whole and a short name at once.
            options.append(("%B", "%b"))
        elif p[0] == "<":
            options.append((f"%{p[1]}",))
        else:
            options.append((p,))
    out = []
    for chosen in product(*options):
        used = [c for c in chosen if c.startswith("%")]
        kinds = [{"%b": "%B", "%m": "%B", "%y": "%Y", "%a": "%A", "%I": "%H"}.get(u, u) for u in used]
        if len(kinds) != len(set(kinds)):
            continue
        if time:
            order = [k for k in kinds if k != "%p"]
            fits = order == ["%H", "%M", "%S"][: len(order)] and len(order) >= 1 and ("%I" in used) == ("%p" in used) and ("%p" in used or len(order) > 1)
        else:
            fits = {"%Y", "%B", "%d"} <= set(kinds) and not {"%H", "%M", "%S", "%p"} & set(kinds)
        if fits:
            out.append("".join(chosen))
    return out


def shapes(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """How many values have each shape; blank values have none."""
    text = collapsed(F.col(value).cast("string"))
    return df.select(*by, text.alias("text")).where(F.length("text") > 0).groupBy(*by, shape(F.col("text")).alias("shape")).agg(F.count("*").alias("n"))


def _strict(x: Column, fmt: str, time: bool) -> Column:
    """Whether a format alone reads a text; what values read by themselves is kept out by a mark in front."""
    parse = parse_time if time else parse_date
    return parse(F.concat(F.lit("\x01"), x), ["\x01" + fmt]).isNotNull()


def format_masks(df: DataFrame, value: str, by: Sequence[str] = (), time: bool = False) -> tuple[DataFrame, list[str]]:
    """(by, mask, n) and the formats of the mask's bits: how many values are read by exactly these formats.

    Each format is tried only on values of the shapes that propose it.
    """
    text = collapsed(F.col(value).cast("string"))
    rows = df.select(*by, text.alias("text")).where(F.length("text") > 0).withColumn("shape", shape(F.col("text")))
    # The most frequent shapes; beyond MAX_SHAPES values have no usual form, and the rest counts as unread.
    known = [r[0] for r in rows.groupBy("shape").count().orderBy(F.desc("count"), "shape").limit(MAX_SHAPES).select("shape").collect()]
    wanted: dict[str, list[str]] = defaultdict(list)
    for form in sorted(known):
        for fmt in proposals(form, time):
            wanted[fmt].append(form)
    formats = sorted(wanted, key=_order)
    bits = [F.when(F.col("shape").isin(*wanted[f]) & _strict(F.col("text"), f, time), F.lit(i)) for i, f in enumerate(formats)]
    mask = F.array_compact(F.array(*bits)) if bits else F.array().cast("array<int>")
    return rows.groupBy(*by, mask.alias("mask")).agg(F.count("*").alias("n")), formats


def _cover(masks: Column, n_formats: int, most: int) -> Column:
    """array<struct(bit, n)> of a greedy cover: the format that reads most of the values left first, with what it reads of all.

    Ties: the format that reads more values of all, then the lower bit.
    """
    reads = lambda some, i: F.aggregate(F.filter(some, lambda m: F.array_contains(m["mask"], i)), F.lit(0).cast("bigint"), lambda acc, m: acc + m["n"])
    bits = F.sequence(F.lit(0), F.lit(n_formats - 1))

    def step(acc: Column, _: Column) -> Column:
        gains = F.filter(F.transform(bits, lambda i: F.struct((-reads(acc["left"], i)).alias("gain"), (-F.get(acc["total"], i)).alias("total"), i.alias("bit"))), lambda g: g["gain"] < 0)
        taken = lambda b: F.struct(
            F.filter(acc["left"], lambda m: ~F.array_contains(m["mask"], b["bit"])).alias("left"), acc["total"].alias("total"), F.concat(acc["chosen"], F.array(F.struct(b["bit"].alias("bit"), (-b["total"]).alias("n")))).alias("chosen"),
        )
        return let(F.array_min(gains), lambda b: F.when(b.isNull(), acc).otherwise(taken(b)))

    begin = F.struct(masks.alias("left"), F.transform(bits, lambda i: reads(masks, i)).alias("total"), F.array().cast("array<struct<bit:int,n:bigint>>").alias("chosen"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), begin, step, lambda acc: acc["chosen"])


def _order(fmt: str) -> tuple[bool, str]:
    """A month before a day goes first, then the order of names."""
    return "%m" in fmt and "%d" in fmt and fmt.index("%m") > fmt.index("%d"), fmt


def inferred_formats(df: DataFrame, value: str, by: Sequence[str] = (), time: bool = False) -> DataFrame:
    """(by,) place, format, n and rate of the formats that together read most values; no row where nothing is read.

    A group's masks, at most one for each set of formats, meet in one row.
    """
    masks, formats = format_masks(df, value, by, time)
    grouped = masks.groupBy(*by).agg(F.collect_list(F.struct("mask", "n")).alias("masks"), F.sum("n").alias("all"))
    if not formats:
        return grouped.limit(0).select(*by, F.lit(1).alias("place"), F.lit("").alias("format"), F.col("all").alias("n"), F.lit(0.0).alias("rate"))
    names = F.array(*map(F.lit, formats))
    each = grouped.select(*by, "all", F.posexplode(_cover(F.col("masks"), len(formats), MOST_TIMES if time else MOST_DATES)).alias("place", "c"))
    return each.select(*by, (F.col("place") + 1).alias("place"), F.get(names, F.col("c.bit")).alias("format"), F.col("c.n").alias("n"), F.round(F.col("c.n") / F.col("all"), 6).alias("rate"))


def substring_rates(df: DataFrame, value: str, formats: Sequence[str], by: Sequence[str] = (), patterns: Sequence[str] = SUBSTRINGS) -> DataFrame:
    """(by,) pattern and rate: the share of all values of which a pattern cuts out a text that a format, or ISO form, reads; best first (``place``)."""
    text = collapsed(F.col(value).cast("string"))
    rows = df.select(*by, text.alias("text")).where(F.length("text") > 0)

    def reads(pattern: str) -> Column:
        cut = F.regexp_extract("text", pattern, 1)
        return F.avg(F.when(let(cut, lambda c: (c != "") & parse_date(c, formats).isNotNull()), 1.0).otherwise(0.0))

    rates = rows.groupBy(*by).agg(*(reads(p).alias(f"p{i}") for i, p in enumerate(patterns)))
    each = F.array(*(F.struct((-F.round(F.col(f"p{i}"), 6)).alias("r"), F.lit(i).alias("at"), F.lit(p).alias("pattern")) for i, p in enumerate(patterns)))
    ranked = rates.select(*by, F.posexplode(F.array_sort(F.filter(each, lambda e: e["r"] < 0))).alias("place", "e"))
    return ranked.select(*by, (F.col("place") + 1).alias("place"), "e.pattern", (-F.col("e.r")).alias("rate"))
