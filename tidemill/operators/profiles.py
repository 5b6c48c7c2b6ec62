"""Profiles of values: coverage, formats that parse, best candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.dates import parse_date, parse_time
from tidemill.operators.relational import ratio


def marker_counts(df: DataFrame, warnings: str, order: Sequence[Column], markers: Mapping[str, str], last: int = 200) -> DataFrame:
    """How many of the last runs carry each kind of warning: a warning belongs to a marker if it begins with it."""
    recent = df.orderBy(*order).limit(last)
    return recent.agg(*(F.count_if(F.exists(warnings, _beginning(m))).alias(n) for n, m in markers.items()))


def _beginning(mark: str):
    return lambda w: w.startswith(mark)


def value_profile(df: DataFrame, by: Sequence[str], value: str, unit: str) -> DataFrame:
    """For each selector: coverage of units with a value, share of units with exactly one, and variation of the values."""
    per_unit = df.groupBy(*by, unit).agg(F.count(F.nullif(F.col(value), F.lit(""))).alias("__n"))
    units = per_unit.groupBy(*by).agg(F.count("*").alias("n_units"), F.count_if(F.col("__n") >= 1).alias("__some"), F.count_if(F.col("__n") == 1).alias("__one"))
    values = df.where(F.coalesce(F.col(value) != "", F.lit(False))).groupBy(*by, value).agg(F.count("*").alias("__c")).groupBy(*by).agg(F.count("*").alias("__distinct"), F.sum("__c").alias("__all"))
    out = units.join(values, list(by), "left")
    r = lambda a, b: F.round(ratio(F.col(a).cast("double"), F.col(b)), 6)
    return out.select(*by, "n_units", r("__some", "n_units").alias("coverage"), r("__one", "__some").alias("uniqueness"), r("__distinct", "__all").alias("variation"))


def coverage_rows(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """path and share of rows with a value there: null, the empty text and false are none."""
    shares = df.agg(*(F.avg(F.when(F.coalesce(~F.col(p).cast("string").isin("", "false"), F.lit(False)), 1.0).otherwise(0.0)).alias(p) for p in paths))
    return shares.select(F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.round(F.coalesce(F.col(p), F.lit(0.0)), 6).alias("coverage")) for p in paths))).alias("x")).select("x.*")


def format_rates(df: DataFrame, value: str, formats: Sequence[str], time: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """For each format the share of values that it reads whole, best first."""
    parse = parse_time if time else parse_date
    # A format alone, without what values read by themselves: other values are told by a mark in front.
    tries = [F.avg(F.when(parse(F.concat(F.lit("\x01"), F.col(value)), ["\x01" + f]).isNotNull(), 1.0).otherwise(0.0)).alias(f"f{i}") for i, f in enumerate(formats)]
    rates = df.where(F.coalesce(F.trim(value) != "", F.lit(False))).groupBy(*by).agg(*tries)
    each = rates.select(*by, F.posexplode(F.array(*(F.struct(F.lit(f).alias("format"), F.round(F.col(f"f{i}"), 6).alias("rate")) for i, f in enumerate(formats)))).alias("at", "x"))
    return each.select(*by, "x.format", "x.rate", "at").where("rate > 0")


def format_cover(df: DataFrame, key: Column, value: str, formats: Sequence[str], most: int = 4) -> list[str]:
    """Formats that together read most values, the one that reads most of the rest first; at most ``most`` passes over sums.

    Each value becomes a bit mask of the formats that read it; masks are counted, and the
    choice is made on the counts: at most 2 ** len(formats) rows, however many values.
    """
    bits = F.lit(0)
    for i, f in enumerate(formats):
        bits = bits + F.when(parse_date(F.concat(F.lit("\x01"), F.col(value)), ["\x01" + f]).isNotNull(), 1 << i).otherwise(0)
    masks = {r[0]: r[1] for r in df.where(key.isNotNull()).groupBy(bits.alias("m")).agg(F.count("*")).collect()}
    chosen: list[str] = []
    while len(chosen) < most:
        gains = [sum(n for m, n in masks.items() if m >> i & 1) for i in range(len(formats))]
        best = max(range(len(formats)), key=lambda i: (gains[i], -i))
        if not gains[best]:
            break
        chosen.append(formats[best])
        masks = {m: n for m, n in masks.items() if not m >> best & 1}
    return chosen


def best_with_alternatives(df: DataFrame, key: Sequence[str], order: Sequence[Column], name: str, more: int = 3) -> DataFrame:
    """The best candidate of each key and a list of the next ones."""
    w = Window.partitionBy(*key).orderBy(*order)
    top = df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= more + 1)
    pairs = F.array_sort(F.collect_list(F.struct("__rank", name)))
    return top.groupBy(*key).agg(pairs.alias("__all")).select(*key, F.col("__all")[0][name].alias(name), F.transform(F.slice("__all", 2, more), lambda x: x[name]).alias("alternatives"))


def weighted_score(parts: Mapping[str, tuple[Column, float]]) -> Column:
    """Sum of shares between 0 and 1, each clamped, times their weights."""
    out = F.lit(0.0)
    for share, weight in parts.values():
        out = out + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share.cast("double"), F.lit(0.0)))) * weight
    return out


def container_scores(groups: DataFrame, key: str, within: float = 0.15) -> DataFrame:
    """The container of each page: links, dates, size, uniformity and depth weighed, and of those near the best the shallowest.

    groups: key, selector, n, n_links, n_dates, same_shape (share of alike elements), depth.
    """
    from tidemill.operators.relational import near_best

    n = F.col("n").cast("double")
    score = weighted_score({"links": (F.col("n_links") / n, 0.30), "dates": (F.col("n_dates") / n, 0.25), "size": (n / 10, 0.15), "shape": (F.col("same_shape"), 0.15), "depth": (1 - F.col("depth") / 12, 0.15)})
    return near_best(groups.withColumn("score", F.round(score, 6)), key, "score", within, [F.col("depth"), F.col("selector")])
