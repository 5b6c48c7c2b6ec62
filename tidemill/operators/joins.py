"""Joins with rules, ranks, defaults and caches.

Rule tables are broadcast only after their rows and bytes are measured.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import casefold, trimmed
from tidemill.functions.urls import canonical_origin, canonical_url, is_origin_only
from tidemill.operators.rule_index import light, text_matches

# Order of rule types, and of kinds of URL matches.
PRECEDENCE = ("source_mapping", "administrator_mapping", "website_mapping", "venue", "keyword")
MATCHES = ("listing_url", "base_url", "page_under_origin")


def first_rule(rows: DataFrame, rules: DataFrame, key: str, fallback: str = "other") -> DataFrame:
    """key, category, rule_id and rule_type of the first rule that matches each row, or the fallback.

    rows: key, source_category, website_id, venue, title, description.
    rules: rule_id, rule_type, category, priority, website_id, source_value, pattern,
    is_regex, case_sensitive, is_active.  Order: type, higher priority, lower id.

    Rules that compare a value exactly are equi-joins; text rules are found through an index of
    rare grams.  The best rule is a minimum of structs, merged map-side.  There is no bound on
    the number of rules.
    """
    live = rules.where("is_active").withColumn("rank", F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("rule_type")))
    live = live.where("rank > 0").withColumn("value", F.coalesce(trimmed(F.col("source_value")), F.lit("")))
    own = rows.withColumn("source", F.coalesce(trimmed(F.col("source_category")), F.lit("")))
    order = F.struct("rank", (-F.col("priority")).alias("p"), "rule_id", "category", "rule_type").alias("best")
    found = []
    for strict in (True, False):
        same = live.where(F.col("case_sensitive") == strict)
        value = F.col("value") if strict else casefold(F.col("value"))
        mine = own.withColumn("join_value", F.col("source") if strict else casefold(F.col("source")))
        exact = same.where(F.col("rule_type").isin("source_mapping", "administrator_mapping") & (value != "")).select(value.alias("join_value"), order)
        found.append(mine.join(light(exact), "join_value").select(key, "best"))
        site = same.where(F.col("rule_type") == "website_mapping").select(F.col("website_id"), value.alias("wanted"), order)
        found.append(mine.join(light(site), "website_id").where("wanted = '' OR wanted = join_value").select(key, "best"))
    both = F.array(F.struct(F.lit("venue").alias("field"), F.col("venue").alias("text")), F.struct(F.lit("keyword").alias("field"), F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("title", "description", "source_category"))).alias("text")))
    texts = own.select(key, F.explode(both).alias("t")).select(key, "t.field", "t.text")
    found.append(text_matches(texts, live.where(F.col("rule_type").isin("venue", "keyword")).select(F.col("rule_type").alias("field"), "pattern", "is_regex", "case_sensitive", order), key))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = every.groupBy(key).agg(F.min("best").alias("best"))
    out = rows.select(key).join(best, key, "left")
    return out.select(key, F.coalesce("best.category", F.lit(fallback)).alias("category"), F.col("best.rule_id").alias("rule_id"), F.coalesce("best.rule_type", F.lit("fallback")).alias("rule_type"))


def match_sources(urls: DataFrame, sources: DataFrame, key: str, url: str) -> DataFrame:
    """key, source_id and match of the best source for each URL; URLs without a match are left out.

    sources: source_id, base_url, listing_url, archived, is_active.  Active sources go before
    waiting ones and these before archived ones; then a listing URL before a base URL before
    a page under the origin of a source that has no listing URL; then the lowest id.
    """
    lifecycle = F.when(F.col("archived"), 2).when(F.col("is_active"), 0).otherwise(1)
    base = sources.select("source_id", lifecycle.alias("life"), canonical_url(F.col("base_url")).alias("base"), canonical_url(F.col("listing_url")).alias("listing"), (F.col("listing_url").isNull() & is_origin_only(F.col("base_url"))).alias("whole"))
    mine = urls.select(key, canonical_url(F.col(url)).alias("own"), canonical_origin(F.col(url)).alias("origin")).where("own <> ''")
    keys = (base.where("listing <> ''").select("source_id", "life", F.col("listing").alias("j")), base.where("base <> ''").select("source_id", "life", F.col("base").alias("j")), base.where("whole").select("source_id", "life", F.col("base").alias("j")))
    found = None
    for kind, k in enumerate(keys):
        side = mine.select(key, F.col("origin" if kind == 2 else "own").alias("j"))
        part = side.join(k, "j").select(key, F.struct("life", F.lit(kind).alias("kind"), "source_id").alias("best"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(key).agg(F.min("best").alias("best"))
    return best.select(key, F.col("best.source_id").alias("source_id"), F.element_at(F.array(*map(F.lit, MATCHES)), F.col("best.kind") + 1).alias("match"))


def with_defaults(rows: DataFrame, settings: DataFrame, key: str, defaults: dict) -> DataFrame:
    """rows with the settings of their key, and the defaults where it has none at all."""
    marked = settings.withColumn("__own", F.lit(True))
    out = rows.join(marked, key, "left")
    return out.select(*rows.columns, *(F.when(F.col("__own"), F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in defaults.items()))


def recipients(events: DataFrame, follows: DataFrame, key: str, targets: dict[str, Sequence[str]]) -> DataFrame:
    """(key, user_id) once for each user that follows one of the targets of an event.

    targets: kind of follow -> columns of events; follows: user_id, kind, target.
    """
    pairs = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("target"))) for kind, cols in targets.items() for c in cols)))
    each = events.select(key, F.explode(pairs).alias("t")).select(key, "t.kind", "t.target")
    return each.join(follows.withColumn("target", F.col("target").cast("long")), ["kind", "target"]).select(key, "user_id").distinct()


def cache_lookup(rows: DataFrame, cache: DataFrame, key: str, found: str) -> DataFrame:
    """rows with the columns of the cache and ``lookup``: hit, negative (known not to exist) or miss."""
    out = rows.join(cache, key, "left")
    return out.withColumn("lookup", F.when(F.col(found).isNull(), "miss").when(F.col(found), "hit").otherwise("negative"))


def resolved(rows: DataFrame, choices: DataFrame, levels: Sequence[str], id_column: str, active: str, default: int | None = None) -> DataFrame:
    """rows with ``choice``: the first level that names one decides; an inactive choice is null, with no fall-through."""
    named = F.coalesce(*(F.col(c) for c in levels), F.lit(default))
    return rows.withColumn("__choice", named).join(choices.select(F.col(id_column).alias("__choice"), F.col(active).alias("__ok")), "__choice", "left").withColumn("choice", F.when(F.coalesce(F.col("__ok"), F.lit(False)), F.col("__choice"))).drop("__choice", "__ok")


def chain(first: DataFrame, *steps: tuple[DataFrame, Sequence[str] | str], select: Sequence[str]) -> DataFrame:
    """Inner joins one after the other, then the distinct values of some columns."""
    out = first
    for table, on in steps:
        out = out.join(table, on)
    return out.select(*select).distinct()


def newest(df: DataFrame, key: str, id_column: str) -> DataFrame:
    """Largest id of each key."""
    return df.groupBy(key).agg(F.max(id_column).alias(id_column))


def overlay(decisions: DataFrame, results: DataFrame, key: str, kinds: Sequence[str]) -> DataFrame:
    """Decisions with one column for each kind of action: whether it succeeded last, null if it never ran."""
    last = results.groupBy(key, "kind").agg(F.max(F.struct("at", "ok")).alias("r"))
    wide = last.groupBy(key).pivot("kind", list(kinds)).agg(F.first(F.col("r.ok")))
    return decisions.join(wide, key, "left")


def differences(have: DataFrame, want: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows to add and to remove so that ``have`` becomes ``want``."""
    add = want.select(*columns).distinct().join(have, list(columns), "left_anti").withColumn("action", F.lit("add"))
    return add.unionByName(have.select(*columns).distinct().join(want, list(columns), "left_anti").withColumn("action", F.lit("remove")))


def condition_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the rows that meet each condition, in one scan."""
    return df.agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))
