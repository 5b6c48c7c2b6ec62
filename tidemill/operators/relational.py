"""Listing, facet, dedup, comparison and ordered operators: (DataFrame, parameters) -> DataFrame.

``today`` and ``now`` are parameters, and every ordered operator takes a total order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import lower_key


def overlaps(start: Column, end: Column, low: str, high: str) -> Column:
    """Whether [start, end] meets [low, high]; a null end is the start."""
    return (start <= F.lit(high).cast("date")) & (F.coalesce(end, start) >= F.lit(low).cast("date"))


def upcoming(start: Column, end: Column, today: str) -> Column:
    """Whether something has not ended by today; without an end the start counts, without both never."""
    return F.coalesce(F.coalesce(end, start) >= F.lit(today).cast("date"), F.lit(False))


def visible(events: DataFrame, sources: DataFrame, cities: DataFrame, today: str) -> DataFrame:
    """Public rows of events: active, not archived, no confirmed duplicate and no recurrence parent,
    of an active source with an approved configuration, in an active city, and not over.

    Sources and cities are dimension tables; Spark broadcasts them where they are small.
    """
    live = events.where(F.col("is_active") & F.col("archived_at").isNull() & (F.col("duplicate_status") != "confirmed_duplicate") & ~F.col("is_recurrence_parent") & upcoming(F.col("start_date"), F.col("end_date"), today))
    approved = sources.where(F.col("is_active") & F.col("active_version").isNotNull()).select(F.col("source_id"))
    active = cities.where("is_active").select("city_id")
    return live.join(approved, "source_id", "left_semi").join(active, "city_id", "left_semi")


def listing_filter(
    city: int | None = None, category: int | None = None, source: int | None = None, search: str | None = None, recurrence: str | None = None, after: str | None = None, low: str | None = None, high: str | None = None, columns: Sequence[str] = ("title", "venue", "corrected_venue", "description")
) -> Column:
    """All filters of a public listing that are given, as one condition."""
    out = F.lit(True)
    if city is not None:
        out = out & (F.col("city_id") == city)
    if category is not None:  # the base category still matches where it is overridden
        out = out & ((F.col("category_id") == category) | F.coalesce(F.col("category_override_id") == category, F.lit(False)))
    if source is not None:
        out = out & (F.col("source_id") == source)
    if search and search.strip():
        out = out & contains_any(search.strip(), columns)
    if recurrence in ("recurring", "single"):
        out = out & (F.col("recurrence_parent_id").isNotNull() if recurrence == "recurring" else F.col("recurrence_parent_id").isNull())
    if after is not None:
        out = out & (F.col("start_date") > F.lit(after).cast("date"))
    if low is not None:
        out = out & (F.coalesce("end_date", "start_date") >= F.lit(low).cast("date"))
    if high is not None:
        out = out & (F.col("start_date") <= F.lit(high).cast("date"))
    return out


def contains_any(text: str, columns: Sequence[str]) -> Column:
    """Case-insensitive LIKE over several columns; wildcards of the text stay wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return out


def in_list(x: Column, values: Sequence, negate: bool = False) -> Column:
    """x in values; an empty list holds nothing, and a null is in no list."""
    if not values:
        return F.lit(negate)
    return F.coalesce(~x.isin(*values), F.lit(True)) if negate else F.coalesce(x.isin(*values), F.lit(False))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Rows of one page, numbered from 1."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Rows of one page with the total of all rows and whether a page follows.

    The total is an aggregate of one row beside the top rows, so nothing is sorted whole.
    """
    total = df.agg(F.count("*").alias("total"))
    return page(df, order, number, size).join(F.broadcast(total)).withColumn("has_next", F.col("total") > max(number, 1) * size)


def page_plus_one(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Rows of one page with whether another follows, learnt from one row more instead of a count."""
    top = df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size + 1)
    packed = top.agg(F.collect_list(F.struct(*df.columns)).alias("rows"))  # size + 1 rows at most
    return packed.select(F.explode(F.slice("rows", 1, size)).alias("r"), (F.size("rows") > size).alias("has_next")).select("r.*", "has_next")


def facet(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias(name))


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[Column], most: int = 1, position: str | None = None) -> DataFrame:
    """The first rows of each key in a total order, with their position if it is named."""
    w = Window.partitionBy(*key).orderBy(*order)
    name = position or "__rn"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= most)
    return out if position else out.drop(name)


def dedup_counted(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """First row of each key by the smallest order value, with the number of rows it stands for.

    Merged map-side as the minimum of a struct: copies of a key do not meet in one task.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.min(F.struct(order.alias("__o"), *rest)).alias("__first")
    return df.groupBy(*key).agg(best, F.count("*").alias("n_rows")).select(*key, *(F.col(f"__first.{c}").alias(c) for c in rest), "n_rows")


def duplicate_flags(df: DataFrame, key: str, status: str) -> DataFrame:
    """df with status possible_duplicate where its key stands in several rows and nobody has decided yet.

    Keys are counted map-side first; only repeated ones are joined back.
    """
    repeated = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1")
    flagged = F.when(F.col("__n").isNotNull() & (F.col(status) == "not_reviewed"), "possible_duplicate").otherwise(F.col(status))
    return df.join(repeated, key, "left").withColumn(status, flagged).select(df.columns)


def compare(old: DataFrame, new: DataFrame, key: Sequence[str], order: Column, fields: Sequence[str], text_fields: Sequence[str] = ()) -> DataFrame:
    """Full outer comparison on a key whose null parts match each other: one row for each pair, and every row without one.

    status is matched, old_only or new_only; a pair is made of the first row of either side,
    and ``differences`` lists the fields that differ, texts compared in their lower key form
    and the empty text as null; n_old and n_new count the rows of the key.
    """

    def firsts(df: DataFrame, side: str) -> DataFrame:
        best = F.min(F.struct(order.alias("__o"), *fields)).alias(side)
        return df.groupBy(*key).agg(best, F.count("*").alias(f"n_{side}"))

    a, b = firsts(old, "old").alias("a"), firsts(new, "new").alias("b")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    shown = lambda c: F.nullif(lower_key(c) if c is not None else c, F.lit(""))
    both = a.join(b, same, "full")
    status = F.when(F.col("new").isNull(), "old_only").when(F.col("old").isNull(), "new_only").otherwise("matched")

    def differs(f: str) -> Column:
        x, y = F.col(f"old.{f}"), F.col(f"new.{f}")
        if f in text_fields:
            x, y = shown(x), shown(y)
        else:
            x, y = F.nullif(x.cast("string"), F.lit("")), F.nullif(y.cast("string"), F.lit(""))
        return F.when(~x.eqNullSafe(y), f)

    found = F.when(status == "matched", F.array_compact(F.array(*(differs(f) for f in fields)))).otherwise(F.array().cast("array<string>"))
    keys = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in key]
    return both.select(*keys, status.alias("status"), found.alias("differences"), F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"))


def runs(df: DataFrame, key: str, order: Sequence[Column], value: str) -> DataFrame:
    """Each run of equal neighbouring values per key: value, its number ``run`` from 1, and its length ``n``."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__new", changed).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def streaks(df: DataFrame, key: str, order: Sequence[Column], failed: Column, threshold: int = 3) -> DataFrame:
    """df with the number of consecutive failures up to each row (a success resets it) and whether it reaches the threshold."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("__f", failed.cast("int")).withColumn("__reset", F.sum(1 - F.col("__f")).over(w))
    inner = Window.partitionBy(key, "__reset").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum("__f").over(inner)).withColumn("alarm", F.col("streak") >= threshold).drop("__f", "__reset")


def illegal_moves(df: DataFrame, key: str, order: Sequence[Column], state: str, allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """Moves from one state of a key to its next that are not in ``allowed``, a fixed table."""
    w = Window.partitionBy(key).orderBy(*order)
    legal = F.lit(False)
    for was, now in allowed:
        legal = legal | ((F.col("was") == was) & (F.col(state) == now))
    return df.withColumn("was", F.lag(state).over(w)).where(F.col("was").isNotNull() & ~F.coalesce(legal, F.lit(False)))


def lapses(df: DataFrame, key: str, at: str, seconds: int, tie: str) -> DataFrame:
    """Rows more than ``seconds`` after the one before of the same key: an expired lease.  ``tie`` orders rows of one time."""
    w = Window.partitionBy(key).orderBy(at, tie)
    t = F.col(at).cast("timestamp").cast("long")
    return df.withColumn("gap", t - F.lag(t).over(w)).where(F.col("gap") > seconds)


def until_stop(df: DataFrame, key: str, order: Sequence[Column], stop: Column) -> DataFrame:
    """Rows of each key up to and with the first that stops it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__stopped", F.coalesce(F.max(stop.cast("int")).over(w), F.lit(0))).where("__stopped = 0").drop("__stopped")


def carried(df: DataFrame, key: str, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """df with the last value that is not null up to each row, such as the heading an item stands under."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def near_best(df: DataFrame, key: str, score: str, within: float, order: Sequence[Column]) -> DataFrame:
    """Of the rows of a key whose score is within a distance of its best, the first in an order."""
    best = F.max(score).over(Window.partitionBy(key))
    return first_wins(df.withColumn("__best", best).where(F.col(score) >= F.col("__best") - within), [key], order).drop("__best")


def reasons(checks: Mapping[str, Column]) -> Column:
    """Names of all checks that fail, in the given order; a null check does not fail."""
    return F.array_compact(F.array(*(F.when(failed, name) for name, failed in checks.items())))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, and ``empty`` where b is 0 or null."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(empty))


def quality_profile(df: DataFrame, valid: Column, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row: counts of rows, of valid and of rejected ones, rows that repeat a key, and the share of rows with each field.

    Null validity counts as rejected; shares of an empty table are 0.  Rows are merged
    by key first, so copies of one key are summed map-side.
    """
    ok = F.count_if(valid).alias("n_valid")
    by_key = df.groupBy(*key).agg(F.count("*").alias("__n"), ok, *(F.count(f).alias(f"__has_{f}") for f in fields))
    total = F.sum("__n")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return by_key.agg(
        count(total).alias("n"), count(F.sum("n_valid")).alias("n_valid"), count(total - F.sum("n_valid")).alias("n_rejected"), count(total - F.count("*")).alias("n_repeated"),
        *(F.round(ratio(F.sum(f"__has_{f}").cast("double"), total), 6).alias(f"share_{f}") for f in fields),
    )


def quality_report(df: DataFrame, truncated: bool = False) -> DataFrame:
    """The full profile of validated candidates as one row.

    Columns read: valid, fingerprint, start_date, end_date, url_ok, history and warnings
    (arrays), detail_used.  Rates are 0 without rows, but 1 for ranges and places where none
    was tried.  Duplicates are counted among valid rows.
    """
    parsed = F.exists("history", lambda h: h.startswith("date_range:"))
    unclear = ~parsed & F.exists("warnings", lambda w: w.startswith("date_range_ambiguous:"))
    tags = F.filter("history", lambda h: h.startswith("geographic:"))
    place = F.substring(F.get(tags, F.size(tags) - 1), 12, 100)
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    by_key = df.groupBy(F.when(F.col("valid"), F.col("fingerprint")).alias("__k"), F.col("valid").alias("__valid")).agg(
        F.count("*").alias("n"), one(F.col("start_date").isNotNull()).alias("dated"), one(F.col("url_ok")).alias("urls"), F.sum(F.size("warnings").cast("long")).alias("warned"), one(F.col("detail_used")).alias("details"),
        one(parsed).alias("parsed"), one(unclear).alias("unclear"), one(parsed & F.col("end_date").isNotNull()).alias("ended"), one(F.col("end_date").isNotNull()).alias("ranges"),
        one(place.isNotNull()).alias("placed"), one(place.isin("excluded", "missing_reject")).alias("dropped"), one(place.startswith("missing")).alias("unplaced"),
    )
    total, valid = F.sum("n"), F.sum(F.when(F.col("__valid"), F.col("n")).otherwise(0))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    tried = F.sum("parsed") + F.sum("unclear")
    r = lambda a, b, e=0.0: F.round(ratio(a.cast("double"), b, e), 6)
    return by_key.agg(
        s("n").alias("n"), F.coalesce(valid, F.lit(0)).cast("long").alias("n_valid"), F.coalesce(total - valid, F.lit(0)).cast("long").alias("n_rejected"),
        r(valid, total).alias("valid_rate"), r(total - valid, total).alias("rejected_rate"), r(F.sum("dated"), total).alias("date_rate"), r(F.sum("urls"), total).alias("url_rate"),
        r(valid - F.count_if(F.col("__valid")), valid).alias("duplicate_rate"), s("warned").alias("n_warnings"), F.lit(truncated).alias("truncated"), F.coalesce(F.sum("details") > 0, F.lit(False)).alias("detail_used"),
        s("ranges").alias("n_ranges"), r(F.sum("parsed"), tried, 1.0).alias("range_rate"), r(F.sum("ended"), tried, 1.0).alias("end_rate"), s("unclear").alias("n_ambiguous"),
        s("placed").alias("n_placed"), (s("placed") - s("dropped")).alias("n_included"), s("dropped").alias("n_excluded"), s("unplaced").alias("n_unplaced"), r(F.sum("placed") - F.sum("dropped"), F.sum("placed"), 1.0).alias("inclusion_rate"),
    )


def missed_bars(bars: Mapping[str, Column]) -> Column:
    """reasons, named for approval: the bars that a profile misses; none means approved."""
    return reasons(bars)


def key_values(**groups: DataFrame) -> DataFrame:
    """Small aggregates of several tables as rows (section, key, n): each group is (key, n)."""
    out = None
    for section, df in groups.items():
        rows = df.select(F.lit(section).alias("section"), F.coalesce(df[df.columns[0]].cast("string"), F.lit("None")).alias("key"), df[df.columns[1]].cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def error_groups(df: DataFrame, column: str) -> DataFrame:
    """Messages of a ;-separated column without their candidate number, counted, the most frequent first."""
    each = df.select(F.explode(F.split(F.col(column), ";")).alias("m"))
    message = F.regexp_replace(F.trim("m"), r"^candidate\[\d+\]:\s*", "")
    return each.select(message.alias("message")).where("message <> ''").groupBy("message").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message")


def progress(df: DataFrame, batch: str, status: str, terminal: Sequence[str]) -> DataFrame:
    """Jobs of each batch, those that ended, and whether all did."""
    done = F.count_if(F.col(status).isin(*terminal))
    return df.groupBy(batch).agg(F.count("*").alias("n"), done.alias("n_done")).withColumn("complete", F.col("n") == F.col("n_done"))
