"""Writes as merges of DataFrames: each gives the table as it stands afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("kept", "updated", "inserted")


def coalescing_upsert(old: DataFrame, new: DataFrame, key: Sequence[str], always: Sequence[str], optional: Sequence[str], order: Column, active: str = "is_active", cancelled: str = "is_cancelled") -> DataFrame:
    """old after a run found new: rows of both and ``action``.

    ``always`` columns take the new value, ``optional`` ones only if it is not null; a
    cancelled row turns inactive and no later run turns it active again; columns that are in
    old alone keep their value.  Of several new rows of one key the first in ``order`` counts.
    """
    rest = [c for c in new.columns if c not in key]
    first = new.groupBy(*key).agg(F.min(F.struct(order.alias("__o"), *rest)).alias("n"))
    both = old.select(*key, F.struct(*[c for c in old.columns if c not in key]).alias("o")).join(first, list(key), "full")
    known, seen = F.col("o").isNotNull(), F.col("n").isNotNull()
    gone = F.coalesce(F.col(f"o.{cancelled}"), F.lit(False)) | F.coalesce(F.col(f"n.{cancelled}"), F.lit(False))
    out = []
    for c in old.columns:
        o, n = F.col(f"o.{c}") if c not in key else None, F.col(f"n.{c}") if c in rest else None
        if c in key:
            value = F.col(c)
        elif c == cancelled:
            value = gone
        elif c == active:
            value = F.when(F.coalesce(F.col(f"n.{cancelled}"), F.lit(False)), False).when(known, o).otherwise(~gone)
        elif c in always:
            value = F.when(seen, n).otherwise(o)
        elif c in optional:
            value = F.coalesce(n, o)
        else:
            value = o if n is None else F.when(known, o).otherwise(n)
        out.append(value.alias(c))
    action = F.when(~seen, ACTIONS[0]).when(known, ACTIONS[1]).otherwise(ACTIONS[2])
    return both.select(*out, action.alias("action"))


def overwriting_upsert(old: DataFrame, new: DataFrame, key: str, order: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Last row of each key wins whole, nulls included, but for the columns in ``keep``."""
    columns = [c for c in old.columns if c != key]
    last = new.groupBy(key).agg(F.max(F.struct(order.alias("__o"), *columns)).alias("n"))
    both = old.select(key, F.struct(*columns).alias("o")).join(last, key, "full")
    pick = lambda c: F.when(F.col("n").isNull() | (F.lit(c in keep) & F.col("o").isNotNull()), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select(key, *(pick(c).alias(c) for c in columns))


def append_once(ledger: DataFrame, new: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """New rows whose key the ledger lacks, one for each key: what is to be appended."""
    rest = [c for c in new.columns if c not in key]
    once = new.groupBy(*key).agg(F.min(F.struct(order.alias("__o"), *rest)).alias("n"))
    return once.join(ledger.select(*key).distinct(), list(key), "left_anti").select(*key, *(F.col(f"n.{c}").alias(c) for c in rest))


def removed(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), list(key), "left_anti")


def archived(table: DataFrame, which: Column, now: str, column: str = "archived_at") -> DataFrame:
    """table with the time in ``column`` for rows that match and are not archived yet."""
    return table.withColumn(column, F.when(F.coalesce(which, F.lit(False)) & F.col(column).isNull(), F.lit(now).cast("timestamp")).otherwise(F.col(column)))


def counted_reports(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Latest report of each key after one new report: the same fingerprint counts up, another starts at 1."""
    both = old.select(key, F.struct(fingerprint, "occurrences").alias("o")).join(new.select(key, F.col(fingerprint).alias("n")), key, "full")
    same = F.col("n").isNull() | F.col("n").eqNullSafe(F.col(f"o.{fingerprint}"))
    count = F.when(F.col("n").isNull(), F.col("o.occurrences")).when(same & F.col("o").isNotNull(), F.col("o.occurrences") + 1).otherwise(1)
    return both.select(key, F.coalesce("n", f"o.{fingerprint}").alias(fingerprint), count.alias("occurrences"))


def audit_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, before and after as JSON of every row that changed, came or went."""
    pack = lambda df, name: df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias(name))
    return pack(before, "before").join(pack(after, "after"), key, "full").where("NOT before <=> after")


def run_status(found: Column, valid: Column, blocked: Column) -> Column:
    """Status of a run from its counters: nothing found or nothing valid is a failure."""
    return F.when(blocked, "blocked").when((found == 0) | (valid == 0), "failed").when(valid < found, "partial").otherwise("success")


def write_csv(df: DataFrame, path: str, order: Sequence[Column]) -> bool:
    """Writes one sorted CSV with a header; nothing for an empty table.  The export is meant to be read whole by a person."""
    if df.limit(1).count() == 0:
        return False
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return True
