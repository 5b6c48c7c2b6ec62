"""Windowed counts, alike for batch tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(df: DataFrame, at: str, by: str, window: Column, late: str) -> DataFrame:
    source = df.withColumn(at, F.col(at).cast("timestamp"))
    source = source.withWatermark(at, late) if df.isStreaming else source
    return source.groupBy(window.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def counts(df: DataFrame, at: str, by: str, width: str, late: str = "0 seconds", slide: str | None = None) -> DataFrame:
    """Rows for each window and value of ``by``; on a stream, rows later than ``late`` are left out."""
    return _counted(df, at, by, F.window(at, width, slide), late)


def sessions(df: DataFrame, at: str, by: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """Rows for each session of a value of ``by``: one ends after ``gap`` without a row."""
    return _counted(df, at, by, F.session_window(at, gap), late)


def joined(left: DataFrame, right: DataFrame, key: str, at_left: str, at_right: str, within: str, late: str = "1 hour") -> DataFrame:
    """Pairs of two streams (or tables) with equal keys, right at most ``within`` after left; state is dropped after that."""
    a = left.withColumn(at_left, F.col(at_left).cast("timestamp"))
    b = right.withColumn(at_right, F.col(at_right).cast("timestamp"))
    a = a.withWatermark(at_left, late) if left.isStreaming else a
    b = b.withWatermark(at_right, late) if right.isStreaming else b
    b = b.withColumnRenamed(key, "__key")
    return a.join(b, F.expr(f"{key} = __key AND {at_right} >= {at_left} AND {at_right} <= {at_left} + INTERVAL {within}")).drop("__key")
