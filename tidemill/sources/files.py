"""File sources and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import trimmed, without_formula
from tidemill.functions.urls import canonical_url, public_url_problem
from tidemill.operators.relational import dedup_counted

# Columns of a submission file.
COLUMNS = ("url", "name", "source_display_name", "city_slug", "timezone")


def submissions(rows: DataFrame, order: str, most: int = 200) -> tuple[DataFrame, list[str]]:
    """Accepted and refused rows of a submission, and the columns that are not known.

    rows: text columns with the position in ``order``.  Formula signs are taken off; a row
    has status accepted, invalid (with a problem) or repeated (an earlier row has its URL);
    rows beyond the first ``most`` have status over_limit.
    """
    if "url" not in rows.columns:
        raise ValueError("the column url is missing")
    unknown = [c for c in rows.columns if c not in (*COLUMNS, order)]
    clean = rows.select(order, *(without_formula(trimmed(F.col(c))).alias(c) for c in COLUMNS if c in rows.columns))
    clean = clean.withColumn("problem", public_url_problem(F.col("url"))).withColumn("own", canonical_url(F.col("url")))
    first = dedup_counted(clean.where("problem IS NULL").select("own", order), ["own"], F.col(order)).select("own", F.col(order).alias("__first"))
    marked = clean.join(first, "own", "left")
    status = F.when(F.col(order) >= most, "over_limit").when(F.col("problem").isNotNull(), "invalid").when(F.col(order) > F.col("__first"), "repeated").otherwise("accepted")
    return marked.withColumn("status", status).drop("own", "__first"), unknown


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all columns text, with no inference."""
    return spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def pasted_lines(df: DataFrame, text: str) -> DataFrame:
    """(line, url) of every line that is not blank, numbered from 0 over all lines."""
    return df.select(F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line", "url")).select("line", trimmed(F.col("url")).alias("url")).where("url <> ''")
