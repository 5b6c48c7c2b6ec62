"""Repeated structure of pages: siblings of one kind, how alike their subtrees are, and how deep they stand.

A page becomes element rows inside its own row (see ``functions.markup``), in one pass.  Rows
of siblings are merged map-side by counts of their subtree hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.dates import looks_dated
from tidemill.functions.markup import classes, elements, shape, tags, text_inside
from tidemill.functions.text import let


def element_rows(df: DataFrame, key: str, page: str) -> DataFrame:
    """One row for each element: key, id, parent, depth, tag, classes (joined by a dot), shape, size, n_links and has_date."""

    def described(every: Column, all_tags: Column, e: Column) -> Column:
        inside = F.slice(every, e["id"], e["last"] - e["id"] + 1)
        links = F.size(F.filter(inside, lambda x: (x["tag"] == "a") & F.contains(F.lower(x["source"]), F.lit("href"))))
        dated = F.exists(inside, lambda x: x["tag"] == "time") | looks_dated(text_inside(all_tags, e))
        return F.struct(
            e["id"].alias("id"), e["parent"].alias("parent"), e["depth"].alias("depth"), e["tag"].alias("tag"), F.array_join(classes(e["source"]), ".").alias("classes"),
            shape(every, e).alias("shape"), F.size(inside).alias("size"), links.alias("n_links"), dated.alias("has_date"),
        )

    made = let(tags(F.col(page)), lambda ts: let(elements(ts), lambda es: F.transform(es, lambda e: described(es, ts, e))))
    return df.select(key, F.explode(made).alias("e")).select(key, "e.*")


def sibling_groups(df: DataFrame, key: str, page: str, least: int = 3) -> DataFrame:
    """Groups of at least ``least`` siblings with one name and one set of classes.

    key, parent, tag, classes, depth, n, n_shapes, same_shape (share of the most frequent subtree),
    n_links and n_dates (siblings with one), and score, the least of n, n_links and n_dates.
    """
    by = [key, "parent", "tag", "classes"]
    rows = element_rows(df, key, page)
    each = rows.groupBy(*by, "shape").agg(F.count("*").alias("c"), F.max("depth").alias("depth"), F.count_if(F.col("n_links") > 0).alias("l"), F.count_if("has_date").alias("d"))
    groups = each.groupBy(*by).agg(F.max("depth").alias("depth"), F.sum("c").alias("n"), F.count("*").alias("n_shapes"), F.max("c").alias("most"), F.sum("l").alias("n_links"), F.sum("d").alias("n_dates")).where(F.col("n") >= least)
    return groups.select(*by, "depth", "n", "n_shapes", F.round(F.col("most") / F.col("n"), 6).alias("same_shape"), "n_links", "n_dates", F.least("n", "n_links", "n_dates").alias("score"))


def containers(df: DataFrame, key: str, page: str, least: int = 3) -> DataFrame:
    """The group of each page that looks most like a list of cards, by links, dates, size, likeness and depth."""
    from tidemill.operators.profiles import container_scores

    found = sibling_groups(df, key, page, least).withColumn("selector", F.concat_ws(".", "tag", F.nullif(F.col("classes"), F.lit(""))))
    return container_scores(found, key)
