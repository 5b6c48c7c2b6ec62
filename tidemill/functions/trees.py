"""Nodes of JSON documents whose shape is not known, as arrays of a row: no shuffle, no Python.

A document is expanded level by level: ``nodes`` folds over the depths and turns the frontier
of one level into the next.  Every step is evaluated once, so the plan stays small.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import let

DEPTH, NODES, ITEMS = 8, 5000, 50  # fixed values: levels below the root, nodes of a document, items of an array that are looked into

_NODE = "struct<path:string,depth:int,node:variant>"


def entries(node: Column) -> Column:
    """Keys and values of an object, by key; none of anything else."""
    return F.coalesce(F.map_entries(F.try_variant_get(node, "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))


def keys(node: Column) -> Column:
    return F.coalesce(F.map_keys(F.try_variant_get(node, "$", "map<string,variant>")), F.array().cast("array<string>"))


def values(node: Column) -> Column:
    return F.coalesce(F.map_values(F.try_variant_get(node, "$", "map<string,variant>")), F.array().cast("array<variant>"))


def items(node: Column) -> Column:
    """Items of an array; none of anything else."""
    return F.coalesce(F.try_variant_get(node, "$", "array<variant>"), F.array().cast("array<variant>"))


def objects(node: Column) -> Column:
    """The objects among the items of an array."""
    return F.filter(items(node), lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())


def _below(parent: Column, most: int, into_arrays: bool) -> Column:
    """The nodes one level below a node."""
    depth, node = parent["depth"] + 1, parent["node"]
    path = lambda k: F.when(parent["path"] == "", k).otherwise(F.concat(parent["path"], F.lit("."), k))
    fields = F.transform(entries(node), lambda e: F.struct(path(e["key"]).alias("path"), depth.alias("depth"), e["value"].alias("node")))
    if not into_arrays:
        return fields.cast(f"array<{_NODE}>")
    places = F.transform(F.slice(items(node), 1, most), lambda x, i: F.struct(F.concat(parent["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), depth.alias("depth"), x.alias("node")))
    return F.concat(fields, places).cast(f"array<{_NODE}>")


def nodes(doc: Column, depth: int = DEPTH, most: int = NODES, into_arrays: bool = True, look: int = ITEMS) -> Column:
    """array<struct(path, depth, node)> of a variant and what stands below it, level by level.

    Fields are ordered by key.  At most ``most`` nodes are kept, those of upper levels first;
    of an array the first ``look`` items are looked into.  Null gives no nodes.
    """
    empty = F.array().cast(f"array<{_NODE}>")
    root = F.array(F.struct(F.lit("").alias("path"), F.lit(0).alias("depth"), doc.alias("node"))).cast(f"array<{_NODE}>")
    begin = F.struct(empty.alias("done"), F.when(doc.isNotNull(), root).otherwise(empty).alias("front"))

    def step(acc: Column, _: Column) -> Column:
        grown = F.concat(acc["done"], acc["front"])
        return let(grown, lambda done: F.struct(done.alias("done"), F.slice(F.flatten(F.transform(acc["front"], lambda n: _below(n, look, into_arrays))), F.lit(1), F.greatest(F.lit(0), most - F.size(done))).alias("front")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), begin, step, lambda acc: F.concat(acc["done"], acc["front"]))
