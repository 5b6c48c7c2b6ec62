"""Runs that write to a table of their own, made from the driver's tables, and what stands there afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators.sinks import Sink
from tidemill.plans.registry import query
from tidemill.sources.shared import new_path
from tidemill.sources.tables import table


def _orders(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price"), "o_custkey")


def _sink(spark, d):
    """Two thirds of the orders, then changes of three kinds; every run is lost once before its marker and repeated."""
    sink, o = Sink(spark, new_path(spark, "orders"), "o_orderkey long, o_orderstatus string, price double, o_custkey long", ["o_orderkey"], 16), _orders(spark, d)
    k = F.col("o_orderkey")
    first, later = o.where(k % 3 != 0), o.where(k % 2 == 0).withColumn("price", F.col("price") + 1)
    change = lambda old, new: old.select("*", F.lit("kept").alias("action")).join(new.select("o_orderkey"), "o_orderkey", "left_anti").unionByName(
        new.join(old.select("o_orderkey", F.col("price").alias("was")), "o_orderkey", "left").select(*old.columns[:2], (F.coalesce("was", F.lit(0.0)) + F.col("price")).alias("price"), "o_custkey", F.when(F.col("was").isNull(), "inserted").otherwise("updated").alias("action"))
    )
    sink.upsert("first", first, F.lit(0))
    sink.publish(sink.stage("add", change, later))  # the run is lost here, after its buckets were replaced
    sink.apply("add", change, later)
    sink.apply("add", change, later)
    sink.delete("gone", o.where(k % 7 == 0).select("o_orderkey"))
    sink.set_column("closed", o.where(k % 5 == 0).select("o_orderkey", F.lit("X").alias("o_orderstatus")), "o_orderstatus")
    return sink


_AFTER = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_totalprice AS DOUBLE) ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS DOUBLE) + 1 ELSE 0 END AS price, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders WHERE (o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0) AND o_orderkey % 7 <> 0"


@query(f"SELECT o_orderkey, o_orderstatus, round(price, 2) AS price, o_custkey FROM ({_AFTER})")
def written_orders(spark, d):
    return _sink(spark, d).read().withColumn("price", F.round("price", 2))


@query("""SELECT 'first' AS run, count(*) FILTER (o_orderkey % 3 <> 0) AS inserted, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS deleted FROM orders
UNION ALL SELECT 'add', count(*) FILTER (o_orderkey % 2 = 0 AND o_orderkey % 3 = 0), count(*) FILTER (o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0), 0 FROM orders
UNION ALL SELECT 'gone', 0, 0, count(*) FILTER (o_orderkey % 7 = 0 AND (o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0)) FROM orders
UNION ALL SELECT 'closed', 0, count(*) FILTER (o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 AND (o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0)), 0 FROM orders""")
def run_log(spark, d):
    return _sink(spark, d).runs().select("run", "inserted", "updated", "deleted")
