"""Merges, ledgers and file sources over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import writes as W
from tidemill.plans.registry import query
from tidemill.sources import files
from tidemill.sources.tables import table

_OLD = "SELECT c_custkey AS id, 'old ' || c_name AS title, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS venue, c_custkey % 5 = 0 AS is_cancelled, c_custkey % 5 <> 0 AS is_active, c_nationkey AS corrected FROM customer WHERE c_custkey % 3 <> 0"
_NEW = "SELECT o_custkey AS id, 'new ' || o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS venue, o_orderkey % 7 = 0 AS is_cancelled, o_orderkey AS seq FROM orders WHERE o_custkey % 4 <> 1"


@query(f"""WITH o AS ({_OLD}), n AS (SELECT * FROM ({_NEW}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.title, o.title) AS title, coalesce(n.venue, o.venue) AS venue, coalesce(o.is_cancelled, false) OR coalesce(n.is_cancelled, false) AS is_cancelled,
CASE WHEN coalesce(n.is_cancelled, false) THEN false WHEN o.id IS NOT NULL THEN o.is_active ELSE true END AS is_active, o.corrected, CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.id = n.id""")
def upsert_coalesce(spark, d):
    for t in ("customer", "orders"):
        table(spark, d, t).createOrReplaceTempView(t)
    return W.coalescing_upsert(spark.sql(_OLD), spark.sql(_NEW), ["id"], ["title"], ["venue"], F.col("seq"))


@query(f"WITH o AS (SELECT id, title, venue FROM ({_OLD})), n AS (SELECT * FROM ({_NEW}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.id IS NULL THEN o.venue ELSE n.venue END AS venue FROM o FULL JOIN n ON o.id = n.id")
def upsert_overwrite(spark, d):
    for t in ("customer", "orders"):
        table(spark, d, t).createOrReplaceTempView(t)
    return W.overwriting_upsert(spark.sql(_OLD).select("id", "title", "venue"), spark.sql(_NEW), "id", F.col("seq"), keep=["title"])


@query("WITH l AS (SELECT DISTINCT user_id, event_type FROM events WHERE day(ts) <= 3), n AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE day(ts) > 3 GROUP BY 1, 2) SELECT n.* FROM n ANTI JOIN l USING (user_id, event_type)")
def ledger_once(spark, d):
    e = table(spark, d, "events")
    ledger = e.where(F.day("ts") <= 3).select("user_id", "event_type")
    return W.append_once(ledger, e.where(F.day("ts") > 3).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], F.col("event_id"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN TIMESTAMP '2024-01-01 00:00:00' WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2020-01-01 00:00:00' END AS archived_at FROM customer WHERE c_custkey % 2 = 1 OR c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, TIMESTAMP '2020-01-01 00:00:00' FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment = 'BUILDING'")
def archive_matching(spark, d):
    c = table(spark, d, "customer").withColumn("archived_at", F.when(F.col("c_custkey") % 2 == 0, F.lit("2020-01-01").cast("timestamp")))
    return W.archived(c, F.col("c_mktsegment") == "BUILDING", "2024-01-01").select("c_custkey", F.col("archived_at").cast("timestamp_ntz").alias("archived_at"))


@query("WITH o AS (SELECT c_custkey, c_mktsegment AS fp, c_nationkey AS occurrences FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS fp FROM customer WHERE c_custkey % 5 <> 0) SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.fp, o.fp) AS fp, CASE WHEN n.fp IS NULL THEN o.occurrences WHEN n.fp = o.fp THEN o.occurrences + 1 ELSE 1 END AS occurrences FROM o FULL JOIN n ON o.c_custkey = n.c_custkey")
def report_occurrences(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    old = c.where(k % 3 != 0).select(k, F.col("c_mktsegment").alias("fp"), F.col("c_nationkey").alias("occurrences"))
    return W.counted_reports(old, c.where(k % 5 != 0).select(k, F.when(k % 2 == 0, "BUILDING").otherwise(F.col("c_mktsegment")).alias("fp")), "c_custkey", "fp")


@query("WITH e AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS v, bool_or(o_orderkey % 97 = 0) AS b FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN b THEN 'blocked' WHEN n = 0 OR v = 0 THEN 'failed' WHEN v < n THEN 'partial' ELSE 'success' END AS status FROM e")
def run_statuses(spark, d):
    r = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") != "P").alias("v"), F.bool_or(F.col("o_orderkey") % 97 == 0).alias("b"))
    return r.select("o_custkey", W.run_status(F.col("n"), F.col("v"), F.col("b")).alias("status"))


@query("WITH p AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'ftp://x.example/' WHEN page_id % 4 = 1 THEN '=' || url ELSE url END AS url, regexp_replace(lower(regexp_extract(url, '^https?://[^/?#]+', 0)), ':80$', '') || CASE WHEN regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+(/.*)?$', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+(/.*)?$', 1), '/+$', '') END || CASE WHEN regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1) = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&')), '&') END AS own FROM pages), r AS (SELECT *, min(page_id) FILTER (page_id % 9 <> 0) OVER (PARTITION BY own) AS first FROM p) SELECT page_id, CASE WHEN page_id >= 200 THEN 'over_limit' WHEN page_id % 9 = 0 THEN 'invalid' WHEN page_id > first THEN 'repeated' ELSE 'accepted' END AS status FROM r")
def csv_submissions(spark, d):
    k = F.col("page_id")
    rows = table(spark, d, "pages").select(k, F.when(k % 9 == 0, "ftp://x.example/").when(k % 4 == 1, F.concat(F.lit("="), "url")).otherwise(F.col("url")).alias("url"), F.lit("x").alias("colour"))
    found, _ = files.submissions(rows, "page_id")
    return found.select("page_id", "status")
