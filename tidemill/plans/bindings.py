"""Queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.geo import haversine_km
from tidemill.functions.text import fingerprint, normalized_title
from tidemill.operators import relational as R
from tidemill.operators import stateful as S
from tidemill.plans.registry import query
from tidemill.sources.tables import table
from tidemill.streaming.windows import counts

def _visible(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.where("o_orderstatus = 'O'").join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])


_VISIBLE = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O'"


@query(f"SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, n_name FROM {_VISIBLE} AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' ORDER BY o_orderdate, o_orderkey LIMIT 12")
def listing_visible_page(spark, d):
    day = F.col("o_orderdate").cast("date")
    rows = _visible(spark, d).where(R.overlaps(day, day, "1995-01-01", "1996-12-31")).select("o_orderkey", day.alias("o_orderdate"), "n_name")
    return R.page(rows, [F.col("o_orderdate"), F.col("o_orderkey")], 1, 12)


@query(f"SELECT CAST(count(*) AS BIGINT) AS n FROM {_VISIBLE}")
def listing_total(spark, d):
    return _visible(spark, d).agg(F.count("*").alias("n"))


@query(f"SELECT n_name, CAST(count(*) AS BIGINT) AS n FROM {_VISIBLE} GROUP BY n_name")
def facet_counts(spark, d):
    return R.facet(_visible(spark, d), "n_name")


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (o_totalprice > 100000) AS BIGINT) AS n_large FROM orders GROUP BY o_orderstatus")
def status_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("n_large"))


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R')")
def sources_facet_semi(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(returned, "s_suppkey", "left_semi").select("s_suppkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join_unseen(spark, d):
    seen = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS fp FROM documents GROUP BY sha256(text)")
def dedup_first_wins(spark, d):
    # Merged before the shuffle, so copies of one text do not meet in one task.
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("fp")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "fp")


@query("SELECT c_custkey, sha256(concat_ws('|', replace(lower(c_name), 'ß', 'ss'), CAST(c_nationkey AS VARCHAR), '')) AS fp FROM customer")
def fingerprints(spark, d):
    return table(spark, d, "customer").select("c_custkey", fingerprint(normalized_title(F.col("c_name")), F.col("c_nationkey"), F.lit(None)).alias("fp"))


_OLD_NEW = "SELECT o_orderkey AS id, lower(trim(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'Client ' || CAST(o_custkey % 400 AS VARCHAR(10)) END)) AS title, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS note, o_orderstatus AS code FROM orders"


@query(f"""WITH e AS ({_OLD_NEW}),
a AS (SELECT title, day, arg_min(note, id) AS note, arg_min(code, id) AS code, count(*) AS n FROM e WHERE id % 2 = 0 GROUP BY title, day),
b AS (SELECT title, day, arg_min(lower(note), id) AS note, arg_min(code, id) AS code, count(*) AS n FROM e WHERE id % 2 = 1 GROUP BY title, day)
SELECT coalesce(a.title, b.title) AS title, coalesce(a.day, b.day) AS day, CASE WHEN b.n IS NULL THEN 'old_only' WHEN a.n IS NULL THEN 'new_only' ELSE 'matched' END AS status,
CASE WHEN a.n IS NULL OR b.n IS NULL THEN '' ELSE concat_ws(',', CASE WHEN nullif(lower(a.note), '') IS DISTINCT FROM nullif(lower(b.note), '') THEN 'note' END, CASE WHEN a.code IS DISTINCT FROM b.code THEN 'code' END) END AS differences,
CAST(coalesce(a.n, 0) AS BIGINT) AS n_old, CAST(coalesce(b.n, 0) AS BIGINT) AS n_new
FROM a FULL JOIN b ON a.title IS NOT DISTINCT FROM b.title AND a.day IS NOT DISTINCT FROM b.day""")
def compare_old_new(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    e = spark.sql(_OLD_NEW)
    both = R.compare(e.where("id % 2 = 0"), e.where("id % 2 = 1").withColumn("note", F.lower("note")), ["title", "day"], F.col("id"), ["note", "code"], ["note"])
    return both.withColumn("differences", F.array_join("differences", ","))


@query("SELECT event_type, CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS start, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    return counts(table(spark, d, "events"), "ts", "event_type", "1 day").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), f AS (SELECT user_id, rn, event_id, t AS last, true AS sent FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, e.event_id, CASE WHEN e.t - f.last > 21600000000 THEN e.t ELSE f.last END, e.t - f.last > 21600000000 FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1) SELECT event_id, sent FROM f")
def alert_cooldown(spark, d):
    return S.fold(table(spark, d, "events"), "user_id", "ts", "event_id", S.cooldown, 21600).select("event_id", F.col("allowed").alias("sent"))


@query("SELECT c_custkey, round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(10.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10.0)) * pow(sin(radians(20.0 - lon) / 2), 2)))), 6) AS km FROM (SELECT c_custkey, -90 + (c_custkey * 37 % 18000) / 100.0::DOUBLE AS lat, -180 + (c_custkey * 91 % 36000) / 100.0::DOUBLE AS lon FROM customer)")
def geo_distance(spark, d):
    lat, lon = -90 + (F.col("c_custkey") * 37 % 18000) / F.lit(100.0), -180 + (F.col("c_custkey") * 91 % 36000) / F.lit(100.0)
    return table(spark, d, "customer").select("c_custkey", F.round(haversine_km(lat, lon, F.lit(10.0), F.lit(20.0)), 6).alias("km"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def latest_per_key(spark, d):
    return R.first_wins(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


_RUNS = "SELECT user_id, run, min(event_type) AS event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, run"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return R.runs(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type")


@query(_RUNS)
def unchanged_run_length(spark, d):
    return _runs(spark, d).select("user_id", "run", "event_type", "n")


@query(f"SELECT user_id, CAST(count(*) AS BIGINT) AS n_streaks, max(n) AS longest FROM ({_RUNS}) WHERE event_type = 'error' AND n >= 3 GROUP BY user_id")
def fail_streaks(spark, d):
    long = _runs(spark, d).where("event_type = 'error' AND n >= 3")
    return long.groupBy("user_id").agg(F.count("*").alias("n_streaks"), F.max("n").alias("longest"))


@query("SELECT event_id, was, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NOT NULL AND NOT (was = 'view' AND event_type = 'click') AND NOT (was = 'click' AND event_type = 'purchase')")
def transitions_illegal(spark, d):
    moves = R.illegal_moves(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type", [("view", "click"), ("click", "purchase")])
    return moves.select("event_id", "was", "event_type")


@query("SELECT event_id, gap FROM (SELECT event_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)) WHERE gap > 600")
def lease_gaps(spark, d):
    return R.lapses(table(spark, d, "events"), "user_id", "ts", 600, "event_id").select("event_id", "gap")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%al%' OR p_brand ILIKE '%al%' OR p_type ILIKE '%al%'")
def multi_search(spark, d):
    return table(spark, d, "part").where("p_name ILIKE '%al%' OR p_brand ILIKE '%al%' OR p_type ILIKE '%al%'").select("p_partkey")


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_orders, CAST(count(o_orderkey) FILTER (o_orderstatus = 'F') AS BIGINT) AS n_closed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def deletion_impact(spark, d):
    # Counted before the join, so a hot customer is merged map-side.
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_closed"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0, ["n_orders", "n_closed"])


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS n_valid, CAST(count(*) FILTER (NOT coalesce(event_type <> 'error', false)) AS BIGINT) AS n_rejected, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS BIGINT) AS n_repeated, round(coalesce(count(event_type)::DOUBLE / nullif(count(*), 0), 0), 6) AS share_event_type, round(coalesce(count(user_id)::DOUBLE / nullif(count(*), 0), 0), 6) AS share_user_id FROM events")
def quality_profile(spark, d):
    return R.quality_profile(table(spark, d, "events"), F.col("event_type") != "error", ["user_id", "event_type"], ["event_type", "user_id"])
