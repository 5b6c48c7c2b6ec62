"""Public listings: visibility, filters, paging, facets, flags and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.dates import weekend_of
from tidemill.functions.text import slug
from tidemill.operators import joins as J
from tidemill.operators import relational as R
from tidemill.plans.registry import query
from tidemill.sources.tables import table

TODAY = "1996-06-01"

# The driver's tables as events, sources and cities; the same text in both dialects.
_EVENTS = """SELECT o_orderkey AS event_id, o_custkey AS source_id, CAST(o_custkey % 25 AS INT) AS city_id, o_orderpriority AS title, o_orderstatus <> 'P' AS is_active,
CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS archived_at, CASE WHEN o_orderkey % 13 = 0 THEN 'confirmed_duplicate' ELSE 'not_reviewed' END AS duplicate_status, o_orderkey % 17 = 0 AS is_recurrence_parent,
CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS start_date, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 10 END AS end_date,
CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS recurrence_parent_id, o_custkey % 7 AS category_id, CASE WHEN o_custkey % 6 = 0 THEN o_custkey % 5 END AS category_override_id,
CASE WHEN o_custkey % 8 = 0 THEN NULL ELSE -90 + (o_custkey * 37 % 18000) / 100.0 END AS lat, CASE WHEN o_custkey % 9 = 0 THEN 45.5 END AS corrected_lat FROM orders"""
_SOURCES = "SELECT c_custkey AS source_id, c_acctbal > 0 AS is_active, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1 END AS active_version, c_name FROM customer"
_CITIES = "SELECT n_nationkey AS city_id, n_regionkey <> 2 AS is_active, n_name FROM nation"
_VISIBLE = f"""e AS ({_EVENTS}), s AS ({_SOURCES}), c AS ({_CITIES}), v AS (SELECT e.*, s.c_name, c.n_name FROM e JOIN s ON e.source_id = s.source_id JOIN c ON e.city_id = c.city_id
WHERE e.is_active AND archived_at IS NULL AND duplicate_status <> 'confirmed_duplicate' AND NOT is_recurrence_parent AND s.is_active AND active_version IS NOT NULL AND c.is_active
AND ((end_date IS NOT NULL AND end_date >= DATE '{TODAY}') OR (end_date IS NULL AND start_date IS NOT NULL AND start_date >= DATE '{TODAY}')))"""


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    for t in ("orders", "customer", "nation"):
        table(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(_EVENTS), spark.sql(_SOURCES), spark.sql(_CITIES)


def _visible(spark: SparkSession, d: str) -> DataFrame:
    return R.visible(*_tables(spark, d), TODAY)


@query(f"WITH {_VISIBLE} SELECT event_id, start_date, end_date FROM v")
def visible_events(spark, d):
    return _visible(spark, d).select("event_id", "start_date", "end_date")


@query(f"""WITH {_VISIBLE}, f AS (SELECT * FROM v WHERE (category_id = 3 OR category_override_id = 3) AND title ILIKE '%urg%' AND recurrence_parent_id IS NULL
AND coalesce(end_date, start_date) >= DATE '1996-07-01' AND start_date <= DATE '1998-12-31')
SELECT event_id, start_date, CAST((SELECT count(*) FROM f) AS BIGINT) AS total, (SELECT count(*) FROM f) > 24 AS has_next FROM f ORDER BY start_date, event_id LIMIT 12 OFFSET 12""")
def listing_filtered_page(spark, d):
    wanted = R.listing_filter(category=3, search="urg", recurrence="single", low="1996-07-01", high="1998-12-31", columns=("title",))
    return R.page_with_total(_visible(spark, d).where(wanted), [F.col("start_date").asc_nulls_first(), F.col("event_id")], 2, 12).select("event_id", "start_date", "total", "has_next")


@query(f"WITH {_VISIBLE} SELECT event_id, start_date FROM v WHERE event_id = (SELECT min(event_id) FROM v)")
def listing_point(spark, d):
    v = _visible(spark, d)
    first = v.agg(F.min("event_id").alias("event_id"))
    return v.join(F.broadcast(first), "event_id").select("event_id", "start_date")


@query("SELECT day, day + CAST(CASE WHEN isodow(day) = 7 THEN -1 ELSE 6 - isodow(day) END AS INTEGER) AS saturday, day + CAST(CASE WHEN isodow(day) = 7 THEN 0 ELSE 7 - isodow(day) END AS INTEGER) AS sunday FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)")
def date_presets(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", weekend_of(F.col("day")).alias("w")).select("day", "w.saturday", "w.sunday")


@query("WITH i AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS a, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE max(CAST(l_shipdate AS DATE)) END AS b FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, a, b FROM i WHERE a <= DATE '1996-03-31' AND coalesce(b, a) >= DATE '1996-02-01'")
def interval_overlap(spark, d):
    day = F.col("l_shipdate").cast("date")
    spans = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(day).alias("a"), F.max(day).alias("b")).withColumn("b", F.when(F.col("l_orderkey") % 5 != 0, F.col("b")))
    return spans.where(R.overlaps(F.col("a"), F.col("b"), "1996-02-01", "1996-03-31"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 7 = 0 THEN upper(p_brand) END, CASE WHEN p_partkey % 3 = 0 THEN p_brand END, p_type) AS label FROM part")
def layered_coalesce(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k, F.coalesce(F.when(k % 7 == 0, F.upper("p_brand")), F.when(k % 3 == 0, F.col("p_brand")), F.col("p_type")).alias("label"))


@query(f"WITH {_VISIBLE} SELECT event_id, round(CAST(coalesce(corrected_lat, lat) AS DOUBLE), 6) AS lat FROM v WHERE coalesce(corrected_lat, lat) IS NOT NULL ORDER BY start_date NULLS FIRST, event_id LIMIT 2000")
def map_points_topk(spark, d):
    points = _visible(spark, d).withColumn("lat", F.round(F.coalesce("corrected_lat", "lat").cast("double"), 6)).where("lat IS NOT NULL")
    return R.page(points, [F.col("start_date").asc_nulls_first(), F.col("event_id")], 1, 2000).select("event_id", "lat")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND o_orderstatus IN ('O', 'P')")
def in_lists(spark, d):
    o = table(spark, d, "orders")
    return o.where(R.in_list(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"], negate=True) & R.in_list(F.col("o_orderstatus"), ["O", "P"])).select("o_orderkey")


@query(f"WITH {_VISIBLE} SELECT n_name, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CAST(count(*) AS BIGINT) AS n FROM v WHERE n_name IS NOT NULL GROUP BY n_name")
def city_facet(spark, d):
    events, sources, cities = _tables(spark, d)
    counts = R.visible(events, sources, cities, TODAY).groupBy("city_id").agg(F.count("*").alias("n"))
    return counts.join(cities, "city_id").groupBy("n_name").agg(F.sum("n").alias("n")).select("n_name", slug(F.col("n_name")).alias("slug"), "n")


@query("SELECT event_id, start_date, CAST(greatest(start_date, DATE '1996-06-01') AS DATE) AS shown FROM (SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS start_date, o_custkey FROM orders) WHERE start_date IS NOT NULL ORDER BY greatest(start_date, DATE '1996-06-01'), o_custkey DESC, event_id LIMIT 50")
def undated_last(spark, d):
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderdate").cast("date")).alias("start_date"), "o_custkey")
    shown = F.when(F.col("start_date").isNotNull(), F.greatest("start_date", F.lit(TODAY).cast("date")))
    order = [F.when(shown.isNull(), 1).otherwise(0), shown, F.desc("o_custkey"), F.col("event_id")]
    return R.page(events.withColumn("shown", shown), order, 1, 50).select("event_id", "start_date", "shown")


@query("WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS fp, CASE WHEN doc_id % 10 = 0 THEN 'not_duplicate' ELSE 'not_reviewed' END AS status FROM documents) SELECT doc_id, CASE WHEN status = 'not_reviewed' AND count(*) OVER (PARTITION BY fp) > 1 THEN 'possible_duplicate' ELSE status END AS status FROM t")
def duplicate_flags(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fp"), F.when(F.col("doc_id") % 10 == 0, "not_duplicate").otherwise("not_reviewed").alias("status"))
    return R.duplicate_flags(docs, "fp", "status").select("doc_id", "status")


@query("SELECT fp, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT doc_id, sha256(replace(lower(trim(regexp_replace(coalesce(text, ''), '[\\s ]+', ' ', 'g'))), 'ß', 'ss')) AS fp FROM documents) GROUP BY fp")
def keep_first_dedup(spark, d):
    from tidemill.functions.text import normalized_title

    docs = table(spark, d, "documents").select(F.sha2(normalized_title(F.col("text")), 256).alias("fp"), "doc_id")
    return R.dedup_counted(docs, ["fp"], F.col("doc_id"))


@query("""SELECT 'status' AS section, o_orderstatus AS key, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'priority', coalesce(CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END, 'None'), CAST(count(*) AS BIGINT) FROM orders GROUP BY 2
UNION ALL SELECT 'segment', c_mktsegment, CAST(count(*) AS BIGINT) FROM customer GROUP BY 2""")
def report_key_values(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return R.key_values(status=R.facet(o, "o_orderstatus"), priority=R.facet(o.withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW"))), "p"), segment=R.facet(c, "c_mktsegment"))


@query("SELECT c_mktsegment, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_users, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS n_open, max(o_orderkey) AS newest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def distinct_users(spark, d):
    # Orders are merged by customer first, so the distinct count is a sum.
    by = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.max("o_orderkey").alias("newest"))
    return by.join(table(spark, d, "customer"), "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n_users"), F.sum("n_open").alias("n_open"), F.max("newest").alias("newest"))


@query("SELECT CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (value > 50) AS BIGINT) AS large, CAST(count(*) FILTER (event_type = 'view' AND value <= 50) AS BIGINT) AS small_views FROM events")
def dashboard_counts(spark, d):
    t, v = F.col("event_type"), F.col("value")
    return J.condition_counts(table(spark, d, "events"), errors=t == "error", large=v > 50, small_views=(t == "view") & (v <= 50))


@query("WITH m AS (SELECT trim(regexp_replace(x, '^ *candidate\\[[0-9]+\\]: *', '')) AS message FROM (SELECT unnest(string_split('candidate[' || p_partkey || ']: ' || p_brand || '; candidate[2]: ' || p_type || ';', ';')) AS x FROM part)) SELECT message, CAST(count(*) AS BIGINT) AS n FROM m WHERE message <> '' GROUP BY message")
def error_messages(spark, d):
    text = F.concat(F.lit("candidate["), F.col("p_partkey").cast("string"), F.lit("]: "), F.col("p_brand"), F.lit("; candidate[2]: "), F.col("p_type"), F.lit(";"))
    return R.error_groups(table(spark, d, "part").select(text.alias("errors")), "errors")


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (o_orderstatus IN ('F', 'P')) AS BIGINT) AS n_done, count(*) = count(*) FILTER (o_orderstatus IN ('F', 'P')) AS complete FROM orders GROUP BY o_custkey")
def batch_progress(spark, d):
    return R.progress(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "P"])


@query("SELECT o_orderkey, o_orderstatus, true AS has_next FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10 OFFSET 10")
def recent_with_more(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return R.page_plus_one(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], 2, 10).select("o_orderkey", "o_orderstatus", "has_next")
