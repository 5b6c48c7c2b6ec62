"""Joins with rules, ranks, defaults and caches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import joins as J
from tidemill.operators import relational as R
from tidemill.plans.registry import query
from tidemill.sources.tables import table

_RULES = [
    (1, "keyword", "shiny", 1, None, None, "BRASS", False, False), (2, "keyword", "flat", 5, None, None, "plated|rolled", True, False), (3, "source_mapping", "brand", 0, None, "brand#13", None, False, False),
    (4, "website_mapping", "site", 0, 3, "", None, False, True), (5, "venue", "hall", 9, None, None, "7", False, True), (6, "keyword", "dead", 99, None, None, "a", False, False), (7, "administrator_mapping", "admin", 0, None, "Brand#21", None, False, True),
]


def _rules(spark):
    rows = [(*r, r[0] != 6) for r in _RULES]
    return spark.createDataFrame(rows, "rule_id int, rule_type string, category string, priority int, website_id int, source_value string, pattern string, is_regex boolean, case_sensitive boolean, is_active boolean")


@query("""SELECT p_partkey, CASE WHEN lower(p_brand) = 'brand#13' THEN 'brand' WHEN p_brand = 'Brand#21' THEN 'admin' WHEN p_partkey % 10 = 3 THEN 'site' WHEN contains(CAST(p_size AS VARCHAR), '7') THEN 'hall' WHEN regexp_matches(lower(p_name || ' ' || p_type || ' ' || p_brand), 'plated|rolled') THEN 'flat' WHEN contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'brass') THEN 'shiny' ELSE 'other' END AS category,
CAST(CASE WHEN lower(p_brand) = 'brand#13' THEN 3 WHEN p_brand = 'Brand#21' THEN 7 WHEN p_partkey % 10 = 3 THEN 4 WHEN contains(CAST(p_size AS VARCHAR), '7') THEN 5 WHEN regexp_matches(lower(p_name || ' ' || p_type || ' ' || p_brand), 'plated|rolled') THEN 2 WHEN contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'brass') THEN 1 END AS INTEGER) AS rule_id FROM part""")
def first_rule_match(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_brand").alias("source_category"), (F.col("p_partkey") % 10).cast("int").alias("website_id"), F.col("p_size").cast("string").alias("venue"), F.col("p_name").alias("title"), F.col("p_type").alias("description"))
    return J.first_rule(parts, _rules(spark), "p_partkey").select("p_partkey", "category", "rule_id")


@query(r"""WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+', 0)), ':80$', '') AS origin, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS bare, regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1) AS q FROM pages),
k AS (SELECT page_id, origin, CASE WHEN bare = regexp_extract(bare, '^[a-zA-Z]+://[^/]+', 0) THEN bare || '/' ELSE bare END || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS own FROM p),
s AS (SELECT page_id AS id, own AS listing, origin || '/' AS base, CASE WHEN page_id % 4 = 0 THEN 2 WHEN page_id % 4 = 1 THEN 0 ELSE 1 END AS life, page_id % 2 = 0 AS whole FROM k WHERE page_id % 5 = 0),
m AS (SELECT k.page_id, s.life, 0 AS kind, s.id FROM k JOIN s ON NOT s.whole AND s.listing = k.own UNION ALL SELECT k.page_id, s.life, 1, s.id FROM k JOIN s ON s.base = k.own UNION ALL SELECT k.page_id, s.life, 2, s.id FROM k JOIN s ON s.whole AND s.base = k.origin || '/'),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY life, kind, id) AS n FROM m) SELECT page_id, id AS source_id, CASE kind WHEN 0 THEN 'listing_url' WHEN 1 THEN 'base_url' ELSE 'page_under_origin' END AS match FROM r WHERE n = 1""")
def ranked_source_match(spark, d):
    pages, k = table(spark, d, "pages"), F.col("page_id")
    base = F.concat(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+", 0), F.lit("/#top"))
    sources = pages.where(k % 5 == 0).select(k.alias("source_id"), base.alias("base_url"), F.when(k % 2 == 1, F.col("url")).alias("listing_url"), (k % 4 == 0).alias("archived"), (k % 4 == 1).alias("is_active"))
    return J.match_sources(pages, sources, "page_id", "url")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal > 0 END, true) AS in_app, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'daily' END ELSE 'immediate' END AS frequency FROM customer")
def preference_defaults(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    own = c.where(k % 3 == 0).select(k, (F.col("c_acctbal") > 0).alias("in_app"), F.when(k % 2 != 0, "daily").alias("frequency"))
    return J.with_defaults(c.select(k), own, "c_custkey", {"in_app": True, "frequency": "immediate"})


@query("WITH f AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'city' WHEN c_custkey % 3 = 1 THEN 'category' ELSE 'source' END AS kind, c_custkey % 40 AS target FROM customer), e AS (SELECT p_partkey, p_partkey % 25 AS city, p_partkey % 7 AS cat, CASE WHEN p_partkey % 6 = 0 THEN p_partkey % 5 END AS over, p_partkey % 90 AS src FROM part WHERE p_partkey <= 300) SELECT DISTINCT p_partkey, user_id FROM e JOIN f ON (kind = 'city' AND target = city) OR (kind = 'category' AND (target = cat OR target = over)) OR (kind = 'source' AND target = src)")
def follow_recipients(spark, d):
    k = F.col("c_custkey")
    follows = table(spark, d, "customer").select(k.alias("user_id"), F.when(k % 3 == 0, "city").when(k % 3 == 1, "category").otherwise("source").alias("kind"), (k % 40).alias("target"))
    p = F.col("p_partkey")
    events = table(spark, d, "part").where(p <= 300).select(p, (p % 25).alias("city"), (p % 7).alias("cat"), F.when(p % 6 == 0, p % 5).alias("over"), (p % 90).alias("src"))
    return J.recipients(events, follows, "p_partkey", {"city": ["city"], "category": ["cat", "over"], "source": ["src"]})


@query("WITH c AS (SELECT DISTINCT sha256(lower(s_name)) AS h, min(s_suppkey) OVER (PARTITION BY lower(s_name)) % 2 = 0 AS found FROM supplier), e AS (SELECT c_custkey, sha256('supplier#' || lpad(CAST(c_custkey % 200 AS VARCHAR), 9, '0')) AS h FROM customer) SELECT c_custkey, CASE WHEN found IS NULL THEN 'miss' WHEN found THEN 'hit' ELSE 'negative' END AS lookup FROM e LEFT JOIN c ON e.h = c.h")
def geocode_cache(spark, d):
    cache = table(spark, d, "supplier").groupBy(F.sha2(F.lower("s_name"), 256).alias("h")).agg((F.min("s_suppkey") % 2 == 0).alias("found"))
    rows = table(spark, d, "customer").select("c_custkey", F.sha2(F.concat(F.lit("supplier#"), F.lpad((F.col("c_custkey") % 200).cast("string"), 9, "0")), 256).alias("h"))
    return J.cache_lookup(rows, cache, "h", "found").select("c_custkey", "lookup")


@query("SELECT c_custkey, CASE WHEN n IS NOT NULL AND n % 4 <> 0 THEN n END AS choice FROM (SELECT c_custkey, coalesce(CASE WHEN c_custkey % 9 = 0 THEN CAST(c_custkey % 25 AS BIGINT) END, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS BIGINT) END, 3) AS n FROM customer)")
def policy_resolution(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k, F.when(k % 9 == 0, k % 25).alias("own"), F.when(k % 2 == 0, F.col("c_nationkey").cast("long")).alias("city"))
    choices = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") % 4 != 0).alias("ok"))
    return J.resolved(rows, choices, ["own", "city"], "id", "ok", 3).select("c_custkey", "choice")


@query("SELECT DISTINCT r_name, c_mktsegment FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def distinct_chain_permissions(spark, d):
    r = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    n, c = table(spark, d, "nation"), table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return J.chain(r, (n, "n_regionkey"), (c, "n_nationkey"), (o, "c_custkey"), select=["r_name", "c_mktsegment"])


@query("WITH n AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) SELECT o_custkey, o_orderkey, o_orderstatus FROM n JOIN orders USING (o_custkey, o_orderkey)")
def newest_decision(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_custkey", "o_orderkey", "o_orderstatus").join(J.newest(o, "o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"])


@query("WITH r AS (SELECT user_id, event_type, arg_max(value > 50, ts) AS ok FROM events GROUP BY 1, 2) SELECT c_custkey, max(ok) FILTER (event_type = 'click') AS click, max(ok) FILTER (event_type = 'purchase') AS purchase FROM customer LEFT JOIN r ON user_id = c_custkey GROUP BY c_custkey")
def decision_overlay(spark, d):
    results = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("kind"), F.col("ts").alias("at"), (F.col("value") > 50).alias("ok"))
    return J.overlay(table(spark, d, "customer").select("c_custkey"), results, "c_custkey", ["click", "purchase"])


@query("WITH a AS (SELECT DISTINCT o_custkey % 100 AS u, o_orderpriority AS p FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey % 90 AS u, o_orderpriority AS p FROM orders WHERE o_orderkey % 2 = 1) SELECT u, p, 'add' AS action FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT u, p, 'remove' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def permission_changes(spark, d):
    o = table(spark, d, "orders")
    side = lambda r, m: o.where(F.col("o_orderkey") % 2 == r).select((F.col("o_custkey") % m).alias("u"), F.col("o_orderpriority").alias("p"))
    return J.differences(side(0, 100), side(1, 90), ["u", "p"])


_PROFILE = "SELECT p_brand, count(*) AS n, count(*) FILTER (p_size > 10) AS n_valid, avg(CASE WHEN p_name LIKE '%a%' THEN 1.0 ELSE 0.0 END) AS cover, avg(CASE WHEN p_type LIKE '%TIN%' OR p_type LIKE '%tin%' THEN 1.0 ELSE 0.0 END) AS url_rate FROM part GROUP BY p_brand"


@query(f"SELECT p_brand, concat_ws(',', CASE WHEN n_valid < 60 THEN 'valid_count' END, CASE WHEN n_valid / n < 0.8 THEN 'valid_rate' END, CASE WHEN cover < 0.8 THEN 'coverage' END, CASE WHEN url_rate < 0.2 THEN 'url_rate' END) AS missed FROM ({_PROFILE})")
def decision_reasons(spark, d):
    part = table(spark, d, "part")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    profile = part.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 10).alias("n_valid"), share(F.col("p_name").like("%a%")).alias("cover"), share(F.col("p_type").like("%TIN%") | F.col("p_type").like("%tin%")).alias("url_rate"))
    bars = {"valid_count": F.col("n_valid") < 60, "valid_rate": R.ratio(F.col("n_valid"), F.col("n")) < 0.8, "coverage": F.col("cover") < 0.8, "url_rate": F.col("url_rate") < 0.2}
    return profile.select("p_brand", F.array_join(R.missed_bars(bars), ",").alias("missed"))


@query("WITH m AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id) AS best FROM events), r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM m WHERE value >= best - 5) SELECT user_id, event_id FROM r WHERE n = 1")
def near_tie_pick(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return R.near_best(e, "user_id", "value", 5.0, [F.col("event_id")]).select("user_id", "event_id")
