"""Scalar functions over the driver's tables: text keys, URLs, dates, places."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import dates as D
from tidemill.functions import text as T
from tidemill.functions import urls as U
from tidemill.functions.geo import GeoFilter
from tidemill.operators import relational as R
from tidemill.plans.registry import query
from tidemill.sources.tables import table


@query(r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[\s ]+', ' ', 'g'))) AS collapsed, sha256(replace(lower(trim(regexp_replace(coalesce(text, ''), '[\s ]+', ' ', 'g'))), 'ß', 'ss')) AS folded, sha256(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '-')) AS slug FROM documents")
def text_keys(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(T.collapsed(F.coalesce(t, F.lit(""))), 256).alias("collapsed"), F.sha2(T.normalized_title(t), 256).alias("folded"), F.sha2(T.slug(F.coalesce(t, F.lit(""))), 256).alias("slug"))


_VARIANTS = "SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN upper(substring(url, 1, 5)) || substring(url, 6, 2000) WHEN 2 THEN regexp_replace(url, '^(https?://[^/?#]+)', 'http://Example.ORG:80') WHEN 3 THEN ' ' || regexp_replace(url, '[?#].*$', '') || '//' WHEN 4 THEN 'garbage ' || page_id WHEN 5 THEN 'https://me:pw@host.example.co.uk:443/a/' || page_id || '/?b=2&a=&b=1#x' WHEN 6 THEN 'https://10.0.0.' || (page_id % 200) || ':8443/p' ELSE '' END AS url FROM pages"
_SPLIT = rf"""v AS ({_VARIANTS}), p AS (SELECT page_id, trim(url) AS u FROM v), a AS (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS s, regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1) AS au,
regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(regexp_replace(u, '#.*$', ''), '\?(.*)$', 1) AS q FROM p),
b AS (SELECT *, lower(regexp_replace(regexp_replace(au, '^.*@', ''), ':.*$', '')) AS h, regexp_extract(au, ':([0-9]+)$', 1) AS port, CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END AS pa, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '')), '&') AS sq FROM a),
c AS (SELECT page_id, CASE WHEN h = '' THEN '' ELSE s || '://' || h || CASE WHEN port = '' OR (s = 'http' AND port = '80') OR (s = 'https' AND port = '443') THEN '' ELSE ':' || port END || pa || CASE WHEN sq = '' THEN '' ELSE '?' || sq END END AS canonical, h, s, au FROM b)"""


def _pages(spark, d):
    table(spark, d, "pages").createOrReplaceTempView("pages")
    return spark.sql(_VARIANTS)


@query(f"WITH {_SPLIT} SELECT page_id, canonical FROM c")
def url_canonical(spark, d):
    return _pages(spark, d).select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query(rf"WITH {_SPLIT} SELECT page_id, CASE WHEN canonical = '' THEN '' ELSE regexp_extract(canonical, '^[a-z]+://[^/]+', 0) || '/' END AS origin, canonical <> '' AND regexp_matches(canonical, '^[a-z]+://[^/]+/(\?.*)?$') AS whole_site, CASE WHEN h = '' THEN NULL WHEN regexp_matches(replace(h, '.', ''), '^[0-9]+$') THEN h WHEN len(string_split(h, '.')) <= 2 THEN h WHEN regexp_matches(h, '\.co\.uk$') THEN array_to_string(string_split(h, '.')[-3:], '.') ELSE array_to_string(string_split(h, '.')[-2:], '.') END AS domain FROM c WHERE h <> ''")
def url_origins(spark, d):
    u = F.col("url")
    return _pages(spark, d).where(U.host(u) != "").select("page_id", U.canonical_origin(u).alias("origin"), U.is_origin_only(u).alias("whole_site"), U.registrable_domain(u).alias("domain"))


@query(f"WITH {_SPLIT} SELECT page_id, CASE page_id % 8 WHEN 7 THEN 'missing' WHEN 4 THEN 'no scheme' WHEN 5 THEN 'credentials' WHEN 6 THEN 'address' END AS problem FROM c")
def url_safety(spark, d):
    return _pages(spark, d).select("page_id", U.public_url_problem(F.col("url")).alias("problem"))


@query(r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS bare, regexp_extract(url, '^https?://[^/?#]+', 0) || '/x/' || page_id AS rooted, CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])page=[^&#]*', '\1page=7') WHEN contains(url, '?') THEN regexp_replace(url, '#.*$', '') || '&page=7' ELSE regexp_replace(url, '#.*$', '') || '?page=7' END AS next FROM pages")
def url_links(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", U.without_query(u).alias("bare"), U.absolute(u, F.concat(F.lit("/x/"), F.col("page_id").cast("string"))).alias("rooted"), U.with_param(u, "page", F.lit(7)).alias("next"))


@query(r"""WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN ' id ' || o_orderkey END AS ext, CASE WHEN o_orderkey % 3 = 0 THEN 'HTTP://Shop.example/' || o_custkey || '/?z=1&a=2' WHEN o_orderkey % 3 = 1 THEN '' END AS url, '  Order ß ' || o_custkey AS title, CAST(o_orderdate AS DATE) AS day, o_custkey % 25 AS city FROM orders)
SELECT o_orderkey, sha256(CASE WHEN ext IS NOT NULL THEN 'external|9|' || trim(ext) WHEN coalesce(url, '') <> '' THEN 'url|http://shop.example/' || regexp_extract(url, '/([0-9]+)/', 1) || '?a=2&z=1' ELSE 'composite|order ss ' || trim(title)[9:] || '|' || day || '||hall|' || CASE WHEN city = 0 THEN '' ELSE CAST(city AS VARCHAR) END END) AS fp FROM e""")
def event_fingerprints(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    url = F.when(k % 3 == 0, F.concat(F.lit("HTTP://Shop.example/"), F.col("o_custkey").cast("string"), F.lit("/?z=1&a=2"))).when(k % 3 == 1, "")
    external = F.when(k % 4 == 0, F.concat(F.lit(" id "), k.cast("string")))
    return o.select(k, T.event_fingerprint(F.lit(9), external, url, F.concat(F.lit("  Order ß "), F.col("o_custkey").cast("string")), F.col("o_orderdate").cast("date"), F.lit(None).cast("string"), F.lit("Hall "), F.col("o_custkey") % 25).alias("fp"))


_FORMATS = ("%B %d, %Y", "%a %d %b %Y", "%m/%d/%Y", "%d.%m.%y")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def date_parse_formats(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    shown = F.when(k % 6 == 0, F.date_format(t, "MMMM d, yyyy")).when(k % 6 == 1, F.date_format(t, "EEE dd MMM yyyy")).when(k % 6 == 2, F.date_format(t, "MM/dd/yyyy")).when(k % 6 == 3, F.date_format(t, "dd.MM.yy")).when(k % 6 == 4, F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit("T10:00"))).otherwise(F.date_format(t, "'on' yyyy-MM-dd"))
    return table(spark, d, "orders").select(k, D.parse_date(shown, _FORMATS).alias("day"))


@query("WITH e AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_custkey % 40 AS INTEGER) AS b FROM orders) SELECT o_orderkey, CASE o_orderkey % 8 WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 4 THEN CASE WHEN a > b THEN NULL ELSE a END ELSE a END AS start, CASE WHEN o_orderkey % 8 IN (0, 1, 4, 5) THEN b END AS stop, CASE o_orderkey % 8 WHEN 0 THEN 'iso_range' WHEN 1 THEN 'explicit_both' WHEN 2 THEN 'single' WHEN 3 THEN 'iso_single' WHEN 4 THEN 'iso_range' WHEN 5 THEN 'explicit_both' END AS form, CASE o_orderkey % 8 WHEN 6 THEN 'missing_year' WHEN 7 THEN 'unparseable' END AS reason FROM e")
def date_range_forms(spark, d):
    k, a = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    b = F.date_add(a, (F.col("o_custkey") % 40).cast("int"))
    f = lambda c, p: F.date_format(c, p)
    shown = (
        F.when(k % 8 == 0, F.concat(f(a, "yyyy-MM-dd"), F.lit(" to "), f(b, "yyyy-MM-dd"))).when(k % 8 == 1, F.concat(f(a, "EEE, MMM d, yyyy"), F.lit(" - "), f(b, "EEEE MMMM d, yyyy"))).when(k % 8 == 2, f(a, "MMMM d / yyyy")).when(k % 8 == 3, f(a, "yyyy-MM-dd"))
        .when(k % 8 == 4, F.concat(f(a, "yyyy-MM-dd"), F.lit("/"), f(b, "yyyy-MM-dd"))).when(k % 8 == 5, F.concat(f(a, "MMM. d yyyy"), F.lit("–"), f(b, "MMM. d, yyyy"))).when(k % 8 == 6, f(a, "MMM d")).otherwise("next Friday")
    )
    r = table(spark, d, "orders").select(k, D.parse_range(shown).alias("r"))
    return r.select("o_orderkey", F.col("r.start").alias("start"), F.col("r.end").alias("stop"), F.col("r.form").alias("form"), F.col("r.reason").alias("reason"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS time, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def time_forms(spark, d):
    t, k = F.col("ts"), F.col("event_id")
    shown = F.when(k % 3 == 0, F.date_format(t, "HH:mm:ss'-05:00'")).when(k % 3 == 1, F.date_format(t, "h:mm:ss a")).otherwise(F.date_format(t, "HH:mm:ss"))
    return table(spark, d, "events").select(k, D.parse_time(shown, ["%I:%M:%S %p"]).alias("time"), D.epoch_iso(F.floor(F.unix_micros(t.cast("timestamp")) / 1_000_000)).alias("iso"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%dT') || '00:00:00.000Z' AS start, strftime(CAST(o_orderdate AS DATE) + 2, '%Y-%m-%dT') || '23:59:59.999Z' AS stop FROM orders")
def day_windows(spark, d):
    b = D.day_bounds_utc(F.col("o_orderdate").cast("date"), "UTC", 3)
    return table(spark, d, "orders").select("o_orderkey", b.alias("b")).select("o_orderkey", "b.start", F.col("b.end").alias("stop"))


@query("SELECT n, CAST(least(5.0 * pow(2, n - 1), 300.0) AS DOUBLE) AS seconds FROM (SELECT DISTINCT CAST(l_linenumber AS INTEGER) AS n FROM lineitem)")
def retry_backoff(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("n")).distinct().select("n", D.backoff(F.col("n"), 5, 300).alias("seconds"))


@query("SELECT part.p_partkey, CASE WHEN p_type ILIKE '%steel%' THEN 'metal' WHEN p_type ILIKE '%tin%' THEN 'soft' WHEN p_type ILIKE '%a%' THEN 'other' END AS category FROM part")
def keyword_categories(spark, d):
    return table(spark, d, "part").select("p_partkey", T.keyword_category(F.col("p_type"), [("steel", "metal"), ("tin", "soft"), ("a", "other")]).alias("category"))


_GEO = """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE n_name || ' street 47' || lpad(CAST(c_custkey % 900 AS VARCHAR(5)), 3, '0') END AS address, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE -90 + (c_custkey * 37 % 18000) / CAST(100.0 AS DOUBLE) END AS lat,
CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE -180 + (c_custkey * 91 % 36000) / CAST(100.0 AS DOUBLE) END AS lon FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@query(rf"""WITH g AS ({_GEO}), t AS (SELECT *, lower(coalesce(address, '')) AS text, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(10.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10.0)) * pow(sin(radians(20.0 - lon) / 2), 2)))) AS km FROM g),
r AS (SELECT *, regexp_matches(text, '\bfrance\b') OR regexp_matches(text, '\bchina\b') AS place, regexp_matches(text, '\b472') AS postal, CASE WHEN lat IS NOT NULL THEN km <= 4000 END AS near, CASE WHEN lat IS NOT NULL THEN lat BETWEEN 0 AND 45 AND lon BETWEEN -20 AND 40 END AS boxed FROM t)
SELECT c_custkey, CASE WHEN text = '' AND lat IS NULL THEN 'missing_review' WHEN place OR postal OR coalesce(near, false) OR coalesce(boxed, false) THEN 'included' ELSE 'excluded' END AS outcome,
CASE WHEN text = '' AND lat IS NULL THEN '' ELSE concat_ws(',', CASE WHEN place THEN 'localities' END, CASE WHEN postal THEN 'postal' END, CASE WHEN near THEN 'radius' END, CASE WHEN boxed THEN 'bounding_box' END) END AS matched FROM r""")
def geo_filter(spark, d):
    for t in ("customer", "nation"):
        table(spark, d, t).createOrReplaceTempView(t)
    rule = GeoFilter(localities=["France"], aliases={"France": ["China"]}, postal_prefixes=["472"], radius=(10.0, 20.0, 4000.0), box=(0.0, 45.0, -20.0, 40.0), missing="needs_review")
    g = spark.sql(_GEO).withColumn("g", rule.decision(F.col("address"), F.lit(None).cast("string"), F.col("lat"), F.col("lon")))
    return g.select("c_custkey", "g.outcome", F.array_join("g.matched", ",").alias("matched"))


_FAULTS = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS a, CAST(o_orderdate AS DATE) + CAST(o_custkey % 20 - 2 AS INT) AS b,
CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 120 END AS DOUBLE) AS lat, CAST(CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey % 200 END AS DOUBLE) AS lon, CASE WHEN o_orderkey % 13 = 0 THEN 'x <SCRIPT>y' ELSE 'fine' END AS note FROM orders"""


@query(f"""WITH f AS ({_FAULTS}) SELECT o_orderkey, concat_ws(',', CASE WHEN title = '' THEN 'title' END, CASE WHEN a IS NULL THEN 'start_date' END, CASE WHEN b < a THEN 'end_before_start' END, CASE WHEN lat > 90 THEN 'latitude' END, CASE WHEN lon > 180 THEN 'longitude' END,
CASE WHEN (lat IS NULL) <> (lon IS NULL) THEN 'half_coordinates' END, CASE WHEN lower(note) LIKE '%<script%' THEN 'script' END) AS reasons FROM f""")
def validate_reasons(spark, d):
    from tidemill.operators.candidates import problems

    table(spark, d, "orders").createOrReplaceTempView("orders")
    f = spark.sql(_FAULTS)
    checks = problems(title=F.col("title"), start_date=F.col("a"), end_date=F.col("b"), latitude=F.col("lat"), longitude=F.col("lon"), description=F.col("note"))
    return f.select("o_orderkey", F.array_join(R.reasons(checks), ",").alias("reasons"))


_TEXTS = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'All day on 2026-05-01' WHEN 1 THEN 'May 5 at noon' WHEN 2 THEN '3/4/26 all-day' WHEN 3 THEN 'maybe later' WHEN 4 THEN '5 June' ELSE '=+cmd 12' END AS t, CASE WHEN p_partkey % 3 = 0 THEN 'eventTitle-box_2' WHEN p_partkey % 3 = 1 THEN 'a1b2c3d4' ELSE 'card' END AS c, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_partkey % 101) / CAST(100.0 AS DOUBLE) END AS share FROM part"


@query(f"""WITH t AS ({_TEXTS}) SELECT p_partkey, p_partkey % 6 = 0 AS has_year, p_partkey % 6 IN (0, 2) AS all_day, p_partkey % 6 IN (0, 1, 2, 4) AS dated, CASE WHEN p_partkey % 6 = 5 THEN 'cmd 12' ELSE t END AS clean, CASE p_partkey % 3 WHEN 0 THEN 'event,title,box' WHEN 1 THEN 'a1b2c3d4' ELSE 'card' END AS tokens,
p_partkey % 3 <> 1 AS stable, CASE p_partkey % 3 WHEN 0 THEN 'eventtitlebox2' WHEN 1 THEN 'a1b2c3d4' ELSE 'card' END AS key, CASE WHEN share IS NULL THEN '—' ELSE CAST(round_even(share * 100, 0) AS INTEGER) || '%' END AS percent FROM t""")
def scalar_forms(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part")
    t, c = F.col("t"), F.col("c")
    return spark.sql(_TEXTS).select("p_partkey", D.has_year(t).alias("has_year"), D.is_all_day(t).alias("all_day"), D.looks_dated(t).alias("dated"), T.without_formula(t).alias("clean"), F.array_join(T.name_tokens(c), ",").alias("tokens"), T.stable_class(c).alias("stable"), T.json_key(c).alias("key"), T.percent(F.col("share")).alias("percent"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(ts AS DATE) END AS day, CASE WHEN event_id % 3 = 1 THEN strftime(ts, '%H:%M:%S') END AS time, strftime(ts, '%a, %b ') || CAST(day(ts) AS VARCHAR) AS shown, event_id % 2 = 0 AS dst FROM events")
def temporal_forms(spark, d):
    k, ts = F.col("event_id"), F.col("ts")
    shown = F.when(k % 3 == 0, F.date_format(ts, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).otherwise("tomorrow")
    e = table(spark, d, "events").select(k, ts, D.temporal(shown).alias("x"))
    return e.select(k, "x.day", "x.time", D.human_date(ts).alias("shown"), F.when(k % 2 == 0, D.observes_dst("Europe/Berlin")).otherwise(D.observes_dst("Asia/Tokyo")).alias("dst"))
