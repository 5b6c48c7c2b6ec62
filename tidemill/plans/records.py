"""Record extractors over documents that are packed from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators.candidates import normalize
from tidemill.plans.registry import query
from tidemill.sources import records as X
from tidemill.sources.tables import table



def _packed(spark, d, one, root):
    """Documents of all orders of a customer: (o_custkey, body), with a text among the objects."""
    o = table(spark, d, "orders")
    items = F.array_sort(F.collect_list(F.struct("o_orderkey", F.to_json(one, {"ignoreNullFields": "false"}).alias("j"))))
    body = F.concat(F.lit('["not an object",'), F.array_join(F.transform(items, lambda x: x["j"]), ","), F.lit("]"))
    return o.groupBy("o_custkey").agg(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in root(body))).alias("body"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS external_source_id, 'Order ' || o_orderpriority AS title, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || CASE WHEN o_orderkey % 20 = 0 THEN '' ELSE 'T19:30:00' END AS start_datetime, CASE WHEN o_orderkey % 30 = 0 THEN NULL ELSE 'http://i/' || o_orderkey END AS image, 'Hall ' || o_custkey AS venue, concat_ws(', ', CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE 'Main 1' END, 'Town') AS address FROM orders")
def json_calendar(spark, d):
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    one = F.struct(
        k.alias("id"), F.concat(F.lit("Order "), "o_orderpriority").alias("title"), F.concat(day, F.lit(" 19:30:00")).alias("start_date"), (k % 20 == 0).alias("all_day"),
        F.when(k % 30 != 0, F.struct(F.concat(F.lit("http://i/"), k.cast("string")).alias("url"))).alias("image"),
        F.struct(F.concat(F.lit("Hall "), F.col("o_custkey").cast("string")).alias("venue"), F.when(k % 40 == 0, "").otherwise("Main 1").alias("address"), F.lit("Town").alias("city")).alias("venue"),
    )
    docs = _packed(spark, d, one, lambda b: ('{"total": 3, "events": ', b, "}"))
    return X.calendar(docs, "o_custkey", "body").select("external_source_id", "title", "start_datetime", "image", "venue", "address")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS external_source_id, 'P ' || o_orderpriority AS title, '<p>' || o_orderstatus || '</p>' AS description, 'http://x/' || o_orderkey AS canonical_url FROM orders")
def json_posts(spark, d):
    k = F.col("o_orderkey")
    one = F.struct(k.alias("id"), F.struct(F.concat(F.lit("P "), "o_orderpriority").alias("rendered")).alias("title"), F.struct(F.concat(F.lit("<p>"), "o_orderstatus", F.lit("</p>")).alias("rendered")).alias("content"), F.concat(F.lit("http://x/"), k.cast("string")).alias("link"))
    return X.posts(_packed(spark, d, one, lambda b: (b,)), "o_custkey", "body").select("external_source_id", "title", "description", "canonical_url")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS external_source_id, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || CASE WHEN o_orderkey % 20 = 0 THEN '' ELSE 'T00:00:00' END AS start_datetime, CASE WHEN o_orderkey % 30 = 0 THEN 'plain.png' ELSE 'md' || o_orderkey END AS image, CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE 'Group ' || o_orderstatus END AS source_category FROM orders")
def json_offset_feed(spark, d):
    k = F.col("o_orderkey")
    image = F.when(k % 30 == 0, F.lit('"plain.png"')).otherwise(F.concat(F.lit('{"md": "md'), k.cast("string"), F.lit('", "lg": "", "sm": "small"}')))
    groups = F.when(k % 40 == 0, "[]").otherwise(F.concat(F.lit('[{"title": "Group '), F.col("o_orderstatus"), F.lit('"}]')))
    seconds = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86400
    text = F.concat(F.lit('{"id": null, "event_id": '), k.cast("string"), F.lit(', "date_ts": '), seconds.cast("string"), F.lit(', "all_day": '), (k % 20 == 0).cast("string"), F.lit(', "photo": '), image, F.lit(', "groups": '), groups, F.lit("}"))
    o = table(spark, d, "orders")
    docs = o.groupBy("o_custkey").agg(F.concat(F.lit('{"events": [1, '), F.array_join(F.array_sort(F.collect_list(text)), ","), F.lit("]}")).alias("body"))
    return X.offset_feed(docs, "o_custkey", "body").select("external_source_id", "start_datetime", "image", "source_category")


@query(f"SELECT CASE WHEN o_orderkey % 20 = 0 THEN 'r' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS external_source_id, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS start_datetime, CASE WHEN o_orderkey % 30 = 0 THEN NULL ELSE 'Place ' || o_orderstatus END AS venue, CASE WHEN o_orderkey % 40 = 0 THEN 'http://ok/' END AS image, 'A|' || o_orderpriority AS categories, 'A' AS source_category, 'Town' AS address FROM orders")
def json_nested_docs(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(
        F.when(k % 20 == 0, F.concat(F.lit('{"recid": "r'), k.cast("string"), F.lit('", "_id": "z"'))).otherwise(F.concat(F.lit('{"recid": "", "id": '), k.cast("string"))), F.lit(', "date": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('", "startDate": ""'),
        F.when(k % 30 == 0, ', "location": {"size": 3}').otherwise(F.concat(F.lit(', "location": [{"label": "Place '), F.col("o_orderstatus"), F.lit('"}]'))), F.lit(', "city": "Town", "media_raw": [{"url": "javascript:x", "src": '), F.when(k % 40 == 0, '" http://ok/ "').otherwise("false"), F.lit('}], "categories": [" A ", {"name": "A"}, 4, {"label": "'), F.col("o_orderpriority"), F.lit('"}]}'),
    )
    o = table(spark, d, "orders")
    docs = o.groupBy("o_custkey").agg(F.concat(F.lit('{"docs": {"count": 1, "docs": ["x", '), F.array_join(F.array_sort(F.collect_list(text)), ","), F.lit("]}}")).alias("body"))
    return X.nested_docs(docs, "o_custkey", "body").select("external_source_id", "start_datetime", "venue", "image", "categories", "source_category", "address")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS external_source_id, o_orderpriority AS title, o_orderstatus AS venue FROM orders")
def json_hits(spark, d):
    one = F.struct(F.col("o_orderkey").cast("string").alias("objectID"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("venue"))
    return X.hits(_packed(spark, d, one, lambda b: ('{"nbHits": 1, "hits": ', b, "}")), "o_custkey", "body").select("external_source_id", "title", "venue")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS external_source_id, o_orderpriority AS title FROM orders")
def script_records(spark, d):
    one = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    docs = _packed(spark, d, one, lambda b: ('<html><script>var x = "</p>";</script><script type="application/json">{"a": {"events": ', b, '}}</script><script type="application/json">{broken</script></html>'))
    return X.script_json(docs, "o_custkey", "body", root="a.events").select("external_source_id", "title")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS external_source_id, o_orderpriority AS title FROM orders")
def page_data_records(spark, d):
    one = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    docs = _packed(spark, d, one, lambda b: ('<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"events": ', b, "}}}</script>"))
    return X.page_data(docs, "o_custkey", "body", "props.pageProps.events").select("external_source_id", "title")


@query(f"SELECT 'N ' || o_orderkey AS title, CASE WHEN o_orderkey % 20 = 0 THEN 'Hall' END AS venue, CASE WHEN o_orderkey % 20 = 0 THEN '1 St, Town' ELSE 'plain' END AS address, 'i' || o_orderkey AS image, CASE WHEN o_orderkey % 30 = 0 THEN 'http://offer/' ELSE 'http://e/' || o_orderkey END AS canonical_url FROM orders")
def linked_data_records(spark, d):
    k = F.col("o_orderkey")
    node = F.concat(
        F.lit('{"@type": '), F.when(k % 20 == 0, '["Thing", "MusicEvent"]').otherwise('"event"'), F.lit(', "name": "N '), k.cast("string"), F.lit('", "image": '), F.when(k % 20 == 0, F.concat(F.lit('[{"url": "i'), k.cast("string"), F.lit('"}]'))).otherwise(F.concat(F.lit('"i'), k.cast("string"), F.lit('"'))),
        F.lit(', "location": '), F.when(k % 20 == 0, '{"name": "Hall", "address": {"streetAddress": "1 St", "addressLocality": "Town", "postalCode": ""}}').otherwise('{"address": "plain"}'), F.when(k % 30 != 0, F.concat(F.lit(', "url": "http://e/'), k.cast("string"), F.lit('"'))).otherwise(', "offers": {"url": "http://offer/"}'), F.lit("}"),
    )
    o = table(spark, d, "orders")
    docs = o.groupBy("o_custkey").agg(F.concat(F.lit('<script type="application/ld+json">{bad</script><SCRIPT type="application/ld+json">[{"@graph": [{"@type": "Organization", "name": "x"}, '), F.array_join(F.array_sort(F.collect_list(node)), ","), F.lit("]}]</SCRIPT>")).alias("body"))
    return X.linked_data(docs, "o_custkey", "body", offers_as_url=True).select("title", "venue", "address", "image", "canonical_url")


@query("SELECT 'u' || p_partkey AS external_source_id, p_name || ', more' AS title, CASE WHEN p_partkey % 2 = 0 THEN '2026-05-01' ELSE '2026-05-01T19:30:00' END AS start_datetime, p_partkey % 2 = 0 AS all_day, p_brand || ', x' AS source_category, p_partkey % 3 = 0 AS cancelled, CASE WHEN p_partkey % 5 = 0 THEN 'FREQ=WEEKLY;COUNT=3' END AS rrule FROM part")
def ics_records(spark, d):
    k = F.col("p_partkey")
    event = F.concat(
        F.lit("BEGIN:VEVENT\r\nUID:u"), k.cast("string"), F.lit("\r\nSUMMARY:"), F.col("p_name"), F.lit("\\, mo\r\n re\r\nDTSTART"), F.when(k % 2 == 0, ";VALUE=DATE:20260501").otherwise(";TZID=Europe/Berlin:20260501T193000"), F.lit("\r\nCATEGORIES:"), F.col("p_brand"), F.lit(",x\r\nSTATUS:"), F.when(k % 3 == 0, "cancelled").otherwise("CONFIRMED"),
        F.when(k % 5 == 0, "\r\nRRULE:FREQ=WEEKLY;COUNT=3").otherwise(""), F.lit("\r\nEND:VEVENT\r\n"),
    )
    docs = table(spark, d, "part").groupBy("p_size").agg(F.concat(F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\n"), F.array_join(F.array_sort(F.collect_list(event)), ""), F.lit("END:VCALENDAR\r\n")).alias("body"))
    return X.calendar_file(docs, "p_size", "body").select("external_source_id", "title", "start_datetime", "all_day", "source_category", "cancelled", "rrule")


@query("SELECT 'g' || p_partkey AS external_source_id, p_name || ' & <b>co</b>' AS title, CASE WHEN p_size % 2 = 0 THEN 'http://rss/' ELSE 'http://atom/' END || p_partkey AS canonical_url, p_brand AS start_datetime FROM part")
def rss_records(spark, d):
    k, even = F.col("p_partkey").cast("string"), F.col("p_size") % 2 == 0
    rss = F.concat(F.lit("<item><title>"), F.col("p_name"), F.lit(" &amp; &lt;b&gt;co&lt;/b&gt;</title><link>http://rss/"), k, F.lit("</link><guid>g"), k, F.lit("</guid><pubDate>Mon, 01 Jan 2001</pubDate><ev:startdate>"), F.col("p_brand"), F.lit("</ev:startdate></item>"))
    atom = F.concat(F.lit("<entry><title><![CDATA["), F.col("p_name"), F.lit(' & <b>co</b>]]></title><link rel="self" href="http://self/"/><link href="http://atom/'), k, F.lit('"/><id>g'), k, F.lit("</id><published>2001-01-01</published><startdate>"), F.col("p_brand"), F.lit("</startdate></entry>"))
    docs = table(spark, d, "part").groupBy("p_size").agg(F.array_join(F.array_sort(F.collect_list(F.when(even, rss).otherwise(atom))), "").alias("items"))
    body = F.when(even, F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>no</title>'), "items", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>no</title>'), "items", F.lit("</feed>\n")))
    return X.feed(docs.select("p_size", body.alias("body")), "p_size", "body", "startdate").select("external_source_id", "title", "canonical_url", "start_datetime")


@query("SELECT event_id, CAST(regexp_extract(props, ':\\s*([0-9]+)', 1) AS BIGINT) AS k, 'BIGINT' AS kind, false AS other FROM events")
def json_props(spark, d):
    e = table(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    kind = F.when(X.kind_of(F.col("v"), "k").isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "BIGINT")
    return e.select("event_id", X.value(F.col("v"), "k", "bigint").alias("k"), kind.alias("kind"), X.value(F.col("v"), "missing.x[0]").isNotNull().alias("other"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS external_source_id, 'Order ' || o_orderpriority AS title, CASE o_orderkey % 4 WHEN 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS start_date, CASE WHEN o_orderkey % 4 = 0 THEN '19:30:00' END AS start_time, 'http://site.example/e/' || o_orderkey AS canonical_url, CASE WHEN o_orderkey % 4 = 2 THEN 'date_range_ambiguous:missing_year,unparseable_start_date:May 1' ELSE '' END AS warnings FROM orders")
def normalized_candidates(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    start = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'19:30:00".replace("19:30:00", "'19:30:00'").replace("'T''19:30:00'", "'T19:30:00'"))).when(k % 4 == 2, "May 1").otherwise(F.date_format("o_orderdate", "MMM d, yyyy"))
    raw = o.select(k.cast("string").alias("external_source_id"), F.concat(F.lit("  Order\t "), "o_orderpriority").alias("title"), start.alias("start_datetime"), F.concat(F.lit("e/"), k.cast("string")).alias("canonical_url"), F.lit("http://site.example/list?x=1").alias("page"))
    return normalize(raw, "page").select("external_source_id", "title", "start_date", "start_time", "canonical_url", F.array_join("warnings", ",").alias("warnings"))


@query(r"SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\b[^>]*href')) AS INTEGER) AS n_links FROM pages")
def page_metadata(spark, d):
    return X.page_metadata(table(spark, d, "pages"), "page_id", "html", "url").select("page_id", "n_links")
