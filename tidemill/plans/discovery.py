"""Discovery of record arrays over documents packed from the driver's tables, whole tables each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import detection as N
from tidemill.operators import discovery as D
from tidemill.plans.registry import query
from tidemill.sources.tables import table


def packed_orders(spark, d):
    """One document for each customer with orders: an array of orders, each with an array of its lines, at a place that depends on the customer."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_returnflag").alias("name"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("when"))))
    per_order = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(lines.alias("lines"))
    o = table(spark, d, "orders").join(per_order, "o_orderkey", "left")
    k = F.col("o_orderkey")
    one = F.struct(k.alias("id"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("Title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start-date"), F.struct(F.lit("Hall").alias("name")).alias("venue"), F.transform("lines", lambda x: F.struct(x["name"].alias("name"), x["when"].alias("when"))).alias("lines"))
    orders = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), one.alias("one")))).alias("all"))
    body = F.to_json(F.transform("all", lambda x: x["one"]))
    c = F.col("o_custkey")
    shapes = [("", ""), ('{"total": 2, "results": {"hits": ', "}}"), ('{"tags": ["a", 1], "a": {"b": {"c": {"d": ', "}}}}"), ('{"list": [1, {"x": null}, ', "]}")]
    out = F.concat(F.lit(shapes[0][0]), body, F.lit(shapes[0][1]))
    for i, (before, after) in enumerate(shapes[1:], 1):
        out = F.when(c % 4 == i, F.concat(F.lit(before), body, F.lit(after))).otherwise(out)
    return orders.select("o_custkey", out.alias("body"))


# The documents anew, and their nodes by recursion over JSON values.
_DOCS = """l AS (SELECT l_orderkey, list({'name': l_returnflag, 'when': strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d')} ORDER BY l_linenumber, l_returnflag, l_shipdate) AS lines FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey, to_json(list(json_merge_patch(json_object('id', o_orderkey, 'start-date', strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d'), 'venue', json_object('name', 'Hall')), CASE WHEN o_orderkey % 3 <> 0 THEN json_object('Title', o_orderpriority) ELSE '{}' END, CASE WHEN lines IS NOT NULL THEN json_object('lines', lines) ELSE '{}' END) ORDER BY o_orderkey)) AS j FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1),
d AS (SELECT o_custkey, CAST(CASE o_custkey % 4 WHEN 0 THEN j ELSE CASE o_custkey % 4 WHEN 1 THEN '{"total": 2, "results": {"hits": ' || j || '}}' WHEN 2 THEN '{"tags": ["a", 1], "a": {"b": {"c": {"d": ' || j || '}}}}' ELSE '{"list": [1, {"x": null}, ' || j || ']}' END END AS JSON) AS j FROM o)"""
_NODES = f"""RECURSIVE {_DOCS},
n AS (SELECT o_custkey, '' AS path, 0 AS depth, j FROM d UNION ALL
SELECT n.o_custkey, CASE WHEN t.arr THEN n.path || '[' || t.k || ']' WHEN n.path = '' THEN t.k ELSE n.path || '.' || t.k END, n.depth + 1, t.v
FROM n, LATERAL (SELECT unnest(CASE json_type(n.j) WHEN 'OBJECT' THEN json_keys(n.j) WHEN 'ARRAY' THEN list_transform(range(CAST(least(json_array_length(n.j), 50) AS BIGINT)), lambda x: CAST(x AS VARCHAR)) ELSE [] END) AS k, json_type(n.j) = 'ARRAY' AS arr) AS u(k, arr),
LATERAL (SELECT u.k, u.arr, CASE WHEN u.arr THEN json_extract(n.j, '$[' || u.k || ']') ELSE json_extract(n.j, '$."' || u.k || '"') END AS v) AS t(k, arr, v) WHERE n.depth < 8),
a AS (SELECT o_custkey, path, depth, list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) = 'OBJECT') AS found FROM n WHERE json_type(j) = 'ARRAY'),
s AS (SELECT o_custkey, CASE WHEN path = '' THEN '$' ELSE path END AS path, depth, len(found) AS size, list_filter(found, lambda x: (list_has_any(json_keys(x), ['Title', 'name'])) AND list_has_any(json_keys(x), ['start-date', 'when'])) AS like_, list_sort(json_keys(found[1])) AS sample FROM a WHERE len(found) >= 3)"""


@query(f"WITH {_NODES} SELECT o_custkey, path, CAST(depth AS INTEGER) AS depth, CAST(size AS INTEGER) AS size, round(len(like_) / size, 4) AS rate, array_to_string(sample, ',') AS sample FROM s")
def nested_array_rates(spark, d):
    return D.array_rates(packed_orders(spark, d), "o_custkey", "body").withColumn("sample", F.array_join("sample", ","))


@query(f"""WITH {_NODES}, r AS (SELECT *, round(len(like_) / size, 4) AS rate FROM s), e AS (SELECT *, round(rate + least(size, 50) / 1000.0, 4) AS score FROM r WHERE rate >= 0.6)
SELECT o_custkey, path, score, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, size DESC, path) AS INTEGER) AS place,
coalesce(CASE WHEN list_contains(sample, 'Title') THEN 'Title' WHEN list_contains(sample, 'name') THEN 'name' END, '') AS title, CASE WHEN list_contains(sample, 'start-date') THEN 'start-date' ELSE 'when' END AS start, CASE WHEN list_contains(sample, 'id') THEN 'id' END AS own FROM e""")
def discovered_event_arrays(spark, d):
    found = D.event_arrays(packed_orders(spark, d), "o_custkey", "body")
    field = lambda f: F.get(F.map_values(F.map_filter("fields", lambda k, _: k == f)), 0)
    return found.select("o_custkey", "path", "score", "place", F.coalesce(field("title"), F.lit("")).alias("title"), field("start_datetime").alias("start"), field("external_source_id").alias("own"))


@query(f"""WITH {_NODES}, p AS (SELECT regexp_replace(path, '\\[[0-9]+\\]', '[]', 'g') AS path, o_custkey, sum(size) AS n, sum(len(like_)) AS l FROM s GROUP BY 1, 2), t AS (SELECT path, count(*) AS n_documents, CAST(sum(n) AS BIGINT) AS n_objects, CAST(sum(l) AS BIGINT) AS n_like FROM p GROUP BY 1)
SELECT path, n_documents, n_objects, n_like, round(n_like / n_objects, 4) AS share, CAST(row_number() OVER (ORDER BY round(n_like / n_objects, 4) DESC, n_objects DESC, path) AS INTEGER) AS rank FROM t""")
def ranked_array_paths(spark, d):
    return D.ranked_paths(packed_orders(spark, d), "o_custkey", "body")


@query("SELECT user_id, path, CAST(n AS INTEGER) AS size, 0.0 AS rate FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), (VALUES ('batch.all')) AS t(path) WHERE n >= 3")
def props_array_rates(spark, d):
    """Every event's props, a user's together in one document."""
    docs = table(spark, d, "events").groupBy("user_id").agg(F.concat(F.lit('{"batch": {"all": ['), F.array_join(F.collect_list("props"), ","), F.lit("]}}")).alias("body"))
    return D.array_rates(docs, "user_id", "body").select("user_id", "path", "size", "rate")


@query("""SELECT o_custkey, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'results.hits' WHEN 2 THEN 'a.b.c.d' ELSE 'list' END AS path, CASE WHEN o_custkey % 4 < 3 THEN CAST(count(*) AS INTEGER) ELSE 1 END AS size,
CASE WHEN o_custkey % 4 < 3 THEN 'title,date,id,venue' ELSE '' END AS present FROM orders GROUP BY o_custkey""")
def best_record_arrays(spark, d):
    best = D.record_array(F.try_parse_json("body"), {g: names for g, (_, names) in N.FIELD_GROUPS.items()})
    return packed_orders(spark, d).select("o_custkey", best.alias("b")).select("o_custkey", "b.path", "b.size", F.array_join("b.present", ",").alias("present"))
