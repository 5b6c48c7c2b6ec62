"""Tables of geographic rules over all customers, against DuckDB's cross join of the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import geo_rules as G
from tidemill.plans.registry import query
from tidemill.sources.tables import table


def _places(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    text = F.when(k % 6 != 0, F.concat(F.col("n_name"), F.lit(" street 47"), F.lpad((k % 900).cast("string"), 3, "0")))
    lat = F.when(k % 5 != 0, F.lit(-90) + (k * 37 % 18000) / 100.0)
    lon = F.when(k % 5 != 0, F.lit(-180) + (k * 91 % 36000) / 100.0)
    return c.select(k, text.alias("text"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))


def _rules(spark, d):
    """A filter for each supplier: circles, boxes, nations and beginnings of postal codes."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    lat, lon = ((k * 53 % 170) - 85.0).cast("double"), ((k * 71 % 360) - 180.0).cast("double")
    rule = lambda grp, kind, term=none, a=number, b=number, km=number, c=number, e=number: F.struct(F.lit(grp).alias("grp"), F.lit(kind).alias("kind"), term.alias("term"), a.alias("lat"), b.alias("lon"), km.alias("km"), c.alias("lat2"), e.alias("lon2"))
    circle = rule("radius", "radius", a=lat, b=lon, km=((k % 9 + 1) * (k % 9 + 1) * 40).cast("double"))
    box = rule("bounding_box", "box", a=lat, b=lon, c=lat + (k % 7 + 1), e=lon + (k % 11 + 1) * 2)
    word, start = rule("localities", "word", F.col("n_name")), rule("postal", "prefix", F.concat(F.lit("47"), (k % 9).cast("string")))
    own = F.array_compact(F.array(F.when(k % 4 != 0, circle), F.when(k % 3 == 0, box), F.when(k % 5 == 0, word), F.when(k % 7 == 0, start)))
    return s.select(k.alias("filter_id"), F.explode(own).alias("r")).select("filter_id", "r.*")


def _filters(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("filter_id"), F.when(k % 2 == 0, "all").otherwise("any").alias("mode"), F.when(k % 3 == 0, "reject").when(k % 3 == 1, "needs_review").otherwise("keep").alias("missing"))


_SQL = r"""p AS (SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN n_name || ' street 47' || lpad(CAST(c_custkey % 900 AS VARCHAR), 3, '0') END AS text, CASE WHEN c_custkey % 5 <> 0 THEN -90 + (c_custkey * 37 % 18000) / CAST(100.0 AS DOUBLE) END AS lat, CASE WHEN c_custkey % 5 <> 0 THEN -180 + (c_custkey * 91 % 36000) / CAST(100.0 AS DOUBLE) END AS lon FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT s_suppkey AS k, n_name, CAST(s_suppkey * 53 % 170 - 85 AS DOUBLE) AS a, CAST(s_suppkey * 71 % 360 - 180 AS DOUBLE) AS b, CAST((s_suppkey % 9 + 1) * (s_suppkey % 9 + 1) * 40 AS DOUBLE) AS km FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT c_custkey, k, lat IS NOT NULL AS known, text IS NULL AS blank, k % 4 <> 0 AS has_r, k % 3 = 0 AS has_b, k % 5 = 0 AS has_w, k % 7 = 0 AS has_p,
has_r AND known AND 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(a - lat) / 2), 2) + cos(radians(lat)) * cos(radians(a)) * pow(sin(radians(b - lon) / 2), 2)))) <= km AS r, has_b AND known AND lat BETWEEN a AND a + k % 7 + 1 AND lon BETWEEN b AND b + (k % 11 + 1) * 2 AS x,
has_w AND regexp_matches(lower(coalesce(text, '')), '\b' || lower(n_name) || '\b') AS w, has_p AND regexp_matches(lower(coalesce(text, '')), '\b47' || k % 9) AS s FROM p, s),
z AS (SELECT *, CAST(r AS INT) + CAST(x AS INT) + CAST(w AS INT) + CAST(s AS INT) AS n, CAST(has_w AS INT) + CAST(has_p AS INT) AS n_text, CASE WHEN known THEN CAST(has_r AS INT) + CAST(has_b AS INT) ELSE 0 END AS n_place, concat_ws(',', CASE WHEN x THEN 'bounding_box' END, CASE WHEN w THEN 'localities' END, CASE WHEN s THEN 'postal' END, CASE WHEN r THEN 'radius' END) AS matched FROM m)"""


@query(f"WITH {_SQL} SELECT c_custkey, k AS filter_id, matched FROM z WHERE n > 0 AND (k % 2 = 1 OR n = n_text + n_place)")
def geo_rule_pairs(spark, d):
    return G.included_pairs(_places(spark, d), _filters(spark, d), _rules(spark, d), "c_custkey", joined=",")


@query(f"""WITH {_SQL}, q AS (SELECT *, has_r OR has_b OR has_w OR has_p AS any_rule, (blank AND NOT known) OR (n_text = 0 AND NOT known) AS lost FROM z WHERE k = c_custkey % 90 + 1)
SELECT c_custkey, CASE WHEN NOT any_rule THEN 'included' WHEN lost THEN CASE k % 3 WHEN 0 THEN 'missing_reject' WHEN 1 THEN 'missing_review' ELSE 'missing_keep' END WHEN CASE WHEN k % 2 = 0 THEN n = n_text + n_place ELSE n > 0 END THEN 'included' ELSE 'excluded' END AS outcome, CASE WHEN any_rule AND lost THEN '' ELSE matched END AS matched FROM q""")
def geo_rule_outcomes(spark, d):
    rows = _places(spark, d).withColumn("filter_id", F.col("c_custkey") % 90 + 1).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("filter_id")), "filter_id", "left_semi")
    return G.outcomes(rows, _filters(spark, d), _rules(spark, d), "c_custkey").select("c_custkey", "outcome", F.array_join("matched", ",").alias("matched"))
