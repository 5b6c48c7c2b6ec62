"""Formats and substrings inferred from the dates and times of whole tables, written in many ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import inference as I
from tidemill.plans.registry import query
from tidemill.sources.tables import table


def _written(spark, d):
    """Order dates in six forms, mixed otherwise for each priority."""
    o = table(spark, d, "orders")
    day, group = F.col("o_orderdate").cast("date"), F.substring("o_orderpriority", 1, 1).cast("int")
    r = (F.col("o_orderkey") * group) % 8
    text = F.when(r < 3, F.date_format(day, "MMMM d, yyyy"))
    for n, form in ((3, "EEE, MMM d, yyyy"), (4, "MM/dd/yyyy"), (5, "dd/MM/yyyy"), (6, "yyyy.MM.dd"), (7, "d MMMM  yyyy ")):
        text = text.when(r == n, F.date_format(day, form))
    return o.select("o_orderkey", group.alias("grp"), text.alias("text"))


_WRITTEN = """v AS (SELECT o_orderkey AS k, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS grp, CAST(o_orderdate AS DATE) AS day, (o_orderkey * CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) % 8 AS r FROM orders),
t AS (SELECT k, grp, CASE WHEN r < 3 THEN strftime(day, '%B %-d, %Y') WHEN r = 3 THEN strftime(day, '%a, %b %-d, %Y') WHEN r = 4 THEN strftime(day, '%m/%d/%Y') WHEN r = 5 THEN strftime(day, '%d/%m/%Y') WHEN r = 6 THEN strftime(day, '%Y.%m.%d') ELSE strftime(day, '%-d %B %Y') END AS text FROM v)"""


def _greedy(texts: str, formats: list[str], most: int) -> str:
    """SQL of a greedy cover of (k, grp, text) by formats in order of preference."""
    hits = " UNION ALL ".join(f"SELECT k, grp, {i} AS bit, '{f}' AS fmt FROM t WHERE try_strptime(text, '{f}') IS NOT NULL" for i, f in enumerate(formats))
    out = f"""WITH {texts}, h AS ({hits}),
a AS (SELECT grp, count(*) AS n_all FROM t GROUP BY 1), s AS (SELECT grp, bit, fmt, count(*) AS total FROM h GROUP BY ALL)"""
    done = []
    for i in range(1, most + 1):
        left = "".join(f" AND NOT EXISTS (SELECT 1 FROM h z JOIN c{j} ON z.grp = c{j}.grp AND z.bit = c{j}.bit WHERE z.k = h.k)" for j in done)
        out += f", g{i} AS (SELECT grp, bit, count(*) AS gain FROM h WHERE true{left} GROUP BY ALL), c{i} AS (SELECT grp, bit, fmt, total FROM g{i} JOIN s USING (grp, bit) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY gain DESC, total DESC, bit) = 1)"
        done.append(i)
    every = " UNION ALL ".join(f"SELECT grp, {i} AS place, fmt, total FROM c{i}" for i in done)
    return out + f" SELECT grp, CAST(place AS INTEGER) AS place, fmt AS format, CAST(total AS BIGINT) AS n, round(total / n_all, 6) AS rate FROM ({every}) JOIN a USING (grp)"


@query(_greedy(_WRITTEN, ["%B %d, %Y", "%Y.%m.%d", "%a, %B %d, %Y", "%a, %b %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%m/%d/%Y", "%Y.%d.%m", "%d/%m/%Y"], 4))
def inferred_date_formats(spark, d):
    return I.inferred_formats(_written(spark, d), "text", ["grp"])


_CLOCK = "t AS (SELECT event_id AS k, event_type AS grp, CASE WHEN event_id % 5 < 3 THEN strftime(ts, '%-I:%M %p') WHEN event_id % 5 = 3 THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%H:%M:%S') END AS text FROM events)"


@query(_greedy(_CLOCK, ["%H:%M", "%H:%M:%S", "%I:%M %p"], 3))
def inferred_time_formats(spark, d):
    r = F.col("event_id") % 5
    text = F.when(r < 3, F.date_format("ts", "h:mm a")).when(r == 3, F.date_format("ts", "HH:mm")).otherwise(F.date_format("ts", "HH:mm:ss"))
    return I.inferred_formats(table(spark, d, "events").select(F.col("event_type").alias("grp"), text.alias("text")), "text", ["grp"], time=True)


@query(f"""WITH {_WRITTEN} SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]{{4}}', 'Y', 'g'), '[0-9]+', '99', 'g'), 'Y', '9999', 'g'), '(January|February|March|April|May|June|July|August|September|October|November|December)', '<B>') AS s, count(*) AS n
FROM (SELECT CASE WHEN regexp_matches(text, '^[A-Z][a-z][a-z], ') THEN '<a>, ' || CASE WHEN text LIKE '%, May %' THEN 'May' ELSE '<b>' END || substr(text, 9) ELSE text END AS text FROM t) GROUP BY 1""")
def date_shapes(spark, d):
    return I.shapes(_written(spark, d), "text").withColumnRenamed("shape", "s")


@query(rf"""WITH {_WRITTEN}, p(i, pattern) AS (VALUES (0, '(\d{{4}}-\d{{2}}-\d{{2}})'), (1, '([A-Z][a-z]{{2,8}} \d{{1,2}},? \d{{4}})'), (2, '([A-Z][a-z]{{2,8}} [A-Z][a-z]{{2,8}} \d{{1,2}},? \d{{4}})'), (3, '([A-Z][a-z]{{2,8}}\.? \d{{1,2}},? \d{{4}})'), (4, '(\d{{1,2}}/\d{{1,2}}/\d{{2,4}})')),
c AS (SELECT grp, k, i, pattern, regexp_extract('Doors ' || text || ' + Add to calendar', pattern, 1) AS cut FROM t, p),
r AS (SELECT grp, i, pattern, round(avg(CASE WHEN cut <> '' AND (try_strptime(cut, '%B %d, %Y') IS NOT NULL OR try_strptime(cut, '%b %d, %Y') IS NOT NULL OR try_strptime(cut, '%m/%d/%Y') IS NOT NULL) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM c GROUP BY ALL)
SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY rate DESC, i) AS INTEGER) AS place, pattern, rate FROM r WHERE rate > 0""")
def date_substrings(spark, d):
    rows = _written(spark, d).withColumn("text", F.concat(F.lit("Doors "), F.trim("text"), F.lit(" + Add to calendar")))
    return I.substring_rates(rows, "text", ["%B %d, %Y", "%b %d, %Y", "%m/%d/%Y"], ["grp"])
