"""Alerts, reminders, digests, row filters and value profiles over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import candidates as C
from tidemill.operators import engagement as G
from tidemill.operators import filters as B
from tidemill.operators import profiles as V
from tidemill.operators import writes as W
from tidemill.plans.registry import query
from tidemill.sources import pages as P
from tidemill.sources.tables import table

_PREFS = "SELECT c_custkey AS user_id, c_custkey % 2 = 0 AS in_app, c_custkey % 3 = 0 AS email, CASE WHEN c_custkey % 6 = 0 THEN 'daily' ELSE 'immediate' END AS frequency, c_custkey % 5 <> 0 AS new_events, c_custkey % 7 <> 0 AS reminders, c_custkey % 5 <> 1 AS updates FROM customer WHERE c_custkey % 4 <> 0"
_OWN = f"p AS ({_PREFS}), u AS (SELECT c_custkey AS user_id, CASE WHEN p.user_id IS NULL THEN true ELSE in_app END AS in_app, CASE WHEN p.user_id IS NULL THEN false ELSE email END AS email, CASE WHEN p.user_id IS NULL THEN 'immediate' ELSE frequency END AS frequency, CASE WHEN p.user_id IS NULL THEN true ELSE new_events END AS new_events, CASE WHEN p.user_id IS NULL THEN true ELSE reminders END AS reminders, CASE WHEN p.user_id IS NULL THEN true ELSE updates END AS updates FROM customer LEFT JOIN p ON c_custkey = p.user_id)"
_OUT = "SELECT r.user_id, r.alert_key, 'in_app' AS channel, 'sent' AS status FROM r JOIN u ON r.user_id = u.user_id WHERE in_app AND {0} UNION ALL SELECT r.user_id, r.alert_key, 'email', CASE WHEN frequency = 'immediate' THEN 'sent' ELSE 'pending' END FROM r JOIN u ON r.user_id = u.user_id WHERE email AND {0}"


def _preferences(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return spark.sql(_PREFS)


def _saved(spark, d):
    """Orders as saved events: the customer saved the part numbered like the order."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 500).alias("event_id")).distinct()


@query(f"WITH {_OWN}, s AS (SELECT DISTINCT o_custkey AS user_id, o_orderkey % 500 AS event_id FROM orders), r AS (SELECT user_id, 'reminder:' || event_id AS alert_key FROM s WHERE event_id % 9 = 0 AND NOT (user_id % 10 = 0 AND event_id = 0)) {_OUT.format('reminders')}")
def saved_reminders(spark, d):
    k = F.col("p_partkey")
    events = table(spark, d, "part").select(k.alias("event_id"), F.lit(True).alias("is_active"), F.when(k % 9 == 0, F.lit("2026-05-02")).otherwise("2026-06-01").cast("date").alias("start_date")).where("event_id < 500")
    ledger = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("user_id"), F.lit("reminder:0").alias("alert_key"), F.explode(F.array(F.lit("in_app"), F.lit("email"))).alias("channel"))
    return G.reminders(events, _saved(spark, d), _preferences(spark, d), ledger, "2026-05-01")


@query(f"WITH {_OWN}, s AS (SELECT DISTINCT o_custkey AS user_id, o_orderkey % 500 AS event_id FROM orders), r AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'updated:' ELSE 'cancelled:' END || event_id AS alert_key FROM s WHERE event_id % 30 < 2) {_OUT.format('updates')}")
def change_alerts(spark, d):
    k = F.col("p_partkey")
    changes = table(spark, d, "part").where("p_partkey < 500 AND p_partkey % 30 < 2").select(k.alias("event_id"), F.when(k % 2 == 0, "updated").otherwise("cancelled").alias("kind"))
    none = spark.createDataFrame([], "user_id long, alert_key string, channel string")
    return G.change_alerts(changes, _saved(spark, d), _preferences(spark, d), none)


@query(f"WITH {_OWN}, r AS (SELECT DISTINCT c_custkey AS user_id, 'new_event:' || p_partkey AS alert_key FROM customer JOIN part ON (c_custkey % 2 = 0 AND c_custkey % 40 = p_partkey % 25) OR (c_custkey % 2 = 1 AND c_custkey % 40 = p_partkey % 7) WHERE p_partkey <= 200 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0) {_OUT.format('new_events')}")
def new_event_alerts(spark, d):
    k, u = F.col("p_partkey"), F.col("c_custkey")
    events = table(spark, d, "part").where(k <= 200).select(k.alias("event_id"), (k % 11 != 0).alias("is_active"), (k % 13 == 0).alias("is_cancelled"), (k % 25).alias("city"), (k % 7).alias("category"))
    follows = table(spark, d, "customer").select(u.alias("user_id"), F.when(u % 2 == 0, "city").otherwise("category").alias("kind"), (u % 40).alias("target"))
    none = spark.createDataFrame([], "user_id long, alert_key string, channel string")
    return G.new_event_alerts(events, follows, _preferences(spark, d), none, {"city": ["city"], "category": ["category"]})


@query("WITH p AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'daily' WHEN c_custkey % 3 = 1 THEN 'weekly' ELSE 'immediate' END AS frequency, CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2026-05-10 00:00:00' - to_days(CAST(c_custkey % 10 AS INTEGER)) END AS last FROM customer WHERE c_custkey % 2 = 0), l AS (SELECT o_custkey AS user_id, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT p.user_id, CAST(n AS BIGINT) AS n FROM p JOIN l ON p.user_id = l.user_id WHERE (frequency = 'daily' AND (last IS NULL OR TIMESTAMP '2026-05-10 00:00:00' - last >= INTERVAL 1 DAY)) OR (frequency = 'weekly' AND (last IS NULL OR TIMESTAMP '2026-05-10 00:00:00' - last >= INTERVAL 7 DAY))")
def pending_digests(spark, d):
    u = F.col("c_custkey")
    last = F.when(u % 5 != 0, F.lit("2026-05-10").cast("timestamp") - F.make_dt_interval(days=(u % 10).cast("int")))
    prefs = table(spark, d, "customer").select(u.alias("user_id"), (u % 2 == 0).alias("email"), F.when(u % 3 == 0, "daily").when(u % 3 == 1, "weekly").otherwise("immediate").alias("frequency"), last.alias("last_digest_at"))
    ledger = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.lit("email").alias("channel"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("sent").alias("status"))
    return G.digests(ledger, prefs, "2026-05-10")


@query("WITH m AS (SELECT p_brand AS fp, min(p_partkey) AS message_id FROM part GROUP BY p_brand), r AS (SELECT DISTINCT p_brand AS fp FROM part WHERE p_partkey % 40 = 0 AND TIMESTAMP '2026-05-10 00:00:00' - to_hours(CAST(p_partkey % 12 AS INTEGER)) >= TIMESTAMP '2026-05-09 18:00:00') SELECT message_id, fp AS fingerprint, s_suppkey AS user_id FROM m JOIN supplier ON s_nationkey = message_id % 25 WHERE fp NOT IN (SELECT fp FROM r)")
def notification_fanout(spark, d):
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    messages = part.select(k.alias("message_id"), F.col("p_brand").alias("fingerprint"), (k % 25).cast("int").alias("role"))
    recent = part.where(k % 40 == 0).select(F.col("p_brand").alias("fingerprint"), (F.lit("2026-05-10").cast("timestamp") - F.make_dt_interval(hours=(k % 12).cast("int"))).alias("at"))
    users = table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").cast("int").alias("role"))
    return G.notifications(messages, users, recent, "at", 21600, "2026-05-10").select("message_id", "fingerprint", "user_id")


_OLD = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 'Multiple Dates' ELSE '2026-05-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR(4)), 2, '0') END AS day, CASE WHEN p_partkey % 3 = 0 THEN '2026-05-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR(4)), 2, '0') END AS stop, CASE WHEN p_partkey % 4 = 0 THEN 1.5 END AS lat, CASE WHEN p_partkey % 6 = 0 THEN '  ' WHEN p_partkey % 6 = 1 THEN NULL ELSE p_name END AS venue, CASE WHEN p_partkey % 9 = 0 THEN p_type END AS address, CASE WHEN p_partkey % 10 = 0 THEN 2.5 END AS corrected, p_partkey % 5 AS attempts FROM part"


@query(f"WITH o AS ({_OLD}) SELECT p_partkey, day IS NULL OR day = 'Multiple Dates' OR day >= '2026-05-15' OR coalesce(stop >= '2026-05-15', false) AS visible, lat IS NULL AND (trim(coalesce(venue, '')) <> '' OR trim(coalesce(address, '')) <> '') AS wanted, CASE WHEN corrected IS NOT NULL THEN 'corrected' WHEN lat IS NOT NULL THEN 'has_coordinates' WHEN trim(coalesce(address, '')) = '' THEN 'no_address' WHEN attempts >= 3 THEN 'too_many_attempts' END AS skip FROM o")
def legacy_filters(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part")
    c = F.col
    return spark.sql(_OLD).select("p_partkey", B.legacy_visible(c("day"), c("stop"), "2026-05-15").alias("visible"), B.geocode_wanted(c("lat"), c("venue"), c("address")).alias("wanted"), B.geocode_skip(c("lat"), c("corrected"), c("address"), c("attempts")).alias("skip"))


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderpriority <> '5-LOW' AND contains(lower(c_name), 'customer') AND CAST(o_orderdate AS DATE) <= DATE '1997-12-31' AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01'")
def client_filter(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.col("o_orderdate").cast("date")
    return rows.where(B.card_filter(F.col("c_mktsegment"), F.col("o_orderpriority"), F.col("c_name"), day, F.lit(None).cast("date"), ["BUILDING", "MACHINERY"], [], ["5-LOW"], "Customer", "1996-01-01", "1997-12-31")).select("o_orderkey")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'drop' WHEN 1 THEN 'review' ELSE 'keep' END AS verdict, c_custkey % 3 = 0 AS open FROM customer")
def tag_verdicts(spark, d):
    k = F.col("c_custkey")
    history = F.split(F.when(k % 4 == 0, "trim,geographic:included,geographic:excluded").when(k % 4 == 1, "geographic:excluded,geographic:missing_review,x").when(k % 4 == 2, "geographic:included").otherwise("trim"), ",")
    return table(spark, d, "customer").select(k, B.kept_by_tag(history).alias("verdict"), B.unresolved(F.when(k % 3 == 1, 1), F.when(k % 3 == 2, 1)).alias("open"))


@query("SELECT s_suppkey, s_suppkey % 4 = 0 OR (s_suppkey % 4 = 1 AND s_suppkey % 3 <> 0) AS is_local, s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 AS internal FROM supplier")
def local_and_internal(spark, d):
    k = F.col("s_suppkey")
    town = F.when(k % 4 == 0, " ").when(k % 4 == 1, "Bloom").otherwise("Elsewhere")
    title = F.when(k % 5 == 0, "INFO-I 101 lecture").otherwise("A fair")
    return table(spark, d, "supplier").select(k, P.local_place(town, F.when(k % 3 == 0, "XX").otherwise("in"), ["bloom"], "IN").alias("is_local"), P.internal_event(title, F.when(k % 7 == 0, "for Staff only").otherwise("open"), F.lit("g"), ["h"], ["advising"], ["orientation"], ["staff only"]).alias("internal"))


@query("WITH u AS (SELECT event_type, user_id, count(*) FILTER (value >= 20) AS n FROM events GROUP BY 1, 2), a AS (SELECT event_type, count(*) AS units, count(*) FILTER (n >= 1) AS filled, count(*) FILTER (n = 1) AS one FROM u GROUP BY 1), v AS (SELECT event_type, count(DISTINCT floor(value)) AS k, count(*) AS c FROM events WHERE value >= 20 GROUP BY 1) SELECT a.event_type, CAST(units AS BIGINT) AS n_units, round(filled / units, 6) AS coverage, round(one / filled, 6) AS uniqueness, round(k / c, 6) AS variation FROM a JOIN v ON a.event_type = v.event_type")
def selector_profiles(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", F.when(F.col("value") >= 20, F.floor("value").cast("string")).alias("v"))
    return V.value_profile(e, ["event_type"], "v", "user_id")


@query("SELECT 'title' AS path, round(avg(CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE 1.0 END), 6) AS coverage FROM part UNION ALL SELECT 'image', round(avg(CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE 1.0 END), 6) FROM part")
def path_coverage(spark, d):
    k = F.col("p_partkey")
    return V.coverage_rows(table(spark, d, "part").select(F.when(k % 4 != 0, F.col("p_name")).otherwise("").alias("title"), F.when(k % 6 == 0, "false").when(k % 6 != 3, "x.png").alias("image")), ["title", "image"])


_FORMATS = ["%Y/%m/%d", "%d.%m.%Y", "%B %d, %Y", "%m-%d"]


@query("SELECT '%Y/%m/%d' AS format, round(count(*) FILTER (o_orderkey % 4 < 2) / count(*), 6) AS rate FROM orders WHERE o_orderkey % 4 < 4 UNION ALL SELECT '%d.%m.%Y', round(count(*) FILTER (o_orderkey % 4 = 2) / count(*), 6) FROM orders")
def date_format_rates(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    shown = F.when(k % 4 < 2, F.date_format(t, "yyyy/MM/dd")).when(k % 4 == 2, F.date_format(t, "dd.MM.yyyy")).otherwise("soon")
    return V.format_rates(table(spark, d, "orders").select(shown.alias("v")), "v", _FORMATS).select("format", "rate")


@query("WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events) SELECT user_id, event_type, max(event_id) FILTER (n = 1) AS event_id, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) FILTER (n BETWEEN 2 AND 4), '') AS alternatives FROM r WHERE n <= 4 GROUP BY 1, 2")
def field_alternatives(spark, d):
    best = V.best_with_alternatives(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.desc("value"), F.col("event_id")], "event_id")
    return best.select("user_id", "event_type", "event_id", F.array_join("alternatives", ",").alias("alternatives"))


@query("WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) SELECT CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (value > 50) AS BIGINT) AS large FROM l")
def warning_markers(spark, d):
    e = table(spark, d, "events").withColumn("w", F.array_compact(F.array(F.when(F.col("event_type") == "error", "error:seen"), F.when(F.col("value") > 50, "large value"))))
    return V.marker_counts(e, "w", [F.desc("ts"), F.desc("event_id")], {"errors": "error:", "large": "large"})


@query("WITH g AS (SELECT c_custkey % 100 AS page, c_custkey AS id, round(0.30 * (c_nationkey / 25.0::DOUBLE) + 0.25 * 1 + 0.15 * 1 + 0.15 * 0.5 + 0.15 * (1 - (c_custkey % 7) / 12.0::DOUBLE), 6) AS score, c_custkey % 7 AS depth, 'sel' || c_custkey AS selector FROM customer), m AS (SELECT *, max(score) OVER (PARTITION BY page) AS best FROM g) SELECT page, selector, score FROM m WHERE score >= best - 0.15 QUALIFY row_number() OVER (PARTITION BY page ORDER BY depth, selector) = 1")
def container_choice(spark, d):
    k = F.col("c_custkey")
    groups = table(spark, d, "customer").select((k % 100).alias("page"), F.concat(F.lit("sel"), k.cast("string")).alias("selector"), F.lit(25).alias("n"), F.col("c_nationkey").alias("n_links"), F.lit(40).alias("n_dates"), F.lit(0.5).alias("same_shape"), (k % 7).alias("depth"))
    return V.container_scores(groups, "page").select("page", "selector", "score")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'srcocc|s' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'parentrec|p|' || CAST(o_orderdate AS DATE) ELSE 'h|' || sha256('fp|' || repeat('x', 300) || '|' || CAST(o_orderdate AS DATE)) END AS identity, lower(trim(regexp_replace(o_orderpriority, '\\s+', ' ', 'g'))) AS address FROM orders")
def occurrence_identities(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date").cast("string")
    own = T.occurrence_identity(F.repeat(F.lit("x"), 300), F.when(k % 3 == 1, "p"), F.when(k % 3 == 0, F.concat(F.lit("s"), k.cast("string"))), F.when(k % 3 == 1, day), day)
    return table(spark, d, "orders").select(k, own.alias("identity"), T.address_key(F.lit(" "), F.concat(F.lit(" "), "o_orderpriority")).alias("address"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN upper(c_mktsegment) || '!' WHEN 1 THEN CAST(c_custkey AS VARCHAR) ELSE 'x' END AS value FROM customer")
def value_transforms(spark, d):
    k = F.col("c_custkey")
    upper = C.transformed(F.concat(F.lit(" <b>"), F.lower("c_mktsegment"), F.lit("</b>\t")), [("strip_html", {}), ("trim", {}), ("upper", {}), ("append", {"text": "!"})])[0]
    number = C.transformed(F.concat(F.lit("no "), k.cast("string"), F.lit(" of")), [("regex_extract_group", {"pattern": "([0-9]+)"})])[0]
    mapped = C.transformed(F.lit("y"), [("exact_value_map", {"mapping": {"y": "z"}}), ("literal_replace", {"find": "z", "replace": "x"})])[0]
    return table(spark, d, "customer").select(k, F.when(k % 3 == 0, upper).when(k % 3 == 1, number).otherwise(mapped).alias("value"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '{\"name\":\"' || c_name || '\"}' END AS before, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE '{\"name\":\"' || c_name || CASE WHEN c_custkey % 4 = 2 THEN '+' ELSE '' END || '\"}' END AS after FROM customer WHERE c_custkey % 4 <> 3")
def audit_changes(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    return W.audit_rows(c.where(k % 4 != 0).select(k, F.col("c_name").alias("name")), c.where(k % 4 != 1).select(k, F.concat("c_name", F.when(k % 4 == 2, "+").otherwise("")).alias("name")), "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR rk > 30 THEN o_orderpriority ELSE 'detail ' || o_custkey END AS venue, CASE WHEN o_orderkey % 4 = 0 THEN 'none' WHEN rk > 30 THEN 'skipped' ELSE 'used' END AS detail FROM (SELECT *, CASE WHEN o_orderkey % 4 <> 0 THEN dense_rank() OVER (ORDER BY CASE WHEN o_orderkey % 4 <> 0 THEN first END NULLS LAST) END AS rk FROM (SELECT *, min(o_orderkey) FILTER (o_orderkey % 4 <> 0) OVER (PARTITION BY o_custkey) AS first FROM orders WHERE o_orderkey < 2000))")
def detail_pages(spark, d):
    k = F.col("o_orderkey")
    records = table(spark, d, "orders").where(k < 2000).select(k, F.when(k % 4 != 0, F.col("o_custkey")).alias("link"), F.col("o_orderpriority").alias("venue"))
    details = table(spark, d, "customer").select(F.col("c_custkey").alias("link"), F.lit(True).alias("ok"), F.concat(F.lit("detail "), F.col("c_custkey").cast("string")).alias("venue"))
    return C.with_detail(records, details, "link", ["venue"], 30, k).select("o_orderkey", "venue", "detail")
