"""Detection, paging, prose dates and decisions over documents made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import detection as N
from tidemill.plans.registry import query
from tidemill.sources import pages as P
from tidemill.sources.tables import table


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'algolia_search' WHEN 1 THEN 'ics_calendar' WHEN 2 THEN 'rss_atom_events' WHEN 3 THEN 'json_ld_event' WHEN 4 THEN 'livewhale_json' WHEN 5 THEN 'simpleview_events' WHEN 6 THEN 'the_events_calendar' WHEN 7 THEN 'next_data' WHEN 8 THEN 'generic_html_cards' END AS pattern,
CAST(CASE p_partkey % 10 WHEN 0 THEN 0.85 WHEN 1 THEN 0.9 WHEN 2 THEN 0.72 WHEN 3 THEN 0.85 WHEN 4 THEN 0.9 WHEN 5 THEN 0.8 WHEN 6 THEN 0.7 WHEN 7 THEN 0.9 WHEN 8 THEN 0.65 WHEN 9 THEN CASE WHEN p_partkey % 20 = 9 THEN 0.4 ELSE 0 END END AS DOUBLE) AS confidence,
p_partkey % 10 = 9 AS needs_review, CASE WHEN p_partkey % 20 = 19 THEN 'captcha' END AS blocked FROM part""")
def source_detection(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    bodies = [
        F.concat(F.lit('{"hits": [{"title": "'), name, F.lit('"}], "nbHits": 1}')), F.concat(F.lit("BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:"), name, F.lit("\nEND:VEVENT\nEND:VCALENDAR")), F.concat(F.lit("<rss><channel><item><title>"), name, F.lit("</title></item></channel></rss>")),
        F.concat(F.lit('<script type="application/ld+json">[{"@type": "MusicEvent", "name": "'), name, F.lit('"}, {"@type": ["Thing", "Event"]}]</script>')), F.concat(F.lit('{"events": [{"id": 1, "date_ts": 5, "title": "'), name, F.lit('"}]}')),
        F.concat(F.lit('{"docs": {"docs": [{"recid": "1", "date": "2026-01-01", "title": "'), name, F.lit('"}, {"id": 2, "startDate": "x", "title": "y"}]}}')), F.concat(F.lit('<script src="/wp-content/plugins/the-events-calendar/x.js"></script><div class="tribe-events-bar">'), name, F.lit("</div>")),
        F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"events": [{"title": "'), name, F.lit('", "startDate": "2026-01-01"}]}}}</script>')), F.concat(*([F.lit('<div class="card big"><a href="/x">'), name, F.lit("</a> May 5</div>")] * 3)),
    ]
    plain = F.when(k % 20 == 19, F.lit("<p>please solve this Captcha</p>")).otherwise(F.lit('<link rel="https://api.w.org/" href="/wp-json/"><p>plain</p>'))
    body = plain
    for i, b in enumerate(bodies):
        body = F.when(k % 10 == i, b).otherwise(body)
    docs = table(spark, d, "part").select(k, body.alias("body"))
    return N.detect(docs, "p_partkey", "body").select("p_partkey", "pattern", "confidence", "needs_review", "blocked")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'third_party_telemetry' WHEN 1 THEN 'third_party_functional' WHEN 2 THEN 'first_party_event_candidate' ELSE 'first_party_other' END AS kind,
CAST(CASE p_partkey % 4 WHEN 2 THEN 0.96 WHEN 3 THEN 0.15 ELSE 0 END AS DOUBLE) AS score, CASE WHEN p_partkey % 4 = 2 THEN 'events' END AS root FROM part""")
def response_classes(spark, d):
    k = F.col("p_partkey")
    url = F.when(k % 4 == 0, "https://stats.site.example/collect").when(k % 4 == 1, "https://cdn.other.org/events.json").when(k % 4 == 2, "https://api.site.example/v1/events").otherwise("https://site.example/facets")
    body = F.when(k % 4 == 3, '{"total": 3, "categories": {"a": 1}}').otherwise(F.concat(F.lit('{"total": 2, "tags": ["x"], "events": [{"title": "'), F.col("p_name"), F.lit('", "startDate": "d", "slug": "s", "id": 1, "location": {"name": "n"}}, {"title": "t"}]}')))
    rows = table(spark, d, "part").select(k, url.alias("url"), body.alias("body"), F.lit("https://www.site.example/list").alias("listing"))
    return N.response_score(rows, "p_partkey", "url", "body", "listing", telemetry=["measure.example"])


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'http://s.example/e?page=' || (p_size + 2) WHEN 1 THEN CASE WHEN p_size + 2 <= 20 THEN 'http://s.example/e?page=' || (p_size + 2) END WHEN 2 THEN 'http://s.example/next/' || p_size WHEN 3 THEN 'http://s.example/rest/' || p_size ELSE CASE WHEN p_size % 3 > 0 THEN 'http://s.example/e?offset=' || (10 + p_size % 3) END END AS next FROM part""")
def next_requests(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    url = F.when(k % 5 == 4, "http://s.example/e?offset=10").otherwise("http://s.example/e")
    body = F.when(k % 5 == 2, F.concat(F.lit('<p><a class="x" rel="next" href="/next/'), size.cast("string"), F.lit('">more</a></p>'))).otherwise(F.concat(F.lit('{"next_rest_url": "http://s.example/rest/'), size.cast("string"), F.lit('"}')))
    kinds = [P.next_page("query", url, size), P.next_page("pages", url, size, total_pages=F.lit(20)), P.next_page("link", url, size, body), P.next_page("body", url, size, body), P.next_page("offset", url, size, size=size % 3)]
    out = kinds[4]
    for i in range(4):
        out = F.when(k % 5 == i, kinds[i]).otherwise(out)
    return table(spark, d, "part").select(k, out.alias("next"))


@query("""WITH r AS (SELECT user_id, event_id // 1000 AS page, event_id AS idx, CAST(floor(value) AS BIGINT) AS h FROM events), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, h ORDER BY page, idx) = 1),
s AS (SELECT user_id, page, count(*) AS n FROM r GROUP BY 1, 2), w AS (SELECT user_id, page, count(*) AS n FROM f GROUP BY 1, 2), p AS (SELECT s.user_id, s.page, CASE WHEN w.n IS NULL OR s.n < 3 THEN 1 ELSE 0 END AS stop FROM s LEFT JOIN w ON s.user_id = w.user_id AND s.page = w.page),
o AS (SELECT user_id, page FROM (SELECT *, coalesce(max(stop) OVER (PARTITION BY user_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) WHERE b = 0),
k AS (SELECT f.*, row_number() OVER (PARTITION BY f.user_id ORDER BY f.page, idx) AS n, count(*) OVER (PARTITION BY f.user_id) > 20 AS truncated FROM f JOIN o ON f.user_id = o.user_id AND f.page = o.page) SELECT idx AS event_id, truncated FROM k WHERE n <= 20""")
def paged_records(spark, d):
    e = table(spark, d, "events").select("user_id", F.expr("event_id div 1000").alias("page"), "event_id", F.floor("value").alias("h"))
    return P.run_records(e, "user_id", "page", "event_id", "h", 20, 3).select("event_id", "truncated")


@query("SELECT o_orderkey, CAST(line AS INTEGER) AS line, CASE WHEN line = 0 THEN CAST(o_orderdate AS DATE) ELSE make_date(CAST(year(o_orderdate) AS BIGINT), 3, 5) END AS day FROM orders, (VALUES (0), (2)) AS t(line)")
def article_dates(spark, d):
    day = F.col("o_orderdate").cast("date")
    text = F.concat(F.lit("Opens "), F.date_format(day, "MMMM d, yyyy"), F.lit("; nothing here\nagain on Mar. 5 and Feb 30"))
    return P.dated_lines(table(spark, d, "orders").select("o_orderkey", text.alias("text"), day.alias("published")), "o_orderkey", "text", "published")


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 20 AS r, CAST(o_orderdate AS DATE) AS a, make_date(CAST(year(o_orderdate) AS BIGINT) + CASE WHEN CAST(o_orderdate AS DATE) > make_date(CAST(year(o_orderdate) AS BIGINT), 6, 15) THEN 1 ELSE 0 END, 6, 15) AS z FROM orders),
m AS (SELECT o_orderkey, a, z, i, CAST(date_trunc('month', a) + to_months(i) AS DATE) AS f FROM (SELECT *, CAST(unnest(range(0, 13)) AS INTEGER) AS i FROM o WHERE r BETWEEN 6 AND 9)),
c AS (SELECT o_orderkey, z, f, a, bool_or(day(last_day(f)) < day(a)) OVER (PARTITION BY o_orderkey ORDER BY i) AS short FROM m)
SELECT o_orderkey, CAST(unnest(generate_series(a, z, INTERVAL 7 DAY)) AS DATE) AS day FROM o WHERE r < 5 UNION ALL SELECT o_orderkey, CAST(unnest(generate_series(a, a + 90, INTERVAL 1 DAY)) AS DATE) FROM o WHERE r = 5
UNION ALL SELECT o_orderkey, CAST(f + CASE WHEN short THEN 27 ELSE CAST(day(a) AS INTEGER) - 1 END AS DATE) AS d FROM c WHERE f + CASE WHEN short THEN 27 ELSE CAST(day(a) AS INTEGER) - 1 END <= z UNION ALL SELECT o_orderkey, a FROM o WHERE r > 9""")
def prose_recurrence(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = F.when(k % 20 < 5, "Weekly until June 15").when(k % 20 == 5, F.concat(F.lit("Open daily thru "), F.date_format(F.date_add(day, 90), "MMM d"), F.lit(", all welcome"))).when(k % 20 < 10, "Held monthly through Jun. 15 in the hall").otherwise("Just once")
    return table(spark, d, "orders").select(k, F.explode(P.text_recurrence(text, day)).alias("day"))


@query("SELECT c_custkey, concat_ws(',', CASE WHEN c_mktsegment <> 'BUILDING' THEN 'not onboarded' END, CASE WHEN c_acctbal <= 0 THEN 'not active' END, CASE WHEN c_custkey % 9 = 0 THEN 'archived' END, CASE WHEN c_custkey % 7 = 0 THEN 'no city' WHEN c_nationkey % 2 = 0 THEN 'city not active' END, CASE WHEN c_custkey % 5 = 0 THEN 'no approved configuration' END, CASE WHEN c_custkey % 4 = 0 THEN 'no schedule' WHEN c_custkey % 4 = 1 THEN 'schedule disabled' END) AS reasons FROM customer")
def schedule_eligibility(spark, d):
    k = F.col("c_custkey")
    city = F.when(k % 7 != 0, F.col("c_nationkey") % 2 != 0)
    schedule = F.when(k % 4 == 1, False).when(k % 4 > 1, True)
    found = N.schedule_reasons(F.when(F.col("c_mktsegment") == "BUILDING", "active").otherwise("draft"), F.col("c_acctbal") > 0, F.when(k % 9 == 0, k), city, k % 5 != 0, schedule)
    return table(spark, d, "customer").select(k, F.array_join(found, ",").alias("reasons"))


@query("""WITH p AS (SELECT c_custkey, c_acctbal, c_nationkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 7 <> 0 END AS on_, c_custkey % 4 <> 0 AS approve FROM customer)
SELECT c_custkey, CASE WHEN on_ IS NULL THEN 'no_applicable_policy' WHEN NOT on_ THEN 'policy_disabled' WHEN c_acctbal >= 500 AND c_nationkey <= 20 AND approve AND c_custkey % 3 <> 0 THEN 'automatic_approval_allowed' ELSE 'automatic_approval_denied' END AS decision,
CASE WHEN on_ THEN concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'pattern not allowed' END, CASE WHEN c_acctbal < 500 THEN 'c_acctbal below 500' END, CASE WHEN c_nationkey > 20 THEN 'c_nationkey above 20' END, CASE WHEN NOT approve THEN 'approval disabled' END) ELSE '' END AS failed FROM p""")
def policy_decisions(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").withColumns({"policy_active": F.when(k % 10 != 0, k % 7 != 0), "approval_enabled": k % 4 != 0})
    return N.decide(rows, "c_custkey", {"c_acctbal": 500}, {"c_nationkey": 20}, {"pattern not allowed": k % 3 == 0}).select("c_custkey", "decision", F.array_join("failed", ",").alias("failed"))


@query("SELECT o_orderkey, least(3 + o_custkey % 3, 4) AS score, CAST(3 + o_custkey % 3 AS BIGINT) AS n FROM orders")
def html_card_groups(spark, d):
    k = F.col("o_orderkey")
    card = lambda link, day: F.concat(F.lit('<li class="b a">'), F.lit('<a href="/e">x</a>') if link else F.lit("x"), F.lit(" May 5, 2026" if day else ""), F.lit("</li>"))
    many = F.repeat(card(True, True), 3)
    rest = F.repeat(card(True, True), 1)
    extra = F.when(F.col("o_custkey") % 3 == 0, "").when(F.col("o_custkey") % 3 == 1, rest).otherwise(F.concat(rest, card(True, False)))
    docs = table(spark, d, "orders").select(k, F.concat(F.lit('<ul><li class="nav"><a href="/">y</a></li>'), many, extra, F.lit("</ul>")).alias("body"))
    return N.html_groups(docs, "o_orderkey", "body").select("o_orderkey", F.col("score").cast("long").alias("score"), "n")


@query("SELECT o_orderkey, CAST(i AS INTEGER) AS idx, 'Order ' || o_orderpriority AS title, 'http://s.example/e/' || o_orderkey AS canonical_url, CASE WHEN i = 1 THEN NULL ELSE 'Hall' END AS venue, strftime(o_orderdate, '%Y-%m-%d') AS start_datetime FROM orders, (VALUES (0), (1)) AS t(i)")
def html_cards(spark, d):
    from tidemill.sources.cards import cards

    k = F.col("o_orderkey")
    one = lambda hall: F.concat(F.lit('<div class="event-card x"><h3 class="event-title"><a href="/e/'), k.cast("string"), F.lit('">Order <b>'), F.col("o_orderpriority"), F.lit('</b></a></h3><time datetime="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('">some day</time>' + ("<span class=venue>Hall</span>" if hall else "") + "<br></div>"))
    docs = table(spark, d, "orders").select(k, F.concat(F.lit('<div class="event-list"><p class="event-card">no</p>'), one(True), one(False), F.lit('</div><div class="event-card">outside</div>')).alias("html"), F.lit("http://s.example/list").alias("url"))
    found = cards(docs, "o_orderkey", "html", "url", "div.event-list > div.event-card", {"title": "h3.event-title", "canonical_url": "h3 a[href]@href", "venue": "span.venue, .none", "start_datetime": "time@datetime"})
    return found.drop("node_hash")
