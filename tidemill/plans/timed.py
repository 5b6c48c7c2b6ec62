"""Time-driven operators over the event log, and recurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import recurrence as Q
from tidemill.operators import relational as R
from tidemill.operators import stateful as S
from tidemill.plans.registry import query
from tidemill.sources.tables import table

_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


def _fold(first: str, state: str, step: str, columns: str, ok: str, detail: str) -> str:
    """A fold as recursive SQL: state columns of the first row, and of each next row from f (before) and e (now)."""
    return f"WITH RECURSIVE {_E}, f AS (SELECT e.user_id, e.rn, e.event_id, {first} FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, e.event_id, {step} FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1) SELECT event_id, {ok} AS allowed, CAST({detail} AS BIGINT) AS detail FROM f"


def _events(spark, d):
    return table(spark, d, "events")


def _shown(df):
    return df.select("event_id", "allowed", "detail")


_YOUNG = "list_filter(f.kept, lambda x: e.t - x < 86400000000)"


@query(_fold("[e.t] AS kept, true AS ok", "kept", f"CASE WHEN len({_YOUNG}) >= 2 THEN {_YOUNG} ELSE list_append({_YOUNG}, e.t) END, len({_YOUNG}) < 2", "", "ok", "len(kept)"))
def sliding_limit(spark, d):
    return _shown(S.fold(_events(spark, d), "user_id", "ts", "event_id", S.sliding_limit, 2, 86400))


@query(_fold("e.t AS start, 1 AS n", "", "CASE WHEN e.t - f.start < 86400000000 THEN f.start ELSE e.t END, CASE WHEN e.t - f.start < 86400000000 THEN f.n + 1 ELSE 1 END", "", "n <= 2", "n"))
def fixed_limit(spark, d):
    return _shown(S.fold(_events(spark, d), "user_id", "ts", "event_id", S.fixed_limit, 2, 86400))


@query(_fold(
    "CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END AS fails, CASE WHEN e.event_type = 'error' AND 1 >= 2 THEN e.t + 172800000000 ELSE 0 END AS until, true AS ok", "",
    "CASE WHEN f.fails >= 2 AND e.t < f.until THEN f.fails WHEN e.event_type = 'error' THEN f.fails + 1 ELSE 0 END, CASE WHEN f.fails >= 2 AND e.t < f.until THEN f.until WHEN e.event_type <> 'error' THEN 0 WHEN f.fails + 1 >= 2 THEN e.t + 172800000000 ELSE f.until END, NOT (f.fails >= 2 AND e.t < f.until)", "", "ok", "fails",
))
def breaker(spark, d):
    e = _events(spark, d).withColumn("fine", F.col("event_type") != "error")
    return _shown(S.fold(e, "user_id", "ts", "event_id", S.breaker, 2, 172800, value="fine"))


@query(_fold("e.t AS at, CAST(0 AS BIGINT) AS wait", "", "greatest(e.t, f.at + 28800000000), greatest(e.t, f.at + 28800000000) - e.t", "", "true", "wait"))
def throttle(spark, d):
    return _shown(S.fold(_events(spark, d), "user_id", "ts", "event_id", S.throttle, 28800))


@query(_fold("e.t AS last, 1 AS n, true AS ok, 0 AS pending", "", "CASE WHEN e.t - f.last >= 86400000000 THEN e.t ELSE f.last END, f.pending + 1, e.t - f.last >= 86400000000, CASE WHEN e.t - f.last >= 86400000000 THEN 0 ELSE f.pending + 1 END", "", "ok", "n"))
def digest_daily(spark, d):
    return _shown(S.fold(_events(spark, d), "user_id", "ts", "event_id", S.digest, 86400))


@query(_fold("1 AS day_n, 1 AS month_n, CAST(e.ts AS DATE) AS day, true AS ok", "", "CASE WHEN CAST(e.ts AS DATE) = f.day THEN f.day_n ELSE 0 END + CASE WHEN CASE WHEN CAST(e.ts AS DATE) = f.day THEN f.day_n ELSE 0 END < 2 AND CASE WHEN month(CAST(e.ts AS DATE)) = month(f.day) THEN f.month_n ELSE 0 END < 40 THEN 1 ELSE 0 END, CASE WHEN month(CAST(e.ts AS DATE)) = month(f.day) THEN f.month_n ELSE 0 END + CASE WHEN CASE WHEN CAST(e.ts AS DATE) = f.day THEN f.day_n ELSE 0 END < 2 AND CASE WHEN month(CAST(e.ts AS DATE)) = month(f.day) THEN f.month_n ELSE 0 END < 40 THEN 1 ELSE 0 END, CAST(e.ts AS DATE), CASE WHEN CAST(e.ts AS DATE) = f.day THEN f.day_n ELSE 0 END < 2 AND CASE WHEN month(CAST(e.ts AS DATE)) = month(f.day) THEN f.month_n ELSE 0 END < 40", "", "ok", "day_n"))
def budget_day_month(spark, d):
    return _shown(S.fold(_events(spark, d), "user_id", "ts", "event_id", S.budget, 2, 40))


@query("WITH RECURSIVE e AS (SELECT event_id, user_id AS who, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events), f AS (SELECT rn, event_id, who, t, true AS ok, 0 AS took FROM e WHERE rn = 1 UNION ALL SELECT e.rn, e.event_id, CASE WHEN f.who = e.who OR e.t - f.t > 90000000 THEN e.who ELSE f.who END, CASE WHEN f.who = e.who OR e.t - f.t > 90000000 THEN e.t ELSE f.t END, f.who = e.who OR e.t - f.t > 90000000, CASE WHEN f.who <> e.who AND e.t - f.t > 90000000 THEN 1 ELSE 0 END FROM f JOIN e ON e.rn = f.rn + 1) SELECT event_id, ok AS allowed, CAST(took AS BIGINT) AS detail FROM f")
def leader_election(spark, d):
    # One lease is one sequence: its requests are one key by nature.
    e = _events(spark, d).withColumn("lease", F.lit(1))
    return _shown(S.fold(e, "lease", "ts", "event_id", S.lease, 90, value="user_id"))


@query("WITH s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS BIGINT) AS streak, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) >= 3 AS alarm FROM s")
def failure_streaks(spark, d):
    return R.streaks(_events(spark, d), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error").select("event_id", "streak", "alarm")


@query("SELECT event_id FROM (SELECT *, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM events) WHERE s = 0")
def pages_until_stop(spark, d):
    return R.until_stop(_events(spark, d), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "purchase").select("event_id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS heading FROM events")
def carried_heading(spark, d):
    e = _events(spark, d).withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return R.carried(e, "user_id", [F.col("ts"), F.col("event_id")], "mark", "heading").select("event_id", "heading")


@query("WITH j AS (SELECT c_custkey, c_custkey % 5 = 0 AS paused, c_custkey % 3 = 0 AS running, TIMESTAMP '2024-01-10 00:00:00' + to_minutes(c_custkey % 40 - 20) AS next_run_at, CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2024-01-10 00:00:00' - to_minutes(c_custkey % 21) END AS beat FROM customer) SELECT c_custkey FROM j WHERE NOT paused AND next_run_at <= TIMESTAMP '2024-01-10 00:00:00' AND (NOT running OR beat IS NULL OR TIMESTAMP '2024-01-10 00:00:00' - beat > INTERVAL 600 SECOND)")
def due_jobs(spark, d):
    k, now = F.col("c_custkey"), F.lit("2024-01-10 00:00:00").cast("timestamp")
    minutes = lambda n: F.make_dt_interval(mins=n.cast("int"))
    jobs = table(spark, d, "customer").select(k, (k % 5 == 0).alias("paused"), (k % 3 == 0).alias("running"), (now + minutes(k % 40 - 20)).alias("next_run_at"), F.when(k % 7 != 0, now - minutes(k % 21)).alias("lock_heartbeat_at"))
    return S.due(jobs, "2024-01-10 00:00:00").select("c_custkey")


@query("WITH s AS (SELECT c_custkey, c_custkey % 3 = 0 AS running, TIMESTAMP '2024-01-10 00:00:00' - to_minutes(c_custkey % 21) AS beat FROM customer WHERE c_custkey % 4 <> 0), k AS (SELECT c_custkey, c_acctbal > 0 AS ok FROM customer WHERE c_custkey % 6 <> 0) SELECT coalesce(s.c_custkey, k.c_custkey) AS c_custkey, NOT coalesce(ok, false) AS paused, coalesce(running, false) AND coalesce(TIMESTAMP '2024-01-10 00:00:00' - beat <= INTERVAL 600 SECOND, false) AS running FROM s FULL JOIN k ON s.c_custkey = k.c_custkey")
def reconciled_jobs(spark, d):
    k, now, c = F.col("c_custkey"), F.lit("2024-01-10 00:00:00").cast("timestamp"), table(spark, d, "customer")
    state = c.where(k % 4 != 0).select(k, F.lit(False).alias("paused"), (k % 3 == 0).alias("running"), (now - F.make_dt_interval(mins=(k % 21).cast("int"))).alias("lock_heartbeat_at"))
    return S.reconciled(state, c.where(k % 6 != 0).select(k, (F.col("c_acctbal") > 0).alias("ok")), "c_custkey", "2024-01-10 00:00:00").select("c_custkey", "paused", "running")


@query("WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderstatus = 'F' AS ok FROM orders), m AS (SELECT o_custkey, min(n) FILTER (ok) AS won, max(n) AS last FROM a WHERE n <= 4 GROUP BY o_custkey) SELECT o_custkey, CAST(coalesce(won, last) AS INTEGER) AS n_attempts, won IS NOT NULL AS succeeded, CAST(CASE coalesce(won, last) WHEN 1 THEN 0 WHEN 2 THEN 10 WHEN 3 THEN 30 ELSE 65 END AS DOUBLE) AS waited FROM m")
def retry_attempts(spark, d):
    ranked = R.first_wins(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderkey")], 4, "n")
    return S.attempts(ranked.withColumn("ok", F.col("o_orderstatus") == "F"), "o_custkey", "n", "ok", 4, 10, 35)


@query("""WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'),
w AS (SELECT o_orderkey, a, CAST(unnest(range(0, 60)) AS INTEGER) AS i FROM p)
SELECT o_orderkey, CAST(a + 14 * i AS DATE) AS day FROM w WHERE o_orderkey % 2 = 0 AND i < 10 AND CAST(a + 14 * i AS DATE) >= DATE '1996-06-01' AND CAST(a + 14 * i AS DATE) <= DATE '1996-06-01' + 400
UNION ALL SELECT o_orderkey, CAST(a + to_months(i) AS DATE) FROM w WHERE o_orderkey % 2 = 1 AND day(a + to_months(i)) = day(a) AND CAST(a + to_months(i) AS DATE) >= DATE '1996-06-01' AND CAST(a + to_months(i) AS DATE) <= DATE '1996-06-01' + 400""")
def recurrence_expand(spark, d):
    day = F.col("o_orderdate").cast("date")
    parents = table(spark, d, "orders").where(day.between("1996-01-01", "1996-12-31")).select("o_orderkey", day.alias("a"))
    weekly = Q.regular_series(F.col("a"), "WEEKLY", 2, F.lit(10), reference="1996-06-01")
    monthly = Q.regular_series(F.col("a"), "MONTHLY", 1, reference="1996-06-01")
    return parents.select("o_orderkey", F.explode(F.when(F.col("o_orderkey") % 2 == 0, weekly).otherwise(monthly)).alias("day"))


@query("""SELECT o_orderkey, CAST(CAST(a + 7 * i AS DATE) AS VARCHAR) AS start_date, CASE WHEN i = 2 THEN '20:30:00' ELSE '19:00:00' END AS start_time, i = 2 AS detached FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(unnest(range(0, 6)) AS INTEGER) AS i FROM orders) WHERE i <> 3 AND CAST(a + 7 * i AS DATE) >= a""")
def recurrence_rules(spark, d):
    o = table(spark, d, "orders")
    day = lambda n: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), n), "yyyy-MM-dd")
    spec = F.to_json(F.struct(F.lit("bounded_expand").alias("mode"), F.lit("FREQ=WEEKLY;COUNT=6").alias("rrule"), F.array(day(21)).alias("exdate"), F.array(F.struct(F.concat(day(14), F.lit("T20:30:00")).alias("start"), F.concat(day(14), F.lit("T19:00:00")).alias("recurrence_id"))).alias("occurrences")))
    parents = o.select("o_orderkey", spec.alias("spec"), F.concat(day(0), F.lit("T19:00:00")).alias("start"), F.concat(day(0), F.lit("T21:00:00")).alias("end"))
    found = Q.expand(parents, "o_orderkey", "spec", "start", "end", "1992-01-01", Q.Bounds(horizon_days=3660))
    return found.select("o_orderkey", "start_date", "start_time", "detached")


@query("WITH s AS (SELECT event_id, user_id, ts, sum(CASE WHEN ts - p < INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, g")
def event_sessions(spark, d):
    from tidemill.streaming.windows import sessions

    return sessions(_events(spark, d), "ts", "user_id", "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
