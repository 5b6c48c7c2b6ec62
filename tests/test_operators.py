"""Boundary, null, empty and tie cases of operators, on small tables."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.functions import dates as D
from tidemill.functions import text as T
from tidemill.functions import urls as U
from tidemill.functions.geo import GeoFilter, last_outcome
from tidemill.operators import candidates as C
from tidemill.operators import recurrence as Q
from tidemill.operators import relational as R
from tidemill.operators import stateful as S
from tidemill.operators import writes as W
from tidemill.sources import files
from tidemill.sources import records as X

START = datetime(2024, 1, 1)


def one(spark, column, **values):
    """The value of a column over one row of text values."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def many(spark, make, values, kind="string"):
    return [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(make(F.col("v")).alias("x")).collect()]


def test_text_keys(spark):
    assert many(spark, T.normalized_title, ["  Straße\t X ", "ΣΑΣ", "ŉ", None, "", " a "]) == ["strasse x", "σασ", "ŉ".casefold(), "", "", "a"]
    assert many(spark, T.cleaned, [" a  b ", " \t", None]) == ["a b", None, None]
    assert many(spark, T.slug, ["Old & New!", "--", None]) == ["old-new", "", None]
    assert many(spark, T.without_formula, ["=+@x", "-1", "ok"]) == ["x", "1", "ok"]
    assert many(spark, T.html_text, ["<p>a &amp;lt; b</p><script>x</script>", "<b></b>"]) == ["a &lt; b", None]
    assert "onclick" not in one(spark, T.safe_markup(F.col("a")), a="<p onclick='x'>k<script>y</script><a href='javascript:z'>l</a></p>")
    for bad in ("(?i)a", "(a+)+", r"(a)\1", "a" * 201):
        with pytest.raises(ValueError):
            T.checked_pattern(bad)
    assert one(spark, T.extracted(F.col("a"), "([0-9]+)"), a="x") is None


def test_urls(spark):
    urls = ["HTTPS://u:p@Example.com:443/a/?b=2&a=&b=1#f", "http://x.org:8080", "garbage", "", None, "http://[::1]/x", "http://a.b/%zz?q=a%20b+c"]
    assert many(spark, U.canonical_url, urls) == ["https://example.com/a?a=&b=1&b=2", "http://x.org:8080/", "", "", "", "http://::1/x", "http://a.b/%zz?q=a+b+c"]
    assert many(spark, U.normalize_url, urls[:3]) == ["https://example.com:443/a?a=&b=1&b=2", "http://x.org:8080/", "garbage"]
    assert one(spark, U.same_resource(F.col("a"), F.col("b")), a="", b="") is False
    assert many(spark, U.registrable_domain, ["https://a.b.co.uk/x", "a.b.com.", "10.0.0.1", "localhost", ""]) == ["b.co.uk", "b.com", "10.0.0.1", "localhost", None]
    assert many(spark, U.public_url_problem, ["http://2130706433/", "http://10.1.1.1", "http://8.8.8.8", "https://a.internal", "ftp://x.y", "//x", "http://u@h.org", None]) == ["address", "address", None, "host", "scheme", "no scheme", "credentials", "missing"]
    base = F.lit("http://h.org/a/b?q=1")
    assert many(spark, lambda v: U.absolute(base, v), ["c", "/c", "?x", "#f", "//o.org/z", "../c", "https://k", ""]) == ["http://h.org/a/c", "http://h.org/c", "http://h.org/a/b?x", "http://h.org/a/b?q=1#f", "http://o.org/z", "http://h.org/c", "https://k", "http://h.org/a/b?q=1"]
    assert many(spark, lambda v: U.with_param(v, "page", F.lit(3)), ["http://a/?page=1&x=2#f", "http://a/", "http://a/?x=1"]) == ["http://a/?page=3&x=2", "http://a/?page=3", "http://a/?x=1&page=3"]
    assert many(spark, lambda v: U.is_telemetry(v, ["x.com"], ["pixel"], ["/tr", "/log"]), ["http://a.x.com/", "http://a.org/travel", "http://a.org/tr?x", "http://a.org/login"]) == [True, False, True, False]


def test_dates(spark):
    assert many(spark, lambda v: D.parse_date(v, ["%d/%m/%Y", "%B %d, %Y"]), ["31/02/2026", "March 5, 2026", "2026-9-2", "2026-09-02T10", " ", None]) == [None, date(2026, 3, 5), None, date(2026, 9, 2), None, None]
    assert many(spark, lambda v: D.parse_time(v, ["%I:%M %p"]), ["7:05 pm", "12:00 AM", "19:00:00-05:00", "25:00", "19"]) == ["19:05:00", "00:00:00", "19:00:00", None, "19:00:00"]
    want = {
        "Sep 29 - 30 / 2026": ("2026-09-29", "2026-09-30", "shared_month_year", None), "Sept. 29-30, 2026": ("2026-09-29", "2026-09-30", "shared_month_year", None), "September 29 - October 1, 2026": ("2026-09-29", "2026-10-01", "shared_year", None),
        "Sep 29, 2026 – Oct 1, 2026": ("2026-09-29", "2026-10-01", "explicit_both", None), "2026-09-29/2026-10-01": ("2026-09-29", "2026-10-01", "iso_range", None), "Mon, Sep 29 to Wed, Oct 1, 2026": ("2026-09-29", "2026-10-01", "shared_year", None),
        "September 29, 2026": ("2026-09-29", None, "single", None), "2026-09-29": ("2026-09-29", None, "iso_single", None), "Sep 29": (None, None, None, "missing_year"), "29 - Sep 30, 2026": (None, None, None, "missing_month"), "Sep 30 - 29, 2026": (None, None, None, "reversed_range"),
        "Feb 30, 2026": (None, None, None, "invalid_date"), "2026-02-30": (None, None, None, "invalid_iso_date"), "next Friday": (None, None, None, "unparseable"), "": (None, None, None, "empty"),
    }
    for text, r in zip(want, many(spark, D.parse_range, list(want)), strict=True):
        assert (str(r["start"]) if r["start"] else None, str(r["end"]) if r["end"] else None, r["form"], r["reason"]) == want[text], text
    w = many(spark, lambda v: D.weekend_of(v.cast("date")), ["2026-09-04", "2026-09-05", "2026-09-06"])
    assert [str(x["saturday"]) for x in w] == ["2026-09-05"] * 3
    assert one(spark, D.prose_dates(F.col("a"), F.lit("2026-01-01").cast("date")), a="On March 3 and Feb 30 and March 3, 2027; also march 3") == [date(2026, 3, 3), date(2027, 3, 3)]


def events(spark, seconds, key="a"):
    return spark.createDataFrame([(i, key, START + timedelta(seconds=s)) for i, s in enumerate(seconds)], "id int, k string, at timestamp")


def allowed(df):
    return [r["allowed"] for r in df.orderBy("id").collect()]


def test_folds_at_their_boundaries(spark):
    assert allowed(S.fold(events(spark, [0, 21600, 21601]), "k", "at", "id", S.cooldown, 21600)) == [True, False, True]
    assert allowed(S.fold(events(spark, [0, 1, 2, 10]), "k", "at", "id", S.sliding_limit, 2, 10)) == [True, True, False, True]
    assert allowed(S.fold(events(spark, [0, 1, 2, 9, 10]), "k", "at", "id", S.fixed_limit, 2, 10)) == [True, True, False, False, True]
    assert allowed(S.fold(events(spark, [0, 90, 181]).withColumn("who", F.col("id").cast("string")), "k", "at", "id", S.lease, 90, value="who")) == [True, False, True]
    fails = events(spark, [0, 1, 2, 11, 12]).withColumn("ok", F.lit(False))
    assert allowed(S.fold(fails, "k", "at", "id", S.breaker, 2, 10, value="ok")) == [True, True, False, True, False]
    assert allowed(S.fold(events(spark, [0, 5, 10]), "k", "at", "id", S.digest, 10)) == [True, False, True]
    waits = [r["detail"] for r in S.fold(events(spark, [0, 1, 30]), "k", "at", "id", S.throttle, 10).orderBy("id").collect()]
    assert waits == [0, 9_000_000, 0]
    assert S.fold(events(spark, []), "k", "at", "id", S.cooldown, 1).count() == 0
    two = events(spark, [0, 0, 0]).unionByName(events(spark, [0, 5]).withColumn("k", F.lit(None).cast("string")).withColumn("id", F.col("id") + 10))
    assert allowed(S.fold(two, "k", "at", "id", S.cooldown, 4)) == [True, False, False, True, True]


def test_fold_over_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    e = events(spark, [0, 3, 6, 7, 100]).withColumn("k", (F.col("id") % 2).cast("string"))
    e.where("id < 3").coalesce(1).write.parquet(source)
    e.where("id >= 3").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = S.fold_stream(stream, "k", "at", "id", S.cooldown, 5).writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["id"], r["allowed"]) for r in spark.table("folded").collect()) == [(0, True), (1, True), (2, True), (3, False), (4, True)]


def test_stream_state_ends(spark, tmp_path):
    """A replay gives the batch's answers, state goes when it can not matter any more, late rows come out apart."""
    source, n = str(tmp_path / "in"), 60
    e = spark.range(n).select(F.col("id").cast("int").alias("id"), (F.col("id") % 20).cast("string").alias("k"), F.timestamp_seconds(F.col("id") * 10 + 1_700_000_000).alias("at"))
    e = e.unionByName(e.where("id >= 40").select((F.col("id") + 100).alias("id"), "k", F.expr("at + INTERVAL 2 SECONDS").alias("at")))
    for low, high in ((0, 20), (20, 40), (40, 60)):
        e.where((F.col("id") % 100 >= low) & (F.col("id") % 100 < high)).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(900, "19", 590 + 1_700_000_000 - 3)], "id int, k string, t long").select("id", "k", F.timestamp_seconds("t").alias("at")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = S.fold_stream(stream, "k", "at", "id", S.cooldown, 5, keep=5, late=5).writeStream.format("memory").queryName("ending").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r["id"]: (r["allowed"], r["late"]) for r in spark.table("ending").collect()}
    want = {r["id"]: (r["allowed"], False) for r in S.fold(e, "k", "at", "id", S.cooldown, 5).collect()}
    assert got.pop(900) == (None, True) and got == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 21 and q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 3


def test_windows_over_a_stream(spark, tmp_path):
    from tidemill.streaming.windows import counts

    source = str(tmp_path / "in")
    events(spark, [0, 10, 70, 400]).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id int, k string, at timestamp").parquet(source)
    q = counts(stream, "at", "k", "1 minute", "1 minute").writeStream.format("memory").queryName("windowed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("windowed").collect()) == [1, 2]


def test_compare_matches_null_keys_and_lists_repeats(spark):
    schema = "id int, title string, day date, venue string"
    old = spark.createDataFrame([(1, None, None, " Hall "), (2, "a", None, "x"), (3, "a", None, "y"), (4, "b", None, None)], schema)
    new = spark.createDataFrame([(1, None, None, "hall"), (2, "a", None, "z"), (5, "c", None, "")], schema)
    got = {r["title"]: (r["status"], r["differences"], r["n_old"], r["n_new"]) for r in R.compare(old, new, ["title", "day"], F.col("id"), ["venue"], ["venue"]).collect()}
    assert got == {None: ("matched", [], 1, 1), "a": ("matched", ["venue"], 2, 1), "b": ("old_only", [], 1, 0), "c": ("new_only", [], 0, 1)}
    assert R.compare(old.limit(0), new.limit(0), ["title"], F.col("id"), ["venue"]).count() == 0


def test_profiles_of_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, f string")
    assert tuple(R.quality_profile(empty, F.col("k").isNotNull(), ["k"], ["f"]).first()) == (0, 0, 0, 0, 0.0)
    rows = spark.createDataFrame([], "valid boolean, fingerprint string, start_date date, end_date date, url_ok boolean, history array<string>, warnings array<string>, detail_used boolean")
    r = R.quality_report(rows).first()
    assert (r["n"], r["valid_rate"], r["range_rate"], r["inclusion_rate"], r["detail_used"]) == (0, 0.0, 1.0, 1.0, False)
    full = spark.createDataFrame([(True, "a", date(2026, 1, 1), date(2026, 1, 2), True, ["date_range:single", "geographic:excluded"], ["w"], False), (True, "a", None, None, False, ["geographic:missing_review"], ["date_range_ambiguous:x"], True), (False, "b", None, None, None, [], [], None)], rows.schema)
    r = R.quality_report(full).first()
    assert [r[c] for c in ("n", "n_valid", "n_rejected", "duplicate_rate", "n_warnings", "range_rate", "end_rate", "n_placed", "n_excluded", "n_unplaced", "inclusion_rate", "detail_used")] == [3, 2, 1, 0.5, 2, 0.5, 0.5, 2, 1, 1, 0.5, True]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "t", "v", False, True), (2, "t", "v", True, False), (3, "t", None, False, True)], "id int, title string, venue string, is_cancelled boolean, is_active boolean")
    new = spark.createDataFrame([(1, "n", None, True, 5), (2, "n", "w", False, 5), (4, "n", "x", False, 9), (4, "first", "x", False, 1)], "id int, title string, venue string, is_cancelled boolean, seq int")
    got = {r["id"]: tuple(r)[1:] for r in W.coalescing_upsert(old, new, ["id"], ["title"], ["venue"], F.col("seq")).collect()}
    assert got == {1: ("n", "v", True, False, "updated"), 2: ("n", "w", True, False, "updated"), 3: ("t", None, False, True, "kept"), 4: ("first", "x", False, True, "inserted")}
    assert W.coalescing_upsert(old.limit(0), new.limit(0), ["id"], ["title"], ["venue"], F.col("seq")).count() == 0
    assert [r["id"] for r in W.append_once(old.select("id"), new.select("id", "seq"), ["id"], F.col("seq")).collect()] == [4]


def test_geographic_filter(spark):
    def outcome(rule, address=None, lat=None, lon=None):
        df = spark.createDataFrame([(address, lat, lon)], "a string, lat double, lon double")
        return df.select(rule.decision(F.col("a"), F.lit(None).cast("string"), F.col("lat"), F.col("lon")).alias("d")).first()["d"]["outcome"]

    town = GeoFilter(localities=["Bath"], missing="reject")
    assert [outcome(town, a) for a in ("1 High St, BATH", "Bathurst", "", None, "x-bath.")] == ["included", "excluded", "missing_reject", "missing_reject", "included"]
    near = GeoFilter(radius=(0.0, 0.0, 112.0), missing="needs_review")
    assert [outcome(near, "x"), outcome(near, "x", 1.0, 0.0), outcome(near, None, 2.0, 0.0)] == ["missing_review", "included", "excluded"]
    both = GeoFilter(mode="all", localities=["Bath"], postal_prefixes=["ba1"], box=(0.0, 1.0, 0.0, 1.0))
    assert [outcome(both, "Bath BA1 2xx"), outcome(both, "Bath BA1", 5.0, 5.0), outcome(both, "Bath BA2")] == ["included", "excluded", "excluded"]
    assert one(spark, last_outcome(F.split("a", ",")), a="geographic:included,x,geographic:excluded") == "excluded"


def test_prose_ends_on_a_leap_day(spark):
    from tidemill.sources import pages as P

    starts = {"1995-12-01": "1996-02-29", "1996-01-05": "1996-02-29", "1996-03-01": "1997-02-28", "1995-01-15": None, "1994-12-01": None, "1995-03-01": "1996-02-29"}
    df = spark.createDataFrame([(d, "Open daily thru Feb 29, all welcome") for d in starts], "d string, t string")
    got = {r["d"]: r["x"] for r in df.select("d", P.text_recurrence(F.col("t"), F.col("d").cast("date")).alias("x")).collect()}
    for d, end in starts.items():
        first = date.fromisoformat(d)
        n = (date.fromisoformat(end) - first).days if end else 0  # without such a day within a year the start stands alone
        assert got[d] == [first + timedelta(days=i) for i in range(n + 1)], d


def test_recurrence(spark):
    def days(spec, start, end=None, reference="2026-01-01", bounds=None):
        df = spark.createDataFrame([(1, json.dumps(spec), start, end)], "k int, spec string, start string, end string")
        return [(r["start_date"], r["start_time"], r["warning"]) for r in Q.expand(df, "k", "spec", "start", "end", reference, bounds).collect()]

    assert [d for d, *_ in days({"rrule": "FREQ=MONTHLY;COUNT=4"}, "2026-01-31")] == ["2026-01-31", "2026-03-31", "2026-05-31", "2026-07-31"]
    assert days({"rrule": "FREQ=HOURLY"}, "2026-01-31") == [("2026-01-31", None, "finer_than_a_day")]
    assert days({"rrule": "nonsense"}, "2026-01-31T10:00:00") == [("2026-01-31", "10:00:00", "rule_unreadable")]
    assert len(days({"rrule": "FREQ=DAILY"}, "2020-01-01", bounds=Q.Bounds(per_parent=7))) == 7
    assert days({"rrule": "FREQ=DAILY"}, "2020-01-01", bounds=Q.Bounds(horizon_days=1))[-1][0] == "2026-01-02"
    assert days({"mode": "parent_only", "rrule": "FREQ=DAILY"}, "2026-01-31") == [("2026-01-31", None, None)] and days({}, None) == []
    moved = {"rrule": "FREQ=DAILY;COUNT=3", "exdate": ["2026-01-02T10:00:00"], "rdate": ["2026-02-01"], "occurrences": [{"start": "2026-01-03T12:00:00", "recurrence_id": "2026-01-03T10:00:00", "cancelled": True}]}
    assert [d[:2] for d in days(moved, "2026-01-01T10:00:00")] == [("2026-01-01", "10:00:00"), ("2026-01-03", "12:00:00"), ("2026-02-01", "00:00:00")]
    got = many(spark, lambda v: Q.regular_series(v.cast("date"), "MONTHLY", count=F.lit(3)), ["2026-01-31"])[0]
    assert [str(d) for d in got] == ["2026-01-31", "2026-03-31", "2026-05-31"]
    left = Q.run_budget(spark.range(10).withColumn("g", F.col("id") % 2 == 0), F.col("id"), F.col("g"), 2)
    assert sorted(r["id"] for r in left.collect()) == [0, 1, 2, 3, 5, 7, 9]


def test_broken_documents_give_no_rows(spark):
    bad = spark.createDataFrame([(1, None), (2, ""), (3, "{not json"), (4, "[]"), (5, '{"events": 3}'), (6, "<rss><item>"), (7, '"text"')], "k int, body string")
    for f in (X.posts, X.calendar, X.offset_feed, X.nested_docs, X.hits, X.script_json, X.linked_data, X.calendar_file, X.feed):
        rows = f(bad, "k", "body").collect()
        assert rows == [] or (f is X.posts and [r["k"] for r in rows] == [5]), f
    doc = spark.createDataFrame([(1, '{"a": {"0": "key", "b": [{"c": 7}]}, "x y": true, "n": null}')], "k int, body string").withColumn("v", F.try_parse_json("body"))
    got = doc.select(*(X.value(F.col("v"), p).alias(str(i)) for i, p in enumerate(["a.b[0].c", "a.b.0.c", "x y", "n", "a.b[3].c"]))).first()
    assert tuple(got) == ("7", "7", "true", None, None)


def test_normalized_candidates(spark):
    raw = spark.createDataFrame([(" A  b ", "<p>x &amp; y</p>", "2026-05-01T19:00:00-05:00", "Sep 5 - 4, 2026", "/e", "95", "x", "http://h.org/l"), (None,) * 8], "title string, description string, start_datetime string, end_datetime string, canonical_url string, latitude string, longitude string, page string")
    a, b = C.normalize(raw, "page", {"title": [("upper", {}), ("append", {"text": "!"})]}, timezone="UTC").orderBy(F.col("title").isNull()).collect()
    assert (a["title"], a["description"], str(a["start_date"]), a["start_time"], a["end_date"], a["canonical_url"], a["latitude"], a["longitude"]) == ("A B !", "x & y", "2026-05-01", "19:00:00", None, "http://h.org/e", 95.0, None)
    assert a["history"] == ["upper", "append"] and a["warnings"] == ["unparseable_end_date:Sep 5 - 4, 2026", "conflicting_timezone_info:start_time", "unparseable_longitude:x"]
    assert b["title"] is None and b["warnings"] == []
    checks = C.problems(title=F.col("title"), start_date=F.lit(None).cast("date"), latitude=F.col("latitude").cast("double"))
    assert raw.limit(1).select(R.reasons(checks).alias("r")).first()["r"] == ["start_date", "latitude", "half_coordinates"]
    assert many(spark, lambda v: C.unicode_normalized(v, "NFKC"), ["ﬁ", None]) == ["fi", None]
    assert many(spark, lambda v: C.transformed(v, [("exact_value_map", {"mapping": {"a": "b"}}), ("literal_replace", {"find": "", "replace": "x"})])[0], ["a", "c", None]) == ["b", "c", None]


def test_submissions(spark, tmp_path):
    rows = spark.createDataFrame([(0, "=http://A.org/", "x"), (1, "http://a.org", "x"), (2, "nope", "x"), (3, None, "x")], "i int, url string, colour string")
    found, unknown = files.submissions(rows, "i", 3)
    assert {r["i"]: r["status"] for r in found.collect()} == {0: "accepted", 1: "repeated", 2: "invalid", 3: "over_limit"} and unknown == ["colour"]
    with pytest.raises(ValueError):
        files.submissions(rows.drop("url"), "i")
    assert not W.write_csv(rows.limit(0), str(tmp_path / "none"), [F.col("i")]) and W.write_csv(rows, str(tmp_path / "some"), [F.col("i")])
    assert files.read_csv(spark, str(tmp_path / "some")).count() == 4


def test_paging_and_flags(spark):
    df = spark.range(25)
    got = R.page_with_total(df, [F.col("id")], 3, 10).collect()
    assert [r["id"] for r in got] == [20, 21, 22, 23, 24] and {(r["total"], r["has_next"]) for r in got} == {(25, False)}
    assert R.page_with_total(df.limit(0), [F.col("id")], 1, 10).count() == 0
    flags = spark.createDataFrame([(1, "a", "not_reviewed"), (2, "a", "not_duplicate"), (3, None, "not_reviewed"), (4, None, "not_reviewed")], "id int, fp string, s string")
    assert {r["id"]: r["s"] for r in R.duplicate_flags(flags, "fp", "s").collect()} == {1: "possible_duplicate", 2: "not_duplicate", 3: "not_reviewed", 4: "not_reviewed"}
    assert [many(spark, lambda v, n=n: R.in_list(v, ["a"], n), ["a", "b", None]) for n in (False, True)] == [[True, False, False], [False, True, True]]
    streak = R.streaks(spark.createDataFrame([(i, "k", f) for i, f in enumerate([True, True, True, False, True])], "i int, k string, f boolean"), "k", [F.col("i")], F.col("f"))
    assert [(r["streak"], r["alarm"]) for r in streak.orderBy("i").collect()] == [(1, False), (2, False), (3, True), (0, False), (1, False)]
    ties = spark.createDataFrame([(1, "k", START), (2, "k", START), (3, "k", START + timedelta(seconds=601)), (4, "k", START + timedelta(seconds=1201))], "i int, k string, at timestamp")
    assert [r["i"] for r in R.lapses(ties, "k", "at", 600, "i").collect()] == [3]


def test_css_subset(spark):
    from tidemill.sources.cards import cards, parsed

    page = '<ul id="a"><li class="x y">1<b data-k="v-1">t</b></li><li class="y">2</li></ul><li class="x">3'
    df = spark.createDataFrame([(1, page, "u"), (2, None, "u"), (3, "", "u")], "k int, html string, url string")
    found = lambda s: [r["title"] for r in cards(df, "k", "html", "url", s, {"title": "b"}).orderBy("k", "idx").collect()]
    assert [len(found(s)) for s in ("li", "li.x", "ul > li", "#a .x", "li.x.y, b", "[data-k^=v]", "[data-k='v-2']", "ul b", "ul > b")] == [3, 2, 2, 1, 2, 1, 0, 1, 0]
    assert found("li.x") == ["t", None]
    for bad in ("", "a,,b", "a:hover", "x" * 501):
        with pytest.raises(ValueError):
            parsed(bad)


def test_detection_of_poor_documents(spark):
    from tidemill.operators import detection as N

    rows = [(1, None, 200), (2, "", 200), (3, "<p>x</p>", 403), (4, "window <script>" + "x" * 3000 + "</script>", 200), (5, '<meta name="generator" content="WordPress 6">', 200)]
    got = {r["k"]: r for r in N.detect(spark.createDataFrame(rows, "k int, body string, status int"), "k", "body", "status").collect()}
    assert all(got[k]["pattern"] is None for k in got) and got[3]["blocked"] == "http_403" and got[4]["browser_required"] and (got[5]["best"], got[5]["confidence"], got[5]["needs_review"]) == ("wordpress_rest", 0.4, True)
    reasons = {r["k"]: r["reason"] for r in N.report(N.detect(spark.createDataFrame(rows, "k int, body string, status int"), "k", "body", "status"), "k").collect()}
    assert reasons == {1: "unsupported", 2: "unsupported", 3: "blocked", 4: "browser_required", 5: "low_confidence"}
    assert N.response_score(spark.createDataFrame([(1, "http://a.org/x", None, "http://a.org")], "k int, u string, b string, l string"), "k", "u", "b", "l").first()["kind"] == "first_party_other"


def test_small_decisions(spark):
    from tidemill.operators import engagement as G
    from tidemill.operators import filters as B
    from tidemill.operators import profiles as V

    rows = spark.createDataFrame([(1, None, None), (2, "Multiple Dates", None), (3, "2026-05-14", None), (4, "2026-05-15", None), (5, "2026-05-01", "2026-05-15")], "i int, day string, stop string")
    assert [r["v"] for r in rows.orderBy("i").select(B.legacy_visible(F.col("day"), F.col("stop"), "2026-05-15").alias("v")).collect()] == [True, True, False, True, True]
    prefs = spark.createDataFrame([(1, True, "daily", datetime(2026, 5, 9)), (2, True, "daily", datetime(2026, 5, 9, 0, 0, 1)), (3, True, "weekly", None), (4, False, "daily", None)], "user_id int, email boolean, frequency string, last_digest_at timestamp")
    ledger = spark.createDataFrame([(u, "email", "pending") for u in (1, 2, 3, 3, 4)], "user_id int, channel string, status string")
    assert sorted(tuple(r) for r in G.digests(ledger, prefs, "2026-05-10").collect()) == [(1, 1), (3, 2)]
    sent = spark.createDataFrame([("a", datetime(2026, 5, 9, 18)), ("b", datetime(2026, 5, 9, 17, 59, 59))], "fingerprint string, at timestamp")
    messages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "x"), (4, "c", "y")], "message_id int, fingerprint string, role string")
    users = spark.createDataFrame([(7, "x"), (8, "x")], "user_id int, role string")
    assert sorted((r["message_id"], r["user_id"]) for r in G.notifications(messages, users, sent, "at", 21600, "2026-05-10").collect()) == [(2, 7), (2, 8)]
    days = spark.createDataFrame([("2026/05/01",), ("2026/05/02",), ("03.05.2026",), ("soon",), (None,)], "v string")
    assert V.format_cover(days, F.lit(1), "v", ["%d.%m.%Y", "%Y/%m/%d", "%m-%d"]) == ["%Y/%m/%d", "%d.%m.%Y"] and V.format_cover(days.limit(0), F.lit(1), "v", ["%Y"]) == []
    assert [r["coverage"] for r in V.coverage_rows(days.limit(0), ["v"]).collect()] == [0.0]


def test_rules_and_matches(spark):
    from tidemill.operators import joins as J

    rules = spark.createDataFrame([(1, "keyword", "k", 0, None, None, "STRASSE", False, False, True), (2, "source_mapping", "s", 0, None, " Music ", None, False, False, True), (3, "website_mapping", "w", 0, 5, "", None, False, True, True), (4, "keyword", "r", 9, None, None, "^jazz", True, True, True)], "rule_id int, rule_type string, category string, priority int, website_id int, source_value string, pattern string, is_regex boolean, case_sensitive boolean, is_active boolean")
    rows = spark.createDataFrame([(1, "music", 5, None, None, None), (2, None, 5, None, None, None), (3, None, None, None, "Große Straße", ""), (4, None, None, None, "jazz", None), (5, None, None, None, "Jazz", None), (6, "", None, None, None, None)], "i int, source_category string, website_id int, venue string, title string, description string")
    got = {r["i"]: (r["category"], r["rule_id"]) for r in J.first_rule(rows, rules, "i").collect()}
    assert got == {1: ("s", 2), 2: ("w", 3), 3: ("k", 1), 4: ("r", 4), 5: ("other", None), 6: ("other", None)}
    assert {r["category"] for r in J.first_rule(rows, rules.limit(0), "i").collect()} == {"other"}
    sources = spark.createDataFrame([(1, "http://a.org/", None, True, False), (2, "https://A.org", None, False, False), (3, "http://a.org", "http://a.org/list", False, True), (4, "http://b.org/x", None, False, True)], "source_id int, base_url string, listing_url string, archived boolean, is_active boolean")
    urls = spark.createDataFrame([(1, "http://a.org:80/list/"), (2, "http://a.org/other"), (3, "https://a.org/any?x"), (4, "http://b.org/y"), (5, ""), (6, None)], "i int, url string")
    assert {r["i"]: (r["source_id"], r["match"]) for r in J.match_sources(urls, sources, "i", "url").collect()} == {1: (3, "listing_url"), 2: (1, "page_under_origin"), 3: (2, "page_under_origin")}


def test_registry(spark):
    from tidemill.sources.registry import REGISTRY, Pattern

    df = spark.createDataFrame([(1, '{"hits": [{"objectID": 5, "title": "t"}]}')], "k int, body string")
    assert [r["external_source_id"] for r in REGISTRY.extract("algolia_search", df, "k", "body").collect()] == ["5"]
    assert len(REGISTRY.choices()) == 12
    for call in (lambda: REGISTRY.get("x"), lambda: REGISTRY.add(Pattern("algolia_search", "", None)), lambda: REGISTRY.extract("algolia_search", df, "k", "body", colour=1), lambda: REGISTRY.extract("next_data", df, "k", "body")):
        with pytest.raises((KeyError, ValueError)):
            call()
