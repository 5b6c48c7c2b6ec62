"""Rule indexes, geographic rules, array discovery and inferred formats against plain versions."""

from __future__ import annotations

import json
import math
import random
import re

from pyspark.sql import functions as F

from tidemill.functions.trees import nodes
from tidemill.operators import discovery as D
from tidemill.operators import geo_rules as G
from tidemill.operators import inference as I
from tidemill.operators import rule_index as X


def test_literals_of_expressions():
    want = {"plated|rolled": ["plated", "rolled"], "^jazz": ["jazz"], "a(b|c)d+ef": ["ef"], "colou?r": ["colo"], "[abc]x": ["x"], r"\d+ km": [" km"], "(?i)x": [], r"a.b\.c": ["b.c"], "x{2,3}yz": ["yz"], "a|": [], r"a\|b": ["a|b"], "": [], r"\Qx\E": [], "[^]a]": [], r"[\]x]yy": ["yy"], "ab+": ["ab"]}
    assert {p: X.literals(p) for p in want} == want


def test_text_rules_equal_every_pair(spark):
    rng = random.Random(5)
    words = ["jazz", "Jazz", "STRASSE", "straße", "a.b", "rock", "x", "no", "Ünder", "ab", "zz", "C++"]
    rows = [(i, rng.choice(["v", "k"]), rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))])) for i in range(120)]
    patterns = ["jazz", "Jazz", "strasse", "x", "ab", "C++", "a.b", "ock n", "ü", " "]
    regexes = [r"^jazz", "roc|zz", r"a\.b", "[xz]$", r"^\w+$", "j.zz", "no?x", r"\bab\b", "C\\+\\+"]
    rules = [(n, f, p, g, s) for n, (f, (p, g), s) in enumerate((f, pg, s) for f in "vk" for pg in [(p, False) for p in patterns] + [(p, True) for p in regexes] for s in (True, False))]
    rule_df = spark.createDataFrame(rules, "best int, field string, pattern string, is_regex boolean, case_sensitive boolean")
    row_df = spark.createDataFrame(rows, "i int, field string, text string")
    got = {tuple(r) for r in X.text_matches(row_df, rule_df, "i").collect()}

    def hit(text, p, regex, strict):
        if not regex:
            return p in text if strict else p.casefold() in text.casefold()
        return re.search(p, text, re.ASCII if strict else re.ASCII | re.IGNORECASE) is not None

    want = {(i, n) for i, f, t in rows if t is not None for n, g, p, r, s in rules if f == g and hit(t, p, r, s)}
    assert {x for x in got if x[1] not in ()} == want
    assert X.text_matches(row_df, rule_df.limit(0), "i").count() == 0
    assert "NestedLoop" not in X.text_matches(row_df, rule_df, "i")._jdf.queryExecution().executedPlan().toString()


def test_index_too_large_for_a_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "k", f"text {i} of many") for i in range(50)], "i int, field string, text string")
    rules = spark.createDataFrame([(i, "k", f"text {i} ", False, i % 2 == 0) for i in range(200)], "best int, field string, pattern string, is_regex boolean, case_sensitive boolean")
    want = {tuple(r) for r in X.text_matches(rows, rules, "i").collect()}
    monkeypatch.setattr(X, "light", lambda df, *a: df)
    assert {tuple(r) for r in X.text_matches(rows, rules, "i").collect()} == want == {(i, i) for i in range(50)}


def test_places_at_poles_and_across_the_date_line(spark):
    rng = random.Random(2)
    spots = [(i, rng.choice([90.0, -90.0, 89.9, 0.0, rng.uniform(-90, 90)]), rng.choice([180.0, -180.0, 179.99, -179.99, 0.0, 200.0, rng.uniform(-180, 180)])) for i in range(150)] + [(900, None, 1.0), (901, 95.0, 1.0)]
    circles = [(i, rng.choice([90.0, -89.99, 0.0, 45.0, rng.uniform(-90, 90)]), rng.choice([180.0, -180.0, 0.0, rng.uniform(-180, 180)]), rng.choice([0.0, 0.5, 30.0, 800.0, 9000.0, 20_100.0])) for i in range(60)]
    boxes = [(100 + i, a := rng.uniform(-95, 80), b := rng.uniform(-185, 150), a + rng.choice([0.0, 0.001, 5, 170]), b + rng.choice([0.0, 0.01, 30, 360])) for i in range(40)]
    rules = [(i, "radius", "radius", None, a, b, km, None, None) for i, a, b, km in circles] + [(i, "bounding_box", "box", None, a, b, None, c, e) for i, a, b, c, e in boxes]
    got = {(r["i"], r["filter_id"]) for r in G.place_matches(spark.createDataFrame(spots, "i int, lat double, lon double"), spark.createDataFrame(rules, "filter_id int, grp string, kind string, term string, lat double, lon double, km double, lat2 double, lon2 double"), "i").collect()}

    def km(a, b, c, e):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(e - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))

    inside = [(i, a, b) for i, a, b in spots if a is not None and abs(a) <= 90]
    want = {(i, n) for i, a, b in inside for n, c, e, r in circles if km(a, b, c, e) <= r} | {(i, n) for i, a, b in inside for n, c, e, f, g in boxes if c <= a <= f and e <= b <= g}
    assert got == want


def test_words_of_places(spark):
    rules = [(1, "localities", "word", "St. Paul"), (2, "postal", "prefix", "474"), (3, "address_contains", "contains", "ain ST"), (4, "localities", "word", " "), (5, "postal", "prefix", "a b"), (6, "localities", "word", "paul")]
    rule_df = spark.createDataFrame([(*r, None, None, None, None, None) for r in rules], "filter_id int, grp string, kind string, term string, lat double, lon double, km double, lat2 double, lon2 double")
    rows = spark.createDataFrame([(1, "12 Main St, st. paul"), (2, "St. Pauls 47401"), (3, "x-474 x474"), (4, None), (5, "")], "i int, text string")
    assert {(r["i"], r["filter_id"]) for r in G.word_matches(rows, rule_df, "i").collect()} == {(1, 1), (1, 3), (1, 6), (2, 2)}


def test_pairs_of_places_and_filters(spark, monkeypatch):
    rng = random.Random(8)
    words = ["paris", "rome", "47401", "oslo", "st 4"]
    rows = [(i, rng.choice([None, "", " ".join(rng.sample(words, 2)).upper()]), rng.choice([None, 95.0, 90.0, -89.5, rng.uniform(-90, 90)]), rng.choice([None, 180.0, -180.0, 380.0, 1e7, rng.uniform(-180, 180)])) for i in range(120)]
    kinds = [("localities", "word", "Paris"), ("localities", "word", "rome"), ("postal", "prefix", "474"), ("address_contains", "contains", "T 4"), ("localities", "word", " ")]
    filters, rules = [(f, rng.choice(["all", "any", None]), "keep") for f in range(60)], []
    for f, _, _ in filters:
        for grp, kind, term in rng.sample(kinds, rng.choice([0, 0, 1, 2, 5])):
            rules.append((f, grp, kind, term, None, None, None, None, None))
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            a, b = rng.choice([95.0, 90.0, rng.uniform(-90, 90)]), rng.uniform(-180, 180)
            rules.append(rng.choice([(f, "radius", "radius", None, a, b, rng.choice([None, -1.0, 0.0, 900.0, 9000.0, 20_100.0]), None, None), (f, "bounding_box", "box", None, a, b, None, a + 40, b + 90)]))
    texts, numbers = "filter_id int, grp string, kind string, term string", "lat double, lon double, km double, lat2 double, lon2 double"
    tables = [spark.createDataFrame(rows, "i int, text string, lat double, lon double"), spark.createDataFrame(filters, "filter_id int, mode string, missing string"), spark.createDataFrame(rules, f"{texts}, {numbers}")]

    def km(a, b, c, e):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(e - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))

    def hit(row, rule):
        (_, text, lat, lon), (_, _, kind, term, a, b, r, c, e) = row, rule
        if kind in G.TEXT_KINDS:
            marks = {"word": r"(?<!\w){}(?!\w)", "prefix": r"(?<![a-z0-9\-]){}", "contains": "{}"}[kind]
            return text is not None and term.strip() != "" and re.search(marks.format(re.escape(term.lower())), text.lower()) is not None
        if lat is None or lon is None or abs(lat) > 90 or kind == "radius" and r is None:
            return False
        return km(lat, lon, a, b) <= r if kind == "radius" else a <= lat <= c and b <= lon <= e

    want = {}
    for row in rows:
        for f, mode, _ in filters:
            own = [r for r in rules if r[0] == f]
            known = row[2] is not None and row[3] is not None
            judged = {r[1] for r in own if r[2] in G.TEXT_KINDS or known}
            found = sorted({r[1] for r in own if hit(row, r)})
            if found and (mode != "all" or len(found) == len(judged)):
                want[row[0], f] = found
    got = lambda **k: {(r["i"], r["filter_id"]): r["matched"] for r in G.included_pairs(*tables, "i", **k).collect()}
    assert got() == want and len(want) > 300
    assert got(joined=",") == {k: ",".join(v) for k, v in want.items()}
    assert G.included_pairs(*tables, "i").count() == len(want)  # each pair once
    assert G.included_pairs(tables[0], tables[1], tables[2].limit(0), "i").count() == 0
    beyond = spark.createDataFrame([(1, "radius", "radius", None, 95.0, 0.0, 9500.0, None, None)], tables[2].schema)  # as from 85 N, 180 E
    assert G.place_matches(spark.createDataFrame([(1, -0.2, 180.0), (2, -2.0, 180.0)], "i int, lat double, lon double"), beyond, "i").select("i").collect() == [(1,)]
    few = spark.createDataFrame([(1, "localities", "word", "paris", *[None] * 5), (1, "radius", "radius", None, 0.0, 0.0, 9000.0, None, None)], tables[2].schema)
    assert "filter_id" not in "".join(re.findall(r"hashpartitioning\(i#.*", G.included_pairs(tables[0], tables[1], few, "i")._jdf.queryExecution().executedPlan().toString()))  # pairs stay where they are made
    monkeypatch.setattr(G, "NAMES", 2)
    assert got() == want
    monkeypatch.setattr(G, "NAMES", 8)
    monkeypatch.setattr(G, "light", lambda df, *a: df)
    assert got() == want


def test_nodes_are_bounded(spark):
    deep = json.dumps({"a": {"b": [{"c": [[[1]]]}, 2]}})
    wide = json.dumps({"list": [{"k": i} for i in range(3000)], "more": {f"x{i:04d}": i for i in range(6000)}})
    df = spark.createDataFrame([(1, deep), (2, wide), (3, "no json"), (4, None), (5, "[]"), (6, "3")], "i int, body string")
    got = {r["i"]: r["p"] for r in df.select("i", F.transform(nodes(F.try_parse_json("body")), lambda n: n["path"]).alias("p")).collect()}
    assert got[1] == ["", "a", "a.b", "a.b[0]", "a.b[1]", "a.b[0].c", "a.b[0].c[0]", "a.b[0].c[0][0]", "a.b[0].c[0][0][0]"]
    assert len(got[2]) == 5000 and "list[49]" in got[2] and "list[50]" not in got[2]
    assert not got[3] and not got[4] and got[5] == [""] and got[6] == [""]


def test_event_arrays_and_their_fields(spark):
    good = [{"Event-Name": "x", "startDate": "d", "URL": "u", "place": "p"}] * 2 + [{"title": "no date"}]
    body = json.dumps({"page": {"items": good, "few": good[:2]}, "names": [{"name": "a", "when": 1}] * 3})
    rows = D.event_arrays(spark.createDataFrame([(1, body), (2, "{"), (3, json.dumps([]))], "i int, body string"), "i", "body").orderBy("place").collect()
    assert [(r["path"], r["size"], r["rate"], r["place"]) for r in rows] == [("names", 3, 1.0, 1), ("page.items", 3, 0.6667, 2)]
    assert rows[1]["fields"] == {"title": "Event-Name", "start_datetime": "startDate", "canonical_url": "URL", "venue": "place"}


def test_formats_of_poor_values(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    found = lambda *v, **k: [(r["format"], r["n"]) for r in I.inferred_formats(df(*v), "v", **k).orderBy("place").collect()]
    assert found() == [] and found(None, "", "  ") == [] and found("no date", "12345", "May") == []
    assert found("May 5, 2026", "May 6, 2026") == [("%B %d, %Y", 2)]
    assert found("May 5, 2026", "Jun 6, 2026") == [("%b %d, %Y", 2)]
    assert found("13/05/2026", "05/13/2026", "01/02/2026", "x") == [("%m/%d/%Y", 2), ("%d/%m/%Y", 2)]
    assert found("Tue | July 4 / 2026") == [("%a | %B %d / %Y", 1)]
    assert found("7:30 PM", "19:30", "8 PM", time=True) == [("%H:%M", 1), ("%I %p", 1), ("%I:%M %p", 1)]
    assert I.proposals("99 99") == [] and I.proposals("<w> 99, 9999") == [] and "%d.%m.%y" in I.proposals("99.99.99")
