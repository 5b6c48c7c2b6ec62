"""Conversation repair against plain versions: all edits by recursion, and all lists of edits of tiny conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache
from itertools import product

import pytest

from tidemill.llm import conversation_repair as cr

BLANK = re.compile(r"[^\x20\x09-\x0D]")
TO = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else x
        fate = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        marks = BLANK.findall(text)
        out.append(1 if not marks else 2 if (role, text) in seen else 3 if marks[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(kinds):
    """(cost, edits) of (initial, fault) pairs, by recursion over all edits."""

    @cache
    def best(i, state):
        found = [(0, "")] if i == len(kinds) and state in ("", "a") else []
        if i < len(kinds):
            initial, fault = kinds[i]
            ways = [(2, "D", state)]
            if fault in (0, 3):
                ways += [(0 if c == "K" else 1, c, TO[state, to]) for c, to in [("K", initial), ("R", "u"), ("R", "a")] if (state, to) in TO and not (c == "R" and to == initial)]
            for cost, edit, to in ways:
                more = 5 if fault == 3 and edit != "D" else 0
                c, e = best(i + 1, to)
                found.append((c + cost + more, edit + e))
        return min(found) if found else (10**9, "")

    @cache
    def with_inserts(i, state, left):
        found = []
        for to in "ua":
            if left and (state, to) in TO:
                c, e = with_inserts(i, TO[state, to], left - 1)
                found.append((c + 5, "I" + e))
        if i == len(kinds):
            found += [(0, "")] if state in ("", "a") else []
        else:
            initial, fault = kinds[i]
            ways = [(2, "D", state)]
            if fault in (0, 3):
                ways += [(0 if c == "K" else 1, c, TO[state, to]) for c, to in [("K", initial), ("R", "u"), ("R", "a")] if (state, to) in TO and not (c == "R" and to == initial)]
            for cost, edit, to in ways:
                c, e = with_inserts(i + 1, to, 2)
                found.append((c + cost + (5 if fault == 3 and edit != "D" else 0), edit + e))
        return min(found) if found else (10**9, "")

    return with_inserts(0, "", 2)


def repaired(rows, edits):
    """The turns that edits leave."""
    state, at, out = "", iter(rows), []
    for e in edits:
        row = None if e == "I" else next(at)
        if e == "D":
            continue
        if e == "K":
            to, role = row[2][:1], row[2]
        else:
            to = "a" if state == "u" else "u"
            role = {"u": "user", "a": "assistant"}[to]
        state = TO[state, to]
        out.append((role, "" if row is None else row[3]))
    assert next(at, None) is None and state in ("", "a")
    return out


def plain(all_rows, hurt=True):
    convs = {}
    for r in all_rows:
        convs.setdefault(r[0], []).append(r)
    out = {}
    for conv, rows in convs.items():
        rows = sorted(damage(rows) if hurt else rows, key=lambda r: (r[1] is not None, r[1] or 0))
        f = faults(rows)
        initials = [r[2][:1] for r in rows]
        turns = [r[1] for r in rows if r[1] is not None]
        cost, edits = cheapest(tuple(zip(initials, f)))
        text = "\n".join(f"{a}:{b}" for a, b in repaired(rows, edits))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count(1), f.count(2), f.count(3), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, edits, hashlib.sha256(text.encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def audits(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def random_rows(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turns = rng.sample(range(-3, 30), rng.randint(1, 14)) + ([None] if rng.random() < 0.1 else [])
        for t in turns:
            rows.append((conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["Hi.", "Yes!", "no end", "So? ", "  \n", "", None, f"Text {rng.random()}.", "Ok.\x0b\x0c"])))
    return rows


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")


def test_given_conversations(given):
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    assert audits(cr.digests(given)) == plain(rows)


def test_odd_conversations(spark):
    rows = random_rows(1) + [(None, 1, "user", "Q?"), (None, 2, "assistant", "A.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS k", "2 AS `a.b`", "3 AS id", "4 AS bucket", "5 AS edits", "6 AS cost").repartition(3)
    assert audits(cr.digests(df)) == plain(rows)
    assert audits(cr.audits(df)) == plain([(c, t, r or " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], hurt=False)


@pytest.mark.parametrize("segment,block", [(3, 7), (5, 1000), (256, 10)])
def test_long_conversations_in_segments(spark, monkeypatch, segment, block):
    monkeypatch.setattr(cr, "SEGMENT", segment)
    monkeypatch.setattr(cr, "BLOCK", block)
    rng = random.Random(segment)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", f"{t % 50} B.", f"{t} C!", "cut", ""])) for c in (1, 2) for t in range(120)]
    rows += [(3, None, rng.choice(["user", "assistant"]), f"same {i}.") for i in range(1)] + [(4, 1, "user", "again.")] * 40
    df = spark.createDataFrame(rows, SCHEMA)
    assert audits(cr.digests(df)) == plain(rows)


def test_repaired_turns(spark):
    rows = random_rows(5, 60)
    got = {}
    for r in cr.repair(cr.damaged(spark.createDataFrame(rows, SCHEMA))).orderBy("conv_id", "place").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for conv, want in plain(rows).items():
        mine = got.get(conv, [])
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in mine).encode()).hexdigest() == want[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(a[:1] for a, _ in mine))


@pytest.mark.parametrize("insert,rerole", [(5, 1), (1, 1), (1, 3), (0, 1)])
def test_least_edits_of_tiny_conversations(monkeypatch, insert, rerole):
    """Every list of edits is tried; cheap inserts make them part of the answers."""
    monkeypatch.setattr(cr, "INSERT", insert or 1)
    monkeypatch.setattr(cr, "REROLE", rerole)
    monkeypatch.setattr(cr, "CLOSING", {"": ("", 0), "s": ("II", 2 * (insert or 1)), "u": ("I", insert or 1), "a": ("", 0)})
    rng = random.Random(insert * 7 + rerole)
    for _ in range(25):
        kinds = [(rng.choice("sua."), rng.choice([0, 0, 1, 3])) for _ in range(rng.randint(0, 4))]
        best = None
        for edits in product("KRD", repeat=len(kinds)):
            for gaps in product(range(3), repeat=len(kinds) + 1):
                word, state, cost, fine = "", "", 0, True
                for i in range(len(kinds) + 1):
                    for _ in range(gaps[i]):
                        state, cost, word = ("a" if state == "u" else "u"), cost + (insert or 1), word + "I"
                    if i == len(kinds):
                        break
                    initial, fault = kinds[i]
                    e = edits[i]
                    word += e
                    if e == "D":
                        cost += 2
                        continue
                    if fault == 1 or e == "K" and (state, initial) not in TO:
                        fine = False
                        break
                    to = initial if e == "K" else "a" if state == "u" else "u"
                    if e == "R" and to == initial:
                        fine = False
                        break
                    state, cost = TO[state, to], cost + (rerole if e == "R" else 0) + (5 if fault == 3 else 0)
                if fine and state in ("", "a"):
                    best = min(best, (cost, word)) if best else (cost, word)
        import pandas as pd

        turns = pd.DataFrame([(0, len(kinds) - i, k, f) for i, (k, f) in enumerate(kinds)], columns=["seg", "back", "initial", "fault"])
        found = cr.solve(turns, pd.DataFrame({"seg": [0], "n": [len(kinds)]}))
        mine = min((r.cost + cr.CLOSING[cr.STATES[r.after]][1], r.edits + cr.CLOSING[cr.STATES[r.after]][0]) for r in found.itertuples() if r.state == 0)
        assert mine == best


def test_empty_table_and_dropped_rows(spark):
    assert cr.digests(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    assert audits(cr.digests(spark.createDataFrame([(gone, 1, "user", "x")], SCHEMA))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
