"""Least-cost repair of the turn structure of conversations.

A conversation is fit for training if the initials of its roles form ``(s?(ua)+)?``.  Rows may
be kept (0), given the other role (user or assistant, 1) or deleted (2), and rows without text
inserted (5); blank and duplicate rows must go, and a truncated row that stays costs 5 more.
Of the cheapest lists of edits the ASCII-least is taken (K keep, R rerole, D delete, I insert).

Rows are dealt by hash of conversation and range of turns, in order, so that a conversation of
very many turns is spread over tasks.  Inside a task, batches of segments of at most
``SEGMENT`` rows go to one DuckDB recursive query: each recursion advances one turn of all
segments, from the last one on, and keeps the least cost and edits for each state of the
grammar before the turn and each state after the segment.  Segments of a conversation are then
put together in order.  Every list of edits of a segment ends in an edit of a row, so none is
the beginning of another, and the least ones of segments make up the least of the whole.

Defined results: rows are ordered by turn (nulls first), then role and a hash of the text; null
ids form one conversation, null roles and texts are one space; other roles than s..., u... and
a... can not be kept; an empty table gives no rows.  Other columns are ignored.  A conversation
holds at most 2^31 bytes of edits, as they are one value; the digest of its text is taken
piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemill.llm.tables import few, stored

SEGMENT, BLOCK = 64, 32_768
BLANKS = " \t\n\x0b\f\r"
STATES = ("", "s", "u", "a")  # what the kept rows end with
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
LAWFUL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Edits and cost after the last row for each state that they end in.
CLOSING = {"": ("", 0), "s": ("II", 2 * INSERT), "u": ("I", INSERT), "a": ("", 0)}


def other_role(state: str) -> str:
    """The initial that may follow a state, of those that can be given or inserted."""
    return NEXT[state][-1]


def moves() -> list[tuple[int, str, int, int, int, str]]:
    """(state, initial, fault, state after, cost, edits) of inserts and one row's edit; the least for each state after."""
    best: dict[tuple, tuple[int, str]] = {}
    for q, initial, fault, inserts in product(STATES, (*"sua", "."), range(4), range(3)):
        at = q
        for _ in range(inserts):
            at = other_role(at)
        steps = [("D", at, DELETE)]
        if fault in (SOUND, TRUNCATED):
            more = CUT if fault == TRUNCATED else 0
            steps += [("K", initial, more)] if initial in NEXT[at] else []
            steps += [("R", other_role(at), REROLE + more)] if initial != other_role(at) else []
        for edit, to, cost in steps:
            key = STATES.index(q), initial, fault, STATES.index(to)
            found = cost + INSERT * inserts, "I" * inserts + edit
            best[key] = min(best.get(key, found), found)
    return [(*key, *found) for key, found in best.items()]


_REPAIR = """
WITH RECURSIVE best(seg, after, state, done, least) USING KEY (seg, after, state) AS (
  SELECT seg, s, s, 0, row(CAST(0 AS BIGINT), '') FROM segments, range(4) ends(s)
  UNION
  SELECT b.seg, b.after, m.state, b.done + 1, min(row(b.least[1] + m.cost, m.edits || b.least[2]))
  FROM best b JOIN turns t ON t.seg = b.seg AND t.back = b.done + 1 JOIN moves m ON m.initial = t.initial AND m.fault = t.fault AND m.next = b.state
  GROUP BY ALL)
SELECT b.seg, b.state, b.after, b.least[1] AS cost, b.least[2] AS edits FROM best b JOIN segments s ON s.seg = b.seg AND s.n = b.done"""


def solve(turns: pd.DataFrame, segments: pd.DataFrame) -> pd.DataFrame:
    """(seg, state, after, cost, edits): the least edits of each segment from each state to each state.

    turns: seg, back (1 for the last row of a segment), initial, fault; segments: seg and its number of rows n.
    """
    with duckdb.connect() as con:
        con.execute("SET threads = 1; SET memory_limit = '400MB'; SET preserve_insertion_order = false")
        con.register("turns", turns)
        con.register("segments", segments)
        con.register("moves", pd.DataFrame(moves(), columns=["state", "initial", "fault", "next", "cost", "edits"]))
        return con.execute(_REPAIR).df()


_ROW = "k string, bucket long, has int, turn long, role string, h1 long, h2 long"
_ORDER = ["has", "turn", "role", "h1", "h2"]


def _keyed(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with k (the id as text, null apart), order columns, role, text; nulls of role and text are one space."""
    col = lambda c: F.col(f"`{c}`")
    t = col(turn).cast("long")
    gone = F.col("`__gone`") if "__gone" in rows.columns else F.lit(False)
    return rows.select(
        col(key).alias("id"), F.coalesce(F.concat(F.lit("="), col(key).cast("string")), F.lit("")).alias("k"), F.coalesce(F.floor(t / SEGMENT), F.lit(-(1 << 62))).alias("bucket"),
        t.isNotNull().cast("int").alias("has"), F.coalesce(t, F.lit(0)).alias("turn"), F.coalesce(col(role), F.lit(" ")).alias("role"), F.coalesce(col(text), F.lit(" ")).alias("text"), gone.alias("gone"),
    ).select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of (key, turn, role, text, __gone) after damage by crc32 of ``key:turn``: of 20 remainders, 0 drops a row
    (``__gone``), 1 empties its text, 2 removes its marks ``.!?``, 3 repeats it, 4 makes its role user; nulls are one space.
    """
    word = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", word(key), word(turn)).cast("binary")) % 20
    kept = F.when(fate == 1, "").when(fate == 2, F.translate(word(text), ".!?", "")).otherwise(word(text))
    copies = F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select(F.col(f"`{key}`"), F.col(f"`{turn}`"), F.when(fate == 4, "user").otherwise(word(role)).alias(role), kept.alias(text), (fate == 0).alias("__gone"), copies.alias("__copy")).drop("__copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Order columns, initial and fault of each row, with ``late`` for rows whose role and text stand at an earlier turn."""
    at = F.struct("has", "turn")
    live = rows.where(~F.col("gone"))
    seen = live.groupBy("k", "role", "h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last").drop("last")
    flat = rows.select(
        "k", "bucket", *_ORDER, "gone", F.when(F.substring("role", 1, 1).isin(*"sua"), F.substring("role", 1, 1)).otherwise(".").alias("initial"),
        F.rtrim("text", F.lit(BLANKS)).alias("solid"),
    ).withColumn("blank", F.col("solid") == "").withColumn("cut", ~F.substring("solid", -1, 1).isin(*".!?")).drop("solid")
    out = flat.join(few(stored(seen, "repeats")), ["k", "role", "h1", "h2"], "left")
    return out.select("k", "bucket", *_ORDER, "gone", "initial", "blank", "cut", (F.col("first").isNotNull() & (at > F.col("first"))).alias("late"))


_SEGMENTS = "k string, bucket long, seq long, costs array<long>, edits array<string>, n int, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, n_turns long, low long, high long"


def _segments(rows: pd.DataFrame, at: int, segment: int) -> pa.RecordBatch:
    """One row for each segment of whole segments; the first row is row ``at`` of its run (conversation and range of turns)."""
    run = ~_same(rows, None, ["k", "bucket"])
    number = np.cumsum(run) - 1
    first = np.flatnonzero(run)
    seq = (np.arange(len(rows)) - first[number] + np.where(number == 0, at, 0)) // segment
    new = run | (seq != np.concatenate(([-1], seq[:-1])))
    rows = rows.assign(seg=np.cumsum(new) - 1)
    heads = rows[new][["k", "bucket"]].assign(seq=seq[new]).reset_index(drop=True)
    live = rows[~rows["gone"]]
    n = live.groupby("seg").size().reindex(heads.index, fill_value=0)
    back = live.groupby("seg").cumcount(ascending=False) + 1
    found = solve(live[["seg", "initial", "fault"]].assign(back=back), pd.DataFrame({"seg": heads.index, "n": n.to_numpy()}))
    slot = found["seg"].to_numpy() * 16 + found["state"].to_numpy() * 4 + found["after"].to_numpy()
    costs, edits = np.full(16 * len(heads), -1, np.int64), np.full(16 * len(heads), None, object)
    costs[slot], edits[slot] = found["cost"].to_numpy(), found["edits"].to_numpy()
    before = live["initial"].shift()
    pairs = (live["seg"] == live["seg"].shift()) & ~(before + live["initial"]).isin(LAWFUL)
    count = lambda mask: live["seg"][mask].value_counts().reindex(heads.index, fill_value=0).to_numpy()
    timed = live[live["has"] == 1]
    edge = pa.array(np.arange(0, 16 * len(heads) + 1, 16, dtype=np.int32))
    each, turns = live.groupby("seg"), timed.groupby("seg")["turn"]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(heads["k"], pa.string()), pa.array(heads["bucket"], pa.int64()), pa.array(heads["seq"], pa.int64()), pa.ListArray.from_arrays(edge, pa.array(costs)), pa.ListArray.from_arrays(edge, pa.array(edits, pa.string())),
            pa.array(n.to_numpy(), pa.int32()), *(pa.array(count(live["fault"] == f), pa.int64()) for f in (BLANK, DUPLICATE, TRUNCATED)), pa.array(count(pairs), pa.int64()),
            *(pa.array(x.reindex(heads.index), pa.string(), from_pandas=True) for x in (each["initial"].first(), each["initial"].last())),
            pa.array(count((live["has"] == 1) & live["starts"]), pa.int64()), *(pa.array(x.reindex(heads.index).astype("Int64"), pa.int64()) for x in (turns.min(), turns.max())),
        ],
        [f.strip().split()[0] for f in _SEGMENTS.split(",")],
    )


def _same(rows: pd.DataFrame, last: pd.DataFrame | None, columns: list[str]) -> np.ndarray:
    """Whether each row equals the row before it in some columns; ``last`` is the row before the first."""
    joined = rows[columns] if last is None else pd.concat([last[columns], rows[columns]], ignore_index=True)
    equal = (joined == joined.shift()).all(axis=1).to_numpy(copy=True)
    return np.concatenate(([False], equal[1:])) if last is None else equal[1:]


def _segment_batches(segment: int, block: int):
    """Segments of sorted rows, block by block; only the rows of an unfinished segment wait for the next block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, at, last = None, 0, None  # at: place in its run of the first row of rest
        for rows in (batch.slice(low, block).to_pandas() for batch in batches for low in range(0, batch.num_rows, block)):
            again = _same(rows, last, ["k", "bucket", "has", "turn"])
            repeat = again & _same(rows, last, ["role", "h1", "h2"])
            at = at if rest is not None or _same(rows, last, ["k", "bucket"])[0] else 0
            last = rows.iloc[-1:]
            fault = np.select([rows["blank"], rows["late"] | repeat, rows["cut"]], [BLANK, DUPLICATE, TRUNCATED], SOUND)
            rows = rows[["k", "bucket", "has", "turn", "gone", "initial"]].assign(fault=fault.astype(np.int32), starts=~again)
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            begin = int(np.flatnonzero(~_same(rows, None, ["k", "bucket"]))[-1])
            offset = at if begin == 0 else 0
            done = max((offset + len(rows) - begin) // segment * segment - offset, 0)  # rows of the last run in full segments
            if begin + done:
                yield _segments(rows.iloc[: begin + done].reset_index(drop=True), at, segment)
                at = offset + done
            rest = rows.iloc[begin + done :].reset_index(drop=True) if begin + done < len(rows) else None
        if rest is not None:
            yield _segments(rest, at, segment)

    return run


_TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_PLANS = f"k string, bucket long, edits string, {_TOTALS}"


def _plan(k: str, segments: list[dict]) -> list[tuple]:
    """Rows of the chosen edits of a conversation for each range of turns; its totals stand in the first one.

    segments are in order; of each, the choice for every state before it and its edits are held.
    """
    value = {i: CLOSING[s][1] for i, s in enumerate(STATES)}
    chosen = []
    for seg in reversed(segments):
        now, how = {}, {}
        for q in range(4):
            options = [(seg["costs"][q * 4 + m] + value[m], seg["edits"][q * 4 + m], m) for m in range(4) if seg["costs"][q * 4 + m] >= 0 and m in value]
            if options:
                now[q], *how[q] = min(options)
        value = now
        chosen.append(how)
    state, parts = 0, []
    for seg, how in zip(segments, reversed(chosen), strict=True):
        edits, state = how[state]
        if parts and parts[-1][0] == seg["bucket"]:
            parts[-1][1].append(edits)
        else:
            parts.append((seg["bucket"], [edits]))
    parts[-1][1].append(CLOSING[STATES[state]][0])
    ends = [s for s in segments if s["n"]]
    illegal = sum(s["illegal"] for s in segments) + sum(a["last_initial"] + b["first_initial"] not in LAWFUL for a, b in zip(ends, ends[1:], strict=False))
    low, high = [s["low"] for s in segments if s["low"] is not None], [s["high"] for s in segments if s["high"] is not None]
    gaps = max(high) - min(low) + 1 - sum(s["n_turns"] for s in segments) if low else 0
    totals = (gaps, *(sum(s[c] for s in segments) for c in ("blank", "duplicate", "truncated")), illegal, value[0])
    return [(k, bucket, "".join(edits), *(totals if i == 0 else (None,) * len(totals))) for i, (bucket, edits) in enumerate(parts)]


def _plan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.strip().split()[0] for f in _PLANS.split(",")]
    types = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 6]
    key, held, out = None, [], []

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

    for batch in batches:
        for seg in batch.to_pylist():
            if seg["k"] != key and held:
                out += _plan(key, held)
                held = []
                if len(out) >= 2000:
                    yield packed(out)
                    out = []
            key = seg["k"]
            held.append(seg)
    out += _plan(key, held) if held else []
    if out:
        yield packed(out)


class _Repairing:
    """Follows the edits of one conversation along its rows."""

    def __init__(self) -> None:
        self.state, self.edits, self.at, self.all, self.digest, self.n = "", "", 0, [], hashlib.sha256(), 0

    def plan(self, edits: str) -> Iterator[tuple]:
        """The edits of the next range of turns; those left of the one before are inserts."""
        yield from self.inserts()
        self.edits, self.at = edits, 0
        self.all.append(edits)

    def put(self, edit: str, initial: str, turn: int | None, role: str, text: str) -> tuple:
        self.digest.update((("\n" if self.n else "") + role + ":" + text).encode())
        self.state, self.n = initial, self.n + 1
        return self.n, turn, role, text, edit

    def inserts(self) -> Iterator[tuple]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            initial = other_role(self.state)
            yield self.put("I", initial, None, NAMES[initial], "")

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            yield self.put(edit, role[:1], turn, role, text)
        elif edit == "R":
            initial = other_role(self.state)
            yield self.put(edit, initial, turn, NAMES[initial], text)


def _repaired_batches(id_type: pa.DataType, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, about, out = None, None, None, []
        types = [id_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] if whole else [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        names = ["id", "place", "turn", "role", "text", "edit"] if whole else ["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

        def done() -> list[tuple]:
            rows = [(ident, *x) for x in now.inserts()]
            return rows if whole else [(ident, *about, "".join(now.all), now.digest.hexdigest())]

        ident = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["k"] != key:
                    out += done() if now else []
                    key, now = r["k"], _Repairing()
                if r["edits"] is not None:
                    made = list(now.plan(r["edits"]))
                    about = tuple(r[c] for c in names[1:7]) if not whole and r["cost"] is not None else about
                    out += [(ident, *x) for x in made] if whole else []
                    continue
                ident = r["id"]
                if not r["gone"]:
                    made = list(now.row(r["turn"] if r["has"] else None, r["role"], r["text"]))
                    out += [(ident, *x) for x in made] if whole else []
                if len(out) >= 1000:
                    yield packed(out)
                    out = []
        out += done() if now else []
        if out:
            yield packed(out)

    return run


def _run(rows: DataFrame, key: str, turn: str, role: str, text: str, whole: bool) -> DataFrame:
    keyed = _keyed(rows, key, turn, role, text)
    ordered = _faults(keyed).repartition("k", "bucket").sortWithinPartitions("k", "bucket", *_ORDER)
    segments = ordered.mapInArrow(_segment_batches(SEGMENT, BLOCK), _SEGMENTS)
    plans = segments.repartition("k").sortWithinPartitions("k", "bucket", "seq").mapInArrow(_plan_batches, _PLANS)
    both = keyed.withColumn("kind", F.lit(1)).unionByName(plans.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    sorted_ = both.repartition("k").sortWithinPartitions("k", "bucket", "kind", *_ORDER)
    id_field = StructField("id", rows.schema[key].dataType)
    schema = "place long, turn long, role string, text string, edit string" if whole else f"{_TOTALS}, audit string, repaired_sha256 string"
    from pyspark.sql.pandas.types import to_arrow_type

    out = sorted_.select("k", "id", "has", "turn", "role", "text", "gone", "edits", *(f.split()[0] for f in _TOTALS.split(", ")))
    return out.mapInArrow(_repaired_batches(to_arrow_type(id_field.dataType), whole), StructType([id_field, *StructType.fromDDL(schema).fields])).withColumnRenamed("id", key)


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations, a row for each kept, changed or inserted turn: key, place, turn, role, text, edit."""
    return _run(rows, key, turn, role, text, True)


def audits(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faults, gaps, illegal neighbours, cost, edits and digest of the repaired text of each conversation."""
    return _run(rows, key, turn, role, text, False)


def digests(conversations: DataFrame) -> DataFrame:
    """Audits of the conversations after damage."""
    return audits(damaged(conversations))
