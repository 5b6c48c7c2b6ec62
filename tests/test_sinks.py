"""Runs that are lost at each step and repeated leave the same table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemill.operators.sinks import BUCKET, Sink


def sink(spark, path):
    return Sink(spark, str(path), "k long, v string, n long", ["k"], 4)


def rows(spark, *r):
    return spark.createDataFrame(list(r), "k long, v string, n long")


def add(old, new):
    """Counts up: not to be done twice."""
    both = old.select("k", F.struct("v", "n").alias("o")).join(new.select("k", F.struct("v", "n").alias("w")), "k", "full")
    action = F.when(F.col("w").isNull(), "kept").when(F.col("o").isNull(), "inserted").otherwise("updated")
    return both.select("k", F.coalesce("w.v", "o.v").alias("v"), (F.coalesce("o.n", F.lit(0)) + F.coalesce("w.n", F.lit(0))).alias("n"), action.alias("action"))


def table(s):
    return {r["k"]: (r["v"], r["n"]) for r in s.read().collect()}


@pytest.mark.parametrize("lost", ["nothing", "in_staging", "after_staging", "in_writing", "after_writing"])
def test_a_lost_run_takes_effect_once(spark, tmp_path, monkeypatch, lost):
    s = sink(spark, tmp_path / "t")
    first, second = rows(spark, *((i, f"a{i}", 1) for i in range(20))), rows(spark, (3, "b", 5), (25, None, 7))
    assert s.apply("one", add, first) == {"inserted": 20, "updated": 0, "deleted": 0, "kept": 0}
    if lost == "in_staging":
        (tmp_path / "t/_staged/two").mkdir()
        (tmp_path / "t/_staged/two/part-x.parquet").write_bytes(b"half")
    elif lost != "nothing":
        staged = s.stage("two", add, second)
        if lost == "in_writing":  # only one of the buckets was replaced
            monkeypatch.setattr(s, "commit", lambda *a: None)
            one = staged.select(BUCKET).first()[0]
            s.publish(staged.where(F.col(BUCKET) == one))
            monkeypatch.undo()
        elif lost == "after_writing":
            s.publish(staged)
    counts = s.apply("two", add, second)
    assert (counts["inserted"], counts["updated"]) == (1, 1) and s.apply("two", add, second) == counts
    want = {i: (f"a{i}", 1) for i in range(20)} | {3: ("b", 6), 25: (None, 7)}
    assert table(s) == want
    assert {r["run"] for r in s.runs().collect()} == {"one", "two"}


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    s = sink(spark, tmp_path / "t")
    s.upsert("one", rows(spark, *((i, "a", i) for i in range(40))), F.lit(0))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob(f"{BUCKET}=*/*.parquet")}
    own = spark.createDataFrame([(7,)], "k long").select(s.bucket()).first()[0]
    assert s.upsert("two", rows(spark, (7, "z", 1), (7, "y", 0)), F.col("n")) == {"inserted": 0, "updated": 1, "deleted": 0, "kept": s._stored().where(F.col(BUCKET) == own).count() - 1}
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob(f"{BUCKET}=*/*.parquet")}
    assert {p for p in before if f"{BUCKET}={own}/" not in str(p)} == {p for p in after if f"{BUCKET}={own}/" not in str(p)} and table(s)[7] == ("z", 1)


def test_deletes_columns_and_absent_keys(spark, tmp_path):
    s = sink(spark, tmp_path / "t")
    assert s.read().count() == 0 and s.runs().count() == 0
    assert s.put_absent("a", rows(spark, (1, None, 1), (1, "later", 2), (None, "null key", 3)), F.col("n"))["inserted"] == 2
    assert s.put_absent("b", rows(spark, (1, "no", 9), (2, "yes", 9)), F.col("n"))["inserted"] == 1
    assert s.set_column("c", spark.createDataFrame([(2, "new"), (99, "unknown")], "k long, v string"), "v")["updated"] == 1
    assert table(s) == {1: (None, 1), 2: ("new", 9), None: ("null key", 3)}
    assert s.delete_where("d", F.col("n") == 9)["deleted"] == 1 and set(table(s)) == {1, None}
    assert s.delete("e", spark.createDataFrame([(1,)], "k long"))["deleted"] == 1 and set(table(s)) == {None}
    assert s.delete_where("f", F.lit(True))["deleted"] == 1 and table(s) == {}
