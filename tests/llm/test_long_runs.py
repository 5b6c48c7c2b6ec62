"""Texts with thousands of names or number words in a row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemill.llm import decontamination as dc

ITEM = "How many red apples does a farmer pick from the old tree before the first frost comes?"


@pytest.mark.parametrize("word", ["Abel ", "two ", "Abel two "])
def test_long_runs_are_matched(spark, word):
    docs = spark.createDataFrame([(1, word * 20_000 + ". " + ITEM), (2, word * 20_000), (3, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert sorted((r["doc_id"], r["kind"], r["coverage"]) for r in dc.leaks(docs, items).collect()) == [(1, "exact", 1.0), (3, "exact", 1.0)]
    assert [r["doc_id"] for r in dc.keep_clean(docs, items).collect()] == [2]


def test_runs_are_one_word_of_the_template(spark):
    texts = {
        "Abel Baker " * 20_000: "_",
        "twenty-one " * 20_000: "0",
        "Abel Baker saw sixty-six or six tents, Two Hundred sixths and two-tone seventeen": "_ saw 0 or 0 tents 0 sixths and 0 tone 0",
        "The Abel The Abel one1 one Abel-Baker": "the _ the _ one0 0 _ _",
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", F.array_join(F.filter(dc.template(F.col("text")), lambda w: w != ""), " ").alias("t")).orderBy("i")
    assert [r["t"] for r in rows.collect()] == list(texts.values())
