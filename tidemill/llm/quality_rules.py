"""Quality rules over a bitmask ledger.

Each rule is evaluated once per text.  The ledger row of a text holds its
measurements and one failure bit for each rule; a policy is a versioned mask, so a
policy change or an ablation is bit arithmetic on the ledger and reads no text.

Defined results: null and empty texts have all measurements 0 and fail ``few_words``;
repeated rows are measured row by row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.textbatch import Words, mix, row_sums, slices, texts_of, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits")

_SYMBOL, _UPPER, _LETTER, _DIGIT, _HEAD = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_HEAD[:] = True
_HEAD[0x80:0xC0] = False  # continuation bytes of UTF-8

#: Rules in bit order; each is true where a text fails.  Integers only, so the bits are exact.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "upper_case": "100 * n_upper > 60 * greatest(n_letters, 1)",
    "digits": "100 * n_digits > 50 * greatest(word_chars, 1)",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versioned policies: a text is kept if it fails none of the policy's rules.
POLICIES = {"base": BASE, "v1": sum(BIT.values())}


def _repeats(words: Words, k: int = 3) -> np.ndarray:
    """For each word, whether it stands in a k-word window that its row has twice or more."""
    at, h = words.windows(k)
    covered = np.zeros(len(words.starts) + 1, np.int64)
    if len(at):
        row = np.repeat(np.arange(len(words.n)), words.n)[at]
        own = mix(h ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(own)
        own = own[order]
        same = own[1:] == own[:-1]
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order][twice]
        covered[hit] += 1
        covered[hit + k] -= 1
    return np.cumsum(covered[:-1]) > 0


def _byte_sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return row_sums(flags, off)


def _lines(text: str) -> tuple[int, int]:
    """Lines that hold a word, and those among them that equal an earlier line."""
    seen, n, dup = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            n += 1
            dup += line in seen
            seen.add(line)
    return n, dup


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            w = words_of(part)
            data, off = w.data, w.row_start
            inside = np.zeros(len(data) + 1, np.int32)
            inside[w.starts] += 1
            inside[w.ends] -= 1
            in_word = np.cumsum(inside[:-1]) > 0
            lines = [_lines(t) for t in texts_of(part)]
            cols = [
                w.n, _byte_sums(_HEAD[data] & in_word, off), _byte_sums(_SYMBOL[data], off),
                np.array([d for _, d in lines], np.int64), row_sums(_repeats(w), w.first), np.array([n for n, _ in lines], np.int64),
                _byte_sums(_UPPER[data], off), _byte_sums(_LETTER[data], off), _byte_sums(_DIGIT[data], off),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c.astype(np.int64)) for c in cols)], ["key", *MEASURES])


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, all measurements and fail_bits of every row: each rule evaluated once."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_measure, f"key {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0)
    for name, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(fails), BIT[name]).otherwise(0))
    return rows.withColumn("fail_bits", bits).withColumnRenamed("key", key)


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """rows of a ledger with the policy's name and whether it keeps each."""
    return rows.withColumn("policy", F.lit(policy)).withColumn("kept", F.col("fail_bits").bitwiseAND(POLICIES[policy]) == 0)


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: texts it fails, and texts that only it fails (kept again without it).

    One pass over the ledger; an empty ledger gives zeros for every rule.
    """
    mask = POLICIES[policy]
    names = [n for n in RULES if BIT[n] & mask]
    hit = F.col("fail_bits").bitwiseAND(mask)
    sums = [F.coalesce(F.sum((hit.bitwiseAND(BIT[n]) != 0).cast("long")), F.lit(0)).alias(f"f_{n}") for n in names]
    sums += [F.coalesce(F.sum((hit == BIT[n]).cast("long")), F.lit(0)).alias(f"o_{n}") for n in names]
    pairs = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only")) for n in names))
    return rows.agg(*sums).select(F.explode(pairs).alias("x")).select("x.*")


def digests(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The measurements of each document with the base verdict and the policy's."""
    rows = apply_policy(ledger(docs), policy)
    return rows.select("doc_id", *MEASURES[:5], (F.col("fail_bits").bitwiseAND(BASE) != 0).alias("base_failed"), "kept", "fail_bits", "policy")
