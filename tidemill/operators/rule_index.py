"""Text rules as an index: only pairs of a row and a rule that share a rare gram are compared.

Every rule has literals of which one must stand in a text that it matches: a plain rule its
pattern, a regular expression one literal for each alternative.  A literal is filed under the
gram (three characters, or all of a shorter literal) that the fewest literals hold.  Rows
give their different grams; those that no rule is filed under go at once, against the grams
of the rules.  What is left meets the rules in an equi-join, and only then is a pattern tried.

Regular expressions without a literal are tried on every row, inside the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidemill.functions.text import casefold

GRAM = 3
MAX_ROWS, MAX_BYTES = 500_000, 32 << 20
MAX_FREE = 200  # rules without a literal that are tried inside a row at once


def light(df: DataFrame, most: int = MAX_ROWS, most_bytes: int = MAX_BYTES) -> DataFrame:
    """df marked for broadcast if its rows and the bytes of its texts are measured to be few."""
    texts = [c for c, t in df.dtypes if t == "string"]
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in texts), F.lit(0))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= most and total <= most_bytes else df


def literals(pattern: str) -> list[str]:
    """Literals of a regular expression of which one stands in every text that it matches; none if that can not be told.

    Groups, classes and repeated characters end a run of literal characters; of each alternative
    the longest run is taken.
    """
    out: list[str] = []
    best = run = ""
    depth, i, n = 0, 0, len(pattern)
    while i <= n:
        c = pattern[i] if i < n else "|"
        if i == n or c == "|" and depth == 0:
            best = max(best, run, key=len)
            if not best:
                return []
            out.append(best)
            best = run = ""
        elif c == "\\":
            nxt = pattern[i + 1 : i + 2]
            if not nxt or nxt == "Q":
                return []
            if not nxt.isalnum() and depth == 0:
                run += nxt
            else:
                best, run = max(best, run, key=len), ""
            if nxt in "pPxukN0c":  # escapes of several characters
                return []
            i += 1
        elif c == "[":
            i += 1
            i += pattern[i : i + 1] == "^"
            level, first = 1, True
            while i < n and level:
                d = pattern[i]
                if d == "\\":
                    i += 1
                elif d == "[":
                    level += 1
                elif d == "]" and not first:
                    level -= 1
                first = False
                i += 1
            i -= 1
            if level:
                return []
            best, run = max(best, run, key=len), ""
        elif c == "(":
            if pattern[i + 1 : i + 2] == "?":
                return []
            depth += 1
            best, run = max(best, run, key=len), ""
        elif c == ")":
            depth -= 1
            run = ""
        elif c in "*?{+":
            if depth == 0:
                best, run = max(best, run if c == "+" else run[:-1], key=len), ""
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    return []
        elif c in "^$.":
            best, run = max(best, run, key=len), ""
        elif depth == 0:
            run += c
        i += 1
    return out


@F.arrow_udf(ArrayType(StringType()))
def _literals(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for patterns in batches:
        yield pa.array([literals(p) if p is not None else [] for p in patterns.to_pylist()], pa.list_(pa.string()))


def grams(text: Column, size: int) -> Column:
    """The different substrings of a length."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _filed(rules: DataFrame) -> DataFrame:
    """Rules with the literal and the candidate grams of each alternative; ``literal`` null for those without one."""
    own = F.when(F.col("is_regex"), _literals("pattern")).otherwise(F.array("pattern"))
    each = rules.withColumn("literal", F.explode_outer(F.when(F.size(own) > 0, own)))
    folded = F.when(F.col("case_sensitive"), F.col("literal")).otherwise(casefold(F.col("literal")))
    return each.withColumn("literal", folded).withColumn("gram", F.when(F.char_length("literal") >= GRAM, grams(F.col("literal"), GRAM)).otherwise(F.array("literal")))


def _row_grams(rows: DataFrame, sizes: list[int], *more: str) -> DataFrame:
    every = F.concat(*(grams(F.col("seen"), n) for n in sizes))
    return rows.select("field", *more, F.explode(every).alias("gram"))


def _hit(pairs: DataFrame) -> Column:
    plain = F.contains(F.col("seen"), F.col("literal"))
    if "check" in pairs.columns:
        plain = plain & (F.col("check").isNull() | F.regexp_like("text", F.col("check")))
    return plain & (~F.col("is_regex") | F.regexp_like("text", F.when(F.col("case_sensitive"), F.col("pattern")).otherwise(F.concat(F.lit("(?i)"), F.col("pattern")))))


def text_matches(rows: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, best) of every rule that matches a text of a row; a pair may stand more than once.

    rows: key, field, text.  rules: field, pattern, is_regex, case_sensitive, best (any value), and
    perhaps check, a further expression that the text must match.
    """
    rules = _filed(rules.where(F.col("pattern").isNotNull() & (F.col("pattern") != ""))).persist()  # read several times; a lost part is made anew
    sizes = {(r[0], r[1]) for r in rules.where(F.col("literal").isNotNull()).select("case_sensitive", F.least(F.char_length("literal"), F.lit(GRAM))).distinct().collect()}
    one = ["field", "literal"]  # the gram of a literal is the same for all its rules
    found = []
    for strict in sorted({s for s, _ in sizes}):
        same = rules.where((F.col("case_sensitive") == strict) & F.col("literal").isNotNull())
        grams_of = same.select(*one, "gram").dropDuplicates(one).select(*one, F.explode("gram").alias("gram"))
        often = grams_of.groupBy("field", "gram").agg(F.count("*").alias("n"))
        rare = grams_of.join(often, ["field", "gram"]).groupBy(*one).agg(F.min(F.struct("n", "gram")).alias("g"))
        index = same.drop("gram").join(rare.select(*one, F.col("g.gram").alias("gram")), one)
        seen = rows.where(F.col("text").isNotNull()).withColumn("seen", F.col("text") if strict else casefold(F.col("text")))
        lengths = sorted(n for s, n in sizes if s == strict)
        marked = light(index)
        if marked is not index:  # texts stay where they are
            pairs = _row_grams(seen, lengths, key, "text", "seen").join(marked, ["field", "gram"])
        else:
            wanted = light(index.select("field", "gram").distinct())
            ids = _row_grams(seen, lengths, key).join(wanted, ["field", "gram"], "left_semi").join(index, ["field", "gram"])
            pairs = ids.join(seen, [key, "field"])
        found.append(pairs.where(_hit(pairs)).select(key, "best"))
    free = rules.where(F.col("literal").isNull())
    if free.limit(1).count():
        found.append(_free_matches(rows, free, key))
    if not found:
        return rows.select(key, F.lit(None).cast(rules.schema["best"].dataType).alias("best")).limit(0)
    return reduce(DataFrame.unionByName, found)


def _free_matches(rows: DataFrame, free: DataFrame, key: str) -> DataFrame:
    """Rules without a literal: in lists of MAX_FREE, each list goes along every row of its field."""
    part = F.pmod(F.xxhash64("pattern", "best"), F.lit(max(1, -(-free.count() // MAX_FREE))))
    lists = free.groupBy("field", part.alias("part")).agg(F.collect_list(F.struct("pattern", "case_sensitive", "best")).alias("list"))
    tried = F.filter("list", lambda r: F.regexp_like(F.col("text"), F.when(r["case_sensitive"], r["pattern"]).otherwise(F.concat(F.lit("(?i)"), r["pattern"]))))
    return rows.join(light(lists), "field").select(key, F.explode(tried).alias("r")).select(key, "r.best")
