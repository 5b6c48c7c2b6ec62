"""Benchmark decontamination by template canonicalisation, in SQL functions only.

Texts become sequences of words in which numbers, names and units are typed
placeholders.  Windows of ``K`` template words are hash-joined with those of the
benchmark; the windows of a pair give its coverage, and its slots (the values behind
placeholders) are compared: a re-parameterised question replaces each value of the
item by the same value wherever it stands.

* numbers: digits, with inner points and commas taken out, and runs of number words
* names: words of a capital followed by lower case, wherever they stand, but for the fixed
  words of ``OPENERS``, which often begin sentences; neighbours are one name
* units: the fixed words of ``UNITS`` after a number

Benchmark windows with ``MIN_WORDS`` words that are no placeholders match by template,
and all windows match word for word, so that verbatim copies of numbers and names are
found too.  Coverage is the better of two: matched windows of all windows, or of those
that may match by template.  Items of fewer than K words match as a whole, word for
word, however few these are.  A stretch of ``EXCERPT`` words of an item whose windows
all stand in the document word for word is a leak at any coverage.

Benchmark windows are broadcast only if counted to be few; so are the ids of documents
whose slots are read.  Otherwise both are shuffle joins.

Defined results: null and empty texts and items match nothing; repeated rows of one
doc_id count as one document; an item matches once for each id; rows with a null doc_id
or item_id match nothing, and the former stay in ``keep_clean``; the longest run of
windows of a tie in coverage goes first; other columns pass through ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.tables import few, light, named, stored

K = 8
MIN_WORDS = 4
MIN_COVERAGE = 0.5
EXCERPT = 13

# Unit words.
UNITS = (
    "kg kilogram kilograms gram grams mg lb lbs pound pounds ounce ounces ton tons tonne tonnes km kilometer kilometers kilometre kilometres meter meters metre metres cm mm mile miles "
    "foot feet inch inches yard yards hour hours minute minutes second seconds day days week weeks month months year years dollar dollars cent cents euro euros percent "
    "liter liters litre litres ml gallon gallons degree degrees celsius fahrenheit mph kmh watt watts volt volts joule joules"
).split()

# Words that often begin a sentence and are no names.
OPENERS = (
    "A An The This That These Those There Here It Its He She They We You I His Her Their Our Your My One Some Any All Each Every Both Many Most Several Few Another Other No Not None "
    "If When While Then Thus Hence So But And Or Nor Yet For As At By In On Of To From With Without After Before During Since Until Once Because Although Though However Therefore "
    "What Which Who Whom Whose Where Why How Is Are Was Were Be Been Do Does Did Has Have Had Can Could Will Would Shall Should May Might Must Let Given Suppose Assume Consider "
    "Find Compute Calculate Solve Determine Show Prove Choose Select Write Explain Describe Name List Complete Answer Question Next Now First Second Finally Also Only Between Among Over Under Per"
).split()

# Number words.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()

_JOIN = "ˠ"  # a letter that joins the words of one name or number; taken out of texts first
_CUT = r"[^\p{L}\p{N}_§]+"
_NUMBER = "|".join(sorted(NUMBERS, key=len, reverse=True))
_NAME = rf"(?=\p{{Lu}})(?<!\p{{L}})(?!(?:{'|'.join([*OPENERS, *(n.capitalize() for n in NUMBERS)])})(?!\p{{L}}))\p{{Lu}}\p{{Ll}}\p{{L}}*"
_FIRST = "".join(sorted({n[0] for n in NUMBERS}))
_COUNT = rf"(?<![\p{{L}}\p{{N}}])(?=[{_FIRST}{_FIRST.upper()}])(?i:{_NUMBER})(?![\p{{L}}\p{{N}}])"
# Possessive repeats: Java walks a greedy repeat of a group by recursion, and some thousand names in a row overflow its stack.
_NAMES = rf"{_NAME}(?: {_NAME})*+"
_COUNTS = rf"\d+|(?<![\p{{L}}\p{{N}}])(?=[{_FIRST}{_FIRST.upper()}])(?i:{_NUMBER})(?:[ -](?i:{_NUMBER})(?![\p{{L}}\p{{N}}]))*+(?![\p{{L}}\p{{N}}])"
_UNIT = rf"(?i)(?<=0)([ -]?)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), f"_§{_JOIN}", "   "), r"(?<=\d)[.,](?=\d)", "")


def _grouped(text: Column) -> Column:
    """_plain with neighbouring names, and neighbouring number words, joined to one word."""
    return F.regexp_replace(_plain(text), rf"({_NAME}) (?={_NAME})|({_COUNT})[ -](?={_COUNT})", f"$1$2{_JOIN}")


def raw_words(text: Column) -> Column:
    """Words in lower case, one for each word of the template."""
    return F.split(F.lower(_grouped(text)), _CUT)


def _template(plain: Column) -> Column:
    named = F.regexp_replace(plain, _NAMES, "_")
    return F.split(F.lower(F.regexp_replace(F.regexp_replace(named, _COUNTS, "0"), _UNIT, "$1§")), _CUT)


def template(text: Column) -> Column:
    """Words in lower case with names, numbers and units replaced by _, 0 and §.

    Whole-text patterns instead of a function of each word: they cost one pass each.
    """
    return _template(_plain(text))


def _marked(words: Column) -> Column:
    return F.split(F.lower(F.translate(words, "0", "ꙮ")), _CUT)


def exact_words(text: Column) -> Column:
    """Single words, with the digit 0 as a letter of its own: no number looks like the placeholder 0."""
    return _marked(_plain(text))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x evaluated once, however often it stands in the result."""
    return F.get(F.transform(F.array(x), use), 0)


def windows(hashes: Column, k: int = K) -> Column:
    """Hashes of all k-word windows of word hashes, in order; empty for fewer words.

    Windows of 1, 2, 4 and so on words are put together, so each takes a few steps for each
    word and no array is made for a window.
    """

    def paired(a: Column, b: Column, shift: int) -> Column:
        return F.transform(a, lambda x, i: F.xxhash64(x, F.get(b, i + shift)))

    def grown(have: Column, width: int, at: Column | None, done: int) -> Column:
        """at: windows of ``done`` words, have: of ``width`` words, the next binary digit of k; the last ones of both are cut off at the end."""
        if k & width:
            part = have if at is None else paired(at, have, done)
            if done + width == k:
                return part
            return _let(part, lambda a: _let(paired(have, have, width), lambda h: grown(h, 2 * width, a, done + width)))
        return _let(paired(have, have, width), lambda h: grown(h, 2 * width, at, done))

    return _let(hashes, lambda h: F.when(F.size(h) >= k, F.slice(grown(h, 1, None, 0), F.lit(1), F.size(h) - k + 1)).otherwise(F.array().cast("array<bigint>")))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, words as template (t) and single words (s), windows of both by the template's words (tw, rw), and the number of empty words before them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    inner = lambda words: F.filter(words, lambda w: w != "")
    lead = (F.element_at(template(text), 1) == "").cast("int")  # positions count an empty word before a leading mark
    words = benchmark.where(F.col("item_id").isNotNull()).select("item_id", inner(template(text)).alias("t"), inner(exact_words(text)).alias("s"), inner(raw_words(text)).alias("g"), lead.alias("lead"))
    # Where the single words of each word of the template begin.
    at = F.transform(F.sequence(F.lit(0), F.size("g")), lambda i: F.aggregate(F.slice("g", F.lit(1), i), F.lit(0), lambda acc, w: acc + F.length(w) - F.length(F.replace(w, F.lit(_JOIN), F.lit(""))) + 1))
    # Written, so that no step is evaluated anew for each element of a later one.
    both = stored(stored(words, "items").select("*", windows(_hashed(F.col("t"))).alias("tw"), windows(_hashed(F.col("s"))).alias("sw"), at.alias("at")), "item-windows")
    return stored(both.select("*", F.transform("tw", lambda _, i: F.get("sw", F.get("at", i))).alias("rw")), "items")


def _short() -> Column:
    return (F.size("t") < K) & (F.size("s") >= 1)


def lengths(items: DataFrame) -> list[int]:
    """Numbers of words of the short items: a few small numbers."""
    return sorted(r[0] for r in items.where(_short()).select(F.size("s")).distinct().collect())


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(item_id, ipos, n_windows, n_rich, rich, raw, h): windows as they are (raw), and as templates where these are rich in plain words."""
    rich = lambda i: F.size(F.filter(F.slice("t", i, K), lambda w: ~w.isin("_", "0", "§"))) >= MIN_WORDS
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - K + 1, F.lit(1))), lambda i: F.struct(rich(i).alias("rich"), F.get("tw", i - 1).alias("th"), F.get("rw", i - 1).alias("rh")))
    long = items.where(F.size("t") >= K).withColumn("places", places)
    each = long.select("item_id", "lead", F.size("places").alias("n_windows"), F.size(F.filter("places", lambda p: p["rich"])).alias("n_rich"), F.posexplode("places").alias("ipos", "p"))
    keys = F.array(F.struct(F.lit(True).alias("raw"), F.col("p.rh").alias("h")), F.when(F.col("p.rich") & (F.col("p.th") != F.col("p.rh")), F.struct(F.lit(False).alias("raw"), F.col("p.th").alias("h"))))
    rows = each.select("item_id", (F.col("ipos") + F.col("lead")).alias("ipos"), "n_windows", "n_rich", F.col("p.rich").alias("rich"), F.explode(keys).alias("k")).where(F.col("k").isNotNull())
    # An item of few words matches as a whole; its single words are counted, whatever is joined.
    whole = F.lit(None).cast("bigint")
    for k in lengths(items):
        whole = F.when(F.size("s") == k, F.get(windows(_hashed(F.col("s")), k), 0)).otherwise(whole)
    short = items.where(_short()).select("item_id", F.col("lead").alias("ipos"), F.lit(1).alias("n_windows"), F.lit(0).alias("n_rich"), F.lit(False).alias("rich"), F.lit(True).alias("raw"), whole.alias("h"))
    return rows.select("item_id", "ipos", "n_windows", "n_rich", "rich", "k.raw", "k.h").unionByName(short)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_run (consecutive windows found word for word) and at of every pair with a common window."""
    items = _items(benchmark)
    known = few(stored(benchmark_windows(items), "benchmark-windows"))
    sizes = lengths(items)
    plain = docs.select("doc_id", _plain(F.col("text")).alias("p"))  # made once, read twice
    words = plain.select("doc_id", _hashed(_template(F.col("p"))).alias("t"), _hashed(_marked(F.col("p"))).alias("s"))
    sets = words.select("doc_id", F.concat(windows(F.col("t")), windows(F.col("s")), *(windows(F.col("s"), k) for k in sizes)).alias("w"))
    # The outer form: of a plain explode the optimizer would infer a filter that evaluates the windows anew.
    each = sets.select("doc_id", F.posexplode_outer("w").alias("dpos", "h"))
    hits = each.join(known, "h").withColumn("support", F.count("*").over(Window.partitionBy("doc_id", "item_id", F.col("dpos") - F.col("ipos"))))
    # One place in the document for each window of the item: bounded by the item, even if a text repeats it.
    # Like windows of one text (Tom has 4 cats. Jane has 7 cats.) fit in many places: the shift that fits most windows goes first.
    # Windows of templates come first in w: dpos is their place.
    once = hits.groupBy("doc_id", "item_id", "ipos").agg(F.min(F.struct((-F.col("support")).alias("s"), (~F.col("raw")).alias("loose"), "dpos")).alias("at"), F.max("raw").alias("raw"), F.max("n_windows").alias("n_windows"), F.max("n_rich").alias("n_rich"), F.max("rich").alias("rich"))
    pairs = once.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_all"), F.max("n_rich").alias("n_rich"), F.count("*").alias("m_all"), F.count_if("rich").alias("m_rich"),
        F.collect_list(F.struct("at.loose", "at.dpos", "ipos", "raw")).alias("at"),
    )
    by_template = F.col("m_rich") * F.col("n_all") > F.col("m_all") * F.col("n_rich")
    run = F.aggregate(
        F.array_sort(F.transform(F.filter("at", lambda m: m["raw"]), lambda m: m["ipos"])),
        F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("best")),
        lambda acc, p: F.struct(p.alias("last"), F.when(p == acc["last"] + 1, acc["n"] + 1).otherwise(1).alias("n"), F.greatest(acc["best"], F.when(p == acc["last"] + 1, acc["n"] + 1).otherwise(1)).alias("best")),
        lambda acc: acc["best"],
    )
    return pairs.select("doc_id", "item_id", F.when(by_template, F.col("n_rich")).otherwise(F.col("n_all")).alias("n_windows"), F.when(by_template, F.col("m_rich")).otherwise(F.col("m_all")).alias("n_matched"), run.alias("n_run"), "at")


def leaks(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each (doc_id, item_id) whose coverage reaches min_coverage or that has an excerpt, with its slots compared.

    kind: exact (all slots alike), reparameterised (other values, consistently), excerpt
    (coverage below min_coverage or values that contradict each other, but EXCERPT words
    in a row word for word) or partial (values contradict each other).
    """
    covered, excerpt = F.col("n_matched") >= min_coverage * F.col("n_windows"), F.col("n_run") >= EXCERPT - K + 1
    found = stored(matches(docs, benchmark).where(covered | excerpt), "leaks")
    ids = few(found.select("doc_id").distinct())
    rows = docs.join(ids, "doc_id", "left_semi").select("doc_id", raw_words(F.col("text")).alias("d")).dropDuplicates(["doc_id"])
    items = light(benchmark, "text").select("item_id", raw_words(F.col("text")).alias("i"), template(F.col("text")).alias("t")).dropDuplicates(["item_id"])
    slots = F.array_distinct(
        F.flatten(
            F.transform(
                "at",
                lambda m: F.filter(
                    F.transform(F.sequence(F.lit(1), F.lit(K)), lambda j: F.struct(F.get(F.col("t"), m["ipos"] + j - 1).alias("t"), F.get(F.col("i"), m["ipos"] + j - 1).alias("i"), F.when(m["loose"], F.get(F.col("d"), m["dpos"] + j - 1)).otherwise(F.get(F.col("i"), m["ipos"] + j - 1)).alias("d"))),
                    lambda s: s["t"].rlike("[_0§]"),
                ),
            )
        )
    )
    out = found.join(rows, "doc_id").join(items, "item_id").withColumn("slots", slots)
    values = F.array_distinct(F.transform("slots", lambda s: F.struct(s["t"], s["i"])))
    same = F.forall("slots", lambda s: s["i"].eqNullSafe(s["d"]))
    consistent = F.size("slots") == F.size(values)
    return out.select(
        "doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), "n_matched", F.round(F.col("n_matched") / F.col("n_windows"), 6).alias("coverage"),
        F.size("slots").cast("long").alias("n_slots"), consistent.alias("consistent"), F.when(covered & same, "exact").when(covered & consistent, "reparameterised").when(excerpt, "excerpt").otherwise("partial").alias("kind"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Rows of docs without a benchmark item, exact, re-parameterised or as an excerpt, unchanged."""
    bad = stored(leaks(docs, benchmark, min_coverage).where("kind <> 'partial' OR coverage >= 0.9").select("doc_id").distinct(), "leaked")
    return docs.join(few(bad), "doc_id", "left_anti").select(*named(docs))
