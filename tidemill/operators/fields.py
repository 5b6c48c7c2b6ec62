"""Inference of fields from repeated cards: a score for each role and selector, with gates, and the best selector of each role.

Cards of a page are the siblings of its chosen group.  Every element inside a card is observed
under its selectors (name, name with a class, and as the child of a parent with a class) and its readable attributes; observations are
reduced to one row for each page and selector by two map-side aggregations, and the score
matrix is an array of roles in that row: no pair of roles or selectors is shuffled.

Seven shares are weighed: names that fit the role, the element's prior, microdata, coverage of
cards, one match a card, values that read as the role's kind, and variation between cards.
Unstable or bare selectors lose, a machine-readable date wins ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.dates import looks_dated, parse_date, parse_time
from tidemill.functions.markup import attribute, classes, elements, tags, text_inside
from tidemill.functions.text import collapsed, let, name_tokens, stable_class
from tidemill.functions.urls import absolute, public_url_problem

ROLES = ("title", "canonical_url", "start_datetime", "start_time", "end_datetime", "end_time", "venue", "address", "description", "image", "source_category", "external_source_id")
REQUIRED, IDENTITY = ("title", "canonical_url", "start_datetime"), ("title", "canonical_url")
# Words of names that speak for a role, and against it.
WORDS = {
    "title": "title name headline heading subject", "canonical_url": "title name link permalink url headline details info", "start_datetime": "date datetime when start day dates",
    "start_time": "time hour showtime start doors clock", "end_datetime": "end until through finish", "end_time": "end until finish", "venue": "venue location place where hall theater theatre room building",
    "address": "address street addr postal zip", "description": "description summary excerpt teaser tagline blurb subtitle caption", "image": "image img photo thumb thumbnail poster picture media",
    "source_category": "category categories genre type tag tags kind series topic", "external_source_id": "id uid identifier guid",
}
AGAINST = {
    "title": "date time venue address image photo thumb price cost share", "canonical_url": "nav menu pagination filter search social share ical google", "start_datetime": "end updated published posted expire",
    "start_time": "end", "description": "date time price cost venue location address", "image": "logo icon avatar sprite",
}
TITLE_LINKS = ("title", "name", "headline")
# How much an element's name alone speaks for a role.
PRIORS = {
    "title": {"h1": 0.85, "h2": 0.85, "h3": 0.85, "h4": 0.7, "h5": 0.6, "h6": 0.6, "a": 0.45}, "canonical_url": {"a": 0.8}, "start_datetime": {"time": 0.9}, "end_datetime": {"time": 0.6}, "start_time": {"time": 0.8},
    "end_time": {"time": 0.6}, "image": {"img": 0.9, "source": 0.7, "picture": 0.6}, "address": {"address": 0.9}, "description": {"p": 0.6, "div": 0.35},
}
PRIOR = 0.3
MICRODATA = {"name": "title", "headline": "title", "url": "canonical_url", "startdate": "start_datetime", "enddate": "end_datetime", "location": "venue", "address": "address", "description": "description", "image": "image", "identifier": "external_source_id"}
# Weights, penalties and gates.
WEIGHTS = {"semantic": 0.26, "tag": 0.13, "schema": 0.10, "coverage": 0.18, "unique": 0.09, "parse": 0.16, "variation": 0.08}
UNSTABLE, BARE, MACHINE, BROAD = 0.10, 0.04, 0.08, 0.15
LEAST_CONFIDENCE, LEAST_REQUIRED = 0.45, 0.55
LEAST_COVERAGE, LEAST_UNIQUE, LEAST_PARSE, LEAST_VARIATION = 0.5, 0.6, 0.5, 0.5
MAX_SELECTOR, MAX_CLASSES = 120, 3
ATTRIBUTES = ("href", "src", "data-src", "data-lazy-src", "data-original", "srcset", "data-srcset", "style", "datetime", "content")
_IMAGES = ("src", "data-src", "data-lazy-src", "data-original", "srcset", "data-srcset", "style")


def _any_of(tokens: Column, words: str) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words.split()))) if words else F.lit(False)


def card_elements(df: DataFrame, key: str, page: str, groups: DataFrame) -> DataFrame:
    """Elements inside the cards of each page: key, card, id, tag, source, text; groups names the siblings (key, parent, tag, classes)."""
    wanted = groups.select(key, F.struct("parent", "tag", "classes").alias("group"))
    rows = df.select(key, F.col(page).alias("page")).join(wanted, key)

    def inside(every: Column, all_tags: Column, card: Column) -> Column:
        above = lambda e: F.when(e["parent"] > card["id"], F.get(every, e["parent"] - 1)["source"])
        return F.transform(F.slice(every, card["id"] + 1, card["last"] - card["id"]), lambda e: F.struct(card["id"].alias("card"), e["id"].alias("id"), e["tag"].alias("tag"), e["source"].alias("source"), above(e).alias("above"), text_inside(all_tags, e).alias("text")))

    is_card = lambda e: (e["parent"] == F.col("group.parent")) & (e["tag"] == F.col("group.tag")) & (F.array_join(classes(e["source"]), ".") == F.col("group.classes"))
    cards = lambda every: F.filter(every, is_card)
    made = let(tags(F.col("page")), lambda ts: let(elements(ts), lambda es: let(cards(es), lambda cs: F.struct(F.size(cs).alias("n_cards"), F.flatten(F.transform(cs, lambda c: inside(es, ts, c))).alias("inside")))))
    return rows.select(key, made.alias("m")).select(key, "m.n_cards", F.explode("m.inside").alias("e")).select(key, "n_cards", "e.*")


def observations(found: DataFrame, key: str) -> DataFrame:
    """One row for each page, selector and attribute (null: the text), with what its first match in each card holds.

    n_cards, n_some (cards with a match), n_one, vals (one value of each card that has one), tags,
    hints (words of names), props (microdata) and first_anchor.
    """
    own = lambda source: F.slice(F.filter(classes(source), stable_class), 1, MAX_CLASSES)
    words = lambda source: F.array_distinct(F.flatten(F.transform(F.array(*(F.coalesce(attribute(source, a), F.lit("")) for a in ("class", "id", "itemprop", "aria-label"))), name_tokens)))
    pick = lambda selector, names: F.struct(selector.alias("selector"), names.alias("names"))
    mine, above = words(F.col("source")), F.regexp_extract(F.lower("above"), "^<([a-z][^\\s/>]*)", 1)
    child = F.transform(own(F.coalesce("above", F.lit(""))), lambda c: pick(F.concat(above, F.lit("."), c, F.lit(" > "), F.col("tag")), F.array_union(F.col("names"), words(F.col("above")))))
    picks = F.concat(F.array(pick(F.col("tag"), F.col("names"))), F.transform(own(F.col("source")), lambda c: pick(F.concat(F.col("tag"), F.lit("."), c), F.col("names"))), child)
    read = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("attribute"), F.nullif(F.col("text"), F.lit("")).alias("value"))), F.filter(F.array(*(F.struct(F.lit(a).alias("attribute"), F.nullif(F.trim(attribute(F.col("source"), a)), F.lit("")).alias("value")) for a in ATTRIBUTES)), lambda x: x["value"].isNotNull()))
    anchors = F.min(F.when((F.col("tag") == "a") & (F.col("text") != ""), F.col("id"))).over(Window.partitionBy(key, "card"))
    named = found.withColumn("first_anchor", F.col("id") == anchors).withColumn("names", mine)
    prop = F.nullif(F.lower(F.coalesce(attribute(F.col("source"), "itemprop"), F.lit(""))), F.lit("")).alias("prop")
    each = named.select(key, "n_cards", "card", "id", "tag", "first_anchor", prop, read.alias("read"), F.explode(picks).alias("pick")).select(key, "n_cards", "card", "id", "tag", "first_anchor", "pick.names", "prop", "pick.selector", "read")
    one = each.where(F.length("selector") <= MAX_SELECTOR).select("*", F.explode("read").alias("r")).select(key, "n_cards", "card", "id", "tag", "first_anchor", "names", "prop", "selector", "r.attribute", "r.value")
    # The first match of a card counts; other matches make it ambiguous.  An attribute that it lacks is no value.
    counts = each.groupBy(key, "selector", "card").agg(F.count("*").alias("c"), F.min("id").alias("first"))
    firsts = one.join(counts, [key, "selector", "card"]).where("id = first")
    seen = firsts.groupBy(key, "selector", "attribute").agg(
        F.max("n_cards").alias("n_cards"), F.collect_list("value").alias("vals"), F.collect_set("tag").alias("tags"), F.array_distinct(F.flatten(F.collect_set("names"))).alias("hints"), F.collect_set("prop").alias("props"), F.max("first_anchor").alias("first_anchor"),
    )
    matched = counts.groupBy(key, "selector").agg(F.count("*").alias("n_some"), F.count_if(F.col("c") == 1).alias("n_one"))
    return seen.join(matched, [key, "selector"])


def _fits(role: str, v: Column, base: Column, dates: Sequence[str], times: Sequence[str]) -> Column:
    """Whether a value reads as the kind of a role."""
    text = collapsed(v)
    n = F.length(text)
    if role == "title":
        return n.between(2, 300) & ~(looks_dated(text) & (n <= 12))
    if role == "canonical_url":
        return ~v.startswith("#") & ~F.lower(v).startswith("javascript:") & public_url_problem(absolute(base, v)).isNull()
    if role in ("start_datetime", "end_datetime"):
        return parse_date(text, dates).isNotNull()
    if role in ("start_time", "end_time"):
        return parse_time(text, times).isNotNull()
    if role == "image":
        return F.when(F.contains(v, F.lit("url(")), v.rlike(r"url\(['\"]?[^'\")]+['\"]?\)")).otherwise(let(F.get(F.split(v, r"\s+"), 0), lambda u: u.rlike(r"(?i)\.(?:jpe?g|png|webp|gif|avif|svg)(?:[?#]|$)") | F.contains(u, F.lit("/"))))
    least, most = {"venue": (1, 160), "address": (6, None), "description": (20, None), "source_category": (1, 80), "external_source_id": (1, 80)}[role]
    return (n >= least) & (n <= most if most else F.lit(True))


def _allowed(role: str) -> Column:
    a = F.col("attribute")
    if role == "canonical_url":
        return F.coalesce(a == "href", F.lit(False))
    if role == "image":
        return F.coalesce(a.isin(*_IMAGES), F.lit(False))
    if role in ("start_datetime", "end_datetime"):
        return a.isNull() | a.isin("datetime", "content")
    return a.isNull()


def _scored(role: str, base: Column, dates: Sequence[str], times: Sequence[str]) -> Column:
    """struct(role, confidence, parse) of an observation under a role, or null where a gate stops it."""
    hints, vals = F.col("hints"), F.col("vals")
    good = _any_of(hints, WORDS[role])
    semantic = F.when(_any_of(hints, " ".join(TITLE_LINKS)), 1.0).when(good, 0.7).otherwise(0.0) if role == "canonical_url" else F.when(good, 1.0).otherwise(0.0)
    priors = F.create_map(*(F.lit(x) for pair in PRIORS.get(role, {"": PRIOR}).items() for x in pair))
    tag = F.array_max(F.transform("tags", lambda t: F.coalesce(F.try_element_at(priors, t), F.lit(PRIOR))))
    tag = F.when(F.col("first_anchor"), F.greatest(tag, F.lit(0.6))).otherwise(tag) if role == "title" else tag
    mine = [p for p, r in MICRODATA.items() if r == role]
    schema = F.when(F.size("props") == 0, 0.4).when(F.arrays_overlap("props", F.array(*map(F.lit, mine))) if mine else F.lit(False), 1.0).otherwise(0.0)
    parse = F.coalesce(F.size(F.filter(vals, lambda v: F.coalesce(_fits(role, v, base, dates, times), F.lit(False)))) / F.nullif(F.size(vals), F.lit(0)), F.lit(0.0))
    bare = ~F.contains(F.col("selector"), F.lit("."))
    stability = 1.0 - F.least(F.lit(0.25), F.length("selector") / (MAX_SELECTOR * 4)) - F.when(F.contains(F.col("selector"), F.lit(" > ")), 0.25).otherwise(0.0)
    broad = F.when(F.col("selector") == "a", BROAD).otherwise(0.0) if role == "canonical_url" else F.lit(0.0)

    def decided(x: Column) -> Column:
        machine = F.when(F.coalesce(F.col("attribute") == "datetime", F.lit(False)) & F.lit(role in ("start_datetime", "end_datetime")), MACHINE).otherwise(0.0)
        w = WEIGHTS
        total = w["semantic"] * x["semantic"] + w["tag"] * x["tag"] + w["schema"] * x["schema"] + w["coverage"] * F.col("coverage") + w["unique"] * F.col("uniqueness") + w["parse"] * x["parse"] + w["variation"] * (F.col("variation") if role in IDENTITY else F.lit(1.0))
        total = total - UNSTABLE * (1.0 - stability) - F.when(bare, BARE).otherwise(0.0) + machine - broad
        gates = (F.col("coverage") >= LEAST_COVERAGE) & (F.col("uniqueness") >= LEAST_UNIQUE) & (x["parse"] >= LEAST_PARSE) & ~((x["semantic"] == 0) & (x["schema"] < 1) & (x["tag"] < 0.6))
        gates = gates & (F.col("variation") >= LEAST_VARIATION) if role in IDENTITY else gates
        return F.when(gates, F.struct(F.lit(role).alias("role"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6).alias("confidence"), F.round(x["parse"], 6).alias("parse")))

    parts = F.struct(semantic.alias("semantic"), tag.alias("tag"), schema.alias("schema"), parse.alias("parse"))
    return F.when(_allowed(role) & ~_any_of(hints, AGAINST.get(role, "")), let(parts, decided))


def score_matrix(seen: DataFrame, key: str, base: str, dates: Sequence[str] = (), times: Sequence[str] = ()) -> DataFrame:
    """(key, role, selector, attribute, confidence, coverage, parse) of every selector that passes a role's gates."""
    shares = seen.withColumns({
        "coverage": F.size("vals") / F.col("n_cards"), "uniqueness": F.col("n_one") / F.nullif(F.col("n_some"), F.lit(0)), "variation": F.coalesce(F.size(F.array_distinct("vals")) / F.nullif(F.size("vals"), F.lit(0)), F.lit(0.0)),
    })
    roles = F.array_compact(F.array(*(_scored(r, F.col(base), dates, times) for r in ROLES)))
    each = shares.select(key, "selector", "attribute", "coverage", roles.alias("roles")).select(key, "selector", "attribute", "coverage", F.explode("roles").alias("s"))
    return each.select(key, "s.role", "selector", "attribute", "s.confidence", F.round("coverage", 6).alias("coverage"), "s.parse")


def inferred_fields(df: DataFrame, key: str, page: str, groups: DataFrame, base: str, dates: Sequence[str] = (), times: Sequence[str] = (), more: int = 3) -> DataFrame:
    """The best selector of each role on each page: key, role, selector, attribute, confidence, coverage, parse, accepted and alternatives.

    Ties: the shorter selector, then its name.  ``accepted`` asks for more confidence of required roles.
    """
    found = observations(card_elements(df, key, page, groups), key).join(df.select(key, F.col(base).alias("base")), key)
    matrix = score_matrix(found, key, "base", dates, times)
    # At most as many rows in a group as a page has selectors.
    one = F.struct((-F.col("confidence")).alias("order"), F.length("selector").alias("length"), "selector", F.coalesce("attribute", F.lit("")).alias("attribute"), "coverage", "parse")
    best = matrix.groupBy(key, "role").agg(F.array_sort(F.collect_list(one)).alias("all"))
    top = F.col("all")[0]
    named = lambda x: F.concat(x["selector"], F.when(x["attribute"] != "", F.concat(F.lit("@"), x["attribute"])).otherwise(""))
    least = F.when(F.col("role").isin(*REQUIRED), LEAST_REQUIRED).otherwise(LEAST_CONFIDENCE)
    return best.select(key, "role", top["selector"].alias("selector"), F.nullif(top["attribute"], F.lit("")).alias("attribute"), (-top["order"]).alias("confidence"), top["coverage"].alias("coverage"), top["parse"].alias("parse"), (-top["order"] >= least).alias("accepted"), F.transform(F.slice("all", 2, more), named).alias("alternatives"))
