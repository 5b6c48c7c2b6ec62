"""Discovery of record arrays in JSON documents of unknown shape, and of the fields of their records.

Documents are parsed once; their nodes are expanded level by level inside the row (see
``functions.trees``).  Only candidates leave the row; paths are ranked over all documents by
sums that are merged map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import json_key, let
from tidemill.functions.trees import items, keys, nodes, objects, values

LEAST_SIZE, LEAST_RATE = 3, 0.6
RECORD_DEPTH = 4  # levels of objects above an array of records
# Names of fields by meaning, in the order in which they are preferred.
TITLES = ("title", "name", "headline", "summary", "eventname", "event_name")
DATES = ("start", "startdate", "start_date", "startdatetime", "start_datetime", "date", "datetime", "begin", "dtstart", "startsat", "starts_at", "when")
FIELDS: dict[str, tuple[str, ...]] = {
    "title": TITLES,
    "start_datetime": DATES,
    "canonical_url": ("url", "link", "permalink", "canonical_url", "href", "eventurl"),
    "end_datetime": ("end", "enddate", "end_date", "enddatetime", "end_datetime", "dtend"),
    "venue": ("venue", "location", "place", "venuename"),
    "address": ("address", "streetaddress", "fulladdress"),
    "image": ("image", "imageurl", "image_url", "photo", "thumbnail"),
    "source_category": ("category", "categories", "type", "genre", "tags"),
    "external_source_id": ("id", "uid", "identifier", "guid", "eventid", "event_id"),
}


def _plain(key: Column) -> Column:
    return F.lower(F.translate(key, "-_ ", ""))


def _names(*options: str) -> Column:
    return F.array(*(F.lit(x.replace("-", "").replace("_", "").replace(" ", "")) for x in options))


def event_like(node: Column) -> Column:
    """Whether an object has a field for a title and one for a date."""
    return let(F.transform(keys(node), _plain), lambda ks: F.arrays_overlap(ks, _names(*TITLES)) & F.arrays_overlap(ks, _names(*DATES)))


def _array(n: Column) -> Column:
    """What an array holds: number of objects, share of event-like ones, and the keys of its first object."""
    shown = lambda found: F.struct(
        n["path"].alias("path"), n["depth"].alias("depth"), F.size(found).alias("size"), F.round(F.size(F.filter(found, event_like)) / F.nullif(F.size(found), F.lit(0)), 4).alias("rate"), F.slice(keys(F.get(found, 0)), 1, 20).alias("sample"),
    )
    return let(objects(n["node"]), shown)


def arrays(doc: Column, least: int = LEAST_SIZE) -> Column:
    """array<struct(path, depth, size, rate, sample)> of all arrays of at least ``least`` objects in a variant."""
    return F.filter(F.transform(nodes(doc), _array), lambda a: a["size"] >= least)


def array_rates(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, path, depth, size, rate and sample of every array of objects in each document; ``$`` is the document itself."""
    each = df.select(F.col(key), F.explode(arrays(F.try_parse_json(body))).alias("a"))
    return each.select(key, F.when(F.col("a.path") == "", "$").otherwise(F.col("a.path")).alias("path"), "a.depth", "a.size", "a.rate", "a.sample")


def event_arrays(df: DataFrame, key: str, body: str) -> DataFrame:
    """The arrays of each document that look like lists of events, best first (``place`` 1), with the key of each field.

    The share of event-like objects dominates the score; a larger array breaks ties, then the path.
    """
    found = array_rates(df, key, body).where(F.col("rate") >= LEAST_RATE)
    score = F.round(F.col("rate") + F.least("size", F.lit(50)) / 1000, 4)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("size").desc(), "path"))
    return found.withColumn("score", score).withColumn("place", place).withColumn("fields", field_keys(F.col("sample")))


def field_keys(sample: Column) -> Column:
    """map<string,string> of each known field to the key of a sample object that stands for it, by the order of ``FIELDS``."""
    plain = F.transform(sample, _plain)

    def own(options: tuple[str, ...]) -> Column:
        hits = F.filter(_names(*options), lambda o: F.array_contains(plain, o))
        # Of keys that are alike the last one counts.
        return let(F.get(hits, 0), lambda h: F.get(F.reverse(F.filter(sample, lambda k: _plain(k) == h)), 0))

    pairs = F.array(*(F.struct(F.lit(name).alias("key"), own(options).alias("value")) for name, options in FIELDS.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def ranked_paths(df: DataFrame, key: str, body: str) -> DataFrame:
    """Each path over all documents, places in arrays as []: documents, objects, their event-like share and the path's rank.

    Rank: share of event-like objects, then objects, then path.
    """
    each = array_rates(df, key, body).withColumn("path", F.regexp_replace("path", r"\[\d+\]", "[]"))
    per_doc = each.groupBy("path", key).agg(F.sum("size").alias("n"), F.sum(F.round(F.col("size") * F.col("rate"))).alias("like"))
    sums = per_doc.groupBy("path").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_objects"), F.sum("like").cast("long").alias("n_like"))
    rated = sums.withColumn("share", F.round(F.col("n_like") / F.col("n_objects"), 4))
    # As many rows as there are shapes of paths, however many documents.
    return rated.withColumn("rank", F.row_number().over(Window.orderBy(F.col("share").desc(), F.col("n_objects").desc(), "path")))


def record_array(doc: Column, groups: Mapping[str, Sequence[str]], depth: int = RECORD_DEPTH) -> Column:
    """struct(hits, size, path, present) of the best array of records that stands in objects of a variant, or null.

    At least half of an array's items are objects.  Most field groups win, then most records,
    then the first path; keys of the first 25 records and of objects in them count.
    """

    def rated(n: Column, found: Column) -> Column:
        inner = F.flatten(F.transform(F.slice(found, 1, 25), lambda r: F.concat(keys(r), F.flatten(F.transform(values(r), keys)))))
        return let(F.transform(inner, json_key), lambda ks: let(_present(ks, groups), lambda given: F.struct((-F.size(given)).alias("hits"), (-F.size(found)).alias("size"), n["path"].alias("path"), given.alias("present"))))

    def described(n: Column) -> Column:
        half = F.greatest(F.lit(1), F.floor(F.size(items(n["node"])) / 2))
        return let(objects(n["node"]), lambda found: F.when(F.size(found) >= half, rated(n, found)))

    found = F.transform(nodes(doc, depth, into_arrays=False), described)
    return let(F.array_min(F.array_compact(found)), lambda b: F.when(b.isNotNull(), F.struct((-b["hits"]).alias("hits"), (-b["size"]).alias("size"), b["path"].alias("path"), b["present"].alias("present"))))


def _present(plain: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """Names of the groups of which one field is among the keys."""
    return F.array_compact(F.array(*(F.when(F.arrays_overlap(plain, F.array(*map(F.lit, fields))), F.lit(name)) for name, fields in groups.items())))
