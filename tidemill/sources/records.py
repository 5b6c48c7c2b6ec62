"""Record extractors: one fetched document -> rows of raw records, in SQL functions.

Each takes a DataFrame with a key and a text column and gives key, ``idx`` (position in the
document), ``node_hash`` (SHA-256 of the record as JSON with sorted keys) and one string
column for each field.  Documents that can not be read give no row; elements that are no
objects are passed over but keep their position.  ``paths`` replaces default paths by name.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.dates import epoch_iso

# Default paths of each kind of document.
POSTS = {"external_source_id": "id", "title": "title.rendered", "description": "content.rendered", "canonical_url": "link", "start_datetime": "date_gmt", "source_category": "type"}
CALENDAR = {
    "external_source_id": "id", "title": "title", "description": "description", "excerpt": "excerpt", "canonical_url": "url", "start_datetime": "start_date", "end_datetime": "end_date", "all_day": "all_day", "timezone": "timezone", "image": "image.url",
    "venue": "venue.venue", "address": "venue.address", "locality": "venue.city", "region": "venue.state", "postal_code": "venue.zip", "latitude": "venue.geo_lat", "longitude": "venue.geo_lng", "organizer": "organizer[0].organizer", "source_category": "categories[0].name", "cost": "cost", "series_id": "series",
}
OFFSET_FEED = {
    "external_source_id": "id", "event_id": "event_id", "title": "title", "canonical_url": "url", "start_datetime": "date_ts", "end_datetime": "date_end_ts", "all_day": "all_day", "timezone": "timezone", "venue": "location", "address": "address", "locality": "city", "region": "state", "postal_code": "zip",
    "latitude": "latitude", "longitude": "longitude", "summary": "summary", "description": "description", "contact_name": "contact_name", "contact_email": "contact_email", "contact_phone": "contact_phone",
}
NESTED_DOCS = {"title": "title", "canonical_url": "url", "start_datetime": "startDate", "end_datetime": "endDate", "date": "date", "locality": "city", "latitude": "latitude", "longitude": "longitude", "recur_type": "recurType"}
SEARCH_HITS = {"external_source_id": "objectID", "title": "title", "description": "description", "canonical_url": "url", "start_datetime": "start", "end_datetime": "end", "venue": "venue", "address": "address", "image": "image", "source_category": "category"}
SCRIPT_EVENTS = {"external_source_id": "id", "title": "title", "description": "description", "canonical_url": "url", "start_datetime": "start", "end_datetime": "end", "venue": "venue", "address": "address", "image": "image", "source_category": "category"}
LINKED_DATA = {"title": "name", "description": "description", "start_datetime": "startDate", "end_datetime": "endDate", "canonical_url": "url", "venue": "location.name", "source_category": "eventStatus", "external_source_id": "identifier", "offers_url": "offers.url"}
FEED = {"title": ("title",), "description": ("description", "summary", "content"), "external_source_id": ("guid", "id"), "source_category": ("category",)}
IMAGE_KEYS = ("lg", "large", "original", "url", "src", "md", "medium", "sm", "small")
MEDIA_KEYS = ("url", "src", "lg", "large", "original", "md", "medium", "sm", "small", "uri")
VENUE_KEYS = ("name", "title", "venue", "label", "displayName")
NAME_KEYS = ("name", "title", "label", "category")
ADDRESS_KEYS = ("streetAddress", "addressLocality", "addressRegion", "postalCode")
UNSAFE_SCHEMES = ("javascript:", "data:", "file:", "vbscript:", "blob:")


def json_path(path: str) -> str:
    """A dotted path with [n] or bare-number steps as a JSON path."""
    out = "$"
    for step in re.findall(r"[^.\[\]]+|\[\d+\]", path):
        out += step if step.startswith("[") else f"[{step}]" if step.isdigit() else f"['{step}']" if not re.fullmatch(r"\w+", step) else f".{step}"
    return out


def value(node: Column, path: str, kind: str = "string") -> Column:
    """The value at a path, or null where there is none or it is of another kind."""
    return F.try_variant_get(node, json_path(path), kind)


def kind_of(node: Column, path: str = "") -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, BOOLEAN and so on, VOID for JSON null; null where nothing is."""
    at = F.try_variant_get(node, json_path(path), "variant") if path else node
    return F.regexp_extract(F.schema_of_variant(at), r"^\w+", 0)


def _array(node: Column, path: str) -> Column:
    return F.when(kind_of(node, path) == "ARRAY", F.try_variant_get(node, json_path(path), "array<variant>"))


def _records(df: DataFrame, key: str, nodes: Column) -> DataFrame:
    """key, idx and node of the objects among nodes."""
    return df.select(F.col(key), F.posexplode(nodes).alias("idx", "node")).where(kind_of(F.col("node")) == "OBJECT")


def _fields(paths: Mapping[str, str]) -> list[Column]:
    return [value(F.col("node"), p).alias(name) for name, p in paths.items()]


def _hash() -> Column:
    return F.sha2(F.to_json("node"), 256).alias("node_hash")


def _first_string(node: Column, names: tuple[str, ...], path: str = "") -> Column:
    """First text that is not empty among the values of some names of an object."""
    text = lambda p: F.when(kind_of(node, p) == "STRING", F.nullif(value(node, p), F.lit("")))
    return F.coalesce(*(text(f"{path}.{n}" if path else n) for n in names))


def _text_or_named(node: Column, path: str, names: tuple[str, ...]) -> Column:
    """A text, or the first named text of an object, or of the first element of an array."""
    own = lambda p: F.when(kind_of(node, p) == "STRING", F.nullif(value(node, p), F.lit(""))).when(kind_of(node, p) == "OBJECT", _first_string(node, names, p))
    return F.when(kind_of(node, path) == "ARRAY", own(f"{path}[0]")).otherwise(own(path))


def _address(*parts: Column) -> Column:
    return F.nullif(F.array_join(F.array_compact(F.array(*(F.nullif(p, F.lit("")) for p in parts))), ", "), F.lit(""))


def _safe(url: Column) -> Column:
    bad = F.lit(False)
    for s in UNSAFE_SCHEMES:
        bad = bad | F.lower(F.trim(url)).startswith(s)
    return F.when(~bad, F.nullif(F.trim(url), F.lit("")))


def posts(df: DataFrame, key: str, text: str, paths: Mapping[str, str] = {}) -> DataFrame:
    """Posts of a content system: an array, or one object."""
    doc = F.try_parse_json(F.col(text))
    nodes = F.when(kind_of(doc) == "OBJECT", F.array(doc)).otherwise(_array(doc, ""))
    return _records(df, key, nodes).select(key, "idx", _hash(), *_fields({**POSTS, **paths}))


def _events_or_array(doc: Column) -> Column:
    return F.when(kind_of(doc) == "OBJECT", _array(doc, "events")).otherwise(_array(doc, ""))


def calendar(df: DataFrame, key: str, text: str, paths: Mapping[str, str] = {}) -> DataFrame:
    """Calendar entries: times after a space become ISO, all-day ones lose theirs, false is no image, the address is put together."""
    found = _records(df, key, _events_or_array(F.try_parse_json(F.col(text)))).select(key, "idx", _hash(), *_fields({**CALENDAR, **paths}))
    whole = F.coalesce(F.col("all_day").try_cast("boolean"), F.lit(False))
    cut = r"^\s*(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})\s*$"
    iso = lambda c: F.when(F.col(c).rlike(cut), F.when(whole, F.regexp_extract(c, cut, 1)).otherwise(F.regexp_replace(c, cut, "$1T$2"))).otherwise(F.col(c))
    return found.withColumns({"start_datetime": iso("start_datetime"), "end_datetime": iso("end_datetime"), "image": F.nullif("image", F.lit("false")), "address": _address(*(F.col(c) for c in ("address", "locality", "region", "postal_code")))})


def offset_feed(df: DataFrame, key: str, text: str, paths: Mapping[str, str] = {}) -> DataFrame:
    """Entries with epoch seconds, images by size and groups by name."""
    node = F.col("node")
    own = {k: v for k, v in {**OFFSET_FEED, **paths}.items()}
    group = F.when(kind_of(node, "groups[0]") == "STRING", value(node, "groups[0]")).otherwise(_first_string(node, ("name", "title"), "groups[0]"))
    found = _records(df, key, _events_or_array(F.try_parse_json(F.col(text)))).select(key, "idx", _hash(), *_fields(own), _text_or_named(node, "photo", IMAGE_KEYS).alias("image"), F.when(kind_of(node, "groups") == "ARRAY", group).alias("source_category"))
    whole = F.coalesce(F.col("all_day").try_cast("boolean"), F.lit(False))
    iso = lambda c: F.when(F.col(c).try_cast("double").isNull(), F.col(c)).otherwise(epoch_iso(F.col(c), whole))
    return found.withColumns({"external_source_id": F.coalesce("external_source_id", "event_id"), "start_datetime": iso("start_datetime"), "end_datetime": iso("end_datetime"), "address": _address(*(F.col(c) for c in ("address", "locality", "region", "postal_code")))}).drop("event_id")


def nested_docs(df: DataFrame, key: str, text: str, root: str = "docs.docs", paths: Mapping[str, str] = {}) -> DataFrame:
    """Records of a nested result: ids and dates with fallbacks, venues and media of several shapes, category names once each."""
    node = F.col("node")
    # The position counts objects only, as the others never were records.
    objects = lambda a: F.filter(a, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    name = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.trim(F.try_variant_get(x, "$", "string"))).otherwise(F.coalesce(*(F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{n}", "variant")) == "STRING", F.nullif(F.trim(F.try_variant_get(x, f"$.{n}", "string")), F.lit(""))) for n in NAME_KEYS)))
    names = F.when(kind_of(node, "categories") == "STRING", F.array(F.trim(value(node, "categories")))).otherwise(F.transform(_array(node, "categories"), name))
    names = F.array_distinct(F.filter(F.array_compact(names), lambda n: n != ""))
    ident = F.coalesce(*(F.when(kind_of(node, k).isin("STRING", "BIGINT", "TINYINT", "SMALLINT", "INT"), F.nullif(F.trim(value(node, k)), F.lit(""))) for k in ("recid", "_id", "id")))
    # An image that is not safe is passed over for the next key.
    image = lambda p: F.when(kind_of(node, p) == "STRING", _safe(value(node, p))).when(kind_of(node, p) == "OBJECT", F.coalesce(*(F.when(kind_of(node, f"{p}.{k}") == "STRING", _safe(value(node, f"{p}.{k}"))) for k in MEDIA_KEYS)))
    found = _records(df, key, objects(_array(F.try_parse_json(F.col(text)), root)))
    found = found.select(
        key, "idx", _hash(), *_fields({**NESTED_DOCS, **paths}), ident.alias("external_source_id"), _text_or_named(node, "location", VENUE_KEYS).alias("venue"),
        F.when(kind_of(node, "media_raw") == "ARRAY", image("media_raw[0]")).otherwise(image("media_raw")).alias("image"), F.when(F.size(names) > 0, F.array_join(names, "|")).alias("categories"), F.get(names, 0).alias("source_category"),
    )
    return found.withColumns({"start_datetime": F.coalesce(F.nullif("start_datetime", F.lit("")), "date"), "address": F.nullif("locality", F.lit(""))}).drop("date")


def hits(df: DataFrame, key: str, text: str, root: str = "hits", paths: Mapping[str, str] = {}) -> DataFrame:
    """Hits of a search response."""
    return _records(df, key, _array(F.try_parse_json(F.col(text)), root)).select(key, "idx", _hash(), *_fields({**SEARCH_HITS, **paths}))


def _scripts(html: Column, mark: str) -> Column:
    """Bodies of the script elements whose attributes hold a mark."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?is)<script\b[^>]*{mark}[^>]*>(.*?)</script\s*>"), 1)


def script_json(df: DataFrame, key: str, text: str, mark: str = r"""type\s*=\s*["']?application/json["']?""", root: str | None = None, paths: Mapping[str, str] = {}) -> DataFrame:
    """Records in JSON scripts of a page: at ``root``, or scripts that are arrays themselves."""
    docs = df.select(key, F.explode(_scripts(F.col(text), mark)).alias("__body")).withColumn("__doc", F.try_parse_json("__body"))
    return _records(docs, key, _array(F.col("__doc"), root or "")).select(key, "idx", _hash(), *_fields({**SCRIPT_EVENTS, **paths}))


def page_data(df: DataFrame, key: str, text: str, root: str, element: str = "__NEXT_DATA__", paths: Mapping[str, str] = {}) -> DataFrame:
    """Records at ``root`` of the data script of a rendered page, or of a text that is JSON as a whole; scripts are never run."""
    whole = F.try_parse_json(F.col(text))
    body = F.get(_scripts(F.col(text), rf"""id\s*=\s*["']{element}["']"""), 0)
    doc = F.coalesce(F.try_parse_json(body), whole)
    return _records(df, key, _array(doc, root)).select(key, "idx", _hash(), *_fields({**SCRIPT_EVENTS, **paths}))


def linked_data(df: DataFrame, key: str, text: str, page_url: Column | None = None, offers_as_url: bool = False, paths: Mapping[str, str] = {}) -> DataFrame:
    """Events in linked-data scripts: arrays and graphs of two levels flattened, types that hold "event" in any case."""
    node = F.col("node")

    def flat(d: Column) -> Column:
        # An object with a graph is its graph; arrays are taken apart.
        graph = F.try_variant_get(d, "$.@graph", "array<variant>")
        return F.when(F.schema_of_variant(d).startswith("ARRAY"), F.try_variant_get(d, "$", "array<variant>")).when(graph.isNotNull() & F.schema_of_variant(d).startswith("OBJECT"), graph).otherwise(F.array(d))

    docs = df.select(*df.columns, F.explode(_scripts(F.col(text), r"""type\s*=\s*["']?application/ld\+json["']?""")).alias("__body")).withColumn("__doc", F.try_parse_json("__body")).where("__doc IS NOT NULL")
    nodes = F.flatten(F.transform(flat(F.col("__doc")), flat))
    extra = [F.coalesce(page_url, F.lit(None)).cast("string").alias("__page")] if page_url is not None else [F.lit(None).cast("string").alias("__page")]
    found = docs.select(key, *extra, F.posexplode(nodes).alias("idx", "node")).where(kind_of(node) == "OBJECT")
    types = F.when(kind_of(node, "@type") == "ARRAY", F.array_join(F.try_variant_get(node, "$['@type']", "array<string>"), " ")).otherwise(value(node, "@type"))
    found = found.where(F.contains(F.lower(types), F.lit("event")))
    address = F.when(kind_of(node, "location.address") == "STRING", value(node, "location.address")).when(kind_of(node, "location.address") == "OBJECT", _address(*(value(node, f"location.address.{k}") for k in ADDRESS_KEYS)))
    image = lambda p: F.when(kind_of(node, p) == "STRING", value(node, p)).when(kind_of(node, f"{p}.url") == "STRING", value(node, f"{p}.url"))
    out = found.select(key, "idx", _hash(), "__page", *_fields({**LINKED_DATA, **paths}), address.alias("address"), F.when(kind_of(node, "image") == "ARRAY", image("image[0]")).otherwise(image("image")).alias("image"))
    url = F.nullif("canonical_url", F.lit(""))
    url = F.coalesce(url, "__page")
    url = F.coalesce(url, F.nullif("offers_url", F.lit(""))) if offers_as_url else url
    return out.withColumn("canonical_url", url).drop("__page", "offers_url")


def calendar_file(df: DataFrame, key: str, text: str) -> DataFrame:
    """Entries of an iCalendar text: folded lines joined, dates and times to ISO, cancelled ones flagged, rules kept as they are."""
    joined = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r?\n[ \t]", "")
    bodies = F.regexp_extract_all(joined, F.lit(r"(?is)BEGIN:VEVENT\s*\r?\n(.*?)END:VEVENT"), 1)
    each = df.where(joined.rlike(r"(?i)BEGIN:VCALENDAR")).select(key, F.posexplode(bodies).alias("idx", "body"))
    line = lambda name, group: F.regexp_extract("body", rf"(?im)^{name}((?:;[^:\r\n]*)?):([^\r\n]*)", group)

    def plain(name: str) -> Column:
        out = line(name, 2)
        for a, b in ((r"\\[nN]", "\n"), (r"\\([,;\\])", "$1")):
            out = F.regexp_replace(out, a, b)
        return F.nullif(F.trim(out), F.lit(""))

    def moment(name: str) -> Column:
        v = F.trim(line(name, 2))
        day = F.regexp_replace(v, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
        timed = F.regexp_replace(v, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z?$", "$1-$2-$3T$4:$5:$6")
        return F.when(v.rlike(r"^\d{8}$"), day).when(v.rlike(r"^\d{8}T\d{6}Z?$"), timed)

    lists = F.array_join(F.transform(F.split(plain("CATEGORIES"), r"\s*,\s*"), lambda c: F.trim(c)), ", ")
    return each.select(
        key, "idx", F.sha2(F.coalesce(plain("UID"), F.col("body")), 256).alias("node_hash"), plain("UID").alias("external_source_id"), plain("SUMMARY").alias("title"), plain("DESCRIPTION").alias("description"), plain("URL").alias("canonical_url"),
        moment("DTSTART").alias("start_datetime"), moment("DTEND").alias("end_datetime"), F.trim(line("DTSTART", 2)).rlike(r"^\d{8}$").alias("all_day"), plain("LOCATION").alias("venue"), F.nullif(lists, F.lit("")).alias("source_category"),
        (F.upper(F.coalesce(plain("STATUS"), F.lit(""))) == "CANCELLED").alias("cancelled"), *(plain(n).alias(n.lower().replace("-", "_")) for n in ("RRULE", "RDATE", "EXDATE", "RECURRENCE-ID")),
    )


def feed(df: DataFrame, key: str, text: str, start_element: str | None = None, end_element: str | None = None) -> DataFrame:
    """Items of an RSS or Atom text, by element name without prefix.  No entity of the text is resolved but the five of XML.

    The date of an entry's publication is never its event's: only a configured element is.
    """
    raw = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?s)<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\])?>", "")
    items = F.regexp_extract_all(raw, F.lit(r"(?s)<(?:\w+:)?(?:item|entry)\b[^>]*>(.*?)</(?:\w+:)?(?:item|entry)\s*>"), 1)
    each = df.where(raw.rlike(r"(?s)<(?:\w+:)?(?:rss|feed|RDF)\b.*</(?:\w+:)?(?:rss|feed|RDF)\s*>\s*$")).select(key, F.posexplode(items).alias("idx", "body"))

    def decoded(x: Column) -> Column:
        held = F.when(x.rlike(r"(?s)^\s*<!\[CDATA\["), F.regexp_extract(x, r"(?s)<!\[CDATA\[(.*?)\]\]>", 1))
        out = x
        for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
            out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
        return F.nullif(F.regexp_replace(F.coalesce(held, out), r"(?U)^\s+|\s+$", ""), F.lit(""))

    def child(names: tuple[str, ...]) -> Column:
        # The first of the named elements that holds text.
        found = F.regexp_extract_all("body", F.lit(rf"(?s)<(?:\w+:)?(?:{'|'.join(map(re.escape, names))})(?:\s[^>]*)?(?<!/)>(\s*<!\[CDATA\[.*?\]\]>|[^<]*)"), 1)
        return F.get(F.filter(F.transform(found, decoded), lambda t: t.isNotNull()), 0)

    links = F.regexp_extract_all("body", F.lit(r"(?s)<(?:\w+:)?link\b([^>]*)>"), 1)
    href = lambda a: F.nullif(F.regexp_extract(a, r"""href\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    main = F.get(F.filter(links, lambda a: href(a).isNotNull() & (~a.rlike(r"\brel\s*=") | a.rlike(r"""\brel\s*=\s*["']alternate["']"""))), 0)
    any_link = F.get(F.filter(links, lambda a: href(a).isNotNull()), 0)
    link = F.coalesce(child(("link",)), decoded(href(main)), decoded(href(any_link)))
    dated = lambda e: child((e,)) if e else F.lit(None).cast("string")
    fields = {n: child(names) for n, names in FEED.items()}
    out = each.select(key, "idx", *(c.alias(n) for n, c in fields.items()), link.alias("canonical_url"), dated(start_element).alias("start_datetime"), dated(end_element).alias("end_datetime"))
    return out.withColumn("node_hash", F.sha2(F.coalesce("external_source_id", "canonical_url", F.col("idx").cast("string")), 256))


def page_metadata(df: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """key, site_name, title, n_links and n_text of a page: og:site_name, else the last segment of the title, else the host."""
    from tidemill.functions.text import html_text
    from tidemill.functions.urls import host_label

    h = F.coalesce(F.col(html), F.lit(""))
    title = html_text(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title", 1))
    site = F.nullif(F.trim(F.regexp_extract(h, r"""(?is)<meta[^>]*property\s*=\s*["']og:site_name["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)), F.lit(""))
    cut = F.when(title.rlike(r"\s[|–—-]\s"), F.trim(F.element_at(F.split(title, r"\s[|–—-]\s"), -1)))
    links = F.size(F.regexp_extract_all(h, F.lit(r"(?i)<a\b[^>]*href"), 0))
    return df.select(key, F.coalesce(site, cut, host_label(F.col(url))).alias("site_name"), title.alias("title"), links.alias("n_links"), F.length(F.coalesce(html_text(h), F.lit(""))).alias("n_text"))
