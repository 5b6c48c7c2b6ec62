"""What kind of source a fetched document is: detectors as scores, the winner, and decisions on it.

A document has url, status, content_type, headers (link) and body.  Detectors are sums of
evidence in SQL functions over the body; none runs a script of the page.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.dates import looks_dated
from tidemill.functions.text import html_text, json_key
from tidemill.functions.trees import keys
from tidemill.functions.urls import is_telemetry, path, registrable_domain
from tidemill.operators.discovery import record_array
from tidemill.operators.relational import reasons
from tidemill.sources.records import kind_of

# Signs of pages that refuse, of pages that scripts fill, and the order that settles ties.
CHALLENGES = ("cloudflare", "access denied", "are you a robot", "captcha")
SCRIPTED = ("__NEXT_DATA__", 'id="__nuxt"', "ng-version", "data-reactroot")
RELIABILITY = ("the_events_calendar", "livewhale_json", "simpleview_events", "wordpress_rest", "json_ld_event", "next_data", "nuxt_payload", "embedded_json", "ics_calendar", "rss_atom_events", "algolia_search", "generic_html_cards")
LEAST_CONFIDENCE = 0.6
EVENT_RATE = 0.7
# Field names by meaning, and what each adds to a response's score.
FIELD_GROUPS: dict[str, tuple[float, tuple[str, ...]]] = {
    "title": (0.12, ("title", "name", "eventname", "headline", "label", "summary")),
    "date": (0.12, ("startdate", "start", "startdatetime", "begindate", "date", "dates", "eventdate", "datetime", "starttime", "startdateutc")),
    "url": (0.06, ("url", "link", "detailurl", "permalink", "canonicalurl", "href", "eventurl", "slug")),
    "id": (0.06, ("id", "eventid", "uid", "objectid", "guid", "recordid")),
    "venue": (0.05, ("venue", "location", "place", "locationname", "venuename", "address", "venueid")),
    "category": (0.03, ("category", "categories", "type", "eventtype", "tags", "genre")),
    "image": (0.03, ("image", "imageurl", "photo", "thumbnail", "media", "img")),
    "enddate": (0.02, ("enddate", "end", "enddatetime", "finishdate")),
}
EVENT_TERMS = ("event", "calendar", "listing", "occurrence", "happening", "whatson")
SUMMARY_TERMS = ("aggregate", "facet", "count", "summary", "filter", "meta")
# Parts of host names and of paths that measure visitors.
TELEMETRY_HOSTS = ("analytics", "telemetry", "tracking", "tracker", "pixel", "beacon", "metrics", "adservice", "doubleclick", "pagead", "adserver", "stats.")
TELEMETRY_PATHS = ("/collect", "/g/collect", "/pixel", "/beacon", "/track", "/telemetry", "/analytics", "/pagead", "/metrics", "/gtm", "/gtag", "/ingest", "/b/ss", "/i/adsct", "/tr", "/log", "/event/track", "/rum")
COUNT_KEYS = ("total", "totalcount", "count", "numfound", "nbhits", "totalresults", "pagecount", "pages")


def _any(x: Column, marks: Sequence[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(x, F.lit(m))
    return out


def blocked_reason(status: Column, body: Column) -> Column:
    """Why a fetch is of no use: http_403 or http_429, or the first sign of a challenge in its beginning; null if it is fine."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 2000))
    out = F.when(status.isin(403, 429), F.concat(F.lit("http_"), status.cast("string")))
    for m in CHALLENGES:
        out = out.when(F.contains(head, F.lit(m)), m)
    return out


def content_type_allowed(content_type: Column, allowed: Sequence[str]) -> Column:
    """Whether a type, without parameters and in any case, is allowed; a missing one is."""
    return F.coalesce(F.lower(F.trim(F.substring_index(content_type, ";", 1))).isin(*[a.lower() for a in allowed]), F.lit(True))


def capped(body: Column, most: int) -> Column:
    """struct(body, truncated): the first characters of a body."""
    return F.struct(F.substring(body, 1, most).alias("body"), F.coalesce(F.length(body) > most, F.lit(False)).alias("truncated"))


def browser_required(body: Column) -> Column:
    """Whether a page shows little without scripts: a framework's mark, or much script and hardly any text."""
    text = F.coalesce(html_text(body), F.lit(""))
    scripts = F.aggregate(F.regexp_extract_all(body, F.lit(r"(?is)<script\b[^>]*>(.*?)</script"), 1), F.lit(0), lambda acc, s: acc + F.length(s))
    return _any(body, SCRIPTED) | ((F.length(text) < 200) & (scripts > 2000))


def _hits(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def _event_like(node: Column) -> Column:
    """Whether an object has a field for a title and one for a date."""
    keys = F.transform(F.map_keys(F.coalesce(F.try_variant_get(node, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))), json_key)
    has = lambda g: F.arrays_overlap(keys, F.array(*map(F.lit, FIELD_GROUPS[g][1])))
    return has("title") & has("date")


def _list_rate(doc: Column, roots: Sequence[str]) -> Column:
    """Best share of event-like objects in an array at one of the paths; 0 without one."""
    rates = []
    for r in roots:
        nodes = F.when(kind_of(doc, r) == "ARRAY", F.try_variant_get(doc, "$" + (f".{r}" if r else ""), "array<variant>"))
        objects = F.filter(nodes, lambda n: F.schema_of_variant(n).startswith("OBJECT"))
        rates.append(F.coalesce(F.size(F.filter(objects, _event_like)) / F.nullif(F.size(nodes), F.lit(0)), F.lit(0.0)))
    return F.greatest(*rates) if len(rates) > 1 else rates[0]


ROOTS = ("", "events", "items", "data.events", "props.pageProps.events", "results", "data")


def confidences(body: Column, content_type: Column | None = None, link_header: Column | None = None) -> dict[str, Column]:
    """Confidence of each detector between 0 (no match) and 1."""
    b = F.coalesce(body, F.lit(""))
    low, doc = F.lower(b), F.try_parse_json(b)
    add = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    generator = b.rlike(r"(?is)<meta[^>]*name\s*=\s*[\"']generator[\"'][^>]*content\s*=\s*[\"'][^\"']*wordpress")
    api_link = b.rlike(r"(?is)<link[^>]*rel\s*=\s*[\"']https://api\.w\.org/[\"'][^>]*href")
    header = F.coalesce(link_header, F.lit("")) if link_header is not None else F.lit("")
    scripts = b.rlike(r"(?is)<script[^>]*src\s*=\s*[\"'][^\"']*wp-(?:content|includes)")
    posts = add(generator, 0.4) + add(api_link, 0.4) + add(_any(header, ("wp-json", "api.w.org")), 0.2)
    posts = F.least(F.lit(1.0), posts + add(scripts, 0.1))
    assets = b.rlike(r"(?is)<(?:script|link)[^>]*(?:src|href)\s*=\s*[\"'][^\"']*(?:the-events-calendar|tribe-events|tribe-common)")
    classes = b.rlike(r"(?is)class\s*=\s*[\"'][^\"']*(?:tribe-events|tribe-common)")
    route = b.rlike(r"(?i)tribe/events/v\d+")
    calendar = F.when(assets | classes | route, F.least(F.lit(0.95), add(generator, 0.05) + add(api_link, 0.1) + add(assets, 0.5) + add(classes, 0.2) + add(route, 0.4)))
    first = F.slice(F.coalesce(F.when(kind_of(doc, "events") == "ARRAY", F.try_variant_get(doc, "$.events", "array<variant>")), F.when(kind_of(doc) == "ARRAY", F.try_variant_get(doc, "$", "array<variant>"))), 1, 5)
    seconds = lambda n: F.try_variant_get(n, "$.date_ts", "variant").isNotNull() & (F.try_variant_get(n, "$.id", "variant").isNotNull() | F.try_variant_get(n, "$.occur_id", "variant").isNotNull())
    feed_assets = b.rlike(r"(?is)<(?:script|link)[^>]*(?:src|href)\s*=\s*[\"'][^\"']*(?:livewhale|lwcms|lw[-_]calendar)")
    feed_route = b.rlike(r"(?i)calendar/api/\d+/events|lwapi")
    offset = F.when((F.size(first) > 0) & F.forall(first, seconds), 0.9).when(feed_assets | feed_route, add(b.rlike(r"(?is)<meta[^>]*generator[^>]*livewhale"), 0.15) + add(feed_assets, 0.5) + add(feed_route, 0.4))
    docs = F.filter(F.slice(F.coalesce(F.when(kind_of(doc, "docs.docs") == "ARRAY", F.try_variant_get(doc, "$.docs.docs", "array<variant>")), F.when(kind_of(doc, "docs") == "ARRAY", F.try_variant_get(doc, "$.docs", "array<variant>"))), 1, 5), lambda n: F.schema_of_variant(n).startswith("OBJECT"))
    given = lambda n, *ks: F.coalesce(*(F.nullif(F.trim(F.try_variant_get(n, f"$.{k}", "string")), F.lit("")) for k in ks)).isNotNull()
    good = F.size(F.filter(docs, lambda n: given(n, "recid", "_id", "id") & given(n, "startDate", "date", "endDate") & given(n, "title")))
    nested = F.when((good > 0) & (good >= F.floor((F.size(docs) + 1) / 2)), F.round(F.least(F.lit(0.92), 0.7 + 0.05 * good), 4))
    linked = F.regexp_extract_all(b, F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script"), 1)
    events = F.aggregate(F.filter(linked, lambda s: F.try_parse_json(s).isNotNull()), F.lit(0), lambda acc, s: acc + F.regexp_count(s, F.lit(r"(?i)\"@type\"\s*:\s*(?:\[[^\]]*)?\"[^\"]*event")))
    json_ld = F.when(events > 0, F.least(F.lit(0.95), 0.75 + 0.05 * F.least(events, F.lit(4))))
    script = lambda mark: F.try_parse_json(F.nullif(F.regexp_extract(b, rf"(?is)<script\b[^>]*{mark}[^>]*>(.*?)</script", 1), F.lit("")))
    rated = lambda d: F.when(_list_rate(d, ROOTS) >= EVENT_RATE, F.least(F.lit(0.9), 0.6 + 0.3 * _list_rate(d, ROOTS)))
    ics = F.when((_any(F.lower(F.substring(b, 1, 2000)), ("begin:vcalendar",)) | (F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/calendar")) if content_type is not None else F.lit(False))) & F.contains(low, F.lit("begin:vevent")), 0.9)
    head = F.lower(F.substring(b, 1, 4000))
    is_feed = _any(head, ("<rss", "<rdf:rdf")) | (F.contains(head, F.lit("<feed")) & F.contains(head, F.lit("atom")))
    rss = F.when(is_feed & ((_hits(low, "<item") + _hits(low, "<entry")) > 0), 0.72)
    hits = F.when((kind_of(doc, "hits") == "ARRAY") & (kind_of(doc, "nbHits").isNotNull() | kind_of(doc, "nbPages").isNotNull()), 0.85)
    return {
        "the_events_calendar": calendar, "livewhale_json": offset, "simpleview_events": nested, "wordpress_rest": F.when(posts > 0, F.least(F.lit(0.9), posts)), "json_ld_event": json_ld,
        "next_data": rated(script(r"id\s*=\s*[\"']__NEXT_DATA__[\"']")), "nuxt_payload": rated(script(r"id\s*=\s*[\"']__NUXT_DATA__[\"']")), "embedded_json": rated(script(r"type\s*=\s*[\"']application/json[\"']")),
        "ics_calendar": ics, "rss_atom_events": rss, "algolia_search": hits,
    }


def html_groups(df: DataFrame, key: str, body: str, least: int = 3) -> DataFrame:
    """Repeated elements of a page by name and sorted classes: key, element, classes, n, n_links, n_dates and score.

    An element reaches to the next of its kind; its score is the least of the three counts.
    """
    opened = F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(r"(?is)(<[a-z][a-z0-9]*\b[^>]*\bclass\s*=\s*[\"'][^\"']+[\"'][^>]*>[^<]*(?:<(?![a-z][a-z0-9]*\b[^>]*\bclass\s*=)[^>]*>[^<]*)*)"), 1)
    each = df.select(key, F.explode(opened).alias("part"))
    name = F.lower(F.regexp_extract("part", r"^<([a-zA-Z][a-zA-Z0-9]*)", 1))
    classes = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_extract("part", r"(?is)^<[^>]*\bclass\s*=\s*[\"']([^\"']+)", 1), r"\s+"), lambda c: c != ""))), ".")
    counted = each.groupBy(key, name.alias("element"), classes.alias("classes")).agg(F.count("*").alias("n"), F.count_if(F.col("part").rlike(r"(?i)<a\b[^>]*href")).alias("n_links"), F.count_if(F.col("part").rlike(r"(?i)<time\b") | looks_dated(html_text(F.col("part")))).alias("n_dates"))
    return counted.where(F.col("n") >= least).withColumn("score", F.least("n", "n_links", "n_dates"))


def detect(df: DataFrame, key: str, body: str, status: str | None = None, content_type: str | None = None, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """One row for each document: pattern, confidence, needs_review, browser_required and blocked.

    The most confident detector wins, ties by ``RELIABILITY``; a winner below ``least`` is
    kept as evidence (``best``) but is no pattern.  Cards of a page come from ``html_groups``.
    """
    cards = html_groups(df, key, body).where("score >= 3").groupBy(key).agg(F.max("score").alias("__score"))
    found = confidences(F.col(body), F.col(content_type) if content_type else None)
    found["generic_html_cards"] = F.when(F.col("__score").isNotNull(), F.least(F.lit(0.85), 0.5 + 0.05 * F.col("__score")))
    blocked = blocked_reason(F.col(status) if status else F.lit(200), F.col(body))
    rows = df.select(key, body, *[c for c in (status, content_type) if c]).join(cards, key, "left")
    ranked = F.array(*(F.when(c.isNotNull() & blocked.isNull(), F.struct((-c).alias("c"), F.lit(RELIABILITY.index(n)).alias("r"), F.lit(n).alias("n"))) for n, c in found.items()))
    best = F.array_min(F.array_compact(ranked))
    out = rows.select(key, best.alias("b"), blocked.alias("blocked"), browser_required(F.coalesce(F.col(body), F.lit(""))).alias("__js"))
    confidence = F.coalesce(-F.col("b.c"), F.lit(0.0))
    return out.select(key, F.when(confidence >= least, F.col("b.n")).alias("pattern"), F.round(confidence, 4).alias("confidence"), F.col("b.n").alias("best"), (confidence < least).alias("needs_review"), (F.col("b").isNull() & F.col("__js")).alias("browser_required"), "blocked")


def report(df: DataFrame, key: str) -> DataFrame:
    """Rows for sources without a pattern, with a fingerprint of what stood in the way."""
    why = F.when(F.col("blocked").isNotNull(), "blocked").when(F.col("browser_required"), "browser_required").when(F.col("best").isNotNull(), "low_confidence").otherwise("unsupported")
    return df.where(F.col("pattern").isNull()).select(key, why.alias("reason"), F.sha2(F.concat_ws("|", F.col(key).cast("string"), why, F.coalesce("blocked", F.lit("")), F.coalesce("best", F.lit(""))), 256).alias("fingerprint"))


def response_score(df: DataFrame, key: str, url: str, body: str, listing: str, telemetry: Sequence[str] = (), threshold: float = 0.45) -> DataFrame:
    """Observed JSON responses as classes: third_party_telemetry, third_party_functional, first_party_event_candidate or first_party_other, with score and root.

    The root is the array of records, wherever it stands in objects, with most field groups, then
    most records, then the first; keys of its first 25 records count, one level of inner objects
    included.  Each body is parsed once.
    """
    p = F.lower(path(F.col(url)))
    parsed = df.select(key, url, listing, F.try_parse_json(F.col(body)).alias("doc"), p.alias("p"), (F.col(body).isNull() | F.trim(F.col(body)).isin("", "{}", "[]", "null")).alias("empty"))
    top = F.transform(keys(F.col("doc")), json_key)
    rows = parsed.select(key, url, listing, "p", "empty", record_array(F.col("doc"), {g: names for g, (_, names) in FIELD_GROUPS.items()}).alias("best"), F.arrays_overlap(top, F.array(*map(F.lit, COUNT_KEYS))).alias("counted"))
    weight = sum((F.when(F.array_contains("best.present", g), w).otherwise(0.0) for g, (w, _) in FIELD_GROUPS.items()), F.lit(0.0))
    own = F.coalesce(registrable_domain(F.col(url)) == registrable_domain(F.col(listing)), F.lit(False))
    add = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    score = F.lit(0.25) + add(_any(F.col("p"), EVENT_TERMS), 0.1) + F.when(F.col("best.size") >= 2, 0.15).when(F.col("best.size") == 1, 0.05).otherwise(0.0) + F.coalesce(weight, F.lit(0.0)) + add(F.col("counted"), 0.05)
    score = score - add(_any(F.col("p"), SUMMARY_TERMS) & (F.coalesce("best.hits", F.lit(-1)) < 3), 0.15) - add(F.col("empty"), 0.3)
    score = F.when(own, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)).otherwise(0.0)
    tracked = is_telemetry(F.col(url), telemetry, TELEMETRY_HOSTS, TELEMETRY_PATHS)
    kind = F.when(tracked, "third_party_telemetry").when(~own, "third_party_functional").when(score >= threshold, "first_party_event_candidate").otherwise("first_party_other")
    return rows.select(key, kind.alias("kind"), F.when(tracked, 0.0).otherwise(score).alias("score"), F.when(own & ~tracked, F.col("best.path")).alias("root"))


def at_least(limits: Mapping[str, float], at_most: Mapping[str, float] = {}) -> dict[str, Column]:
    """Checks of measures against limits, for ``reasons``: a missing measure fails."""
    low = {f"{n} below {v:g}": F.coalesce(F.col(n) < v, F.lit(True)) for n, v in limits.items()}
    return low | {f"{n} above {v:g}": F.coalesce(F.col(n) > v, F.lit(True)) for n, v in at_most.items()}


def decide(df: DataFrame, key: str, limits: Mapping[str, float], at_most: Mapping[str, float] = {}, flags: Mapping[str, Column] = {}, policy: str = "policy_active", approve: str = "approval_enabled") -> DataFrame:
    """key, decision and the reasons that failed, for rows of a source's profile joined with its policy.

    No policy (null) and a policy that is off decide at once; otherwise every check is made,
    and approval is allowed only if none fails and the policy approves at all.
    """
    failed = reasons({**flags, **at_least(limits, at_most), "approval disabled": ~F.coalesce(F.col(approve), F.lit(False))})
    open_ = F.coalesce(F.col(policy), F.lit(False))
    decision = F.when(F.col(policy).isNull(), "no_applicable_policy").when(~open_, "policy_disabled").when(F.size(failed) == 0, "automatic_approval_allowed").otherwise("automatic_approval_denied")
    return df.select(key, decision.alias("decision"), F.when(open_, failed).otherwise(F.array().cast("array<string>")).alias("failed"))


def schedule_reasons(status: Column, is_active: Column, archived_at: Column, city_active: Column, approved: Column, schedule_enabled: Column) -> Column:
    """All reasons why a source is not to be scheduled; none means it is."""
    return reasons({
        "not onboarded": F.coalesce(status != "active", F.lit(True)), "not active": ~F.coalesce(is_active, F.lit(False)), "archived": archived_at.isNotNull(), "no city": city_active.isNull(), "city not active": city_active == F.lit(False),
        "no approved configuration": ~F.coalesce(approved, F.lit(False)), "no schedule": schedule_enabled.isNull(), "schedule disabled": schedule_enabled == F.lit(False),
    })
