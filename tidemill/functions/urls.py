"""URL functions as Column -> Column expressions.

URLs are split by one pattern into scheme, authority, path, query and fragment; hosts
leave out user names and ports.  Hosts beyond ASCII are compared as they are.
"""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import let, trimmed

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = (
    "co.uk org.uk gov.uk ac.uk me.uk ltd.uk plc.uk com.au net.au org.au gov.au edu.au co.nz org.nz co.za co.jp or.jp com.br com.mx com.ar "
    "co.in net.in org.in co.kr com.cn com.sg com.hk co.il com.tr com.tw com.ua co.id com.ph com.my"
).split()

# Hosts and endings that are never public.
BLOCKED_HOSTS = ("localhost", "metadata.google.internal")
BLOCKED_ENDINGS = (".localhost", ".local", ".internal")


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(trimmed(url), _URL, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host, without user and port; empty without one."""
    named = F.regexp_replace(_part(url, 2), r"^.*@", "")
    return F.lower(F.when(named.startswith("["), F.regexp_extract(named, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(named, r":.*$", "")))


def port(url: Column) -> Column:
    """Port number or null."""
    return F.regexp_extract(_part(url, 2), r":([0-9]+)$", 1).try_cast("int")


def path(url: Column) -> Column:
    return _part(url, 3)


def _decoded(x: Column) -> Column:
    return F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def sorted_query(query: Column) -> Column:
    """key=value pairs of a query string in order, blank values kept, re-encoded alike."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), _decoded(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def _parsed(url: Column) -> Column:
    """struct(scheme, authority, host, port, path, query) of a URL."""
    place = lambda t: F.struct(t.alias("t"), F.regexp_extract(t, _URL, 2).alias("authority"))
    described = lambda p: F.struct(
        F.lower(F.regexp_extract(p["t"], _URL, 1)).alias("scheme"), p["authority"].alias("authority"), _host_of(p["authority"]).alias("host"), F.regexp_extract(p["authority"], r":([0-9]+)$", 1).try_cast("int").alias("port"),
        F.regexp_extract(p["t"], _URL, 3).alias("path"), F.regexp_extract(p["t"], _URL, 4).alias("query"),
    )
    return let(let(trimmed(url), place), described)


def _host_of(authority: Column) -> Column:
    named = F.regexp_replace(authority, r"^.*@", "")
    return F.lower(F.when(F.contains(named, F.lit("[")) & named.startswith("["), F.regexp_extract(named, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(named, ":", 1)))


def _bare(p: Column) -> Column:
    return F.when(p["path"].isin("", "/"), "/").otherwise(F.rtrim(p["path"], F.lit("/")))


def _built(p: Column, port: Column, shown: Column, query: bool = True) -> Column:
    place = F.concat(p["host"], F.coalesce(F.concat(F.lit(":"), port.cast("string")), F.lit("")))
    base = F.concat(F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(""), F.when(place != "", F.concat(F.lit("//"), place)).otherwise(""), shown)
    return F.concat(base, F.when(p["query"] != "", let(sorted_query(p["query"]), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))).otherwise("")) if query else base


def normalize_url(url: Column) -> Column:
    """The URL in fingerprints: lower-case scheme and host, every port kept, query sorted, no user, fragment or final slash."""
    value = F.coalesce(url, F.lit(""))
    return F.when(trimmed(value) == "", "").otherwise(let(_parsed(value), lambda p: _built(p, F.nullif(p["port"], F.lit(0)), _bare(p))))


def _canonical(p: Column, query: bool = True) -> Column:
    default = ((p["scheme"] == "http") & (p["port"] == 80)) | ((p["scheme"] == "https") & (p["port"] == 443))
    shown = F.when(_bare(p) == "", "/").otherwise(_bare(p)) if query else F.lit("/")
    return F.when(p["host"] == "", "").otherwise(_built(p, F.when(~default, p["port"]), shown, query))


def canonical_url(url: Column) -> Column:
    """The URL that tells sources apart: as normalize_url without default ports; empty without a host, which equals nothing."""
    return let(_parsed(F.coalesce(url, F.lit(""))), lambda p: _canonical(p))


def canonical_origin(url: Column) -> Column:
    """canonical_url with the path / and no query; empty if that is empty."""
    return let(_parsed(F.coalesce(url, F.lit(""))), lambda p: _canonical(p, False))


def is_origin_only(url: Column) -> Column:
    """Whether a URL with a host has no path; a query does not count."""
    return let(_parsed(F.coalesce(url, F.lit(""))), lambda p: (p["host"] != "") & (_bare(p).isin("", "/")))


def same_resource(a: Column, b: Column) -> Column:
    return let(F.struct(canonical_url(a).alias("x"), canonical_url(b).alias("y")), lambda p: (p["x"] != "") & (p["x"] == p["y"]))


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def with_param(url: Column, name: str, value: Column) -> Column:
    """The URL with one query parameter replaced, or added at the end."""
    key = F.lit(f"{name}=")
    base, mark = F.regexp_replace(url, r"#.*$", ""), rf"([?&]){name}=[^&#]*"
    added = F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), key, value.cast("string"))
    changed = F.concat(F.regexp_extract(base, rf"^(.*?[?&]){name}=[^&#]*", 1), key, value.cast("string"), F.regexp_extract(base, rf"^.*?[?&]{name}=[^&#]*(.*)$", 1))
    return F.when(base.rlike(mark), changed).otherwise(added)


def host_label(url: Column) -> Column:
    """A host as a name: without www. and suffix, hyphens as spaces, each word with a capital."""
    labels = F.split(F.regexp_replace(host(url), r"^www\.", ""), r"\.")
    return F.nullif(F.initcap(F.regexp_replace(F.get(labels, F.greatest(F.size(labels) - 2, F.lit(0))), "[-_]+", " ")), F.lit(""))


def registrable_domain(x: Column) -> Column:
    """The last labels of a host that one owner registers; numeric hosts as they are; null without a host."""

    def owned(name: Column, labels: Column) -> Column:
        n = F.size(labels)
        last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")
        numeric = F.replace(name, F.lit("."), F.lit("")).rlike("^[0-9]+$") | F.contains(name, F.lit(":"))
        return F.when(name == "", None).when(numeric | (n <= 2), name).when(last(2).isin(*TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))

    named = let(F.coalesce(trimmed(x), F.lit("")), lambda v: F.rtrim(F.lower(F.when(F.contains(v, F.lit("://")), _host_of(F.regexp_extract(v, _URL, 2))).otherwise(F.substring_index(v, "/", 1))), F.lit(".")))
    return let(named, lambda name: let(F.split(name, r"\."), lambda labels: owned(name, labels)))


def absolute(base: Column, link: Column) -> Column:
    """A link as seen from a page: absolute, scheme-relative, root-relative, query-only, fragment-only or a sibling path, dots resolved one level."""

    def joined(v: Column, b: Column) -> Column:
        origin = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
        page = F.substring_index(F.substring_index(b, "#", 1), "?", 1)
        folder = F.when(F.regexp_extract(b, _URL, 3) == "", F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
        up = F.regexp_replace(F.regexp_replace(folder, r"[^/]+/$", ""), r"^([A-Za-z][A-Za-z0-9+.\-]*://)$", "")
        return (
            F.when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), v)
            .when(v.startswith("//"), F.concat(F.lower(F.regexp_extract(b, _URL, 1)), F.lit(":"), v))
            .when(v.startswith("/"), F.concat(origin, v))
            .when(v.startswith("?"), F.concat(page, v))
            .when(v.startswith("#"), F.concat(F.substring_index(b, "#", 1), v))
            .when(v.startswith("../"), let(up, lambda u: F.concat(F.when(u == "", F.concat(origin, F.lit("/"))).otherwise(u), F.substring(v, 4, 100_000))))
            .otherwise(F.concat(folder, F.regexp_replace(v, r"^(\./)+", "")))
        )

    return let(trimmed(link), lambda v: F.when(v == "", base).otherwise(let(trimmed(base), lambda b: joined(v, b))))


def public_url_problem(url: Column) -> Column:
    """Why a URL is not a safe public address, or null: missing, scheme, credentials, host or address range."""
    return let(_parsed(F.coalesce(url, F.lit(""))), lambda p: _problem(F.coalesce(trimmed(url), F.lit("")), p))


def _problem(v: Column, p: Column) -> Column:
    h, s = p["host"], p["scheme"]
    octets = F.transform(F.split(h, r"\."), lambda p: p.try_cast("bigint"))
    dotted = h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    number = F.when(dotted, F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p)).when(h.rlike("^[0-9]{1,10}$"), h.try_cast("bigint"))
    # First and last number of each IPv4 range that is not public.
    ranges = ((0, 8), (10 << 24, 8), (127 << 24, 8), ((169 << 24) + (254 << 16), 16), ((172 << 24) + (16 << 16), 12), ((192 << 24) + (168 << 16), 16), (192 << 24, 24), ((192 << 24) + (2 << 8), 24), ((198 << 24) + (18 << 16), 15), ((198 << 24) + (51 << 16) + (100 << 8), 24), ((203 << 24) + (113 << 8), 24), (224 << 24, 4), (240 << 24, 4))
    inside = let(number, lambda n: F.exists(F.array(*(F.struct(F.lit(low).cast("bigint").alias("low"), F.lit(low + (1 << (32 - bits)) - 1).cast("bigint").alias("high")) for low, bits in ranges)), lambda r: n.between(r["low"], r["high"])))
    six = F.contains(h, F.lit(":")) & h.rlike(r"^(::1?$|f[cd]|fe[89ab]|ff)")
    ended = F.lit(False)
    for end in BLOCKED_ENDINGS:
        ended = ended | h.endswith(end)
    return (
        F.when(v == "", "missing")
        .when(s == "", "no scheme")
        .when(~s.isin("http", "https"), "scheme")
        .when(F.contains(p["authority"], F.lit("@")), "credentials")
        .when(h == "", "no host")
        .when(h.isin(*BLOCKED_HOSTS) | ended, "host")
        .when(F.coalesce(inside, F.lit(False)) | six, "address")
    )


def is_telemetry(url: Column, domains: Sequence[str], host_marks: Sequence[str] = (), path_marks: Sequence[str] = ()) -> Column:
    """Whether a request is measurement and no content: its domain, a mark in its host, or a whole path segment."""
    hosts = "|".join(re.escape(m) for m in host_marks)
    paths = "|".join(re.escape(m.strip("/")) for m in path_marks)
    out = registrable_domain(url).isin(*domains)
    out = out | host(url).rlike(hosts) if hosts else out
    out = out | path(url).rlike(rf"(?i)(^|/)(?:{paths})(/|$)") if paths else out
    return F.coalesce(out, F.lit(False))
