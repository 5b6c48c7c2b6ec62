"""Text functions as Column -> Column expressions.  Null stays null unless stated."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_INPUT = 10_000  # fixed value: characters of a value that transforms look at
MAX_PATTERN = 200  # fixed value: characters of a configured pattern


# White space, no-break spaces included.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_RUN = r"[\x09-\x0d \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x evaluated once, however often it stands in the result."""
    return F.get(F.transform(F.array(x), use), 0)


def trimmed(x: Column) -> Column:
    """Without white space at both ends, tabs, line ends and no-break spaces included."""
    return F.btrim(x, F.lit(SPACES))


def collapsed(x: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.btrim(F.regexp_replace(x, _SPACE_RUN, " "))


def cleaned(x: Column) -> Column:
    """collapsed, with the empty text as null."""
    return F.nullif(collapsed(x.cast("string")), F.lit(""))


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Letters whose full case folding is not their lower case: to one letter, and to several."""
    one, many = {}, {}
    for c in map(chr, range(sys.maxunicode + 1)):
        low, fold = c.lower(), c.casefold()
        if low != fold and len(low) == 1 and low == c:
            (one if len(fold) == 1 else many)[c] = fold
    return one, many


def casefold(x: Column) -> Column:
    """Full case folding: the sharp s as ss, the final sigma as sigma."""
    one, many = _folds()
    low = F.lower(x)
    whole = F.translate(low, "".join(one), "".join(one.values()))
    for letter, fold in many.items():
        whole = F.replace(whole, F.lit(letter), F.lit(fold))
    # In these ranges only the sharp s folds otherwise than to its lower case.
    return F.when(low.rlike(r"[^\x00-\xb4\xb6-\u0148\u014a-\u017e\u2000-\u20ff]"), whole).otherwise(F.replace(low, F.lit("ß"), F.lit("ss")))


def normalized_title(x: Column) -> Column:
    """The key form of a text: collapsed and case-folded; null is the empty text."""
    return casefold(collapsed(F.coalesce(x, F.lit(""))))


def lower_key(x: Column) -> Column:
    """The looser key of comparisons: collapsed and lower-case, the empty text as null."""
    return F.nullif(F.lower(collapsed(x)), F.lit(""))


def strip_tags(x: Column, by: str = "") -> Column:
    return F.regexp_replace(x, r"<[^>]+>", by)


def html_text(x: Column) -> Column:
    """Visible text of markup: scripts, styles, comments and tags out, character references decoded once, collapsed."""
    from tidemill.functions.sanitise import decoded

    bare = F.regexp_replace(x, r"""(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)|<![^>]*>|</?[a-z](?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+>""", " ")
    return F.nullif(collapsed(decoded(bare)), F.lit(""))


def safe_markup(x: Column) -> Column:
    """Markup without dangerous elements, event attributes and script URLs; null for none."""
    from tidemill.functions.sanitise import sanitised

    return sanitised(x)


def slug(x: Column) -> Column:
    """Lower-case letters and digits, other runs as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), "^-|-$", "")


def without_formula(x: Column) -> Column:
    """A spreadsheet cell without the signs that make it a formula."""
    return F.ltrim(x, F.lit("=+-@" + SPACES))


def name_tokens(x: Column) -> Column:
    """Lower-case parts of an identifier, cut at signs and humps, of two characters at least."""
    humps = F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(humps), r"[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def stable_class(x: Column) -> Column:
    """Whether a class name looks given by a person: 2 to 40 signs, no digit first, no long number and no hash."""
    t = trimmed(x)
    return F.length(t).between(2, 40) & ~t.rlike(r"^\d|\d{3,}") & ~t.rlike(r"(?i)^[a-z]*[0-9a-f]{6,}$")


def json_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def redacted(x: Column, shown: int = 4) -> Column:
    """A token with its first signs only, or none of a short one."""
    return F.when(F.length(x) > 2 * shown, F.concat(F.left(x, F.lit(shown)), F.lit("…"))).when(F.length(x) > 0, "…").otherwise("")


def percent(x: Column) -> Column:
    """A share as whole percent; a missing share as a dash, which is not 0."""
    return F.when(x.isNull(), "—").otherwise(F.concat(F.bround(x * 100).cast("int").cast("string"), F.lit("%")))


def keyword_category(x: Column, words: list[tuple[str, str]]) -> Column:
    """The category of the first keyword, in the given order, that stands anywhere in the text."""
    low, out = F.lower(x), F
    for i, (word, category) in enumerate(words):
        hit = F.contains(low, F.lit(word))
        out = F.when(hit, category) if i == 0 else out.when(hit, category)
    return out.otherwise(None) if words else F.lit(None).cast("string")


def checked_pattern(pattern: str) -> str:
    """The pattern, if it is short and can not run away; otherwise ValueError."""
    if len(pattern) > MAX_PATTERN:
        raise ValueError("pattern too long")
    if "(?" in pattern:
        raise ValueError("extension groups are not allowed")
    if re.search(r"\\[1-9]", pattern):
        raise ValueError("back-references are not allowed")
    if re.search(r"\([^)]*[+*}][^)]*\)[+*{]", pattern):
        raise ValueError("nested quantifiers are not allowed")
    re.compile(pattern)
    return pattern


def extracted(x: Column, pattern: str, group: int = 1) -> Column:
    """One group of the first match of a checked pattern; null without a match."""
    pattern = checked_pattern(pattern)
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by |, null as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def _given(x: Column) -> Column:
    return x.isNotNull() & (x != "")


def event_fingerprint(website: Column, external_id: Column, url: Column, title: Column, day: Column, time: Column, venue: Column, city: Column, scoped: bool = True) -> Column:
    """Identity of an event: source id within a website, else normalised URL, else title, date, time, venue and city."""
    from tidemill.functions.urls import normalize_url

    own = F.coalesce(normalize_url(url), F.lit(""))
    external = _given(external_id) & (website.isNotNull() if scoped else F.lit(True))
    return F.when(external, fingerprint(F.lit("external"), website, trimmed(external_id))).when(own != "", fingerprint(F.lit("url"), own)).otherwise(
        fingerprint(F.lit("composite"), normalized_title(title), day, time, normalized_title(venue), F.nullif(city.cast("string"), F.lit("0")))
    )


def occurrence_identity(parent: Column, source_parent: Column, source_occurrence: Column, recurrence_id: Column, start: Column, most: int = 200) -> Column:
    """Identity of one occurrence: its own id, else parent and recurrence id, else parent and start; long ones hashed."""
    key = F.when(_given(source_occurrence), F.concat_ws("|", F.lit("srcocc"), source_occurrence)).when(_given(source_parent) & _given(recurrence_id), F.concat_ws("|", F.lit("parentrec"), source_parent, recurrence_id)).otherwise(F.concat_ws("|", F.lit("fp"), parent, start.cast("string")))
    return F.when(F.length(key) > most, F.concat(F.lit("h|"), F.sha2(key, 256))).otherwise(key)


def address_key(address: Column, venue: Column) -> Column:
    """The lookup form of a place: address, or venue, lower-case and collapsed; null without either."""
    return F.coalesce(lower_key(address), lower_key(venue))
