"""Markup made safe, and entities decoded: a fold over tags with a stack of open elements, in SQL functions.

Only a few elements stay; dangerous ones go with all that they hold, others leave their content.
Attributes are read one by one: handlers go, and so do addresses whose scheme, once entities are
decoded and white space and control characters are taken out, runs or embeds something.  What
is never closed is closed where its parent ends; a sign < that opens no tag is written as &lt;.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.markup import VOID
from tidemill.functions.text import let, trimmed

# Elements that go with their content, elements that stay, and schemes that are not safe.
DANGEROUS = ("script", "style", "iframe", "frame", "frameset", "form", "object", "embed")
SAFE = ("p", "br", "a", "strong", "em", "b", "i", "ul", "ol", "li")
UNSAFE_SCHEMES = ("javascript:", "data:", "vbscript:", "file:", "blob:")
ADDRESSES = ("href", "src", "xlink:href", "action", "formaction", "background", "poster")
# Named character references.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "colon": ":", "semi": ";", "comma": ",", "period": ".", "excl": "!", "quest": "?", "num": "#", "dollar": "$", "percnt": "%",
    "lpar": "(", "rpar": ")", "ast": "*", "plus": "+", "sol": "/", "bsol": "\\", "equals": "=", "commat": "@", "lowbar": "_", "hyphen": "‐", "tab": "\t", "newline": "\n",
    "copy": "©", "reg": "®", "trade": "™", "deg": "°", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»",
    "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ouml": "ö", "uuml": "ü", "auml": "ä", "szlig": "ß", "ntilde": "ñ", "euro": "€", "pound": "£",
}
_REFERENCE = r"^(#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[a-zA-Z]+;)"
_RAW = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\z)|<![^>]*>"
_TOKEN = r"""(?s)</?[a-zA-Z](?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+>[^<]*+|<[^<]*+|^[^<]++"""
_IS_TAG = r"""(?s)^</?[a-zA-Z](?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+>"""
_ATTRIBUTE = r"""(?s)[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""


def _character(number: Column) -> Column:
    """The character of a code point; the replacement character where there is none."""
    fine = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("�")


def decoded(x: Column) -> Column:
    """A text with its character references decoded once; unknown ones stay."""
    names = F.create_map(*(F.lit(v) for pair in NAMED.items() for v in pair))

    def one(piece: Column) -> Column:
        def told(ref: Column) -> Column:
            name = F.lower(F.rtrim(ref, F.lit(";")))
            number = F.when(name.startswith("#x"), F.conv(F.substring(name, 3, 8), 16, 10).try_cast("bigint")).otherwise(F.substring(name, 2, 10).try_cast("bigint"))
            found = F.when(ref.startswith("#"), _character(number)).otherwise(F.try_element_at(names, name))
            return F.coalesce(F.when(ref != "", F.concat(found, F.substring(piece, F.length(ref) + 1, F.length(piece)))), F.concat(F.lit("&"), piece))

        return let(F.regexp_extract(piece, _REFERENCE, 1), told)

    pieces = F.split(x, "&")
    return F.when(F.contains(x, F.lit("&")), let(pieces, lambda ps: F.concat(F.get(ps, 0), F.array_join(F.transform(F.slice(ps, F.lit(2), F.size(ps)), one), "")))).otherwise(x)


def unsafe_address(value: Column) -> Column:
    """Whether an attribute's value, as written, is an address that runs or embeds something."""
    bare = F.lower(F.regexp_replace(decoded(decoded(value)), r"[\x00-\x20\x7f-\xa0­​-‏  ﻿]", ""))
    return let(bare, lambda b: F.exists(F.array(*map(F.lit, UNSAFE_SCHEMES)), lambda s: b.startswith(s)))


def _attributes(source: Column) -> Column:
    """The attributes of a tag that may stay, each with a space before it, values in double quotes."""
    inside = F.regexp_replace(source, r"(?s)^<[a-zA-Z][^\s/>]*|>[^>]*$", "")
    cut = F.transform(F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: F.struct(F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)).alias("name"), F.regexp_replace(F.regexp_extract(a, r"(?s)=\s*(.*)$", 1), r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2").alias("value")))
    kept = F.filter(cut, lambda a: ~a["name"].startswith("on") & (a["name"] != "srcdoc") & ~(a["name"].isin(*ADDRESSES) & unsafe_address(a["value"])))
    return F.array_join(F.transform(kept, lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), F.replace(F.replace(a["value"], F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;")), F.lit('"'))), "")


def sanitised(x: Column) -> Column:
    """Safe markup of a description; null for none.  A text without tags is only trimmed."""
    every = F.regexp_extract_all(F.regexp_replace(x, _RAW, ""), F.lit(_TOKEN), F.lit(0))
    told = lambda t: F.struct(
        t.rlike(_IS_TAG).alias("is_tag"), F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1)).alias("name"), t.startswith("</").alias("closing"), F.regexp_extract(t, _IS_TAG, 0).alias("tag"), F.regexp_replace(t, _IS_TAG, "").alias("text"),
    )
    begin = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("out"))
    ends = lambda names: F.array_join(F.transform(F.filter(F.reverse(names), lambda n: n.isin(*SAFE)), lambda n: F.concat(F.lit("</"), n, F.lit(">"))), "")

    def step(acc: Column, t: Column) -> Column:
        stack = acc["stack"]
        last = let(F.array_compact(F.transform(stack, lambda n, i: F.when(n == t["name"], i))), lambda p: F.coalesce(F.get(p, F.size(p) - 1), F.size(stack)))
        return let(F.when(t["closing"], last).otherwise(F.size(stack)), lambda kept: after(acc, t, kept))

    def after(acc: Column, t: Column, kept: Column) -> Column:
        stack = acc["stack"]
        left = F.slice(stack, F.lit(1), kept)
        opened = ~t["closing"] & ~t["name"].isin(*VOID, "frame", "embed")
        grown = F.when(~t["is_tag"], stack).when(opened, F.concat(left, F.array(t["name"]))).otherwise(left)
        hidden = lambda names: F.exists(names, lambda n: n.isin(*DANGEROUS))
        shown = F.when(t["name"].isin(*SAFE) & ~t["closing"], F.concat(F.lit("<"), t["name"], _attributes(t["tag"]), F.lit(">"))).otherwise("")
        gone = F.slice(stack, kept + 1, F.size(stack) - kept)
        bad = F.array_compact(F.transform(gone, lambda n, i: F.when(n.isin(*DANGEROUS), i)))
        seen = F.filter(gone, lambda n, i: i < F.coalesce(F.get(bad, 0), F.size(gone)))  # what stood in a dangerous element was never opened
        piece = F.when(~t["is_tag"], F.replace(t["text"], F.lit("<"), F.lit("&lt;"))).otherwise(F.concat(F.when(hidden(left), "").otherwise(F.concat(ends(seen), F.when(hidden(grown), "").otherwise(shown))), F.when(hidden(grown), "").otherwise(t["text"])))
        return F.struct(grown.cast("array<string>").alias("stack"), F.concat(acc["out"], F.array(F.when(~t["is_tag"] & hidden(stack), "").otherwise(piece))).cast("array<string>").alias("out"))

    whole = F.aggregate(F.transform(every, told), begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.when(F.exists(acc["stack"], lambda n: n.isin(*DANGEROUS)), "").otherwise(ends(acc["stack"]))))
    return F.nullif(trimmed(F.when(F.contains(x, F.lit("<")) & F.contains(x, F.lit(">")), whole).otherwise(x)), F.lit(""))
