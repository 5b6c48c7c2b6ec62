"""Structure and cleaning of markup that is broken, hostile or odd."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemill.functions.markup import attribute, elements, tags
from tidemill.functions.sanitise import decoded, sanitised
from tidemill.functions.text import html_text
from tidemill.operators import structure as S


def one(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


SAFE = [
    ('<p onclick="x()">Hi <b>there</p>', "<p>Hi <b>there</b></p>"),
    ('<a href="java&#115;cript:alert(1)">x</a>', "<a>x</a>"),
    ('<a href=" jav\tascript:alert(1)" title=\'a "q"\'>x</a>', '<a title="a &quot;q&quot;">x</a>'),
    ('<a href="JaVa&#x73;cript&colon;x">y</a>', "<a>y</a>"),
    ('<a href="&amp;#106;avascript:x">g</a>', "<a>g</a>"),
    ('<a href="\x01javascript:x">g</a>', "<a>g</a>"),
    ("<a href=data:text/html,x>d</a>", "<a>d</a>"),
    ('<a/href="vbscript:x">e</a>', "<a>e</a>"),
    ('<a href="http://x/?a=1&amp;b=2">k</a>', '<a href="http://x/?a=1&amp;b=2">k</a>'),
    ("<script>alert(1)", None),
    ("<form><p>in</p></form>out", "out"),
    ("<iframe src=x><p>a</iframe>b", "b"),
    ("<scr<script>ipt>alert(1)</script>", "&lt;scr"),
    ("a < b and c > d", "a &lt; b and c > d"),
    ('<p title="a>b">t</p>', '<p title="a>b">t</p>'),
    ("<p title='x' onmouseover='y(\"z\")'>t</p>", '<p title="x">t</p>'),
    ("<svg/onload=alert(1)>s", "s"),
    ("<<p>x", "&lt;<p>x</p>"),
    ("<ul><li>a<li>b</ul>c", "<ul><li>a<li>b</li></li></ul>c"),
    ("</p>only an end", "only an end"),
    ("<b>un", "<b>un</b>"),
    (" plain ", "plain"),
    (" ", None),
    (None, None),
]


def test_sanitised(spark):
    assert one(spark, sanitised, *(a for a, _ in SAFE)) == [b for _, b in SAFE]


def test_cleaning_twice_changes_nothing(spark):
    once = one(spark, sanitised, *(a for a, _ in SAFE))
    assert one(spark, sanitised, *once) == once


def test_references(spark):
    got = one(spark, decoded, "a &amp;amp; b", "&#65;&#x42;&#x1F600;", "&bogus; & &#xD800; &#99999999;", "&lt", "x&copy;y", None, "")
    assert got == ["a &amp; b", "AB\U0001f600", "&bogus; & � �", "&lt", "x©y", None, ""]


def test_text_of_markup(spark):
    got = one(spark, html_text, '<p title="a>b">t</p><script>x</script><!-- c -->u&nbsp;&eacute;', "<script>never closed", "a < b", "<style>p{}</style> ", None)
    assert got == ["t u é", None, "a < b", None, None]


def test_elements(spark):
    page = "<ul><li>a<li>b<br><p>c<p>d</ul><div class='x'><p>e<div>f</div></div></span><table><tr><td>1<td>2<tr><th>3</table><a/>g"
    df = spark.createDataFrame([(page,), (None,), ("no tags",), ("<b",)], "v string")
    rows = df.select(F.transform(elements(tags(F.col("v"))), lambda e: F.struct(e["id"], e["parent"], e["depth"], e["tag"], e["last"]))).collect()
    assert [tuple(e) for e in rows[0][0]] == [
        (1, 0, 1, "ul", 6), (2, 1, 2, "li", 2), (3, 1, 2, "li", 6), (4, 3, 3, "br", 4), (5, 3, 3, "p", 5), (6, 3, 3, "p", 6), (7, 0, 1, "div", 9), (8, 7, 2, "p", 8), (9, 7, 2, "div", 9),
        (10, 0, 1, "table", 15), (11, 10, 2, "tr", 13), (12, 11, 3, "td", 12), (13, 11, 3, "td", 13), (14, 10, 2, "tr", 15), (15, 14, 3, "th", 15), (16, 0, 1, "a", 16),
    ]
    assert [r[0] for r in rows[1:]] == [[], [], []]


def test_sibling_groups(spark):
    card = '<div class="b card"><a href="/x">t</a><time>May 5</time></div>'
    page = f"<section>{card}{card}<div class='card b'><a href=x>u</a></div><div class=other>v</div></section>"
    (r,) = S.sibling_groups(spark.createDataFrame([(1, page), (2, ""), (3, None)], "k int, h string"), "k", "h").collect()
    assert (r["k"], r["tag"], r["classes"], r["depth"], r["n"], r["n_shapes"], r["same_shape"], r["n_links"], r["n_dates"], r["score"]) == (1, "div", "b.card", 2, 3, 2, 0.666667, 3, 2, 2)


@pytest.mark.parametrize("source,value", [('<a href="x y">', "x y"), ("<a data-href=n href=z>", "z"), ("<a title='href=q'>", None), ("<a HREF = 'k'>", "k"), ("<a>", None)])
def test_attributes(spark, source, value):
    assert one(spark, lambda c: attribute(c, "href"), source) == [value]
