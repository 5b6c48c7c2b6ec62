"""Fields inferred from cards of pages made by hand."""

from __future__ import annotations

from tidemill.operators import fields as I
from tidemill.operators import structure as S


def card(i, extra=""):
    return f"""<div class="event-card"><img class="event-thumb" src="/img/{i}.jpg"><h3 class="event-title"><a href="/e/{i}">Concert number {i}</a></h3>
<time class="event-date" datetime="2026-05-{i:02d}">May {i}, 2026</time><span class="event-venue">Hall {i % 2}</span><span class="x9f8e7d6c">noise</span><a class="share" href="/share">Share</a>{extra}</div>"""


def inferred(spark, *pages):
    df = spark.createDataFrame([(i, p, "http://s.example/list") for i, p in enumerate(pages)], "k int, h string, u string")
    groups = S.sibling_groups(df, "k", "h").where("classes = 'event-card'").select("k", "parent", "tag", "classes")
    rows = I.inferred_fields(df, "k", "h", groups, "u", dates=["%B %d, %Y"]).collect()
    return {(r["k"], r["role"]): r for r in rows}


def test_roles_of_cards(spark):
    page = "<main>" + "".join(card(i) for i in range(1, 7)) + "</main>"
    got = inferred(spark, page, "", None, "<p>no cards</p>")
    best = {role: (r["selector"], r["attribute"], r["accepted"]) for (k, role), r in got.items() if k == 0}
    assert best["title"] == ("h3.event-title", None, True)
    assert best["start_datetime"] == ("time.event-date", "datetime", True)
    assert best["venue"] == ("span.event-venue", None, True)
    assert best["image"] == ("img.event-thumb", "src", True)
    assert best["canonical_url"] == ("h3.event-title > a", "href", True) and {k for k, _ in got} == {0}
    assert 0 < got[0, "title"]["confidence"] <= 1 and got[0, "start_datetime"]["parse"] == 1.0
    assert "time.event-date" in got[0, "start_datetime"]["alternatives"]


def test_gates(spark):
    """A constant title, a rare field and an unstable class name are no fields."""
    same = "<main>" + "".join(card(i).replace(f"Concert number {i}", "Same").replace(f"/e/{i}", "/same") for i in range(1, 7)) + "</main>"
    rare = "<main>" + "".join(card(i, '<p class="summary">a long enough summary of it</p>' if i == 1 else "") for i in range(1, 7)) + "</main>"
    got = inferred(spark, same, rare)
    assert (0, "title") not in got and (1, "description") not in got
    assert not any("x9f8e7d6c" in r["selector"] for r in got.values())
