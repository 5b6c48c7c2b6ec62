"""Structure of all pages of the driver's table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.sanitise import sanitised
from tidemill.functions.text import html_text
from tidemill.operators import structure as S
from tidemill.plans.registry import query
from tidemill.sources.tables import table

_BODY = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<(script|style)>.*?</(script|style)>', ' ', 'g')"
_P = f"p AS (SELECT page_id, unnest(string_split({_BODY}, '<p>')[2:]) AS x FROM pages), c AS (SELECT page_id, contains(x, '<b>') AS b, count(*) AS c FROM p GROUP BY 1, 2)"


@query(f"""WITH {_P}, l AS (SELECT page_id, CAST(len(regexp_extract_all({_BODY}, '<li>')) AS BIGINT) AS n FROM pages)
SELECT page_id, 'li' AS tag, 5 AS depth, n, CAST(1 AS BIGINT) AS n_shapes, 1.0 AS same_shape, n AS n_links FROM l WHERE n >= 3
UNION ALL SELECT page_id, 'p', 4, CAST(sum(c) AS BIGINT), count(*), round(max(c) / sum(c), 6), CAST(0 AS BIGINT) FROM c GROUP BY page_id HAVING sum(c) >= 3""")
def page_sibling_groups(spark, d):
    return S.sibling_groups(table(spark, d, "pages"), "page_id", "html").select("page_id", "tag", "depth", "n", "n_shapes", "same_shape", "n_links")


@query(rf"""WITH b AS (SELECT page_id, {_BODY} AS b FROM pages), t AS (SELECT page_id, lower(unnest(regexp_extract_all(b, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM b)
SELECT page_id, tag, count(*) AS n, CAST(CASE tag WHEN 'html' THEN 1 WHEN 'head' THEN 2 WHEN 'body' THEN 2 WHEN 'meta' THEN 3 WHEN 'title' THEN 3 WHEN 'nav' THEN 3 WHEN 'div' THEN 3 WHEN 'article' THEN 3 WHEN 'footer' THEN 3 WHEN 'ul' THEN 4 WHEN 'h1' THEN 4 WHEN 'p' THEN 4 WHEN 'li' THEN 5 WHEN 'b' THEN 5 WHEN 'br' THEN 6 WHEN 'a' THEN 6 END AS INTEGER) AS depth FROM t GROUP BY page_id, tag""")
def page_elements(spark, d):
    rows = S.element_rows(table(spark, d, "pages"), "page_id", "html")
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


@query(f"""WITH l AS (SELECT page_id, len(regexp_extract_all({_BODY}, '<li>')) AS n FROM pages), s AS (SELECT page_id, 'li' AS selector, 5 AS depth, round(0.3 + 0.15 * least(1.0, n / 10.0) + 0.15 + 0.15 * (1 - 5 / CAST(12.0 AS DOUBLE)), 6) AS score FROM l WHERE n >= 3)
SELECT page_id, selector FROM s""")
def page_containers(spark, d):
    return S.containers(table(spark, d, "pages"), "page_id", "html").select("page_id", "selector")


# Of these pages only paragraphs and their bold beginnings are left open, until the article ends.
_SAFE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<![^>]*>', '', 'g'), '(?s)<(script|style)>.*?</(script|style)>', '', 'g'),
'</article>', repeat('</b></p>', len(regexp_extract_all(html, '<b>')))), '</?(html|head|meta|title|body|nav|div|article|h1|footer)\b[^>]*>', '', 'g')"""


@query(f"SELECT page_id, sha256(trim({_SAFE})) AS h FROM pages")
def sanitised_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(sanitised(F.col("html")), 256).alias("h"))


@query(rf"SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace({_BODY}, '<![^>]*>', ' '), '<[^>]*>', ' ', 'g'), '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[\s\x{{85}}\x{{a0}}\x{{3000}}]+', ' ', 'g'))) AS h FROM pages")
def page_texts(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(html_text(F.col("html")), 256).alias("h"))


def _navigation(d_pages):
    """The links of each page's navigation as cards."""
    return S.sibling_groups(d_pages, "page_id", "html").where("tag = 'li'").select("page_id", "parent", "tag", "classes")


@query(rf"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS t FROM pages),
s AS (SELECT page_id, count(*) AS n, count(DISTINCT href) AS n_href, count(DISTINCT replace(replace(replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '&quot;', chr(34)), '&lt;', '<'), '&amp;', '&')) AS n_text, count(*) FILTER (length(trim(t)) BETWEEN 2 AND 300) AS fine FROM l GROUP BY 1 HAVING count(*) >= 3),
b AS (SELECT *, 0.1 * 0.4 + 0.18 + 0.09 AS same, 0.1 * (1 / CAST(480 AS DOUBLE)) + 0.04 AS lost FROM s)
SELECT page_id, 'canonical_url' AS role, 'a' AS selector, 'href' AS attribute, round(0.13 * 0.8 + same + 0.16 + 0.08 * n_href / n - lost - 0.15, 6) AS confidence FROM b WHERE n_href / n >= 0.5
UNION ALL SELECT page_id, 'title', 'a', NULL, round(0.13 * 0.6 + same + 0.16 * fine / n + 0.08 * n_text / n - lost, 6) FROM b WHERE n_text / n >= 0.5 AND fine / n >= 0.5""")
def inferred_navigation_fields(spark, d):
    from tidemill.operators import fields as I

    pages = table(spark, d, "pages")
    return I.inferred_fields(pages, "page_id", "html", _navigation(pages), "url").select("page_id", "role", "selector", "attribute", "confidence")
