"""Queries on markup."""

from pyspark.sql import functions as F

from plenum import bindings as b
from plenum.functions import markup as m
from plenum.sources.readers import widen
from plenum.functions.xmltext import child_text, text_of

# The tags that the given pages have, one after the other; a heading's and a mark's texts are trimmed.
MARKDOWN = """
WITH bare AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)\\s*>', '', 'g'),
    '(?s)<!--.*?-->|<![^>]*>', '', 'g'), '(?is)<head(\\s[^>]*)?>.*?</head\\s*>|<nav(\\s[^>]*)?>.*?</nav\\s*>', '', 'g') AS x FROM pages),
spaced AS (SELECT page_id, regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '(?i)<b>\\s*</b>', '', 'g') AS x FROM bare),
marked AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)<b>\\s*', '**', 'g'), '(?i)\\s*</b>', '** ', 'g'),
    '(?i)<h1(\\s[^>]*)?>', chr(10) || chr(10) || '# ', 'g'), '(?i)<br\\s*/?>', '  ' || chr(10), 'g'),
    '(?i)</?(p|div|article|footer|section|main|h1)(\\s[^>]*)?>', chr(10) || chr(10), 'g') AS x FROM spaced),
plain AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS x FROM marked),
blocks AS (SELECT page_id, regexp_replace(x, '[ \\t]*\\n[ \\t]*\\n\\s*', chr(10) || chr(10), 'g') AS x FROM plain),
single AS (SELECT page_id, regexp_replace(regexp_replace(x, '([^\\s|]) {2,}([^\\s|])', '\\1 \\2', 'g'), '([^\\s|]) {2,}([^\\s|])', '\\1 \\2', 'g') AS x FROM blocks)
SELECT page_id, regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '(?m)([^ ]) $', '\\1', 'g') AS markdown, NULL AS error FROM single"""

QUERIES = {
    "markup_sections": (
        lambda s, d: m.page_sections(b.table(s, d, "pages").select("page_id", "html"), "html").drop("html"),
        """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
          regexp_extract(html, '(?s)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
          '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
        nullif(regexp_extract(html, '<html[^>]*\\slang="([^"]*)"', 1), '') AS lang,
        len(regexp_extract_all(html, '<a\\s[^>]*href=')) AS links FROM pages""",
    ),
    "markup_first_heading": (
        lambda s, d: b.table(s, d, "pages").select("page_id", F.length(child_text("html", "h1")).alias("length")),
        """SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(
          regexp_extract(html, '(?s)<h1(?:\\s[^>]*)?>(.*?)</h1\\s*>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
          '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))) AS length FROM pages
        WHERE html LIKE '%<h1%'
        UNION ALL SELECT page_id, NULL FROM pages WHERE html NOT LIKE '%<h1%'""",
    ),
    "markup_to_markdown": (
        lambda s, d: m.to_markdown(widen(b.table(s, d, "pages").select("page_id", "html")), "html", rules=m.HTML).drop("html"),
        MARKDOWN,
    ),
    "markup_plain_text": (
        lambda s, d: m.to_markdown(
            b.documents(s, d).select(
                "id",
                F.concat(
                    F.lit("<asi:PerusteluOsa><sis:KappaleKooste>"),
                    F.replace(F.replace(F.col("summary"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                    F.lit("</sis:KappaleKooste></asi:PerusteluOsa>"),
                ).alias("xml"),
            ),
            "xml",
        ).select("id", text_of(F.replace(F.col("markdown"), F.lit("<"), F.lit("&lt;"))).alias("text"), "error"),
        """SELECT doc_id AS id, trim(regexp_replace(text, '[\\s\\p{Z}\\x{0b}\\x{85}]+', ' ', 'g')) AS text, NULL AS error
        FROM documents""",
    ),
}
