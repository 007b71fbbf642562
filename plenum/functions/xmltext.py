"""Cutting elements, texts and attributes out of XML kept in a text column.

Documents are many and large, their schema is open, and most jobs need a few
small pieces: those are cut with one regular expression each, inside the scan
stage, with no DOM per expression. Prefixes are ignored; an element must not
contain another of its own name (none of those cut here does).

What is cut must be in canonical form: attributes in double quotes without a
``>`` inside, no comments, CDATA sections, processing instructions or numeric
references. ``canonical`` brings any well-formed document into it; the builders
do that first. Documents of a known shape are parsed by a schema instead
(``sources.readers.parse_xml``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = r"(?:[\w.-]++:)?"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# A tag with quoted values that may hold any sign, and what else a document is made of.
_TAG = r"""<[^<>"'!?](?:[^<>"']|"[^"]*+"|'[^']*+')*+>"""
_PIECES = rf"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>\[]*(?:\[.*?\])?\s*>|{_TAG}|[^<]+|<"
# Attributes that are not canonical; the pattern begins with one sign, which is looked for fast.
_ODD = r"""=(?:(?<=\s=)|\s*'|\s+"|"[^">]*+>)"""
_SIGNS = {34: "&quot;", 38: "&amp;", 39: "&apos;", 60: "&lt;", 62: "&gt;"}


def _replaced(c: Column, signs: str) -> Column:
    named = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}
    for sign in signs:
        c = F.replace(c, F.lit(sign), F.lit(named[sign]))
    return c


def _canonical_piece(t: Column) -> Column:
    def quoted(v: Column) -> Column:
        inner = F.substring(v, F.lit(2), F.length(v) - 2)
        return (
            F.when(v.startswith('"'), F.concat(F.lit('"'), _replaced(inner, "<>"), F.lit('"')))
            .when(v.startswith("'"), F.concat(F.lit('"'), _replaced(inner, '<>"'), F.lit('"')))
            .otherwise(F.regexp_replace(v, r"\s*=\s*", "="))
        )

    values = F.regexp_extract_all(t, F.lit(r"""(?s)"[^"]*+"|'[^']*+'|[^"']++"""), 0)
    return (
        F.when(t.startswith("<![CDATA["), _replaced(F.substring(t, F.lit(10), F.length(t) - 12), "&<>"))
        .when(t.startswith("<!") | t.startswith("<?"), "")
        .when(t.startswith("<") & (F.contains(t, F.lit("'")) | F.contains(t, F.lit('"'))), F.array_join(F.transform(values, quoted), ""))
        .otherwise(t)
    )


def _numbered(c: Column) -> Column:
    """Numeric references as the characters they stand for; those of signs that matter as named ones, impossible ones as they are."""

    def one(t: Column) -> Column:
        hexadecimal = t.startswith("&#x") | t.startswith("&#X")
        code = F.when(hexadecimal, F.conv(F.regexp_extract(t, "([0-9a-fA-F]+);$", 1), 16, 10)).otherwise(
            F.regexp_extract(t, "([0-9]+);$", 1)
        ).try_cast("int")
        possible = ((code >= 32) & (code < 0xD800)) | ((code >= 0xE000) & (code < 0x110000)) | code.isin(9, 10, 13)
        named = F.try_element_at(F.create_map(*[F.lit(x) for pair in _SIGNS.items() for x in pair]), code)
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(t.startswith("&#") & possible, F.coalesce(named, sign)).otherwise(t)

    pieces = F.regexp_extract_all(c, F.lit(r"&#[0-9]+;|&#[xX][0-9a-fA-F]+;|[^&]+|&"), 0)
    return F.when(F.contains(c, F.lit("&#")), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def canonical(col: str | Column) -> Column:
    """The same document in the form that this module cuts; one that is in it already is only looked at."""
    c = _c(col)
    pieces = F.transform(F.regexp_extract_all(c, F.lit(_PIECES), 0), _canonical_piece)
    odd = F.contains(c, F.lit("<!")) | F.contains(c, F.lit("<?")) | F.contains(c, F.lit("&#")) | c.rlike(_ODD)
    return F.when(odd, F.transform(F.array(F.array_join(pieces, "")), _numbered)[0]).otherwise(c)


def element_pattern(*tags: str) -> str:
    """Elements up to the next end tag of their name; texts and tags inside are passed as wholes, not sign by sign."""
    one = [
        rf"<{PREFIX}{t}(?=[\s/>])[^>]*+>(?:(?<=/>)|(?:[^<]++|<(?!/{PREFIX}{t}\s*>))*+</{PREFIX}{t}\s*>)" for t in tags
    ]
    return "(?s)" + "|".join(one)


def subtrees(col: str | Column, *tags: str) -> Column:
    """All elements of these names, in document order."""
    return F.regexp_extract_all(_c(col), F.lit(element_pattern(*tags)), 0)


def cut(col: str | Column, *tags: str) -> Column:
    """The first such element, '' without one."""
    return F.regexp_extract(_c(col), element_pattern(*tags), 0)


def subtree(col: str | Column, *tags: str) -> Column:
    """The first such element, NULL without one."""
    return F.nullif(cut(col, *tags), F.lit(""))


def without(col: str | Column, *tags: str) -> Column:
    return F.regexp_replace(_c(col), element_pattern(*tags), "")


def raw_attribute(col: str | Column, name: str) -> Column:
    """Attribute of the outermost element of a cut piece, '' without one."""
    return unescape(F.regexp_extract(_c(col), rf'^<[^>]*?[\s:]{name}="([^"]*)"', 1))


def attribute(col: str | Column, name: str) -> Column:
    """The same, a missing or empty one being NULL."""
    return F.nullif(raw_attribute(col, name), F.lit(""))


def unescape(col: str | Column) -> Column:
    """The predefined entities; numeric ones are gone from canonical XML, and in HTML they are good Markdown."""
    c = _c(col)
    named = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
    for entity, char in named.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _spaced(bare: Column) -> Column:
    return F.trim(F.regexp_replace(bare, r"(?U)\s{2,}|[^\S ]", " "))


def _untagged(col: str | Column) -> Column:
    return F.regexp_replace(_c(col), r"(?s)<!--.*?-->|<[^>]*>", "")


def text_of(col: str | Column) -> Column:
    """All text inside, tags dropped, white space collapsed; NULL stays NULL."""
    return _spaced(unescape(_untagged(col)))


def text_within(col: str | Column, whole: Column) -> Column:
    """The same of a piece of ``whole``, which costs nothing to read and tells whether there are entities."""
    return F.when(F.contains(whole, F.lit("&")), text_of(col)).otherwise(_spaced(_untagged(col)))


def own_text(col: str | Column) -> Column:
    """Text before the first child element, trimmed; '' when there is none."""
    return strip(unescape(F.regexp_extract(_c(col), r"(?s)^<[^>]*[^/]>([^<]*)", 1)))


def strip(col: str | Column) -> Column:
    """Trim white space of any kind."""
    return F.regexp_replace(_c(col), r"(?U)\A\s+|\s+\z", "")


def child_or_blank(col: str | Column, tag: str) -> Column:
    """Like ``child_text`` but '' without such a child; one cut only, so fit for use inside lambdas."""
    return text_within(cut(col, tag), _c(col))


def child_text(col: str | Column, tag: str) -> Column:
    return text_of(subtree(col, tag))
