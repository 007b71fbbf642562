"""The main text of HTML pages, with site templates removed.

A page is read once into blocks of text and the subtrees that hold them. What is never main text by its element is left out while reading, and
so are containers that name themselves: inside an article or main part only those whose class or role is exactly a word for reader comments or
adverts, elsewhere those whose class, id or role has a word for menus, notices and the like in it. Headings, paragraphs, lists' items and
other elements that hold content themselves are never left out by a name. Each other container is hashed with all it holds; Spark counts on how
many different pages of a host a hash occurs, and subtrees that recur on many of them are deleted wherever they occur on that host.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.shared import mapped, written

#: A subtree on this many different pages of a host at least, and on this share of them, is part of its template.
MIN_PAGES, MIN_SHARE = 10, 0.3

# Elements of HTML and words of classes, ids and roles by what they are for.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp noscript template svg".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul caption head".split()
)
DROPPED = set("head nav footer aside form script style textarea title iframe noembed noframes noscript template svg button select canvas object menu dialog".split())
DROP_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login comment comments disqus replies "
    "respond share sharing social related recommended recommendations widget masthead pagination pager toolbar search skip complementary contentinfo "
    "dialog alert".split()
)
COMMENT_WORDS = set("comment comments replies ad ads advert adverts advertisement sponsored".split())
#: Elements that may be left out by a name.
CONTAINERS = set("div section ul ol table article span center fieldset details figure".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPES = set("ul ol dl table article main section div body html td th".split())
#: In an article or main part any other element may hold content that repeats.
CONTENT = set("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd table caption thead tbody tfoot tr figure figcaption details summary address hgroup".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^<>])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


class _Open:
    """An open element: its first block, whether its text is left out, whether it is or is in the main part, and hashes of what it holds."""

    __slots__ = ("name", "key", "at", "gone", "main", "held")

    def __init__(self, name: str, key: str, at: int, gone: bool, main: bool):
        self.name, self.key, self.at, self.gone, self.main = name, key, at, gone, main
        self.held = xxhash.xxh64(f"{name}|{key}")


def _unwanted(name: str, attributes: dict[str, str], main: bool) -> bool:
    if name in DROPPED or (name == "header" and not main) or "hidden" in attributes:
        return True
    if name in ("html", "body", "main"):
        return False
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if name not in CONTAINERS and not (name == "header" and not main):
        return False
    given = [attributes.get(a, "").lower() for a in ("class", "role")]
    if main or name == "article":
        return bool(set(" ".join(given).split()) & COMMENT_WORDS)
    words = set(re.split(r"[^a-z0-9]+", " ".join([*given, attributes.get("id", "").lower()])))
    return bool(words & DROP_WORDS) or bool(words & {"header", "banner"})


def read_page(page: str) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The blocks of a page's main part, and (hash, first block, end block) of each container in it that may be part of a template.

    The main part is what stands in `article` and `main` elements, or the whole body if there is none with text. A container that holds more
    than half of the main part's characters is no template, nor is an element of `CONTENT` inside an article or main part.
    """
    stack = [_Open("html", "", 0, False, False)]
    blocks: list[tuple[str, bool]] = []
    subtrees: list[tuple[int, int, int, bool]] = []
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                top = stack[-1]
                blocks.append((text, top.main))
                top.held.update(text)

    def close() -> None:
        own = stack[-1]
        if own.name in BLOCK:
            flush()
        stack.pop()
        if not stack:
            return
        if own.name in BLOCK and not own.gone:
            stack[-1].held.update(own.held.digest())
            if len(blocks) > own.at and own.name not in ("html", "body", "main", "article") and not (own.main and own.name in CONTENT):
                subtrees.append((own.held.intdigest(), own.at, len(blocks), own.main))

    def text(raw: str) -> None:
        if raw and not stack[-1].gone:
            pieces.append(html.unescape(raw) if "&" in raw else raw)

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        text(page[at : found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            if name == "br":
                text(" ")
            elif any(x.name == name for x in stack[1:]):
                while stack[-1].name != name:
                    close()
                close()
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                text(" " if name == "br" else "")
            continue
        if name in BLOCK:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    while len(stack) > i:
                        close()
                    break
                if stack[i].name in BLOCK:
                    break
        for i in range(len(stack) - 1, 0, -1) if name in CLOSES else ():
            if stack[i].name in CLOSES[name]:
                while len(stack) > i:
                    close()
            elif stack[i].name in SCOPES:
                break
        if name in ("td", "th"):
            text(" ")
        attributes = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(found[3])} if found[3].strip(" /") else {}
        top = stack[-1]
        main = top.main or (name in ("article", "main") and not top.gone) or (attributes.get("role") == "main" and not top.gone)
        stack.append(_Open(name, f"{attributes.get('class', '')}|{attributes.get('id', '')}", len(blocks), top.gone or _unwanted(name, attributes, top.main), main))
    while stack:
        flush()
        close()

    if any(main for _, main in blocks):
        number, kept = [], 0
        for _, main in blocks:
            number.append(kept)
            kept += main
        number.append(kept)
        own = [b for b, main in blocks if main]
        subtrees = [(h, number[a], number[b], True) for h, a, b, main in subtrees if main]
    else:
        own = [b for b, _ in blocks]
    upto = [0]
    for b in own:
        upto.append(upto[-1] + len(b))
    return own, [(h, a, b) for h, a, b, _ in subtrees if 2 * (upto[b] - upto[a]) <= upto[-1]]


_SUBTREE = pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])


def read_pages(pages: DataFrame) -> DataFrame:
    """(row, id, url, host, body, blocks, subtrees) of pages (row, id, url, host, html); body: a hash of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                blocks, subtrees, bodies = [], [], []
                for page in part.column(4).to_pylist():
                    own, trees = read_page(page or "")
                    blocks.append(own)
                    subtrees.append([{"hash": h - (1 << 63), "first": a, "end": b} for h, a, b in trees])
                    bodies.append(xxhash.xxh64_intdigest("\n".join(own)) - (1 << 63))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(bodies, pa.int64()), pa.array(blocks, pa.list_(pa.string())), pa.array(subtrees, pa.list_(_SUBTREE))],
                    names=["row", "id", "url", "host", "body", "blocks", "subtrees"],
                )

    kind = pages.schema["id"].dataType.simpleString()
    shape = f"row long, id {kind}, url string, host string, body long, blocks array<string>, subtrees array<struct<hash: long, first: int, end: int>>"
    return mapped(pages.select("row", "id", "url", "host", "html"), run, shape)


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE
) -> DataFrame:
    """(`id_col`, `url_col`, text, n_chars, n_template) for every row of `pages`; n_template counts blocks deleted as part of a site's template.

    A template is on `min_pages` different pages of its host at least, and on `min_share` of them. Blocks are joined by two \\n. Pages of a host with equal text count once for its template, so copies make no template. A null html is
    empty and gives an empty text; pages without a url or host share one host; repeated rows come out as often as they came in; an empty table gives
    an empty table. Other columns are not read.
    """
    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    source = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    scanned = written(read_pages(source), "pages")
    different = scanned.where(F.size("subtrees") > 0).select("host", "body", F.explode(F.array_distinct(F.col("subtrees.hash"))).alias("hash")).distinct()
    size = scanned.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("size"))
    often = different.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    template = written(often.join(size, "host").where(F.col("n") >= min_share * F.col("size")).select("host", "hash"), "template")
    gone = (
        scanned.where(F.size("subtrees") > 0).select("row", "host", F.explode("subtrees").alias("s")).select("row", "host", "s.hash", "s.first", "s.end")
        .join(template, ["host", "hash"]).groupBy("row").agg(F.collect_set(F.struct("first", "end")).alias("gone"))
    )
    plain = scanned.where(F.size("subtrees") == 0).select("id", "url", "blocks", F.lit(0).cast("long").alias("n_template"))
    places = F.array_distinct(F.flatten(F.transform("gone", lambda g: F.sequence(g["first"], g["end"] - 1))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("blocks") - 1), places)
    cleaned = scanned.where(F.size("subtrees") > 0).join(gone, "row", "left").select(
        "id", "url", F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.transform(stay, lambda i: F.get("blocks", i))).alias("blocks"),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_template"),
    )
    text = F.concat_ws("\n\n", "blocks")
    return plain.union(cleaned).select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"), F.length(text).cast("long").alias("n_chars"), "n_template")
