"""Markup -> Markdown as one fold over the tokens of a document.

A document is cut into tags and texts with a regular expression and walked once
with ``aggregate``, run by run; the state is a few counters. Nothing leaves the row, so a
whole corpus converts in the scan stage with no shuffle and no Python. What a
tag means is a table of rules, one for the parliament's XML and one for HTML.
A tag the rules do not know is reported in an error column; its text is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.xmltext import (
    PREFIX, child_or_blank, child_text, raw_attribute, subtree, subtrees, text_within, unescape, without,
)


@dataclass(frozen=True)
class Rules:
    roles: Mapping[str, str]
    ordered: tuple[str, ...] = ()
    bulleted: tuple[str, ...] = ()
    style_attribute: str | None = None
    image_attribute: str = "src"
    link_attribute: str = "href"
    any_child_is_item: bool = False
    capitalize_headings: bool = False
    fold_case: bool = False
    superscripts: Mapping[str, str] = field(default_factory=dict)
    subscripts: Mapping[str, str] = field(default_factory=dict)


# --- fixed values: what the tags of the parliament's documents mean ---------------------
_XML_ROLES = {
    "heading": ["OtsikkoTeksti", "ValiotsikkoTeksti", "LihavaKursiiviOtsikkoTeksti", "RiviotsikkoTeksti"],
    "para": ["KappaleKooste", "JohdantoTeksti", "ViiteTeksti", "SaadosKappaleKooste"],
    "quote": ["SisennettyKappaleKooste"],
    "table": ["table"],
    "row": ["row"],
    "cell": ["entry"],
    "list": ["Lista", "SuppeaLista"],
    "chapter": ["PerusteluLuku", "VireilletuloAsia"],
    "plain": [
        "LukuOtsikko", "PerusteluOsa", "SisaltoKuvaus", "AsiaKuvaus", "PaatosOsa", "PaatosToimenpide", "PonsiOsa",
        "PykalaViite", "Kuva", "tgroup", "colspec", "thead", "tbody", "Alkio", "ListaAlkio",
        "SaadoskokoelmaViiteTunnus", "AsiakirjaViiteTunnus", "SopimussarjaViiteTunnus", "ViiteTunnus",
    ],
    "skip": [
        "OtsikkoNroTeksti", "Tyhja", "NeljannesTyhja", "AsiantuntijatToimenpide", "Valiokuntakasittely",
        "MuuAsiaKuvaus", "YhdistettyAsia",
    ],
    "italic": ["KursiiviTeksti", "HarvaKursiiviTeksti"],
    "bold": ["LihavaTeksti"],
    "bolditalic": ["LihavaKursiiviTeksti"],
    "sup": ["YlaindeksiTeksti"],
    "sub": ["AlaindeksiTeksti"],
    "footnote": ["AlaviiteTeksti"],
    "aside": ["AlaviiteKooste"],
    "link": ["YleinenViite"],
    "break": ["Rivivaihto"],
    "gap": ["Aukko"],
}
XML = Rules(
    roles={t: role for role, tags in _XML_ROLES.items() for t in tags},
    ordered=("Numerosulku", "Numeropiste", "JatkuvaNumeropiste", "JatkuvaNumerosulku", "Kirjainsulku"),
    bulleted=("Viiva", "Tasaviiva", "LyhytViiva", "LyhytTasaviiva"),
    style_attribute="ulkoasuKoodi",
    image_attribute="kuvaTiedostoTeksti",
    link_attribute="viiteURL",
    any_child_is_item=True,
    capitalize_headings=True,
    superscripts={"2": "²", "3": "³"},
    subscripts={"1": "₁", "2": "₂", "3": "₃", "10": "₁₀"},
)

# --- fixed values: the same for HTML pages ------------------------------------------------
_HTML_ROLES = {
    "h1": ["h1"], "h2": ["h2"], "h3": ["h3"], "h4": ["h4"], "h5": ["h5"], "h6": ["h6"],
    "para": ["p", "div", "section", "article", "header", "footer", "main", "pre", "figure", "figcaption", "aside"],
    "quote": ["blockquote"],
    "table": ["table"],
    "row": ["tr"],
    "cell": ["td", "th"],
    "ul": ["ul"],
    "ol": ["ol"],
    "item": ["li"],
    "plain": ["html", "body", "span", "thead", "tbody", "label", "form", "small", "u", "font", "center", "button",
              "hr", "input", "code", "tfoot", "meta", "link", "base"],
    "skip": ["head", "title", "script", "style", "nav", "noscript", "template", "svg"],
    "italic": ["i", "em"],
    "bold": ["b", "strong"],
    "sup": ["sup"],
    "sub": ["sub"],
    "link": ["a"],
    "image": ["img"],
    "break": ["br"],
}
HTML = Rules(roles={t: role for role, tags in _HTML_ROLES.items() for t in tags}, fold_case=True)

# Texts and tags that are surely nothing else come first.
TOKEN = (
    r"(?s)[^<]++|<(?![!?]|(?i:script|style)\b)[^>]*+>|<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(?i:script|style)\b[^>]*>.*?</(?i:script|style)\s*>|<[^>]*>"
)
LEVELS = ["h1", "h2", "h3", "h4", "h5", "h6"]
MARKS = {"italic": "*", "bold": "**", "bolditalic": "***"}
# What a token does, decided once per token before the fold.
(NOTHING, TEXT, HEADING, HEADING_END, BLOCK, BLOCK_END, LIST, LIST_END, ITEM, TABLE, TABLE_END, ROW, ROW_END, CELL,
 CELL_END, MARK, MARK_END, WRAP, WRAP_END, LINK, LINK_END, ASIDE, ASIDE_END, BREAK, GAP, IMAGE, CHAPTER, CHAPTER_END,
 SKIP) = range(29)
# What the tags of a role do as they open, close or are empty.
DOES = {
    **{r: (BLOCK, BLOCK_END, NOTHING) for r in ("para", "quote")},
    **{r: (LIST, LIST_END, NOTHING) for r in ("ul", "ol", "list")},
    **{r: (MARK, MARK_END, NOTHING) for r in MARKS},
    **{r: (WRAP, WRAP_END, NOTHING) for r in ("sup", "sub", "footnote")},
    **{r: (HEADING, HEADING_END, NOTHING) for r in ("heading", *LEVELS)},
    "item": (ITEM, NOTHING, NOTHING), "skip": (SKIP, NOTHING, NOTHING), "link": (LINK, LINK_END, NOTHING),
    "table": (TABLE, TABLE_END, NOTHING), "row": (ROW, ROW_END, NOTHING), "cell": (CELL, CELL_END, NOTHING),
    "aside": (ASIDE, ASIDE_END, NOTHING), "chapter": (CHAPTER, CHAPTER_END, NOTHING),
    "break": (BREAK, NOTHING, BREAK), "gap": (GAP, NOTHING, GAP),
}
ARGS = {**{h: h[1] for h in LEVELS}, "ul": "-", "ol": "1", "quote": "> ", **MARKS}
# Tokens that are folded together at least.
RUN = 64
STRINGS, LISTS = "array<string>", "array<struct<kind:string,n:int,depth:int>>"


def _literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def _does(role: str) -> tuple[int, int, int, str]:
    """What a tag of a role does as it opens, closes or is empty, and its argument."""
    return (*DOES.get(role, (NOTHING, NOTHING, NOTHING)), ARGS.get(role, ""))


TOKEN_FIELDS = ("op", "d", "tag", "arg", "role")


def _token(*values: Column | int | str | None) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(TOKEN_FIELDS, values)])


def _by_tag(rules: Rules, fields: Callable[[str, str], Mapping[str, int | str]]) -> Column:
    """Map from tag name to a struct of fixed values, written as SQL: column by column it would take a second to build."""

    def struct(tag: str, role: str) -> str:
        return ", ".join(f"'{n}', {v!r}" for n, v in fields(tag, role).items())

    return F.expr("map(" + ", ".join(f"'{tag}', named_struct({struct(tag, role)})" for tag, role in rules.roles.items()) + ")")


def _rules_by_tag(rules: Rules) -> Column:
    return _by_tag(rules, lambda tag, role: {"role": role, **dict(zip(("open", "close", "empty", "arg"), _does(role)))})


def _bare_tokens(rules: Rules, d: int) -> Column:
    """Tag name -> the whole token of a tag without attributes that opens (1), closes (-1) or is empty (0)."""

    def bare(tag: str, role: str) -> dict[str, int | str]:
        op, arg = _does(role)[{1: 0, -1: 1, 0: 2}[d]], _does(role)[3]
        if role == "image" and not rules.any_child_is_item:
            op, arg = NOTHING, ""
        if role == "link":
            arg = ""
        if role == "list" and d == 1 and rules.style_attribute:
            op, arg = LIST, "-"
        return dict(zip(TOKEN_FIELDS, (op, d, tag, arg, role)))

    return _by_tag(rules, bare)


def _token_structs(markup: Column, rules: Rules) -> Column:
    """Tokens as (op, d, tag, arg, role): what to do, change of depth, tag name, text or attribute."""

    def one(t: Column) -> Column:
        content = F.when(t.startswith("<!["), F.substring(t, 10, F.length(t) - 12)).otherwise(
            F.when(F.contains(t, F.lit("&")), unescape(t)).otherwise(t)
        )
        text = _token(TEXT, 0, "", F.regexp_replace(content, r"\s{2,}|[^\S ]", " "), "text")
        tag = F.regexp_extract(t, rf"^</?{PREFIX}([\w.-]+)", 1)
        name = F.lower(tag) if rules.fold_case else tag
        code = (t.startswith("<s") | t.startswith("<S")) & F.lower(F.substring(t, 3, 1)).isin("c", "t") & t.rlike(r"^<(?i:script|style)\b")
        odd = t.startswith("<!") | t.startswith("<?") | code
        # What a tag without attributes is stands in a table; others and unknown ones are looked at.
        bare = F.when(t.startswith("</"), F.try_element_at(_bare_tokens(rules, -1), name)).when(
            t.endswith("/>"), F.try_element_at(_bare_tokens(rules, 0), name)
        ).otherwise(F.try_element_at(_bare_tokens(rules, 1), name))
        looked_at = let(name, lambda n: let(F.try_element_at(_rules_by_tag(rules), n), lambda rule: element(t, n, rule)))
        return (
            F.when(~t.startswith("<") | t.startswith("<![CDATA["), text)
            .when(odd, _token(NOTHING, 0, name, "", "none"))
            .otherwise(F.coalesce(F.when(~F.contains(t, F.lit("=")), bare), looked_at))
        )

    def element(t: Column, tag: Column, rule: Column) -> Column:
        closes, empty = t.startswith("</"), t.endswith("/>")
        d = F.when(closes, -1).when(empty, 0).otherwise(1)
        op = F.coalesce(F.when(closes, rule["close"]).when(empty, rule["empty"]).otherwise(rule["open"]), F.lit(NOTHING))
        plain = _token(op, d, tag, F.coalesce(rule["arg"], F.lit("")), rule["role"])
        shown = let(raw_attribute(t, rules.image_attribute), lambda image: _token(
            F.when(~closes & (image != ""), IMAGE).otherwise(NOTHING), d, tag, image, "picture" if rules.any_child_is_item else "image"
        ))
        picture = rule["role"] == "image"
        if rules.any_child_is_item:  # the file name may sit on a child of any name
            picture = t.contains(f'{rules.image_attribute}="')
        out = F.when(picture, shown).when(rule["role"] == "link", _token(op, d, tag, raw_attribute(t, rules.link_attribute), "link"))
        if rules.style_attribute:
            out = out.when((rule["role"] == "list") & (d == 1), let(raw_attribute(t, rules.style_attribute), lambda style: _token(
                F.when(style == "Tyhja", SKIP).otherwise(LIST), d, tag,
                F.when(style.isin(list(rules.ordered)), "1").when(style == "Tyhja", "").otherwise("-"), "list",
            )))
        return out.otherwise(plain)

    return F.transform(F.regexp_extract_all(markup, F.lit(TOKEN), 0), one)


def _drop_title_blocks(markup: Column) -> Column:
    """Table groups of at most one column are titles, not tables."""
    pieces = F.split(markup, rf"(?=<{PREFIX}tgroup[\s>])")

    def keep(p: Column) -> Column:
        columns = F.size(F.split(p, rf"<{PREFIX}colspec(?=[\s/>])")) - 1
        group = p.rlike(rf"^<{PREFIX}tgroup[\s>]")
        return F.when(
            group & (columns <= 1), F.regexp_replace(p, rf"(?s)^<.*?</{PREFIX}tgroup\s*>", "")
        ).otherwise(p)

    return F.when(F.contains(markup, F.lit("tgroup")), F.array_join(F.transform(pieces, keep), "")).otherwise(markup)


def _drop_empty_marks(markup: Column, rules: Rules, whole: Column) -> Column:
    """``whole`` is the piece that ``markup`` is made of: where no such tag is named, nothing is looked for."""
    marks = [t for t, r in rules.roles.items() if r in (*MARKS, "sup", "sub")]
    case = "(?i)" if rules.fold_case else ""
    dropped = F.regexp_replace(markup, rf"{case}<({PREFIX}(?:{'|'.join(marks)}))(?:\s[^>]*?)?(?:/>|>\s*</\1\s*>)", "")
    if rules.fold_case:
        return dropped
    return F.when(reduce(or_, [F.contains(whole, F.lit(t)) for t in marks]), dropped).otherwise(markup)


def _step(s: Column, t: Column, rules: Rules) -> Column:
    """The state after one token: one branch per kind of token."""
    op, role, arg, depth = t["op"], t["role"], t["arg"], s["depth"] + t["d"]
    in_list, in_cell = F.size(s["lists"]) > 0, s["cols"] > 0

    # In the XML every direct child of a list is an item, whatever its name.
    top = F.try_element_at(s["lists"], F.lit(-1))
    item = (t["d"] == 1) & in_list & (s["skip"] == 0) & (F.coalesce(top["depth"], F.lit(-9)) + 1 == s["depth"])
    cur, lists = s["cur"], s["lists"]
    if rules.any_child_is_item:
        cur, lists = F.when(item, F.concat(cur, _bullet(s))).otherwise(cur), F.when(item, _counted(s)).otherwise(lists)

    def then(piece: Column | str | None = None, **changed: Column) -> Column:
        """The state after a tag that closes or a text."""
        out = s.withField("depth", depth)
        if piece is not None:
            out = out.withField("cur", F.concat(s["cur"], F.lit(piece) if isinstance(piece, str) else piece))
        for name, value in changed.items():
            out = out.withField(name, value)
        return out

    def opened(piece: Column | str | None = None, **changed: Column) -> Column:
        """The state after a tag that opens, which may be an item."""
        if rules.any_child_is_item:
            changed = {"lists": lists, "cur": cur} | changed
        if piece is not None:
            changed["cur"] = F.concat(cur, F.lit(piece) if isinstance(piece, str) else piece)
        return then(**changed)

    same = t["tag"] == s["skipped"]
    skip = F.when(same, s["skip"] + t["d"]).otherwise(s["skip"])

    bare = F.trim(arg)
    number = (s["notes_made"] + 1).cast("string")
    said = (
        F.when(s["mark"] == "", F.when(
            s["heading"] & F.lit(rules.capitalize_headings),
            F.concat(F.upper(F.left(bare, F.lit(1))), F.lower(F.substring(bare, 2, 1_000_000_000))),
        ).otherwise(arg))
        .when(s["mark"] == "sup", F.coalesce(_pick(bare, rules.superscripts), F.concat(F.lit("<sup>"), bare, F.lit("</sup>"))))
        .when(s["mark"] == "sub", F.coalesce(_pick(bare, rules.subscripts), F.concat(F.lit("<sub>"), bare, F.lit("</sub>"))))
        .when(s["mark"] == "footnote", F.concat(F.lit("[^"), number, F.lit("]")))
        .otherwise(bare)
    )
    def in_a_cell(x: Column) -> Column:
        return F.when(in_cell, F.replace(x, F.lit("|"), F.lit("\\|"))).otherwise(x)

    said = in_a_cell(said)
    footnote = (s["mark"] == "footnote") & (bare != "")
    text = F.when((s["mark"] == "") & ~s["heading"], then(in_a_cell(arg))).when(bare == "", then()).when(
        footnote,
        then(said, notes=F.concat(s["notes"], F.array(F.concat(F.lit("[^"), number, F.lit("]: "), bare))),
             notes_made=s["notes_made"] + 1),
    ).otherwise(then(said))

    level = F.when(arg != "", arg.cast("int")).otherwise(F.least(s["chapters"] + 1, F.lit(6)))
    no_notes = F.array().cast(STRINGS)
    notes = F.when(F.size(s["notes"]) > 0, F.concat(F.lit("\n\n"), F.array_join(s["notes"], "\n\n"))).otherwise("")
    after_block = F.concat(notes, F.when(in_list, "\n").otherwise("\n\n"))
    before_block = F.when(in_cell, F.when(s["blocks"] > 0, " <br> ").otherwise("")).when(in_list, "").otherwise(
        F.concat(F.lit("\n\n"), arg)
    )
    header_rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.greatest(s["width"], s["cols"])))
    pad = F.repeat(F.lit("  |"), F.greatest(s["width"] - s["cols"], F.lit(0)))
    pushed = F.struct(arg.alias("kind"), F.lit(0).alias("n"), s["depth"].alias("depth"))

    branches = {
        TEXT: text,
        NOTHING: opened(),
        BLOCK: opened(before_block, blocks=s["blocks"] + 1),
        BLOCK_END: F.when(in_cell, then()).otherwise(then(after_block, notes=no_notes)),
        MARK: opened(arg, mark=role),
        MARK_END: then(F.concat(arg, F.lit(" ")), mark=F.lit("")),
        LINK: opened("[", url=arg),
        LINK_END: then(F.concat(F.lit("]("), s["url"], F.lit(")"))),
        ITEM: F.when(in_list, s.withField("cur", F.concat(s["cur"], _bullet(s))).withField("lists", _counted(s))).otherwise(then("\n\n")),
        LIST: opened(lists=F.concat(lists, F.array(pushed))),
        LIST_END: F.when(in_list, then("\n\n", lists=F.slice(s["lists"], 1, F.size(s["lists"]) - 1))).otherwise(then()),
        SKIP: opened(skip=F.lit(1), skipped=t["tag"]),
        HEADING: opened(F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), level), F.lit(" ")), heading=F.lit(True)),
        HEADING_END: then(after_block, heading=F.lit(False), notes=no_notes),
        WRAP: opened(mark=role),
        WRAP_END: then(mark=F.lit("")),
        BREAK: opened(F.when(in_cell, " <br> ").otherwise("  \n")),
        IMAGE: opened(F.concat(F.lit("![]("), arg, F.lit(")"))),
        CHAPTER: opened(chapters=s["chapters"] + 1),
        CHAPTER_END: then(chapters=s["chapters"] - 1),
        TABLE: opened("\n\n", rows=F.lit(0), cols=F.lit(0), width=F.lit(0)),
        TABLE_END: then("\n\n", cols=F.lit(0)),
        ROW: opened("\n|", cols=F.lit(0)),
        ROW_END: F.when(s["rows"] == 0, then(header_rule, rows=F.lit(1), width=s["cols"], cols=F.lit(0)))
        .otherwise(then(pad, rows=s["rows"] + 1, cols=F.lit(0))),
        CELL: opened(" ", cols=s["cols"] + 1, blocks=F.lit(0)),
        CELL_END: then(" |", blocks=F.lit(0)),
        ASIDE: opened("("),
        ASIDE_END: then(")"),
        GAP: opened(" "),
    }

    def choose(codes: list[int]) -> Column:
        """The branch of ``op``, found by halving."""
        half = len(codes) // 2
        return F.when(op < codes[half], choose(codes[:half])).otherwise(choose(codes[half:])) if half else branches[codes[0]]

    texts, others = branches[TEXT], sorted(set(branches) - {TEXT})
    return (
        F.when(s["skip"] > 0, s.withField("depth", depth).withField("skip", skip))
        .when(op == TEXT, texts).otherwise(choose(others))
    )


def _bullet(s: Column) -> Column:
    """What begins an item of the innermost list."""
    top = F.try_element_at(s["lists"], F.lit(-1))
    bullet = F.when(top["kind"] == "1", F.concat((top["n"] + 1).cast("string"), F.lit(". "))).otherwise("- ")
    return F.concat(F.lit("\n"), F.repeat(F.lit("  "), F.size(s["lists"]) - 1), bullet)


def _counted(s: Column) -> Column:
    """The lists, one item more in the innermost."""
    top = F.try_element_at(s["lists"], F.lit(-1))
    counted = F.struct(top["kind"].alias("kind"), (top["n"] + 1).alias("n"), top["depth"].alias("depth"))
    return F.concat(F.slice(s["lists"], 1, F.size(s["lists"]) - 1), F.array(counted))


def _pick(key: Column, mapping: Mapping[str, str]) -> Column:
    return F.try_element_at(_literal_map(mapping), key) if mapping else F.lit(None).cast("string")


def _tidy(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t]*\n[ \t]*\n\s*", "\n\n")
    text = F.regexp_replace(text, r" (?<=[^\s|] ) ++(?=[^\s|])", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\A\s+|\s+\z", ""), r"(?m) (?<!  )$", "")


def _tokens_of(markup: Column, rules: Rules) -> Column:
    text = F.coalesce(markup, F.lit(""))
    if rules.any_child_is_item:
        text = _drop_title_blocks(text)
    return _token_structs(_drop_empty_marks(text, rules, markup), rules)


def _fold(tokens: Column, rules: Rules) -> Column:
    """The Markdown of a document's tokens.

    Spark copies the whole state at every step. So runs of tokens are folded with what they write in the state, about as many runs as
    tokens in a run, and the runs' texts are carried from run to run only.
    """
    start = F.struct(
        F.lit("").alias("cur"), F.array().cast(STRINGS).alias("notes"), F.lit(0).alias("notes_made"),
        F.lit(0).alias("depth"), F.lit(0).alias("skip"), F.lit("").alias("skipped"), F.lit(0).alias("chapters"),
        F.array().cast(LISTS).alias("lists"), F.lit("").alias("mark"), F.lit(False).alias("heading"),
        F.lit("").alias("url"), *[F.lit(0).alias(f) for f in ("rows", "cols", "width", "blocks")],
    )
    run = F.greatest(F.lit(RUN), F.ceil(F.sqrt(F.size(tokens))).cast("int"))

    def step(s: Column, t: Column) -> Column:
        return _step(s, t, rules)

    def whole(size: Column) -> Column:
        begin = F.struct(start.alias("state"), F.array().cast(STRINGS).alias("out"))
        runs = F.sequence(F.lit(0), F.floor(F.size(tokens) / size).cast("int"))

        def one(acc: Column, i: Column) -> Column:
            own = F.aggregate(F.slice(tokens, i * size + 1, size), acc["state"].withField("cur", F.lit("")), step)
            return let(own, lambda s: F.struct(
                s.withField("cur", F.lit("")).alias("state"), F.concat(acc["out"], F.array(s["cur"])).alias("out")
            ))

        return F.aggregate(runs, begin, one, lambda acc: F.array_join(acc["out"], ""))

    return _tidy(let(run, whole))


def sections_to_markdown(
    df: DataFrame, sections: Mapping[str, Column], rules: Rules = XML, error: str | None = "error",
    more: Column | None = None, more_out: str = "_more",
) -> DataFrame:
    """Add the Markdown of several markup columns, all converted by one fold expression.

    ``error`` names a column with the unknown tags (NULL when all are known); ``more`` is a list of
    further pieces, whose Markdown comes as a list of the same order.
    """
    names = list(sections)
    keep = [c for c in df.columns if c not in (*names, error)]
    pieces = F.array(*sections.values())
    df = df.withColumn("_markup", pieces if more is None else F.concat(pieces, more))
    df = df.withColumn("_tokens", F.transform("_markup", lambda m: _tokens_of(m, rules)))
    df = df.withColumn("_markdown", F.transform("_tokens", lambda t: _fold(t, rules)))
    cols = [F.when(F.get("_markup", i).isNotNull(), F.get("_markdown", i)).alias(n) for i, n in enumerate(names)]
    if error:
        unknown = F.array_sort(
            F.array_distinct(
                F.transform(
                    F.filter(F.flatten("_tokens"), lambda t: t["role"].isNull() & (t["d"] >= 0)), lambda t: t["tag"]
                )
            )
        )
        cols.append(F.nullif(F.array_join(unknown, ","), F.lit("")).alias(error))
    if more is not None:
        cols.append(F.slice("_markdown", len(names) + 1, F.size("_markdown")).alias(more_out))
    return df.select(*keep, *cols)


def to_markdown(df: DataFrame, col: str, out: str = "markdown", rules: Rules = XML, error: str | None = "error") -> DataFrame:
    """Add the Markdown of a markup column, and the unknown tags in it (NULL when all are known)."""
    return sections_to_markdown(df, {out: F.col(col)}, rules, error)


def _spaced(c: Column, *tags: str) -> Column:
    """Texts of the children that have any, joined by blanks."""
    texts = [F.when(F.contains(c, F.lit(t)), child_or_blank(c, t)).otherwise("") for t in tags]
    return F.array_join(F.filter(F.array(*texts), lambda x: x != ""), " ")


def _named(c: Column, *tags: str) -> Column:
    """``subtrees``; they are not looked for in a text that does not name them, which is found out much faster."""
    absent = reduce(and_, [~F.contains(c, F.lit(t)) for t in tags])
    return F.when(absent, F.array().cast(STRINGS)).otherwise(subtrees(c, *tags))


_TABLE = rf"^<{PREFIX}table[\s>]"


def _with_tables(x: Column) -> Column:
    """The text of an element and, as markup, the tables in it."""
    return F.when(F.contains(x, F.lit("table")), F.concat(F.array(text_within(without(x, "table"), x)), subtrees(x, "table"))).otherwise(
        F.array(text_within(x, x))
    )


def statute_blocks(col: str | Column) -> Column:
    """One statute as a list of blocks: header, preamble, then per section a bold head and in their order its moments, item lists and tables. Tables are
    markup still."""
    c = F.col(col) if isinstance(col, str) else col
    header = _spaced(c, "LakiehdotusNumeroKooste", "SaadostyyppiKooste", "SaadosNimekeKooste")
    preamble = F.flatten(F.transform(
        F.flatten(F.transform(_named(c, "Johtolause"), lambda j: _named(j, "SaadosKappaleKooste", "table"))), _with_tables
    ))

    def part(x: Column) -> Column:
        items = F.flatten(F.transform(
            _named(x, "MomenttiJohdantoKooste", "MomenttiKohtaKooste", "table"),
            lambda y: F.when(is_table(y), F.array(y))
            .when(y.rlike(rf"^<{PREFIX}MomenttiKohtaKooste"), let(
                _with_tables(y), lambda b: F.concat(F.array(F.concat(F.lit("- "), F.get(b, 0))), F.slice(b, 2, F.size(b)))))
            .otherwise(_with_tables(y)),
        ))
        return F.when(is_table(x), F.array(x)).when(x.rlike(rf"^<{PREFIX}KohdatMomentti"), items).otherwise(_with_tables(x))

    def section(p: Column) -> Column:
        head = _spaced(p, "PykalaTunnusKooste", "SaadosOtsikkoKooste")
        bold = F.transform(
            F.array(head), lambda h: F.when(h != "", F.concat(F.lit("**"), h, F.lit("**"))).otherwise(F.lit(""))
        )
        return F.concat(bold, F.flatten(F.transform(_named(p, "MomenttiKooste", "KohdatMomentti", "table"), part)))

    sections = F.flatten(F.transform(_named(c, "Pykala"), section))
    title = F.transform(
        F.array(header), lambda h: F.when(h != "", F.concat(F.lit("# "), h, F.lit("\n"))).otherwise(F.lit(""))
    )
    return F.filter(F.concat(title, preamble, sections), lambda b: (b != "") & (b != "- "))


def is_table(block: Column) -> Column:
    return F.contains(block, F.lit("table")) & block.rlike(_TABLE)


def statutes_of(col: str | Column) -> Column:
    """The blocks of all statutes of a document."""
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(F.flatten(F.transform(_named(c, "SaadosOsa"), lambda x: subtrees(x, "Saados"))), statute_blocks)


def joined_blocks(blocks: Column, table: Callable[[Column], Column]) -> Column:
    """Blocks as Markdown; ``table`` gives that of a table's markup."""
    each = F.transform(blocks, lambda b: F.when(is_table(b), table(b)).otherwise(b))
    return F.array_join(F.filter(each, lambda b: b != ""), "\n\n")


def joined_statutes(statutes: str | Column, table: Callable[[Column], Column]) -> Column:
    """All statutes of a document, divided by rules; NULL without any."""
    texts = F.filter(F.transform(statutes, lambda s: joined_blocks(s, table)), lambda x: x != "")
    return F.nullif(F.array_join(texts, "\n\n---\n\n"), F.lit(""))


def _table_to_markdown(markup: Column) -> Column:
    return let(_tokens_of(markup, XML), lambda t: _fold(t, XML))


def statute_to_markdown(col: str | Column) -> Column:
    return joined_blocks(statute_blocks(col), _table_to_markdown)


def law_changes(col: str | Column) -> Column:
    """All statutes of a document, divided by rules; NULL without any."""
    return joined_statutes(statutes_of(col), _table_to_markdown)


def page_sections(df: DataFrame, col: str) -> DataFrame:
    """Title, language and number of links of an HTML page."""
    return df.withColumn("title", child_text(col, "title")).withColumn(
        "lang", F.nullif(F.regexp_extract(col, r'<html[^>]*\slang="([^"]*)"', 1), F.lit(""))
    ).withColumn("links", F.size(F.regexp_extract_all(F.col(col), F.lit(r"<a\s[^>]*href="), 0)))


__all__ = [
    "HTML", "XML", "Rules", "is_table", "joined_statutes", "law_changes", "page_sections", "sections_to_markdown",
    "statute_to_markdown", "statutes_of", "subtree", "to_markdown", "without",
]
