"""Column functions for cleaning, mapping and formatting values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum import schemas


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def blank_to_null(col: str | Column) -> Column:
    return F.nullif(F.trim(_c(col)), F.lit(""))


# --- projections and code maps ------------------------------------------------


def project(df: DataFrame, mapping: Mapping[str, str | Column]) -> DataFrame:
    """Select and rename: new name -> old name or expression."""
    return df.select(*[_c(src).alias(new) for new, src in mapping.items()])


def mapped(col: str | Column, mapping: Mapping[str, str], unknown: str = "null") -> Column:
    """Look a code up in a fixed map; ``unknown`` is null, keep or error."""
    c = _c(col)
    hit = F.try_element_at(literal_map(mapping), c)
    if unknown == "null":
        return hit
    if unknown == "keep":
        return F.coalesce(hit, c)
    if unknown == "error":
        return F.when(
            c.isNotNull() & hit.isNull(), F.raise_error(F.concat(F.lit("unknown code: "), c)).cast("string")
        ).otherwise(hit)
    raise ValueError(f"unknown policy: {unknown}")


def map_codes(df: DataFrame, col: str, mapping: Mapping[str, str], unknown: str = "drop") -> DataFrame:
    """Trim and map a code column; ``unknown`` is drop, keep or error."""
    trimmed = F.trim(_c(col))
    if unknown == "drop":
        return df.where(trimmed.isin(list(mapping))).withColumn(col, mapped(trimmed, mapping))
    return df.withColumn(col, mapped(trimmed, mapping, unknown))


def map_status(code: str | Column) -> Column:
    """Handling status; no code at all means the matter is open, an unknown one passes through."""
    return F.coalesce(mapped(code, schemas.STATUS_CODES, "keep"), F.lit("open"))


def map_role(role: str | Column) -> Column:
    return mapped(F.lower(_c(role)), schemas.ROLE_CODES, "error")


def label(col: str | Column, labels: Mapping[str, str]) -> Column:
    return mapped(col, labels, "keep")


def harmonize(
    col: str | Column,
    spellings: Mapping[str, Sequence[str]] = schemas.GROUP_SPELLINGS,
    none_name: str = schemas.NO_GROUP_NAME,
) -> Column:
    """Canonical id of a group name; other names are lower-cased."""
    table = {s: canonical for canonical, names in spellings.items() for s in (canonical, *names)}
    table[none_name] = schemas.NO_GROUP
    c = _c(col)
    return F.coalesce(mapped(c, table), F.lower(c))


def drop_sentinels(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(list(values)))


def drop_empty_twins(df: DataFrame, id_col: str, body: str) -> DataFrame:
    """Keep the documents with a body; see ``lonely_empties`` for ids that have none."""
    return df.where(F.col(body).isNotNull())


def lonely_empties(df: DataFrame, id_col: str, body: str) -> DataFrame:
    """Ids none of whose rows has a body: a fault in the source, not a twin."""
    return df.groupBy(id_col).agg(F.count(body).alias("bodies")).where("bodies = 0").select(id_col)


# --- dates and times ---------------------------------------------------------------


def parse_dmy(col: str | Column) -> Column:
    """d.m.yyyy, padded or not; anything else is NULL."""
    c = F.trim(_c(col))
    return F.when(c.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(c, "d.M.yyyy"))


def complete_date(col: str | Column, side: str) -> Column:
    """A bare year becomes its first or last day; a full date stays itself."""
    c = F.trim(_c(col))
    day = {"start": "-01-01", "end": "-12-31"}[side]
    return F.when(c.rlike(r"^\d{4}$"), F.to_date(F.concat(c, F.lit(day)))).otherwise(parse_dmy(c))


def iso_utc_date(col: str | Column) -> Column:
    """UTC date of an ISO timestamp, without any zone shift."""
    return date_prefix(col)


def date_prefix(col: str | Column) -> Column:
    return F.try_to_date(F.substring(_c(col), 1, 10), "yyyy-MM-dd")


def helsinki_ts(col: str | Column) -> Column:
    """Instant of a local time string such as 2024-01-31T14:00:00."""
    local = F.replace(_c(col), F.lit("T"), F.lit(" "))
    return F.concat(F.nullif(F.trim(local), F.lit("")), F.lit(" Europe/Helsinki")).try_cast("timestamp")


# Every character with the property White_Space (fixed values).
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


# --- numbers -------------------------------------------------------------------------


def strip_quotes(col: str | Column) -> Column:
    return F.btrim(_c(col), F.lit("'"))


def parse_money(col: str | Column, empty: str | None = "0", to: str = "decimal(18,2)") -> Column:
    """Quoted text with blank thousands and a decimal comma -> number.

    ``empty`` is the text an empty amount counts as; None leaves it NULL. Text
    that is no number even then (a second comma) is NULL.
    """
    bare = F.translate(strip_quotes(col), WHITE_SPACE, "")
    amount = F.nullif(bare, F.lit(""))
    if empty is not None:
        amount = F.when(bare == "", F.lit(empty)).otherwise(bare)
    # Only the first comma is decimal; with a second one this is no number either.
    return F.translate(amount, ",", ".").try_cast(to)


def numeric_id(col: str | Column) -> Column:
    c = F.trim(_c(col))
    return F.when(c.rlike(r"^\d+$"), c).try_cast("int")


def ints_in(col: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(_c(col), F.lit(r"(\d+)"), 1), lambda x: x.try_cast("int"))


# --- ids and names ------------------------------------------------------------------------


def lower_id(col: str | Column) -> Column:
    return F.lower(_c(col))


def name_tokens(col: str | Column, i: int) -> Column:
    return F.get(F.split(_c(col), " "), i)


def doc_type(col: str | Column) -> Column:
    return F.nullif(F.regexp_extract(_c(col), r"(?U)VASKI_JULKVP_(\w+)", 1), F.lit(""))


def assembly_code(col: str | Column) -> Column:
    """Committee records end in P after the committee's code; all else is plenary."""
    c = _c(col)
    return F.when(F.endswith(c, F.lit("P")), F.left(c, F.length(c) - 1)).otherwise(F.lit(schemas.PLENARY))


def speech_id(start: str | Column, number: str | Column) -> Column:
    return F.concat(F.left(_c(start), F.lit(4)), F.lit("/"), _c(number))


def strip_party(last_name: str | Column) -> Column:
    """Drop a trailing party code from a surname of several words."""
    c = F.trim(_c(last_name))
    codes = "|".join(schemas.PARTY_SUFFIXES)
    return F.trim(F.regexp_replace(c, rf"(?i)(?<=\S)\s+[(/.,]*({codes})[)/.,]*$", ""))


def has_note(notes: str | Column, note: str = schemas.WORK_RELATED_NOTE) -> Column:
    return F.coalesce(F.array_contains(_c(notes), F.lit(note)), F.lit(False))


def url_id(col: str | Column) -> Column:
    return F.translate(_c(col), " /", "+-")


# --- text ---------------------------------------------------------------------------------------


def squash_space(col: str | Column) -> Column:
    return F.trim(F.regexp_replace(_c(col), r"(?U)\s+", " "))


def clean_title(col: str | Column) -> Column:
    return F.replace(squash_space(col), F.lit("-—"), F.lit("-"))


def truncate_words(col: str | Column, n: int = 80) -> Column:
    """First ``n`` blank-separated words and an ellipsis; short text stays, none is ''."""
    c = F.coalesce(_c(col), F.lit(""))
    words = F.split(c, " ")
    return F.when(F.size(words) <= n, c).otherwise(
        F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("..."))
    )


def ellipsize(col: str | Column) -> Column:
    """Mark a snippet that starts or stops in mid-sentence."""
    c = F.coalesce(_c(col), F.lit(""))
    head = F.when(c.rlike(r"^[a-z]"), F.concat(F.lit("..."), c)).otherwise(c)
    return F.when(head.rlike(r"[.,!?;:]\z"), head).otherwise(F.concat(head, F.lit("...")))


def text_concat(*cols: str | Column) -> Column:
    """Join with blanks, NULL counting as empty text."""
    return F.concat_ws(" ", *[F.coalesce(_c(c), F.lit("")) for c in cols])


def like_literal(q: str) -> str:
    return q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def ilike_match(col: str | Column, q: str, kind: str, parity: bool = False) -> Column:
    """Case-blind exact / prefix / substring match; ``parity`` lets % and _ in ``q`` act as wildcards."""
    text = q if parity else like_literal(q)
    pattern = {"exact": text, "prefix": f"{text}%", "substring": f"%{text}%"}[kind]
    return F.coalesce(_c(col).ilike(pattern), F.lit(False))


def boost_score(cols: Sequence[str], q: str, parity: bool = False) -> Column:
    """1.0 exact + 0.5 prefix + 0.1 substring over the best of the columns, added up."""

    def any_of(kind: str) -> Column:
        hit = F.lit(False)
        for c in cols:
            hit = hit | ilike_match(c, q, kind, parity)
        return hit

    weights = {"exact": 1.0, "prefix": 0.5, "substring": 0.1}
    score = F.lit(0.0)
    for kind, w in weights.items():
        score = score + F.when(any_of(kind), F.lit(w)).otherwise(F.lit(0.0))
    return score


def year_span(first_start: str | Column, last_end: str | Column) -> Column:
    end = _c(last_end)
    return F.concat(
        F.year(_c(first_start)).cast("string"),
        F.lit(" - "),
        F.coalesce(F.date_format(end, "yyyy-MM-dd"), F.lit("...")),
    )


def assemble_bodies(paragraphs: str | Column, chair: str | Column) -> Column:
    """Paragraphs of a speech, the chair's interventions moved to the end and labelled.

    ``chair`` is array<struct<name, text>> in order. Each intervention takes the
    first equal paragraph out of the body; one that is not there is only added.
    """
    paras = F.filter(F.transform(_c(paragraphs), lambda p: F.trim(p)), lambda p: p != "")
    said = F.filter(
        _c(chair),
        lambda c: (F.coalesce(F.trim(c["text"]), F.lit("")) != "") & (F.coalesce(c["name"], F.lit("")) != ""),
    )

    def move(body: Column, c: Column) -> Column:
        text = F.trim(c["text"])
        at = F.array_position(body, text).cast("int")
        rest = F.when(at > 0, F.concat(F.slice(body, 1, at - 1), F.slice(body, at + 1, F.size(body)))).otherwise(body)
        return F.concat(rest, F.array(F.concat(F.lit("**"), c["name"], F.lit("**: "), text)))

    body = F.aggregate(F.coalesce(said, F.array().cast("array<struct<name:string,text:string>>")), paras, move)
    return F.array_join(body, "\n\n")
