"""Proposals, interpellations and committee reports (XML) -> typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum import schemas
from plenum.functions.clean import (
    blank_to_null, date_prefix, lonely_empties, lower_id, map_status, numeric_id,
)
from plenum.functions.markup import is_table, joined_statutes, sections_to_markdown, statutes_of
from plenum.functions.xmltext import attribute, canonical, child_text, subtree, subtrees, text_of
from plenum.operators.nested import spread
from plenum.operators.resolve import assign_key, exists_flag, lookup_first, resolve_signers
from plenum.plans.minutes import metadata

DOCUMENT_RAW = "Id string, XmlData string, Status string, Created string, Eduskuntatunnus string"
# Element that holds the body of each kind (fixed values).
BODIES = {
    "government": "HallituksenEsitys", "mp_law": "EduskuntaAloite", "mp_petition": "EduskuntaAloite",
    "interpellation": "Kysymys", "committee_report": "Mietinto",
}


def _identified(raw: DataFrame, xml: str) -> list[Column]:
    return [
        metadata(xml, "eduskuntaTunnus").alias("doc_id"), date_prefix(metadata(xml, "laadintaPvm")).alias("date"),
        F.col(xml).alias("xml"),
    ]


def _bodies(kind: str, xml: str) -> Column:
    tag = BODIES[kind]
    return F.regexp_extract_all(
        F.col(xml), F.lit(rf"(?s)<(?:[\w.-]+:)?{tag}(?=[\s>]).*</(?:[\w.-]+:)?{tag}\s*>"), 0
    )


def with_body(raw: DataFrame, kind: str, xml: str = "XmlData", unless: str | None = None) -> DataFrame:
    """(doc_id, id, date, xml, body) of the documents that have a body; empty twins are left out.

    ``id`` is the printed ``doc_id`` in lower case; documents whose ``doc_id`` begins with ``unless`` are left out. The body is cut once,
    with no filter that the optimizer could push below it and compute again.
    """
    raw = raw.withColumn(xml, canonical(xml))
    bodies = _bodies(kind, xml)
    if unless is not None:
        bodies = F.when(~F.startswith(metadata(xml, "eduskuntaTunnus"), F.lit(unless)), bodies)
    return spread(raw, _identified(raw, xml), bodies, "body").withColumn("id", lower_id("doc_id"))


def without_twin(raw: DataFrame, kind: str, xml: str = "XmlData") -> DataFrame:
    """Ids of documents that exist only without a body: faults of the source."""
    raw = raw.withColumn(xml, canonical(xml))
    rows = raw.select(*_identified(raw, xml), F.get(_bodies(kind, xml), 0).alias("body"))
    return lonely_empties(rows.withColumn("id", lower_id("doc_id")), "id", "body")


def extract_sections(
    df: DataFrame, wanted: tuple[str, ...] = ("summary", "reasoning"), body: str = "body", whole: str | None = None
) -> DataFrame:
    """Title, law changes and the wanted sections of a document body, blank ones NULL.

    Sections: summary, reasoning, opinion, motion. ``markup_error`` lists tags
    that are not understood.
    """
    parts = {
        "summary": F.array_join(subtrees(body, "AsiaKuvaus", "SisaltoKuvaus"), "\n"),
        "reasoning": subtree(body, "PerusteluOsa"),
        "opinion": F.array_join(subtrees(whole or body, "PaatosOsa"), "\n"),
        "motion": subtree(body, "PonsiOsa"),
    }
    titles = F.transform(
        F.flatten(F.transform(subtrees(body, "Nimeke"), lambda n: subtrees(n, "NimekeTeksti"))), text_of
    )
    # Tables of statutes are converted together with the sections.
    df = df.withColumn("_statutes", statutes_of(whole or body))
    df = df.withColumn("_tables", F.filter(F.flatten("_statutes"), is_table))
    df = sections_to_markdown(df, {n: parts[n] for n in wanted}, error="markup_error", more=F.col("_tables"), more_out="_shown")
    return df.withColumns(
        {
            "title": blank_to_null(F.array_join(titles, "\n\n")),
            "law_changes": joined_statutes(
                "_statutes", lambda t: F.get("_shown", F.array_position(F.col("_tables"), t).cast("int") - 1)
            ),
            **{n: blank_to_null(n) for n in wanted},
        }
    ).drop("_statutes", "_tables", "_shown")


def extract_signers(df: DataFrame, body: str = "body", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per signature with a first-name element."""
    return (
        spread(df, keys, subtrees(body, "Allekirjoittaja"), "s")
        .where(subtree("s", "EtuNimi").isNotNull())
        .select(
            *keys,
            attribute(subtree("s", "Henkilo"), "muuTunnus").alias("person_id"),
            child_text("s", "EtuNimi").alias("first_name"),
            child_text("s", "SukuNimi").alias("last_name"),
            F.coalesce(
                attribute("s", "allekirjoitusLuokitusKoodi") == schemas.FIRST_SIGNER_CLASS, F.lit(False)
            ).alias("first"),
        )
    )


def signatures(df: DataFrame, persons: DataFrame, key: str, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(one row per document and person, unresolved signers); a first signature wins over another."""
    found, missing = resolve_signers(extract_signers(df, body), persons)
    found = found.groupBy(F.col("id").alias(key), "person_id").agg(F.max("first").alias("first"))
    return found, missing


def extract_participants(df: DataFrame, xml: str = "xml") -> DataFrame:
    """(committee_report_id, person_id) of numbered participants, each once."""
    people = F.flatten(F.transform(subtrees(xml, "OsallistujaOsa"), lambda o: subtrees(o, "Henkilo")))
    return (
        spread(df, [F.col("id").alias("committee_report_id")], people, "p")
        .select("committee_report_id", numeric_id(attribute("p", "muuTunnus")).alias("person_id"))
        .dropna()
        .distinct()
    )


def status_of(handling: DataFrame, xml: str = "XmlData") -> DataFrame:
    """(doc_id, code, seq): status code of each handling document; none means open."""
    return handling.withColumn(xml, canonical(xml)).select(
        F.col("Eduskuntatunnus").alias("doc_id"),
        attribute(subtree(xml, "EduskuntakasittelyPaatosKuvaus"), "eduskuntakasittelyPaatosKoodi").alias("code"),
        F.col("Id").alias("seq"),
    )


def _proposal_columns(df: DataFrame, kind: str) -> DataFrame:
    return df.select(
        "id", F.lit(kind).alias("ptype"), "date", "title", "summary", "reasoning", "law_changes", "status"
    )


def build_government_proposals(raw: DataFrame, handling: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals, signatures); Swedish twins and documents without a body are left out."""
    docs = with_body(raw, "government", unless="RP")
    coded = lookup_first(extract_sections(docs), status_of(handling), "doc_id", "code", [F.col("seq")])
    out = coded.withColumn("status", map_status("code"))
    return _proposal_columns(out, "government"), signatures(docs, persons, "proposal_id")[0]


def build_law_proposals(raw: DataFrame, handling: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = with_body(raw, "mp_law")
    coded = lookup_first(extract_sections(docs), status_of(handling), "doc_id", "code", [F.col("seq")])
    out = coded.withColumn("status", map_status("code"))
    return _proposal_columns(out, "mp_law"), signatures(docs, persons, "proposal_id")[0]


def build_petitions(raw: DataFrame, agenda_items: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A petition counts as handled once it has been on an agenda."""
    docs = with_body(raw, "mp_petition")
    seen = agenda_items.select(F.col("parliament_id").alias("id")).where(F.startswith("id", F.lit("tpa")))
    out = exists_flag(extract_sections(docs), seen, "id", "handled", "open", "status")
    return _proposal_columns(out, "mp_petition"), signatures(docs, persons, "proposal_id")[0]


def build_interpellations(raw: DataFrame, handling: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = with_body(raw, "interpellation")
    coded = lookup_first(extract_sections(docs, ("reasoning", "motion")), status_of(handling), "doc_id", "code", [F.col("seq")])
    out = coded.withColumn("status", map_status("code"))
    return (
        out.select("id", "date", "title", "reasoning", "motion", "status"),
        signatures(docs, persons, "interpellation_id")[0],
    )


def build_committee_reports(raw: DataFrame, persons: DataFrame) -> dict[str, DataFrame]:
    """Reports, their participants, the objections in them and who signed those.

    Reports on the budget have another body and are left out.
    """
    docs = with_body(raw, "committee_report")
    ident = subtree("body", "IdentifiointiOsa")
    actors = subtrees(ident, "Toimija")
    author = F.get(F.filter(actors, lambda a: attribute(a, "rooliKoodi") == "Laatija"), 0)
    named = F.get(F.filter(actors, lambda a: subtree(a, "YhteisoTeksti").isNotNull()), 0)
    reports = extract_sections(docs, ("summary", "opinion", "reasoning"), whole="xml").select(
        "id",
        F.lower(child_text(subtree(ident, "Vireilletulo"), "EduskuntaTunnus")).alias("proposal_id"),
        "date",
        F.coalesce(child_text(author, "YhteisoTeksti"), child_text(named, "YhteisoTeksti")).alias("committee_name"),
        F.col("summary").alias("proposal_summary"), "opinion", "reasoning", "law_changes",
    )
    objections = spread(
        docs, [F.col("id").alias("committee_report_id")], subtrees("body", "JasenMielipideOsa"), "body", "i"
    ).withColumn("objection_index", F.col("i") + 1)
    objections = assign_key(objections, ["committee_report_id", "objection_index"])
    texts = extract_sections(objections, ("reasoning", "motion"))
    signed = resolve_signers(extract_signers(objections), persons)[0]
    return {
        "committee_reports": reports,
        "committee_report_signatures": extract_participants(docs),
        "objections": texts.select("id", "committee_report_id", "reasoning", "motion"),
        "objection_signatures": signed.select(F.col("id").alias("objection_id"), "person_id").distinct(),
    }
