"""Minutes of the plenary and of committees (XML) -> records, agenda items, speeches, absentees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum import schemas
from plenum.functions.clean import (
    assemble_bodies, assembly_code, blank_to_null, clean_title, date_prefix, has_note, helsinki_ts, lower_id,
    numeric_id, speech_id,
)
from plenum.functions.xmltext import attribute, canonical, child_text, own_text, subtree, subtrees
from plenum.operators.nested import spread
from plenum.operators.temporal import thread_roots

KEY = ["record_assembly_code", "record_number", "record_year"]


def metadata(xml: str | Column, name: str) -> Column:
    return blank_to_null(attribute(subtree(xml, "JulkaisuMetatieto"), name))


def rollcall_link(xml: str) -> Column:
    """Link to the roll-call report among the other items of a plenary."""
    papers = F.flatten(F.transform(subtrees(xml, "MuuAsiakohta"), lambda m: subtrees(m, "KohtaAsiakirja")))
    calls = F.filter(papers, lambda p: F.contains(child_text(p, "AsiakirjatyyppiNimi"), F.lit("Nimenhuutoraportti")))
    return F.get(F.transform(calls, lambda p: attribute(p, "hyperlinkkiKoodi")), 0)


def keyed(raw: DataFrame, xml: str = "XmlData") -> DataFrame:
    """Add the record's key: assembly, number, year."""
    raw = raw.withColumn(xml, canonical(xml))
    ident = subtree(xml, "EduskuntaTunniste")
    kind = F.coalesce(child_text(ident, "AsiakirjaTyyppiTeksti"), child_text(ident, "AsiakirjatyyppiKoodi"))
    return raw.select(
        F.col(xml).alias("xml"),
        assembly_code(kind).alias("record_assembly_code"),
        numeric_id(child_text(ident, "AsiakirjaNroTeksti")).alias("record_number"),
        numeric_id(child_text(ident, "ValtiopaivavuosiTeksti")).alias("record_year"),
    )


def build_records(raw: DataFrame, xml: str = "XmlData") -> DataFrame:
    """One row per record; a missing meeting time falls back to the date of drafting."""
    docs = keyed(raw, xml)
    created = date_prefix(metadata("xml", "laadintaPvm"))
    # The minutes' own tag carries the time; only the tag is cut, not the body.
    head = F.regexp_extract("xml", r"<(?:[\w.-]+:)?(?:Kokous)?Poytakirja\s[^>]*>", 0)
    met = date_prefix(attribute(head, "kokousAloitusHetki"))
    return docs.select(
        F.col("record_assembly_code").alias("assembly_code"), F.col("record_number").alias("number"),
        F.col("record_year").alias("year"), F.coalesce(met, created).alias("meeting_date"),
        created.alias("creation_date"),
        F.when(F.col("record_assembly_code") == schemas.PLENARY, rollcall_link("xml")).alias("rollcall_id"),
    ).distinct()


def _items(raw: DataFrame, xml: str) -> DataFrame:
    items = spread(keyed(raw, xml), KEY, subtrees("xml", "Asiakohta"), "item", "item_pos")
    own_id = F.coalesce(attribute("item", "eduskuntaTunnus"), attribute("item", "muuTunnus"))
    return items.withColumn("parliament_id", lower_id(own_id))


def build_agenda_items(raw: DataFrame, xml: str = "XmlData") -> DataFrame:
    title = clean_title(own_text(subtree(subtree("item", "KohtaNimeke"), "NimekeTeksti")))
    return (
        _items(raw, xml)
        .select("parliament_id", *KEY, title.alias("title"))
        .where(F.col("title") != schemas.BAD_AGENDA_TITLE)
        .distinct()
    )


def _body(speech: str) -> Column:
    paragraphs = F.transform(
        F.flatten(F.transform(subtrees(speech, "PuheenvuoroOsa"), lambda o: subtrees(o, "KappaleKooste"))), own_text
    )
    chair = F.flatten(
        F.transform(
            subtrees(speech, "PuheenjohtajaRepliikki"),
            lambda r: F.transform(
                subtrees(r, "KappaleKooste"),
                lambda k: F.struct(child_text(r, "PuheenjohtajaTeksti").alias("name"), own_text(k).alias("text")),
            ),
        )
    )
    return assemble_bodies(paragraphs, chair)


def build_speeches(raw: DataFrame, xml: str = "XmlData") -> DataFrame:
    """Speeches of members and ministers; a response points to the last root speech before it."""
    spoken = spread(
        _items(raw, xml), [*KEY, "item_pos", F.col("parliament_id").alias("agenda_item_parliament_id")],
        subtrees("item", "PuheenvuoroToimenpide"), "speech", "speech_pos",
    )
    role = child_text("speech", "AsemaTeksti")
    started = attribute("speech", "puheenvuoroAloitusHetki")
    rows = spoken.select(
        *KEY, "agenda_item_parliament_id",
        "item_pos", "speech_pos",
        speech_id(started, attribute(subtree("speech", "PuheenvuoroOsa"), "muuTunnus")).alias("id"),
        numeric_id(attribute(subtree("speech", "Henkilo"), "muuTunnus")).alias("person_id"),
        role.alias("role"),
        helsinki_ts(started).alias("start_time"),
        _body("speech").alias("speech"),
        attribute("speech", "puheenvuoroLuokitusKoodi").alias("speech_type"),
        child_text("speech", "TarkenneTeksti").alias("note"),
    ).where(F.col("person_id").isNotNull() & (F.col("role").isNull() | F.contains("role", F.lit("ministeri"))))
    is_root = ~F.col("note").eqNullSafe(schemas.RESPONSE_NOTE)
    return thread_roots(rows, KEY, ["item_pos", "speech_pos"], is_root, "id").select(
        "id", "person_id", *KEY, "agenda_item_parliament_id", "start_time", "speech", "speech_type", "response_to"
    )


def extract_absentees(raw: DataFrame, id_col: str = "Eduskuntatunnus", xml: str = "XmlData") -> DataFrame:
    """(id, person_id, work_related) per person named in a roll-call report."""
    people = F.flatten(F.transform(subtrees(xml, "Toimija"), lambda t: subtrees(t, "Henkilo")))
    return spread(raw.withColumn(xml, canonical(xml)), [F.col(id_col).alias("id")], people, "p").select(
        "id",
        numeric_id(attribute("p", "muuTunnus")).alias("person_id"),
        has_note(F.transform(subtrees("p", "LisatietoTeksti"), own_text)).alias("work_related"),
    )
