"""The member register (one XML document per person) -> typed tables.

Input: one row per person with person_id, first name, last name and the XML.
Documents are parsed by an explicit schema, of which Spark reads the fields that
a builder needs; repeated elements are arrays, so one child or many read the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum import schemas
from plenum.functions.clean import blank_to_null, complete_date, drop_sentinels, harmonize, map_role, parse_dmy
from plenum.functions.xmltext import canonical, subtree
from plenum.operators.aggregate import union_fill
from plenum.operators.nested import concat_lists, spread
from plenum.operators.resolve import assign_key, lookup_values, not_in
from plenum.operators.temporal import distinct_values
from plenum.sources.readers import parse_xml

MEMBER_RAW = (
    "personId int, lastname string, firstname string, party string, minister string, phone string, email string, "
    "XmlDataFi string"
)
# Place of each field among the children of the root (fixed values).
CHILDREN = {
    "phone_number": 7, "email": 8, "occupation": 10, "year_of_birth": 11, "place_of_birth": 12,
    "place_of_residence": 16,
}


# The parts of a member's document that are read by name (fixed values).
_PERIODS = "Jasenyys: array<struct<AlkuPvm: string, LoppuPvm: string, Rooli: string>>"
_SEATS = f"struct<Toimielin: array<struct<_OnkoValiokunta: string, Nimi: string, {_PERIODS}>>>"
POSTS = "Jasenyys array<struct<Ministeriys: string, Nimi: string, Hallitus: string, AlkuPvm: string, LoppuPvm: string>>"
RETIRED = "KansanedustajuusPaattynytPvm string"
INTERESTS = "Sidonnaisuudet struct<Sidonnaisuus: array<struct<RyhmaOtsikko: string, Sidonta: string>>>"
GROUPS = (
    "Eduskuntaryhmat struct<NykyinenEduskuntaryhma: array<struct<Nimi: string, AlkuPvm: string>>, "
    f"EdellisetEduskuntaryhmat: struct<Eduskuntaryhma: array<struct<Nimi: string, {_PERIODS}>>>>"
)
COMMITTEES = f"{RETIRED}, NykyisetToimielinjasenyydet {_SEATS}, AiemmatToimielinjasenyydet {_SEATS}"


def _parsed(raw: DataFrame, xml: str, schema: str) -> DataFrame:
    """(personId, doc): the fields of a schema."""
    return parse_xml(raw.select("personId", xml), xml, schema).select("personId", "doc")


def _text(c: str) -> Column:
    """Text of a field, '' without one."""
    return _plain(F.col(c))


def _plain(c: Column) -> Column:
    """A parsed text has no markup left; what looks like it was written so."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def _list(docs: DataFrame, path: str) -> Column:
    return F.coalesce(F.col(path), F.array().cast(docs.select(path).schema[0].dataType))


def build_persons(raw: DataFrame, photos: DataFrame | None = None, xml: str = "XmlDataFi") -> DataFrame:
    """Persons; the register's fields are known by their place only."""

    # One XPath call, so one parse per document, returns all wanted children.
    wanted = [2, 3, *CHILDREN.values()]
    path = "concat(" + ", '\x1f', ".join(f"string(/*/*[{n}])" for n in wanted) + ")"
    raw = raw.withColumn("_children", F.split(F.xpath_string(xml, F.lit(path)), "\x1f"))

    def child(n: int) -> Column:
        return blank_to_null(F.get("_children", wanted.index(n)))

    rows = raw.select(
        F.col("personId").cast("int").alias("id"),
        F.trim("firstname").alias("first_name"),
        F.trim("lastname").alias("last_name"),
        F.concat_ws(" ", child(2), child(3)).alias("full_name"),
        *[child(n).alias(c) for c, n in CHILDREN.items()],
    ).withColumn("year_of_birth", F.col("year_of_birth").try_cast("int"))
    if photos is None:
        return rows.withColumn("photo", F.lit(None).cast("string"))
    return lookup_values(rows, photos.withColumn("id", F.col("id").try_cast("int")), "id")


def build_ministers(raw: DataFrame, xml: str = "XmlDataFi") -> tuple[DataFrame, DataFrame]:
    """(ministers, minister_positions); only posts with a ministry. Their list may stand anywhere, so it is cut out before it is parsed."""
    posts_of = subtree(canonical(xml), "ValtioneuvostonJasenyydet")
    docs = _parsed(raw.select("personId", posts_of.alias(xml)), xml, POSTS)
    posts = spread(docs, ["personId"], F.col("doc.Jasenyys"), "p")
    ministers = posts.where(_text("p.Ministeriys") != "").select(
        F.col("personId").cast("int").alias("person_id"),
        blank_to_null(_text("p.Nimi")).alias("minister_position"),
        blank_to_null(_text("p.Hallitus")).alias("cabinet_id"),
        complete_date(_text("p.AlkuPvm"), "start").alias("start_date"),
        complete_date(_text("p.LoppuPvm"), "end").alias("end_date"),
    )
    return ministers, distinct_values(ministers.withColumnRenamed("minister_position", "title"), "title")


def build_interests(raw: DataFrame, xml: str = "XmlDataFi") -> DataFrame:
    docs = _parsed(raw, xml, INTERESTS)
    rows = spread(docs, ["personId"], F.col("doc.Sidonnaisuudet.Sidonnaisuus"), "s", "pos").select(
        F.col("personId").cast("int").alias("person_id"), "pos",
        blank_to_null(_text("s.RyhmaOtsikko")).alias("category"), blank_to_null(_text("s.Sidonta")).alias("interest"),
    )
    kept = drop_sentinels(rows, "interest", schemas.NOTHING_TO_DECLARE)
    return assign_key(kept, ["person_id", "pos"]).select("id", "person_id", "category", "interest")


def _groups(raw: DataFrame, xml: str) -> DataFrame:
    """(person_id, name, periods): the current group and the former ones."""
    docs = _parsed(raw, xml, GROUPS)
    now, before = "doc.Eduskuntaryhmat.NykyinenEduskuntaryhma", "doc.Eduskuntaryhmat.EdellisetEduskuntaryhmat.Eduskuntaryhma"
    periods = docs.select(before).schema[0].dataType.elementType["Jasenyys"].dataType
    none = F.array().cast(periods)
    nothing = F.lit(None).cast("string")

    # The current group has its start next to the name, a former one has periods.
    current = F.transform(_list(docs, now), lambda g: F.struct(
        _plain(g["Nimi"]).alias("name"),
        F.array(F.struct(g["AlkuPvm"].alias("AlkuPvm"), nothing.alias("LoppuPvm"), nothing.alias("Rooli"))).cast(periods).alias("periods"),
    ))
    former = F.transform(_list(docs, before), lambda g: F.struct(
        _plain(g["Nimi"]).alias("name"), F.coalesce(g["Jasenyys"], none).alias("periods"),
    ))
    return (
        spread(docs, [F.col("personId").cast("int").alias("person_id")], concat_lists(current, former), "x")
        .select("person_id", "x.name", "x.periods")
        .where("name <> ''")
    )


def build_parliamentary_groups(raw: DataFrame, xml: str = "XmlDataFi", parity: bool = False) -> DataFrame:
    """Groups by harmonised id; an id with several spellings keeps the smallest name."""
    names = distinct_values(_groups(raw, xml), "name").select(harmonize("name").alias("id"), "name")
    return names if parity else names.groupBy("id").agg(F.min("name").alias("name"))


def build_group_memberships(raw: DataFrame, xml: str = "XmlDataFi") -> DataFrame:
    return spread(_groups(raw, xml), ["person_id", "name"], F.col("periods"), "m").select(
        harmonize("name").alias("pg_id"), "person_id",
        parse_dmy(_text("m.AlkuPvm")).alias("start_date"), parse_dmy(_text("m.LoppuPvm")).alias("end_date"),
    )


def _committees(raw: DataFrame, xml: str, serving: Callable[[Column], Column]) -> DataFrame:
    """(person_id, name, periods): current and former seats in real committees of those whose day of retirement passes.

    The day decides inside the list of seats: a filter on it would be pushed below the parsing, also below the shuffle that spreads the documents, and
    parse them there once more.
    """
    docs = _parsed(raw, xml, COMMITTEES)
    seats = F.concat(_list(docs, "doc.NykyisetToimielinjasenyydet.Toimielin"), _list(docs, "doc.AiemmatToimielinjasenyydet.Toimielin"))
    retired = complete_date(_text("doc.KansanedustajuusPaattynytPvm"), "start")
    return (
        spread(docs, [F.col("personId").cast("int").alias("person_id")], F.when(serving(retired), seats), "c")
        .select("person_id", _text("c.Nimi").alias("name"), F.col("c._OnkoValiokunta").alias("real"), F.col("c.Jasenyys").alias("periods"))
        .where("name <> '' AND real = 'true'").drop("real")
    )


def build_assemblies(spark: SparkSession, raw: DataFrame, xml: str = "XmlDataFi") -> DataFrame:
    """The assemblies that keep records, and the committees of members who retired since the cut-off."""
    fixed = spark.createDataFrame(schemas.ASSEMBLIES, "code string, name string")
    cutoff = F.lit(schemas.ASSEMBLY_RETIREMENT_CUTOFF).cast("date")
    seen = _committees(raw, xml, lambda retired: retired >= cutoff)
    found = distinct_values(seen, "name")
    return union_fill(fixed, not_in(found, fixed, ["name"]))


def build_committee_memberships(raw: DataFrame, xml: str = "XmlDataFi") -> DataFrame:
    cutoff = F.lit(schemas.COMMITTEE_RETIREMENT_CUTOFF).cast("date")
    seats = _committees(raw, xml, lambda retired: F.coalesce(retired >= cutoff, F.lit(True)))
    return (
        spread(seats, ["person_id", F.col("name").alias("committee_name")], F.col("periods"), "m")
        .where(_text("m.AlkuPvm") != "")
        .select(
            "person_id", "committee_name", complete_date(_text("m.AlkuPvm"), "start").alias("start_date"),
            complete_date(_text("m.LoppuPvm"), "end").alias("end_date"), map_role(_text("m.Rooli")).alias("role"),
        )
    )
