"""Lobbying register, campaign money and election promises -> typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum import schemas
from plenum.functions.clean import (
    iso_utc_date, mapped, name_tokens, parse_money, project, strip_quotes,
)
from plenum.operators.nested import explode_drop, explode_keep, unnest
from plenum.operators.resolve import active_persons, assign_key, resolve_by_name, semi_by_id
from plenum.operators.temporal import first_per_key

# --- raw shapes -------------------------------------------------------------------

LOBBY_COMPANY = "companyId string, otherCompanyId string, companyName string, mainIndustry string"
LOBBY_NOTIFICATION = (
    "companyId string, otherCompanyId string, termId int, topics array<struct<id:int, contactTopicOther:string, "
    "contactTopicProject:struct<projectId:string, fi:string, sv:string, en:string, createdAt:string, id:int>, "
    "contactedTargets:array<struct<contactedTargetId:int, contactMethods:array<string>, "
    "activityNotificationTopicId:int>>>>"
)
LOBBY_TARGET = "id int, fi struct<id:int, name:string, createdAt:string>"
LOBBY_TERM = "id int, reportingStartDate string, reportingEndDate string"
PROMISE = "firstName string, lastName string, promise string"
TOPIC = "topic_id string, term string"

# Header of the budget file -> our names, in file order of the wanted columns (fixed values).
BUDGET_COLUMNS = {
    "Etunimet": "first_name",
    "Sukunimi": "last_name",
    "Ehdokkaan mahdollisen tukiryhman nimi": "support_group",
    "Vaalikampanjan kulut yhteensa": "expenses_total",
    "Vaalikampanjan rahoitus yhteensa": "incomes_total",
    "2.1 Rahoitus sisaltaa omia varoja yhteensa": "income_own",
    "2.2 Rahoitus sisaltaa ehdokkaan ja tukiryhman ottamia lainoja yhteensa": "income_loan",
    "2.3 Rahoitus sisaltaa yksityishenkiloilta saatua tukea yhteensa": "income_person",
    "2.4 Rahoitus sisaltaa yrityksilta saatua tukea yhteensa": "income_company",
    "2.5 Rahoitus sisaltaa puolueelta saatua tukea yhteensa": "income_party",
    "2.6 Rahoitus sisaltaa puolueyhdistyksilta saatua tukea yhteensa": "income_party_union",
    "2.7 Rahoitus sisaltaa muilta tahoilta saatua tukea yhteensa": "income_other",
    "2.8 Rahoitus sisaltaa valitettya tukea yhteensa": "income_forwarded",
}
# Header of the funding file -> our names (fixed values).
FUNDING_COLUMNS = {
    "Tukilahteen lomakenumerot": "ftype",
    "Tukija": "funder_organization",
    "Tukijan y-tunnus/yhdistysrekisterinumero jos on": "funder_company_id",
    "Tukijan etunimet": "funder_first_name",
    "Tukijan sukunimi": "funder_last_name",
    "Tuen saajan etunimet": "first_name",
    "Tuen saajan Sukunimi": "last_name",
    "Lainan nimi": "loan_title",
    "Lainan takaisinmaksuaika/laina-aika": "loan_schedule",
    "Tuen maara": "amount",
}
BUDGET_AMOUNTS = [
    "expenses_total", "incomes_total", "income_own", "income_loan", "income_person", "income_company",
    "income_party", "income_party_union", "income_forwarded", "income_other",
]


# --- lobbying ------------------------------------------------------------------------


def build_lobbies(companies: DataFrame) -> DataFrame:
    """One row per lobby (id, name, industry): a row with an industry wins over one without."""
    rows = companies.select(
        F.coalesce("companyId", "otherCompanyId").alias("id"),
        F.col("companyName").alias("name"),
        F.col("mainIndustry").alias("industry"),
    )
    return first_per_key(rows, ["id"], "industry", ["name"])


def notifications(raw: DataFrame) -> DataFrame:
    """The register's JSON in the shape the lobbying jobs use."""
    topics = F.transform(
        "topics",
        lambda t: F.when(
            t.isNotNull(),
            F.struct(
                t["id"].alias("id"),
                t["contactTopicProject"]["fi"].alias("fi"),
                t["contactTopicOther"].alias("other"),
                t["contactTopicProject"]["projectId"].alias("project"),
                F.transform(
                    t["contactedTargets"],
                    lambda x: F.struct(x["contactedTargetId"].alias("target_id"), x["contactMethods"].alias("methods")),
                ).alias("targets"),
            ),
        ),
    )
    return raw.select(
        F.col("companyId").alias("company_id"), F.col("otherCompanyId").alias("other_company_id"),
        F.col("termId").alias("term_id"), topics.alias("topics"),
    )


def topic_rows(notified: DataFrame) -> DataFrame:
    """One row per notified topic; notifications without topics only register a lobby."""
    t = explode_drop(notified.select("company_id", "other_company_id", "term_id", "topics"), "topics")
    return unnest(t, "topics").select(
        F.coalesce("company_id", "other_company_id").alias("lobby_id"),
        "term_id",
        F.col("id").alias("topic_id"),
        F.coalesce("fi", "other").alias("topic"),
        "project",
        "targets",
    )


def build_lobby_topics(notified: DataFrame, parity: bool = False) -> DataFrame:
    """Topics; an id with several texts keeps the smallest, unless ``parity`` asks for all."""
    rows = topic_rows(notified).select(F.col("topic_id").alias("id"), "topic", "project")
    if parity:
        return rows.distinct()
    return (
        rows.groupBy("id").agg(F.min(F.struct("topic", "project")).alias("t")).select("id", "t.topic", "t.project")
    )


def match_targets(targets: DataFrame, active: DataFrame, wanted: DataFrame) -> DataFrame:
    """(person_id, target_id) of contacted targets that carry an active member's name."""
    named = targets.where(~F.col("name").isin("-", "")).select(
        F.col("id").alias("target_id"),
        name_tokens("name", 0).alias("first_name"),
        name_tokens("name", 1).alias("last_name"),
    )
    return semi_by_id(resolve_by_name(named, active).select("person_id", "target_id"), wanted, ["target_id"])


def build_lobby_actions(notified: DataFrame, targets: DataFrame, memberships: DataFrame, persons: DataFrame) -> DataFrame:
    """One row per lobby, topic, contacted member and contact method."""
    contacts = unnest(explode_keep(topic_rows(notified).drop("topic", "project"), "targets"), "targets")
    contacts = explode_keep(contacts, "methods").where(F.col("target_id").isNotNull())
    active = active_persons(memberships, persons, schemas.LOBBY_TARGET_CUTOFF)
    matched = match_targets(targets, active, contacts.select("target_id").distinct())
    return contacts.join(matched, "target_id").select(
        "lobby_id", "term_id", "person_id", "topic_id", F.col("methods").alias("contact_method")
    )


def build_lobby_terms(raw: DataFrame) -> DataFrame:
    return project(
        raw,
        {"id": "id", "start_date": iso_utc_date("reportingStartDate"), "end_date": iso_utc_date("reportingEndDate")},
    )


def build_topics(raw: DataFrame) -> DataFrame:
    return raw.select("topic_id", "term")


# --- campaign money ----------------------------------------------------------------------


def build_election_budgets(raw: DataFrame, memberships: DataFrame, persons: DataFrame) -> DataFrame:
    """Campaign budgets of today's members; an empty amount is 0."""
    amounts = [parse_money(c).alias(c) for c in BUDGET_AMOUNTS]
    rows = raw.select(
        strip_quotes("first_name").alias("first_name"),
        strip_quotes("last_name").alias("last_name"),
        strip_quotes("support_group").alias("support_group"),
        F.lit(schemas.ELECTION_YEAR).alias("election_year"),
        *amounts,
    )
    return resolve_by_name(rows, active_persons(memberships, persons)).select(
        "person_id", "support_group", "election_year", *BUDGET_AMOUNTS
    )


def build_election_fundings(raw: DataFrame, memberships: DataFrame, persons: DataFrame) -> DataFrame:
    """Single contributions to today's members; an empty amount stays NULL for the audit to find."""
    texts = [
        "funder_organization", "funder_company_id", "funder_first_name", "funder_last_name", "loan_title",
        "loan_schedule",
    ]
    rows = raw.select(
        strip_quotes("first_name").alias("first_name"),
        strip_quotes("last_name").alias("last_name"),
        F.lit(schemas.ELECTION_YEAR).alias("election_year"),
        mapped(strip_quotes("ftype"), schemas.FUNDING_CODES, "keep").alias("ftype"),
        *[strip_quotes(c).alias(c) for c in texts],
        parse_money("amount", empty=None).alias("amount"),
    )
    return resolve_by_name(rows, active_persons(memberships, persons)).select(
        "person_id", "election_year", "ftype", *texts, "amount"
    )


def build_promises(raw: DataFrame, memberships: DataFrame, persons: DataFrame) -> DataFrame:
    rows = raw.select(
        mapped("firstName", schemas.NICKNAMES, "keep").alias("first_name"),
        F.col("lastName").alias("last_name"),
        "promise",
        F.lit(schemas.ELECTION_YEAR).alias("election_year"),
    )
    out = resolve_by_name(rows, active_persons(memberships, persons))
    return assign_key(out, ["person_id", "promise"]).select("id", "person_id", "promise", "election_year")
