"""Table schemas, enums and the fixed values of the domain."""

from __future__ import annotations

# --- fixed values: enums, in ordinal order ---------------------------------
VOTES = ["yes", "no", "abstain", "absent"]
PROPOSAL_TYPES = ["government", "citizen", "mp_law", "mp_petition", "mp_debate"]
STATUSES = [
    "open", "handled", "expired", "cancelled", "rejected", "resting",
    "passed", "passed_changed", "passed_urgent", "replied", "dealt",
]
FUNDER_TYPES = ["loan", "person", "company", "party", "party_union", "other", "forwarded"]

# --- fixed values: code maps ------------------------------------------------
VOTE_CODES = {"Jaa": "yes", "Ei": "no", "Poissa": "absent", "Tyhjää": "abstain"}
VOTE_LABELS = {"yes": "Jaa", "no": "Ei", "abstain": "Tyhjä", "absent": "Poissa"}
STATUS_CODES = {
    "Expired": "expired",
    "Cancelled": "cancelled",
    "Rejected": "rejected",
    "Resting": "resting",
    "Passed": "passed",
    "Replied": "replied",
    "Dealt": "dealt",
    "PassedChanged": "passed_changed",
    "PassedUrgent": "passed_urgent",
}
STATUS_LABELS = {
    "open": "Avoin",
    "expired": "Vanhentunut",
    "resting": "Hyllytetty",
    "handled": "Käsitelty",
    "passed": "Hyväksytty",
    "passed_changed": "Hyväksytty muutettuna",
    "passed_urgent": "Hyväksytty kiireellisenä",
    "rejected": "Hylätty",
    "cancelled": "Peruttu",
}
ROLE_CODES = {
    "jäsen": "member",
    "varajäsen": "associate",
    "lisäjäsen": "additional",
    "puheenjohtaja": "chair",
    "varapuheenjohtaja": "first vice",
    "ensimmäinen varapuheenjohtaja": "first vice",
    "toinen varapuheenjohtaja": "second vice",
}
ROLE_LABELS = {
    "member": "jäsen",
    "associate": "varajäsen",
    "additional": "lisäjäsen",
    "chair": "puheenjohtaja",
    "first vice": "ensimmäinen varapuheenjohtaja",
    "second vice": "toinen varapuheenjohtaja",
}
FUNDING_CODES = {
    "2.2": "loan",
    "2.3": "person",
    "2.4": "company",
    "2.5": "party",
    "2.6": "party_union",
    "2.7": "other",
    "2.8": "forwarded",
}
SPEECH_TYPE_LABELS = {
    "E": "Esittelypuheenvuoro",
    "V": "Vastauspuheenvuoro",
    "N": "Nopeatahtinen keskustelu",
    "R": "Ryhmäpuheenvuoro",
    "T": "",
    " ": "",
}
PARTY_LABELS = {
    "kd": "KD", "kesk": "Kesk.", "kok": "Kok.", "liik": "Liik.", "ps": "PS",
    "r": "RKP", "sd": "SDP", "vas": "Vas.", "vihr": "Vihr.",
}

# --- fixed values: spellings of the parliamentary groups ----------------------
GROUP_SPELLINGS = {
    "vas": ["Vasemmistoliiton eduskuntaryhmä", "Left Alliance Parliamentary Group"],
    "kok": [
        "Kansallisen kokoomuksen eduskuntaryhmä",
        "Parliamentary Group of the National Coalition parliamentary_group",
    ],
    "ps": ["Perussuomalaisten eduskuntaryhmä", "The Finns parliamentary_group Parliamentary Group"],
    "vihr": ["Vihreä eduskuntaryhmä", "Green Parliamentary Group"],
    "sd": ["Sosialidemokraattinen eduskuntaryhmä", "Social Democratic Parliamentary Group"],
    "kd": ["Kristillisdemokraattinen eduskuntaryhmä", "Christian Democratic Parliamentary Group"],
    "kesk": ["Keskustan eduskuntaryhmä", "Centre parliamentary_group Parliamentary Group"],
    "r": ["Ruotsalainen eduskuntaryhmä", "Swedish Parliamentary Group"],
    "liik": ["Liike Nyt -eduskuntaryhmä", "Liike Nyt-Movement's Parliamentary Group"],
}
NO_GROUP_NAME = "Eduskuntaryhmään kuulumaton"
NO_GROUP = "-"
PARTY_SUFFIXES = ["ps", "kok", "vihr", "sd", "r", "liik", "kesk", "vas"]

# --- fixed values: sentinels, exclusions and cut-offs ---------------------------
NOTHING_TO_DECLARE = ["Ei ilmoitettavia sidonnaisuuksia", "Ei ilmoitettavia tuloja"]
BAD_ROLLCALL_IDS = ["EDK-2016-AK-99126", "00000000-0000-0000-0000-000000000000"]
BAD_AGENDA_TITLE = "Tilapäisen puheenjohtajan valinta"
POST_CATEGORIES = [
    "Hallinto- ja luottamustehtävät yksityisissä yrityksissä, yhteisöissä sekä julkisyhteisöissä",
    "Valtion, kunnan ja muiden julkisyhteisöjen virat",
]
ASSEMBLY_RETIREMENT_CUTOFF = "2000-01-01"
COMMITTEE_RETIREMENT_CUTOFF = "2010-01-01"
LOBBY_TARGET_CUTOFF = "2024-01-01"
ELECTION_YEAR = 2023
PLENARY = "EK"
RESPONSE_NOTE = "(vastauspuheenvuoro)"
WORK_RELATED_NOTE = "(e)"
FIRST_SIGNER_CLASS = "EnsimmainenAllekirjoittaja"
NICKNAMES = {'Ritva "Kike"': "Ritva"}

# --- fixed values: assemblies that keep records -----------------------------------
ASSEMBLIES = [
    ("HaV", "Hallintovaliokunta"),
    ("LaV", "Lakivaliokunta"),
    ("LiV", "Liikenne- ja viestintävaliokunta"),
    ("MmV", "Maa- ja metsätalousvaliokunta"),
    ("PeV", "Perustuslakivaliokunta"),
    ("PmN", "Puhemiesneuvosto"),
    ("EK", "Eduskunnan täysistunto"),
    ("PuV", "Puolustusvaliokunta"),
    ("SiV", "Sivistysvaliokunta"),
    ("StV", "Sosiaali- ja terveysvaliokunta"),
    ("SuV", "Suuri valiokunta"),
    ("TaV", "Talousvaliokunta"),
    ("TrV", "Tarkastusvaliokunta"),
    ("TuV", "Tulevaisuusvaliokunta"),
    ("TyV", "Työelämä- ja tasa-arvovaliokunta"),
    ("UaV", "Ulkoasiainvaliokunta"),
    ("VaV", "Valtiovarainvaliokunta"),
    ("YmV", "Ympäristövaliokunta"),
    ("SuVtJ", "Suuren valiokunnan jaosto"),
    ("TiV", "Tiedusteluvalvontavaliokunta"),
]

# --- table schemas ------------------------------------------------------------------
# name -> (columns as DDL, key columns, required columns)
TABLES: dict[str, tuple[str, list[str], list[str]]] = {
    "persons": (
        "id int, first_name string, last_name string, full_name string, phone_number string, "
        "email string, occupation string, year_of_birth int, place_of_birth string, "
        "place_of_residence string, photo string",
        ["id"], ["id"],
    ),
    "minister_positions": ("title string", ["title"], ["title"]),
    "ministers": (
        "person_id int, minister_position string, cabinet_id string, start_date date, end_date date",
        ["minister_position", "person_id", "start_date"],
        ["minister_position", "person_id", "start_date"],
    ),
    "interests": ("id bigint, person_id int, category string, interest string", ["id"], ["id"]),
    "ballots": (
        "id int, title string, session_item_title string, start_time timestamp, "
        "parliament_id string, minutes_url string, results_url string",
        ["id"], ["id"],
    ),
    "votes": ("ballot_id int, person_id int, vote string", ["ballot_id", "person_id"], ["ballot_id", "person_id"]),
    "parliamentary_groups": ("id string, name string", ["id"], ["id"]),
    "mp_parliamentary_group_memberships": (
        "pg_id string, person_id int, start_date date, end_date date",
        ["pg_id", "person_id", "start_date"], ["pg_id", "person_id", "start_date"],
    ),
    "assemblies": ("code string, name string", ["name"], ["name"]),
    "mp_committee_memberships": (
        "person_id int, committee_name string, start_date date, end_date date, role string",
        ["person_id", "committee_name", "start_date", "role"],
        ["person_id", "committee_name", "start_date", "role"],
    ),
    "records": (
        "assembly_code string, number int, year int, meeting_date date, creation_date date, rollcall_id string",
        ["assembly_code", "number", "year"],
        ["assembly_code", "number", "year", "meeting_date", "creation_date"],
    ),
    "absences": (
        "id bigint, person_id int, record_assembly_code string, record_number int, record_year int, "
        "work_related boolean",
        ["id"], ["id", "person_id", "record_assembly_code", "record_number", "record_year"],
    ),
    "agenda_items": (
        "parliament_id string, record_assembly_code string, record_number int, record_year int, title string",
        ["parliament_id", "record_assembly_code", "record_number", "record_year"],
        ["parliament_id", "record_assembly_code", "record_number", "record_year", "title"],
    ),
    "speeches": (
        "id string, person_id int, record_assembly_code string, record_number int, record_year int, "
        "agenda_item_parliament_id string, start_time timestamp, speech string, speech_type string, "
        "response_to string",
        ["id"], ["id", "person_id", "start_time", "speech", "speech_type"],
    ),
    "proposals": (
        "id string, ptype string, date date, title string, summary string, reasoning string, "
        "law_changes string, status string",
        ["id"], ["id", "date", "status"],
    ),
    "proposal_signatures": (
        "proposal_id string, person_id int, first boolean", ["proposal_id", "person_id"], ["proposal_id", "person_id"],
    ),
    "topics": ("topic_id string, term string", ["topic_id"], ["topic_id"]),
    "committee_reports": (
        "id string, proposal_id string, date date, committee_name string, proposal_summary string, "
        "opinion string, reasoning string, law_changes string",
        ["id"], ["id", "proposal_id", "date", "committee_name", "proposal_summary", "opinion"],
    ),
    "committee_budget_reports": (
        "id string, proposal_id string, committee_name string", ["id"], ["id", "proposal_id", "committee_name"],
    ),
    "committee_report_signatures": (
        "committee_report_id string, person_id int",
        ["committee_report_id", "person_id"], ["committee_report_id", "person_id"],
    ),
    "objections": ("id bigint, committee_report_id string, reasoning string, motion string", ["id"], ["id"]),
    "objection_signatures": (
        "objection_id bigint, person_id int", ["objection_id", "person_id"], ["objection_id", "person_id"],
    ),
    "interpellations": (
        "id string, date date, title string, reasoning string, motion string, status string",
        ["id"], ["id", "date", "title"],
    ),
    "interpellation_signatures": (
        "interpellation_id string, person_id int, first boolean",
        ["interpellation_id", "person_id"], ["interpellation_id", "person_id"],
    ),
    "election_seasons": ("start_date date, end_date date", ["start_date"], ["start_date"]),
    "lobbies": ("id string, name string, industry string", ["id"], ["id", "name"]),
    "lobby_topics": ("id int, topic string, project string", ["id"], ["id", "topic"]),
    "lobby_terms": ("id int, start_date date, end_date date", ["id"], ["id"]),
    "lobby_actions": (
        "id bigint, term_id int, lobby_id string, person_id int, topic_id int, contact_method string",
        ["id"], ["id", "term_id", "lobby_id", "person_id", "topic_id"],
    ),
    "election_fundings": (
        "id bigint, person_id int, election_year int, ftype string, funder_organization string, "
        "funder_company_id string, funder_first_name string, funder_last_name string, loan_title string, "
        "loan_schedule string, amount decimal(18,2)",
        ["id"], ["id", "person_id", "election_year", "ftype", "amount"],
    ),
    "election_budgets": (
        "person_id int, support_group string, election_year int, expenses_total decimal(18,2), "
        "incomes_total decimal(18,2), income_own decimal(18,2), income_loan decimal(18,2), "
        "income_person decimal(18,2), income_company decimal(18,2), income_party decimal(18,2), "
        "income_party_union decimal(18,2), income_forwarded decimal(18,2), income_other decimal(18,2)",
        ["person_id", "election_year"],
        ["person_id", "election_year", "expenses_total", "incomes_total"],
    ),
    "promises": (
        "id bigint, person_id int, promise string, election_year int",
        ["id"], ["id", "person_id", "promise", "election_year"],
    ),
}

# child columns -> parent table and columns
REFERENCES: list[tuple[str, list[str], str, list[str]]] = [
    ("ministers", ["person_id"], "persons", ["id"]),
    ("ministers", ["minister_position"], "minister_positions", ["title"]),
    ("interests", ["person_id"], "persons", ["id"]),
    ("votes", ["ballot_id"], "ballots", ["id"]),
    ("votes", ["person_id"], "persons", ["id"]),
    ("mp_parliamentary_group_memberships", ["pg_id"], "parliamentary_groups", ["id"]),
    ("mp_parliamentary_group_memberships", ["person_id"], "persons", ["id"]),
    ("mp_committee_memberships", ["committee_name"], "assemblies", ["name"]),
    ("records", ["assembly_code"], "assemblies", ["code"]),
    ("absences", ["person_id"], "persons", ["id"]),
    ("absences", ["record_assembly_code", "record_number", "record_year"],
     "records", ["assembly_code", "number", "year"]),
    ("agenda_items", ["record_assembly_code", "record_number", "record_year"],
     "records", ["assembly_code", "number", "year"]),
    ("speeches", ["person_id"], "persons", ["id"]),
    ("speeches",
     ["record_assembly_code", "record_number", "record_year", "agenda_item_parliament_id"],
     "agenda_items",
     ["record_assembly_code", "record_number", "record_year", "parliament_id"]),
    ("speeches", ["response_to"], "speeches", ["id"]),
    ("proposal_signatures", ["proposal_id"], "proposals", ["id"]),
    ("proposal_signatures", ["person_id"], "persons", ["id"]),
    ("committee_reports", ["committee_name"], "assemblies", ["name"]),
    ("committee_report_signatures", ["committee_report_id"], "committee_reports", ["id"]),
    ("committee_report_signatures", ["person_id"], "persons", ["id"]),
    ("objections", ["committee_report_id"], "committee_reports", ["id"]),
    ("objection_signatures", ["objection_id"], "objections", ["id"]),
    ("objection_signatures", ["person_id"], "persons", ["id"]),
    ("interpellation_signatures", ["interpellation_id"], "interpellations", ["id"]),
    ("interpellation_signatures", ["person_id"], "persons", ["id"]),
    ("lobby_actions", ["term_id"], "lobby_terms", ["id"]),
    ("lobby_actions", ["lobby_id"], "lobbies", ["id"]),
    ("lobby_actions", ["person_id"], "persons", ["id"]),
    ("lobby_actions", ["topic_id"], "lobby_topics", ["id"]),
    ("election_fundings", ["person_id"], "persons", ["id"]),
    ("election_budgets", ["person_id"], "persons", ["id"]),
    ("promises", ["person_id"], "persons", ["id"]),
    ("committee_budget_reports", ["committee_name"], "assemblies", ["name"]),
]

# column -> allowed values
DOMAINS: dict[str, dict[str, list[str]]] = {
    "votes": {"vote": VOTES},
    "proposals": {"ptype": PROPOSAL_TYPES, "status": STATUSES},
    "interpellations": {"status": STATUSES},
    "election_fundings": {"ftype": FUNDER_TYPES},
}

# column -> greatest length
LENGTHS: dict[str, dict[str, int]] = {
    "persons": {
        "first_name": 200, "last_name": 200, "full_name": 200, "phone_number": 50, "email": 200,
        "occupation": 200, "place_of_birth": 200, "place_of_residence": 200, "photo": 100,
    },
    "minister_positions": {"title": 100},
    "ministers": {"minister_position": 100, "cabinet_id": 50},
    "interests": {"category": 200},
    "ballots": {
        "title": 500, "session_item_title": 2000, "parliament_id": 50, "minutes_url": 200, "results_url": 200,
    },
    "parliamentary_groups": {"id": 100, "name": 100},
    "mp_parliamentary_group_memberships": {"pg_id": 100},
    "assemblies": {"code": 10, "name": 100},
    "mp_committee_memberships": {"committee_name": 200, "role": 50},
    "records": {"assembly_code": 10, "rollcall_id": 20},
    "absences": {"record_assembly_code": 10},
    "agenda_items": {"parliament_id": 20, "record_assembly_code": 10},
    "speeches": {
        "id": 15, "record_assembly_code": 10, "agenda_item_parliament_id": 20, "speech_type": 1, "response_to": 15,
    },
    "proposals": {"id": 20, "title": 1000},
    "proposal_signatures": {"proposal_id": 20},
    "topics": {"topic_id": 10, "term": 200},
    "committee_reports": {"id": 20, "proposal_id": 20, "committee_name": 200},
    "committee_budget_reports": {"id": 20, "proposal_id": 20, "committee_name": 200},
    "committee_report_signatures": {"committee_report_id": 20},
    "objections": {"committee_report_id": 20},
    "interpellations": {"id": 20, "title": 1000},
    "interpellation_signatures": {"interpellation_id": 20},
    "lobbies": {"id": 20, "name": 200, "industry": 200},
    "lobby_topics": {"topic": 1000, "project": 20},
    "lobby_actions": {"lobby_id": 20, "contact_method": 50},
    "election_fundings": {
        "funder_organization": 200, "funder_company_id": 20, "funder_first_name": 100,
        "funder_last_name": 100, "loan_title": 200, "loan_schedule": 200,
    },
    "election_budgets": {"support_group": 200},
    "promises": {"promise": 1000},
}


def columns_of(table: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a table, in load order."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(TABLES[table][0])
    return [(f.name, f.dataType.simpleString()) for f in schema]
