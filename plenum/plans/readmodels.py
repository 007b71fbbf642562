"""Read models, each built for all persons, proposals or items in one job.

Lists are nested in parts (see ``nest_sorted``): ``part`` is 0 for every key
whose list fits one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum import schemas
from plenum.functions.clean import label, truncate_words, url_id, year_span
from plenum.operators.aggregate import bundle_latest, group_rows, page, true_first
from plenum.operators.nested import nest_sorted
from plenum.operators.resolve import count_per_key
from plenum.operators.temporal import dedupe_by, latest_interval


def _descending(ts: str) -> Column:
    return -F.unix_micros(F.col(ts).cast("timestamp"))


def _by_start(*ties: str) -> list[Column]:
    """Ascending start, an unknown one last."""
    return [F.col("start_date").isNull(), F.col("start_date"), *[F.col(t) for t in ties]]


def attach_lists(base: DataFrame, key: str, lists: dict[str, DataFrame]) -> DataFrame:
    """Join nested lists to their owners part by part; an owner without any gets empty ones."""
    parts: DataFrame | None = None
    for nested in lists.values():
        parts = nested if parts is None else parts.join(nested, [key, "part"], "full_outer")
    out = base.join(parts, key, "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    for into, nested in lists.items():
        out = out.withColumn(into, F.coalesce(into, F.array().cast(nested.schema[into].dataType)))
    return out


# --- persons ------------------------------------------------------------------------


def nested_groups(memberships: DataFrame, groups: DataFrame | None = None, **kw) -> DataFrame:
    """Memberships per person by start, with the group's name when given."""
    m = memberships
    if groups is not None:
        m = m.join(groups.select(F.col("id").alias("pg_id"), "name"), "pg_id")
    fields = ["pg_id", *(["name"] if groups is not None else []), "start_date", "end_date"]
    order = [*_by_start("pg_id"), F.col("end_date").isNull(), F.col("end_date")]
    return nest_sorted(
        m.select(F.col("person_id").alias("id"), *fields), ["id"], order, fields, "parliamentary_groups", **kw
    )


def nested_posts(ministers: DataFrame, **kw) -> DataFrame:
    fields = [F.col("minister_position").alias("name"), F.col("start_date"), F.col("end_date")]
    order = [*_by_start("minister_position"), F.col("end_date").isNull(), F.col("end_date")]
    return nest_sorted(
        ministers.select(F.col("person_id").alias("id"), "minister_position", "start_date", "end_date"),
        ["id"], order, fields, "minister_positions", **kw,
    )


def person_list(persons: DataFrame, memberships: DataFrame, groups: DataFrame | None, ministers: DataFrame) -> DataFrame:
    """Person with nested groups and minister posts."""
    return attach_lists(
        persons, "id",
        {"parliamentary_groups": nested_groups(memberships, groups), "minister_positions": nested_posts(ministers)},
    )


def current_state(memberships: DataFrame, by: Sequence[str] = ("pg_id",)) -> DataFrame:
    """The last membership per person in the order the lists have."""
    return latest_interval(memberships, ["person_id"], "last_by_start", ties=[*by])


def active_list(persons: DataFrame, memberships: DataFrame) -> DataFrame:
    """Persons whose last membership is open, and persons without any."""
    last = current_state(memberships).select(F.col("person_id").alias("id"), "pg_id", "end_date")
    return persons.join(last, "id", "left").where(F.col("end_date").isNull()).drop("end_date")


def person_page(persons: DataFrame, memberships: DataFrame, size: int = 20, number: int = 0) -> DataFrame:
    return page(active_list(persons, memberships), [F.col("last_name").asc_nulls_last(), F.col("id")], size, number)


def person_cards(persons: DataFrame, memberships: DataFrame, ministers: DataFrame) -> DataFrame:
    """List item: current group, and the last minister post if it is still held."""
    post = latest_interval(ministers, ["person_id"], "last_by_start", ties=["minister_position"]).select(
        F.col("person_id").alias("id"),
        F.when(F.col("end_date").isNull(), F.col("minister_position")).alias("minister_position"),
    )
    return active_list(persons, memberships).join(post, "id", "left")


def person_header(persons: DataFrame, memberships: DataFrame) -> DataFrame:
    """Current group, former groups in order of entry, and the years of service.

    Works on one row per (person, group), so it never gathers a person's periods.
    """
    m = memberships
    per_group = m.groupBy("person_id", "pg_id").agg(F.min("start_date").alias("first_start"))
    last = current_state(m).select("person_id", F.col("pg_id").alias("current"), F.col("end_date").alias("last_end"))
    first = m.groupBy("person_id").agg(F.min("start_date").alias("first_start"))
    former = (
        per_group.join(last.select("person_id", "current"), "person_id")
        .where((F.col("pg_id") != F.col("current")) & (F.col("pg_id") != schemas.NO_GROUP))
    )
    former = nest_sorted(
        former, ["person_id"], [F.col("first_start"), F.col("pg_id")], ["pg_id"], "former"
    ).withColumn("former", F.transform("former", lambda x: x["pg_id"]))
    head = last.join(first, "person_id").select(
        F.col("person_id").alias("id"), "current", year_span("first_start", "last_end").alias("years")
    )
    return attach_lists(
        persons.select("id", "first_name", "last_name").join(head, "id"),
        "id", {"former": former.withColumnRenamed("person_id", "id")},
    )


def person_votes(votes: DataFrame, ballots: DataFrame) -> DataFrame:
    """Votes cast by each person with their ballots; newest first within a person."""
    b = ballots.withColumnRenamed("id", "ballot_id")
    return votes.where(F.col("vote").isNotNull()).join(b, "ballot_id", "left").withColumn(
        "vote_label", label("vote", schemas.VOTE_LABELS)
    )


def newest_first(df: DataFrame, owner: str, time: str, tie: str) -> DataFrame:
    """Presentation order; a range sort, so a busy owner spreads over partitions."""
    return df.orderBy(owner, F.col(time).desc_nulls_last(), F.col(tie).desc())


def person_vote_bundles(votes: DataFrame, ballots: DataFrame, **kw) -> DataFrame:
    """A person's votes bundled by item, the header taken from the latest ballot."""
    return bundle_latest(
        person_votes(votes, ballots),
        ["person_id", "parliament_id"],
        F.struct("start_time", "ballot_id"),
        ["start_time", "minutes_url", "session_item_title"],
        [_descending("start_time"), -F.col("ballot_id")],
        ["ballot_id", "title", "vote", "results_url"],
        "ballots",
        **kw,
    )


def person_speeches(speeches: DataFrame, agenda_items: DataFrame, parity: bool = False) -> DataFrame:
    """Speeches with the title of their item.

    An item occurs in several records, so the join by its id alone fans out; one
    row per speech stays. ``parity`` keeps one row per person and start time.
    """
    titles = agenda_items.select(F.col("parliament_id").alias("agenda_item_parliament_id"), "title")
    if not parity:
        one = titles.groupBy("agenda_item_parliament_id").agg(F.min("title").alias("title"))
        return dedupe_by(
            speeches.join(one, "agenda_item_parliament_id"), ["id"], [F.col("start_time"), F.col("title")]
        )
    return dedupe_by(
        speeches.join(titles.distinct(), "agenda_item_parliament_id"),
        ["person_id", "start_time"], [F.col("id"), F.col("title")],
    )


def own_initiatives(signatures: DataFrame, proposals: DataFrame, words: int = 80) -> DataFrame:
    """Proposals a person is the first signer of, the government's aside."""
    own = signatures.where(F.col("first").eqNullSafe(F.lit(True))).select("proposal_id", "person_id")
    return own.join(
        proposals.where(F.col("ptype") != "government").withColumnRenamed("id", "proposal_id"), "proposal_id"
    ).select(
        "person_id", "proposal_id", "title", "date",
        truncate_words(F.coalesce("summary", "reasoning"), words).alias("excerpt"),
        label("status", schemas.STATUS_LABELS).alias("status_label"),
        url_id("proposal_id").alias("url_id"),
    )


def committee_roles(committee_memberships: DataFrame, **kw) -> DataFrame:
    return group_rows(
        committee_memberships.withColumn("role_label", label("role", schemas.ROLE_LABELS)),
        ["person_id"], "committee_name",
        [*_by_start("role"), F.col("end_date").isNull(), F.col("end_date")],
        ["role_label", "start_date", "end_date"], "roles", **kw,
    )


def interests_by_category(
    interests: DataFrame, posts: bool, categories: Sequence[str] = tuple(schemas.POST_CATEGORIES), **kw
) -> DataFrame:
    """Interests in the post categories (``posts``) or in all others; no category counts in neither."""
    wanted = F.col("category").isin(list(categories))
    return group_rows(
        interests.where(wanted if posts else ~wanted), ["person_id"], "category",
        [F.col("interest"), F.col("id")], ["interest"], "interests", **kw,
    )


def person_promises(promises: DataFrame) -> DataFrame:
    return promises.select("person_id", "promise", "election_year")


# --- proposals -----------------------------------------------------------------------------


def proposal_signatures(signatures: DataFrame, persons: DataFrame, memberships: DataFrame, **kw) -> DataFrame:
    """Signers per proposal, first signers on top, each with the group last entered.

    A signer who never belonged to a group is left out.
    """
    group = latest_interval(memberships, ["person_id"], "by_start", ties=["pg_id"]).select(
        "person_id", F.col("pg_id").alias("party_id")
    )
    signers = persons.withColumnRenamed("id", "person_id").join(group, "person_id")
    rows = signatures.join(signers, "person_id")
    return nest_sorted(
        rows, ["proposal_id"],
        [true_first("first"), F.col("last_name").isNull(), F.col("last_name"), F.col("first_name").isNull(),
         F.col("first_name"), F.col("person_id")],
        [F.col("person_id").alias("id"), "first_name", "last_name", "photo", "first", "party_id"],
        "signatures", **kw,
    )


def proposal_list(
    proposals: DataFrame, signatures: DataFrame, persons: DataFrame, memberships: DataFrame, reports: DataFrame
) -> DataFrame:
    """Proposal with its signers and the number of committee reports on it."""
    nested = proposal_signatures(signatures, persons, memberships).withColumnRenamed("proposal_id", "id")
    counted = count_per_key(proposals, reports, "id", "proposal_id", "committee_report_count")
    return attach_lists(counted, "id", {"signatures": nested})


def proposal_page(proposals: DataFrame, size: int = 10, number: int = 0) -> DataFrame:
    return page(proposals, [F.col("date").desc(), F.col("id").asc()], size, number)


def proposal_ballots(proposals: DataFrame, ballots: DataFrame) -> DataFrame:
    """Ballots held on each proposal."""
    b = ballots.select(F.col("parliament_id"), F.col("id").alias("ballot_id"), "title", "start_time", "results_url")
    return proposals.select(F.col("id").alias("parliament_id")).join(b, "parliament_id")


# --- debates ------------------------------------------------------------------------------------


def speeches_with_speakers(
    speeches: DataFrame, persons: DataFrame, memberships: DataFrame, parity: bool = False
) -> DataFrame:
    """Speeches with the speaker's name and group (an ended group wins over the current one).

    ``parity`` keeps one speech per item and start time, as a page lists them.
    """
    group = latest_interval(memberships, ["person_id"], "ended_first", ties=["pg_id"]).select("person_id", "pg_id")
    people = persons.select(F.col("id").alias("person_id"), "first_name", "last_name", "photo")
    out = speeches.join(people, "person_id", "left").join(group, "person_id", "left")
    return dedupe_by(out, ["item_id", "start_time"], [F.col("id")]) if parity else out


def debate_threads(spoken: DataFrame, **kw) -> DataFrame:
    """Root speeches of each item with their responses; an orphaned response is left out."""
    # A response's root is keyed by its id; only a key with its root present makes a thread.
    roots = spoken.where(F.col("response_to") == F.col("id"))
    responses = spoken.where(F.col("response_to") != F.col("id"))
    nested = nest_sorted(
        responses, ["item_id", "response_to"], [F.col("start_time"), F.col("id")],
        ["id", "person_id", "last_name", "pg_id", "start_time", "body"], "responses", **kw,
    ).withColumnRenamed("response_to", "id")
    empty = F.array().cast(nested.schema["responses"].dataType)
    return (
        roots.join(nested, ["item_id", "id"], "left")
        .withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
        .withColumn("responses", F.coalesce("responses", empty))
    )


def orphaned_responses(spoken: DataFrame) -> DataFrame:
    roots = spoken.where(F.col("response_to") == F.col("id")).select("item_id", F.col("id").alias("response_to"))
    return spoken.where(F.col("response_to") != F.col("id")).join(roots, ["item_id", "response_to"], "left_anti")


def debate_participants(spoken: DataFrame) -> DataFrame:
    """Each speaker of an item once, as first heard."""
    return dedupe_by(spoken, ["item_id", "person_id"], [F.col("start_time"), F.col("id")]).select(
        "item_id", "person_id", "first_name", "last_name", "photo", F.col("pg_id").alias("party_id")
    )


# --- keys for a full export -------------------------------------------------------------------------


def export_keys(persons: DataFrame, proposals: DataFrame, agenda_items: DataFrame) -> DataFrame:
    """Page keys of everything that gets a page."""
    people = persons.select(F.lit("person").alias("kind"), F.concat_ws("+", "first_name", "last_name").alias("key"))
    bills = proposals.select(F.lit("proposal").alias("kind"), url_id(F.col("id").cast("string")).alias("key"))
    items = agenda_items.select(F.lit("item").alias("kind"), F.col("title").alias("key"))
    return people.unionByName(bills).unionByName(items).distinct()
