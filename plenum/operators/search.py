"""Full-text search over documents and persons.

Text is cut into lower-case runs of letters and digits, numbered from 1. The
index is a postings table (doc_id, segment, term, positions); a document is one
segment unless its appended name list is too long for one row, in which case
the rest of the list forms further segments, whose positions go on where the
segment before ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.clean import boost_score, ilike_match, text_concat
from plenum.functions.markup import let
from plenum.operators.aggregate import agg_names, page, with_total
from plenum.operators.nested import NEST_LIMIT, spread
from plenum.operators.temporal import latest_interval
from plenum.sources.search_index import SearchIndex

SEPARATORS = r"[^\p{L}\p{N}]+"
# Weight of an unlabelled word in the ranking (fixed value).
WORD_WEIGHT = 0.1
POSITION = "array<int>"
SPAN = "array<struct<e:int,s:int>>"
# Document ids that are broadcast at most.
FEW = 100_000


def tokens(col: str | Column) -> Column:
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    return F.filter(F.split(F.lower(c), SEPARATORS), lambda x: x != "")


# --- queries ---------------------------------------------------------------------


@dataclass(frozen=True)
class Element:
    """A word or phrase: (offset, term) pairs."""

    words: tuple[tuple[int, str], ...]
    negated: bool = False


@dataclass(frozen=True)
class Query:
    """Alternatives, each a conjunction of elements."""

    clauses: tuple[tuple[Element, ...], ...]

    @property
    def elements(self) -> list[Element]:
        return list(dict.fromkeys(e for c in self.clauses for e in c))

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys(t for e in self.elements for _, t in e.words))

    @property
    def needs_all_docs(self) -> bool:
        return any(all(e.negated for e in c) for c in self.clauses)


def parse_query(q: str | None, stop_words: Sequence[str] = ()) -> Query | None:
    """Words are ANDed, ``or`` separates alternatives, ``-`` negates, quotes make a phrase."""
    clauses: list[list[Element]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', q or ""):
        if word.lower() == "or" and not minus:
            clauses.append([])
            continue
        cut = [t for t in re.split(r"[\W_]+", (quoted or word).lower()) if t]
        kept = tuple((i, t) for i, t in enumerate(cut) if t not in stop_words)
        if kept:
            base = kept[0][0]
            clauses[-1].append(Element(tuple((i - base, t) for i, t in kept), bool(minus)))
    full = tuple(tuple(c) for c in clauses if c)
    return Query(full) if full else None


# --- documents and index --------------------------------------------------------------


def person_docs(persons: DataFrame, memberships: DataFrame, groups: DataFrame, ministers: DataFrame) -> DataFrame:
    """(id, text): names, name of the latest group, latest minister title."""
    group = latest_interval(memberships, ["person_id"], "ended_first", ties=["pg_id"]).select("person_id", "pg_id")
    group = group.join(groups.select(F.col("id").alias("pg_id"), F.col("name").alias("pg_name")), "pg_id")
    post = latest_interval(ministers, ["person_id"], "ended_first", ties=["minister_position"])
    return (
        persons.join(group.select(F.col("person_id").alias("id"), "pg_name"), "id", "left")
        .join(post.select(F.col("person_id").alias("id"), "minister_position"), "id", "left")
        .select("id", text_concat("first_name", "last_name", "pg_name", "minister_position").alias("text"))
    )


def proposal_docs(
    proposals: DataFrame, signatures: DataFrame | None = None, persons: DataFrame | None = None,
    limit: int = NEST_LIMIT,
) -> DataFrame:
    """(doc_id, segment, text): title, summary, reasoning, law changes, signer names."""
    fields = ["title", "summary", "reasoning", "law_changes"]
    if signatures is None or persons is None:
        return proposals.select(
            F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("segment"), text_concat(*fields).alias("text")
        )
    named = signatures.join(persons.select(F.col("id").alias("person_id"), "first_name", "last_name"), "person_id")
    names = agg_names(
        named.withColumnRenamed("proposal_id", "doc_id"), ["doc_id"],
        F.concat(F.col("first_name"), F.lit(" "), F.col("last_name")),
        [F.col("last_name"), F.col("first_name"), F.col("person_id")], limit=limit,
    )
    head = proposals.withColumnRenamed("id", "doc_id").join(names.where("part = 0"), "doc_id", "left")
    main = head.select("doc_id", F.lit(0).cast("long").alias("segment"), text_concat(*fields, "names").alias("text"))
    rest = names.where("part > 0").select("doc_id", F.col("part").alias("segment"), F.col("names").alias("text"))
    return main.unionByName(rest)


def _grouped_words(texts: Column, stop_words: Sequence[str]) -> Column:
    """(term, positions) of the words of a document: sorted pairs are cut where the term changes."""
    pairs = F.flatten(F.transform(texts, lambda t: F.transform(
        tokens(t), lambda w, i: F.struct(w.alias("term"), (i + 1).cast("int").alias("pos"))
    )))
    if stop_words:
        pairs = F.filter(pairs, lambda p: ~p["term"].isin(list(stop_words)))

    def cut(sorted_pairs: Column) -> Column:
        n = F.size(sorted_pairs)
        starts = F.filter(
            F.sequence(F.lit(0), n),
            lambda i: (i == 0) | (i == n) | (F.get(sorted_pairs, i)["term"] != F.get(sorted_pairs, i - 1)["term"]),
        )
        return let(starts, lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda a, i: F.struct(
            F.get(sorted_pairs, a)["term"].alias("term"),
            F.transform(F.slice(sorted_pairs, a + 1, F.get(at, i + 1) - a), lambda p: p["pos"]).alias("positions"),
        )))

    return let(F.array_sort(pairs), lambda p: F.when(F.size(p) > 0, cut(p)))


def build_postings(docs: DataFrame, stop_words: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """Postings of documents (doc_id, segment, text). Dropped stop words keep their position.

    A filter on terms goes before the grouping of words. Where most postings are wanted (``whole``), as for an index, texts meet by document instead, so
    that words are grouped inside a row and no word is shuffled. The words of further segments, which must be joined with the
    words before these, and those of documents without an id, which are all one document, are grouped one by one.
    """
    later = docs.where(F.col("segment") > 0)
    sizes = docs.join(later.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "segment", F.size(tokens("text")).alias("_n"))
    earlier = Window.partitionBy("doc_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("doc_id", "segment", F.sum("_n").over(earlier).alias("_before")).where(F.col("segment") > 0)
    words = ["doc_id", "segment"], tokens("text"), "term", "pos"
    rest = spread(later, *words).join(before, ["doc_id", "segment"]).withColumn("pos", F.col("pos") + F.col("_before"))
    first = docs.where(F.col("segment") == 0)
    exploded = spread(first.where(F.col("doc_id").isNull()) if whole else first, *words)
    exploded = exploded.unionByName(rest.select(*exploded.columns))
    if stop_words:
        exploded = exploded.where(~F.col("term").isin(list(stop_words)))
    singly = exploded.groupBy("doc_id", "segment", "term").agg(
        F.array_sort(F.collect_list((F.col("pos") + 1).cast("int"))).alias("positions")
    )
    if not whole:
        return singly
    texts = first.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "segment").agg(F.collect_list("text").alias("_texts"))
    return spread(texts, ["doc_id", "segment"], _grouped_words(F.col("_texts"), stop_words), "_w").select(
        "doc_id", "segment", "_w.term", "_w.positions"
    ).unionByName(singly)


# --- matching and ranking -----------------------------------------------------------------


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p + F.lit(by))


def _spans(element: Element, positions: Callable[[str], Column]) -> Column:
    """Where an element occurs: array of (end, start)."""
    last = element.words[-1][0]
    at = positions(element.words[0][1])
    for offset, term in element.words[1:]:
        # Lists moved back by the word's place in the phrase meet by hashing.
        at = F.array_intersect(at, _moved(positions(term), -offset))
    return F.transform(at, lambda p: F.struct((p + F.lit(last)).alias("e"), p.alias("s"))).cast(SPAN)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def matches(query: Query, has: Callable[[Element], Column]) -> Column:
    return _any([_all([~has(e) if e.negated else has(e) for e in clause]) for clause in query.clauses])


def cover_density(query: Query, spans: Callable[[Element], Column], positions: Callable[[str], Column]) -> Column:
    """Sum over the minimal covers of weight / (1 + words inside that are no match).

    A cover is a shortest stretch that holds all wanted elements of some
    alternative. One sweep over the sorted hits and ends of occurrences counts
    the hits so far and keeps, for each element, the last start and the hits
    before it; a cover ends wherever the latest possible start moves. As hits
    before a place never fall, the hits before that start are found like the
    start itself.
    """
    wanted = [[e for e in c if not e.negated] for c in query.clauses]
    wanted = [c for c in wanted if c]
    if not wanted:
        return F.lit(0.0)
    if len(wanted) == 1 and len(wanted[0]) == 1 and len(wanted[0][0].words) == 1:
        return F.size(spans(wanted[0][0])) * F.lit(WORD_WEIGHT)

    elements = list(dict.fromkeys(e for c in wanted for e in c))
    terms = list(dict.fromkeys(t for e in elements for _, t in e.words))
    if all(len(e.words) == 1 for e in elements):
        return _word_covers(wanted, elements, spans)
    # Hits of a stretch as long as the longest phrase are remembered, so that an occurrence's own hits can be counted.
    width = 1 + max(e.words[-1][0] for e in elements)
    HIT, END, LOOK = 0, 1, 2

    def points(places: Column, kind: int, i: int, end, start) -> Column:
        return F.transform(
            places, lambda x: F.struct(end(x).alias("e"), F.lit(kind).alias("k"), F.lit(i).alias("i"), start(x).alias("s"))
        )

    ends = [points(spans(e), END, i, lambda x: x["e"], lambda x: x["s"]) for i, e in enumerate(elements)]
    looks = F.array_distinct(F.transform(F.flatten(F.array(*ends)), lambda x: x["e"]))
    events = F.array_sort(F.concat(
        *[points(positions(t), HIT, -1, lambda x: x, lambda x: x) for t in terms], *ends,
        points(looks, LOOK, -1, lambda x: x, lambda x: x),
    ))
    start_state = F.struct(
        F.lit(0).alias("hits"), F.array().cast(POSITION).alias("recent"),
        F.array(*[F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("n")) for _ in elements]).alias("last"),
        F.lit(-1).alias("prev"), F.lit(0.0).alias("score"),
    )

    def latest(last: Column, field: str) -> Column:
        # -1 in any element keeps the alternative's start at -1.
        starts = []
        for clause in wanted:
            each = [F.get(last, elements.index(e))[field] for e in clause]
            starts.append(F.least(*each) if len(each) > 1 else each[0])
        return F.greatest(*starts) if len(starts) > 1 else starts[0]

    def step(state: Column, ev: Column) -> Column:
        hit, end, look = ev["k"] == HIT, ev["k"] == END, ev["k"] == LOOK
        recent = F.when(
            hit, F.concat(F.filter(state["recent"], lambda p: p > ev["e"] - F.lit(width)), F.array(ev["e"]))
        ).otherwise(state["recent"])
        before = state["hits"] - F.size(F.filter(state["recent"], lambda p: p >= ev["s"]))
        last = F.when(end, F.transform(
            state["last"], lambda x, i: F.when(i == ev["i"], F.struct(ev["s"].alias("s"), before.alias("n"))).otherwise(x)
        )).otherwise(state["last"])
        start = latest(state["last"], "s")
        noise = F.greatest(ev["e"] - start - (state["hits"] - latest(state["last"], "n") - 1), F.lit(0))
        moved = look & (start > state["prev"])
        return F.struct(
            (state["hits"] + hit.cast("int")).alias("hits"), recent.alias("recent"), last.alias("last"),
            F.when(moved, start).otherwise(state["prev"]).alias("prev"),
            (state["score"] + F.when(moved, F.lit(WORD_WEIGHT) / (F.lit(1) + noise)).otherwise(F.lit(0.0))).alias("score"),
        )

    return F.aggregate(events, start_state, step, lambda s: s["score"])


def _needed(query: Query) -> list[str]:
    """Terms that every matching document has."""
    per_clause = [{t for e in c if not e.negated for _, t in e.words} for c in query.clauses]
    return sorted(set.intersection(*per_clause))


def _postings_of(postings: DataFrame | SearchIndex, query: Query) -> DataFrame:
    """Postings of the query's terms.

    A stored index knows how many documents a term has. If every match must hold a term that few have, other postings are read for those
    documents only; the list is broadcast, as its size is known to be `FEW` ids at most.
    """
    if not isinstance(postings, SearchIndex):
        return postings.where(F.col("term").isin(query.terms))
    counts = postings.documents_of(query.terms)
    rows = postings.postings(query.terms)
    needed = _needed(query)
    rarest = min(needed, key=lambda t: (counts[t], t)) if needed else None
    if rarest is None or counts[rarest] > FEW or len(query.terms) == 1:
        return rows
    few = postings.postings([rarest]).select("doc_id").distinct()
    return rows.join(F.broadcast(few), "doc_id", "left_semi")


def _word_covers(wanted: list[list[Element]], elements: list[Element], spans: Callable[[Element], Column]) -> Column:
    """`cover_density` of words only: every occurrence is a hit of its own, so its number is the hits so far."""
    events = F.array_sort(F.concat(*[_tagged(spans(e), i) for i, e in enumerate(elements)]))
    fields = [f"{f}{i}" for i in range(len(elements)) for f in ("s", "n")]
    begin = F.struct(F.lit(0).alias("hits"), F.lit(-1).alias("prev"), F.lit(0.0).alias("score"), *[F.lit(-1).alias(f) for f in fields])

    def latest(of: dict[str, Column], field: str) -> Column:
        starts = [F.least(*[of[f"{field}{elements.index(e)}"] for e in c]) if len(c) > 1 else of[f"{field}{elements.index(c[0])}"] for c in wanted]
        return F.greatest(*starts) if len(starts) > 1 else starts[0]

    def step(state: Column, ev: Column) -> Column:
        own = {}
        for i in range(len(elements)):
            own[f"s{i}"] = F.when(ev["i"] == i, ev["s"]).otherwise(state[f"s{i}"])
            own[f"n{i}"] = F.when(ev["i"] == i, state["hits"]).otherwise(state[f"n{i}"])
        start = latest(own, "s")
        noise = F.greatest(ev["s"] - start - (state["hits"] - latest(own, "n")), F.lit(0))
        moved = start > state["prev"]
        return F.struct(
            (state["hits"] + 1).alias("hits"), F.when(moved, start).otherwise(state["prev"]).alias("prev"),
            (state["score"] + F.when(moved, F.lit(WORD_WEIGHT) / (F.lit(1) + noise)).otherwise(F.lit(0.0))).alias("score"),
            *[own[f].alias(f) for f in fields],
        )

    return F.aggregate(events, begin, step, lambda s: s["score"])


def _tagged(places: Column, i: int) -> Column:
    return F.transform(places, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i")))


def match_docs(postings: DataFrame | SearchIndex, query: Query | None, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, rank) of the matching documents.

    Reads the postings of the query's terms only and meets them in one grouping
    by document. ``docs`` (doc_id) is needed when an alternative has nothing but
    negations.
    """
    if query is None:
        known = postings.postings([]) if isinstance(postings, SearchIndex) else postings
        return known.select("doc_id", F.lit(0.0).alias("rank")).limit(0)
    terms, elements = query.terms, query.elements

    def positions(t: str) -> Column:
        return F.col(f"_p{terms.index(t)}")

    found = (
        _postings_of(postings, query)
        .groupBy("doc_id")
        .agg(*[
            F.flatten(F.collect_list(F.when(F.col("term") == t, F.col("positions")))).cast(POSITION).alias(f"_p{i}")
            for i, t in enumerate(terms)
        ])
    )
    spanned = found.select(
        "doc_id", *[f"_p{i}" for i in range(len(terms))],
        *[_spans(e, positions).alias(f"_s{i}") for i, e in enumerate(elements)],
    )

    def spans(e: Element) -> Column:
        return F.col(f"_s{elements.index(e)}")

    per_doc = spanned.select(
        "doc_id", cover_density(query, spans, positions).alias("rank"),
        *[(F.size(spans(e)) > 0).alias(f"_h{i}") for i, e in enumerate(elements)],
    )
    if query.needs_all_docs:
        if docs is None:
            raise ValueError("a query of negations only needs the list of documents")
        per_doc = docs.select("doc_id").join(per_doc, "doc_id", "left")

    def has(e: Element) -> Column:
        return F.coalesce(F.col(f"_h{elements.index(e)}"), F.lit(False))

    return per_doc.where(matches(query, has)).select("doc_id", F.coalesce("rank", F.lit(0.0)).alias("rank"))


# --- row-local evaluation: short texts and result pages ----------------------------------------


def with_match(df: DataFrame, words: str, query: Query, hit: str, rank: str | None = None) -> DataFrame:
    """Match flag (and rank) of a token column, without an index.

    Positions and spans become columns first, so that no lambda computes them again.
    """
    keep, terms, elements = df.columns, query.terms, query.elements

    def found(t: str) -> Column:
        at = F.transform(words, lambda x, i: F.when(x == F.lit(t), i + 1))
        return F.filter(at, lambda p: p.isNotNull())

    def positions(t: str) -> Column:
        return F.col(f"_p{terms.index(t)}")

    def spans(e: Element) -> Column:
        return F.col(f"_s{elements.index(e)}")

    df = df.select(*keep, *[found(t).alias(f"_p{i}") for i, t in enumerate(terms)])
    df = df.select("*", *[_spans(e, positions).alias(f"_s{i}") for i, e in enumerate(elements)])
    out = [matches(query, lambda e: F.size(spans(e)) > 0).alias(hit)]
    if rank is not None:
        out.append(cover_density(query, spans, positions).alias(rank))
    return df.select(*keep, *out)


def mark_terms(col: str | Column, terms: Sequence[str]) -> Column:
    """Wrap every whole-word occurrence of the terms in <mark>."""
    c = F.col(col) if isinstance(col, str) else col
    either = "|".join(re.escape(t) for t in terms)
    return F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}])({either})(?![\p{{L}}\p{{N}}])", "<mark>$1</mark>")


def with_headline(df: DataFrame, col: str, terms: Sequence[str], out: str, max_words: int = 30) -> DataFrame:
    """The stretch of at most ``max_words`` words with the most marked terms, the earliest on a tie.

    The stretch is centred on its matches; text without a match starts at the top.
    """
    keep = [c for c in df.columns if c != out]
    either = "|".join(re.escape(t) for t in terms)
    pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}])({either})(?![\p{{L}}\p{{N}}])"
    words = F.filter(F.split(F.coalesce(F.col(col), F.lit("")), r"(?U)\s+"), lambda w: w != "")
    df = df.withColumn("_words", words)
    at = F.filter(F.transform("_words", lambda w, i: F.when(w.rlike(pattern), i)), lambda i: i.isNotNull())
    df = df.withColumn("_at", at)
    # Every stretch worth having starts at a match: (matches, -start).
    stretches = F.transform(
        "_at",
        lambda i, k: F.struct(
            # Matches are ascending, so those of a stretch are among the next max_words of them.
            F.size(F.filter(F.slice("_at", k + 1, F.lit(max_words)), lambda j: j < i + max_words)).alias("n"),
            (-i).alias("start"),
        ),
    )
    df = df.withColumn("_first", -F.array_max(stretches)["start"])
    last = F.array_max(F.filter("_at", lambda j: j < F.col("_first") + max_words))
    slack = F.lit(max_words) - (last - F.col("_first") + 1)
    begin = F.coalesce(F.col("_first") - F.floor(slack / 2).cast("int"), F.lit(0))
    df = df.withColumn("_begin", F.greatest(F.lit(0), F.least(begin, F.size("_words") - F.lit(max_words))))
    text = F.array_join(F.slice("_words", F.col("_begin") + 1, max_words), " ")
    return df.select(*keep, mark_terms(text, terms).alias(out))


def search_proposals(
    proposals: DataFrame, postings: DataFrame | SearchIndex, q: str | None, limit: int = 50, offset: int = 0,
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """A page of matching proposals by rank and date, with marked title and snippet and the total.

    Texts are read again only for the rows of the page, at most ``limit`` of
    them, which is the bound of the broadcast.
    """
    query = parse_query(q, stop_words)
    hits = match_docs(postings, query, proposals.select(F.col("id").alias("doc_id")))
    ranked = hits.withColumnRenamed("doc_id", "id").join(proposals.select("id", "date"), "id")
    rows = (
        ranked.orderBy(F.col("rank").desc(), F.col("date").desc(), F.col("id")).offset(offset).limit(limit)
    )
    total = hits.agg(F.count(F.lit(1))).scalar()
    shown = proposals.join(F.broadcast(rows.select("id", "rank")), "id")
    if query is None:
        shown = shown.withColumn("content_snippet", F.col("summary"))
    else:
        # The first field that matches by itself gives the snippet.
        fields = ["summary", "reasoning", "law_changes"]
        for f in fields:
            shown = with_match(shown.withColumn("_words_of", tokens(f)), "_words_of", query, f"_hit_{f}")
        picked = F.coalesce(*[F.when(F.col(f"_hit_{f}"), F.col(f)) for f in fields])
        shown = with_headline(shown.withColumn("_picked", picked), "_picked", query.terms, "_headline")
        shown = shown.withColumn(
            "content_snippet", F.when(F.col("_picked").isNotNull(), F.col("_headline")).otherwise(F.col("summary"))
        ).withColumn("title", mark_terms(F.coalesce("title", F.lit("")), query.terms))
    return shown.select(
        "id", "ptype", "date", "title", "content_snippet", "status", "rank", total.alias("total_hits"),
    ).orderBy(F.col("rank").desc(), F.col("date").desc(), F.col("id"))


def search_persons(
    persons: DataFrame, docs: DataFrame, memberships: DataFrame, ministers: DataFrame, q: str | None,
    limit: int = 50, offset: int = 0, parity: bool = False, stop_words: Sequence[str] = (),
) -> DataFrame:
    """Persons by full-text match or by part of a name; name boosts plus five times the rank.

    ``docs`` are the person documents (id, text); they are a line each, so they
    are matched in place.
    """
    text = (q or "").strip()
    query = parse_query(text, stop_words)
    joined = persons.join(docs.select("id", "text"), "id")
    if query is None:
        joined = joined.withColumn("_hit", F.lit(False)).withColumn("_rank", F.lit(0.0))
    else:
        joined = with_match(joined.withColumn("_words_of", tokens("text")), "_words_of", query, "_hit", "_rank")
    part_of_name = ilike_match("first_name", q or "", "substring", parity) | ilike_match(
        "last_name", q or "", "substring", parity
    )
    wanted = (F.col("_hit") | part_of_name) if text else F.lit(False)
    found = (
        joined.where(wanted)
        .withColumn("rank", boost_score(["first_name", "last_name"], q or "", parity) + F.col("_rank") * F.lit(5.0))
        .drop("text", "_words_of", "_hit", "_rank")
    )
    found = with_total(found)
    rows = page_of(found, limit, offset)
    group = latest_interval(memberships, ["person_id"], "ended_first", ties=["pg_id"]).select(
        F.col("person_id").alias("id"), F.col("pg_id").alias("party_id")
    )
    post = latest_interval(ministers, ["person_id"], "current_first", ties=["minister_position"]).select(
        F.col("person_id").alias("id"), "minister_position"
    )
    return rows.join(group, "id", "left").join(post, "id", "left").orderBy(
        F.col("rank").desc(), F.col("last_name").asc_nulls_last(), F.col("id")
    )


def page_of(found: DataFrame, limit: int, offset: int) -> DataFrame:
    order = [F.col("rank").desc(), F.col("last_name").asc_nulls_last(), F.col("id")]
    if offset % limit == 0:
        return page(found, order, limit, offset // limit)
    return found.orderBy(*order).offset(offset).limit(limit)
