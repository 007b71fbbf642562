"""Queries on the text search."""

from pyspark.sql import functions as F

from plenum import bindings as b
from plenum.catalog.bits import MEMBERSHIPS, MINISTERS, PERSONS, with_
from plenum.functions.clean import ellipsize
from plenum.operators import search as t
from plenum.operators.aggregate import page_info
from plenum.sources.scratch import scratch_folder
from plenum.sources.search_index import open_index, write_index

TOKENS = """
words AS (
  SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(split_part(text, chr(10), 1) || ' ' || text || '  '),
                                                     '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents))"""


def _postings(s, d, whole=False):
    return t.build_postings(t.proposal_docs(b.documents(s, d)), whole=whole)


def _match(q):
    def run(s, d):
        docs = b.documents(s, d).select(F.col("id").alias("doc_id"))
        return t.match_docs(_postings(s, d), t.parse_query(q), docs).select("doc_id")

    return run


def _has(term):
    return f"doc_id IN (SELECT doc_id FROM words WHERE term = '{term}')"


def _match_sql(condition):
    return with_(TOKENS) + f"SELECT doc_id FROM documents WHERE {condition}"


PHRASE = """doc_id IN (SELECT a.doc_id FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
  WHERE a.term = 'of' AND b.term = 'the')"""


def _pages(s, d, q, limit, offset):
    return t.search_proposals(b.documents(s, d), _postings(s, d), q, limit, offset)


def _stored(s, d):
    """The index of all documents, written and opened again."""
    path = scratch_folder(s, "search-index")
    write_index(_postings(s, d, whole=True), path)
    return open_index(s, path)


def covers(elements, clauses):
    """Ranked documents: elements are words or phrases of words that follow each other, clauses the numbers of elements of each alternative.

    At each place where an occurrence ends, the cover's start is the latest start of an alternative, that is the earliest of its elements' last
    starts; a start has one cover, the shortest.
    """
    def occurrences(i, words):
        joins = " ".join(
            f"JOIN words w{k} ON w{k}.doc_id = w0.doc_id AND w{k}.pos = w0.pos + {k} AND w{k}.term = '{w}'" for k, w in enumerate(words) if k
        )
        return f"SELECT w0.doc_id, w0.pos + {len(words) - 1} AS e, w0.pos AS s, {i} AS i FROM words w0 {joins} WHERE w0.term = '{words[0]}'"

    split = [e.split() for e in elements]
    terms = ", ".join(f"'{w}'" for w in sorted({w for e in split for w in e}))
    n = range(len(elements))
    starts = [f"least({', '.join(f'l{i}' for i in c)})" if len(c) > 1 else f"l{c[0]}" for c in clauses]
    return f"""
occ AS ({' UNION ALL '.join(occurrences(i, e) for i, e in enumerate(split))}),
ends AS (SELECT doc_id, e, {', '.join(f'max(CASE WHEN i = {i} THEN s END) AS s{i}' for i in n)} FROM occ GROUP BY doc_id, e),
walk AS (SELECT doc_id, e, {', '.join(f'coalesce(max(s{i}) OVER w, -1) AS l{i}' for i in n)}
         FROM ends WINDOW w AS (PARTITION BY doc_id ORDER BY e)),
found AS (SELECT doc_id, e, {f"greatest({', '.join(starts)})" if len(starts) > 1 else starts[0]} AS s FROM walk),
covers AS (SELECT doc_id, s, min(e) AS e FROM found WHERE s > 0 GROUP BY doc_id, s),
hits AS (SELECT doc_id, pos FROM words WHERE term IN ({terms})),
scored AS (
  SELECT c.doc_id, 0.1 / (1 + greatest((c.e - c.s) - (count(*) - 1), 0)) AS score
  FROM covers c JOIN hits o ON o.doc_id = c.doc_id AND o.pos BETWEEN c.s AND c.e GROUP BY c.doc_id, c.s, c.e),
ranked AS (SELECT doc_id, sum(score) AS rank FROM scored GROUP BY doc_id)"""


COVERS = covers(["with", "that"], [[0, 1]])


def _rank(q, elements, clauses, index=_postings):
    return (
        lambda s, d: t.match_docs(index(s, d), t.parse_query(q)).withColumn("rank", F.round("rank", 6)),
        with_(TOKENS, covers(elements, clauses)) + "SELECT doc_id, round(rank, 6) AS rank FROM ranked",
    )


def _page(s, d, index):
    return t.search_proposals(b.documents(s, d), index(s, d), "with that", 10, 10).select(
        "id", "ptype", "status", F.date_format("date", "yyyy-MM-dd").alias("date"), "title", "content_snippet",
        F.round("rank", 6).alias("rank"), "total_hits",
    )


def _marked(text):
    return f"""array_to_string(list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+'),
      lambda x: CASE WHEN lower(x) IN ('with', 'that') THEN '<mark>' || x || '</mark>' ELSE x END), '')"""


# The stretch of 30 words with the most matches, the first of equal ones, its matches in the middle.
SNIPPETS = f"""
split AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents),
spots AS (SELECT doc_id, text, w, list_filter(range(0, len(w)), lambda i: regexp_matches(
         lower(w[i + 1]), '(^|[^\\p{{L}}\\p{{N}}])(with|that)($|[^\\p{{L}}\\p{{N}}])')) AS m FROM split),
counted AS (SELECT doc_id, i, (SELECT count(*) FROM unnest(m) AS u(j) WHERE j >= i AND j < i + 30) AS n,
                   (SELECT max(j) FROM unnest(m) AS u(j) WHERE j < i + 30) AS last_one
            FROM (SELECT doc_id, m, unnest(m) AS i FROM spots)),
best AS (SELECT doc_id, i, last_one FROM counted QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1),
placed AS (SELECT a.doc_id, a.text, a.w, greatest(0, least(b.i - (30 - (b.last_one - b.i + 1)) // 2, len(a.w) - 30)) AS first
           FROM spots a JOIN best b USING (doc_id)),
snippets AS (SELECT doc_id, {_marked("array_to_string(w[first + 1 : first + 30], ' ')")} AS content_snippet,
                    {_marked("split_part(text, chr(10), 1)")} AS title FROM placed)"""
PAGE = (
    with_(TOKENS, COVERS, SNIPPETS)
    + """SELECT d.doc_id AS id, d.lang AS ptype, d.source AS status, n.title, n.content_snippet,
    strftime(DATE '2024-01-01' + (d.doc_id % 365)::INT, '%Y-%m-%d') AS date, round(r.rank, 6) AS rank,
    (SELECT count(*) FROM ranked) AS total_hits
    FROM ranked r JOIN documents d USING (doc_id) JOIN snippets n USING (doc_id)
    ORDER BY r.rank DESC, date DESC, d.doc_id LIMIT 10 OFFSET 10"""
)


def _groups(s, d):
    return b.memberships(s, d).select(F.col("pg_id").alias("id"), F.col("pg_id").alias("name")).distinct()


def _persons(s, d, q, limit, offset):
    docs = t.person_docs(b.persons(s, d), b.memberships(s, d), _groups(s, d), b.minister_posts(s, d))
    return t.search_persons(b.persons(s, d), docs, b.memberships(s, d), b.minister_posts(s, d), q, limit, offset)


PERSON_DOCS = """
pg AS (SELECT person_id, pg_id FROM memberships QUALIFY row_number() OVER (
  PARTITION BY person_id ORDER BY end_date DESC NULLS LAST, start_date DESC, pg_id DESC) = 1),
mi_last AS (SELECT person_id, minister_position FROM ministers QUALIFY row_number() OVER (
  PARTITION BY person_id ORDER BY end_date DESC NULLS LAST, start_date DESC, minister_position DESC) = 1),
mi_now AS (SELECT person_id, minister_position FROM ministers QUALIFY row_number() OVER (
  PARTITION BY person_id ORDER BY end_date DESC NULLS FIRST, start_date DESC, minister_position DESC) = 1),
docs AS (
  SELECT p.id, p.first_name, p.last_name, pg.pg_id AS party_id, n.minister_position,
         list_filter(regexp_split_to_array(lower(concat_ws(' ', p.first_name, p.last_name, coalesce(pg.pg_id, ''),
           coalesce(l.minister_position, ''))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
  FROM persons p LEFT JOIN pg ON pg.person_id = p.id LEFT JOIN mi_last l ON l.person_id = p.id
  LEFT JOIN mi_now n ON n.person_id = p.id)"""


def _person_sql(where, rank, tail):
    return (
        with_(PERSONS, MEMBERSHIPS, MINISTERS, PERSON_DOCS)
        + f"""SELECT id, first_name, last_name, party_id, minister_position, round({rank}, 6) AS rank,
        count(*) OVER () AS total_hits FROM docs WHERE {where} ORDER BY rank DESC, last_name, id {tail}"""
    )


def _person_cols(df):
    return df.select(
        "id", "first_name", "last_name", "party_id", "minister_position", F.round("rank", 6).alias("rank"), "total_hits"
    )


def _signed(s, d):
    """Proposals of the orders with the names of their signers."""
    nothing = F.lit(None).cast("string")
    docs = b.proposals(s, d).select("id", "title", nothing.alias("summary"), nothing.alias("reasoning"), nothing.alias("law_changes"))
    return t.build_postings(t.proposal_docs(docs, b.signatures(s, d), b.supplier_persons(s, d)), ["of"], whole=True)


def _stemmed(s, d):
    """Postings of all documents by Finnish stem, without Finnish stop words."""
    return finnish.stemmed_postings(t.build_postings(t.proposal_docs(b.documents(s, d)), finnish.stop_words(s)))


QUERIES = {
    "search_signers": (
        lambda s, d: t.match_docs(_signed(s, d), t.parse_query('"given0 supplier 000000007" -urgent', ["of"])).withColumn("rank", F.round("rank", 6)),
        # Who signed twice is named twice.
        """SELECT l_orderkey AS doc_id, round(0.1 * count(*), 6) AS rank FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        WHERE l_suppkey = 7 AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY 1""",
    ),
    "search_postings": (
        lambda s, d: _postings(s, d, whole=True).select(
            "doc_id", "term", F.size("positions").alias("n"), F.get("positions", 0).alias("first_pos"),
            F.try_element_at("positions", F.lit(-1)).alias("last_pos"),
        ),
        with_(TOKENS)
        + """SELECT doc_id, term, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos
        FROM words GROUP BY doc_id, term""",
    ),
    "search_match_and": (
        _match("with that"),
        with_(TOKENS) + "SELECT doc_id FROM words WHERE term IN ('with', 'that') GROUP BY doc_id HAVING count(DISTINCT term) = 2",
    ),
    "search_match_or": (_match("queque or that"), _match_sql(f"{_has('queque')} OR {_has('that')}")),
    "search_match_not": (_match("with -that"), _match_sql(f"{_has('with')} AND NOT {_has('that')}")),
    "search_match_only_not": (_match("-the"), _match_sql(f"NOT {_has('the')}")),
    "search_match_phrase": (_match('"of the"'), _match_sql(PHRASE)),
    "search_match_mixed": (
        _match('"of the" with or der -die'),
        _match_sql(f"({PHRASE} AND {_has('with')}) OR ({_has('der')} AND NOT {_has('die')})"),
    ),
    "search_rank_single_term": (
        lambda s, d: t.match_docs(_postings(s, d), t.parse_query("with")).withColumn("rank", F.round("rank", 6)),
        with_(TOKENS) + "SELECT doc_id, round(0.1 * count(*), 6) AS rank FROM words WHERE term = 'with' GROUP BY 1",
    ),
    "search_rank_two_terms": _rank("with that", ["with", "that"], [[0, 1]]),
    "search_rank_three_terms": _rank("with that by", ["with", "that", "by"], [[0, 1, 2]]),
    "search_rank_phrase": _rank('"of the" with', ["of the", "with"], [[0, 1]]),
    "search_rank_or": _rank('"of the" with or by that or der', ["of the", "with", "by", "that", "der"], [[0, 1], [2, 3], [4]]),
    "search_stored_rank": _rank('"of the" with', ["of the", "with"], [[0, 1]], _stored),
    "search_stored_terms": (
        lambda s, d: _stored(s, d).dictionary(["with", "that", "der", "no such word"]),
        with_(TOKENS) + """SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS hits FROM words
        WHERE term IN ('with', 'that', 'der', 'no such word') GROUP BY term""",
    ),
    "search_page": (lambda s, d: _page(s, d, _postings), PAGE),
    "search_stored_page": (lambda s, d: _page(s, d, _stored), PAGE),
    "search_title_marks": (
        lambda s, d: b.documents(s, d).select("id", t.mark_terms("title", ["the", "la"]).alias("title")),
        """SELECT doc_id AS id, regexp_replace(split_part(text, chr(10), 1),
        '(^|[^\\p{L}\\p{N}])(the|la)\\b', '\\1<mark>\\2</mark>', 'gi') AS title FROM documents
        WHERE false UNION ALL
        SELECT doc_id, array_to_string(list_transform(regexp_extract_all(split_part(text, chr(10), 1),
          '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+'), lambda x: CASE WHEN lower(x) IN ('the', 'la')
          THEN '<mark>' || x || '</mark>' ELSE x END), '') FROM documents""",
    ),
    "search_headline": (
        lambda s, d: _pages(s, d, "with that", 50, 0).select(
            "id", ellipsize("content_snippet").alias("content_snippet"), "title"
        ),
        with_(TOKENS, COVERS, SNIPPETS)
        + """SELECT id, title, CASE WHEN regexp_matches(t, '^[a-z]') THEN '...' ELSE '' END || t ||
        CASE WHEN right(t, 1) IN ('.', ',', '!', '?', ';', ':') THEN '' ELSE '...' END AS content_snippet
        FROM (SELECT r.doc_id AS id, n.title, n.content_snippet AS t FROM ranked r JOIN documents d USING (doc_id) JOIN snippets n USING (doc_id)
              ORDER BY r.rank DESC, d.doc_id % 365 DESC, d.doc_id LIMIT 50)""",
    ),
    "snippet_ellipsis": (
        lambda s, d: b.documents(s, d).select("id", ellipsize(F.left("summary", F.lit(60))).alias("snippet")),
        """SELECT doc_id AS id, CASE WHEN regexp_matches(t, '^[a-z]') THEN '...' ELSE '' END || t ||
        CASE WHEN right(t, 1) IN ('.', ',', '!', '?', ';', ':') THEN '' ELSE '...' END AS snippet
        FROM (SELECT doc_id, left(text, 60) AS t FROM documents)""",
    ),
    "search_persons_hybrid": (
        lambda s, d: _person_cols(_persons(s, d, "household", 20, 20)),
        _person_sql(
            "list_contains(w, 'household') OR first_name ILIKE '%household%' OR last_name ILIKE '%household%'",
            "1.6 * (first_name ILIKE 'household')::INT + 5 * 0.1 * len(list_filter(w, lambda x: x = 'household'))",
            "LIMIT 20 OFFSET 20",
        ),
    ),
    "search_persons_by_group": (
        lambda s, d: _person_cols(_persons(s, d, "minister 5", 500, 0)),
        _person_sql(
            "list_contains(w, 'minister') AND list_contains(w, '5')",
            """5 * (CASE WHEN list_position(w, '5') < list_position(w, 'minister') THEN 0.05 ELSE 0 END
                    + CASE WHEN w[-1] = '5' THEN 0.1 ELSE 0 END)""",
            "LIMIT 500",
        ),
    ),
    "search_persons_page_info": (
        lambda s, d: _persons(s, d, "house", 20, 0).select("total_hits", *page_info("total_hits", 0, 20)).distinct(),
        with_(PERSONS)
        + """SELECT count(*) AS total_hits, least(1, count(*)) AS page_min, least(20, count(*)) AS page_max,
        CAST(ceil(count(*) / 20.0) AS BIGINT) AS last_page FROM persons
        WHERE first_name ILIKE '%house%' OR last_name ILIKE '%house%'""",
    ),
}
