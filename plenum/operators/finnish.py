"""Finnish stems (the published Snowball rules) as column expressions, for a vocabulary.

Every term is stemmed once, however many documents have it, and the stems are joined back to postings. ``R1`` begins after the first consonant
that follows a vowel, ``R2`` likewise inside R1; endings are only taken off inside their region.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions.markup import let
from plenum.operators.search import Query

# Letters and endings of the rules.
VOWELS, SOUNDS, CONSONANTS = "aeiouyäö", "aeiouäö", "bcdfghjklmnpqrstvwxz"
LONG = "(?:aa|ee|ii|oo|uu|ää|öö)"
PARTICLES = "kin|kaan|kään|ko|kö|han|hän|pa|pä|sti"
POSSESSIVES = "si|ni|nsa|nsä|mme|nne|an|än|en"
CASES = (
    "han|hen|hin|hon|hun|hän|hön|siin|den|tten|seen|a|ä|tta|ttä|ta|tä|ssa|ssä|sta|stä|lla|llä|lta|ltä|lle|na|nä|ksi|ine|n"
)
OTHERS = "mpi|mpa|mpä|mmi|mma|mmä|impi|impa|impä|immi|imma|immä|eja|ejä"


def stop_words(spark: SparkSession) -> list[str]:
    """Spark's list of Finnish stop words."""
    return list(spark._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords("finnish"))


def _region(word: Column) -> Column:
    """Letters before the region that begins after the first consonant after a vowel."""
    found = F.regexp_extract(word, rf"^([^{VOWELS}]*[{VOWELS}]+[^{VOWELS}])", 1)
    return F.when(found == "", F.length(word)).otherwise(F.length(found))


def _ending(word: Column, mark: Column, endings: str) -> Column:
    """The longest of the endings that lies behind the mark, '' without one."""
    return F.regexp_extract(F.substring(word, mark + 1, F.length(word)), f"({endings})$", 1)


def _shorter(word: Column, by: int | Column) -> Column:
    return F.left(word, F.length(word) - by)


def _rule(word: Column, mark: Column, endings: str, result: Callable[[Column, Column, Column], Column]) -> Column:
    """The word after one rule: ``result`` of the word, its ending and what is before that; the word itself without an ending."""
    return let(_ending(word, mark, endings), lambda e: F.when(e == "", word).otherwise(
        let(_shorter(word, F.length(e)), lambda b: result(word, e, b))
    ))


def _particle(w: Column, e: Column, b: Column, p2: Column) -> Column:
    return F.when(F.when(e == "sti", F.length(b) >= p2).otherwise(b.rlike(f"[{VOWELS}nt]$")), b).otherwise(w)


def _possessive(w: Column, e: Column, b: Column) -> Column:
    kept = (
        ((e == "si") & b.rlike("k$")) | ((e == "an") & ~b.rlike("(?:ta|ssa|sta|lla|lta|na)$"))
        | ((e == "än") & ~b.rlike("(?:tä|ssä|stä|llä|ltä|nä)$")) | ((e == "en") & ~b.rlike("(?:lle|ine)$"))
    )
    return F.when(kept, w).when((e == "ni") & b.rlike("kse$"), F.concat(_shorter(b, 1), F.lit("i"))).otherwise(b)


def _case(w: Column, e: Column, b: Column, p1: Column) -> Column:
    kept = (
        F.when(e.rlike("^h.n$"), F.right(b, F.lit(1)) != F.substring(e, 2, 1))
        .when(e.isin("siin", "den", "tten"), ~b.rlike(f"[{SOUNDS}]i$"))
        .when(e == "seen", ~b.rlike(f"{LONG}$"))
        .when(e.isin("a", "ä"), ~b.rlike(f"[{CONSONANTS}][{VOWELS}]$"))
        .when(e.isin("tta", "ttä"), ~b.rlike("e$"))
        .otherwise(F.lit(False))
    )
    longer = (e == "n") & b.rlike(f"(?:{LONG}|ie)$") & (F.length(b) - 2 >= p1)
    return F.when(kept, w).when(longer, _shorter(b, 1)).otherwise(b)


def _other(w: Column, e: Column, b: Column) -> Column:
    return F.when((F.length(e) == 3) & ~e.isin("eja", "ejä") & b.rlike("po$"), w).otherwise(b)


def _plural(w: Column, cased: Column, p1: Column, p2: Column) -> Column:
    """i or j goes after a case ending, else t after a vowel, and then mma or imma before it."""
    without_i = _rule(w, p1, "[ij]", lambda _w, _e, b: b)
    without_t = _rule(w, p1, "t", lambda own, _e, b: F.when(b.rlike(f"[{VOWELS}]$"), _rule(
        b, p2, "imma|mma", lambda x, e, c: F.when((e == "mma") & c.rlike("po$"), x).otherwise(c)
    )).otherwise(own))
    return F.when(cased, without_i).otherwise(without_t)


def _tidied(word: Column, p1: Column, endings: Sequence[str]) -> Column:
    if not endings:
        return F.regexp_replace(word, rf"([{CONSONANTS}])\1([{VOWELS}]*)$", "$1$2")
    return let(_rule(word, p1, endings[0], lambda w, _e, _b: _shorter(w, 1)), lambda w: _tidied(w, p1, endings[1:]))


def stem(word: str | Column) -> Column:
    """The stem of a lower-case word. NULL stays NULL."""
    c = F.col(word) if isinstance(word, str) else word

    def all_rules(x: Column) -> Column:
        w, p1, p2 = x["w"], x["p1"], x["p2"]
        tidy = (LONG, f"[{CONSONANTS}][aäei]", "[ou]j", "jo")
        bare = let(_rule(w, p1, PARTICLES, lambda *a: _particle(*a, p2)), lambda a: _rule(a, p1, POSSESSIVES, _possessive))
        return let(bare, lambda b: let(_rule(b, p1, CASES, lambda *a: _case(*a, p1)), lambda d: let(
            _rule(d, p2, OTHERS, _other), lambda o: let(_plural(o, b != d, p1, p2), lambda p: _tidied(p, p1, tidy))
        )))

    def marked(p: Column) -> Column:
        second = p["p1"] + _region(F.substring(p["w"], p["p1"] + 1, F.length(p["w"])))
        return let(F.struct(p["w"].alias("w"), p["p1"].alias("p1"), second.alias("p2")), all_rules)

    return F.when(c.isNotNull(), let(F.struct(c.alias("w"), _region(c).alias("p1")), marked))


def with_stems(df: DataFrame, term: str, out: str = "stem") -> DataFrame:
    return df.withColumn(out, stem(term))


def stemmed_postings(postings: DataFrame) -> DataFrame:
    """Postings by stem: the vocabulary is stemmed once and joined back."""
    stems = with_stems(postings.select("term").distinct(), "term")
    return (
        postings.join(stems, "term")
        .groupBy("doc_id", "segment", F.col("stem").alias("term"))
        .agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    )


def stemmed_query(spark: SparkSession, query: Query | None) -> Query | None:
    """A query for stemmed postings; its few words are stemmed by the same columns."""
    if query is None:
        return None
    rows = with_stems(spark.createDataFrame([(t,) for t in query.terms], "term string"), "term").collect()
    stem = {r["term"]: r["stem"] for r in rows}

    def one(words: Sequence[tuple[int, str]]) -> tuple[tuple[int, str], ...]:
        return tuple((at, stem[t]) for at, t in words)

    return Query(tuple(tuple(replace(e, words=one(e.words)) for e in clause) for clause in query.clauses))
