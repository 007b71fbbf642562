"""Cleaning functions on hand-written edge cases."""

from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plenum import schemas
from plenum.functions import clean as c


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(fn("x").alias("y")).first().y


@pytest.mark.parametrize(
    "raw, start, end",
    [
        ("17.4.2019", date(2019, 4, 17), date(2019, 4, 17)),
        ("1.2.2000", date(2000, 2, 1), date(2000, 2, 1)),
        ("1995", date(1995, 1, 1), date(1995, 12, 31)),
        ("", None, None), (None, None, None), ("31.2.2000", None, None),
    ],
)
def test_dates(spark, raw, start, end):
    assert one(spark, raw, lambda x: c.complete_date(x, "start")) == start
    assert one(spark, raw, lambda x: c.complete_date(x, "end")) == end


@pytest.mark.parametrize(
    "raw, budget, funding",
    [("'1 234,50'", 1234.5, 1234.5), ("''", 0, None), ("'1,2,3'", None, None), ("'1 000,05'", 1000.05, 1000.05),
     (None, None, None), ("'-5'", -5, -5)],
)
def test_money(spark, raw, budget, funding):
    def number(v):
        return None if v is None else float(v)

    assert number(one(spark, raw, c.parse_money)) == budget
    assert number(one(spark, raw, lambda x: c.parse_money(x, empty=None))) == funding


@pytest.mark.parametrize(
    "raw, status",
    [(None, "open"), ("Expired", "expired"), ("Cancelled", "cancelled"), ("Rejected", "rejected"),
     ("Resting", "resting"), ("Passed", "passed"), ("Replied", "replied"), ("Dealt", "dealt"),
     ("PassedChanged", "passed_changed"), ("PassedUrgent", "passed_urgent"), ("Odd", "Odd")],
)
def test_status(spark, raw, status):
    assert one(spark, raw, c.map_status) == status


def test_group_names(spark):
    for canonical, spellings in schemas.GROUP_SPELLINGS.items():
        for s in (canonical, *spellings):
            assert one(spark, s, c.harmonize) == canonical
    assert one(spark, "Eduskuntaryhmään kuulumaton", c.harmonize) == "-"
    assert one(spark, "SUOMEN Kansanpuolue", c.harmonize) == "suomen kansanpuolue"


def test_roles(spark):
    assert one(spark, "Varapuheenjohtaja", c.map_role) == "first vice"
    assert one(spark, None, c.map_role) is None
    with pytest.raises(PySparkException):
        one(spark, "keisari", c.map_role)


def test_code_maps(spark):
    df = spark.createDataFrame([(" Tyhjää ",), ("Jaa",), ("?",), (None,)], "v string")
    got = c.map_codes(df, "v", schemas.VOTE_CODES).collect()
    assert sorted(r.v for r in got) == ["abstain", "yes"]
    kept = c.map_codes(df, "v", schemas.VOTE_CODES, "keep").collect()
    assert {r.v for r in kept} == {"abstain", "yes", "?", None}


@pytest.mark.parametrize(
    "raw, name",
    [("Meikäläinen kok", "Meikäläinen"), ("von Konner", "von Konner"), ("Saari /vihr.", "Saari"), ("r", "r"),
     ("Pekka Saari ps", "Pekka Saari"), ("Kok", "Kok")],
)
def test_party_suffix(spark, raw, name):
    assert one(spark, raw, c.strip_party) == name


def test_small_functions(spark):
    assert one(spark, "HaVP", c.assembly_code) == "HaV"
    assert one(spark, "PTK", c.assembly_code) == "EK"
    assert one(spark, "HE 1/2020 vp", c.url_id) == "HE+1-2020+vp"
    assert one(spark, "  a -—\n b ", c.clean_title) == "a - b"
    assert one(spark, "x VASKI_JULKVP_Täysi_fi y", c.doc_type) == "Täysi_fi"
    assert one(spark, "none", c.doc_type) is None
    assert one(spark, "a b c", lambda x: c.truncate_words(x, 2)) == "a b..."
    assert one(spark, None, c.truncate_words) == ""
    assert one(spark, "middle of", c.ellipsize) == "...middle of..."
    assert one(spark, "Whole.", c.ellipsize) == "Whole."
    assert one(spark, "one", lambda x: c.name_tokens(x, 1)) is None
    assert one(spark, "12a", c.numeric_id) is None
    assert one(spark, "PTK 3/2015 vp", c.ints_in) == [3, 2015]
    assert one(spark, "2024-07-01T12:00:00", lambda x: F.unix_seconds(c.helsinki_ts(x))) == 1719824400
    assert one(spark, "2021-12-31T22:00:00.000Z", c.iso_utc_date) == date(2021, 12, 31)
    assert one(spark, None, lambda x: c.text_concat(x, F.lit("a"))) == " a"


def test_wildcards_are_literal_unless_asked(spark):
    for q, parity, hit in [("%", False, False), ("%", True, True), ("a_c", False, False), ("a_c", True, True)]:
        assert one(spark, "abc", lambda x: c.ilike_match(x, q, "exact", parity)) is hit
    assert one(spark, "100%", lambda x: c.ilike_match(x, "0%", "substring")) is True


def test_boosts_add_up(spark):
    df = spark.createDataFrame([("Berg", "Bergbom"), ("Anna", "Lindberg"), (None, "berg")], "f string, l string")
    got = [round(r[0], 6) for r in df.select(c.boost_score(["f", "l"], "berg")).collect()]
    assert got == [1.6, 0.1, 1.6]


def test_speech_body(spark):
    df = spark.sql(
        "SELECT array('Alku', 'Kiitos', '  ', 'Loppu', 'Kiitos') AS p, "
        "array(named_struct('name', 'Puhemies', 'text', 'Kiitos'), named_struct('name', 'Puhemies', 'text', 'Muu'), "
        "named_struct('name', string(NULL), 'text', 'Alku')) AS c")
    body = df.select(c.assemble_bodies("p", "c").alias("b")).first().b
    assert body == "Alku\n\nLoppu\n\nKiitos\n\n**Puhemies**: Kiitos\n\n**Puhemies**: Muu"


def test_twins(spark):
    df = spark.createDataFrame([(1, "x"), (1, None), (2, None), (3, None), (3, None)], "id int, body string")
    assert [r.id for r in c.drop_empty_twins(df, "id", "body").collect()] == [1]
    assert sorted(r.id for r in c.lonely_empties(df, "id", "body").collect()) == [2, 3]


def test_sentinels(spark):
    df = spark.createDataFrame([("a",), (None,), (schemas.NOTHING_TO_DECLARE[0],)], "x string")
    assert [r.x for r in c.drop_sentinels(df, "x", schemas.NOTHING_TO_DECLARE).collect()] == ["a"]
