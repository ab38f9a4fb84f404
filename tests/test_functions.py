"""Column expressions against literals."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.functions import periods, texts, values


def one(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in given.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,scale,expected", [("2", 1e7, 1e7), ("16.54", 1e6, 1e4), ("72,253", 1.0, 1.0), ("72,253.01", 1.0, 0.01), ("(1,234.5)", 1.0, 0.1), ("12.5 %", 1.0, 0.1), ("-", 1.0, None), (None, 1.0, None)])
def test_written_precision(spark, raw, scale, expected):
    assert one(spark, values.written_precision(F.col("r"), F.col("s")), r=raw, s=scale) == (pytest.approx(expected) if expected else None)


def test_agreement_is_strict_at_the_edge(spark):
    def agree(a, b, pa, pb):
        row = spark.createDataFrame([(a, b, pa, pb)], "a double, b double, pa double, pb double")
        return row.select(values.agree(*map(F.col, ("a", "b", "pa", "pb"))).alias("x")).first().x

    assert agree(6.6, 6.5, 0.1, 0.1) is False and agree(6.6, 6.56, 0.1, 0.1) is True
    assert agree(5.0, 5.0, None, None) is True and agree(5.0, 5.1, None, None) is False and agree(None, 5.0, 1.0, 1.0) is None


@pytest.mark.parametrize(
    "a,b,same",
    [("Company Secretary & Compliance Officer", "company secretary and compliance officer", True), ("IGI Airport", "Indira Gandhi International Airport", True), ("Indira Gandhi International Airport", "IGI Airport", True),
     ("12 Main Road", "14 Main Road", False), ("Chair", "Treasurer", False), ("", "x", None), ("IGI", "Indira Gandhi", False)],
)
def test_texts_agree(spark, a, b, same):
    assert one(spark, values.texts_agree(values.text_tokens(F.col("a")), values.text_tokens(F.col("b"))), a=a, b=b) is same


@pytest.mark.parametrize(
    "raw,hint,month,label,start,end,confidence",
    [
        ("Q4 FY24", None, 4, "Q4 FY2024", date(2024, 1, 1), date(2024, 3, 31), 1.0),
        ("Q1 2019-20", None, 4, "Q1 FY2020", date(2019, 4, 1), date(2019, 6, 30), 1.0),
        ("FY2023-24", None, 4, "FY2024", date(2023, 4, 1), date(2024, 3, 31), 1.0),
        ("FY99", None, 4, "FY1999", date(1998, 4, 1), date(1999, 3, 31), 1.0),
        ("FY2024", None, 1, "FY2024", date(2024, 1, 1), date(2024, 12, 31), 1.0),
        ("March 31, 2024", "for the year ended", 4, "FY2024", date(2023, 4, 1), date(2024, 3, 31), 1.0),
        ("March 31, 2024", "as at", 4, "2024-03-31", date(2024, 3, 31), date(2024, 3, 31), 1.0),
        ("March 31, 2024", None, 4, "FY2024", date(2023, 4, 1), date(2024, 3, 31), 0.6),
        ("2024-05-15", None, 4, "2024-05-15", date(2024, 5, 15), date(2024, 5, 15), 0.9),
        ("2023-24", None, 4, "FY2024", date(2023, 4, 1), date(2024, 3, 31), 1.0),
        ("2016-23", None, 4, "2016-2023", date(2016, 1, 1), date(2023, 12, 31), 1.0),
        ("1999-00", None, 4, "FY2000", date(1999, 4, 1), date(2000, 3, 31), 1.0),
        ("2021", None, 4, "2021", date(2021, 1, 1), date(2021, 12, 31), 0.7),
        ("soon", None, 4, "unknown", None, None, 0.0),
        (None, None, 4, "unknown", None, None, 0.0),
    ],
)
def test_periods(spark, raw, hint, month, label, start, end, confidence):
    got = one(spark, periods.parse_period(F.col("r"), F.col("h"), month), r=raw, h=hint)
    assert (got.label, got.start, got.end, got.confidence) == (label, start, end, confidence) and got.ambiguous == (confidence == 0.6)


@pytest.mark.parametrize("text,month", [("for the year ended March 31", 4), ("year ended 31 December", 1), ("period ending the 30 September", 10), ("nothing", 4)])
def test_fiscal_calendars(spark, text, month):
    assert one(spark, periods.fiscal_start_month(F.col("t")), t=text) == month


@pytest.mark.parametrize("name,key", [("Delta Foods Private Limited", "delta foods"), ("M. Delta, Ltd.", "m delta"), ("Dr. Asha Rao", "asha rao"), ("Company", "company"), (None, "")])
def test_name_keys(spark, name, key):
    assert one(spark, texts.name_key(F.col("n")), n=name) == key


def test_identifiers(spark):
    got = one(spark, texts.identifiers(F.col("t")), t="CIN L63090DL2011PLC221234, again L63090DL2011PLC221234; DIN: 00012345; ISIN INE148O01028")
    assert [tuple(x) for x in got] == [("cin", "L63090DL2011PLC221234", "DL2011221234"), ("din", "00012345", "00012345"), ("isin", "INE148O01028", "INE148O01028")]


@pytest.mark.parametrize("predicate,n", [("Company Secretary", 1), ("Managing Director", 1), ("Non-Executive Director", 0), ("Head - New Ventures", 1), ("Previous roles", 0), ("Registered office", 1), ("Chair of the board", 1), (None, 1)])
def test_cardinality(spark, predicate, n):
    assert one(spark, texts.cardinality(F.col("p")), p=predicate) == n


def test_tokens_and_terms(spark):
    assert one(spark, texts.tokens(F.col("t")), t="The Sales, of glass boxes") == ["the", "sale", "glass", "boxe"]
    assert one(spark, texts.terms(F.col("t"), ["the"]), t="The non-current Assets the") == ["non-current", "assets"]


def test_local_terms_read_each_text_once(spark):
    """Every word's score once read both texts again; equal scores leave the first place's words first."""
    texts_of = lambda *words: " ".join(words)
    rows = [(texts_of("The", "zeta", "same", "alpha"), texts_of("same", "beta", "gamma")), (texts_of("one", "two", "same", "ten"), texts_of("same", "SAME", "new")), (None, texts_of("word")), (texts_of(*[f"a{chr(97 + i)}x" for i in range(14)]), "")]
    df = spark.createDataFrame(rows, "a string, b string").select(texts.local_terms(F.col("a"), F.col("b"), ["the"]).alias("t"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2
    got = [[(t.word, round(t.score, 6)) for t in r.t] for r in df.collect()]
    third = 0.333333
    assert got[0] == [("alpha", third), ("zeta", third), ("beta", third), ("gamma", third)]
    assert got[1] == [("new", 0.5), ("one", 0.25), ("ten", 0.25), ("two", 0.25)]
    assert got[2] == [("word", 0.5)] and [w for w, _ in got[3]] == [f"a{chr(97 + i)}x" for i in range(12)]
