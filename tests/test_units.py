"""Printed figures and units of problem 1."""

from factloom.operators.units import found, resolve, segment, to_base_units


def from_quote(value, quote, predicate="Net sales"):
    return resolve(value, None, quote, predicate, None, None, None, None)


def test_a_digit_of_a_period_label_is_no_figure():
    assert from_quote("2", "Net sales | Q2 FY2014 | 2 billion ₹") == ("INR", 2 * 10**12)
    assert from_quote("1", "Net sales | H1 FY2014 | 1 billion ₹") == ("INR", 10**12)
    assert from_quote("2", "Net sales | Rs2 bn") == ("INR", 2 * 10**12)


def test_a_place_without_unit_gives_way_to_the_next():
    assert from_quote("3", "Net sales, note 3, came to 3 million euros") == ("EUR", 3 * 10**9)
    assert from_quote("3", "Net sales | 3 (previous year 3 million euros)") is None
    assert from_quote("3", "Net sales | 3") is None


def test_a_unit_string_may_be_long_or_change_length_in_lower_case():
    padded = "(" + " " * 100 + "₹ million)"
    assert resolve("12", padded, None, None, None, None, None, None) == ("INR", 12 * 10**9)
    assert segment("million İ") is None and segment("x" * 100_000) is None
    assert segment(" " * 5000 + "Rs crore") == ("INR", 10**7, 1, 1)


def test_units_of_headings_labels_and_long_phrases_are_seen():
    assert from_quote("289", "₹ in crore | Net sales | FY2020 | 289") == ("INR", 289 * 10**10)
    assert from_quote("289", "Net sales (USD million) | FY2020 | 289") == ("USD", 289 * 10**9)
    assert from_quote("289", "Net sales (USD million): 289 €") == ("EUR", 289 * 10**3)
    assert from_quote("28", "Days | FY2018 | 28", "Days") is None
    assert from_quote("289", "EBIT 3 (USD) | Net sales | 289") is None
    assert from_quote("289", "Net sales 289 (" + " " * 50 + "USD million)") == ("USD", 289 * 10**9)


COLUMNS = """id bigint, claim_type string, value_raw string, unit_raw string, evidence_quote string, predicate string,
unit_dimension string, unit_currency string, unit_scale double, qualifiers map<string,string>, claim_id bigint, base_unit string"""


def test_rows_with_nulls_repeats_long_texts_and_clashing_columns(spark):
    row = lambda i, value, unit, quote=None: (i, "measurement", value, unit, quote, None, None, None, None, None, 77, "x")
    rows = [
        row(1, None, None), row(2, "", ""), row(3, "-", "USD"), row(4, "5", None),
        row(5, "5", "USD mn"), row(5, "5", "USD mn"), row(6, "7", None, "word " * 20_000 + "7 kg"), row(None, "1", "%"),
        (8, "state", "5", "USD", *[None] * 6, 77, "x"),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    got = sorted(map(tuple, to_base_units(df).drop("problem").collect()), key=repr)
    assert got == sorted([(1, None, None), (2, None, None), (3, None, None), (4, None, None), (5, "USD", 5 * 10**9), (5, "USD", 5 * 10**9), (6, "tonnes", 7), (None, "percent", 1000)], key=repr)
    assert found(df).count() == 4
    assert to_base_units(df.limit(0)).count() == 0


def test_equal_costs_always_give_the_same():
    assert {segment.__wrapped__("mn t", None) for _ in range(5)} == {("tonnes", 10**6, 1, 1)}


def test_the_fields_dimension_decides_between_readings():
    assert segment("pounds", None)[0] == segment("pounds", "GBP")[0] == "GBP"
    assert segment("pounds", "tonnes") == ("tonnes", None, 45359237, 10**11)
    assert segment("points", None)[0] == "percentage_points" and segment("points", "percent") == ("percent", None, 1, 100) and segment("points", "count")[0] == "count"
    assert segment("times", None)[0] == "ratio" and segment("times", "count")[0] == "count"
    assert resolve("2,000", "pounds", None, None, "mass_tonnes", None, None, None) == ("tonnes", 907)


def test_powers_of_ten_and_letters_after_a_root():
    for text, size in (("USD 10^12", 10**12), ("10⁶ USD", 10**6), ("USD x10^6", 10**6), ("USD x10³", 10**3), ("€m", 10**6), ("USD m", 10**6), ("$B", 10**9), ("INR hundred crore", 10**9)):
        assert segment(text)[1] == size, text
    assert segment("10^99 USD") is None and segment("mt") == ("tonnes", None, 1, 1) and segment("Mt") == ("tonnes", 10**6, 1, 1)
    assert segment("shipments")[0] == "count" and segment("sterling")[0] == "GBP" and segment("dollar")[0] == "USD"


def test_a_printed_scale_keeps_the_stored_unit():
    assert resolve("5 thousand", None, None, None, "mass_tonnes", None, 0.001, None) == ("tonnes", 5000)


def test_what_cannot_be_held_is_reported(spark):
    rows = [(1, "measurement", "9" * 30, "USD bn", *[None] * 6, 1, "x"), (2, "measurement", "1", "kg", *[None] * 6, 1, "x"), (3, "measurement", "1.5", "kg", *[None] * 6, 1, "x"), (4, "measurement", "-", "kg", *[None] * 6, 1, "x")]
    got = {r.claim_id: (r.base_unit, r.problem) for r in to_base_units(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {1: (None, "beyond 64 bits"), 2: ("tonnes", None), 3: ("tonnes", "rounded"), 4: (None, "undetermined")}
