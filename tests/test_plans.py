"""Gate, second look, scopes, graph, questions, seats and evidence on small inputs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.operators import similarity
from factloom.plans import ask, grounding, rank, registry, relate, scope, scouts, temporal
from factloom.plans.claims import comparables, holdings

CLAIM = """id bigint, document_id bigint, page_no int, claim_type string, source string, subject string, predicate string, org_scope string, qualifiers map<string,string>,
unknown_qualifiers array<string>, modality string, value_raw string, value_num double, value_text string, valid_from date, valid_to date, valid_to_is_open boolean, evidence_quote string,
assertion_time date, unit_dimension string, unit_currency string, unit_scale double, period_start date, period_end date, period_label string, period_raw string"""
BASE = {
    "document_id": 1, "page_no": 0, "claim_type": "measurement", "source": "text", "subject": "Delta Ltd", "predicate": "Net sales", "org_scope": None, "qualifiers": {}, "unknown_qualifiers": [], "modality": "actual",
    "value_raw": "100", "value_num": 100.0, "value_text": None, "valid_from": None, "valid_to": None, "valid_to_is_open": None, "evidence_quote": "Net sales 100", "assertion_time": None, "unit_dimension": "currency",
    "unit_currency": "INR", "unit_scale": 1e6, "period_start": date(2019, 4, 1), "period_end": date(2020, 3, 31), "period_label": "FY2020", "period_raw": "FY2020",
}
NAMES = [c.strip().split()[0] for c in CLAIM.replace("\n", " ").replace("map<string,string>", "map").split(",")]


def claims(spark, *rows):
    return spark.createDataFrame([tuple({"id": k, **BASE, **r}[n] for n in NAMES) for k, r in enumerate(rows)], CLAIM)


STATE = {"claim_type": "state", "predicate": "Company secretary", "subject": "Asha Rao", "org_scope": "Delta Ltd", "value_raw": None, "value_num": None, "unit_dimension": None, "period_start": None, "period_end": None}


@pytest.mark.parametrize(
    "a,b,verdict,axis",
    [
        ({}, {"unit_dimension": None}, "INSUFFICIENT_EVIDENCE", "unit"),
        ({}, {"unit_dimension": "percent"}, "INCOMPARABLE", "unit"),
        ({}, {"unit_currency": "USD"}, "INCOMPARABLE", "currency"),
        ({}, {"unit_currency": None}, "INSUFFICIENT_EVIDENCE", "unit"),
        ({"qualifiers": {"consolidation": "standalone"}}, {"unknown_qualifiers": ["consolidation"]}, "INSUFFICIENT_EVIDENCE", "consolidation"),
        ({}, {"period_start": None}, "INSUFFICIENT_EVIDENCE", "period"),
        ({}, {"period_start": date(2020, 4, 1), "period_end": date(2021, 3, 31)}, "CONTEXTUAL_TEMPORAL", "period"),
        ({}, {"period_start": date(2020, 1, 1)}, "CONTEXTUAL", "period"),
        ({"qualifiers": {"consolidation": "standalone"}}, {"qualifiers": {"consolidation": "consolidated", "segment": "x"}}, "CONTEXTUAL", "consolidation"),
        ({}, {"modality": "target"}, "CONTEXTUAL", "modality"),
        ({}, {"value_num": None}, "INSUFFICIENT_EVIDENCE", "value"),
        ({}, {"value_raw": "100.2", "value_num": 100.2}, "CORROBORATES", None),
        ({}, {"value_raw": "101", "value_num": 101.0}, "CONTRADICTS", None),
        (STATE, {**STATE, "value_text": "x"}, "INSUFFICIENT_EVIDENCE", "value"),
        ({**STATE, "value_text": "Chief & head"}, {**STATE, "value_text": "chief and head"}, "CORROBORATES", None),
        ({**STATE, "value_text": "a"}, {**STATE, "value_text": "b"}, "CONTRADICTS", None),
        ({**STATE, "predicate": "Directors", "value_text": "a"}, {**STATE, "predicate": "Directors", "value_text": "b"}, "INCOMPARABLE", "cardinality"),
        ({**STATE, "valid_from": date(2000, 1, 1), "valid_to": date(2001, 1, 1)}, {**STATE, "valid_from": date(2001, 1, 1)}, "CONTEXTUAL_TEMPORAL", "valid_time"),
    ],
)
def test_gate(spark, a, b, verdict, axis):
    rows = comparables(claims(spark, a, b))
    got = relate.pairs(rows).first()
    assert (got.verdict, got.axis) == (verdict, axis)


def test_tallies_equal_the_pairs_one_by_one(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/claims.parquet")
    rows = comparables(df)
    for mask in ((), ("period",), ("unit", "modality")):
        listed = relate.pairs(rows, mask, most=10**9).groupBy("verdict", "axis").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("values_differ").alias("differing"))
        assert sorted(map(str, listed.collect())) == sorted(map(str, relate.tallies(rows, mask).collect()))
    assert relate.tallies(rows.limit(0)).count() == 0 and relate.corpus_reduction(rows.limit(0)).first().pairs == 0


def test_values_far_beyond_their_precision_are_tallied(spark):
    """A misread precision of 10^-11, none at all, and more digits than 64 bits hold."""
    near = 2.0**52
    values = [("Rs.10152920092", 10152920092.0), ("Rs.10152920092", 10152920092.0), ("nil", 5e3), ("nil", 5e3), ("nil", -5e3), ("nil", 0.0), ("nil", 1e300), ("10152920092", 10152920092.4), ("-3.25", -3.25), ("-3.2", -3.2)]
    values += [("1", sign * (near + d)) for d in (-2.0, -1.0, -0.5, 0.0, 1.0, 2.0) for sign in (1, -1)] + [("1e0", 2 * near - 1), ("1", 2 * near), ("1", 2 * near + 2), ("1", float("nan")), ("1", float("inf")), ("1", float("inf"))]
    rows = comparables(claims(spark, *[{"value_raw": raw, "value_num": v, "unit_scale": None} for raw, v in values]))
    listed = relate.pairs(rows).groupBy("verdict", "axis").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("values_differ").alias("differing"))
    got = relate.tallies(rows).collect()
    assert {r.verdict for r in got} == {"CORROBORATES", "CONTRADICTS"}
    assert sorted(map(str, listed.collect())) == sorted(map(str, got))


@pytest.mark.parametrize("mask", [("consolidation", "modality"), ("unit",), ("period",), ()])
def test_masked_tallies_of_odd_blocks(spark, mask):
    """Measurements and states in one block, predicates of one key that hold one or many, unheld values; by pairs and by classes."""
    odd = {"value_raw": "Rs.10152920092", "value_num": 10152920092.0, "unit_scale": None}
    state = {**STATE, "subject": "Delta Ltd", "predicate": "Net sales", "value_text": "chief financial officer"}
    many = {"subject": "Rao", "predicate": "Fees:", "claim_type": "state", "value_num": None, "period_start": None}
    rows = [
        odd, state, odd, {**state, "value_text": "cfo"}, {**odd, "unit_dimension": None}, {**state, "valid_from": date(2001, 1, 1)}, {**state, "valid_to": date(2001, 1, 1)}, {**odd, "modality": "target"},
        {**odd, "unit_currency": "USD", "qualifiers": {"consolidation": "standalone", "segment": None}}, {**odd, "unknown_qualifiers": ["consolidation"]}, {**odd, "period_start": date(2020, 1, 1)}, {**odd, "period_end": None},
        {**many, "value_text": "a"}, {**many, "predicate": "Fees/", "value_text": "b"}, {**many, "predicate": "Fees", "value_text": "a"}, {**many, "predicate": "Fees/"}, {**odd, "subject": None}, {**odd, "predicate": " "},
    ]
    rows = comparables(claims(spark, *rows))
    listed = relate.pairs(rows, mask).groupBy("verdict", "axis").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("values_differ").alias("differing"))
    expected = sorted(map(str, listed.collect()))
    for small in (64, 1):
        assert sorted(map(str, relate.tallies(rows, mask, small).collect())) == expected


@pytest.mark.parametrize("mask", [("unit",), (), ("period",)])
def test_states_before_other_kinds_are_tallied_by_their_dates_and_texts(spark, mask):
    """Claims of one context and period, which differ only in dates or texts that a state looks at."""
    early, late = {"valid_to": date(2001, 1, 1)}, {"valid_from": date(2005, 1, 1)}
    state = {**STATE, "subject": "Delta Ltd", "predicate": "Net sales", "value_text": "7 mills"}
    other = {**state, "claim_type": "event"}
    figure = {"period_start": None, "period_end": None}
    rows = comparables(claims(spark, {**state, **early}, {**figure, **late}, {**figure, **early}, figure, {**other, **early}, {**other, **early, "value_text": "8 mills"}, {**other, **late}))
    listed = relate.pairs(rows, mask).groupBy("verdict", "axis").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("values_differ").alias("differing"))
    assert sorted(map(str, relate.tallies(rows, mask, 1).collect())) == sorted(map(str, listed.collect()))


def test_the_text_of_an_untyped_claim_is_kept(spark):
    state = {**STATE, "subject": "Delta Ltd", "predicate": "Net sales", "value_text": "7 mills"}
    rows = comparables(claims(spark, state, {**state, "claim_type": None}, {**state, "claim_type": "measurement"}))
    assert [r.text for r in rows.orderBy("claim_id").collect()] == [["7", "mills"], ["7", "mills"], []]
    assert {(r.verdict, r.axis): r.pairs for r in relate.tallies(rows).collect()} == {("CORROBORATES", None): 1, ("INCOMPARABLE", "cardinality"): 1, ("INSUFFICIENT_EVIDENCE", "value"): 1}


def test_registers(spark):
    pairs = spark.createDataFrame([(1, "CONTEXTUAL", "segment", True), (2, "CONTEXTUAL", "segment", True), (3, "CONTEXTUAL", "basis", True), (4, "CONTEXTUAL", "period", False), (5, "CORROBORATES", None, False)], "claim_a int, verdict string, axis string, values_differ boolean")
    assert {r.axis: (r.origin, r.status, r.resolves) for r in registry.axes(pairs).collect()} == {"segment": ("discovered", "promoted", 2), "basis": ("discovered", "candidate", 1), "period": ("seed", "active", 0)}
    known = spark.createDataFrame([("a", 1)], "key string, entity int")
    assert sorted(map(tuple, registry.learn(known, spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "key string, entity int"), "key").collect())) == [("a", 1), ("b", 2)]
    merged = registry.merge_entities(spark.createDataFrame([(1, "x"), (2, "y")], "entity_id int, v string"), spark.createDataFrame([(2, 1)], "absorbed int, kept int"))
    assert {r.v: r.entity_id for r in merged.collect()} == {"x": 1, "y": 1}


def test_successions_vacancies_and_closures(spark):
    seat = {**STATE, "value_text": None}
    rows = [
        {**seat, "subject": "A", "valid_from": date(2000, 1, 1), "valid_to": date(2001, 5, 31), "document_id": 1},
        {**seat, "subject": "B", "valid_from": date(2001, 6, 1), "valid_to": date(2002, 3, 27), "document_id": 2},
        {**seat, "subject": "C", "valid_from": date(2002, 5, 17), "valid_to_is_open": True, "document_id": 3, "assertion_time": date(2003, 1, 1)},
        {**seat, "subject": "C", "valid_from": date(2002, 5, 17), "valid_to": date(2004, 1, 1), "document_id": 4, "assertion_time": date(2005, 1, 1)},
    ]
    held = holdings(claims(spark, *rows))
    got = {(r.first, r.second): (r.verdict, r.gap_days, r.vacant_days) for r in temporal.successions(held).collect()}
    assert got[("A", "B")] == ("SUCCESSION", 1, 0) and got[("B", "C")] == ("SUCCESSION_WITH_VACANCY", 51, 50)
    verdicts = {(r.ref_a, r.ref_b): r.verdict for r in temporal.related(held).collect()}
    assert set(verdicts.values()) == {"SUCCESSION", "SUCCESSION_WITH_VACANCY", "CLOSES_INTERVAL"}
    assert [r.filler for r in temporal.roster(held, "2002-01-01").collect()] == ["B"]
    double = holdings(claims(spark, rows[0], {**rows[0], "subject": "D"}))
    assert temporal.observed_cardinality(double).first().observed == 0 and temporal.observed_cardinality(held).first().observed == 1


@pytest.mark.parametrize(
    "quote,value,page,method,reason",
    [
        ("sales were 81,415.38 in all", "81,415.38", "The sales were 81,415.38 in all.", "exact", None),
        ("sales were 81 415.38 in all", "81,415.38", "The sales  were\n81 415.38 in all.", "normalized", None),
        ("fuel-efficient fleet of 46", "46", "fuel- efficient fleet of 46", "dehyphenated", None),
        ("Parcels | 50,765.87 | 45,522.22", "50,765.87", "x\nParcels | 50,765.87 | 62.35% | 45,522.22 | 63%", "row_subset", None),
        ("Parcels | 45,522.22 | 50,765.87", "50,765.87", "Parcels | 50,765.87 | 45,522.22", "none", "quote_not_found"),
        ("", "1", "1", "none", "empty_quote"),
        ("sales were 5 in all", "", "sales were 5 in all", "exact", "missing_value"),
        ("sales were 5 in all", "6", "sales were 5 in all", "exact", "value_not_in_quote"),
    ],
)
def test_grounding(spark, quote, value, page, method, reason):
    pages = spark.createDataFrame([(1, 1, 0, page), (2, 1, 0, "ingested again")], "id bigint, document_id bigint, page_no int, text string")
    got = grounding.grounded(claims(spark, {"evidence_quote": quote, "value_raw": value}), pages).first()
    assert (got.method, got.reason_code, got.ok) == (method, reason, reason is None)


def test_second_look(spark):
    row = spark.createDataFrame([(100.0, -100.2, "(100)", "100.2", "Less: fees | (100)", "Fees | 100.2")], "a double, b double, ra string, rb string, pa string, pb string")
    c = lambda *n: [F.col(x) for x in n]
    got = row.select(
        scouts.sign_lead(*c("a", "b", "ra", "rb", "pa", "pb")).alias("sign"), scouts.row_label_lead(*c("ra", "rb", "pa", "pb")).alias("row"), scouts.is_circular(F.lit("about 100.2"), F.col("rb"), F.lit("INR")).alias("c1"),
        scouts.is_circular(F.lit("12 INR"), F.col("rb"), F.lit("INR")).alias("c2"), scouts.is_circular(F.lit("gross"), F.col("rb"), F.lit("INR")).alias("c3"),
        scouts.shared_span_lead(F.lit("5 and 6  respectively"), F.lit("5 and 6 respectively")).alias("span"),
        scouts.reconsidered(F.lit("CONTRADICTS"), F.lit("gross"), F.lit("net"), F.lit(0.7)).alias("v1"), scouts.reconsidered(F.lit("CONTRADICTS"), F.lit("gross"), F.lit("net"), F.lit(0.5)).alias("v2"),
        F.map_values(scouts.with_axes(F.create_map(F.lit("k"), F.lit("old")), F.create_map(F.lit("k"), F.lit("new"), F.lit("j"), F.lit("x")))).alias("m"),
    ).first()
    assert (got.sign, got.row, got.c1, got.c2, got.c3, got.span, got.v1, got.v2) == (0.7, 0.8, True, True, False, 0.9, "CONTEXTUAL", "CONTRADICTS") and set(got.m) == {"old", "x"}


def test_declarations_and_their_reach(spark):
    lines = [("Consolidated statements", 20.0), ("(All amounts in ₹ million)", 10.0), ("Sales 12", 10.0), ("Segment, standalone", 16.0), ("text", 10.0), ("(USD thousand)", 10.0), ("more", 10.0), ("Other", 20.0), ("x", 10.0)]
    df = spark.createDataFrame([(1, k, t, s, k * 12.0) for k, (t, s) in enumerate(lines)], "page_id int, line_no int, text string, size double, y double")
    assert scope.body_size(df).first().body == 10.0
    df = scope.heading_levels(df, 10.0).withColumn("declared", scope.declarations(F.col("text"), F.lit(False)))
    got = {r.line_no: r.frame for r in scope.inherited(df).collect()}
    assert got[2] == {"consolidation": "consolidated", "currency": "INR", "scale": "million"}
    assert got[4] == {"consolidation": "standalone"} and got[6] == {"consolidation": "standalone", "currency": "USD", "scale": "thousand"} and got[8] == {}
    assert scope.frame_changes(scope.inherited(df)).count() >= 4
    assert df.select(F.max(F.size(scope.declarations(F.lit("in ₹ million " + "x" * 200), F.lit(False))))).first()[0] == 0


def test_rows_are_anchored_to_their_first_cell(spark):
    cells = spark.createDataFrame([(1, 0.0, 1.0, "a"), (1, 2.0, 2.0, "b"), (1, 4.0, 3.0, "c"), (1, 6.4, 0.0, "d")], "page_id int, y double, x double, text string")
    assert {r.text: r.row_no for r in scope.rows_of(cells).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}


def test_walks_add_up_and_return_what_is_lost(spark):
    graph = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 3.0)], "src string, dst string, w double")
    seeds = spark.createDataFrame([("a", "a"), ("b", "b")], "seed string, node string")
    ranks = {(r.seed, r.node): r["rank"] for r in rank.personalized(graph, seeds).collect()}
    assert abs(sum(v for (s, _), v in ranks.items() if s == "a") - 1) < 1e-6 and ranks[("a", "c")] == pytest.approx(0.85 * 0.75 * ranks[("a", "b")], rel=1e-4)
    hops = {r.node: r.hop for r in rank.neighbourhood(graph, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert hops == {"a": 0, "b": 1, "c": 2}


def test_questions(spark):
    names = spark.createDataFrame([("metric", "Net sales"), ("metric", "Gross margin"), ("subject", "Delta Foods Limited")], "kind string, name string")
    asked = spark.createDataFrame([("What were the net sales of Delta Foods?",), ("",), (None,)], "question string")
    assert {(r.kind, r.name) for r in ask.resolve(asked, names).collect()} == {("metric", "Net sales"), ("subject", "Delta Foods Limited")}
    df = claims(spark, {}, {"value_num": 130.0}, {"qualifiers": {"consolidation": "standalone"}}, {"period_label": "FY2021"})
    got = {(r.period, r.context): r.incoherent for r in ask.contexts(df).collect()}
    assert got[("FY2020", "modality=actual")] and not got[("FY2021", "modality=actual")]
    assert [(r.axis, r.n_values) for r in ask.distinguishing(df).collect()] == [("consolidation", 2)]


def test_similarity_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [2.0, 0.1])], "vec_id bigint, embedding array<double>")
    expected = [(1, 1, 2), (1, 2, 7), (2, 1, 7), (2, 2, 1)]
    for block in (16_384, 1):
        monkeypatch.setattr(similarity, "BLOCK", block)
        got = similarity.top_k(rows, rows.filter("vec_id <= 2"), k=2)
        assert sorted((r.query, r["rank"], r.other) for r in got.collect()) == expected
    assert similarity.top_k(rows.limit(0), rows.limit(0)).count() == 0


def test_remembered_explanations_are_judged_again(spark):
    rows = [("CONTRADICTS", "gross", "net", 0.7, "CONTEXTUAL"), ("CONTRADICTS", "about 5", "net", 0.9, "CONTRADICTS"), ("CONTRADICTS", None, "", 0.9, "CONTRADICTS"), ("CONTRADICTS", "gross", "gross", 0.9, "CONTRADICTS"), ("CONTRADICTS", "gross", None, 0.5, "CONTRADICTS"), ("CONTEXTUAL", "a", "b", 0.9, "CONTEXTUAL")]
    df = spark.createDataFrame(rows, "v string, a string, b string, c double, expected string")
    lit = F.lit
    got = df.select(scouts.reapplied(F.col("v"), F.col("a"), F.col("b"), F.col("c"), lit("5"), lit("6"), lit("INR"), lit("INR")).alias("x"), "expected").collect()
    assert all(r.x == r.expected for r in got)


def test_recovered_axes_enter_the_graph_unless_held_out(spark):
    graph = spark.createDataFrame([("claim:1", "doc:1", 1.0), ("doc:1", "claim:1", 1.0), ("claim:2", "doc:1", 1.0), ("doc:1", "claim:2", 1.0)], "src string, dst string, w double")
    relations = spark.createDataFrame([(7, 1, 2, "basis", "gross", None), (8, 1, 9, "basis", "net", "x")], "relation_id int, claim_a int, claim_b int, axis string, value_a string, value_b string")
    weights = spark.createDataFrame([("axis:basis", 2.0)], "node string, weight double")
    new = {(r.src, r.dst) for r in rank.with_recovered(graph, relations, weights, 10, spark.createDataFrame([(8,)], "relation_id int")).collect()} - {(r.src, r.dst) for r in graph.collect()}
    assert new == {("claim:1", "qual:basis=gross"), ("qual:basis=gross", "axis:basis"), ("claim:2", "axis:basis")} | {("qual:basis=gross", "claim:1"), ("axis:basis", "qual:basis=gross"), ("axis:basis", "claim:2")}
