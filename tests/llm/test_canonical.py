import pytest

from factloom.llm.canonical import NameList, SymmetricDeletes, deletes, edits, found, map_to_list, weighted_distance

NAMES = [(1, "Net sales"), (1, "Turnover"), (2, "Policy interest rate"), (3, "Chief risk officer"), (3, "CRO"), (4, "Capital expenditure"), (5, "Cost of goods sold")]


@pytest.mark.parametrize(
    "typed,entry",
    [("Net sales", 1), ("(a) Nett sales [A]", 1), ("Sales, net - restated", 1), ("turnover.", 1), ("rate Policy interest", 2), ("Plicyintreestrate", 2), ("Poli. inte. rate", 2),
     ("Policy seminar seats", 0), ("Chief risk Offr", 3), ("Chf-rsk-ffcr", 3), ("CRO", 3), ("Cap. exp.", 4), ("Of which: Cptl expndtr", 4), ("Cst of goosd slod", 5), ("tbd", 0), ("", 0), (None, 0), ("-", 0), ("x" * 100_000, 0)],
)
def test_typed_names(typed, entry):
    assert NameList(NAMES, {}).find(typed) == entry


def test_symmetric_deletes_miss_no_word_within_the_edits():
    words = ["sales", "policy", "interest", "officer", "expenditure"]
    lookup = SymmetricDeletes(words)
    for w in words:
        for q in {w[:i] + c + w[j:] for i in range(len(w)) for j in (i, i + 1) for c in ("", "q")}:
            assert w in lookup.near(q) or edits(q) == 0
    assert deletes("ab", 2) == {"ab", "a", "b", ""}


def test_weights():
    assert weighted_distance("ab", "ba") < weighted_distance("ab", "cd") and weighted_distance("sales", "saless") < weighted_distance("sales", "salesx")


def test_equal_scores_go_to_the_more_frequent_name():
    two = [(1, "Net salas"), (2, "Net salis")]
    assert NameList(two, {}).find("Net salxs") == 1 and NameList(two, {"Net salis": 3}).find("Net salxs") == 2


def test_tables(spark):
    claims = spark.createDataFrame([(1, "Net sales", 9), (2, "net sales", 9), (2, "net sales", 9), (3, None, 9), (4, "", 9), (5, "Others", 9)], "id bigint, predicate string, metric_id int")
    metrics = spark.createDataFrame([(7, "Net sales", "x"), (8, None, "x")], "id bigint, canonical_name string, dimension string")
    aliases = spark.createDataFrame([(1, 7, "Turnover")], "id bigint, metric_id bigint, alias string")
    got = sorted(map(tuple, found(claims, metrics, aliases).collect()))
    assert got == [(2, 7), (2, 7), (3, 0), (4, 0), (5, 0)]
    assert found(claims.limit(0), metrics, aliases).count() == 0
    assert {r.metric_id for r in found(claims, metrics.limit(0), aliases.limit(0)).collect()} == {0}
    names = spark.createDataFrame([(7, "Net sales")], "entry_id bigint, name string")
    assert map_to_list(claims, names).count() == 6
