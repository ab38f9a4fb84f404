import __spark_entry__ as e


def test_published_counts_of_the_fixture(spark):
    """FIXTURES 3.1 has these counts at sf0.01."""
    row = e.queries()["relate_reduction"](spark, "/root/testdata/sf0.01").first()
    assert (row.pairs, row.raw_disagreements, row.explained, row.blocked, row.unresolved) == (12400, 9417, 7976, 1371, 70)
    got = {r.verdict: r.n for r in e.queries()["relate_verdict_counts"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {"CONTEXTUAL": 500, "CONTEXTUAL_TEMPORAL": 8700, "CONTRADICTS": 70, "CORROBORATES": 330, "INSUFFICIENT_EVIDENCE": 2800}
