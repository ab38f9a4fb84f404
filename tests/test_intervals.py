from datetime import date

from factloom.operators.intervals import periods_and_gaps

SCHEMA = "claim_type string, subject string, org_scope string, predicate string, valid_from date, valid_to date, valid_to_is_open boolean"


def run(spark, rows):
    df = spark.createDataFrame([("state", "s", None, "p", *r) for r in rows], SCHEMA)
    return sorted(tuple(r)[3:] for r in periods_and_gaps(df).collect())


def test_adjoining_overlapping_and_gap(spark):
    d = date
    got = run(spark, [(d(2000, 1, 1), d(2001, 5, 31), False), (d(2001, 6, 1), d(2001, 7, 1), None), (d(2001, 7, 3), d(2001, 8, 1), False), (d(2000, 2, 1), d(2000, 3, 1), False)])
    assert got == [("gap", "2001-07-02", "2001-07-02"), ("period", "2000-01-01", "2001-07-01"), ("period", "2001-07-03", "2001-08-01")]


def test_open_ends_and_rows_that_assert_nothing(spark):
    d = date
    assert run(spark, [(None, None, True), (d(2000, 1, 2), d(2000, 1, 1), False)]) == []
    assert run(spark, [(None, d(2000, 1, 1), False), (d(2005, 1, 1), d(2006, 1, 1), True)]) == [
        ("gap", "2000-01-02", "2004-12-31"), ("period", "0001-01-01", "2000-01-01"), ("period", "2005-01-01", "9999-12-31")]


def test_hot_group_over_many_splits_equals_a_naive_sweep(spark, monkeypatch):
    import random

    from factloom.operators import blocks, intervals

    monkeypatch.setattr(blocks, "FAN_IN", 2)
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        s = rng.randrange(-700_000, 2_900_000) if rng.random() < 0.5 else rng.randrange(400)
        rows.append((rng.choice(["hot", "hot", None, "x"]), s, s + rng.randrange(3)))
    got = {}
    for r in intervals.merge(spark.createDataFrame(rows, "k string, s int, e int").repartition(7), ["k"]).collect():
        got.setdefault(r.k, []).append((r.s, r.e, r.after))
    for k in ("hot", None, "x"):
        runs = []
        for s, e in sorted((s, e) for x, s, e in rows if x == k):
            if runs and s <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        assert sorted(got[k]) == [(s, e, runs[i + 1][0] if i + 1 < len(runs) else None) for i, (s, e) in enumerate(runs)]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([("state", "s", None, None, date(2000, 1, 1), None, None, 1, "x")], SCHEMA + ", s int, hash string")
    assert [tuple(r) for r in periods_and_gaps(df).collect()] == [("s", "", None, "period", "2000-01-01", "9999-12-31")]
    assert periods_and_gaps(df.limit(0)).count() == 0
