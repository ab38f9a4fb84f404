import random

import pytest
from pyspark.sql import functions as F

from factloom.operators.dense import heavy_blocks, key_counts, key_results

ROWS = [("a", "x")] * 5 + [("a", None)] * 3 + [(None, None)] * 2 + [("", "x"), ("-", "=")]


def test_key_counts_keep_every_key(spark):
    df = spark.createDataFrame(ROWS, "p string, q string").repartition(5)
    got = {(r.p, r.q): r.n for r in key_counts(df, ["p", "q"]).collect()}
    assert got == {k: ROWS.count(k) for k in set(ROWS)}


def test_results_of_all_keys_equal_a_grouping(spark, monkeypatch):
    from factloom.operators import blocks

    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", None, f"k{rng.randrange(500)}"]), f"q{rng.randrange(3)}", rng.choice([None, -5, 2**40, rng.randrange(99)]), i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "p string, q string, v bigint, hash int").repartition(9)
    expected = {tuple(r) for r in df.groupBy("p", "q").agg(F.count(F.lit(1)), F.sum("v"), F.min("v"), F.max("v")).collect()}
    for fan_in, keys, held, sent in ((32, 1 << 14, 1 << 18, 1 << 20), (2, 50, 100, 300)):
        for name, x in (("FAN_IN", fan_in), ("KEYS", keys), ("HELD", held), ("SENT", sent)):
            monkeypatch.setattr(blocks, name, x)
        assert {tuple(r) for r in key_results(df, ["p", "q"], "v").collect()} == expected


def test_sums_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([("a", 2**62)] * 3, "p string, v bigint").coalesce(1)
    with pytest.raises(Exception, match="64 bits"):
        key_results(df, ["p"], "v").collect()


def heavy(df, keys, share, **more):
    return {tuple(r) for r in heavy_blocks(df, keys, share, **more).collect()}


def test_heavy_blocks_with_nulls_ties_repeats_and_long_texts(spark):
    rows = [("a", None)] * 6 + [("b" * 50_000, "")] * 6 + [(None, None)] * 4 + [("", "x")] * 3 + [("c", "x")] * 5
    df = spark.createDataFrame(rows, "p string, q string").repartition(4)
    assert heavy(df, ["p", "q"], 4) == {("a", None, 6), ("b" * 50_000, "", 6)}
    assert heavy(df, ["p", "q"], 6) == {("a", None, 6), ("b" * 50_000, "", 6), (None, None, 4), ("c", "x", 5)}


def test_empty_table_has_no_blocks(spark):
    df = spark.createDataFrame([], "p string, q string")
    assert heavy(df, ["p"], 4) == set() and key_counts(df, ["p", "q"]).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", "b", "c")] * 3, "n string, salt string, cell string")
    assert heavy(df, ["salt", "cell"], 2) == {("b", "c", 3)}
    for f in (heavy_blocks, key_counts):
        with pytest.raises(ValueError):
            f(df, ["n"])
        got = f(df, ["n", "salt"], count="rows")
        assert got.columns == ["n", "salt", "rows"] and [tuple(r) for r in got.collect()] == [("a", "b", 3)]
