import pytest

from factloom.llm.mixture import mixture, spread, water_fill
from factloom.llm.tokens import count_tokens


def test_water_fill_makes_up_for_caps():
    assert water_fill(10, [1, 1], [100, 100]) == [5, 5]
    assert water_fill(10, [1, 1], [2, 100]) == [2, 8]
    assert water_fill(10, [1, 3, 0], [1, 2, 50]) == [1, 2, 0]


def test_siblings_make_up_before_ancestors():
    leaves = [(("a", "x"), 1.0, 1.0), (("a", "y"), 1.0, 100.0), (("b", "z"), 2.0, 100.0)]
    assert spread(leaves, 8.0) == {("a", "x"): 1.0, ("a", "y"): 3.0, ("b", "z"): 4.0}
    short = [(("a", "x"), 1.0, 1.0), (("a", "y"), 1.0, 1.0), (("b", "z"), 2.0, 100.0)]
    assert spread(short, 8.0) == {("a", "x"): 1.0, ("a", "y"): 1.0, ("b", "z"): 6.0}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, "a few words " * (1 + i % 5), "big", "en" if i % 3 else None) for i in range(300)]
    rows += [(1000 + i, "other words here " * 3, "small", "de") for i in range(20)] + [(2000, "stays out", "unlisted", "en"), (2001, "no source", None, "en"), (2002, "", "big", "en"), (2003, None, "small", "en")]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id bigint, text string, source string, lang string, tokens string")
    return docs, spark.createDataFrame([("big", 0.5, 2), ("small", 0.5, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")


def test_caps_hold_and_others_make_up(tables):
    taken, report = mixture(*tables)
    rows = taken.collect()
    uses = {}
    for r in rows:
        uses.setdefault((r.source, r.doc_id), []).append(r.epoch)
    assert {s for s, _ in uses} == {"big", "small"}
    assert all(sorted(e) == list(range(1, len(e) + 1)) and len(e) <= {"big": 2, "small": 3}[s] for (s, _), e in uses.items())
    got = {r.source: r for r in report.collect()}
    assert got["small"].most_repeats == 3 and got["small"].repeats_limit_it and got["small"].tokens_used == 3 * got["small"].tokens_available
    assert got["big"].tokens_used == sum(r.n_tokens for r in rows if r.source == "big")
    total = got["big"].tokens_available + got["small"].tokens_available
    assert 0 <= total - got["big"].tokens_used - got["small"].tokens_used <= 2 * count_tokens("a few words " * 5)
    assert abs(sum(r.reached_share for r in got.values()) - 1) < 1e-5 and got["absent"].tokens_used == 0


def test_exact_total_reaches_the_targets(tables):
    _, report = mixture(*tables, total_tokens="exact")
    got = {r.source: r.reached_share for r in report.collect()}
    assert abs(got["big"] - 0.5) < 0.03 and abs(got["small"] - 0.5) < 0.03


def test_same_seed_same_texts_and_many_buckets(tables, monkeypatch):
    from factloom.llm import mixture as module

    a = sorted(map(tuple, mixture(*tables, seed=1)[0].collect()))
    monkeypatch.setattr(module, "BUCKET", 7)
    b = sorted(map(tuple, mixture(*tables, seed=1)[0].collect()))
    assert a == b and a != sorted(map(tuple, mixture(*tables, seed=2)[0].collect()))


def test_empty_tables(tables):
    docs, targets = tables
    taken, report = mixture(docs.limit(0), targets)
    assert taken.count() == 0 and {r.reached_share for r in report.collect()} == {None}
    assert mixture(docs, targets.limit(0))[0].count() == 0
