import random
from collections import defaultdict

from factloom.llm.recompression import coverage, shared_spans


def naive(rows, least):
    where = defaultdict(set)
    for d, t in rows:
        for i in range(len(t or "") - least + 1):
            where[t[i : i + least]].add(d)
    out = []
    for d, t in rows:
        spans = []
        for i in range(len(t or "") - least + 1):
            if len(where[t[i : i + least]]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + least
                else:
                    spans.append([i, i + least])
        out += [(d, s, e) for s, e in spans]
    return sorted(out)


def test_equals_the_naive_comparison(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab\U0001f600é ") for _ in range(n))
    parts = [word(n) for n in (19, 20, 21, 35, 60)]
    rows = [(i, "".join(rng.choice([*parts, word(rng.randrange(30))]) for _ in range(rng.randrange(6)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "x" * 300), (63, "zq" * 100), (64, "zq" * 30), (65, parts[4]), (66, parts[4])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = naive(rows, 20)
    assert sorted(map(tuple, shared_spans(df, 20).collect())) == expected
    assert {r.doc_id: r.shared_chars for r in coverage(df, 20).collect()} == {d: sum(e - s for x, s, e in expected if x == d) for d, _ in rows}


def test_given_documents_equal_the_naive_comparison(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    expected = naive(rows, 160)
    assert expected and sorted(map(tuple, shared_spans(df, 160).collect())) == expected


def test_hot_and_crowded_symbols_lose_nothing(spark, monkeypatch):
    from factloom.llm import recompression

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = [word(26), word(45), "- " * 15]
    rows = [(i, word(rng.randrange(12)) + rng.choice(common) + word(rng.randrange(12)) + rng.choice(common)) for i in range(80)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(7, rows[1][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n int")
    joined = {}
    for d, t in rows:
        joined.setdefault(d, []).append(t)
    expected = sorted({(d, s, e) for d, s, e in naive([r for r in rows if r[0] != 7], 20)})
    for sample, crowd in ((2000, 256), (0, 0), (0, 10**9), (100, 3)):
        monkeypatch.setattr(recompression, "SAMPLE", sample)
        monkeypatch.setattr(recompression, "CROWD", crowd)
        got = sorted(map(tuple, shared_spans(df.filter("doc_id <> 7"), 20).collect()))
        assert got == expected and got


def test_equal_windows_belong_to_equal_symbols():
    from factloom.llm.recompression import window_runs

    rng = random.Random(9)
    core = "".join(rng.choice("ab c-.é") for _ in range(400))
    texts = [core, "zz " + core + "q", "x" * 50 + core[100:300] + "y" * 90, "", "short", "x" * 300]
    key, _, number, first, n = window_runs(texts, 60)
    by = {}
    for s, t, f, k in zip(key.tolist(), number.tolist(), first.tolist(), n.tolist()):
        for i in range(f, f + k):
            by.setdefault(texts[t][i : i + 60], []).append(s)
    assert all(len(set(v)) == 1 for v in by.values())
    where = [t[i : i + 60] for t in texts for i in range(len(t) - 59)]
    assert {w: len(v) for w, v in by.items()} == {w: where.count(w) for w in set(where)}


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a" * 50), (1, "a" * 50)], "doc_id bigint, text string")
    assert shared_spans(df, 20).count() == 0 and shared_spans(df.limit(0), 20).count() == 0
