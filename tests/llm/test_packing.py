import random

import numpy as np
import pytest

from factloom.llm.packing import containers, report, sum_of_squares
from factloom.llm.tokens import count_tokens, encoding, stretches, VOCABULARY


def naive(items, capacity):
    """The rule with nothing but a list of levels."""
    levels, out = [], []
    for size in items:
        if size == 0:
            out.append(out[-1] if out else 0)
            levels = levels or [0]
            continue
        options = {lv for lv in levels if lv + size <= capacity} | {0}

        def squares(lv):
            left = list(levels)
            if lv in left and (lv or 0 in levels):
                left.remove(lv)
            left.append(lv + size)
            counts = {}
            for x in left:
                if 0 < x < capacity:
                    counts[x] = counts.get(x, 0) + 1
            return sum(c * c for c in counts.values())

        best = min(options, key=lambda lv: (squares(lv), -lv))
        out.append(squares(best))
        if best in levels:
            levels.remove(best)
        levels.append(best + size)
    return levels


def test_rule_equals_the_naive_one():
    rng = random.Random(4)
    for _ in range(30):
        items = sorted((rng.randrange(1, 21) for _ in range(60)), reverse=True) if rng.random() < 0.5 else [rng.randrange(1, 21) for _ in range(60)]
        at = sum_of_squares(items, 20)
        levels = np.bincount(at, weights=items)
        assert levels.max() <= 20 and sorted(levels.astype(int)) == sorted(naive(items, 20))


def test_stretches_give_the_text_back():
    for text in ("", "a b " * 100, "x" * 1000, "\n" * 500):
        assert "".join(stretches(text, 64)) == text


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randrange(0, 60)) for i in range(400)] + [(400, None), (401, ""), (402, "token " * 1000), (3, "again"), (3, "again"), (None, "no id")]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, salt string")


def test_every_text_whole_and_no_container_too_full(docs, spark):
    rows, df = docs
    got = containers(df, 64).collect()
    by_doc, by_container = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
        by_container[r.container_id] = by_container.get(r.container_id, 0) + r.n_tokens
    assert max(by_container.values()) <= 64
    for d, t in rows:
        size = count_tokens(t)
        if size > 64 or d != 3:
            pieces = sorted(by_doc[d])
            assert sum(n for _, n in pieces) == size
            assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
            assert len(pieces) == max(1, -(-size // 64))
    assert len(by_doc[3]) == 3
    total = sum(count_tokens(t) for _, t in rows)
    one = report(containers(df, 64), 64).first()
    assert one.tokens == total and one.fewest == -(-total // 64) and one.used > 0.94 and one.fullest <= 64


def test_several_shards_are_packed_again(docs, monkeypatch):
    from factloom.llm import packing

    monkeypatch.setattr(packing, "SHARD", 40)
    one = report(containers(docs[1], 64), 64).first()
    monkeypatch.setattr(packing, "SLACK", 1.0)
    without = report(containers(docs[1], 64), 64).first()
    assert one.items == without.items and one.tokens == without.tokens and one.containers < without.containers


def test_empty_table_and_bad_capacity(docs):
    assert containers(docs[1].limit(0), 64).count() == 0
    assert report(containers(docs[1].limit(0), 64), 64).first().containers == 0
    with pytest.raises(ValueError):
        containers(docs[1], 0)


def test_sizes_are_the_tokenizers():
    assert count_tokens("Hello world") == len(encoding(VOCABULARY).encode_ordinary("Hello world")) == 2
