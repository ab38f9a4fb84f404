import random

import pytest

from factloom.llm.names import compatible, distances, entities, found, linked, near, neighbours, words


def naive_distance(a, b):
    """Unrestricted Damerau-Levenshtein by breadth-first search over edits."""
    seen, front, steps = {a}, {a}, 0
    letters = set(a + b)
    while b not in front:
        steps += 1
        out = set()
        for w in front:
            for i in range(len(w) + 1):
                out |= {w[:i] + c + w[i:] for c in letters}
                if i < len(w):
                    out.add(w[:i] + w[i + 1 :])
                    out |= {w[:i] + c + w[i + 1 :] for c in letters}
                if i + 1 < len(w):
                    out.add(w[:i] + w[i + 1] + w[i] + w[i + 2 :])
        front = {w for w in out - seen if len(w) <= max(len(a), len(b)) + 1}
        seen |= front
    return steps


def test_distance_is_the_metric():
    rng = random.Random(1)
    some = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(12)]
    for p in some[:6]:
        assert distances(some, p).tolist() == [naive_distance(t, p) for t in some]
    assert distances(["ca"], "abc")[0] == 2  # the restricted distance, 3, would be no metric
    for a in some:
        for b in some:
            assert near(a, b) == (distances([a], b)[0] <= 1)


def test_neighbours_equal_all_pairs(spark):
    rng = random.Random(2)
    some = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(5, 8))) for _ in range(300)})
    df = spark.createDataFrame([(w,) for w in [*some, "x" * 70, "abc"]], "word string")
    got = {(r.word, r.other) for r in neighbours(df).collect()}
    assert got == {(a, b) for a in some for b in some if a != b and near(a, b)} and got


@pytest.mark.parametrize(
    "a,b,same",
    [("Margaret J. X", "Peggy X", True), ("Bill X", "William X", True), ("W. X", "William X", True), ("William J. X", "William K. X", False), ("Samuel X", "Daniel X", False),
     ("X Grain Terminals Ltd", "Grains Terminal X", True), ("X Water Works", "X W. W. Corp.", True), ("X Waterworks", "X Water Works", True), ("X Mar. Ins.", "X Marine Insurance", True),
     ("X Solar Pwr", "X Solar Power", True), ("X Seed Research", "X Paper Products", False), ("X Seed Research", "X Seed Research Finance", False), ("X", "Republic of X", True), ("X", "X Logistics", False)],
)
def test_rests(a, b, same):
    rest = lambda n: [w for w in words(n) if w != "x"]
    assert compatible(rest(a), rest(b)) == same == compatible(rest(b), rest(a))


def test_two_middle_initials_are_two_people():
    block = [("a", 9, ["gregory"]), ("b", 3, ["gregory", "p"]), ("c", 2, ["gregory", "k"]), ("d", 1, ["g"])]
    got = entities(block)
    assert got[0] == got[1] == got[3] != got[2]


ROWS = [("Veltraneth Logistics Limited", None)] * 5 + [("Logistics Veltraneht Ltd", "the Company"), ("-", ""), (None, None), ("Velmarroth Logistics Limited", "Zimkepilonog, P."), ("Patricia Zimkepilonog", "Samuel Zimkepilonog"), ("y" * 5000, None)]


def test_tables(spark):
    df = spark.createDataFrame([(*r, "n", 1) for r in ROWS], "subject string, org_scope string, name string, n int")
    got = {tuple(r) for r in found(df).collect()}
    assert got == {("Logistics Veltraneht Ltd", "Veltraneth Logistics Limited"), ("Patricia Zimkepilonog", "Zimkepilonog, P.")}
    sizes = {r.name: r.spellings for r in linked(df).collect()}
    assert sizes["Samuel Zimkepilonog"] == 1 and sizes["Veltraneth Logistics Limited"] == 2 and "the Company" not in sizes
    assert found(df.limit(0)).count() == 0
