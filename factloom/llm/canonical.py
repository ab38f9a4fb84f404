"""Free-entered names mapped to the closest entry of a reference list; what has none is reported.

The reference list is small and checked to be (``MOST_NAMES``); its tokens and its names written
without gaps go into a symmetric-delete dictionary that is broadcast.  A typed token is looked up by
its own deletes, which finds every reference token within the edit bound; the weighted
Damerau-Levenshtein distance then ranks what was found.  A name's tokens are assigned to the typed
ones in any order, a typed token may also be a dotted or vowel-less abbreviation, and names typed
with wrong gaps are compared as a whole.  Equal scores go to the name that stands more often in the
data exactly as listed, then to the smaller id.

A null or empty value stands for no entry (0), as does one that is no closer than the bound to any.
Repeated values get the same answer; an empty table gives no rows; with an empty list all are 0.
Texts may be of any length: a text far longer than any name matches none.  Other columns don't matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: the list is broadcast, so it has to be one that fits; a longer one is refused, not cut
MOST_NAMES = 100_000
#: edits that the deletes of a token of some length cover
EDITS = ((3, 0), (5, 1), (99, 2))
WHOLE_EDITS = 2

# ---- fixed values ----
#: words without weight in a name
SMALL = frozenset("of and the to in at on for by de a an".split())
#: what statements add to a label: its standing, a note, the unit
REMARKS = frozenset("unaudited audited restated provisional refer note see which ref times percent".split())
NEAR_LETTERS = frozenset("ec ce ao oa nu un rn nr il li tl lt hn nh vu uv sa as ie ei".split())
# ---- end of fixed values ----

_TOKEN = re.compile(r"[^\W_]+")
_FRONT = re.compile(r"^(?:\s*(?:\(?(?:\d{1,3}|[a-z]|[ivx]{2,4})[.)](?=\s)|[-–—•*·]+(?=\s)))+", re.I)
_BRACKETED = re.compile(r"\[[^\[\]]{0,3}\]|[*†‡§]+")


def tokens(text: str) -> list[tuple[str, bool]]:
    """(token, whether a dot follows) without enumeration, marks and gaps."""
    text = unicodedata.normalize("NFKC", text).casefold().replace("&", " and ").replace("'", "").replace("’", "")
    text = _BRACKETED.sub(" ", _FRONT.sub(" ", text))
    return [(m.group(), text[m.end() : m.end() + 1] == ".") for m in _TOKEN.finditer(text)]


def deletes(word: str, most: int) -> set[str]:
    """The word with up to ``most`` characters taken out."""
    return {"".join(word[i] for i in range(len(word)) if i not in gone) for k in range(min(most, len(word)) + 1) for gone in map(set, combinations(range(len(word)), k))}


def edits(word: str) -> int:
    return next(n for length, n in EDITS if len(word) <= length or length == 99)


@lru_cache(maxsize=200_000)
def weighted_distance(a: str, b: str) -> float:
    """Damerau-Levenshtein (adjacent swaps) with cheaper doublings, vowels and look-alike letters."""
    previous2: list[float] = []
    previous = [0.9 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [0.9 * i]
        for j, y in enumerate(b, 1):
            if x == y:
                best = previous[j - 1]
            else:
                best = previous[j - 1] + (0.8 if x + y in NEAR_LETTERS else 1.0)
            best = min(best, previous[j] + (0.6 if i > 1 and a[i - 2] == x else 0.9), row[j - 1] + (0.6 if (j > 1 and b[j - 2] == y) or y in "aeiou" else 0.9))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, previous2[j - 2] + 0.8)
            row.append(best)
        previous2, previous = previous, row
    return previous[-1]


def _within(q: str, r: str) -> bool:
    """Whether the letters of q come in r in this order, the first ones being the same."""
    if q[0] != r[0]:
        return False
    rest = iter(r)
    return all(ch in rest for ch in q)


def _bare(word: str) -> str:
    return word[:1] + _consonants(word[1:])


def _consonants(word: str) -> str:
    return "".join(ch for ch in word if ch not in "aeiou")


class SymmetricDeletes:
    """Deletes of the listed words; a lookup gives every word that shares one with the query."""

    def __init__(self, words: Iterable[str], most=edits):
        self.most, self.index = most, defaultdict(set)
        for w in words:
            for d in deletes(w, most(w)):
                self.index[d].add(w)

    def near(self, query: str) -> set[str]:
        index = self.index
        return set().union(*(index[d] for d in deletes(query, self.most(query)) if d in index)) if query else set()


class NameList:
    """Reference names with their ids, looked up as the module says."""

    def __init__(self, names: list[tuple[int, str]], frequency: dict[str, int]):
        self.exact: dict[str, int] = {}
        self.entries: list[tuple[int, list[str], int, str]] = []
        self.vocabulary: dict[int, set[str]] = defaultdict(set)
        self.by_token, by_whole = defaultdict(set), defaultdict(set)
        for key, name in sorted(names, key=lambda x: (-frequency.get(x[1], 0), x[0], x[1])):
            parts = [t for t, _ in tokens(name)]
            if not parts:
                continue
            at = len(self.entries)
            self.entries.append((key, parts, frequency.get(name, 0), "".join(parts)))
            self.vocabulary[key].update(parts)
            self.exact.setdefault("".join(parts), key)
            by_whole["".join(parts)].add(at)
            for t in parts:
                self.by_token[t].add(at)
        self.by_whole = by_whole
        self.longest = max((len(e[3]) for e in self.entries), default=0)
        words = set(self.by_token)
        self.words = SymmetricDeletes(words)
        self.whole = SymmetricDeletes(by_whole, lambda w: min(WHOLE_EDITS, max(1, len(w) // 6)))
        self.by_letter = defaultdict(list)
        for w in sorted(words):
            self.by_letter[w[0]].append(w)
        self.bare = {w: _bare(w) for w in words}
        self.consonants = defaultdict(list)
        for w in sorted(words):
            self.consonants[_consonants(w)].append(w)
        self.longest_word = max(map(len, words), default=0)
        self.by_consonants = defaultdict(set)
        for w, entries in by_whole.items():
            self.by_consonants[_consonants(w)] |= entries
        self.whole_consonants = SymmetricDeletes((w for w in self.by_consonants if len(w) >= 6), lambda w: 1)
        self.remarks = SymmetricDeletes({r for w in REMARKS for r in (w, _bare(w), _consonants(w))})
        self._is_remark = lru_cache(maxsize=20_000)(lambda q: any(weighted_distance(q, w) <= 0.35 * len(w) for w in self.remarks.near(q)))
        self._cost = lru_cache(maxsize=100_000)(self._token_costs)

    def _token_costs(self, q: str, dotted: bool) -> dict[str, float]:
        """Cost of reading a typed token as each reference token it may be."""
        cost: dict[str, float] = {}

        def say(word: str, c: float):
            if c < cost.get(word, 9):
                cost[word] = c

        for w in self.words.near(q):
            d = weighted_distance(q, w)
            if d <= max(1.0, 0.45 * len(w)) and not (d and len(w) <= 3):
                say(w, 0.22 * d if len(w) > 3 else 0.3 * d)
        for w in self.by_letter[q[0]]:
            if len(q) < len(w):
                if w.startswith(q) and (dotted or len(q) >= 2) and w not in SMALL:
                    say(w, 0.12 if dotted else 0.25)
                elif len(q) >= 2 and len(w) > 3 and _within(q, w) and len(q) >= 0.2 * len(w):
                    say(w, 0.2 if not set(q[1:]) & set("aeiou") else 0.3)
                elif dotted and len(q) >= 3 and (d := weighted_distance(q, w[: len(q)])) <= 1:
                    say(w, 0.2 + 0.2 * d)
                elif len(q) >= 4 and len(w) > 4 and abs(len(q) - len(b := self.bare[w])) <= 1 and (d := weighted_distance(q, b)) <= 1.01:
                    say(w, 0.25 + 0.2 * d)
            elif len(w) > 4 and len(q) <= len(w) + 3 and q.startswith(w):
                say(w, 0.25)
        if len(q) >= 3:
            for w in self.consonants.get(q, ()):
                say(w, 0.3)
        return cost

    def _split(self, q: str) -> list[str]:
        """A token typed without gaps as the words of the list that it is made of, at most one piece being none."""
        best: list[tuple[float, list[str], int] | None] = [(0.0, [], 0)] + [None] * len(q)
        known = lambda p: p in self.by_token or p in REMARKS or p in SMALL
        for j in range(1, len(q) + 1):
            for i in range(max(0, j - self.longest_word), j):
                if (before := best[i]) is not None:
                    piece = q[i:j]
                    odd = not known(piece)
                    if odd and (before[2] or j - i > 8):
                        continue
                    c = before[0] + 0.5 + odd * (0.5 + 0.3 * (j - i))
                    if best[j] is None or c < best[j][0]:
                        best[j] = (c, [*before[1], piece], before[2] + odd)
        end = best[len(q)]
        return end[1] if end is not None and len(end[1]) > 1 and any(len(p) > 3 and (p in self.by_token or p in REMARKS) for p in end[1]) else [q]

    def _assigned(self, typed: list[tuple[str, bool]], costs: list[dict[str, float]], at: int) -> float:
        """Cost of reading the typed tokens as this name, in any order."""
        key, parts, _, _ = self.entries[at]
        total = 0.0
        options = sorted((c, abs(i - j), i, j) for i, cost in enumerate(costs) for j, p in enumerate(parts) if (c := cost.get(p)) is not None)
        used_q, used_r = set(), set()
        matched = 0
        for c, _, i, j in options:
            if i not in used_q and j not in used_r:
                used_q.add(i)
                used_r.add(j)
                small = parts[j] in SMALL
                total += c * (0.3 if small else 1.0)
                matched += not small
        weight = sum(p not in SMALL for p in parts)
        missing = sum((0.05 if p in SMALL else 0.55) for j, p in enumerate(parts) if j not in used_r)
        if missing >= 0.5 and (matched < 2 or matched < weight - 1):
            return 9.0
        for i, (q, _) in enumerate(typed):
            if i in used_q or q in SMALL:
                continue
            if q in self.vocabulary[key]:
                total += 0.3
            elif q.isdigit():
                total += 0.1
            else:
                total += 0.12 if self._is_remark(q) else 0.9
        return (total + missing) / max(1, weight) ** 0.75 if matched else 9.0

    def _by_tokens(self, typed: list[tuple[str, bool]]) -> list[tuple[float, int]]:
        costs = [self._cost(q, dotted) for q, dotted in typed]
        candidates = {at for cost in costs for w in cost if w not in SMALL for at in self.by_token[w]}
        return [(self._assigned(typed, costs, at), at) for at in candidates]

    def find(self, text: str | None, bound: float = 0.55) -> int:
        """The id of the entry that a typed name stands for; 0 if none."""
        if not text or len(text) > 4 * self.longest + 80:
            return 0
        typed = tokens(text)
        if not typed:
            return 0
        if (key := self.exact.get("".join(t for t, _ in typed))) is not None:
            return key
        scored = self._by_tokens(typed)
        if min(scored, default=(9.0, 0))[0] > 0.2:
            parted = [(p, dotted) for q, dotted in typed for p in (self._split(q) if 6 <= len(q) <= self.longest and q not in self.by_token else [q])]
            if len(parted) > len(typed):
                scored += [(0.05 + c, at) for c, at in self._by_tokens(parted)]
            squeezed = "".join(t for t, _ in typed if not t.isdigit() and not self._is_remark(t))
            if squeezed and len(squeezed) <= self.longest + WHOLE_EDITS:
                for w in self.whole.near(squeezed):
                    d = weighted_distance(squeezed, w)
                    if d <= max(1.0, 0.2 * len(w)):
                        scored += [(0.14 * d + 0.05, at) for at in self.by_whole[w]]
                for w in self.whole_consonants.near(spare := _consonants(squeezed)):
                    d = weighted_distance(spare, w)
                    if d <= 1:
                        scored += [(0.25 + 0.2 * d, at) for at in self.by_consonants[w]]
        score, at = min(scored, default=(9.0, 0))
        return self.entries[at][0] if score <= bound else 0


def map_to_list(df: DataFrame, names: DataFrame, value_col: str = "predicate", id_col: str = "id", bound: float = 0.55) -> DataFrame:
    """(row_id, value, entry_id) of every row; names: (entry_id, name).  A narrow map, each distinct value looked up once a batch."""
    listed = [(r.entry_id, r.name) for r in names.select("entry_id", "name").limit(MOST_NAMES + 1).collect() if r.entry_id is not None and r.name]
    if len(listed) > MOST_NAMES:
        raise ValueError(f"the list has more than {MOST_NAMES} names")
    spark = df.sparkSession
    counts = df.select(F.col(f"`{value_col}`").alias("name")).join(F.broadcast(names.select("name").distinct()), "name", "left_semi").groupBy("name").count()
    frequency = {r["name"]: r["count"] for r in counts.collect()}  # at most as many rows as the list
    shared = spark.sparkContext.broadcast((listed, frequency))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = lru_cache(maxsize=50_000)(NameList(*shared.value).find)
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            # distinct values in their order, so that costs don't depend on the rows
            found = [find(v, bound) for v in coded.dictionary.to_pylist()] + [0]
            index = coded.indices.fill_null(len(found) - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([found[i] for i in index], pa.int64())], names=["row_id", "value", "entry_id"])

    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("row_id"), F.col(f"`{value_col}`").alias("value"))
    return rows.mapInArrow(convert, "row_id bigint, value string, entry_id bigint")


def found(claims: DataFrame, metrics: DataFrame, aliases: DataFrame) -> DataFrame:
    """(claim_id, metric_id) of the claims whose predicate isn't a canonical name as it stands."""
    names = metrics.select(F.col("id").alias("entry_id"), F.col("canonical_name").alias("name")).union(aliases.select("metric_id", "alias"))
    listed = F.broadcast(metrics.select(F.col("canonical_name").alias("predicate")).filter("predicate IS NOT NULL"))
    typed = claims.select("id", "predicate").join(listed, "predicate", "left_anti")
    return map_to_list(typed, names).select(F.col("row_id").alias("claim_id"), F.col("entry_id").alias("metric_id"))
