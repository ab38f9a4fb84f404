"""The gate over whole blocks as array work: every pair of a block is counted, none is stored.

Rows come sorted by block.  Small blocks are judged pair by pair; of larger ones, pairs of classes
(claims of the same context) are, and only pairs of values that can agree are looked at one by one,
found in the sorted values of each two orders of precision.  The branches are those of ``relate.judged``.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from factloom.functions.values import SLACK

SCHEMA = "verdict string, axis string, pairs bigint, differing bigint"
SMALL, AT_ONCE, ROWS, TABLE = 64, 1_000_000, 50_000, 3_000
NONE = -(2**31)
UNKNOWN, SAME, OVERLAPPING, DISJOINT = range(4)
FIXED = [
    ("VALUE", None), ("INSUFFICIENT_EVIDENCE", "unit"), ("INCOMPARABLE", "unit"), ("INCOMPARABLE", "currency"), ("INSUFFICIENT_EVIDENCE", "period"), ("CONTEXTUAL_TEMPORAL", "period"), ("CONTEXTUAL", "period"),
    ("CONTEXTUAL_TEMPORAL", "valid_time"), ("INCOMPARABLE", "cardinality"), ("INSUFFICIENT_EVIDENCE", "value"), ("CORROBORATES", None), ("CONTRADICTS", None),
]
CODE = {x: i for i, x in enumerate(FIXED)}


def texts_agree(a: str, b: str) -> bool | None:
    """``values.texts_agree`` of two lists of words, each joined by blanks."""
    a, b = a.split(), b.split()
    if not a or not b:
        return None
    if a == b:
        return True
    numbers = lambda x: [t for t in x if re.search("[0-9]", t)]
    if numbers(a) != numbers(b):
        return False

    def aligned(short: list[str], long: list[str]) -> bool:
        at = 0
        for t in short:
            n = len(t)
            if at < len(long) and long[at] == t:
                at += 1
            elif n >= 2 and re.fullmatch("[a-z]+", t) and at + n <= len(long) and "".join(w[0] for w in long[at : at + n]) == t:
                at += n
            else:
                return False
        return at == len(long)

    return aligned(a, b) or aligned(b, a)


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Places in a list of distinct values."""
    encoded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist()


class Blocks:
    """Whole blocks of claims, and the tally of their pairs."""

    def __init__(self, rows: pa.Table, starts: np.ndarray, mask: tuple[str, ...], priority: list[str]):
        ends = np.append(starts[1:], rows.num_rows)
        order = np.lexsort((rows["claim_id"].combine_chunks().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(starts)), ends - starts)))
        self.starts, self.ends, self.mask = starts, ends, mask
        number = lambda c, fill: rows[c].combine_chunks().fill_null(fill).to_numpy(zero_copy_only=False)[order]
        self.id = number("claim_id", 0)
        self.value, self.precision = number("canonical", np.nan), number("precision", 0.0)
        valid = lambda c: rows[c].combine_chunks().is_valid().to_numpy(zero_copy_only=False)[order]
        self.valued, self.bare = valid("canonical"), ~valid("precision")
        dates = np.stack([number(c, NONE).astype(np.int64) for c in ("period_start", "period_end", "valid_from", "valid_to")], 1)
        self.periods, self.period = np.unique(dates[:, :2], axis=0, return_inverse=True)
        self.from_, self.to = dates[:, 2], dates[:, 3]
        self.text, self.texts = _ids(rows["text"])
        self.text = self.text[order]
        self.single = number("single", True)
        self.context, contexts = _ids(rows["context"])
        self.context = self.context[order]
        self._read([json.loads(c) for c in contexts], priority)
        self.tables = self._coarse_table() if len(contexts) <= TABLE else None
        places = np.arange(len(self.periods))
        self.relations = self._relation(places[:, None], places[None]) if len(places) <= TABLE else None
        self.pairs, self.valued_pairs, self.near = (defaultdict(int) for _ in range(3))

    # ---- the gate ----

    def _read(self, contexts: list[dict], priority: list[str]) -> None:
        places = {a: i for i, a in enumerate(priority)}
        axes = [{k: v for k, v in (c.get("axes") or {}).items() if k not in self.mask} for c in contexts]
        unknown = [[k for k in c.get("unknown") or [] if k is not None and k not in self.mask] for c in contexts]
        keys = sorted({k for x in (*axes, *unknown) for k in x}, key=lambda k: (places.get(k, len(priority)), k))
        self.keys, at, seen = keys, {k: i for i, k in enumerate(keys)}, {}
        self.stated = np.zeros((len(contexts), len(keys)), np.int32)  # 0: not stated
        self.missing = np.zeros((len(contexts), len(keys)), bool)
        for i, (said, lacks) in enumerate(zip(axes, unknown, strict=True)):
            for k, v in said.items():
                self.stated[i, at[k]] = seen.setdefault((k, v), len(seen) + 1)
            for k in lacks:
                self.missing[i, at[k]] = True
        name: dict = {None: 0, "currency": 1}
        put = lambda field: np.array([name.setdefault(c.get(field), len(name)) for c in contexts], np.int64)
        self.dimension, self.currency = put("dimension"), put("currency")
        kind = [c.get("claim_type") for c in contexts]
        self.measured, self.state, self.untyped = (np.array([k == x for k in kind], bool) for x in ("measurement", "state", None))

    def _coarse(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Codes of two contexts for each relation of their periods: the branches without dates and texts."""
        n, m = len(FIXED), len(self.keys)
        out = np.zeros((4, len(a)), np.int32)
        for s in range(0, len(a), 100_000):
            x, y = a[s : s + 100_000], b[s : s + 100_000]
            d, e = self.dimension[x], self.dimension[y]
            measured, money = self.measured[x] & ("unit" not in self.mask), (d == 1) & (e == 1)
            c, f = self.currency[x], self.currency[y]
            first = np.full(len(x), -1)
            if m:
                lacks = (self.missing[x] & (self.stated[y] > 0)) | (self.missing[y] & (self.stated[x] > 0))
                first = np.where(lacks.any(1), n + lacks.argmax(1), first)
                differ = self.stated[x] != self.stated[y]
                differing = np.where(differ.any(1), n + m + differ.argmax(1), CODE["VALUE", None])
            else:
                differing = np.zeros(len(x), np.int64)
            first = np.where(measured & money & (c != f), CODE["INCOMPARABLE", "currency"], first)
            first = np.where(measured & (d != e), CODE["INCOMPARABLE", "unit"], first)
            first = np.where(measured & ((d == 0) | (e == 0) | (money & ((c == 0) | (f == 0)))), CODE["INSUFFICIENT_EVIDENCE", "unit"], first)
            unknown = np.where(self.state[x] | self.untyped[x], differing, CODE["INSUFFICIENT_EVIDENCE", "period"])
            for r, then in ((UNKNOWN, unknown), (SAME, differing), (OVERLAPPING, CODE["CONTEXTUAL", "period"]), (DISJOINT, CODE["CONTEXTUAL_TEMPORAL", "period"])):
                out[r, s : s + 100_000] = np.where(first >= 0, first, then)
        return out

    def _coarse_table(self) -> np.ndarray:
        k = np.arange(len(self.dimension))
        return self._coarse(np.repeat(k, len(k)), np.tile(k, len(k))).reshape(4, len(k), len(k))

    def _relation(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if "period" in self.mask:
            return np.full(np.broadcast(a, b).shape, SAME, np.int8)
        (s, e), (t, f) = ((self.periods[x, 0], self.periods[x, 1]) for x in (a, b))
        known = (s != NONE) & (e != NONE) & (t != NONE) & (f != NONE)
        return np.where(~known, UNKNOWN, np.where((s == t) & (e == f), SAME, np.where((s <= f) & (t <= e), OVERLAPPING, DISJOINT))).astype(np.int8)

    def gate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Codes of pairs of rows, a first."""
        p, q, c, d = self.period[a], self.period[b], self.context[a], self.context[b]
        relation = self._relation(p, q) if self.relations is None else self.relations[p, q]
        code = self._coarse(c, d)[relation, np.arange(len(a))] if self.tables is None else self.tables[relation, c, d]
        states = np.flatnonzero(self.state[c])
        if not len(states):
            return code
        a, b, relation, c, d = a[states], b[states], relation[states], c[states], d[states]
        says = code[states]
        first, low, high = self._missing(c, d), -719162, 2932896  # 0001-01-01, 9999-12-31
        starts, ends = ([np.where(x[y] == NONE, z, x[y]) for y in (a, b)] for x, z in ((self.from_, low), (self.to, high)))
        dated = [(self.from_[y] != NONE) | (self.to[y] != NONE) for y in (a, b)]
        apart = dated[0] & dated[1] & ((starts[0] >= ends[1]) | (starts[1] >= ends[0]))
        says = np.where(~first & (relation == UNKNOWN) & apart, CODE["CONTEXTUAL_TEMPORAL", "valid_time"], says)
        left = np.flatnonzero(says == CODE["VALUE", None])
        text = self._texts(self.text[a[left]], self.text[b[left]])
        by_text = np.array([CODE["CONTRADICTS", None], CODE["CORROBORATES", None], CODE["INSUFFICIENT_EVIDENCE", "value"]])[text]
        says[left] = np.where(~self.single[a[left]] & (text != 1), CODE["INCOMPARABLE", "cardinality"], by_text)
        code[states] = says
        return code

    def _missing(self, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = np.zeros(len(c), bool)
        for s in range(0, len(c), 100_000):
            x, y = c[s : s + 100_000], d[s : s + 100_000]
            out[s : s + 100_000] = ((self.missing[x] & (self.stated[y] > 0)) | (self.missing[y] & (self.stated[x] > 0))).any(1)
        return out

    def _texts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """1 where texts agree, 0 where not, 2 where one is empty."""
        both, place = np.unique(a * len(self.texts) + b, return_inverse=True)
        found = np.zeros(len(both), np.int64)
        for i, x in enumerate(both.tolist()):
            agreed = texts_agree(self.texts[x // len(self.texts)], self.texts[x % len(self.texts)])
            found[i] = 2 if agreed is None else int(agreed)
        return found[place]

    # ---- counting ----

    def _add(self, to: dict, code: np.ndarray, n: np.ndarray | None = None) -> None:
        found = np.bincount(code, n, minlength=1)
        for k in np.flatnonzero(found).tolist():
            to[k] += int(found[k])

    def _agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gap = np.abs(self.value[a] - self.value[b])
        return np.where(self.bare[a] & self.bare[b], gap == 0, gap < (self.precision[a] + self.precision[b]) / 2 * SLACK)

    def _ranges(self, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in the lists, place in a range), over all ranges first..last-1, so many at a time."""
        n = np.maximum(last - first, 0)
        total = np.cumsum(n)
        s = 0
        while s < len(n):
            done = total[s - 1] if s else 0
            e = max(s + 1, int(np.searchsorted(total, done + AT_ONCE, "right")))
            k = n[s:e]
            place = np.repeat(np.arange(s, e), k)
            if len(place):
                yield place, np.arange(len(place)) - np.repeat(np.cumsum(k) - k, k) + first[place]
            s = e

    def small(self, blocks: np.ndarray) -> None:
        """All pairs of the rows of blocks, one by one."""
        sizes = self.ends[blocks] - self.starts[blocks]
        rows = np.repeat(self.starts[blocks] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        for place, b in self._ranges(rows + 1, np.repeat(self.ends[blocks], sizes)):
            a = rows[place]
            code = self.gate(a, b)
            self._add(self.pairs, code)
            both = self.valued[a] & self.valued[b]
            self._add(self.valued_pairs, code[both])
            a, b, code = a[both], b[both], code[both]
            with np.errstate(invalid="ignore"):
                self._add(self.near, code[self._agree(a, b)])

    def large(self, block: int) -> None:
        """All pairs of the rows of one block, by classes."""
        rows = np.arange(self.starts[block], self.ends[block])
        states = self.state[self.context[rows]]
        parts = [self.context[rows], self.period[rows], np.where(states, self.single[rows], 0)]
        if states.any():  # a state that comes first looks at the dates and text of any later claim
            parts += [self.from_[rows], self.to[rows], self.text[rows]]
        key = np.zeros(len(rows), np.int64)
        for x in parts:  # renumbered each time, so that no product leaves 64 bits
            x = np.unique(x, return_inverse=True)[1]
            key = np.unique(key * (x.max() + 1) + x, return_inverse=True)[1]
        _, one, n = np.unique(key, return_index=True, return_counts=True)
        valued = np.bincount(key, self.valued[rows], minlength=len(n)).astype(np.int64)
        one = rows[one]
        kinds = self.context[one]
        ordered = len({*zip(self.state[kinds].tolist(), self.measured[kinds].tolist(), np.where(self.state[kinds], self.single[one], True).tolist(), strict=True)}) > 1
        k = np.arange(len(n))
        for i, j in self._ranges(k, np.full(len(k), len(k))):
            code = self.gate(one[i], one[j])
            count = lambda c: np.where(i == j, c[i] * (c[i] - 1) // 2, c[i] * c[j])  # noqa: B023, E731
            pairs = count(n)
            if ordered:  # which claim comes first decides some verdicts
                other = self.gate(one[j], one[i])
                for x in np.flatnonzero(code != other).tolist():
                    mine, theirs = rows[key == i[x]], rows[key == j[x]]
                    first = int((len(theirs) - np.searchsorted(self.id[theirs], self.id[mine], "right")).sum())
                    self.pairs[int(code[x])] += first
                    self.pairs[int(other[x])] += int(pairs[x]) - first
                pairs = np.where(code == other, pairs, 0)
            self._add(self.pairs, code, pairs)
            self._add(self.valued_pairs, code, count(valued))
        self._near(rows[self.valued[rows] & np.isfinite(self.value[rows])])

    def _near(self, rows: np.ndarray) -> None:
        """Pairs of the rows whose values agree, found in the sorted values of each two orders of precision."""
        rows = rows[np.argsort(self.value[rows], kind="stable")]
        precision = self.precision[rows]
        level = np.where(precision > 0, np.ceil(np.log10(np.where(precision > 0, precision, 1)) - 1e-9), -1000)
        groups = [rows[level == x] for x in np.unique(level)]
        for g, fine in enumerate(groups):
            for coarse in groups[g:]:
                v, w = self.value[coarse], self.value[fine]
                reach = (max(self.precision[coarse].max(), 0) + max(self.precision[fine].max(), 0)) / 2
                slack = 4 * np.spacing(np.abs(v) + reach)
                last = np.searchsorted(w, v + reach + slack, "right")
                # rows of one order meet once, the smaller value first
                first = np.arange(1, len(v) + 1) if fine is coarse else np.searchsorted(w, v - reach - slack, "left")
                for place, at in self._ranges(first, last):
                    a, b = coarse[place], fine[at]
                    agreed = self._agree(a, b)
                    self._add(self.near, self.gate(a[agreed], b[agreed]))

    def tally(self, small: int) -> dict[tuple[str, str | None], list[int]]:
        sizes = self.ends - self.starts
        self.small(np.flatnonzero((sizes > 1) & (sizes <= small)))
        for block in np.flatnonzero(sizes > small).tolist():
            self.large(block)
        names = [*FIXED, *(("INSUFFICIENT_EVIDENCE", k) for k in self.keys), *(("CONTEXTUAL", k) for k in self.keys)]
        out: dict = defaultdict(lambda: [0, 0])

        def put(name: tuple, pairs: int, differing: int) -> None:
            out[name][0] += pairs
            out[name][1] += differing

        for code, pairs in self.pairs.items():
            near, differing = self.near[code], self.valued_pairs[code] - self.near[code]
            if code == CODE["VALUE", None]:
                put(("CORROBORATES", None), near, 0)
                put(("CONTRADICTS", None), differing, differing)
                put(("INSUFFICIENT_EVIDENCE", "value"), pairs - near - differing, 0)
            else:
                put(names[code], pairs, differing)
        return {k: v for k, v in out.items() if v[0]}


def of_partition(batches: Iterator[pa.RecordBatch], mask: tuple[str, ...], priority: list[str], small: int = SMALL) -> Iterator[pa.RecordBatch]:
    """The tally of a partition's rows, which are sorted by block, without those that have no key; no more than some blocks are held at once."""
    total: dict = defaultdict(lambda: [0, 0])
    held: list[pa.RecordBatch] = []

    def starts_of(rows: pa.Table) -> np.ndarray:
        changed = [pc.not_equal(rows[c].combine_chunks()[1:], rows[c].combine_chunks()[:-1]).to_numpy(zero_copy_only=False) for c in ("entity", "metric")]
        return np.append(0, np.flatnonzero(changed[0] | changed[1]) + 1)

    def count(rows: pa.Table, starts: np.ndarray) -> None:
        for name, (pairs, differing) in Blocks(rows, starts, mask, priority).tally(small).items():
            total[name][0] += pairs
            total[name][1] += differing

    waiting = 0
    for batch in batches:
        batch = batch.filter(pc.and_(pc.is_valid(batch.column("entity")), pc.is_valid(batch.column("metric"))))
        if batch.num_rows:
            held.append(batch)
            waiting += batch.num_rows
        if waiting >= ROWS:
            rows = pa.Table.from_batches(held)
            starts = starts_of(rows)
            if len(starts) > 1:  # the last block may go on
                count(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1]).to_batches()
            waiting = 0
    if held:
        rows = pa.Table.from_batches(held)
        count(rows, starts_of(rows))
    if total:
        columns = [[k[0] for k in total], [k[1] for k in total], [v[0] for v in total.values()], [v[1] for v in total.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["verdict", "axis", "pairs", "differing"])
