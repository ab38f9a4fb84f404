"""Quantities recorded in different units, brought to one base unit per dimension.

A unit string is segmented by dynamic programming over character tries of scale prefixes, unit
roots and exponents; ambiguous decompositions are ordered by cost, and a prior on the field's
stored dimension decides between decompositions of equal cost.  A printed figure is read from
whatever convention it was printed in.  What is printed with the figure counts first
(``value_raw``, ``unit_raw``, the words next to the figure in ``evidence_quote``), then the stored
unit columns, then ``qualifiers``; a later place only supplies what earlier ones leave open.

Nulls in any column, empty strings and nil markers: the row has no printed figure or no
determinable unit and gets a null base unit; no row is dropped by the operator itself.  Texts may be
of any length.  Repeated rows come out as often as they stand in the table; an empty table gives no
rows.  Decompositions of equal cost are ordered by their text, so the result is always the same.
Columns of the table besides the ones read don't matter, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: how units are written (form, base unit, numerator, denominator); a form that stands
# more than once has several readings, the usual one first, which the field's dimension tells apart ----
ROOTS = [
    ("Indian Rupees", "INR", 1, 1), ("Indian Rupee", "INR", 1, 1), ("rupees", "INR", 1, 1), ("rupee", "INR", 1, 1),
    ("INR", "INR", 1, 1), ("Rs.", "INR", 1, 1), ("Rs", "INR", 1, 1), ("₹", "INR", 1, 1),
    ("U.S. dollars", "USD", 1, 1), ("US dollars", "USD", 1, 1), ("dollars", "USD", 1, 1), ("dollar", "USD", 1, 1), ("US$", "USD", 1, 1),
    ("USD", "USD", 1, 1), ("$", "USD", 1, 1),
    ("pounds sterling", "GBP", 1, 1), ("pound sterling", "GBP", 1, 1), ("sterling", "GBP", 1, 1), ("pounds", "GBP", 1, 1), ("pounds", "tonnes", 45359237, 10**11), ("GBP", "GBP", 1, 1), ("£", "GBP", 1, 1),
    ("euros", "EUR", 1, 1), ("euro", "EUR", 1, 1), ("EUR", "EUR", 1, 1), ("€", "EUR", 1, 1),
    ("per cent", "percent", 1, 1), ("percent", "percent", 1, 1), ("pct", "percent", 1, 1), ("%", "percent", 1, 1),
    ("basis points", "percent", 1, 100), ("basis point", "percent", 1, 100), ("bps", "percent", 1, 100), ("bp", "percent", 1, 100),
    ("percentage points", "percentage_points", 1, 1), ("percentage point", "percentage_points", 1, 1),
    ("ppt", "percentage_points", 1, 1), ("p.p.", "percentage_points", 1, 1), ("pp", "percentage_points", 1, 1),
    ("times", "ratio", 1, 1), ("times", "count", 1, 1), ("x", "ratio", 1, 1),
    ("count", "count", 1, 1), ("number", "count", 1, 1), ("nos.", "count", 1, 1), ("nos", "count", 1, 1),
    ("units", "count", 1, 1), ("unit", "count", 1, 1), ("shipments", "count", 1, 1), ("employees", "count", 1, 1),
    ("tonnes", "tonnes", 1, 1), ("tonne", "tonnes", 1, 1), ("metric tons", "tonnes", 1, 1), ("metric ton", "tonnes", 1, 1),
    ("tons", "tonnes", 1, 1), ("ton", "tonnes", 1, 1), ("t", "tonnes", 1, 1),
    ("MT", "tonnes", 1, 1), ("mt", "tonnes", 1, 1),
    ("kilograms", "tonnes", 1, 1000), ("kilogram", "tonnes", 1, 1000), ("kgs", "tonnes", 1, 1000), ("kg", "tonnes", 1, 1000), ("Kg.", "tonnes", 1, 1000),
    ("quintals", "tonnes", 1, 10), ("quintal", "tonnes", 1, 10), ("qtl", "tonnes", 1, 10),
    ("days", "days", 1, 1), ("day", "days", 1, 1), ("d", "days", 1, 1),
    ("points", "percentage_points", 1, 1), ("points", "percent", 1, 100), ("points", "count", 1, 1),
    ("weeks", "days", 7, 1), ("week", "days", 7, 1), ("wks", "days", 7, 1), ("wk", "days", 7, 1),
]
SCALES = [
    ("thousands", 10**3), ("thousand", 10**3), ("Tsd.", 10**3), ("Tsd", 10**3), ("K", 10**3),
    ("lakhs", 10**5), ("lakh", 10**5), ("lacs", 10**5), ("lac", 10**5),
    ("millions", 10**6), ("million", 10**6), ("Mn.", 10**6), ("mn", 10**6), ("mln", 10**6), ("Mio.", 10**6), ("Mio", 10**6), ("millones", 10**6),
    ("crores", 10**7), ("crore", 10**7), ("Cr.", 10**7), ("cr", 10**7),
    ("billions", 10**9), ("billion", 10**9), ("bn", 10**9), ("Mrd.", 10**9), ("Mrd", 10**9), ("milliards", 10**9), ("milliard", 10**9),
    ("trillions", 10**12), ("trillion", 10**12), ("tn", 10**12),
]
#: thousands written as noughts, and the parts of a power of ten: how it may begin, and its exponent
NOUGHTS = [("'000s", 10**3), ("'000", 10**3), ("000s", 10**3), ("000", 10**3)]
POWER_STARTS = ["10^", "x10^", "x 10^", "×10^", "× 10^", "10", "x10", "×10"]
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
LARGEST_EXPONENT = 15
#: prefixes written against their root, exact case
GLUED = [("k", 10**3), ("K", 10**3), ("T", 10**3), ("M", 10**6), ("Md", 10**9)]
#: letters written after their root, exact case, as in $B or €m
AFTER = [("m", 10**6), ("M", 10**6), ("B", 10**9), ("b", 10**9), ("k", 10**3), ("K", 10**3), ("T", 10**12)]
FILLERS = ["All amounts in", "amounts in", "in", "of", "de", "d'"]
#: roots that are too short to be matched in another case
EXACT_CASE = {"MT", "mt", "t", "d"}
STORED_BASE = {"percent": "percent", "percentage_points": "percentage_points", "ratio": "ratio", "count": "count", "mass_tonnes": "tonnes", "tonnes": "tonnes", "days": "days"}
CURRENCIES = ("INR", "USD", "EUR", "GBP")
# ---- end of fixed values ----


class Trie:
    """Character trie; the walk yields every entry that starts at a position."""

    def __init__(self, entries):
        self.root: dict = {}
        for form, payload in entries:
            node = self.root
            for ch in form.lower():
                node = node.setdefault(ch, {})
            node.setdefault("", []).append((form, payload))

    def walk(self, text: str, start: int):
        node = self.root
        for i in range(start, len(text)):
            node = node.get(text[i].lower())
            if node is None:
                return
            for form, payload in node.get("", ()):
                yield i + 1, form, payload


_ROOTS = Trie((f, (b, n, d, sum(g == f for g, *_ in ROOTS[:k]))) for k, (f, b, n, d) in enumerate(ROOTS))
_SCALES = Trie((f, s) for f, s in [*SCALES, *NOUGHTS, ("hundred", 100)])
_POWERS = Trie((f, None) for f in POWER_STARTS)
_EXPONENTS = Trie((str(n).translate(str.maketrans("0123456789", SUPERSCRIPTS)) if high else str(n), (n, high)) for n in range(1, LARGEST_EXPONENT + 1) for high in (False, True))
_AFTER = Trie((f, s) for f, s in AFTER)
_GLUED = Trie((f, s) for f, s in GLUED)
_FILLERS = Trie((f, None) for f in FILLERS)


def _cached(maxsize: int):
    """An LRU cache that long texts pass by, so that what it holds stays small."""

    def wrap(f):
        kept = lru_cache(maxsize=maxsize)(f)
        return wraps(f)(lambda text, *rest: (kept if len(text) <= 200 else f)(text, *rest))

    return wrap


def _is_edge(text: str, i: int) -> bool:
    """Whether a word may begin or end between text[i-1] and text[i]."""
    return i <= 0 or i >= len(text) or not (text[i - 1].isalpha() and text[i].isalpha())


def _powers(text: str, i: int) -> Iterator[tuple[int, int]]:
    """(end, size) of the powers of ten that start at a position: a start, then an exponent in plain or raised digits."""
    if i and text[i - 1].isdigit():
        return
    for j, form, _ in _POWERS.walk(text, i):
        for k, _, (exponent, high) in _EXPONENTS.walk(text, j):
            if high != (form[-1] == "^") and not (k < len(text) and text[k].isdigit()):
                yield k, 10**exponent


@_cached(maxsize=200_000)
def segment(text: str, prior: str | None = None) -> tuple[str | None, int | None, int, int] | None:
    """Cheapest decomposition of a whole unit string: (base, scale, numerator, denominator) or None.

    Scale None means that none is written.  Costs: one per lexeme, so that longer lexemes win; an
    unusual reading of a root costs 0.05 more, one outside the field's stored dimension 0.4, so that
    "pounds" are tonnes in a field of masses, and pounds sterling in any other.  A text may have any length.  A state of the dynamic
    programme is what has been read up to a position: base, factor, scale, inside a gloss.
    """
    n, reach = len(text), 0
    layers: dict[int, dict] = defaultdict(dict)
    layers[0][(None, None, 1, 1, False, False)] = 0.0

    def push(i, state, cost):
        nonlocal reach
        reach = max(reach, i)
        if cost < layers[i].get(state, 1e9):
            layers[i][state] = cost

    for i in range(n):
        if i > reach:
            return None
        if not layers[i]:
            continue
        ch = text[i]
        edge = _is_edge(text, i)
        for (base, scale, num, den, gloss, glued), cost in list(layers[i].items()):
            if not glued and (ch.isspace() or ch in ".,:)]"):
                push(i + 1, (base, scale, num, den, gloss, False), cost + (0.0 if ch.isspace() else 0.1))
            if not glued and ch in "([":
                push(i + 1, (base, scale, num, den, base is not None, False), cost + 0.1)
            if edge and not glued:
                for j, _, _ in _FILLERS.walk(text, i):
                    if _is_edge(text, j) or text[j - 1] == "'":
                        push(j, (base, scale, num, den, gloss, False), cost + 0.5)
                for j, form, size in _SCALES.walk(text, i):
                    if not _is_edge(text, j) or (form[0] == "0" and i and text[i - 1].isdigit()) or (j < n and form[-1] == "0" and text[j].isdigit()):
                        continue
                    if gloss:
                        if size == scale:
                            push(j, (base, scale, num, den, True, False), cost + 0.5)
                    else:
                        push(j, (base, (scale or 1) * size, num, den, False, False), cost + 1)
                for j, power in _powers(text, i):
                    if not gloss:
                        push(j, (base, (scale or 1) * power, num, den, False, False), cost + 1)
                if base is not None and scale is None and not gloss:
                    for j, form, size in _AFTER.walk(text, i):
                        if text[i:j] == form and _is_edge(text, j):
                            push(j, (base, size, num, den, False, False), cost + 1)
                for j, form, size in _GLUED.walk(text, i):
                    if text[i:j] == form and not gloss and scale is None and j < n and not text[j].isspace():
                        push(j, (base, size, num, den, False, True), cost + 0.6)
            if edge or glued:
                for j, form, (root, rn, rd, unusual) in _ROOTS.walk(text, i):
                    if not _is_edge(text, j) or (form in EXACT_CASE and text[i:j] != form):
                        continue
                    extra = 1 + 0.05 * unusual + (0.4 if prior and root != prior else 0.0)
                    if base is None:
                        push(j, (root, scale, rn, rd, gloss, False), cost + extra)
                    elif gloss and root == base:
                        push(j, (base, scale, num, den, True, False), cost + 0.5)
    best = min(((c, s) for s, c in layers[n].items() if not s[5]), key=lambda x: (x[0], str(x[1])), default=None)
    if best is None:
        return None
    base, scale, num, den = best[1][:4]
    return None if base is None and scale is None else (base, scale, num, den)


#: a figure in any printing convention: grouping by comma, dot, apostrophe or space; O misread for 0
_FIGURE = re.compile(
    r"(?<![0-9O'’])[0-9O](?:[0-9O]|[.,'’](?=[0-9O])|[\u00a0\u2009\u202f ](?!000s)(?=[0-9O]{3}(?![0-9O])))*"
)
_SIGN = re.compile(r"[-−–]\s*$")
_SPACES = "\u00a0\u2009\u202f "


def read_figure(token: str) -> tuple[int, int] | None:
    """(digits, decimals) of a printed figure; a lone separator before exactly three digits groups."""
    token = token.replace("O", "0").replace("’", "'")
    for ch in _SPACES:
        token = token.replace(ch, "'")
    token = token.replace("'", "")
    dot, comma = token.rfind("."), token.rfind(",")
    cut = -1
    if dot >= 0 and comma >= 0:
        cut = max(dot, comma)
        if token.count(token[cut]) > 1:
            cut = -1
    elif dot >= 0 or comma >= 0:
        at = max(dot, comma)
        if token.count(token[at]) == 1 and (len(token) - at - 1 != 3 or at > 3 or token[:at] in ("", "0")):
            cut = at
    whole = token if cut < 0 else token[:cut]
    part = "" if cut < 0 else token[cut + 1 :]
    digits = re.sub(r"[.,]", "", whole) + part
    return (int(digits), len(part)) if digits.isdigit() else None


@_cached(maxsize=100_000)
def _split_value(raw: str) -> tuple | None:
    """(core as printed, digits, decimals, negative, text before, text after) of a value string."""
    best = None
    for m in _FIGURE.finditer(raw):
        s, e = m.span()
        token = m.group()
        if not any(c.isdigit() for c in token) or (s and raw[s - 1].isalpha() and raw[s - 1] not in "ROsS" and raw[max(0, s - 3) : s] not in ("INR", "USD", "EUR", "GBP")):
            if not any(c.isdigit() for c in token):
                continue
        if token == "000" and ((s and raw[s - 1] in "'’") or raw[e : e + 1] == "s" or raw[s - 1 : s] == " "):
            continue
        if best is None:
            best = (s, e, token)
    if best is None:
        return None
    s, e, token = best
    # "12 000 MT": a last group of 000 after a plain space is the written scale
    spare = ""
    if token.endswith(" 000") and re.match(r"\s*[A-Za-z]", raw[e:]):
        spare, token = token[-4:], token[:-4]
    figure = read_figure(token)
    if figure is None:
        return None
    before, after = raw[:s], spare + raw[e:]
    negative = False
    if "(" in before and ")" in after and after.lstrip().startswith(")"):
        k = before.rfind("(")
        if not before[k + 1 :].strip(" -−–"):
            negative, before, after = True, before[:k], after.lstrip()[1:]
    if (m := _SIGN.search(before)) is not None:
        negative, before = True, before[: m.start()]
    return token, figure[0], figure[1], negative, before, after


_MARKS = re.compile(r"approx\.?|\bca?\.|[~*†‡§≈+]|\[[A-Za-z0-9]\]", re.I)


def _around(before: str, after: str, prior: str | None) -> tuple | None:
    """The unit written with a figure, before it, after it or on both sides."""
    left, right = _MARKS.sub(" ", before).strip(), _MARKS.sub(" ", after).strip()
    if not left and not right:
        return None
    if right.count("(") > right.count(")"):
        right += ")"
    a, b = (segment(left, prior) if left else None), (segment(right, prior) if right else None)
    return _merge(a, b)


def _merge(a: tuple | None, b: tuple | None) -> tuple | None:
    """What two places state; the first one wins where both do."""
    if a is None or b is None:
        return a or b
    base, num, den = (a[0], a[2], a[3]) if a[0] else (b[0], b[2], b[3])
    return base, a[1] if a[1] is not None else b[1], num, den


_WORD_STARTS = re.compile(r"(?<![A-Za-z0-9])(?=\S)")


@_cached(maxsize=100_000)
def _ending_unit(text: str, prior: str | None) -> tuple | None:
    """The longest unit phrase that ends a text."""
    for m in _WORD_STARTS.finditer(text):
        if (found := segment(text[m.start() :].strip(), prior)) is not None:
            return found
    return None


@_cached(maxsize=100_000)
def _starting_unit(text: str, prior: str | None) -> tuple | None:
    """The longest unit phrase that starts a text."""
    ends = [m.end() for m in re.finditer(r"[^\s]+", text)]
    for e in reversed(ends):
        piece = text[:e].strip()
        if piece.count("(") > piece.count(")"):
            piece += ")"
        if (found := segment(piece, prior)) is not None:
            return found
        trimmed = piece.rstrip(".,;)")
        if trimmed != piece and (found := segment(trimmed, prior)) is not None:
            return found
    return None


_LETTERS = re.compile(r"[A-Za-z]+$")
#: a bracket that holds the figure of another period or a plan
_OTHER_FIGURE = re.compile(r"\((?:previous|prior|plan|budget|target)\b[^)]*$", re.I)


def _is_figure(quote: str, at: int, end: int) -> bool:
    """Whether quote[at:end] is a figure of its own: no part of a longer one or of a label such as Q2."""
    left, right = quote[at - 1] if at else " ", quote[end] if end < len(quote) else " "
    if left.isdigit() or (left in ".,'O" and at > 1 and quote[at - 2].isdigit()):
        return False
    if right.isdigit() or (right in ".,'O" and quote[end + 1 : end + 2].isdigit()):
        return False
    head = quote[max(0, at - 40) : at]  # longer than any unit that is one word
    letters = _LETTERS.search(head)
    # letters against a figure are a unit (INR2), else they and the figure are one label
    if (letters is not None and segment(letters.group()) is None) or re.search(r"[A-Za-z]-$", head):
        return False
    return _OTHER_FIGURE.search(quote[:at]) is None


_BRACKET = re.compile(r"[(\[]([^()\[\]]*)[)\]]\s*$")
_PERIOD = re.compile(r"\b(?:[QH][1-4]\b|FY\s?\d[\d\-/]*|(?:19|20)\d\d\b)", re.I)


def _holds_figure(cell: str) -> bool:
    """Whether a cell has a figure besides periods, powers of ten and the number of a line."""
    cell = _PERIOD.sub(" ", re.sub(r"^\s*\d+[.)]", " ", cell))
    return re.search(r"\d", re.sub(r"'?000s?\b|10\^\d", " ", cell)) is not None


def _cell_unit(cell: str, predicate: str | None, prior: str | None) -> tuple | None:
    """The unit of a heading or label cell; a predicate is none, whatever it is called."""
    if (m := _BRACKET.search(cell)) is not None and (unit := segment(m.group(1).strip(), prior)) is not None:
        return unit
    cell = cell.strip()
    return None if predicate and cell == predicate.strip() else segment(cell, prior)


def _fitting(unit: tuple | None, cell: tuple | None) -> tuple | None:
    """A cell fills what is open but doesn't rescale a currency by the scale of another unit."""
    if unit is not None and cell is not None and unit[0] and cell[0] and unit[0] != cell[0]:
        return unit
    return _merge(unit, cell)


def _from_quote(quote: str, predicate: str | None, token: str, prior: str | None) -> tuple | None:
    """The unit in the words next to this figure in the quote; other figures' units don't count.

    The words next to a figure are those that join it without another word or figure between, before
    it or after it, as far as its clause or cell goes (| ; : end it), however long they are.  What
    they leave open comes from the cells before, the nearest first, back to the one that holds a
    further figure: a cell that is a unit as a whole, such as a heading, or that ends in one in
    brackets, such as a label.

    Places after the predicate are tried first, in their order, until one has a unit.  Places before
    it are tried only if the figure doesn't stand after it.
    """
    floor = 0
    if predicate:
        at = quote.find(predicate)
        floor = at + len(predicate) if at >= 0 else 0
    for start in (floor, 0):
        at, met = quote.find(token, start), False
        while at >= 0:
            end = at + len(token)
            if _is_figure(quote, at, end):
                met = True
                head = quote[:at].rstrip("(-−– \t\r\n\x0b\x0c\x85" + _SPACES)
                tail = re.sub(r"^\)", "", quote[end:])
                tail = re.split(r"\(previous|\bin (?:Q\d|FY)|\bfor the\b|[|;]", tail)[0]
                *cells, head = re.split(r"[|;:]", head)
                unit = _merge(_ending_unit(head, prior), _starting_unit(_MARKS.sub(" ", tail), prior))
                for cell in reversed(cells):
                    if (unit is not None and _complete(unit)) or _holds_figure(cell):
                        break
                    unit = _fitting(unit, _cell_unit(cell, predicate, prior))
                if unit is not None:
                    return unit
            at = quote.find(token, at + 1)
        if floor == 0 or met:
            break
    return None


@lru_cache(maxsize=20_000)
def _stored(dimension: str | None, currency: str | None, scale: float | None) -> tuple | None:
    base = STORED_BASE.get(dimension or "")
    if base is None and (dimension in (None, "", "currency")) and currency in CURRENCIES:
        base = currency
    if scale is None or scale <= 0:
        return (base, None, 1, 1) if base else None
    if scale >= 1:
        return base, int(scale), 1, 1
    return base, 1, 1, round(1 / scale)


@lru_cache(maxsize=20_000)
def _scale_word(word: str) -> int | None:
    found = segment(word, None)
    return found[1] if found and found[0] is None else None


def _qualified(qualifiers) -> tuple | None:
    if not qualifiers:
        return None
    q = dict(qualifiers)
    base = q.get("currency") if q.get("currency") in CURRENCIES else STORED_BASE.get(q.get("unit_dimension") or "")
    scale = _scale_word(q["scale"]) if q.get("scale") else None
    return (base, scale, 1, 1) if base or scale is not None else None


def resolve(value_raw, unit_raw, quote, predicate, dimension, currency, scale, qualifiers) -> tuple[str, int] | None:
    """(base unit, thousandths) of one measurement, or None where figure or unit can't be determined."""
    found = measure(value_raw, unit_raw, lambda: quote, predicate, dimension, currency, scale, lambda: qualifiers)
    return found and found[:2]


def measure(value_raw, unit_raw, quote, predicate, dimension, currency, scale, qualifiers) -> tuple[str, int, bool] | None:
    """(base unit, thousandths, whether they are exact); quote and qualifiers are asked for only if what comes before them leaves the unit open."""
    parts = _split_value(value_raw) if value_raw else None
    if parts is None:
        return None
    token, digits, decimals, negative, before, after = parts
    prior = STORED_BASE.get(dimension or "") or (currency if dimension == "currency" else None)
    unit = _around(before, after, prior)
    if unit is None or not _complete(unit):
        if unit_raw:
            unit = _merge(unit, segment(unit_raw.strip(), prior))
        if unit is None or not _complete(unit):
            if text := quote():
                unit = _merge(unit, _from_quote(text, predicate, token, prior))
            if unit is None or not _complete(unit):
                unit = _supply(unit, _stored(dimension, currency, scale))
                if unit is None or not _complete(unit):
                    unit = _supply(unit, _qualified(qualifiers()))
    if unit is None or unit[0] is None:
        return None
    base, size, num, den = unit
    milli, rest = divmod(digits * (size or 1) * num * 1000, 10**decimals * den)
    if rest * 2 >= 10**decimals * den:
        milli += 1
    return base, -milli if negative else milli, rest == 0


def _complete(unit: tuple) -> bool:
    """A currency without a scale leaves the scale open; other roots are whole units themselves."""
    base, size = unit[0], unit[1]
    return base is not None and (size is not None or base not in CURRENCIES)


def _supply(unit: tuple | None, later: tuple | None) -> tuple | None:
    """Let stored columns or qualifiers fill what the printed unit leaves open.

    They supply a base for a lone scale, or a scale for a lone currency.  A place that states a
    currency with a scale of its own is a whole other unit: it doesn't rescale a printed currency.
    """
    if unit is None or later is None:
        return unit or later
    if unit[0] is None:
        return later[0], unit[1], later[2], later[3]
    if unit[1] is None and later[0] is None and unit[0] in CURRENCIES:
        return unit[0], later[1], unit[2], unit[3]
    return unit


_COLUMNS = ["value_raw", "unit_raw", "predicate", "unit_dimension", "unit_currency", "unit_scale"]


def to_base_units(claims: DataFrame, id_col: str = "id") -> DataFrame:
    """One row (claim_id, base_unit, base_milli, problem) per measurement claim, nulls where undeterminable.

    ``problem`` says why: "undetermined", "beyond 64 bits", or "rounded" where the value isn't a
    whole number of thousandths.  A narrow per-batch map: no shuffle, nothing broadcast but the code;
    each distinct unit string is segmented once per worker, and quotes and qualifiers are read only
    for the rows that need them.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quotes, qualifiers = batch.column("evidence_quote"), batch.column("qualifiers")
            base, milli, problem = [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in _COLUMNS), strict=True)
            for i, (value_raw, unit_raw, predicate, dimension, currency, scale) in enumerate(rows):
                found = measure(value_raw, unit_raw, lambda i=i: quotes[i].as_py(), predicate, dimension, currency, scale, lambda i=i: qualifiers[i].as_py())
                if found is not None and abs(found[1]) >= 2**63:
                    found, said = None, "beyond 64 bits"
                else:
                    said = "undetermined" if found is None else None if found[2] else "rounded"
                base.append(found and found[0])
                milli.append(found and found[1])
                problem.append(said)
            arrays = [batch.column("claim_id"), pa.array(base, pa.string()), pa.array(milli, pa.int64()), pa.array(problem, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["claim_id", "base_unit", "base_milli", "problem"])

    rows = claims.filter(F.col("claim_type") == "measurement").select(F.col(id_col).cast("bigint").alias("claim_id"), *_COLUMNS, "evidence_quote", "qualifiers")
    return rows.mapInArrow(convert, "claim_id bigint, base_unit string, base_milli bigint, problem string")


def found(claims: DataFrame) -> DataFrame:
    """The measurement claims with a printed figure and a determinable unit."""
    return to_base_units(claims).filter(F.col("base_unit").isNotNull()).drop("problem")
