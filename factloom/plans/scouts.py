"""The second look at a contradiction: leads in the pages, the guard against circular ones, and re-judging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
SIGN_TOLERANCE = 0.005
LESS_OR_ADD = r"(?i)^\s*(less|add|deduct)\b\s*[:.\-]?"
COORDINATION = r"(?i)\b(and|respectively|while|whereas|against)\b"
LEAST_CONFIDENCE = 0.6
# ---- end of fixed values ----


def lines_with(page: Column, figure: Column) -> Column:
    """The lines of a page in which a figure stands."""
    return F.filter(F.split(F.coalesce(page, F.lit("")), r"\r\n|[\n\r]"), lambda line: line.contains(figure))


def row_label(line: Column) -> Column:
    """The first cell of a table row, or what precedes the first figure of a line."""
    cell = F.trim(F.element_at(F.split(line, r"\|"), 1))
    return F.when(line.contains("|"), cell).otherwise(F.trim(F.regexp_extract(line, r"^([^0-9]*)", 1)))


def signs_differ(a: Column, b: Column) -> Column:
    """Opposite signs and magnitudes within half a per cent."""
    return (a * b < 0) & (F.abs(F.abs(a) - F.abs(b)) <= SIGN_TOLERANCE * F.greatest(F.abs(a), F.abs(b)))


def _reversing(raw: Column, page: Column) -> Column:
    """Whether a figure is printed in brackets or in a row labelled less or add."""
    return raw.rlike(r"^\s*\(.*\)\s*$") | F.exists(lines_with(page, raw), lambda line: row_label(line).rlike(LESS_OR_ADD))


def sign_lead(a: Column, b: Column, raw_a: Column, raw_b: Column, page_a: Column, page_b: Column) -> Column:
    """Confidence that two values differ only by sign convention: 0.9 if both sides show theirs, 0.7 if one does, else null."""
    shown = _reversing(raw_a, page_a).cast("int") + _reversing(raw_b, page_b).cast("int")
    return F.when(signs_differ(a, b) & (shown == 2), 0.9).when(signs_differ(a, b) & (shown == 1), 0.7)


def shared_span_lead(quote_a: Column, quote_b: Column) -> Column:
    """Confidence that both figures stand in one passage: its words tell them apart if it coordinates them."""
    fold = lambda q: F.lower(F.trim(F.regexp_replace(q, r"\s+", " ")))
    x, y = fold(quote_a), fold(quote_b)
    same = (x != "") & (y != "") & (x.contains(y) | y.contains(x))
    return F.when(same & (quote_a.rlike(COORDINATION) | quote_b.rlike(COORDINATION)), 0.9).when(same, 0.75)


def row_label_lead(raw_a: Column, raw_b: Column, page_a: Column, page_b: Column) -> Column:
    """0.8 where the figures stand in rows with different labels."""
    label = lambda page, raw: F.lower(row_label(F.get(lines_with(page, raw), F.lit(0))))
    a, b = label(page_a, raw_a), label(page_b, raw_b)
    return F.when((a != "") & (b != "") & (a != b), 0.8)


def is_circular(label: Column, raw: Column, unit: Column) -> Column:
    """Whether a label only repeats the figure that it is to explain: it contains the figure, or nothing but figures and the unit."""
    bare = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[\s,.()%]", "")
    rest = F.replace(F.regexp_replace(bare(label), "[0-9]", ""), F.regexp_replace(bare(unit), "[0-9]", ""), F.lit(""))
    figure = bare(raw)
    contains = (figure != "") & bare(label).contains(figure)
    return F.coalesce(contains | ((rest == "") & label.rlike("[0-9]")), F.lit(False))


def reconsidered(verdict: Column, value_a: Column, value_b: Column, confidence: Column) -> Column:
    """A contradiction with grounded, different values of a new axis becomes CONTEXTUAL; a second look never corroborates."""
    explains = (confidence >= LEAST_CONFIDENCE) & (value_a != value_b)
    out = F.when((verdict == "CONTRADICTS") & explains, "CONTEXTUAL").otherwise(verdict)
    return F.when((out == "CORROBORATES") & (verdict != "CORROBORATES"), F.raise_error(F.lit("a second look must not corroborate"))).otherwise(out)


def with_axes(axes: Column, learned: Column) -> Column:
    """What is learned of a claim's context, without changing what it states."""
    return F.map_concat(F.map_filter(learned, lambda k, v: ~F.map_contains_key(axes, k)), axes)


def reapplied(verdict: Column, value_a: Column, value_b: Column, confidence: Column, raw_a: Column, raw_b: Column, unit_a: Column, unit_b: Column) -> Column:
    """What a remembered explanation makes of a contradiction today.

    What was verified against the pages stays; whether a label is circular is judged again, and an
    explanation without labels or with too little confidence leaves the verdict.
    """
    circular = is_circular(F.coalesce(value_a, F.lit("")), raw_a, unit_a) | is_circular(F.coalesce(value_b, F.lit("")), raw_b, unit_b)
    says = F.coalesce(F.nullif(value_a, F.lit("")), F.nullif(value_b, F.lit(""))).isNotNull()
    differ = ~F.coalesce(value_a, F.lit("")).eqNullSafe(F.coalesce(value_b, F.lit("")))
    holds = (verdict == "CONTRADICTS") & (F.coalesce(confidence, F.lit(0.0)) >= LEAST_CONFIDENCE) & says & differ & ~circular
    return F.when(holds, "CONTEXTUAL").otherwise(verdict)
