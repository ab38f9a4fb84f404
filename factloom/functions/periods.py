"""Reporting periods as intervals, read from their labels on the document's own fiscal calendar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SPAN_WORDS = r"(?i)\bfor\s+the\s+(year|quarter|period|half[\s-]?year)\s+end(ed|ing)\b|\byear\s+end(ed|ing)\b|\btwelve\s+months?\s+end(ed|ing)\b"
INSTANT_WORDS = r"(?i)\bas\s+(at|on|of)\b|\bbalance\s+sheet\s+date\b"
# ---- end of fixed values ----
_NAMES = "|".join(sorted({*MONTHS, *[m[:3] for m in MONTHS]}, key=len, reverse=True))
_QUARTER = r"(?i)\bQ([1-4])\b[\s/-]*(?:FY)?\s*([0-9]{2,4})(?:\s*[-/]\s*([0-9]{2,4}))?"
_YEAR = r"(?i)\bFY\s*([0-9]{2,4})(?:\s*[-/]\s*([0-9]{2,4}))?"
_ISO = r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"
_LONG = rf"(?i)\b({_NAMES})\.?\s+([0-9]{{1,2}})\s*,?\s*([0-9]{{4}})\b"
_PAIR = r"\b([0-9]{4})\s*[-/]\s*([0-9]{2,4})\b"
_BARE = r"\b([0-9]{4})\b"
_CLOSES = r"(?i)\b(?:year|period)\s+end(?:ed|ing)\s+(?:the\s+)?(?:[0-9]{1,2}\s+)?(" + "|".join(MONTHS) + r")\b"


def _part(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def month_number(name: Column) -> Column:
    short = F.substring(F.lower(name), 1, 3)
    return reduce(lambda c, k: c.when(short == MONTHS[k][:3], k + 1), range(1, 12), F.when(short == MONTHS[0][:3], 1))


def fiscal_start_month(text: Column, default: int = 4) -> Column:
    """The month in which the fiscal year opens, from wording such as "year ended March 31"."""
    return F.coalesce(month_number(_part(text, _CLOSES, 1)) % 12 + 1, F.lit(default))


def full_year(token: Column, anchor: Column | None = None) -> Column:
    """A year of two or four digits; with an anchor the century is the anchor's, or the next if that is before it."""
    value = token.cast("int")
    if anchor is None:
        short = F.when(value <= 50, 2000 + value).otherwise(1900 + value)
    else:
        near = anchor - anchor % 100 + value
        short = F.when(near < anchor, near + 100).otherwise(near)
    return F.when(F.length(token) == 4, value).otherwise(short)


def fiscal_year(end_year: Column, start_month: Column) -> tuple[Column, Column]:
    """(first day, last day) of the fiscal year named for the year in which it ends."""
    first = F.when(start_month == 1, F.make_date(end_year, F.lit(1), F.lit(1))).otherwise(F.make_date(end_year - 1, start_month, F.lit(1)))
    return first, F.date_sub(F.add_months(first, 12), 1)


def fiscal_name(day: Column, start_month: Column) -> Column:
    """The year that names the fiscal year a day lies in."""
    closes = (start_month + 10) % 12 + 1
    return F.when((F.month(day) != closes) & (F.month(day) >= start_month), F.year(day) + 1).otherwise(F.year(day))


def parse_period(raw: Column, hint: Column | None = None, start_month: Column | int = 4) -> Column:
    """STRUCT(label, start, end, granularity, ambiguous, confidence) of a period label.

    Tried in order: quarter, fiscal year, a full date (a year, an instant, or a year end of which the
    hint doesn't say which), two years, one year; else unknown.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    hint = F.coalesce(hint, F.lit("")) if hint is not None else F.lit("")
    opens = F.lit(start_month) if isinstance(start_month, int) else start_month

    def says(label, first, last, kind: str, confidence: float, ambiguous: bool = False) -> Column:
        return F.struct(label.alias("label"), first.alias("start"), last.alias("end"), F.lit(kind).alias("granularity"), F.lit(ambiguous).alias("ambiguous"), F.lit(confidence).alias("confidence"))

    def fiscal(year: Column, confidence: float = 1.0, ambiguous: bool = False) -> Column:
        return says(F.concat(F.lit("FY"), year.cast("string")), *fiscal_year(year, opens), "fiscal_year", confidence, ambiguous)

    quarter, one, two = (_part(text, _QUARTER, k) for k in (1, 2, 3))
    named = F.when(two.isNotNull(), full_year(two, full_year(one))).otherwise(full_year(one))
    q_first = F.add_months(fiscal_year(named, opens)[0], (quarter.cast("int") - 1) * 3)
    in_quarter = says(F.concat(F.lit("Q"), quarter, F.lit(" FY"), named.cast("string")), q_first, F.date_sub(F.add_months(q_first, 3), 1), "quarter", 1.0)

    fy_one, fy_two = _part(text, _YEAR, 1), _part(text, _YEAR, 2)
    in_year = fiscal(F.when(fy_two.isNotNull(), full_year(fy_two, full_year(fy_one))).otherwise(full_year(fy_one)))

    iso = F.try_to_date(_part(text, _ISO, 1), "yyyy-MM-dd")
    day = F.coalesce(iso, F.try_to_date(F.concat_ws("-", _part(text, _LONG, 3), F.lpad(month_number(_part(text, _LONG, 1)).cast("string"), 2, "0"), F.lpad(_part(text, _LONG, 2), 2, "0")), "yyyy-MM-dd"))
    instant = lambda c: says(day.cast("string"), day, day, "instant", c)
    closing = (F.month(day) == (opens + 10) % 12 + 1) & (day == F.last_day(day))
    on_day = (
        F.when(hint.rlike(SPAN_WORDS), fiscal(fiscal_name(day, opens)))
        .when(hint.rlike(INSTANT_WORDS), instant(1.0))
        .when(closing, fiscal(fiscal_name(day, opens), 0.6, True))
        .otherwise(instant(0.9))
    )

    from_, to = _part(text, _PAIR, 1).cast("int"), full_year(_part(text, _PAIR, 2), _part(text, _PAIR, 1).cast("int"))
    years = says(F.concat_ws("-", from_.cast("string"), to.cast("string")), F.make_date(from_, F.lit(1), F.lit(1)), F.make_date(to, F.lit(12), F.lit(31)), "multi_year", 1.0)
    bare = _part(text, _BARE, 1)
    year = says(bare, F.make_date(bare.cast("int"), F.lit(1), F.lit(1)), F.make_date(bare.cast("int"), F.lit(12), F.lit(31)), "multi_year", 0.7)
    nothing = says(F.lit("unknown"), F.lit(None).cast("date"), F.lit(None).cast("date"), "unknown", 0.0)
    return (
        F.when(quarter.isNotNull(), in_quarter)
        .when(fy_one.isNotNull(), in_year)
        .when(day.isNotNull(), on_day)
        .when(to - from_ == 1, fiscal(to))
        .when(to > from_, years)
        .when(bare.isNotNull(), year)
        .otherwise(nothing)
    )


def period_relation(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """same, overlapping, disjoint, or unknown where a side has no interval."""
    unknown = start_a.isNull() | end_a.isNull() | start_b.isNull() | end_b.isNull()
    return (
        F.when(unknown, "unknown")
        .when((start_a == start_b) & (end_a == end_b), "same")
        .when((start_a <= end_b) & (start_b <= end_a), "overlapping")
        .otherwise("disjoint")
    )
