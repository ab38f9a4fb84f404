"""What printed values say: their precision, and whether two of them can be one value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: a tie at the edge of two roundings is a disagreement, whatever the last bit says
SLACK = 1 - 1e-9


def written_precision(raw: Column, scale: Column | float = 1.0) -> Column:
    """The smallest step that a printed figure shows, in base units; null without a digit.

    Three digits after a last comma are a group of thousands, not decimals.
    """
    scale = F.lit(scale) if isinstance(scale, float) else scale
    text = F.trim(raw)
    tail = F.regexp_extract(text, r"([.,][0-9]+)\s*%?\s*\)?\s*$", 1)
    grouped = tail.rlike("^,[0-9]{3}$")
    places = F.when((tail == "") | grouped, 0).otherwise(F.length(tail) - 1)
    return F.when(text.rlike("[0-9]"), F.pow(F.lit(10.0), -places) * scale)


def difference(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def relative(a: Column, b: Column) -> Column:
    """The difference as a share of the larger magnitude."""
    largest = F.greatest(F.abs(a), F.abs(b))
    return F.when(largest > 0, difference(a, b) / largest).when(largest.isNotNull(), 0.0)


def agree(a: Column, b: Column, precision_a: Column, precision_b: Column) -> Column:
    """Whether two values can be roundings of one; equality if neither shows a precision; null if one is null."""
    threshold = (F.coalesce(precision_a, F.lit(0.0)) + F.coalesce(precision_b, F.lit(0.0))) / 2
    bare = precision_a.isNull() & precision_b.isNull()
    return F.when(bare, difference(a, b) == 0).otherwise(difference(a, b) < threshold * SLACK)


def relation(agreed: Column) -> Column:
    return F.when(agreed.isNull(), "unknown").when(agreed, "agree").otherwise("disagree")


def text_tokens(value: Column) -> Column:
    """Lower-case words and numbers of a text value, & read as and."""
    return F.regexp_extract_all(F.replace(F.lower(F.coalesce(value, F.lit(""))), F.lit("&"), F.lit(" and ")), F.lit("([a-z0-9]+)"), 1)


def _initials(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.slice(words, start, n), lambda w: F.substring(w, 1, 1)), "")


def _aligned(short: Column, long: Column) -> Column:
    """Whether the short side reads as the long one, acronyms spelt out; -1 stands for a failed read."""

    def step(at: Column, token: Column) -> Column:
        n = F.length(token)
        spelt = (n >= 2) & token.rlike("^[a-z]+$") & (at + n - 1 <= F.size(long)) & (_initials(long, at, n) == token)
        return F.when(at < 1, -1).when(F.try_element_at(long, at).eqNullSafe(token), at + 1).when(spelt, at + n).otherwise(-1)

    return F.aggregate(short, F.lit(1), step) == F.size(long) + 1


def texts_agree(a: Column, b: Column) -> Column:
    """Whether two token lists say the same: equal, or equal numbers and words that differ by acronyms only; null if one is empty."""
    numbers = lambda x: F.filter(x, lambda t: t.rlike("[0-9]"))
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(None).cast("boolean"))
        .when(a == b, True)
        .when(numbers(a) != numbers(b), False)
        .otherwise(_aligned(a, b) | _aligned(b, a))
    )


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")
