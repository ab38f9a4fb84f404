"""Evidence: whether a claim's quote stands on its page, and its value in the quote; what doesn't is quarantined.

Tiers from exact to forgiving: the quote as it is (1.0), after folding what typesetting varies (0.95),
after joining hyphenated words (0.9), as a subsequence of the cells of one table row (0.6).  Folding
uses NFKC, which Spark has no function for, in an Arrow UDF; the rest are Column expressions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: dashes, quotes and blanks that are folded, signs that are dropped, scores ----
DASHES, QUOTES, DOUBLE_QUOTES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "\u2018\u2019\u201a", "\u201c\u201d\u201e"
DROPPED = "\u200b\u200c\u200d\u00ad\ufeff"
SCORES = {"exact": 1.0, "normalized": 0.95, "dehyphenated": 0.9, "row_subset": 0.6}
SHORT_QUOTE, SHORT_FACTOR = 8, 0.8
# ---- end of fixed values ----
_FOLD = {**dict.fromkeys(map(ord, DASHES), "-"), **dict.fromkeys(map(ord, QUOTES), "'"), **dict.fromkeys(map(ord, DOUBLE_QUOTES), '"'), **dict.fromkeys(map(ord, DROPPED))}


def fold_text(text: str) -> str:
    """NFKC, folded signs, and one blank for any white space."""
    folded = unicodedata.normalize("NFKC", text).translate(_FOLD)
    out, blank = [], False
    for ch in folded:
        if ch.isspace():
            if not blank:
                out.append(" ")
            blank = True
        else:
            out.append(ch)
            blank = False
    return "".join(out)


def fold(text: Column) -> Column:
    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fold_text(t))

    return folded(text)


def dehyphenated(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(\w)-\s*(\w)", "$1$2")


def _cells(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\|"), lambda c: F.trim(c)), lambda c: c != "")


def _row_subset(quote: Column, page: Column) -> Column:
    """Whether the quote's cells, two or more, come in this order in one line of the page."""
    wanted = _cells(quote)

    def in_line(line: Column) -> Column:
        step = lambda left, cell: F.when((F.size(left) > 0) & (F.get(left, F.lit(0)) == cell), F.slice(left, F.lit(2), F.greatest(F.size(left), F.lit(1)))).otherwise(left)
        return F.size(F.aggregate(_cells(line), wanted, step)) == 0

    lines = F.filter(F.split(page, r"\r\n|[\n\r]"), lambda x: x.contains("|"))
    return (F.size(wanted) >= 2) & F.exists(lines, in_line)


def grounded(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """(claim_id, document_id, page_no, ok, method, score, reason_code, start) of every claim.

    A page that was ingested again counts by its smallest id; a claim without a page has an empty
    one.  The value is the printed one of a measurement, the text of a state.
    """
    newest = pages.groupBy("document_id", "page_no").agg(F.min_by("text", "id").alias("page"))
    value = F.when(F.col("claim_type") == "measurement", F.col("value_raw")).otherwise(F.coalesce("value_text", "subject"))
    rows = claims.select(F.col("id").alias("claim_id"), "document_id", "page_no", F.coalesce("evidence_quote", F.lit("")).alias("quote"), value.alias("value"))
    rows = rows.join(newest, ["document_id", "page_no"], "left").withColumn("page", F.coalesce("page", F.lit("")))
    rows = rows.withColumn("at", F.instr("page", F.col("quote")))
    # folding both sides is Python's work, so it is done for what isn't there as it is
    exact = F.col("at") > 0
    rows = rows.withColumn("folded_quote", F.trim(fold(F.col("quote")))).withColumn("folded_page", fold(F.when(~exact, F.col("page")).otherwise("")))
    method = (
        F.when(F.trim("quote") == "", "none")
        .when(exact, "exact")
        .when(F.col("folded_page").contains(F.col("folded_quote")), "normalized")
        .when(dehyphenated(F.col("folded_page")).contains(dehyphenated(F.col("folded_quote"))), "dehyphenated")
        .when(_row_subset(F.col("folded_quote"), F.col("page")), "row_subset")
        .otherwise("none")
    )
    rows = rows.withColumn("method", method)
    folded_value = F.trim(fold(F.col("value")))
    rows = rows.withColumn("folded_value", folded_value)
    figures = lambda c: F.regexp_replace(c, "[^0-9]", "")
    in_quote = F.lower("folded_quote").contains(F.lower("folded_value")) | ((figures(F.col("folded_value")) != "") & figures(F.col("folded_quote")).contains(figures(F.col("folded_value"))))
    reason = (
        F.when(F.trim("quote") == "", "empty_quote")
        .when(F.col("method") == "none", "quote_not_found")
        .when(F.coalesce("folded_value", F.lit("")) == "", "missing_value")
        .when(~in_quote, "value_not_in_quote")
    )
    base = F.coalesce(*[F.when(F.col("method") == m, s) for m, s in SCORES.items()], F.lit(0.0))
    score = F.when(F.col("reason_code").isNotNull(), 0.0).when(F.length(F.trim("quote")) < SHORT_QUOTE, F.round(base * SHORT_FACTOR, 3)).otherwise(base)
    rows = rows.withColumn("reason_code", reason)
    return rows.select("claim_id", "document_id", "page_no", F.col("reason_code").isNull().alias("ok"), "method", score.alias("score"), "reason_code", F.when(F.col("method") == "exact", F.col("at") - 1).alias("start"))
