"""Questions over the claims: what they name, the claims that answer, and the contexts that keep answers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import texts
from factloom.plans.claims import axes

PERIOD = r"(?i)\b(Q[1-4]\s*FY\s*[0-9]{2,4}|FY\s*[0-9]{2,4}|[0-9]{4})\b"
INCOHERENT_SPAN = 0.01


def resolve(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(question, kind, name) of the registry name of each kind that a question's words cover best.

    Questions: (question); names: (kind, name), a small register.  The share of a name's words in the
    question decides, then the later name; at least half of them must be there.
    """
    asked = questions.select("question", F.explode(texts.tokens(F.col("question"))).alias("word")).distinct()
    named = names.select("kind", "name", texts.tokens(F.col("name")).alias("words")).filter("size(words) > 0")
    by_word = named.select("kind", "name", F.size("words").alias("size"), F.explode("words").alias("word"))
    hits = asked.join(by_word, "word").groupBy("question", "kind", "name", "size").agg(F.count(F.lit(1)).alias("hits"))
    scored = hits.withColumn("share", F.col("hits") / F.col("size")).filter("share >= 0.5")
    return scored.groupBy("question", "kind").agg(F.max(F.struct("share", "size", "name"))["name"].alias("name"))


def context(claims: DataFrame) -> Column:
    """What keeps two claims from answering the same question: axes and modality in order."""
    stated = axes(F.col("qualifiers"), F.col("modality"))
    return F.array_join(F.array_sort(F.transform(F.map_entries(stated), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")


def contexts(claims: DataFrame) -> DataFrame:
    """(subject, predicate, period, dimension, context, claims, spread, texts, incoherent) of every context in which something is measured or held.

    A context is incoherent if its values span more than a hundredth of the largest, or it has several texts.
    """
    period = F.coalesce("period_label", "period_raw", F.lit(""))
    value = F.when(F.col("claim_type") == "measurement", F.col("value_num") * F.coalesce("unit_scale", F.lit(1.0)))
    rows = claims.select("subject", "predicate", period.alias("period"), F.coalesce("unit_dimension", F.lit("")).alias("dimension"), context(claims).alias("context"), value.alias("v"), F.lower(F.trim("value_text")).alias("t"))
    grouped = rows.groupBy("subject", "predicate", "period", "dimension", "context").agg(
        F.count(F.lit(1)).alias("claims"), F.max("v").alias("high"), F.min("v").alias("low"), F.max(F.abs("v")).alias("largest"), F.count_distinct("t").alias("texts")
    )
    spread = F.when(F.col("largest") > 0, (F.col("high") - F.col("low")) / F.col("largest")).otherwise(0.0)
    return grouped.withColumn("spread", spread).withColumn("incoherent", (F.col("spread") > INCOHERENT_SPAN) | (F.col("texts") > 1)).drop("high", "low", "largest")


def distinguishing(claims: DataFrame) -> DataFrame:
    """(subject, predicate, axis, n_values): axes on which the answers about one thing differ, an absent one being a value."""
    stated = axes(F.col("qualifiers"), F.col("modality"))
    key = ["subject", "predicate"]
    rows = claims.select(*key, stated.alias("m"))
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("all"))
    each = rows.select(*key, F.explode("m").alias("axis", "value")).groupBy(*key, "axis", "value").agg(F.count(F.lit(1)).alias("n"))
    by_axis = each.groupBy(*key, "axis").agg(F.count(F.lit(1)).alias("stated"), F.sum("n").alias("n"))
    joined = by_axis.join(counted, key)
    n = F.col("stated") + F.when(F.col("n") < F.col("all"), 1).otherwise(0)
    return joined.select(*key, "axis", n.alias("n_values")).filter("n_values > 1")
