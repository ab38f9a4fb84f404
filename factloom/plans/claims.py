"""The claims table as the comparison engine sees it: gate records of measurements and states, holdings of seats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import texts, values


def axes(qualifiers: Column, modality: Column) -> Column:
    """What a claim says about its context: its qualifiers, and its modality if it has one; no nulls."""
    stated = F.map_filter(F.coalesce(qualifiers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: v.isNotNull() & (k != "modality"))
    said = F.coalesce(modality, F.lit(""))
    return F.when(said != "", F.map_concat(stated, F.create_map(F.lit("modality"), said))).otherwise(stated)


def comparables(claims: DataFrame) -> DataFrame:
    """One gate record per claim.

    The entity and metric are keys of the strings as typed; a canonical value needs a number and is
    scaled by the stored scale (1 if null or 0).  An axis that is stated is never unknown too.
    """
    scale = F.when(F.coalesce("unit_scale", F.lit(0.0)) == 0, 1.0).otherwise(F.col("unit_scale"))
    stated = axes(F.col("qualifiers"), F.col("modality"))
    measured = F.col("claim_type") == "measurement"
    return claims.select(
        F.col("id").alias("claim_id"),
        F.col("document_id").alias("document"),
        "claim_type",
        F.nullif(texts.name_key(F.col("subject")), F.lit("")).alias("entity"),
        F.nullif(texts.predicate_key(F.col("predicate")), F.lit("")).alias("metric"),
        F.col("unit_dimension").alias("dimension"),
        F.col("unit_currency").alias("currency"),
        F.when(measured, F.col("value_num") * scale).alias("canonical"),
        F.when(measured, values.written_precision(F.col("value_raw"), scale)).alias("precision"),
        values.text_tokens(F.when(measured, "").otherwise(F.col("value_text"))).alias("text"),
        (measured | (texts.cardinality(F.col("predicate")) == 1)).alias("single"),
        "period_start",
        "period_end",
        "valid_from",
        "valid_to",
        stated.alias("axes"),
        F.array_sort(F.array_except(F.coalesce("unknown_qualifiers", F.array().cast("array<string>")), F.map_keys(stated))).alias("unknown"),
    )


def holdings(claims: DataFrame) -> DataFrame:
    """(ref, scope, predicate, filler, document, valid_from, valid_to, open, asserted) of the state claims.

    The scope is the organisation, else the subject; the filler is the subject, or the value where the
    subject is the organisation itself.  An interval without an end is open.
    """
    org = F.coalesce(F.nullif(F.trim("org_scope"), F.lit("")), F.col("subject"))
    own = F.lower(F.trim("subject")) == F.lower(F.trim(org))
    return claims.filter((F.col("claim_type") == "state") & F.col("subject").isNotNull() & F.col("predicate").isNotNull()).select(
        F.col("id").alias("ref"),
        org.alias("scope"),
        F.trim("predicate").alias("predicate"),
        F.when(own, F.coalesce("value_text", F.lit(""))).otherwise(F.col("subject")).alias("filler"),
        F.col("document_id").alias("document"),
        "valid_from",
        "valid_to",
        (F.coalesce("valid_to_is_open", F.lit(False)) | F.col("valid_to").isNull()).alias("open"),
        F.col("assertion_time").alias("asserted"),
    )
