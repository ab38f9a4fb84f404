"""Registers that comparisons leave behind: axes, newest relations, learned aliases and merged entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: axes that are established from the start; a discovered one is after so many pairs ----
SEED_AXES = ["consolidation", "estimate_vintage", "price_base", "pro_forma", "restated", "org_scope", "period", "modality", "unit", "currency", "valid_time"]
PROMOTED_AFTER = 2
# ---- end of fixed values ----


def axes(pairs: DataFrame) -> DataFrame:
    """(axis, occurrences, resolves, first_claim, origin, status) of the axes that verdicts name."""
    settles = F.col("values_differ") & F.col("verdict").startswith("CONTEXTUAL")
    seen = pairs.filter("axis IS NOT NULL").groupBy("axis").agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(settles).alias("resolves"), F.min("claim_a").alias("first_claim"))
    seed = F.col("axis").isin(*SEED_AXES)
    status = F.when(seed, "active").when(F.col("resolves") >= PROMOTED_AFTER, "promoted").otherwise("candidate")
    return seen.withColumn("origin", F.when(seed, "seed").otherwise("discovered")).withColumn("status", status)


def newest(relations: DataFrame) -> DataFrame:
    """One row per pair of claims, in either order: that of the newest generation."""
    pair = [F.least("claim_a", "claim_b").alias("claim_a"), F.greatest("claim_a", "claim_b").alias("claim_b")]
    rest = [c for c in relations.columns if c not in ("claim_a", "claim_b", "generation")]
    best = relations.select(*pair, "generation", *rest).groupBy("claim_a", "claim_b").agg(F.max(F.struct("generation", *rest)).alias("x"))
    return best.select("claim_a", "claim_b", "x.*")


def learn(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """What is known plus what is seen for the first time, the first of several by the other columns' order."""
    rest = [c for c in known.columns if c != key]
    new = seen.select(*known.columns).join(known.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*rest)).alias("x")).select(key, "x.*")
    return known.unionByName(new)


def merge_entities(rows: DataFrame, redirects: DataFrame, column: str = "entity_id") -> DataFrame:
    """Rows with absorbed entities replaced by those that keep their place; redirects: (absorbed, kept)."""
    to = redirects.select(F.col("absorbed").alias(column), F.col("kept"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("kept", column)).drop("kept")
