"""Who held a seat when: neighbours, successions, vacancies, closures and rosters over holdings.

A slot is an organisation's seat, by scope and predicate in lower case.  In a slot that admits one
holder these pairs are related: the same holder, one dated and one undated holding, overlapping ones,
and neighbours in order of their starts.  In a slot for many only the same holder's holdings are.
Pairs of equal holdings are found by equi-joins on the slot and, for overlaps, on years that both
intervals cover, so that a seat with very many holdings isn't compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import texts

SLOT = ["slot_scope", "slot_predicate"]
#: days between an end and the next start that are no vacancy
CONTIGUOUS = 1


def _from(c: str = "valid_from") -> Column:
    return F.coalesce(F.col(c), F.lit("0001-01-01").cast("date"))


def _to(c: str = "valid_to") -> Column:
    return F.coalesce(F.col(c), F.lit("9999-12-31").cast("date"))


def slotted(holdings: DataFrame) -> DataFrame:
    """Holdings with their slot, whether they are undated, and closed ends where an interval is open."""
    return holdings.select(
        F.lower("scope").alias("slot_scope"),
        F.lower("predicate").alias("slot_predicate"),
        "*",
        (F.col("valid_from").isNull() & F.col("valid_to").isNull()).alias("undated"),
        _from().alias("s"),
        F.when(F.col("open"), F.lit("9999-12-31").cast("date")).otherwise(_to()).alias("e"),
    )


def roster(holdings: DataFrame, day: str) -> DataFrame:
    """(scope, predicate, filler) of what held on a day; a missing start or end doesn't exclude it."""
    on = F.lit(day).cast("date")
    ended = ~F.col("open") & F.col("valid_to").isNotNull() & (F.col("valid_to") < on)
    return holdings.filter(((F.col("valid_from") <= on) | F.col("valid_from").isNull()) & ~ended).select("scope", "predicate", "filler").distinct()


def _distinct(holdings: DataFrame) -> DataFrame:
    """Equal assertions as one, with how many there are: repeats of a claim say nothing new about a seat."""
    keys = [*SLOT, "filler", "valid_from", "valid_to", "open", "undated", "s", "e"]
    return slotted(holdings).groupBy(*keys).agg(F.min("ref").alias("ref"), F.min("asserted").alias("asserted"), F.min("document").alias("document"), F.count(F.lit(1)).alias("claims"))


def neighbours(holdings: DataFrame) -> DataFrame:
    """Consecutive dated holdings of a slot in order of start, end and number; the days between them.

    ``gap_days`` is the difference of the dates, ``vacant_days`` the days in between, null where the
    first has no end or the second no start.
    """
    order = Window.partitionBy(*SLOT).orderBy("s", "e", "ref")
    rows = _distinct(holdings).filter(~F.col("undated"))
    after = lambda c: F.lead(c).over(order)
    pairs = rows.select(*SLOT, "ref", "filler", "valid_from", "valid_to", "open", "s", "e", *[after(c).alias(f"next_{c}") for c in ("ref", "filler", "valid_from", "valid_to", "s", "e")])
    gap = F.date_diff(F.col("next_valid_from"), F.when(~F.col("open"), F.col("valid_to")))
    return pairs.filter("next_ref IS NOT NULL").withColumn("gap_days", gap).withColumn("vacant_days", F.greatest(F.lit(0), gap - 1))


def successions(holdings: DataFrame) -> DataFrame:
    """(scope, predicate, first, second, gap_days, vacant_days, verdict) of disjoint neighbours with different holders in seats for one."""
    rows = neighbours(holdings).filter((F.col("filler") != F.col("next_filler")) & (F.col("next_s") > F.col("e")) & (texts.cardinality(F.col("slot_predicate")) == 1))
    verdict = F.when(F.col("gap_days") > CONTIGUOUS, "SUCCESSION_WITH_VACANCY").otherwise("SUCCESSION")
    return rows.select(
        F.col("slot_scope").alias("scope"), F.col("slot_predicate").alias("predicate"), F.col("filler").alias("first"), F.col("next_filler").alias("second"), "gap_days", "vacant_days", verdict.alias("verdict")
    )


def observed_cardinality(holdings: DataFrame) -> DataFrame:
    """(scope, predicate, inferred, observed, holders): a seat for one of which one document shows two holders at a time is for many.

    No pairs are formed: the first holding, in order of starts, that overlaps an earlier one of
    another holder also overlaps the earlier one that ends last.  Were that its own holder's, it and
    the other's would have overlapped before.
    """
    rows = slotted(holdings).withColumn("inferred", texts.cardinality(F.col("predicate")))
    before = Window.partitionBy(*SLOT, "document").orderBy("s", "e", "ref").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.struct("e", "filler")).over(before)
    rows = rows.withColumn("latest", latest).withColumn("clash", (F.col("latest.filler") != F.col("filler")) & (F.col("latest.e") >= F.col("s")))
    found = rows.groupBy(*SLOT).agg(F.min("inferred").alias("inferred"), F.bool_or(F.coalesce("clash", F.lit(False))).alias("several"), F.count_distinct("filler").alias("holders"))
    observed = F.when((F.col("inferred") == 1) & F.col("several"), 0).otherwise(F.col("inferred"))
    return found.select(F.col("slot_scope").alias("scope"), F.col("slot_predicate").alias("predicate"), "inferred", observed.alias("observed"), "holders")


def _pair_verdict() -> Column:
    """STRUCT(verdict, axis, gap_days) of two holdings a and b of one slot for one holder."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    same = a("filler") == b("filler")
    overlap = (a("s") <= b("e")) & (b("s") <= a("e"))

    def says(verdict: str, axis: str | None = "valid_time", gap: Column | None = None) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), F.lit(axis).alias("axis"), (F.lit(None) if gap is None else gap).cast("int").alias("gap_days"))

    both_asserted = a("asserted").isNotNull() & b("asserted").isNotNull()
    a_earlier = F.when(both_asserted, a("asserted") <= b("asserted")).otherwise(a("open") & ~b("open"))
    earlier, later = (lambda c: F.when(a_earlier, a(c)).otherwise(b(c))), (lambda c: F.when(a_earlier, b(c)).otherwise(a(c)))
    closes = earlier("open") & ~later("open")
    after = earlier("asserted").isNull() | later("valid_to").isNull() | (later("valid_to") >= earlier("asserted"))
    a_first = _from("a.valid_from") <= _from("b.valid_from")
    first_to = F.when(a_first, a("valid_to")).otherwise(b("valid_to"))
    second_from = F.when(a_first, b("valid_from")).otherwise(a("valid_from"))
    gap = F.date_diff(second_from, first_to)
    of_one = (
        F.when(closes & after, says("CLOSES_INTERVAL"))
        .when(closes, says("CONTRADICTS"))
        .when(a("open") & b("open") & a("valid_from").eqNullSafe(b("valid_from")), says("CORROBORATES", None))
        .when(a("open") & b("open"), says("CONTEXTUAL"))
        .when(a("valid_from").eqNullSafe(b("valid_from")) & a("valid_to").eqNullSafe(b("valid_to")), says("CORROBORATES", None))
        .when(~overlap, says("CONTINUES", gap=gap))
        .otherwise(says("CONTRADICTS"))
    )
    return (
        F.when(same, of_one)
        .when(a("undated") & b("undated") & both_asserted & (a("asserted") != b("asserted")), says("CONTEXTUAL"))
        .when(a("undated") & b("undated"), says("CONTRADICTS"))
        .when(a("undated") != b("undated"), says("INSUFFICIENT_EVIDENCE"))
        .when(overlap, says("CONTRADICTS"))
        .when(gap.isNull() | (gap <= CONTIGUOUS), says("SUCCESSION", gap=gap))
        .otherwise(says("SUCCESSION_WITH_VACANCY", gap=gap))
    )


def related(holdings: DataFrame) -> DataFrame:
    """(scope, predicate, ref_a, ref_b, verdict, axis, gap_days, vacant_days) of every pair of distinct assertions that says something."""
    order = Window.partitionBy(*SLOT).orderBy("undated", "s", "e", "ref")
    rows = _distinct(holdings).withColumn("at", F.row_number().over(order))
    seats = observed_cardinality(holdings).select(F.col("scope").alias("slot_scope"), F.col("predicate").alias("slot_predicate"), "observed")
    rows = rows.join(seats, SLOT)
    same = F.col("a.filler") == F.col("b.filler")
    meets = (F.col("a.s") <= F.col("b.e")) & (F.col("b.s") <= F.col("a.e"))
    next_to = (F.col("b.at") == F.col("a.at") + 1) & ~F.col("a.undated") & ~F.col("b.undated")
    wanted = same | ((F.col("a.observed") == 1) & ((F.col("a.undated") != F.col("b.undated")) | meets | next_to))
    pairs = rows.alias("a").join(rows.alias("b"), SLOT).filter((F.struct("a.s", "a.e", "a.ref") < F.struct("b.s", "b.e", "b.ref")) & wanted)
    pairs = pairs.select(*SLOT, F.col("a.ref").alias("ref_a"), F.col("b.ref").alias("ref_b"), _pair_verdict().alias("v"))
    return pairs.select(
        F.col("slot_scope").alias("scope"), F.col("slot_predicate").alias("predicate"), "ref_a", "ref_b", "v.verdict", "v.axis", "v.gap_days", F.greatest(F.lit(0), F.col("v.gap_days") - 1).alias("vacant_days")
    )
