"""Corpus comparison: blocks, pairs, the comparability gate, and its tallies.

Claims need ``claim_id, document, claim_type, entity, metric, dimension, currency, canonical, precision,
text ARRAY, single, period_start, period_end, valid_from, valid_to, axes MAP, unknown ARRAY`` (``plans.claims``).  A null
entity or metric is never compared.  ``pairs`` lists the pairs of blocks of up to 400 claims, as an
interactive comparison would; ``tallies`` counts the pairs of all blocks, whatever their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import periods, values
from factloom.plans import tally
from factloom.sources.tables import table

MAX_BLOCK = 400
PRIORITY = ["consolidation", "estimate_vintage", "price_base", "pro_forma", "restated", "org_scope", "period", "modality"]
KEY = ["entity", "metric"]


def fixture_measurements(spark: SparkSession, folder: str) -> DataFrame:
    """fx_measurements of FIXTURES 3.1 from the driver tables."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    base = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("entity"), (F.year("o_orderdate") + F.when(F.month("o_orderdate") >= 4, 1).otherwise(0)).alias("fy"))
        .agg(F.sum(cents).alias("gross"), F.sum(cents * (100 - F.round(F.col("l_discount") * 100).cast("bigint"))).alias("net"))
        .withColumn("net", F.expr("net div 100"))
    )
    million, tenth, crore = "((x + 500000) div 1000000) / 100e0", "((x + 5000000) div 10000000) / 10e0", "((x + 500000000) div 1000000000) * 1e0"
    printed = [
        ("ar", "gross", million.replace("x", "gross"), 2, 1e6, "'gross'"),
        ("ar", "net", million.replace("x", "net"), 2, 1e6, "'net'"),
        ("deck", "gross", crore.replace("x", "gross"), 0, 1e7, "CASE WHEN fy % 2 = 0 THEN 'gross' END"),
        ("press", "gross", tenth.replace("x", "gross") + " + CASE WHEN fy % 3 = 0 THEN 0.1e0 ELSE 0e0 END", 1, 1e6, "'gross'"),
    ]
    rows = F.explode(F.array(*[
        F.struct(F.lit(doc).alias("document"), F.lit(n).alias("n"), F.expr(value).alias("value"), F.lit(places).alias("places"), F.lit(scale).alias("scale"), F.expr(f"CAST({basis} AS STRING)").alias("basis"))
        for n, (doc, _, value, places, scale, basis) in enumerate(printed)
    ]))
    return base.select("entity", "fy", rows.alias("r")).select(
        F.concat_ws("|", "entity", F.lpad(F.col("fy").cast("string"), 4, "0"), "r.n").alias("claim_id"),
        "r.document",
        "entity",
        F.lit("revenue").alias("metric"),
        F.lit("measurement").alias("claim_type"),
        F.array().cast("array<string>").alias("text"),
        F.lit(True).alias("single"),
        F.lit(None).cast("date").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
        F.lit("currency").alias("dimension"),
        F.lit("INR").alias("currency"),
        (F.col("r.value") * F.col("r.scale")).alias("canonical"),
        (F.element_at(F.array(F.lit(1.0), F.lit(0.1), F.lit(0.01)), F.col("r.places") + 1) * F.col("r.scale")).alias("precision"),
        F.make_date(F.col("fy") - 1, F.lit(4), F.lit(1)).alias("period_start"),
        F.make_date(F.col("fy"), F.lit(3), F.lit(31)).alias("period_end"),
        F.expr("map_filter(map('basis', r.basis, 'modality', 'actual'), (k, v) -> v IS NOT NULL)").alias("axes"),
        F.when(F.col("r.basis").isNull(), F.array(F.lit("basis"))).otherwise(F.array().cast("array<string>")).alias("unknown"),
    )


def _sizes(claims: DataFrame) -> DataFrame:
    return claims.dropna(subset=KEY).groupBy(*KEY).agg(F.count(F.lit(1)).alias("claims"))


def oversized(claims: DataFrame) -> DataFrame:
    """The blocks that are declined, with their sizes."""
    return _sizes(claims).filter(F.col("claims") > MAX_BLOCK)


def _primary(axes: Column) -> Column:
    place = F.create_map(*[x for i, a in enumerate(PRIORITY) for x in (F.lit(a), F.lit(i))])
    return F.try_element_at(F.array_sort(F.transform(axes, lambda a: F.struct(F.coalesce(F.try_element_at(place, a), F.lit(len(PRIORITY))).alias("p"), a.alias("a")))), F.lit(1))["a"]


def judged(both: DataFrame, mask: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``gate``, a STRUCT(verdict, axis), to rows of two claims aliased a and b: the first branch that applies.

    Masked axes count as if neither side stated or missed them.  Where everything up to the values is
    the same the verdict is VALUE: it depends on whether the values agree.
    """
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    masked = F.array(*[F.lit(m) for m in mask]).cast("array<string>")
    axes = lambda x: F.map_filter(x("axes"), lambda k, v: ~F.array_contains(masked, k)) if mask else x("axes")
    unknown = lambda x: F.array_except(x("unknown"), masked) if mask else x("unknown")
    missing = F.array_union(F.array_intersect(unknown(a), F.map_keys(axes(b))), F.array_intersect(unknown(b), F.map_keys(axes(a))))
    both = both.withColumn("g_missing", _primary(missing))
    state = a("claim_type") == "state"
    both = _with_context(both, mask, axes)

    def says(verdict: str, axis: Column | str | None) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), (F.lit(axis).cast("string") if axis is None or isinstance(axis, str) else axis).alias("axis"))

    measured = F.lit("unit" not in mask) & (a("claim_type") == "measurement")
    currency = (a("dimension") == "currency") & (b("dimension") == "currency")
    unknown_unit = a("dimension").isNull() | b("dimension").isNull() | (currency & (a("currency").isNull() | b("currency").isNull()))
    relation, text = F.col("g_relation"), F.col("g_text")
    open_period = state & (relation == "unknown")
    branches = [
        (~a("entity").eqNullSafe(b("entity")), says("INCOMPARABLE", "entity")),
        (~a("metric").eqNullSafe(b("metric")), says("INCOMPARABLE", "metric")),
        (measured & unknown_unit, says("INSUFFICIENT_EVIDENCE", "unit")),
        (measured & (a("dimension") != b("dimension")), says("INCOMPARABLE", "unit")),
        (measured & currency & (a("currency") != b("currency")), says("INCOMPARABLE", "currency")),
        (F.col("g_missing").isNotNull(), says("INSUFFICIENT_EVIDENCE", F.col("g_missing"))),
        (open_period & F.col("g_apart"), says("CONTEXTUAL_TEMPORAL", "valid_time")),
        (~open_period & (relation == "unknown"), says("INSUFFICIENT_EVIDENCE", "period")),
        (relation == "disjoint", says("CONTEXTUAL_TEMPORAL", "period")),
        (relation == "overlapping", says("CONTEXTUAL", "period")),
        (F.col("g_differing").isNotNull(), says("CONTEXTUAL", F.col("g_differing"))),
        (state & ~a("single") & (text != "agree"), says("INCOMPARABLE", "cardinality")),
        (state & (text == "unknown"), says("INSUFFICIENT_EVIDENCE", "value")),
        (state & (text == "agree"), says("CORROBORATES", None)),
        (state, says("CONTRADICTS", None)),
    ]
    chain = F.when(*branches[0])
    for when, then in branches[1:]:
        chain = chain.when(when, then)
    return both.withColumn("gate", chain.otherwise(says("VALUE", None)))


def _with_context(both: DataFrame, mask: tuple[str, ...], axes) -> DataFrame:
    """Columns that the later branches look at: the differing axis, the periods' relation, states' dates and texts."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    differing = F.map_keys(F.map_filter(F.map_zip_with(axes(a), axes(b), lambda k, x, y: ~x.eqNullSafe(y)), lambda k, v: v))
    relation = F.lit("same") if "period" in mask else periods.period_relation(a("period_start"), a("period_end"), b("period_start"), b("period_end"))
    state = a("claim_type") == "state"
    dated = lambda x: x("valid_from").isNotNull() | x("valid_to").isNotNull()
    ends = lambda x: F.coalesce(x("valid_to"), F.lit("9999-12-31").cast("date"))
    starts = lambda x: F.coalesce(x("valid_from"), F.lit("0001-01-01").cast("date"))
    apart = dated(a) & dated(b) & ((starts(a) >= ends(b)) | (starts(b) >= ends(a)))
    same_text = values.relation(values.texts_agree(a("text"), b("text")))
    return both.withColumns(
        {"g_differing": _primary(differing), "g_relation": relation, "g_apart": F.when(state, apart), "g_text": F.when(state, F.coalesce(same_text, F.lit("unknown")))}
    )


def _settled(verdict: Column, near: Column) -> Column:
    """A verdict with the values: unknown, agreeing or not."""
    return F.when(verdict != "VALUE", verdict).when(near.isNull(), "INSUFFICIENT_EVIDENCE").when(near, "CORROBORATES").otherwise("CONTRADICTS")


def pairs(claims: DataFrame, mask: tuple[str, ...] = (), most: int = MAX_BLOCK) -> DataFrame:
    """(claim_a, claim_b, metric, verdict, axis, values_differ, relative, cross_document) of every pair in a block of at most ``most`` claims."""
    kept = claims.join(_sizes(claims).filter(F.col("claims").between(2, most)).select(*KEY), KEY, "left_semi")
    both = kept.withColumn("block_entity", F.col("entity")).withColumn("block_metric", F.col("metric"))
    block = ["block_entity", "block_metric"]
    joined = judged(both.alias("a").join(both.alias("b"), block).filter("a.claim_id < b.claim_id"), mask)
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    near = values.agree(a("canonical"), b("canonical"), a("precision"), b("precision"))
    return (
        joined.select(
            a("claim_id").alias("claim_a"), b("claim_id").alias("claim_b"), a("metric").alias("metric"), "gate", near.alias("near"), values.relative(a("canonical"), b("canonical")).alias("relative"), (~a("document").eqNullSafe(b("document"))).alias("cross_document")
        )
        .select(
            "claim_a",
            "claim_b",
            "metric",
            _settled(F.col("gate.verdict"), F.col("near")).alias("verdict"),
            F.when((F.col("gate.verdict") == "VALUE") & F.col("near").isNull(), "value").otherwise(F.col("gate.axis")).alias("axis"),
            F.coalesce(~F.col("near"), F.lit(False)).alias("values_differ"),
            "relative",
            "cross_document",
        )
    )


def tallies(claims: DataFrame, mask: tuple[str, ...] = (), small: int = tally.SMALL) -> DataFrame:
    """(verdict, axis, pairs, differing): how many pairs of all blocks get each verdict, and with values that differ.

    No block is declined and no pair is stored: the claims are brought together by block once, and
    each block is counted as array work where it lies (``plans.tally``), pair by pair up to ``small`` claims.
    """
    context = F.to_json(F.struct("claim_type", "dimension", "currency", "axes", "unknown")).alias("context")
    dates = [F.unix_date(c).alias(c) for c in ("period_start", "period_end", "valid_from", "valid_to")]
    # rows without a key are left out in the arrays: a filter here would compute the keys twice
    rows = claims.select(*KEY, "claim_id", context, *dates, F.array_join("text", " ").alias("text"), "single", "canonical", "precision")
    counted = rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(lambda batches: tally.of_partition(batches, mask, PRIORITY, small), tally.SCHEMA)
    return counted.groupBy("verdict", "axis").agg(F.sum("pairs").alias("pairs"), F.sum("differing").alias("differing"))


def corpus_reduction(claims: DataFrame) -> DataFrame:
    """One row for all claims: how many apparent disagreements a named axis explains."""
    verdict = F.col("verdict")
    some = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    open_ones = verdict.isin("CONTRADICTS", "INSUFFICIENT_EVIDENCE")
    one = tallies(claims).agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum("differing"), F.lit(0)).alias("raw_disagreements"),
        some("differing", ~open_ones).alias("explained"),
        some("differing", verdict == "INSUFFICIENT_EVIDENCE").alias("blocked"),
        some("differing", verdict == "CONTRADICTS").alias("unresolved"),
    )
    share = F.when(F.col("raw_disagreements") > 0, F.round(F.col("explained") / F.col("raw_disagreements"), 6)).otherwise(0.0)
    return one.withColumn("reduction", share)


def reduction(compared: DataFrame) -> DataFrame:
    """One row: how many apparent disagreements a named axis explains."""
    differ, verdict = F.col("values_differ"), F.col("verdict")
    tally = compared.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(differ).alias("raw_disagreements"),
        F.count_if(differ & ~verdict.isin("CONTRADICTS", "INSUFFICIENT_EVIDENCE")).alias("explained"),
        F.count_if(differ & (verdict == "INSUFFICIENT_EVIDENCE")).alias("blocked"),
        F.count_if(differ & (verdict == "CONTRADICTS")).alias("unresolved"),
        F.count_if("cross_document").alias("cross_document"),
    )
    share = F.when(F.col("raw_disagreements") > 0, F.round(F.col("explained") / F.col("raw_disagreements"), 6)).otherwise(0.0)
    return tally.withColumn("reduction", share)


def verdict_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def axis_counts(compared: DataFrame) -> DataFrame:
    return compared.filter("axis IS NOT NULL").groupBy("axis").agg(F.count(F.lit(1)).alias("n"))
