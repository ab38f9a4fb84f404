"""Claims against claims: the gate's verdicts over whole blocks, masks, feeds, and the published fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import dense
from factloom.plans import claims as records
from factloom.plans import registry, relate
from factloom.queries import Registry
from factloom.queries.corpus import _CARDINALITY, _HEAD_WORD, _NAME_KEY, _PRECISION, _PREDICATE_KEY

QUERIES = Registry()
query = QUERIES.add

_PRIORITY = "['consolidation', 'estimate_vintage', 'price_base', 'pro_forma', 'restated', 'org_scope', 'period', 'modality']"
_PRIMARY = "list_sort(list_transform({}, lambda x: {{'p': coalesce(list_position(" + _PRIORITY + ", x), 99), 'a': x}}))[1].a"


def pairs_sql(mask: tuple[str, ...] = ()) -> str:
    """Every pair of claims in a block, judged one by one."""
    off = "[" + ", ".join(f"'{m}'" for m in mask) + "]::VARCHAR[]"
    period = "'same'" if "period" in mask else (
        "CASE WHEN a.ps IS NULL OR a.pe IS NULL OR b.ps IS NULL OR b.pe IS NULL THEN 'unknown' WHEN a.ps = b.ps AND a.pe = b.pe THEN 'same' WHEN a.ps <= b.pe AND b.ps <= a.pe THEN 'overlapping' ELSE 'disjoint' END"
    )
    unit = "false" if "unit" in mask else "a.claim_type = 'measurement'"
    return rf"""WITH base AS (SELECT *, regexp_extract(trim(value_raw), '([.,][0-9]+)\s*%?\s*\)?\s*$', 1) AS t, CASE WHEN coalesce(unit_scale, 0) = 0 THEN 1.0::DOUBLE ELSE unit_scale END AS s, claim_type = 'measurement' AS ms FROM claims),
        shaped AS (SELECT *, {_HEAD_WORD} AS w FROM (SELECT *, predicate AS p FROM base)),
        c AS (SELECT id, document_id AS doc, claim_type, nullif({_NAME_KEY.format('subject')}, '') AS entity, nullif({_PREDICATE_KEY.format('predicate')}, '') AS metric, unit_dimension AS dim, unit_currency AS cur,
            CASE WHEN ms THEN value_num * s END AS v, CASE WHEN ms THEN {_PRECISION} END AS prec, period_start AS ps, period_end AS pe, valid_from AS vf, valid_to AS vt, ms OR {_CARDINALITY} = 1 AS single,
            map_from_entries(list_filter(list_concat(list_filter(coalesce(map_entries(qualifiers), []), lambda e: e.key <> 'modality' AND e.value IS NOT NULL), [{{'key': 'modality', 'value': nullif(modality, '')}}]), lambda e: e.value IS NOT NULL AND NOT list_contains({off}, e.key))) AS axes,
            list_filter(coalesce(unknown_qualifiers, []), lambda x: NOT list_contains({off}, x)) AS unk0,
            CASE WHEN ms THEN []::VARCHAR[] ELSE regexp_extract_all(replace(lower(coalesce(value_text, '')), '&', ' and '), '([a-z0-9]+)', 1) END AS txt FROM shaped),
        d AS (SELECT *, list_filter(unk0, lambda x: NOT list_contains(map_keys(axes), x)) AS unk FROM c WHERE entity IS NOT NULL AND metric IS NOT NULL),
        j AS (SELECT a.id AS ia, b.id AS ib, a.doc <> b.doc AS cross_document, a.entity AS entity, a.claim_type = 'state' AS st, {unit} AS ms, a.dim AS da, b.dim AS db, a.cur AS ca, b.cur AS cb, a.metric AS metric, a.single AS single, a.txt AS ta, b.txt AS tb,
            list_distinct(list_concat(list_intersect(a.unk, map_keys(b.axes)), list_intersect(b.unk, map_keys(a.axes)))) AS missing,
            list_filter(list_distinct(list_concat(map_keys(a.axes), map_keys(b.axes))), lambda k: a.axes[k] IS DISTINCT FROM b.axes[k]) AS differing,
            {period} AS rel, (a.vf IS NOT NULL OR a.vt IS NOT NULL) AND (b.vf IS NOT NULL OR b.vt IS NOT NULL) AND (coalesce(a.vf, DATE '0001-01-01') >= coalesce(b.vt, DATE '9999-12-31') OR coalesce(b.vf, DATE '0001-01-01') >= coalesce(a.vt, DATE '9999-12-31')) AS apart,
            abs(a.v - b.v) AS gap, greatest(abs(a.v), abs(b.v)) AS largest, CASE WHEN a.prec IS NULL AND b.prec IS NULL THEN abs(a.v - b.v) = 0 ELSE abs(a.v - b.v) < (coalesce(a.prec, 0) + coalesce(b.prec, 0)) / 2 * (1 - 1e-9::DOUBLE) END AS near
            FROM d a JOIN d b ON a.entity = b.entity AND a.metric = b.metric AND a.id < b.id),
        g AS (SELECT *, CASE WHEN ms AND (da IS NULL OR db IS NULL OR (da = 'currency' AND db = 'currency' AND (ca IS NULL OR cb IS NULL))) THEN 'INSUFFICIENT_EVIDENCE:unit' WHEN ms AND da <> db THEN 'INCOMPARABLE:unit'
            WHEN ms AND da = 'currency' AND ca <> cb THEN 'INCOMPARABLE:currency' WHEN len(missing) > 0 THEN 'INSUFFICIENT_EVIDENCE:' || {_PRIMARY.format('missing')}
            WHEN st AND rel = 'unknown' AND apart THEN 'CONTEXTUAL_TEMPORAL:valid_time' WHEN NOT st AND rel = 'unknown' THEN 'INSUFFICIENT_EVIDENCE:period' WHEN rel = 'disjoint' THEN 'CONTEXTUAL_TEMPORAL:period' WHEN rel = 'overlapping' THEN 'CONTEXTUAL:period'
            WHEN len(differing) > 0 THEN 'CONTEXTUAL:' || {_PRIMARY.format('differing')} WHEN st AND NOT single AND (len(ta) = 0 OR ta <> tb) THEN 'INCOMPARABLE:cardinality' WHEN st AND (len(ta) = 0 OR len(tb) = 0) THEN 'INSUFFICIENT_EVIDENCE:value'
            WHEN st AND ta = tb THEN 'CORROBORATES:' WHEN st THEN 'CONTRADICTS:' WHEN near IS NULL THEN 'INSUFFICIENT_EVIDENCE:value' WHEN near THEN 'CORROBORATES:' ELSE 'CONTRADICTS:' END AS va FROM j),
        related AS (SELECT ia, ib, entity, metric, cross_document, gap, largest, split_part(va, ':', 1) AS verdict, nullif(split_part(va, ':', 2), '') AS axis, coalesce(NOT near, false) AS values_differ FROM g)"""


_TALLY = " SELECT verdict, axis, count(*) AS pairs, count_if(values_differ) AS differing FROM related GROUP BY 1, 2"


@query(
    pairs_sql()
    + """ SELECT count(*) AS pairs, count_if(values_differ) AS raw_disagreements, count_if(values_differ AND verdict NOT IN ('CONTRADICTS', 'INSUFFICIENT_EVIDENCE')) AS explained,
        count_if(values_differ AND verdict = 'INSUFFICIENT_EVIDENCE') AS blocked, count_if(values_differ AND verdict = 'CONTRADICTS') AS unresolved, round(explained / raw_disagreements, 6) AS reduction FROM related""",
    "claims",
)
def claims_reduction(claims: DataFrame) -> DataFrame:
    """How many apparent disagreements between all claims a named axis explains."""
    return relate.corpus_reduction(records.comparables(claims))


@query(pairs_sql() + _TALLY, "claims")
def claims_verdicts(claims: DataFrame) -> DataFrame:
    """Pairs of claims by verdict and axis."""
    return relate.tallies(records.comparables(claims))


@query(pairs_sql(("period",)) + _TALLY, "claims")
def gate_masked_period(claims: DataFrame) -> DataFrame:
    """The verdicts as if all claims were of one period."""
    return relate.tallies(records.comparables(claims), ("period",))


@query(pairs_sql(("unit",)) + _TALLY, "claims")
def gate_masked_unit(claims: DataFrame) -> DataFrame:
    """The verdicts as if all measurements had one unit."""
    return relate.tallies(records.comparables(claims), ("unit",))


@query(pairs_sql(("consolidation", "modality")) + _TALLY, "claims")
def gate_masked_axes(claims: DataFrame) -> DataFrame:
    """The verdicts without consolidation and modality."""
    return relate.tallies(records.comparables(claims), ("consolidation", "modality"))


@query(
    pairs_sql() + ", sized AS (SELECT entity, metric, count(*) AS n FROM d GROUP BY 1, 2) SELECT entity, metric, n, CASE WHEN n = 1 THEN 'single' WHEN n <= 400 THEN 'compared' ELSE 'oversized' END AS status FROM sized",
    "claims",
)
def block_sizes(claims: DataFrame) -> DataFrame:
    """Claims in each block, and whether an interactive comparison would list its pairs."""
    rows = dense.key_counts(records.comparables(claims).dropna(subset=relate.KEY), relate.KEY)
    status = F.when(F.col("n") == 1, "single").when(F.col("n") <= relate.MAX_BLOCK, "compared").otherwise("oversized")
    return rows.withColumn("status", status)


_LISTED = pairs_sql() + ", sized AS (SELECT entity, metric FROM d GROUP BY 1, 2 HAVING count(*) <= 400), listed AS (SELECT related.* FROM related JOIN sized USING (entity, metric))"


@query(
    _LISTED + " SELECT ia AS claim_a, ib AS claim_b, round(gap / largest, 9) AS relative FROM listed WHERE verdict = 'CONTRADICTS' ORDER BY gap / largest DESC NULLS LAST, ia, ib LIMIT 20",
    "claims",
)
def conflicts_topk(claims: DataFrame) -> DataFrame:
    """The twenty widest contradictions; the limit is the report's."""
    rows = relate.pairs(records.comparables(claims)).filter("verdict = 'CONTRADICTS'")
    return rows.orderBy(F.desc_nulls_last("relative"), "claim_a", "claim_b").limit(20).select("claim_a", "claim_b", F.round("relative", 9).alias("relative"))


_RANK = "CASE verdict WHEN 'CONTRADICTS' THEN 0 WHEN 'CONTEXTUAL' THEN 1 WHEN 'CONTEXTUAL_TEMPORAL' THEN 2 WHEN 'CORROBORATES' THEN 3 WHEN 'INSUFFICIENT_EVIDENCE' THEN 4 ELSE 5 END"


@query(
    _LISTED
    + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY {_RANK}, cross_document DESC, gap / largest DESC NULLS LAST, ia, ib) AS in_metric FROM listed)
        SELECT ia AS claim_a, ib AS claim_b, verdict FROM ranked ORDER BY in_metric > 3, {_RANK}, cross_document DESC, gap / largest DESC NULLS LAST, ia, ib LIMIT 60""",
    "claims",
)
def pairs_feed_top60(claims: DataFrame) -> DataFrame:
    """The sixty most telling pairs, at most three of a metric before others' turn; the limit is the screen's."""
    rows = relate.pairs(records.comparables(claims)).withColumn("interest", F.expr(_RANK))
    order = ["interest", F.desc("cross_document"), F.desc_nulls_last("relative"), "claim_a", "claim_b"]
    ranked = rows.withColumn("in_metric", F.row_number().over(Window.partitionBy("metric").orderBy(*order)))
    return ranked.orderBy(F.col("in_metric") > 3, *order).limit(60).select("claim_a", "claim_b", "verdict")


@query(
    _LISTED
    + """ SELECT axis, count(*) AS occurrences, count_if(values_differ AND verdict LIKE 'CONTEXTUAL%') AS resolves, min(ia) AS first_claim,
        CASE WHEN axis IN ('consolidation', 'estimate_vintage', 'price_base', 'pro_forma', 'restated', 'org_scope', 'period', 'modality', 'unit', 'currency', 'valid_time') THEN 'seed' ELSE 'discovered' END AS origin,
        CASE WHEN axis IN ('consolidation', 'estimate_vintage', 'price_base', 'pro_forma', 'restated', 'org_scope', 'period', 'modality', 'unit', 'currency', 'valid_time') THEN 'active' WHEN count_if(values_differ AND verdict LIKE 'CONTEXTUAL%') >= 2 THEN 'promoted' ELSE 'candidate' END AS status
        FROM listed WHERE axis IS NOT NULL GROUP BY 1""",
    "claims",
)
def axis_registry(claims: DataFrame) -> DataFrame:
    """Every axis named in a verdict, how often it occurs and settles a disagreement, and whether it is established."""
    return registry.axes(relate.pairs(records.comparables(claims)))


@query(
    _LISTED
    + """, gens AS (SELECT ia, ib, verdict, 1 + (ia + ib) % 3 AS generation FROM listed UNION ALL SELECT ia, ib, verdict, 1 AS generation FROM listed)
        SELECT ia AS claim_a, ib AS claim_b, max(generation)::BIGINT AS generation FROM gens GROUP BY 1, 2""",
    "claims",
)
def newest_generation(claims: DataFrame) -> DataFrame:
    """Of relations recorded in several runs, those of the newest."""
    rows = relate.pairs(records.comparables(claims)).select("claim_a", "claim_b", "verdict")
    runs = rows.withColumn("generation", 1 + (F.col("claim_a") + F.col("claim_b")) % 3).unionByName(rows.withColumn("generation", F.lit(1).cast("bigint")))
    return registry.newest(runs).select("claim_a", "claim_b", "generation")
