"""States over time: rosters, successions, vacancies, closures, cardinality, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import periods
from factloom.operators import intervals
from factloom.plans import claims as records
from factloom.plans import temporal
from factloom.queries import Registry
from factloom.queries.corpus import _CARDINALITY, _HEAD_WORD

QUERIES = Registry()
query = QUERIES.add
AS_OF = "2020-06-30"

HELD = r"""held AS (SELECT id AS ref, CASE WHEN lower(trim(subject)) = lower(trim(org)) THEN coalesce(value_text, '') ELSE subject END AS filler, org AS scope, trim(predicate) AS predicate, document_id AS document,
    valid_from, valid_to, coalesce(valid_to_is_open, false) OR valid_to IS NULL AS open, assertion_time AS asserted, lower(org) AS slot_scope, lower(trim(predicate)) AS slot_predicate,
    valid_from IS NULL AND valid_to IS NULL AS undated, coalesce(valid_from, DATE '0001-01-01') AS s,
    CASE WHEN coalesce(valid_to_is_open, false) OR valid_to IS NULL THEN DATE '9999-12-31' ELSE valid_to END AS e
    FROM (SELECT *, coalesce(nullif(trim(org_scope), ''), subject) AS org FROM claims WHERE claim_type = 'state' AND subject IS NOT NULL AND predicate IS NOT NULL)),
    one AS (SELECT slot_scope, slot_predicate, filler, valid_from, valid_to, open, undated, s, e, min(ref) AS ref, min(asserted) AS asserted FROM held GROUP BY ALL)"""
_SEATS = rf"""seats AS (SELECT slot_scope, slot_predicate, min(inferred) AS inferred, count(DISTINCT filler) AS holders,
    coalesce(bool_or(EXISTS (SELECT 1 FROM held o WHERE o.slot_scope = h.slot_scope AND o.slot_predicate = h.slot_predicate AND o.document = h.document AND o.filler <> h.filler AND o.s <= h.e AND h.s <= o.e)), false) AS several
    FROM (SELECT *, {_CARDINALITY} AS inferred FROM (SELECT *, {_HEAD_WORD} AS w FROM (SELECT *, predicate AS p FROM held))) h GROUP BY 1, 2)"""


@query(
    f"WITH {HELD} SELECT DISTINCT scope, predicate, filler FROM held WHERE (valid_from IS NULL OR valid_from <= DATE '{AS_OF}') AND (open OR valid_to IS NULL OR valid_to >= DATE '{AS_OF}')",
    "claims",
)
def roster_as_of(claims: DataFrame) -> DataFrame:
    """Who held what on one day."""
    return temporal.roster(records.holdings(claims), AS_OF)


@query(
    f"""WITH {HELD}, n AS (SELECT *, lead(s) OVER w AS ns, lead(filler) OVER w AS nf, lead(valid_from) OVER w AS nvf FROM one WHERE NOT undated WINDOW w AS (PARTITION BY slot_scope, slot_predicate ORDER BY s, e, ref))
        SELECT scope, predicate, first, second, gap_days, greatest(0, gap_days - 1) AS vacant_days, CASE WHEN gap_days > 1 THEN 'SUCCESSION_WITH_VACANCY' ELSE 'SUCCESSION' END AS verdict FROM (
        SELECT slot_scope AS scope, slot_predicate AS predicate, filler AS first, nf AS second, date_diff('day', CASE WHEN NOT open THEN valid_to END, nvf)::INT AS gap_days, {_CARDINALITY} AS card
        FROM (SELECT *, {_HEAD_WORD} AS w FROM (SELECT *, slot_predicate AS p FROM n)) WHERE nf <> filler AND ns > e) WHERE card = 1""",
    "claims",
)
def successions(claims: DataFrame) -> DataFrame:
    """Neighbouring holders of a seat for one, and the days for which it stood empty."""
    return temporal.successions(records.holdings(claims))


@query(
    f"WITH {HELD}, {_SEATS} SELECT slot_scope AS scope, slot_predicate AS predicate, inferred, CASE WHEN inferred = 1 AND several THEN 0 ELSE inferred END AS observed, holders FROM seats",
    "claims",
)
def cardinality_observe(claims: DataFrame) -> DataFrame:
    """Seats that one document shows with two holders at a time are for many."""
    return temporal.observed_cardinality(records.holdings(claims))


@query(
    f"""WITH {HELD}, {_SEATS}, numbered AS (SELECT one.*, CASE WHEN inferred = 1 AND several THEN 0 ELSE inferred END AS observed, row_number() OVER (PARTITION BY one.slot_scope, one.slot_predicate ORDER BY undated, s, e, ref) AS at
        FROM one JOIN seats USING (slot_scope, slot_predicate)),
        p AS (SELECT a.filler = b.filler AS same, a.s <= b.e AND b.s <= a.e AS meets, a.undated AS au, b.undated AS bu, a.open AS ao, b.open AS bo, a.valid_from AS af, b.valid_from AS bf, a.valid_to AS at_, b.valid_to AS bt,
            a.asserted AS aa, b.asserted AS ba, a.s AS a_s, b.s AS b_s FROM numbered a JOIN numbered b ON a.slot_scope = b.slot_scope AND a.slot_predicate = b.slot_predicate AND (a.s, a.e, a.ref) < (b.s, b.e, b.ref)
            WHERE a.filler = b.filler OR (a.observed = 1 AND (a.undated <> b.undated OR (a.s <= b.e AND b.s <= a.e) OR (b.at = a.at + 1 AND NOT a.undated AND NOT b.undated)))),
        o AS (SELECT *, CASE WHEN aa IS NOT NULL AND ba IS NOT NULL THEN aa <= ba ELSE ao AND NOT bo END AS ae, date_diff('day', CASE WHEN a_s <= b_s THEN at_ ELSE bt END, CASE WHEN a_s <= b_s THEN bf ELSE af END) AS gap FROM p),
        c AS (SELECT *, CASE WHEN ae THEN ao ELSE bo END AS eo, CASE WHEN ae THEN bo ELSE ao END AS lo, CASE WHEN ae THEN aa ELSE ba END AS ea, CASE WHEN ae THEN bt ELSE at_ END AS lt FROM o),
        v AS (SELECT CASE WHEN same AND eo AND NOT lo AND (ea IS NULL OR lt IS NULL OR lt >= ea) THEN 'CLOSES_INTERVAL' WHEN same AND eo AND NOT lo THEN 'CONTRADICTS'
            WHEN same AND ao AND bo THEN CASE WHEN af IS NOT DISTINCT FROM bf THEN 'CORROBORATES' ELSE 'CONTEXTUAL' END
            WHEN same AND af IS NOT DISTINCT FROM bf AND at_ IS NOT DISTINCT FROM bt THEN 'CORROBORATES' WHEN same AND NOT meets THEN 'CONTINUES' WHEN same THEN 'CONTRADICTS'
            WHEN au AND bu AND aa <> ba THEN 'CONTEXTUAL' WHEN au AND bu THEN 'CONTRADICTS' WHEN au <> bu THEN 'INSUFFICIENT_EVIDENCE' WHEN meets THEN 'CONTRADICTS'
            WHEN gap IS NULL OR gap <= 1 THEN 'SUCCESSION' ELSE 'SUCCESSION_WITH_VACANCY' END AS verdict FROM c)
        SELECT verdict, count(*) AS n FROM v GROUP BY 1""",
    "claims",
)
def temporal_verdicts(claims: DataFrame) -> DataFrame:
    """How often each relation between two holdings of a seat occurs."""
    return temporal.related(records.holdings(claims)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT relation, count(*) AS n FROM (SELECT CASE WHEN period_start IS NULL OR period_end IS NULL OR ns IS NULL OR ne IS NULL THEN 'unknown' WHEN period_start = ns AND period_end = ne THEN 'same'
       WHEN period_start <= ne AND ns <= period_end THEN 'overlapping' ELSE 'disjoint' END AS relation FROM (SELECT period_start, period_end, id, lead(id) OVER w AS ni, lead(period_start) OVER w AS ns, lead(period_end) OVER w AS ne
       FROM claims WHERE claim_type = 'measurement' WINDOW w AS (PARTITION BY document_id, page_no ORDER BY id)) WHERE ni IS NOT NULL) GROUP BY 1""",
    "claims",
)
def period_relations(claims: DataFrame) -> DataFrame:
    """How the periods of a page's consecutive measurements relate."""
    order = Window.partitionBy("document_id", "page_no").orderBy("id")
    rows = claims.filter("claim_type = 'measurement'").select("period_start", "period_end", *[F.lead(c).over(order).alias(n) for c, n in (("id", "ni"), ("period_start", "ns"), ("period_end", "ne"))])
    relation = periods.period_relation(*[F.col(c) for c in ("period_start", "period_end", "ns", "ne")])
    return rows.filter("ni IS NOT NULL").groupBy(relation.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query(None, "claims")
def period_parse(claims: DataFrame) -> DataFrame:
    """Every period as printed, with the interval it is read as on an April calendar."""
    seen = claims.filter("period_raw IS NOT NULL").groupBy("period_raw").agg(F.count(F.lit(1)).alias("claims"))
    return seen.select("period_raw", "claims", periods.parse_period(F.col("period_raw")).alias("p")).select("period_raw", "claims", "p.*")


@query(
    """WITH held AS (SELECT subject, coalesce(org_scope, '') AS org_scope, predicate, CASE WHEN valid_to IS NULL OR coalesce(valid_to_is_open, false) THEN DATE '9999-12-31' ELSE valid_to END AS e, coalesce(valid_from, DATE '0001-01-01') AS s
       FROM claims WHERE claim_type = 'state' AND (valid_from IS NOT NULL OR valid_to IS NOT NULL)), r AS (SELECT *, max(e) OVER (PARTITION BY subject, org_scope, predicate ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM held WHERE e >= s)
       SELECT count(*) AS gaps, sum(date_diff('day', before, s) - 1)::BIGINT AS days FROM r WHERE date_diff('day', before, s) > 1""",
    "claims",
)
def vacancy_days(claims: DataFrame) -> DataFrame:
    """How many gaps there are between the periods of all holders and seats, and their days."""
    gaps = intervals.periods_and_gaps(claims).filter("kind = 'gap'")
    return gaps.agg(F.count(F.lit(1)).alias("gaps"), F.sum(F.date_diff(F.col("ends").cast("date"), F.col("starts").cast("date")) + 1).cast("bigint").alias("days"))
