"""Views over the corpus: facts, documents, registries, quarantine, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import texts, values
from factloom.queries import Registry

QUERIES = Registry()
query = QUERIES.add

# ---- fixed values: confidence bands, placeholders, display tokens of units ----
BANDS = [("0.90 and above", 0.90), ("0.75 to 0.90", 0.75), ("0.60 to 0.75", 0.60), ("below 0.60", -1.0)]
PLACEHOLDERS = ["unknown", "unclear", "n/a", "na", "none", "null", "not available", "not applicable", "tbd", "xx", ""]
SCALE_LETTERS = {1e3: "K", 1e5: "L", 1e6: "M", 1e7: "CR", 1e9: "B", 1e12: "T"}
# ---- end of fixed values ----


def confidence(extraction: Column, grounding: Column) -> Column:
    """The weakest stage decides; a missing one counts as none."""
    return F.least(F.coalesce(extraction, F.lit(0.0)), F.coalesce(grounding, F.lit(0.0)))


def band(score: Column) -> Column:
    out = F.lit(BANDS[-1][0])
    for name, least in reversed(BANDS[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def unit_token(dimension: Column, currency: Column, scale: Column) -> Column:
    letter = F.lit(None).cast("string")
    for size, x in SCALE_LETTERS.items():
        letter = F.when(scale == size, x).otherwise(letter)
    money = F.when(letter.isNotNull(), F.concat_ws("_", currency, letter)).otherwise(currency)
    return (
        F.when(dimension.isNull(), "UNKNOWN")
        .when((dimension == "currency") & currency.isNull(), "CUR_RAW")
        .when(dimension == "currency", money)
        .when(dimension == "percent", "PCT")
        .when(dimension == "percentage_points", "PP")
        .otherwise(F.upper(dimension))
    )


def is_placeholder(text: Column) -> Column:
    """Whether a text says nothing."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"^[.?-]+|[.?-]+$", "")
    return bare.isin(*PLACEHOLDERS)


_TOKEN_SQL = """CASE WHEN unit_dimension IS NULL THEN 'UNKNOWN' WHEN unit_dimension = 'currency' AND unit_currency IS NULL THEN 'CUR_RAW'
    WHEN unit_dimension = 'currency' THEN concat_ws('_', unit_currency, CASE unit_scale WHEN 1e3 THEN 'K' WHEN 1e5 THEN 'L' WHEN 1e6 THEN 'M' WHEN 1e7 THEN 'CR' WHEN 1e9 THEN 'B' WHEN 1e12 THEN 'T' END)
    WHEN unit_dimension = 'percent' THEN 'PCT' WHEN unit_dimension = 'percentage_points' THEN 'PP' ELSE upper(unit_dimension) END"""
_CONFIDENCE_SQL = "least(coalesce(conf_extraction, 0.0), coalesce(conf_grounding, 0.0))"
_BAND_SQL = "CASE WHEN c >= 0.90 THEN '0.90 and above' WHEN c >= 0.75 THEN '0.75 to 0.90' WHEN c >= 0.60 THEN '0.60 to 0.75' ELSE 'below 0.60' END"


@query(
    f"""SELECT id AS claim_id, document_id, coalesce(page_no, -1) AS page_no, subject, predicate, claim_type,
        CASE WHEN claim_type = 'measurement' THEN coalesce(nullif(trim(value_raw), ''), '—') ELSE coalesce(value_text, subject) END AS printed,
        {_TOKEN_SQL} AS unit, coalesce(period_label, period_raw, '') AS period, {_CONFIDENCE_SQL} AS confidence,
        CASE WHEN claim_type = 'state' THEN concat(coalesce(CAST(valid_from AS VARCHAR), '…'), ' to ', CASE WHEN valid_to IS NULL OR valid_to_is_open THEN 'now' ELSE CAST(valid_to AS VARCHAR) END) END AS tenure
        FROM claims""",
    "claims",
)
def fact_view(claims: DataFrame) -> DataFrame:
    """Every claim as a screen shows it: printed value, unit, period or tenure, and confidence."""
    measured = F.col("claim_type") == "measurement"
    printed = F.when(measured, F.coalesce(F.nullif(F.trim("value_raw"), F.lit("")), F.lit("—"))).otherwise(F.coalesce("value_text", "subject"))
    ends = F.when(F.col("valid_to").isNull() | F.coalesce("valid_to_is_open", F.lit(False)), "now").otherwise(F.col("valid_to").cast("string"))
    tenure = F.when(F.col("claim_type") == "state", F.concat(F.coalesce(F.col("valid_from").cast("string"), F.lit("…")), F.lit(" to "), ends))
    return claims.select(
        F.col("id").alias("claim_id"), "document_id", F.coalesce("page_no", F.lit(-1)).alias("page_no"), "subject", "predicate", "claim_type", printed.alias("printed"),
        unit_token(F.col("unit_dimension"), F.col("unit_currency"), F.col("unit_scale")).alias("unit"), F.coalesce("period_label", "period_raw", F.lit("")).alias("period"),
        confidence(F.col("conf_extraction"), F.col("conf_grounding")).alias("confidence"), tenure.alias("tenure"),
    )


@query(
    """SELECT id AS claim_id, subject, predicate FROM claims WHERE contains(lower(concat_ws(' ', subject, predicate, value_raw, value_text, period_label)), 'logistics')
       AND period_label = 'FY2020'""",
    "claims",
)
def fact_search(claims: DataFrame) -> DataFrame:
    """Facts of one period in which a word stands, whatever its case."""
    text = F.lower(F.concat_ws(" ", "subject", "predicate", "value_raw", "value_text", "period_label"))
    return claims.filter((F.col("period_label") == "FY2020") & text.contains("logistics")).select(F.col("id").alias("claim_id"), "subject", "predicate")


@query(f"SELECT {_TOKEN_SQL} AS unit, count(*) AS n FROM claims WHERE claim_type = 'measurement' GROUP BY 1", "claims")
def unit_tokens(claims: DataFrame) -> DataFrame:
    """How often each display unit occurs."""
    token = unit_token(F.col("unit_dimension"), F.col("unit_currency"), F.col("unit_scale"))
    return claims.filter("claim_type = 'measurement'").groupBy(token.alias("unit")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH scored AS (SELECT {_BAND_SQL} AS band FROM (SELECT {_CONFIDENCE_SQL} AS c FROM claims)),
        bands AS (SELECT unnest(['0.90 and above', '0.75 to 0.90', '0.60 to 0.75', 'below 0.60']) AS band)
        SELECT bands.band, count(scored.band) AS n FROM bands LEFT JOIN scored USING (band) GROUP BY 1""",
    "claims",
)
def confidence_bands(claims: DataFrame) -> DataFrame:
    """Claims in each band of confidence, also the empty ones."""
    scored = claims.groupBy(band(confidence(F.col("conf_extraction"), F.col("conf_grounding"))).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    bands = claims.sparkSession.createDataFrame([(b,) for b, _ in BANDS], "band string")
    return bands.join(scored, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    """SELECT count(*) AS claims, count(DISTINCT document_id) AS documents, count(DISTINCT (document_id, page_no)) FILTER (page_no IS NOT NULL) AS pages,
       count(DISTINCT subject) AS subjects, count(DISTINCT predicate) AS predicates, count(*) FILTER (claim_type = 'state') AS states,
       count(*) FILTER (unit_dimension IS NOT NULL) AS with_unit, count(*) FILTER (period_start IS NOT NULL) AS with_period FROM claims""",
    "claims",
)
def corpus_summary(claims: DataFrame) -> DataFrame:
    """One row of totals."""
    return claims.agg(
        F.count(F.lit(1)).alias("claims"), F.count_distinct("document_id").alias("documents"), F.count_distinct("document_id", "page_no").alias("pages"),
        F.count_distinct("subject").alias("subjects"), F.count_distinct("predicate").alias("predicates"), F.count_if(F.col("claim_type") == "state").alias("states"),
        F.count("unit_dimension").alias("with_unit"), F.count("period_start").alias("with_period"),
    )


@query(
    """WITH c AS (SELECT document_id, count(*) AS claims, count(DISTINCT page_no) AS pages_with_claims FROM claims GROUP BY 1),
       q AS (SELECT document_id, count(*) AS quarantined FROM quarantine GROUP BY 1)
       SELECT f.id AS document_id, f.filename, f.n_pages, coalesce(c.claims, 0) AS claims, coalesce(c.pages_with_claims, 0) AS pages_with_claims, coalesce(q.quarantined, 0) AS quarantined
       FROM filings f LEFT JOIN c ON c.document_id = f.id LEFT JOIN q ON q.document_id = f.id""",
    "filings", "claims", "quarantine",
)
def documents_view(filings: DataFrame, claims: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Every document with its claims, the pages that have some, and what was refused."""
    counted = claims.groupBy("document_id").agg(F.count(F.lit(1)).alias("claims"), F.count_distinct("page_no").alias("pages_with_claims"))
    refused = quarantine.groupBy("document_id").agg(F.count(F.lit(1)).alias("quarantined"))
    both = filings.withColumnRenamed("id", "document_id").join(counted, "document_id", "left").join(refused, "document_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("document_id", "filename", "n_pages", zero("claims"), zero("pages_with_claims"), zero("quarantined"))


@query(
    """SELECT m.id AS metric_id, m.canonical_name, m.dimension, coalesce(string_agg(DISTINCT a.alias, '; ' ORDER BY a.alias), '') AS aliases, any_value(coalesce(c.n, 0)) AS claims
       FROM metrics m LEFT JOIN metric_aliases a ON a.metric_id = m.id LEFT JOIN (SELECT predicate, count(*) AS n FROM claims GROUP BY 1) c ON c.predicate = m.canonical_name GROUP BY 1, 2, 3""",
    "metrics", "metric_aliases", "claims",
)
def metric_registry_view(metrics: DataFrame, aliases: DataFrame, claims: DataFrame) -> DataFrame:
    """Every metric with its aliases in order and the claims under its canonical name."""
    other = aliases.groupBy("metric_id").agg(F.array_join(F.array_sort(F.collect_set("alias")), "; ").alias("aliases"))
    used = claims.join(F.broadcast(metrics.select(F.col("canonical_name").alias("predicate"))), "predicate", "left_semi").groupBy("predicate").agg(F.count(F.lit(1)).alias("claims"))
    both = metrics.withColumnRenamed("id", "metric_id").join(other, "metric_id", "left").join(used.withColumnRenamed("predicate", "canonical_name"), "canonical_name", "left")
    return both.select("metric_id", "canonical_name", "dimension", F.coalesce("aliases", F.lit("")).alias("aliases"), F.coalesce("claims", F.lit(0)).alias("claims"))


@query(
    """SELECT axis, count(*) AS occurrences, count(DISTINCT value) AS n_values, array_to_string(list_sort(list_distinct(list(value)))[1:6], '; ') AS some_values
       FROM (SELECT unnest(map_keys(qualifiers)) AS axis, unnest(map_values(qualifiers)) AS value FROM claims) WHERE value IS NOT NULL GROUP BY 1""",
    "claims",
)
def axis_values(claims: DataFrame) -> DataFrame:
    """Every axis that claims state, with up to six of its values in order."""
    stated = claims.select(F.explode("qualifiers").alias("axis", "value")).filter("value IS NOT NULL")
    return stated.groupBy("axis", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("axis").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("n_values"), F.array_join(F.slice(F.array_sort(F.collect_list("value")), 1, 6), "; ").alias("some_values")
    )


@query(
    """SELECT axis, count(*) AS claims, count(*) FILTER (stated) AS stated_too FROM
       (SELECT unnest(unknown_qualifiers) AS axis, qualifiers FROM claims), LATERAL (SELECT list_contains(map_keys(qualifiers), axis) AS stated) GROUP BY 1""",
    "claims",
)
def unknown_axes(claims: DataFrame) -> DataFrame:
    """Every axis that claims leave unknown, and how many of them state it all the same, where stating counts."""
    missing = claims.select("qualifiers", F.explode("unknown_qualifiers").alias("axis"))
    stated = F.array_contains(F.map_keys("qualifiers"), F.col("axis"))
    return missing.groupBy("axis").agg(F.count(F.lit(1)).alias("claims"), F.count_if(stated).alias("stated_too"))


@query(
    """SELECT coalesce(stage, 'TOTAL') AS stage, coalesce(reason_code, 'all') AS reason_code, count(*) AS n, count(DISTINCT document_id) AS documents FROM quarantine GROUP BY ROLLUP (stage, reason_code)""",
    "quarantine",
)
def quarantine_report(quarantine: DataFrame) -> DataFrame:
    """Refusals by stage and reason, with subtotals and a total."""
    rolled = quarantine.rollup("stage", "reason_code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("documents"))
    return rolled.select(F.coalesce("stage", F.lit("TOTAL")).alias("stage"), F.coalesce("reason_code", F.lit("all")).alias("reason_code"), "n", "documents")


@query(
    """SELECT id AS quarantine_id, document_id, coalesce(page_no, -1) AS page_no, stage, reason_code, payload::JSON->>'$.subject' AS subject, payload::JSON->>'$.value_raw' AS value_raw FROM quarantine""",
    "quarantine",
)
def quarantine_view(quarantine: DataFrame) -> DataFrame:
    """Every refusal with the subject and value of its payload."""
    part = lambda c: F.get_json_object("payload", f"$.{c}").alias(c)
    return quarantine.select(F.col("id").alias("quarantine_id"), "document_id", F.coalesce("page_no", F.lit(-1)).alias("page_no"), "stage", "reason_code", part("subject"), part("value_raw"))


@query("SELECT grounding_method, count(*) AS n, round(count(*) / (SELECT count(*) FROM claims), 6) AS share FROM claims GROUP BY 1", "claims")
def grounding_methods(claims: DataFrame) -> DataFrame:
    """Claims by how their evidence was found, and each one's share."""
    counted = claims.groupBy("grounding_method").agg(F.count(F.lit(1)).alias("n"))
    total = claims.agg(F.count(F.lit(1)).alias("all"))
    return counted.select("grounding_method", "n", F.round(F.col("n") / total.scalar(), 6).alias("share"))


@query(
    r"""SELECT predicate, count(*) AS n FROM claims WHERE regexp_replace(lower(trim(coalesce(predicate, ''))), '^[.?-]+|[.?-]+$', '', 'g')
       IN ('unknown', 'unclear', 'n/a', 'na', 'none', 'null', 'not available', 'not applicable', 'tbd', 'xx', '') GROUP BY 1""",
    "claims",
)
def placeholder_predicates(claims: DataFrame) -> DataFrame:
    """Predicates that say nothing."""
    return claims.filter(is_placeholder(F.col("predicate"))).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


_PREDICATE_KEY = r"trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^0-9A-Za-z_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_NAME_KEY = (
    "regexp_replace("
    + _PREDICATE_KEY.format(r"regexp_replace(trim(coalesce({}, '')), '(?i)^(mr|mrs|ms|miss|dr|prof|shri|smt|sri|sh)\.?\s+', '')")
    + ", ' (private limited|public limited company|limited liability partnership|incorporated|corporation|company|limited|pvt ltd|pvt|ltd|llp|plc|inc|corp|co)$', '')"
)


@query(f"SELECT {_NAME_KEY.format('subject')} AS key, count(*) AS claims, count(DISTINCT subject) AS spellings FROM claims WHERE subject IS NOT NULL GROUP BY 1", "claims")
def name_keys(claims: DataFrame) -> DataFrame:
    """Subjects by their comparison key."""
    spelt = claims.filter("subject IS NOT NULL").groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    return spelt.groupBy(texts.name_key(F.col("subject")).alias("key")).agg(F.sum("n").alias("claims"), F.count(F.lit(1)).alias("spellings"))


@query(f"SELECT {_PREDICATE_KEY.format('predicate')} AS key, count(*) AS claims, count(DISTINCT predicate) AS spellings FROM claims WHERE predicate IS NOT NULL GROUP BY 1", "claims")
def predicate_keys(claims: DataFrame) -> DataFrame:
    """Predicates by their comparison key."""
    spelt = claims.filter("predicate IS NOT NULL").groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))
    return spelt.groupBy(texts.predicate_key(F.col("predicate")).alias("key")).agg(F.sum("n").alias("claims"), F.count(F.lit(1)).alias("spellings"))


@query(
    rf"""WITH keys AS (SELECT metric_id, {_PREDICATE_KEY.format('alias')} AS key FROM metric_aliases UNION SELECT id, {_PREDICATE_KEY.format('canonical_name')} FROM metrics),
        one AS (SELECT key, min(metric_id) AS metric_id FROM keys GROUP BY 1)
        SELECT coalesce(metric_id, 0) AS metric_id, count(*) AS claims FROM claims LEFT JOIN one ON one.key = {_PREDICATE_KEY.format('predicate')} GROUP BY 1""",
    "claims", "metrics", "metric_aliases",
)
def metric_resolution(claims: DataFrame, metrics: DataFrame, aliases: DataFrame) -> DataFrame:
    """Claims by the metric whose name or alias has the same key, 0 for none."""
    names = metrics.select(F.col("id").alias("metric_id"), texts.predicate_key(F.col("canonical_name")).alias("key")).unionByName(aliases.select("metric_id", texts.predicate_key(F.col("alias")).alias("key")))
    one = names.groupBy("key").agg(F.min("metric_id").alias("metric_id"))
    typed = claims.groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).withColumn("key", texts.predicate_key(F.col("predicate")))
    return typed.join(F.broadcast(one), "key", "left").groupBy(F.coalesce("metric_id", F.lit(0)).alias("metric_id")).agg(F.sum("n").alias("claims"))


_CARDINALITY = r"""CASE WHEN regexp_matches(lower(p), '\b(cin|isin|registered office|registration number|corporate identity|pan|head ?quarters?)\b')
    OR regexp_matches(lower(p), '\b(chief|secretary|chairman|chairperson|managing|president|compliance officer|cfo|ceo|coo|cto)\b') THEN 1
    WHEN regexp_matches(lower(p), '\b(director|member|subsidiary|subsidiaries|partner|shareholder|auditor|associate|associates|affiliate|affiliates|promoter|promoters|trustee|trustees)\b') THEN 0
    WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN 0 ELSE 1 END"""
_HEAD_WORD = r"regexp_extract(trim(regexp_split_to_array(regexp_replace(trim(lower(p)), ':+$', ''), '\s[-–—]\s|\bof\b|\bfor\b')[1]), '(\S*)$', 1)"


@query(
    f"SELECT predicate, cardinality, claims FROM (SELECT p AS predicate, {_CARDINALITY} AS cardinality, n AS claims FROM (SELECT *, {_HEAD_WORD} AS w FROM (SELECT predicate AS p, count(*) AS n FROM claims WHERE predicate IS NOT NULL GROUP BY 1)))",
    "claims",
)
def cardinality_infer(claims: DataFrame) -> DataFrame:
    """How many holders each predicate admits by its words."""
    counted = claims.filter("predicate IS NOT NULL").groupBy("predicate").agg(F.count(F.lit(1)).alias("claims"))
    return counted.select("predicate", texts.cardinality(F.col("predicate")).alias("cardinality"), "claims")


_PRECISION = r"""CASE WHEN regexp_matches(trim(value_raw), '[0-9]') THEN pow(10.0::DOUBLE, -(CASE WHEN t = '' OR regexp_matches(t, '^,[0-9]{3}$') THEN 0 ELSE length(t) - 1 END)) * s END"""


@query(
    rf"""SELECT id AS claim_id, {_PRECISION} AS precision FROM (SELECT *, regexp_extract(trim(value_raw), '([.,][0-9]+)\s*%?\s*\)?\s*$', 1) AS t,
        CASE WHEN coalesce(unit_scale, 0) = 0 THEN 1.0::DOUBLE ELSE unit_scale END AS s FROM claims WHERE claim_type = 'measurement')""",
    "claims",
)
def written_precision(claims: DataFrame) -> DataFrame:
    """The smallest step that each printed figure shows, in base units."""
    scale = F.when(F.coalesce("unit_scale", F.lit(0.0)) == 0, 1.0).otherwise(F.col("unit_scale"))
    return claims.filter("claim_type = 'measurement'").select(F.col("id").alias("claim_id"), values.written_precision(F.col("value_raw"), scale).alias("precision"))


@query(
    r"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(replace(lower(coalesce(value_text, '')), '&', ' and '), '([a-z0-9]+)', 1)) AS token FROM claims WHERE claim_type = 'state') GROUP BY 1""",
    "claims",
)
def text_value_tokens(claims: DataFrame) -> DataFrame:
    """The words of the states' values."""
    found = claims.filter("claim_type = 'state'").select(F.explode(values.text_tokens(F.col("value_text"))).alias("token"))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT document_id, to_json(struct_pack(document := document_id, claims := n, measurements := m, states := n - m)) AS json FROM
       (SELECT document_id, count(*) AS n, count(*) FILTER (claim_type = 'measurement') AS m FROM claims WHERE document_id IS NOT NULL GROUP BY 1)""",
    "claims",
)
def export_headers(claims: DataFrame) -> DataFrame:
    """The header of each document's JSON export."""
    counted = claims.filter("document_id IS NOT NULL").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("claim_type") == "measurement").alias("m"))
    header = F.struct(F.col("document_id").alias("document"), F.col("n").alias("claims"), F.col("m").alias("measurements"), (F.col("n") - F.col("m")).alias("states"))
    return counted.select("document_id", F.to_json(header).alias("json"))
