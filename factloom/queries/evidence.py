"""Pages and evidence: ingest, admission, sampling, routing, grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import values
from factloom.plans import grounding
from factloom.queries import Registry

QUERIES = Registry()
query = QUERIES.add
#: a page with text, and the figures of a page that was read as a picture
TEXT_CHARS, UNBOUND_LEAST, UNBOUND_SHARE, FIGURES_LEAST = 100, 6, 0.55, 5


@query(
    "SELECT sha256(coalesce(text, '')) AS content, min(id) AS first_page, count(*) AS copies FROM filing_pages GROUP BY 1",
    "filing_pages",
)
def ingest_dedup(pages: DataFrame) -> DataFrame:
    """Pages by the hash of their content: the first one is kept, copies are not ingested again."""
    return pages.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content")).agg(F.min("id").alias("first_page"), F.count(F.lit(1)).alias("copies"))


@query(
    """SELECT document_id, count(*) AS pages, count(*) FILTER (length(text) >= 100) AS with_text, count(*) FILTER (length(text) >= 100) >= greatest(1, count(*) // 2) AS admitted
       FROM filing_pages GROUP BY 1""",
    "filing_pages",
)
def text_layer_admission(pages: DataFrame) -> DataFrame:
    """Documents with enough text on at least half of their pages."""
    full = F.count_if(F.length("text") >= TEXT_CHARS)
    counted = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), full.alias("with_text"))
    return counted.withColumn("admitted", F.col("with_text") >= F.greatest(F.lit(1), F.expr("pages div 2")))


@query(
    """WITH one AS (SELECT document_id, page_no, min(length(text)) AS chars FROM filing_pages WHERE text IS NOT NULL GROUP BY 1, 2),
       n AS (SELECT document_id, count(*) AS pages FROM one GROUP BY 1)
       SELECT document_id, count(*) AS sampled, sum(least(chars, 9000 // 6))::BIGINT AS chars FROM one JOIN n USING (document_id)
       WHERE page_no < 4 OR (pages > 8 AND page_no IN (pages // 4, pages // 2)) GROUP BY 1""",
    "filing_pages",
)
def profile_sample(pages: DataFrame) -> DataFrame:
    """The pages from which a document is profiled: the first four, and of a long one those at a quarter and half."""
    one = pages.filter("text IS NOT NULL").groupBy("document_id", "page_no").agg(F.min(F.length("text")).alias("chars"))
    counted = one.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"))
    wanted = "page_no < 4 OR (pages > 8 AND page_no IN (pages div 4, pages div 2))"
    return one.join(counted, "document_id").filter(wanted).groupBy("document_id").agg(F.count(F.lit(1)).alias("sampled"), F.sum(F.least("chars", F.lit(1500))).alias("chars"))


@query(
    """SELECT p.document_id, p.page_no FROM (SELECT DISTINCT document_id, page_no FROM filing_pages) p
       WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.document_id = p.document_id AND c.page_no = p.page_no)
       AND NOT EXISTS (SELECT 1 FROM quarantine q WHERE q.document_id = p.document_id AND q.page_no = p.page_no)""",
    "filing_pages", "claims", "quarantine",
)
def pending_pages(pages: DataFrame, claims: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Pages that have neither claims nor refusals: the ones still to be read."""
    key = ["document_id", "page_no"]
    done = claims.select(*key).unionByName(quarantine.select(*key)).dropna().distinct()
    return pages.select(*key).distinct().join(done, key, "left_anti")


@query(
    """SELECT id AS page_id, coalesce(unbound_numbers, 0) >= 6 AND coalesce(unbound_numbers, 0) / (coalesce(unbound_numbers, 0) + coalesce(bound_numbers, 0)) >= 0.55 AS routed FROM filing_pages""",
    "filing_pages",
)
def figure_routing(pages: DataFrame) -> DataFrame:
    """Pages whose figures mostly stand apart from any label and go to the pass that reads pictures."""
    loose, bound = F.coalesce("unbound_numbers", F.lit(0)), F.coalesce("bound_numbers", F.lit(0))
    share = F.when(loose + bound > 0, loose / (loose + bound)).otherwise(0.0)
    return pages.select(F.col("id").alias("page_id"), ((loose >= UNBOUND_LEAST) & (share >= UNBOUND_SHARE)).alias("routed"))


@query(
    r"SELECT id AS page_id, len(regexp_extract_all(coalesce(text, ''), '[0-9][0-9,]*\.?[0-9]*')) AS figures, len(regexp_extract_all(coalesce(text, ''), '[0-9][0-9,]*\.?[0-9]*')) >= 5 AS has_figures FROM filing_pages",
    "filing_pages",
)
def figure_counts(pages: DataFrame) -> DataFrame:
    """How many figures a page has, and whether they are enough for a table."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[0-9][0-9,]*\.?[0-9]*"))
    return pages.select(F.col("id").alias("page_id"), n.cast("bigint").alias("figures"), (n >= FIGURES_LEAST).alias("has_figures"))


@query(
    """SELECT t.id AS claim_id FROM claims t WHERE t.claim_type = 'measurement' AND t.source = 'text' AND regexp_replace(coalesce(t.value_raw, ''), '[^0-9]', '', 'g') <> ''
       AND EXISTS (SELECT 1 FROM claims f WHERE f.source = 'figure' AND f.document_id = t.document_id AND f.page_no = t.page_no
       AND regexp_replace(f.value_raw, '[^0-9]', '', 'g') = regexp_replace(t.value_raw, '[^0-9]', '', 'g'))""",
    "claims",
)
def superseded_figures(claims: DataFrame) -> DataFrame:
    """Measurements read from text whose digits a figure of the same page has too."""
    key = ["document_id", "page_no", "digits"]
    rows = claims.withColumn("digits", values.digits(F.coalesce("value_raw", F.lit("")))).filter("digits <> ''")
    figures = rows.filter("source = 'figure'").select(*key).distinct()
    return rows.filter("claim_type = 'measurement' AND source = 'text'").join(figures, key, "left_semi").select(F.col("id").alias("claim_id"))


_GROUND = r"""WITH pages AS (SELECT document_id, page_no, min_by(text, id) AS page FROM filing_pages GROUP BY 1, 2),
    q AS (SELECT c.id, coalesce(evidence_quote, '') AS quote, CASE WHEN claim_type = 'measurement' THEN value_raw ELSE coalesce(value_text, subject) END AS value, coalesce(page, '') AS page
          FROM claims c LEFT JOIN pages p ON c.document_id = p.document_id AND c.page_no = p.page_no),
    m AS (SELECT *, CASE WHEN trim(quote) = '' THEN 'none' WHEN contains(page, quote) THEN 'exact' WHEN contains(regexp_replace(page, '\s+', ' ', 'g'), trim(regexp_replace(quote, '\s+', ' ', 'g'))) THEN 'normalized' ELSE 'none' END AS method,
          regexp_replace(value, '[^0-9]', '', 'g') AS vd, regexp_replace(quote, '[^0-9]', '', 'g') AS qd FROM q),
    g AS (SELECT *, CASE WHEN trim(quote) = '' THEN 'empty_quote' WHEN method = 'none' THEN 'quote_not_found' WHEN coalesce(trim(value), '') = '' THEN 'missing_value'
          WHEN NOT (contains(lower(quote), lower(trim(value))) OR (vd <> '' AND contains(qd, vd))) THEN 'value_not_in_quote' END AS reason_code FROM m)"""


@query(_GROUND + " SELECT method, coalesce(reason_code, 'grounded') AS outcome, count(*) AS n FROM g GROUP BY 1, 2", "claims", "filing_pages")
def ground_outcomes(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """How the claims' evidence was found on their pages, and why some is refused."""
    return grounding.grounded(claims, pages).groupBy("method", F.coalesce("reason_code", F.lit("grounded")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(_GROUND + " SELECT id AS claim_id, reason_code FROM g WHERE reason_code IS NOT NULL", "claims", "filing_pages")
def ground_refused(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """The claims whose evidence doesn't hold, for the quarantine."""
    return grounding.grounded(claims, pages).filter("NOT ok").select("claim_id", "reason_code")


@query(
    "SELECT body_font_size AS size, sum(n_chars)::BIGINT AS chars, count(*) AS documents FROM filings WHERE body_font_size IS NOT NULL GROUP BY 1",
    "filings",
)
def body_sizes(filings: DataFrame) -> DataFrame:
    """Font sizes of body text by the characters set in them."""
    return filings.filter("body_font_size IS NOT NULL").groupBy(F.col("body_font_size").alias("size")).agg(F.sum("n_chars").alias("chars"), F.count(F.lit(1)).alias("documents"))
