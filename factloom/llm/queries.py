"""The queries of this subpackage and their SQL, added by the entry module where it can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import canonical, mixture, names, packing, recompression, splitting
from factloom.sources.tables import table


def limits(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The handful of named limits of job_limits."""
    return {r.limit_name: r.limit_value for r in table(spark, sf_dir, "job_limits").collect()}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page that has to be split, whatever its stored length says."""
    limit = limits(spark, sf_dir)
    return splitting.found(table(spark, sf_dir, "filing_pages"), limit["page_max_chars"], limit["page_overlap_chars"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim whose predicate is no canonical name as it stands, with the entry it stands for or 0."""
    return canonical.found(*(table(spark, sf_dir, t) for t in ("claims", "metrics", "metric_aliases")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of spellings of the same person or organisation."""
    return names.found(table(spark, sf_dir, "claims"))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its frequency, its entity and how many spellings that has."""
    return names.linked(table(spark, sf_dir, "claims"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or piece of one, with its container."""
    return packing.containers(table(spark, sf_dir, "documents"), limits(spark, sf_dir)["container_tokens"])


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are, how few there could be and how full they are."""
    return packing.report(p7_containers(spark, sf_dir), limits(spark, sf_dir)["container_tokens"])


#: what kind of publication a source is, the upper level of the weight tree
DOMAINS = {"macro_review": "public bodies", "regulator_order": "public bodies"} | dict.fromkeys(["annual_report", "earnings_deck", "prospectus", "press_note", "board_minutes"], "companies")


def _mixed(spark: SparkSession, sf_dir: str, total: str | None = None) -> tuple[DataFrame, DataFrame]:
    return mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), total, DOMAINS)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a text in a mixture as large as the listed sources together."""
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each listed source in that mixture."""
    return _mixed(spark, sf_dir)[1]


def p8_shares_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the largest mixture in which every source reaches its target."""
    return _mixed(spark, sf_dir, "exact")[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of each document that stand verbatim in others."""
    return recompression.shared_spans(table(spark, sf_dir, "documents"), limits(spark, sf_dir)["shared_min_chars"])


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document's text such stretches cover."""
    return recompression.coverage(table(spark, sf_dir, "documents"), limits(spark, sf_dir)["shared_min_chars"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p2_found, p4_found, p5_found, p5_entities, p7_containers, p7_report, p8_mixture, p8_shares, p8_shares_exact, p9_found, p9_coverage]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            SELECT id AS page_id FROM filing_pages
            WHERE length(text) > (SELECT limit_value FROM job_limits WHERE limit_name = 'page_max_chars')
        """,
    }
