"""Sinks: append, replace by key, JSON documents and snapshots; and the page numbers a user names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans import registry
from factloom.session import cut


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Add rows to a table, in folders by some columns."""
    df.write.mode("append").partitionBy(*(by or [])).parquet(path)


def replace_by_key(existing: DataFrame, new: DataFrame, keys: list[str], path: str) -> None:
    """Write what exists without the rows that have a key of the new ones, and the new ones; the table may be its own source.

    Rows with a null in the key are replaced by none and stay.
    """
    kept = existing.join(new.select(*keys).distinct(), keys, "left_anti").select(*existing.columns)
    cut(kept.unionByName(new.select(*existing.columns))).write.mode("overwrite").parquet(path)


def without_relations_of(relations: DataFrame, doomed: DataFrame) -> DataFrame:
    """Relations of which neither claim is doomed; doomed: (claim_id)."""
    columns = relations.columns
    for side in ("claim_a", "claim_b"):
        relations = relations.join(doomed.select(F.col("claim_id").alias(side)).distinct(), side, "left_anti")
    return relations.select(*columns)


def documents_json(filings: DataFrame, claims: DataFrame, quarantine: DataFrame) -> DataFrame:
    """(document_id, json) of every document: its header, claims in order of page and number, and refusals.

    Dates are ISO; null fields are left out.  A document's claims are one row, as a reader of the file
    needs them; they are bounded by what one document says.
    """
    measured = F.col("claim_type") == "measurement"
    only = lambda c, when: F.when(when, F.col(c)).alias(c)
    claim = F.struct(
        F.coalesce("page_no", F.lit(-1)).alias("page_no"), "id", "claim_type", "subject", "predicate", "qualifiers", "unknown_qualifiers",
        *[only(c, measured) for c in ("value_raw", "value_num", "unit_raw", "period_label")],
        *[only(c, ~measured) for c in ("value_text", "valid_from", "valid_to", "valid_to_is_open")], "evidence_quote",
    )
    said = claims.select("document_id", claim.alias("c")).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("c.page_no", "c.id", F.to_json("c").alias("json")))).alias("claims"))
    refused = quarantine.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("id", "stage", "reason_code"))).alias("quarantined"))
    header = F.struct("document_id", "filename", "publisher", "as_of_date", "n_pages")
    rows = filings.withColumnRenamed("id", "document_id").join(said, "document_id", "left").join(refused, "document_id", "left")
    texts = F.array_join(F.transform(F.coalesce("claims", F.array().cast("array<struct<page_no:int,id:bigint,json:string>>")), lambda x: x["json"]), ",")
    refusals = F.coalesce(F.to_json("quarantined"), F.lit("[]"))
    return rows.select("document_id", F.concat(F.lit('{"document":'), F.to_json(header), F.lit(',"claims":['), texts, F.lit('],"quarantined":'), refusals, F.lit("}")).alias("json"))


def write_documents_json(documents: DataFrame, path: str) -> None:
    """One JSON document a line."""
    documents.select("json").write.mode("overwrite").text(path)


def snapshot(relations: DataFrame, path: str) -> None:
    """Keep of every pair only its newest relation."""
    registry.newest(relations).write.mode("overwrite").parquet(path)


def pages_of(spec: str | None) -> list[int] | None:
    """Page numbers named as in "0-9,35,40", each once and in order; None means all."""
    if not spec or not spec.strip():
        return None
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        first, dash, last = part.partition("-")
        low, high = int(first), int(last if dash else first)
        if high < low:
            raise ValueError(f"{part}: the last page comes before the first")
        out.update(range(low, high + 1))
    return sorted(out)
