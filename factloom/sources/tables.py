"""Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class SchemaOutOfDate(ValueError):
    """A stored table lacks columns that are needed, or has them with other types."""


def table(spark: SparkSession, folder: str, name: str, expected: StructType | None = None) -> DataFrame:
    """Read ``<folder>/<name>.parquet``; column pruning and filters reach this scan.

    With an expected schema its columns are checked before anything is read; further ones are allowed.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if expected is not None:
        there = {f.name: f.dataType for f in df.schema}
        wrong = [f.name for f in expected if there.get(f.name) != f.dataType]
        if wrong:
            raise SchemaOutOfDate(f"{name}: {', '.join(wrong)}")
    return df


def of_documents(df: DataFrame, ids: list[int], column: str = "document_id") -> DataFrame:
    """The rows of some documents; the filter reaches the scan."""
    return df.filter(df[column].isin(ids))
