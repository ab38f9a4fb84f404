"""Incremental ingest: new pages by the hash of their content, each once, whatever arrives again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_content(pages: DataFrame) -> DataFrame:
    return pages.withColumn("content", F.sha2(F.coalesce("text", F.lit("")), 256))


def new_pages(pages: DataFrame, known: DataFrame | None) -> DataFrame:
    """The pages whose content isn't known, the one with the smallest id of equal ones."""
    first = with_content(pages).groupBy("content").agg(F.min_by(F.struct(*pages.columns), "id").alias("p")).select("p.*", "content")
    return first if known is None else first.join(known.select("content").distinct(), "content", "left_anti").select(*first.columns)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Stream page files of a folder into a table; a page that is there already is not added again."""

    def add(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        try:
            known = session.read.parquet(target)
        except Exception:  # the table doesn't exist before the first batch
            known = None
        new_pages(batch, known).write.mode("append").parquet(target)

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
