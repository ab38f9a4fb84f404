import json

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from factloom.sources import sinks
from factloom.sources.tables import SchemaOutOfDate, of_documents, table
from factloom.streaming import ingest, windows

DATA = "/root/testdata/sf0.001"


def test_schema_is_checked(spark):
    good = StructType([StructField("id", LongType()), StructField("alias", StringType())])
    assert table(spark, DATA, "metric_aliases", good).count() == 52
    with pytest.raises(SchemaOutOfDate, match="alias"):
        table(spark, DATA, "metric_aliases", StructType([StructField("alias", LongType())]))
    few = of_documents(table(spark, DATA, "claims"), [1, 2])
    assert "In(document_id" in few._jdf.queryExecution().toString().replace("PushedFilters: [", "") and few.count() > 0


def test_append_and_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    sinks.append(df, path)
    sinks.append(spark.createDataFrame([(3, "c")], "k int, v string"), path)
    sinks.replace_by_key(spark.read.parquet(path), spark.createDataFrame([(2, "B"), (2, "BB")], "k int, v string"), ["k"], path)
    assert sorted(map(str, (tuple(r) for r in spark.read.parquet(path).collect()))) == sorted(map(str, [(1, "a"), (2, "B"), (2, "BB"), (3, "c"), (None, "n")]))
    relations = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "claim_a int, claim_b int")
    assert [tuple(r) for r in sinks.without_relations_of(relations, spark.createDataFrame([(2,)], "claim_id int")).collect()] == [(4, 5)]


def test_documents_as_json(spark):
    got = sinks.documents_json(table(spark, DATA, "filings"), table(spark, DATA, "claims"), table(spark, DATA, "quarantine")).collect()
    claims = {r.document_id: r["count"] for r in table(spark, DATA, "claims").groupBy("document_id").count().collect()}
    for row in got:
        x = json.loads(row.json)
        assert x["document"]["document_id"] == row.document_id and len(x["claims"]) == claims.get(row.document_id, 0)
        assert [(c["page_no"], c["id"]) for c in x["claims"]] == sorted((c["page_no"], c["id"]) for c in x["claims"])


def test_snapshot_keeps_the_newest(spark, tmp_path):
    relations = spark.createDataFrame([(1, 2, 1, "a"), (2, 1, 3, "b"), (1, 2, 2, "c"), (5, 6, 1, "d")], "claim_a int, claim_b int, generation int, verdict string")
    sinks.snapshot(relations, str(tmp_path / "s"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [(1, 2, 3, "b"), (5, 6, 1, "d")]


def test_page_numbers():
    assert sinks.pages_of("0-3,35, 2,40") == [0, 1, 2, 3, 35, 40] and sinks.pages_of(" ") is None
    with pytest.raises(ValueError):
        sinks.pages_of("5-2")


def test_pages_are_ingested_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id bigint, document_id bigint, text string"
    for rows in ([(1, 1, "a"), (2, 1, "a"), (3, 1, None)], [(4, 2, "a"), (5, 2, "b")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark, source, schema, target, str(tmp_path / "c")).awaitTermination()
    assert sorted((r.id, r.text) for r in spark.read.parquet(target).collect()) == [(1, "a"), (3, None), (5, "b")]


def test_windows_over_a_stream(spark, tmp_path):
    events = table(spark, DATA, "events")
    events.repartition(2).write.parquet(str(tmp_path / "e"))
    for k, plan in enumerate((lambda e: windows.tumbling(e, "1 day"), lambda e: windows.tumbling(e, "2 days", "1 day"), lambda e: windows.sessions(e, "6 hours"))):
        stream = plan(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
        stream.writeStream.format("memory").queryName(f"w{k}").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(tuple, spark.table(f"w{k}").collect())) == sorted(map(tuple, plan(events).collect()))
