"""Incremental ingest adds what one pass over all rows would."""

from assay.streaming import ingest


def test_insert_new(spark, tmp_path):
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    schema = "id long, content_hash string"
    for batch in ([(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")], [(6, "c"), (7, "d")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.insert_new(stream, table, ["content_hash"], "id", f"{tmp_path}/check").awaitTermination()
    got = sorted((r.id, r.content_hash) for r in spark.read.parquet(table).collect())
    assert got == [(1, "a"), (2, "b"), (5, "c"), (7, "d")]


def test_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "Passed"), ("2024-01-01 00:50:00", "Passed"), ("2024-01-01 01:10:00", "Failed")]
    spark.createDataFrame(rows, "ts string, test_outcome string").selectExpr("cast(ts as timestamp) ts", "test_outcome").write.parquet(f"{tmp_path}/r")
    stream = spark.readStream.schema("ts timestamp, test_outcome string").parquet(f"{tmp_path}/r")
    q = ingest.outcomes_by_window(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.start), r.test_outcome, r.n) for r in spark.sql("select * from windows").collect()) == [("2024-01-01 00:00:00", "Passed", 2), ("2024-01-01 01:00:00", "Failed", 1)]
