from lodestone.streaming.tally import distinct_events, sessions, windowed_counts


def test_stream_agrees_with_table(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1), ("2024-01-01 00:20:00", "a", 2), ("2024-01-01 01:30:00", "b", 3), ("2024-01-01 00:10:00", "a", 1)]
    table = spark.createDataFrame(rows, "t string, k string, id int").selectExpr("cast(t as timestamp) as t", "k", "id")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "t", "k").writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("hourly")) == key(windowed_counts(table, "t", "k")) and len(key(spark.table("hourly"))) == 2
    assert sorted(r["n"] for r in sessions(table, "t", "k").collect()) == [1, 3]
    assert distinct_events(table, "t", "id").count() == 3
