from boardloom.streaming.questions import intents_by_window


def test_stream_equals_batch(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "which net"), ("2024-01-01 00:01:00", "swd"), ("2024-01-01 00:02:00", "swd"), ("2024-01-01 00:30:00", "hello")]
    df = spark.createDataFrame(rows, "at string, text string").selectExpr("cast(at as timestamp) at", "text")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = intents_by_window(stream, "at", "text").writeStream.outputMode("complete").format("memory").queryName("intents").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("intents").collect())) == sorted(map(tuple, intents_by_window(df, "at", "text").collect()))
