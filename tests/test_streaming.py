def test_streaming_history(spark, tmp_path):
    from casewise.streaming import streaming_history

    schema = "caseid long, timestamp long, bis double"
    spark.createDataFrame([(1, 0, 5.0), (1, 10, 6.0), (2, 0, 1.0)], schema).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([(1, 20, 7.0), (2, 30, 2.0)], schema).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in/*")
    query = streaming_history(stream, "bis", 3).writeStream.format("memory").queryName("history").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.caseid, r.timestamp): (r.history, r.present) for r in spark.table("history").collect()}
    assert got[1, 0] == ([5, 5, 5], [0, 0, 1]) and got[1, 20] == ([5, 6, 7], [1, 1, 1]) and got[2, 30][0] is None
