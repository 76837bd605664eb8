from tidewake.streaming.bouts import bout_counts


def test_bouts_of_a_stream(spark, tmp_path):
    d = tmp_path / "in"
    spark.createDataFrame([("a", 0, 1), ("a", 1, 1), ("a", 2, 2)], "clip_id string, t long, pred int").coalesce(1).write.parquet(str(d))
    s = spark.readStream.schema("clip_id string, t long, pred int").parquet(str(d))
    w = bout_counts(s).writeStream.outputMode("update").format("memory").queryName("bouts").option("checkpointLocation", str(tmp_path / "c")).start()
    w.processAllAvailable()
    spark.createDataFrame([("a", 3, 2), ("a", 4, 1)], "clip_id string, t long, pred int").coalesce(1).write.mode("append").parquet(str(d))
    w.processAllAvailable()
    w.stop()
    assert max((r.rows, r.bouts) for r in spark.table("bouts").collect()) == (5, 3)
