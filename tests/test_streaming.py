from lodestone.streaming import events

DIR = "/root/testdata/sf0.001"


def test_a_stream_counts_as_a_batch_does(spark, tmp_path):
    batch = spark.read.parquet(f"{DIR}/events.parquet").select("ts", "event_type")
    source = tmp_path / "in"
    batch.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(batch.schema).parquet(str(source))
    query = events.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("counts").collect()))
    assert got == sorted(map(tuple, events.windowed_counts(batch).collect()))


def test_latest_by_key(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "w")], "job string, at int, state string")
    assert sorted(map(tuple, events.latest_by_key(log, "job", "at").collect())) == [("a", 3, "z"), ("b", 1, "w")]
