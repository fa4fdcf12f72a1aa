from tidemark.sources import feed_source

ROWS = [(o, s, f"t{s % 3}", "U", str(s)) for o in (1, 2) for s in range(1, 20)]


def test_batch_filter_and_stream(spark, tmp_path):
    feed_source.register(spark)
    for i in range(2):
        spark.createDataFrame(ROWS[i::2], feed_source.SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"log/{i}"))
    folder = f"file://{tmp_path}/log"
    read = spark.read.format("tidemark_changes").load(folder)
    assert sorted(map(tuple, read.collect())) == sorted(ROWS)
    assert sorted(map(tuple, read.filter("table_name = 't1'").collect())) == sorted(r for r in ROWS if r[2] == "t1")
    query = (
        spark.readStream.format("tidemark_changes").load(folder).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(map(tuple, spark.read.schema(feed_source.SCHEMA).parquet(str(tmp_path / "out")).collect())) == sorted(ROWS)


def test_a_late_file_with_a_smaller_name_is_delivered_once(spark, tmp_path):
    feed_source.register(spark)
    folder = f"file://{tmp_path}/log"

    def run():
        stream = spark.readStream.format("tidemark_changes").load(folder).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame(ROWS[::2], feed_source.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "log/z"))
    run()
    spark.createDataFrame(ROWS[1::2], feed_source.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "log/a"))
    run()
    assert sorted(map(tuple, spark.read.schema(feed_source.SCHEMA).parquet(str(tmp_path / "out")).collect())) == sorted(ROWS)
