from sparkloom.sources import files
from sparkloom.streaming import events
from sparkloom.streaming.batch_equivalents import tumbling


def test_stream_gives_what_the_batch_gives(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/in")
    stream = events.tumbling_stream(events.event_stream(spark, f"{tmp_path}/in"), "1 hour", "30 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("tumbling").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        query.processAllAvailable()
        assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, tumbling(rows, "1 hour").collect()))
    finally:
        query.stop()


def test_duplicates_in_a_stream(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.union(rows).write.parquet(f"{tmp_path}/in")
    stream = events.unique_stream(events.event_stream(spark, f"{tmp_path}/in"), "400 days")
    query = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        query.processAllAvailable()
        assert spark.table("once").count() == rows.count()
    finally:
        query.stop()


def test_file_formats(spark, sf_dir, tmp_path):
    nation = files.read(spark, f"{sf_dir}/nation.parquet")
    for kind in ("csv", "json", "orc"):
        files.write(nation, f"{tmp_path}/{kind}", kind)
        back = files.read(spark, f"{tmp_path}/{kind}", kind, None if kind == "orc" else nation.schema)
        assert sorted(back.collect()) == sorted(nation.collect())
    files.write(nation, f"{tmp_path}/parts", by=("n_regionkey",))
    assert "PartitionFilters: [isnotnull" in files.read(spark, f"{tmp_path}/parts").where("n_regionkey = 1")._jdf.queryExecution().executedPlan().toString()
