from pyspark.sql import functions as F

from paperloom.streaming import arrivals

SF = "/root/testdata/sf0.001"
KEYS = "seq bigint, openalex_id string, corpus_id string, title string, year int, venue string, citation_count int, round int, source string, keywords string, parent_id string, search_rank int"


def test_windows_match_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = arrivals.read(spark, str(tmp_path / "in"), events._jdf.schema().toDDL())
    q = arrivals.discoveries_by_window(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("kind")).count()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()
    assert spark.table("w").count() == want.count()


def test_store_upsert_by_batches(spark, tmp_path):
    rows = [(i, f"W{i % 3}", None, f"t{i}", 2000, "", i, 0, "search", "k", None, None) for i in range(6)]
    for n in (0, 1):
        spark.createDataFrame(rows[n * 3 : n * 3 + 3], KEYS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = arrivals.read(spark, str(tmp_path / "in"), KEYS, per_trigger=1)
    q = stream.writeStream.foreachBatch(arrivals.upsert_sink(str(tmp_path / "store"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "store").glob("version=*"))
    got = spark.read.parquet(str(tmp_path / "store" / f"version={last}"))
    assert got.count() == 3 and got.select(F.sum(F.size("history"))).first()[0] == 6
