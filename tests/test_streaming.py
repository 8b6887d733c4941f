"""The frontier as a stream."""

import uuid

from weftline.streaming.frontier import collect_frontier, new_urls, sightings


def write(spark, path, rows):
    spark.createDataFrame(rows, "url string, seen string").selectExpr("url", "CAST(seen AS TIMESTAMP) AS seen").coalesce(1).write.mode("append").parquet(path)


def test_frontier_is_merged_once(spark, tmp_path):
    src, name = str(tmp_path / "in"), "frontier_" + uuid.uuid4().hex
    write(spark, src, [("http://A.test", "2024-01-01 00:00:00"), ("http://a.test/", "2024-01-01 00:00:01"), ("mailto:x", "2024-01-01 00:00:02")])
    run = lambda: collect_frontier(spark.readStream.schema("url string, seen timestamp").parquet(src), name, str(tmp_path / "cp")).awaitTermination()
    try:
        run()
        write(spark, src, [("http://a.test/", "2024-01-01 00:01:00"), ("http://b.test/", "2024-01-01 00:01:00")])
        run()
        run()
        assert sorted(r.url for r in spark.table(name).collect()) == ["http://a.test/", "http://b.test/"]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_windows_and_first_sightings(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [("http://a.test/", "2024-01-01 00:00:00"), ("http://a.test/", "2024-01-01 00:00:30"), ("http://b.test/", "2024-01-01 00:05:00")])
    stream = lambda: spark.readStream.schema("url string, seen timestamp").parquet(src)
    for i, (df, mode) in enumerate([(new_urls(stream(), "seen", "10 minutes"), "append"), (sightings(stream(), "seen", "10 minutes", "1 minute"), "complete")]):
        query = df.writeStream.format("memory").queryName(f"out{i}").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{i}")).start()
        query.awaitTermination()
    assert sorted(r.url for r in spark.table("out0").collect()) == ["http://a.test/", "http://b.test/"]
    assert sorted((r.host, r.n) for r in spark.table("out1").collect()) == [("a.test", 2), ("b.test", 1)]
