"""A frontier as a stream: each micro-batch of discovered urls is merged into the table of seen ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.functions.web import normal_url


def new_urls(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """The first sighting of each url of a stream (url, time), in normal form, within ``delay`` of event time.

    State older than the watermark is dropped, so it does not grow with the stream.
    """
    urls = stream.withWatermark(time, delay).select(normal_url("url").alias("url"), time).where("url is not null")
    return urls.dropDuplicatesWithinWatermark(["url"])


def sightings(stream: DataFrame, time: str, delay: str, window: str) -> DataFrame:
    """Urls seen per host and window of event time; late rows count until the watermark passes."""
    host = F.regexp_extract(normal_url("url"), r"^[a-z]+://([^/]+)", 1)
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), host.alias("host")).agg(F.count("*").alias("n"))


def collect_frontier(stream: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the urls of a stream (url) that ``table`` (url, batch) does not have; safe to repeat after a failure."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(normal_url("url").alias("url")).where("url is not null").distinct()
        if spark.catalog.tableExists(table):
            fresh = fresh.join(spark.table(table).select("url"), "url", "left_anti")
        fresh.withColumn("batch", F.lit(number).cast("bigint")).write.mode("append").saveAsTable(table)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
