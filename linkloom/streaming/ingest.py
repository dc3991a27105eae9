"""Streaming ingest: page files that arrive one by one, routed and counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import markup as m
from linkloom.langpack import ENGLISH, LanguagePack
from linkloom.operators.routing import is_media, route


def page_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """Stream of Parquet page files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def routed(pages: DataFrame, title: str = "title", pack: LanguagePack = ENGLISH) -> DataFrame:
    return pages.withColumn("kind", route(F.col(title), pack)).where("kind is not null")


def alias_counts(pages: DataFrame, text: str = "text", pack: LanguagePack = ENGLISH) -> DataFrame:
    """Running (alias, entity, n), for output mode update or complete."""
    links = pages.select(F.explode(m.links(F.col(text))).alias("l")).select("l.alias", "l.entity")
    return links.where(~is_media(F.col("entity"), pack)).groupBy("alias", "entity").agg(F.count(F.lit(1)).alias("n"))


def revisions_per_window(pages: DataFrame, at: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(from, pages) per event-time window; rows later than `late` behind the newest are left out, and state with them."""
    timed = pages.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.window("__at", window).alias("w")).agg(F.count(F.lit(1)).alias("pages")).select(F.col("w.start").alias("from"), "pages")


def once_per_key(pages: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """Pages delivered again within the watermark pass once."""
    return pages.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all that is there; the whole result of the last batch, as files that a later batch replaces."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str):
    """Process all that is there into an in-memory table, for tests and small summaries."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
