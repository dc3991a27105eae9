"""Sinks: partitioned pages, dictionaries, the corpus as text, archives, and resuming where an earlier run stopped."""

from __future__ import annotations

import shutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.markup import shard


def write_pages(df: DataFrame, path: str, title: str = "title") -> None:
    """Pages as Parquet in folders by the first sign of their shard; rows of a folder are brought together first."""
    top = F.substring(shard(F.col(title)), 1, 1)
    df.withColumn("shard", shard(F.col(title))).withColumn("part", top).repartition("part", F.pmod(F.xxhash64(title), F.lit(16))).write.mode("overwrite").partitionBy("part").parquet(path)


def write_classes(df: DataFrame, path: str, class_col: str = "page_class") -> None:
    df.write.mode("overwrite").partitionBy(class_col).parquet(path)


def dictionary_json(df: DataFrame, key: str, item: str, n: str) -> DataFrame:
    """(key, json) with json = {item: n, ...}, items in order. A key's items must fit one row; see dictionary_lines."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(item).alias("item"), F.col(n).alias("n"))))
    return df.groupBy(F.col(key).alias("key")).agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def dictionary_lines(df: DataFrame, key: str, item: str, n: str) -> DataFrame:
    """One JSON line per entry, for keys of any size."""
    return df.select(F.to_json(F.struct(F.col(key).alias("key"), F.col(item).alias("item"), F.col(n).alias("n"))).alias("value"))


def corpus_blocks(df: DataFrame, name: Column, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(keep, name, block): header line, body and four line breaks per document."""
    return df.select(*(keep or []), name.alias("name"), F.concat(F.lit("###FILENAME### "), name, F.lit("\n"), F.col(text), F.lit("\n\n\n\n")).alias("block"))


def write_corpus(df: DataFrame, name: Column, path: str, text: str = "text") -> None:
    """The corpus as text files, documents in the order of their names across files."""
    corpus_blocks(df, name, text).repartitionByRange("name").sortWithinPartitions("name").select(F.regexp_replace("block", r"\n\z", "")).write.mode("overwrite").text(path)  # the writer ends each block's last line


def publish(spark: SparkSession, source: str, target: str) -> None:
    """Copy a table under its public name, unless it is there already."""
    spark.read.parquet(source).write.mode("ignore").parquet(target)


def archive(path: str, target: str) -> str:
    """Zip a local folder; returns the archive's name."""
    return shutil.make_archive(target, "zip", path)


def still_to_do(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key an earlier run has not written."""
    return df.join(done.select(key).distinct(), key, "left_anti")
