"""Sources: XML dumps, page files, JSON dictionaries and run settings."""

from __future__ import annotations

import configparser
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PAGE_SCHEMA = "title string, ns int, id long, redirect struct<_title:string>, revision struct<id:long,text:string>"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title, redirect_title, text) of a MediaWiki XML dump.

    The schema is fixed: only the page's own id is read, not those of revisions and contributors, and the redirect
    attribute and text need no inference over the dump. Compressed dumps are read as they are.
    """
    raw = spark.read.format("xml").option("rowTag", "page").schema(PAGE_SCHEMA).load(path)
    return raw.select(F.col("id").alias("page_id"), "title", F.col("redirect._title").alias("redirect_title"), F.coalesce("revision.text", F.lit("")).alias("text"))


def title_ids(pages: DataFrame) -> DataFrame:
    """(title, page_id): the first page, by id, of each title in any namespace."""
    return pages.where("title is not null").groupBy("title").agg(F.min("page_id").alias("page_id"))


def first_pages(pages: DataFrame) -> DataFrame:
    """The first page, by id, of each title, with all its columns."""
    order = Window.partitionBy("title").orderBy(F.col("page_id").asc_nulls_last())
    return pages.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def read_page_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text) of the text files below a folder, at any depth."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_dictionary(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(key, value) of a JSON object {key: value}; value is the type of the values, as in 'long' or 'array<string>'."""
    raw = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", T.MapType(T.StringType(), T._parse_datatype_string(value)))
    return raw.select(F.explode(parsed).alias("key", "value"))


def read_counts(spark: SparkSession, path: str, keys: str = "string") -> DataFrame:
    """(key, item, n) of a JSON object {key: {item: n}}; keys='long' reads keys and items as numbers."""
    raw = spark.read.text(path, wholetext=True)
    nested = raw.select(F.explode(F.from_json("value", "map<string,map<string,bigint>>")).alias("key", "items"))
    return nested.select(F.col("key").cast(keys).alias("key"), F.explode("items").alias("item", "n")).withColumn("item", F.col("item").cast(keys))


@dataclass(frozen=True)
class RunConfig:
    wikipath: str
    outputpath: str
    logging_path: str = ""
    processes: int = 6
    language: str = "en"
    extra: tuple = ()


def load_run_config(path: str) -> RunConfig:
    """Settings of a run from a JSON file; unknown keys are kept in extra."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    known = {k: given[k] for k in ("wikipath", "outputpath", "logging_path", "processes", "language") if k in given}
    return RunConfig(**known, extra=tuple(sorted((k, v) for k, v in given.items() if k not in known)))


def load_paths(path: str) -> dict[str, str]:
    """All options of an INI file, ${name} and ${section:name} filled in."""
    parser = configparser.ConfigParser(interpolation=configparser.ExtendedInterpolation())
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    return {f"{s}.{k}": v for s in parser.sections() for k, v in parser[s].items()}
