"""Far too many small files: consolidate them by copying encoded blocks, and tell copies from revisions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.readings import text_reading, title_reading
from linkloom.session import lookup_join, materialize, scratch_path

#: Size to which files are filled.
TARGET_BYTES = 128 << 20
#: Blocks that one file holds at most, so that its footer stays small: blocks are copied as they are, tiny ones stay tiny.
FILE_BLOCKS = 20_000
#: Files whose places one task decides.
PLAN_FILES = 50_000


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    uri = uri.replace("file:///", "/").replace("file:/", "/") if uri.startswith("file:") else uri
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    from linkloom.sources.parquet_blocks import read_footer

    for batch in batches:
        found = []
        for path in batch["path"]:
            f = read_footer(*_open(path))
            found.append((path, hashlib.sha256(f.signature).hexdigest(), f.size, f.rows, len(f.groups)))
        yield pd.DataFrame(found, columns=["path", "signature", "bytes", "rows", "blocks"])


def _copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from linkloom.sources.parquet_blocks import append_files, read_footer

    for batch in batches:
        done = []
        for _, b in batch.iterrows():
            filesystem, target = _open(b["target"])
            part = f"{target.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}.part"  # an attempt's own name, hidden from readers
            rows, blocks = append_files(filesystem, [_open(p)[1] for p in b["paths"]], part)
            written = read_footer(filesystem, part)
            if (rows, blocks) != (b["rows"], b["blocks"]) or (written.rows, len(written.groups)) != (rows, blocks):
                raise ValueError(f"{b['target']}: {rows} rows in {blocks} blocks, expected {b['rows']} in {b['blocks']}")
            filesystem.move(part, target)  # the last of several attempts wins with equal bytes
            done.append((b["target"], len(b["paths"]), rows, blocks, filesystem.get_file_info(target).size))
        yield pd.DataFrame(done, columns=["path", "files", "rows", "blocks", "bytes"])


def _packed(target_dir: str, target_bytes: int):
    """The target files of one group of sources: filled in path order up to target_bytes and FILE_BLOCKS."""

    def run(files: pd.DataFrame) -> pd.DataFrame:
        files = files.sort_values("path")
        name = f"{target_dir}/part-{files['signature'].iloc[0][:8]}-{files['shard'].iloc[0]:05d}"
        bins: list[dict] = []
        for f in files.itertuples():
            last = bins[-1] if bins else None
            if not last or last["bytes"] + f.bytes > target_bytes or last["blocks"] + f.blocks > FILE_BLOCKS:
                bins.append(last := {"target": f"{name}-{len(bins):06d}.parquet", "paths": [], "rows": 0, "blocks": 0, "bytes": 0})
            last["paths"].append(f.path)
            for k in ("rows", "blocks", "bytes"):
                last[k] += getattr(f, k)
        return pd.DataFrame(bins)

    return run


def consolidate(spark: SparkSession, paths: list[str] | DataFrame, target_dir: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Copy Parquet files into few larger ones under target_dir: (path, files, rows, blocks, bytes) per written file.

    paths is a list or a table (path). Files of one schema are packed, in path order, until target_bytes; no page is
    decoded. Schema, block counts and row totals are checked for each written file and in total. No files, or files
    without rows, give files without rows or none. Footers are read, places decided and blocks copied in tasks: the
    driver handles totals only.
    """
    listed = spark.createDataFrame([(p,) for p in paths], "path string") if isinstance(paths, list) else paths.select("path")
    n = listed.count() if not isinstance(paths, list) else len(paths)
    feet = materialize(listed.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism)), "path").mapInPandas(_footers, "path string, signature string, bytes long, rows long, blocks long"), "footers")
    filesystem, root = _open(target_dir)
    filesystem.create_dir(root, recursive=True)
    sharded = feet.withColumn("shard", F.pmod(F.xxhash64("path"), F.lit(-(-max(n, 1) // PLAN_FILES))).cast("int"))
    plan = materialize(sharded.groupBy("signature", "shard").applyInPandas(_packed(target_dir, target_bytes), "target string, paths array<string>, rows long, blocks long, bytes long"), "plan")
    done = materialize(plan.repartition(max(1, plan.count()), "target").mapInPandas(_copies, "path string, files long, rows long, blocks long, bytes long"), "consolidated")
    read, written = (t.agg(F.coalesce(F.sum("rows"), F.lit(0)), files).first() for t, files in ((feet, F.count(F.lit(1))), (done, F.coalesce(F.sum("files"), F.lit(0)))))
    if tuple(read) != tuple(written):
        raise ValueError(f"rows or files are missing after consolidation: {tuple(read)} read, {tuple(written)} written")
    return done


def consolidated(df: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """A file table read from its files after these were consolidated in the shared folder."""
    spark = df.sparkSession
    target = scratch_path(spark, "consolidated")
    done = consolidate(spark, df.inputFiles(), target, target_bytes)
    if (done.agg(F.sum("rows")).first()[0] or 0) != df.count():
        raise ValueError("the consolidated table has other rows than the table read")
    return spark.read.schema(df.schema).parquet(target)


def content_key(title: str, text: str) -> list:
    """Columns that are equal for rows with the same title reading and text reading: the title and a SHA-256 of the text."""
    t = F.col(text)
    return [F.coalesce(title_reading(F.col(title)), F.lit("\0")).alias("__title"), F.coalesce(F.sha2(text_reading(t), 256), F.lit("")).alias("__text")]


def delivered_once(df: DataFrame, id_col: str = "file_id", title: str = "title", text: str = "text") -> DataFrame:
    """(id, copy_of): per row the smallest id with the same title and text; copy_of equals id for the row that is held.

    Null titles are equal to each other only, as are null texts. Rows that repeat as a whole have one id and stay one row.
    Groups are reduced with map-side combine and looked up again, so a text that is a third of all rows is no hot task.
    """
    keyed = df.select(F.col(id_col).alias("__id"), *content_key(title, text)).distinct()
    keyed = materialize(keyed, "content")
    groups = keyed.groupBy("__title", "__text").agg(F.min("__id").alias("copy_of"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return lookup_join(keyed, groups, ["__title", "__text"]).select(F.col("__id").alias(id_col), F.coalesce("copy_of", "__id").alias("copy_of"))
