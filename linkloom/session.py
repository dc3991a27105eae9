"""Session helpers: scratch tables in the shared folder, whole-row distinct, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A lookup side is broadcast only if its bytes stay under this; beyond it the join is shuffled and hot keys are split.
BROADCAST_BYTES = 16 << 20

#: The run's own folder below the scratch root, removed when the driver ends.
_RUN = f"linkloom-{uuid.uuid4().hex}"
_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder all executors share, from spark.checkpoint.dir. A temporary one of this machine only where that is unset and
    the session runs on this machine alone; a cluster without a shared folder is refused."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or "").rstrip("/")
    key = root or spark.sparkContext.applicationId
    if key not in _roots:
        master = spark.sparkContext.master
        if not root and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        _roots[key] = root or f"file://{tempfile.mkdtemp(prefix='linkloom-')}"
        if root:
            atexit.register(remove_scratch, spark, f"{root}/{_RUN}")
        else:
            atexit.register(shutil.rmtree, _roots[key].removeprefix("file://"), ignore_errors=True)
    return _roots[key]


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Remove a run's folder, on whatever file system it lies; a session that has ended leaves only local ones to remove."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone
        if path.startswith(("file:", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{_RUN}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, and a lost executor costs a re-read only."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_rows_once(df: DataFrame) -> DataFrame:
    """Rows that repeat in every column count once. Map columns are compared by their sorted entries."""
    maps = {f.name: F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) for f in df.schema if isinstance(f.dataType, T.MapType)}
    return (df.withColumns(maps) if maps else df).distinct()


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, where a few small files would leave most of them idle; else df itself.

    For steps that compute much per row. Input with a file per core, or of more than 4 MB per core, is not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores and size < cores * (4 << 20) else df


def distinct_over(df: DataFrame) -> DataFrame:
    """Distinct rows, left in spark.sql.shuffle.partitions partitions even if small: much is computed per row next."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *df.columns).distinct()


#: Bytes that a row and a value take besides their content, at least.
ROW_BYTES, VALUE_BYTES = 16, 8


def content_bytes(schema: T.StructType) -> Column:
    """Bytes of a row as it would be held for a broadcast, at least; values of variable length are measured, not guessed."""
    out = F.lit(ROW_BYTES + VALUE_BYTES * len(schema)).cast("long")
    for f in schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out = out + 2 * F.coalesce(F.octet_length(c.cast("string")), F.lit(0))
    return out


def fits_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written table may be broadcast: its content is added up, unless its rows alone are too many."""
    if table.count() * (ROW_BYTES + VALUE_BYTES * len(table.columns)) > limit:
        return False
    return (table.agg(F.sum(content_bytes(table.schema))).first()[0] or 0) <= limit


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", written: bool = False, salts: int = 32) -> DataFrame:
    """Join left to a lookup side, whatever the skew of left's keys. Null keys match nothing.

    The lookup side is written (unless `written` says that it is a table already), measured, and broadcast if its bytes
    stay within BROADCAST_BYTES. Otherwise both sides are shuffled on the key once: partitions that hot keys of left make
    too large are split while the join runs (adaptive skew join). Where the session has that switched off, left is
    salted instead.
    """
    spark = left.sparkSession
    right = right if written else materialize(right, "lookup")
    if fits_broadcast(right):
        return left.join(F.broadcast(right), on, how)
    if all(spark.conf.get(f"spark.sql.adaptive.{k}", "true") == "true" for k in ("enabled", "skewJoin.enabled")):
        return left.join(right, on, how)
    return salted_join(left, right, on, how, salts)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", salts: int = 32) -> DataFrame:
    """Shuffled join with left's hot keys spread over `salts` tasks.

    Hot are keys of more than 1/256 of left's rows: fewer than 256 of them, so the driver may hold and broadcast their
    list. Only their right rows are copied; all other keys have salt 0. Salts are hashes of rows, so a task that is run
    again sends each row where it went before.
    """
    left = materialize(left, "probe")
    keyed = left.where(" and ".join(f"`{k}` is not null" for k in on))
    heavy = keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(left.count() // 256, 1000))
    rows = heavy.select(*on, F.lit(True).alias("__heavy")).collect()
    if not rows:
        return left.join(right, on, how)
    kinds = T.StructType([*(T.StructField(k, left.schema[k].dataType) for k in on), T.StructField("__heavy", T.BooleanType())])
    heavy = left.sparkSession.createDataFrame([tuple(r) for r in rows], kinds)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in left.schema if not isinstance(f.dataType, T.MapType)]), F.lit(salts)).cast("int")
    tagged = left.withColumn("__spread", spread).join(F.broadcast(heavy), on, "left").withColumn("__salt", F.when(F.col("__heavy"), F.col("__spread")).otherwise(F.lit(0))).drop("__heavy", "__spread")
    copies = F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(F.broadcast(heavy), on, "left").withColumn("__salt", F.explode(copies)).drop("__heavy")
    return tagged.join(copied, [*on, "__salt"], how).drop("__salt")
