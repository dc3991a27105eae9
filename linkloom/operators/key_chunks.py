"""Per-key results without imbalance, by exact offset chunking.

Rows are first added up inside each input partition, so that a key that holds most rows is small before anything moves.
What is left is put into one global order of key and value that may cut a key, and even a value, anywhere; rows are
counted per partition, prefix sums of the counts give each partition its offset, and offset plus place numbers every row
exactly. Equal runs of numbers are the chunks: each is reduced where it lies, without a further shuffle. A value, or a
key, can go on beyond its chunk only at the chunk's ends, so of each chunk only the two values at its ends and the
states of the two keys there are handed on and merged with those of the neighbours; all other keys are finished.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.session import materialize, scratch_path

#: Rows of a chunk.
CHUNK_ROWS = 262_144
#: Rows that a task adds up at a time.
TASK_ROWS = 1_000_000


def number_rows(df: DataFrame, order: list[str], partitions: int | None = None, name: str = "position") -> DataFrame:
    """df with `position` (or another name): 0, 1, 2, ... in the order of the given columns, without gaps and without a single-task sort.

    The sort cuts ranges by all order columns, so equal leading keys spread over partitions. Counts per partition come
    to the driver: one row per partition, never per key. An empty input gives an empty result. Rows that are equal in
    all order columns stay in one range, whichever comes first.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ordered")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(*order).write.parquet(path)
    ordered = spark.read.schema(T.StructType([*df.schema, T.StructField("__part", T.IntegerType())])).parquet(path)
    ordered = ordered.withColumns({"__file": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")})
    counts = sorted((r["__part"], r["__file"], r["n"]) for r in ordered.groupBy("__part", "__file").agg(F.count(F.lit(1)).alias("n")).collect())
    starts = [0, *accumulate(c[2] for c in counts)][:-1] if counts else []
    offsets = spark.createDataFrame([(f, s) for (_, f, _), s in zip(counts, starts)], "__file string, __start long")
    # one row per partition file: bounded by the number of partitions
    return ordered.join(F.broadcast(offsets), "__file").withColumn(name, F.col("__start") + F.col("__row")).drop("__file", "__row", "__start", "__part")


def _new(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """Whether each row differs from the one before it in any of the columns; nulls are equal to each other."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        c = c.combine_chunks()
        a, b = c.slice(1), c.slice(0, n - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return new


def _own_sums(names: list[str], weight: str):
    """Rows of a task with equal names added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= TASK_ROWS:
                yield from summed(held)
                held, rows = [], 0
        if rows:
            yield from summed(held)

    def summed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by(names).aggregate([(weight, "sum")])
        return t.rename_columns([*names, weight]).select([*names, weight]).to_batches()

    return run


def _chunk_states(keys: list[str], value: str, chunk_rows: int):
    """Rows (keys, value, total, what) of each stretch of numbered rows inside one chunk: 'final' for the best value of a
    key that lies inside, 'state' for that of the keys at the ends, 'end' for the two values at the ends."""

    def reduced(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        key_new = _new([t[k] for k in keys])
        runs = np.flatnonzero(key_new | _new([t[value]]))
        total = np.add.reduceat(t["total"].to_numpy(), runs)
        key_of = np.cumsum(key_new)[runs] - 1
        inside = np.ones(len(runs), dtype=bool)
        inside[[0, -1]] = False
        # the largest total of each key, the first value, which is the smallest, among equals
        at = np.flatnonzero(inside)
        order = at[np.lexsort((at, -total[at], key_of[at]))]
        best = order[np.flatnonzero(np.diff(key_of[order], prepend=-1))] if len(order) else order
        what = np.where((key_of[best] == 0) | (key_of[best] == key_of[-1]), "state", "final")
        ends = np.array([0, len(runs) - 1])[: 1 if len(runs) == 1 else 2]
        rows = np.concatenate([best, ends])
        picked = t.select([*keys, value]).take(pa.array(runs[rows]))
        columns = [c.combine_chunks() for c in picked.columns]
        columns += [pa.array(total[rows], pa.int64()), pa.array([*what.tolist(), *["end"] * len(ends)], pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*keys, value, "total", "what"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            position = b.column("__position").to_numpy()
            cuts = np.flatnonzero((np.diff(position // chunk_rows) != 0) | (np.diff(position) != 1)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(position)]):
                if s == e:
                    continue
                if held and (position[s] != last + 1 or position[s] % chunk_rows == 0):
                    yield reduced(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(s, e - s))
                last = position[e - 1]
        if held:
            yield reduced(pa.Table.from_batches(held))

    return run


def strongest_value(df: DataFrame, keys: list[str], value: str, weight: str, chunk_rows: int = CHUNK_ROWS, partitions: int | None = None) -> DataFrame:
    """Per key the value with the largest sum of weight, the smallest value among equals: (keys, winner, total).

    Rows with a null value take no part; null weights add 0. Keys may be null (null is a key of its own). A chunk that
    is read in two parts is two chunks: what holds for its ends holds for theirs.
    """
    names = [*keys, value]
    rows = df.where(F.col(value).isNotNull()).select(*names, F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("total"))
    shape = T.StructType([*rows.schema.fields[:-1], T.StructField("total", T.LongType())])
    own = materialize(rows.mapInArrow(_own_sums(names, "total"), shape), "sums")  # read twice: for the ranges and for the order
    numbered = number_rows(own, names, partitions, "__position")
    made = materialize(numbered.mapInArrow(_chunk_states(keys, value, chunk_rows), T.StructType([*shape.fields, T.StructField("what", T.StringType())])), "states")
    done = made.where("what = 'final'").select(*keys, F.col(value).alias("winner"), "total")
    # two values and two keys a chunk: what the neighbours have of them is added up, then compared
    ends = made.where("what = 'end'").groupBy(*names).agg(F.sum("total").alias("total"))
    open_ = ends.unionByName(made.where("what = 'state'").select(*names, "total"))
    best = F.min(F.struct((-F.col("total")).alias("neg"), F.col(value).alias("v")))
    merged = open_.groupBy(*keys).agg(best.alias("s")).select(*keys, F.col("s.v").alias("winner"), (-F.col("s.neg")).alias("total"))
    return done.unionByName(merged)
