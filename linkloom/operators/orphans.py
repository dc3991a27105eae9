"""References to records that do not exist: a broadcast Bloom filter proves most orphans, an exact join settles the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.session import lookup_join, materialize

#: One filter, as large as the engine's own aggregate makes them (spark.sql.optimizer.runtime.bloomFilter.maxNumBits).
SHARD_BYTES = 8 << 20
#: Filters that are broadcast at most, 256 MB: enough for 220 million keys at one false positive in a hundred. With more
#: keys more references pass on to the exact join, which settles them all the same.
MAX_SHARDS = 32


def bloom_shards(keys: DataFrame, hashed: Column, items: int, fpp: float = 0.01, shard_bytes: int = SHARD_BYTES, max_shards: int = MAX_SHARDS) -> DataFrame:
    """(shard, filter): Bloom filters of a hash column, each of the keys whose hash falls to its shard.

    As many shards as `items` keys need at the false-positive rate fpp. The engine's own aggregate merges the filters of
    the partitions.
    """
    from math import log

    from pyspark.sql.classic.column import Column as ClassicColumn

    bits = int(-max(items, 1) * log(fpp) / log(2) ** 2) + 64
    shards = min(max_shards, -(-bits // (shard_bytes * 8)))
    jvm = keys.sparkSession._jvm
    to, expressions = jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.org.apache.spark.sql.catalyst.expressions
    long = lambda n: to.expression(F.lit(n).cast("long")._jc)
    made = expressions.aggregate.BloomFilterAggregate(to.expression(hashed._jc), long(-(-max(items, 1) // shards)), long(min(bits // shards + 64, shard_bytes * 8)))
    return keys.groupBy(shard_of(hashed, shards).alias("shard")).agg(ClassicColumn(to.column(made.toAggregateExpression())).alias("filter")).withColumn("shards", F.lit(shards))


def shard_of(hashed: Column, shards: int) -> Column:
    """The filter looks at the hash's bits; which shard it is, a second hash tells."""
    return F.pmod(F.xxhash64(hashed, F.lit(shards)), F.lit(shards)).cast("int")


def might_contain(filters: DataFrame, hashed: Column) -> Column:
    """Whether a key of this hash may be among those of the filters (a written bloom_shards). Each filter is a scalar
    subquery: made on the executors, sent to all once."""
    from pyspark.sql.classic.column import Column as ClassicColumn

    jvm = filters.sparkSession._jvm
    to = jvm.org.apache.spark.sql.classic.ExpressionUtils

    def test(shard: int) -> Column:
        own = filters.where(F.col("shard") == shard).select("filter").scalar()
        found = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(to.expression(own._jc), to.expression(hashed._jc))
        return F.coalesce(ClassicColumn(to.column(found)), F.lit(False))

    shards = (filters.select("shards").first() or [1])[0]
    out = test(0)
    for k in range(1, shards):
        out = F.when(shard_of(hashed, shards) == k, test(k)).otherwise(out)
    return out


def lifetimes(parents: DataFrame, key: str, created: str, deleted: str) -> DataFrame:
    """(key, since, until, first_created): when each key existed, spans that touch or overlap made one.

    until null: still there. Rows without created never existed and only show, with since null, that the key is known.
    """
    far = F.lit("9999-12-31 23:59:59").cast(parents.schema[created].dataType)
    spans = parents.select(F.col(key).alias("key"), F.col(created).alias("since"), F.coalesce(deleted, far).alias("until")).where("key is not null")
    spans = spans.groupBy("key", "since").agg(F.max("until").alias("until")).withColumn("month", F.date_trunc("month", F.col("since").cast("timestamp")))
    # first within months, so that no key, however often it came and went, is one task's alone
    merged = _islands(_islands(spans, ["key", "month"]), ["key"])
    firsts = spans.groupBy("key").agg(F.min("since").alias("first_created"))
    return merged.join(firsts, "key").select("key", "since", F.when(F.col("until") < far, F.col("until")).alias("until"), "first_created")


def _islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of equal keys that touch or overlap as one."""
    upto = Window.partitionBy(*keys).orderBy("since")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    numbered = spans.withColumn("new", F.when(F.col("since") <= F.max("until").over(before), 0).otherwise(1)).withColumn("island", F.sum("new").over(upto))
    return numbered.groupBy(*keys, "island").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("island")


def find_orphans(refs: DataFrame, parents: DataFrame, key: str, at: str, parent_key: str, created: str, deleted: str) -> DataFrame:
    """Rows of refs whose key has no living parent at their time, with `status`.

    missing: no such parent at all; deleted: one had been created by then, but none was alive; late: all came later. A
    null key is no reference; with a null time a known key is 'late'. An empty parent table makes every row 'missing'.
    All columns of refs are kept (one named status is replaced); those of parents do not appear.
    """
    lives = materialize(lifetimes(parents, parent_key, created, deleted), "lifetimes")
    n = lives.count()
    refs = refs.where(F.col(key).isNotNull())
    if not n:
        return refs.withColumn("status", F.lit("missing"))
    kind = "string" if parents.schema[parent_key].dataType.typeName() == "string" else "long"
    hashed = F.xxhash64(F.col(key).cast(kind))
    filters = materialize(bloom_shards(lives, F.xxhash64(F.col("key").cast(kind)), n), "filters")
    maybe = might_contain(filters, hashed)
    sure = refs.where(~maybe).withColumn("status", F.lit("missing"))
    # spans of one key do not overlap, so the last one begun by then decides; a reference is looked up once
    packed = lives.groupBy("key").agg(F.min("first_created").alias("__first"), F.array_sort(F.collect_list(F.struct("since", "until"))).alias("__spans")).withColumnRenamed("key", key)
    checked = lookup_join(refs.where(maybe), packed, [key])
    alive = F.exists("__spans", lambda s: (s["since"] <= F.col(at)) & (s["until"].isNull() | (s["until"] > F.col(at))))
    status = F.when(F.col("__spans").isNull(), "missing").when(F.coalesce(alive, F.lit(False)), F.lit(None)).when(F.col("__first") <= F.col(at), "deleted").otherwise("late")
    doubtful = checked.withColumn("status", status).where("status is not null").drop("__first", "__spans")
    return sure.unionByName(doubtful)


def orphan_report(orphans: DataFrame, table: str, at: str) -> DataFrame:
    """(ref_table, ref_month, status, references) of find_orphans' rows."""
    return orphans.groupBy(F.lit(table).alias("ref_table"), F.date_format(at, "yyyy-MM").alias("ref_month"), "status").agg(F.count(F.lit(1)).alias("references"))
