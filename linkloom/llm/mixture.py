"""Mixing sources to target weights: whole copies where they are certain, Pareto order sampling for the rest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from linkloom.llm.tokens import DEFAULT_TOKENIZER, token_count
from linkloom.session import distinct_over, materialize

#: Buckets into which ranks are counted before the one that holds the cut is put in order.
RANK_BUCKETS = 1_024
#: A weights table is configuration: more rows than this are refused, so the driver gets a million counts at most.
MAX_SOURCES = 1_000
#: Share of a source's quota that may be missing in the end, as long as anything is left that fits.
TOLERANCE = 0.002


def source_reading(c: Column) -> Column:
    """Sources are compared without regard to case, outer white space, and the kind of separator inside."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s_\-]+", "_")


def _plan(weights: list, have: dict[str, tuple[int, int]], total: float | None) -> dict[str, dict]:
    """Per source the quota in tokens, the whole copies and the tokens left to sample."""
    live = {w["source"]: w for w in weights if have.get(w["source"], (0, 0))[0] > 0 and (w["target_share"] or 0) > 0 and (w["max_repeat"] or 0) > 0}
    share_sum = sum(w["target_share"] for w in live.values())
    most = min((have[s][0] * w["max_repeat"] / (w["target_share"] / share_sum) for s, w in live.items()), default=0.0)
    size = most if total is None else total
    plan = {}
    for s, w in live.items():
        tokens = have[s][0]
        quota = min(size * w["target_share"] / share_sum, tokens * w["max_repeat"])
        copies = min(int(quota / tokens + 1e-9), w["max_repeat"])
        plan[s] = {"quota": quota, "copies": copies, "rest": max(0.0, quota - copies * tokens) if copies < w["max_repeat"] else 0.0}
    return plan


def _scale(rest: float, groups: list[tuple[float, float]]) -> float:
    """c with sum of tokens * min(1, c * weight) = rest, over (weight, tokens)."""
    low, high = 0.0, max((1 / w for w, _ in groups if w > 0), default=1.0)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(t * min(1.0, mid * w) for w, t in groups) < rest:
            low = mid
        else:
            high = mid
    return high


def _cuts(units: DataFrame, order: str, rest: dict[str, float], width: float) -> DataFrame:
    """units (id, source, tokens, `order`) in that order as far as `rest` tokens of their source reach; the first that does
    not fit and all behind it are left out.

    The order is counted in buckets; only the bucket with the cut is sorted, so no source is one task.
    """
    spark = units.sparkSession
    given = spark.createDataFrame(list(rest.items()), "source string, rest double")
    units = units.join(F.broadcast(given), "source").withColumn("bucket", F.floor(F.col(order) * width).cast("int"))
    counted = sorted((r["source"], r["bucket"], r["t"]) for r in units.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).collect())
    cuts: dict[str, tuple[int, float]] = {}
    run: dict[str, float] = {}
    for s, b, t in counted:
        if s not in cuts and run.get(s, 0.0) + t > rest[s]:
            cuts[s] = (b, rest[s] - run.get(s, 0.0))
        run[s] = run.get(s, 0.0) + t
    edge = spark.createDataFrame([(s, *cuts.get(s, (1 << 30, 0.0))) for s in rest], "source string, cut int, missing double")
    units = units.join(F.broadcast(edge), "source")
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy(order, "id"))
    at_cut = units.where("bucket = cut").withColumn("upto", upto).where("upto <= missing")
    return units.where("bucket < cut").select("id", "source").unionByName(at_cut.select("id", "source"))


def mixture(df: DataFrame, weights: DataFrame, id_col: str, text: str = "text", source: str = "source", weight: Column | None = None, total_tokens: int | None = None, seed: int = 0, tokenizer: str = DEFAULT_TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixture (id, source, tokens, copies) and its report (source, target_share, tokens, share, documents, copies).

    weights holds source, target_share, max_repeat. Without total_tokens the mixture is as large as every source with
    documents can bear at its share; with it, sources that cannot are used max_repeat times and fall short. Shares of
    sources without documents go to the others in proportion. Whole copies of all documents of a source are certain;
    the rest is a Pareto order sample: documents are ranked by U/(1-U) over p/(1-p), U a hash of the id, p the
    inclusion probability in proportion to `weight` (default 1), and taken in that order as far as the tokens reach.
    What is then missing is filled up in the same order with documents that still fit, once more each as long as none
    is used more than max_repeat times, until TOLERANCE is met or nothing fits.

    Null and empty texts have no tokens and are left out, as are documents without a listed source. Rows that repeat as
    a whole count once.
    """
    rows = weights.select(source_reading(F.col("source")).alias("source"), "target_share", "max_repeat").distinct().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError("too many sources for a weights table")
    spark = df.sparkSession
    listed = spark.createDataFrame([(w["source"],) for w in rows], "source string")
    docs = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), source_reading(F.col(source)).alias("source"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    docs = distinct_over(docs.where("text <> '' and source is not null")).join(F.broadcast(listed), "source", "left_semi")
    sized = materialize(docs.withColumn("tokens", token_count(F.col("text"), tokenizer)).drop("text").where("tokens > 0"), "sized")
    band = F.round(F.log2("w") * 8).cast("int")
    groups = sized.groupBy("source", band.alias("band")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.avg("w").alias("w")).collect()
    have: dict[str, tuple[int, int]] = {}
    for g in groups:
        t, n = have.get(g["source"], (0, 0))
        have[g["source"]] = (t + g["tokens"], n + g["n"])
    plan = _plan(rows, have, total_tokens)
    most = {w["source"]: w["max_repeat"] for w in rows}
    scales = {s: _scale(p["rest"], [(g["w"], g["tokens"]) for g in groups if g["source"] == s]) for s, p in plan.items()}
    known = spark.createDataFrame([(s, p["copies"], most[s], float(scales[s])) for s, p in plan.items()], "source string, copies int, most int, scale double")
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    p = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), F.col("scale") * F.col("w")))
    odds = (u / (1 - u)) / (p / (1 - p))
    ranked = materialize(sized.join(F.broadcast(known), "source").select("id", "source", "tokens", "copies", "most", (odds / (1 + odds)).alias("rank")), "ranked")
    missing = {s: p["rest"] for s, p in plan.items() if p["rest"] > 0}
    extra = ranked.select("id", F.lit(0).alias("extra")).limit(0)
    if missing:
        extra = materialize(_cuts(ranked, "rank", missing, RANK_BUCKETS).select("id", F.lit(1).alias("extra")), "extra")
    while True:
        now = ranked.join(extra, "id", "left").withColumn("copies", F.col("copies") + F.coalesce("extra", F.lit(0))).drop("extra")
        used = {r["source"]: r["t"] for r in now.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
        missing = {s: p["quota"] - used[s] for s, p in plan.items() if p["quota"] - used[s] > TOLERANCE * p["quota"]}
        if not missing:
            break
        given = spark.createDataFrame([(s, float(m)) for s, m in missing.items()], "source string, gap double")
        fits = now.join(F.broadcast(given), "source").where("tokens <= gap and copies < most")
        each = fits.select("id", "source", "tokens", "rank", F.posexplode(F.sequence(F.col("copies"), F.col("most") - 1)).alias("turn", "copy")).withColumn("at", F.col("turn") + F.col("rank"))
        # few and small documents are what fits into a gap, in as many copies as they may still have
        more = materialize(_cuts(each, "at", missing, 64).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("extra")), "fill")
        if more.isEmpty():
            break
        extra = materialize(extra.unionByName(more).groupBy("id").agg(F.sum("extra").cast("int").alias("extra")), "extra")
    mixed = materialize(now.where("copies > 0").select(F.col("id").alias(id_col), "source", "tokens", "copies"), "mixture")
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").cast("long").alias("copies"))
    wanted = spark.createDataFrame([(w["source"], w["target_share"], w["max_repeat"]) for w in rows], T.StructType([T.StructField("source", T.StringType()), T.StructField("target_share", T.DoubleType()), T.StructField("max_repeat", T.IntegerType())]))
    full = wanted.join(F.broadcast(used), "source", "left").fillna(0, ["tokens", "documents", "copies"])
    size = math.fsum(r["tokens"] for r in used.collect())
    report = full.select("source", "target_share", "max_repeat", "tokens", (F.col("tokens") / F.lit(size or 1.0)).alias("share"), "documents", "copies")
    return mixed, report
