"""Quality of linking and typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "<unk_wid>"


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def linking_accuracy(predictions: DataFrame, kinds: tuple[str, ...] = ("prior", "context", "joint"), truth: str = "truth") -> DataFrame:
    """(kind, correct, known, accuracy) over rows with the true id and, per kind, the predicted id and its probability
    (<kind>_p): rows of unknown truth are left out, a prediction of probability 0 is wrong."""
    known = predictions.where(F.col(truth) != UNKNOWN)
    each = known.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), ((F.col(k) == F.col(truth)) & (F.col(f"{k}_p") != 0)).alias("ok")) for k in kinds])).alias("x")).select("x.*")
    out = each.groupBy("kind").agg(F.count_if("ok").alias("correct"), F.count(F.lit(1)).alias("known"))
    return out.withColumn("accuracy", _ratio(F.col("correct"), F.col("known")))


def typing_metrics(rows: DataFrame, predicted: str = "predicted", true: str = "true") -> DataFrame:
    """One row: strict accuracy, loose macro and loose micro precision, recall and f1 of label sets (arrays)."""
    p, t = F.array_distinct(predicted), F.array_distinct(true)
    both = F.size(F.array_intersect(p, t))
    each = rows.select((F.array_sort(p) == F.array_sort(t)).alias("same"), both.alias("both"), F.size(p).alias("np"), F.size(t).alias("nt"))
    sums = each.agg(
        F.avg(F.col("same").cast("double")).alias("strict"),
        F.avg(_ratio(F.col("both"), F.col("np"))).alias("macro_p"), F.avg(_ratio(F.col("both"), F.col("nt"))).alias("macro_r"),
        F.sum("both").alias("b"), F.sum("np").alias("p"), F.sum("nt").alias("t"),
    )
    out = sums.withColumns({"micro_p": _ratio(F.col("b"), F.col("p")), "micro_r": _ratio(F.col("b"), F.col("t"))})
    return out.select("strict", "macro_p", "macro_r", f1(F.col("macro_p"), F.col("macro_r")).alias("macro_f1"), "micro_p", "micro_r", f1(F.col("micro_p"), F.col("micro_r")).alias("micro_f1"))


def correct_context(posteriors: DataFrame, key: str, score: str, pos: str) -> DataFrame:
    """Number of keys whose first candidate has the highest score."""
    best = posteriors.groupBy(key).agg(F.min(F.struct((-F.col(score)).alias("neg"), F.col(pos).alias("pos"))).alias("b"))
    return best.agg(F.count_if(F.col("b.pos") == 0).alias("correct"), F.count(F.lit(1)).alias("mentions"))
