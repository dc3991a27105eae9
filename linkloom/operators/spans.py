"""Operators on spans [start, end) inside a page or line: overlap, adjacency, nearness, visibility, merging.

Overlap is decided by sweeping sorted ends with a running maximum, never by listing pairs; only interval_join, whose
result is pairs, joins spans, cell by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.session import materialize


def _over(keys: list[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def free_spans(new: DataFrame, occupied: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Rows of new that overlap no row of occupied with equal keys. Empty occupied spans overlap nothing."""
    a = new.withColumns({"__at": F.col(end), "__occ": F.lit(0), "__reach": F.lit(None).cast("long")})
    b = occupied.select(*keys, F.col(start).alias("__at"), F.lit(1).alias("__occ"), F.col(end).cast("long").alias("__reach")).where("__reach > __at")
    both = a.unionByName(b, allowMissingColumns=True)
    # in front of the new span's end: all occupied spans that begin before it
    reach = F.max("__reach").over(_over(keys, "__at", "__occ").rowsBetween(Window.unboundedPreceding, -1))
    swept = both.withColumn("__max", reach).where("__occ = 0")
    free = F.col("__max").isNull() | (F.col("__max") <= F.col(start))
    return swept.where(free).drop("__at", "__occ", "__reach", "__max")


def overlap_flags(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", tie: str | None = None) -> DataFrame:
    """spans with `overlaps`: whether a span overlaps the one before or after it in start order."""
    w = _over(keys, start, end, *([tie] if tie else []))
    before, after = F.coalesce(F.lag(end).over(w) > F.col(start), F.lit(False)), F.coalesce(F.lead(start).over(w) < F.col(end), F.lit(False))
    return spans.withColumn("overlaps", before | after)


def merge_adjacent(spans: DataFrame, keys: list[str], joined: Column, start: str = "start", end: str = "end", tie: str | None = None) -> DataFrame:
    """(keys, start, end, parts): neighbours merged two and two where `joined` holds, the third of a run beginning anew.

    joined is evaluated on a span's row and may use prev_end, the end of the span before it.
    """
    w = _over(keys, start, end, *([tie] if tie else []))
    rows = spans.withColumn("prev_end", F.lag(end).over(w)).withColumn("__new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(w))
    inside = _over([*keys, "__run"], start, end, *([tie] if tie else []))
    rows = rows.withColumn("__pair", F.floor((F.row_number().over(inside) - 1) / 2))
    return rows.groupBy(*keys, "__run", "__pair").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("__run", "__pair")


def nearest_anchor(spans: DataFrame, anchors: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """spans with `distance` to the nearest anchor of equal keys (page and entity), null without one.

    To the left start is measured to start, to the right end to end.
    """
    a = spans.withColumns({"__anchor_start": F.lit(None).cast("long"), "__anchor_end": F.lit(None).cast("long"), "__kind": F.lit(1)})
    b = anchors.select(*keys, F.col(start).alias(start), F.col(end).alias(end), F.col(start).cast("long").alias("__anchor_start"), F.col(end).cast("long").alias("__anchor_end"), F.lit(0).alias("__kind"))
    both = a.unionByName(b, allowMissingColumns=True)
    left = F.last("__anchor_start", ignorenulls=True).over(_over(keys, start, "__kind").rowsBetween(Window.unboundedPreceding, -1))
    right = F.last("__anchor_end", ignorenulls=True).over(_over(keys, F.desc(end), "__kind").rowsBetween(Window.unboundedPreceding, -1))
    found = both.withColumns({"__left": left, "__right": right}).where("__kind = 1")
    return found.withColumn("distance", F.least(F.col(start) - F.col("__left"), F.col("__right") - F.col(end))).drop("__anchor_start", "__anchor_end", "__kind", "__left", "__right")


def visible(occurrences: DataFrame, declarations: DataFrame, keys: list[str], at: str, strict: bool = True) -> DataFrame:
    """Occurrences that come after the first declaration of their keys (page and entity); strict=False: or with it."""
    first = declarations.groupBy(*keys).agg(F.min(at).alias("__first"))
    seen = F.col("__first") < F.col(at) if strict else F.col("__first") <= F.col(at)
    return occurrences.join(first, keys).where(seen).drop("__first")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end", cell: int = 256) -> DataFrame:
    """Full outer join of two annotators' spans: (keys, l_start, l_end, r_start, r_end), a row per overlapping pair and
    per span that overlaps none of the other side.

    Spans meet in the cells, of `cell` positions, that they touch, so the spans of one key are compared with those near
    them only, and a key with most spans is spread over its cells; a pair counts in the first cell both touch.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*keys, F.col(start).cast("long").alias(f"{name}_start"), F.col(end).cast("long").alias(f"{name}_end"))
        return materialize(rows.withColumn(f"{name}_id", F.monotonically_increasing_id()), f"{name}_spans")

    def cells(df: DataFrame, name: str) -> DataFrame:
        low = F.floor(F.col(f"{name}_start") / cell)
        return df.withColumn(f"{name}_cell", low).withColumn("__cell", F.explode(F.sequence(low, F.greatest(low, F.floor(F.col(f"{name}_end") / cell)))))

    a, b = side(left, "l"), side(right, "r")
    meet = cells(a, "l").join(cells(b, "r"), [*keys, "__cell"])
    pairs = materialize(meet.where("l_start < r_end and r_start < l_end and __cell = greatest(l_cell, r_cell)").drop("__cell", "l_cell", "r_cell"), "pairs")
    only = [df.join(pairs.select(f"{n}_id"), f"{n}_id", "left_anti") for df, n in ((a, "l"), (b, "r"))]
    out = pairs.unionByName(only[0], allowMissingColumns=True).unionByName(only[1], allowMissingColumns=True)
    return out.select(*keys, "l_start", "l_end", "r_start", "r_end")


def overlap_islands(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """spans with `island`: spans connected by overlaps have one number, counted from 1 in start order."""
    w = _over(keys, start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach > F.col(start), 0).otherwise(1)
    return spans.withColumn("__new", new).withColumn("island", F.sum("__new").over(w)).drop("__new")


def running_offset(spans: DataFrame, keys: list[str], added: Column, start: str = "start") -> DataFrame:
    """spans with `shift`: the characters that the annotations before each add to its line."""
    w = _over(keys, start).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("shift", F.coalesce(F.sum(added).over(w), F.lit(0)))


def before_first(rows: DataFrame, keys: list[str], order: str, stop: Column) -> DataFrame:
    """Rows in front of the first row of their keys at which stop holds."""
    w = _over(keys, order)
    return rows.withColumn("__stopped", F.max(stop.cast("int")).over(w)).where("coalesce(__stopped, 0) = 0").drop("__stopped")


def previous_value(rows: DataFrame, keys: list[str], order: list[str], column: str, name: str = "previous") -> DataFrame:
    return rows.withColumn(name, F.lag(column).over(_over(keys, *order)))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (s2 < e1)
