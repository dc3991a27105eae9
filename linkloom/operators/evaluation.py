"""Two annotators side by side: comparable pages, their spans, and what each found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import markup as m
from linkloom.operators import mentions, spans


def comparison_text(text: Column) -> Column:
    """Text up to the first heading, one-sentence lines joined again."""
    return m.rejoin_lines(m.strip_space(m.intro(text)))


def comparable(left: DataFrame, right: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """(title, left_text, right_text) of pages of one title whose text without annotations is the same."""
    a = left.select(F.col(title).alias("title"), comparison_text(F.col(text)).alias("left_text"))
    b = right.select(F.col(title).alias("title"), comparison_text(F.col(text)).alias("right_text"))
    return a.join(b, "title").where(mentions.bare_text(F.col("left_text")) == mentions.bare_text(F.col("right_text")))


def found_spans(text: Column, title: Column) -> Column:
    """Spans an annotator added: neither anchors nor links of the page itself, unless these name the page."""
    return F.filter(mentions.annotation_spans(text), lambda x: F.coalesce(~x["tag"].isin("ANCHOR", "annotation"), F.lit(False)) | F.coalesce(x["entity"] == title, F.lit(False)))


def side_by_side(pairs: DataFrame) -> DataFrame:
    """(title, l_start, l_end, r_start, r_end): what both found, where they overlap, and what only one did. Neighbours with
    nothing but white space between them count as one span."""

    def side(column: str) -> DataFrame:
        rows = pairs.select("title", F.col(column).alias("t"), F.explode(found_spans(F.col(column), F.col("title"))).alias("s"))
        flat = rows.select("title", F.col("s.start").cast("long").alias("start"), (F.col("s.start") + F.col("s.len")).cast("long").alias("end"), mentions.bare_text(F.col("t")).alias("b"))
        gap = F.substring(F.col("b"), F.col("prev_end").cast("int") + 1, F.greatest((F.col("start") - F.col("prev_end")).cast("int"), F.lit(0)))
        return spans.merge_adjacent(flat, ["title"], (F.col("prev_end") <= F.col("start")) & (F.trim(gap) == ""))

    return spans.interval_join(side("left_text"), side("right_text"), ["title"])


def agreement(joined: DataFrame) -> DataFrame:
    """One row: spans both found, and those only the left and only the right one did."""
    return joined.agg(
        F.count_if(F.col("l_start").isNotNull() & F.col("r_start").isNotNull()).alias("both"), F.count_if(F.col("r_start").isNull()).alias("left_only"), F.count_if(F.col("l_start").isNull()).alias("right_only")
    )


def sample(pages: DataFrame, title: str, size: int, seed: int = 0) -> DataFrame:
    """A seeded sample of `size` distinct titles that begin with a letter: those whose hash is lowest."""
    names = pages.select(title).where(F.col(title).rlike(r"^\p{L}")).distinct()
    return names.orderBy(F.md5(F.concat(F.col(title), F.lit(str(seed)))), title).limit(size)
