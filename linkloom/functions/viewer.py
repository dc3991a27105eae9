"""Annotated text as HTML, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import markup as m
from linkloom.session import lookup_join


def render_lines(lines: DataFrame, title_ids: DataFrame, page: str = "page_id", line_no: str = "line_no", text: str = "text") -> DataFrame:
    """(page, line_no, html) of lines. Links of entities with an id point to it, others are only coloured; links of two
    parts have no entity; '==' lines are h2, deeper ones h4, all others paragraphs."""
    raw = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    gaps = lines.select(page, line_no, raw.alias("__t"))
    parts = gaps.select(page, line_no, F.posexplode(m.link_bodies(F.col("__t"))).alias("pos", "b"))
    p = F.split("b", r"\|")
    parts = parts.withColumns({"n": F.size(p), "title": p[0], "alias": F.when(F.size(p) > 1, F.element_at(p, -2)).otherwise(p[0])})
    parts = lookup_join(parts, title_ids.select("title", F.col("page_id").alias("__id")), ["title"])
    shown = F.when(F.col("n") <= 2, F.concat(F.lit('<a class="name">'), "alias", F.lit("</a>"))).when(
        F.col("__id").isNotNull(), F.concat(F.lit('<a style="color:blue" href="?curid='), F.col("__id").cast("string"), F.lit('">'), "alias", F.lit("</a>"))
    ).otherwise(F.concat(F.lit('<a style="color:green">'), "alias", F.lit("</a>")))
    links = parts.withColumn("h", shown).groupBy(page, line_no).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]).alias("__links"))
    both = gaps.join(links, [page, line_no], "left")
    body = F.array_join(F.zip_with(F.split("__t", m.LINK, -1), F.coalesce("__links", F.array().cast("array<string>")), lambda g, h: F.concat(F.coalesce(g, F.lit("")), F.coalesce(h, F.lit("")))), "")
    return both.select(page, line_no, _tag(body).alias("html"))


def _tag(body: Column) -> Column:
    name = F.trim(F.regexp_replace(body, r"^=+|=+$", ""))
    return F.when(body.startswith("==="), F.concat(F.lit("<h4>"), name, F.lit("</h4>"))).when(body.startswith("=="), F.concat(F.lit("<h2>"), name, F.lit("</h2>"))).when(F.trim(body) == "", "").otherwise(F.concat(F.lit("<p>"), body, F.lit("</p>")))


def page_by_title(lines: DataFrame, titles: DataFrame, title_ids: DataFrame, title: str) -> DataFrame:
    """(page_id, html) of the page of one title; titles: (page_id, title). A title that is not there has no row."""
    own = lines.join(titles.where(F.col("title") == title).select("page_id"), "page_id", "left_semi")
    return render_page(own, title_ids)


def render_page(lines: DataFrame, title_ids: DataFrame, page: str = "page_id", line_no: str = "line_no", text: str = "text") -> DataFrame:
    """(page, html) of whole pages."""
    html = render_lines(lines, title_ids, page, line_no, text)
    return html.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line_no, "html"))), lambda x: x["html"]), "\n").alias("html"))
