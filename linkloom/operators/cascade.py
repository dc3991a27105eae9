"""The candidate cascade: one ordered CASE over facts joined to each mention; the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import markup as m
from linkloom.operators import dictionary
from linkloom.session import lookup_join, materialize

# Labels of values, which never name an entity.
VALUE_TAGS = ("DATE", "TIME", "DURATION", "SET", "MONEY", "PERCENT", "ORDINAL")
JOIN = "###"


def _present(a: Column) -> Column:
    return F.coalesce(F.size(a) > 0, F.lit(False))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def resolve(facts: DataFrame, best_links: bool = True) -> DataFrame:
    """facts with `resolved` (entity or null) and `final_tag` (null: bare text).

    Columns read: alias, tag, entity (of links and acronyms met by the recogniser), previous_alias, is_title,
    seen_entity, seen_redirect, popular_entity, popular_redirect (entity names or null), candidates (sorted array),
    all_persons, best_linked, line_candidates (array), human, geo (booleans), part_of (array). best_links=False leaves
    the rule by links out. Null facts count as false or empty.
    """
    c = F.col
    tag, alias, n = c("tag"), c("alias"), F.coalesce(F.size("candidates"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    in_line = F.coalesce(F.size("line_candidates"), F.lit(0))
    joined = lambda a: F.array_join(a, JOIN)
    numeric = m.is_number(alias)
    link = tag == "annotation"
    rules: list[tuple[Column, Column | None, Column | None]] = [
        (F.coalesce(alias, F.lit("")) == "", None, None),
        (tag.isin(*VALUE_TAGS), None, tag),
        (tag == "acronym_entity", alias, tag),
        ((tag == "acronym") & c("previous_alias").isNotNull(), c("previous_alias"), tag),
        (link & (m.starts_upper(alias) | numeric), c("entity"), tag),
        (link, None, None),
        (_yes(c("is_title")), c("title"), F.concat(tag, F.lit("_article_entity"))),
        (c("seen_entity").isNotNull(), c("seen_entity"), F.concat(tag, F.lit("_match_candidate"))),
        (c("seen_redirect").isNotNull(), c("seen_redirect"), F.concat(tag, F.lit("_redirect_candidate"))),
        (c("popular_entity").isNotNull(), c("popular_entity"), F.concat(tag, F.lit("_popular_entity"))),
        (c("popular_redirect").isNotNull(), c("popular_redirect"), F.concat(tag, F.lit("_popular_redirect"))),
        (n == 1, F.element_at("candidates", 1), F.concat(tag, F.lit("_single_candidate"))),
        (F.lit(best_links) & (n > 1) & _yes(c("all_persons")) & c("best_linked").isNotNull(), c("best_linked"), F.concat(tag, F.lit("_best_links"))),
        ((n > 1) & (in_line == 1), F.element_at("line_candidates", 1), F.concat(tag, F.lit("_single_line_candidate"))),
        ((n > 1) & (in_line > 1), joined("line_candidates"), F.concat(tag, F.lit("_multiple_line_candidates"))),
        (n > 1, joined("candidates"), F.concat(tag, F.lit("_multiple_candidates"))),
        (_yes(c("human")), alias, F.concat(tag, F.lit("_human_disambiguation"))),
        (_yes(c("geo")), alias, F.concat(tag, F.lit("_geo_disambiguation"))),
        (_present(c("part_of")), joined("part_of"), F.concat(tag, F.lit("_part_of_seen_entity"))),
    ]
    entity, label = c("entity"), tag
    none = F.lit(None).cast("string")
    for when, value, name in reversed(rules):
        hit = F.coalesce(when, F.lit(False))
        entity = F.when(hit, none if value is None else value).otherwise(entity)
        label = F.when(hit, none if name is None else name).otherwise(label)
    return facts.withColumns({"resolved": entity, "final_tag": label})


def gather_facts(mentions: DataFrame, counts: DataFrame, redirects: DataFrame, popular: DataFrame, edges: DataFrame, ids: DataFrame, persons: DataFrame, human: DataFrame, geo: DataFrame, linked_id: str = "page_id") -> DataFrame:
    """The facts `resolve` reads, for mentions (page_id, title, line_no, start, alias, entity, tag).

    A seen entity is one linked in this line or an earlier one, later links of the same line included. counts (alias,
    entity, n), redirects (source, target), popular (entity), edges (src_id, dst_id, n), ids (title, page_id), persons
    (entity), human and geo (title) may be of any size: each is joined by its key, none is sent whole. linked_id is the
    column of mentions with the page's id in edges, where page_id is another key.
    """
    one = mentions.withColumn("__m", F.struct("page_id", "line_no", "start", "alias"))
    counts, redirects = materialize(counts, "counts"), materialize(redirects, "redirects")
    line = Window.partitionBy("page_id", "line_no").orderBy("start")
    one = one.withColumn("previous_alias", F.lag("alias").over(line))
    seen = one.where("tag = 'annotation'").groupBy("page_id", "entity").agg(F.min("line_no").alias("__since"))
    redirect = redirects.select(F.col("source").alias("alias"), F.col("target").alias("__to"))
    one = lookup_join(one, redirect, ["alias"])

    def see(df: DataFrame, on: str, name: str) -> DataFrame:
        s = seen.select("page_id", F.col("entity").alias("__k"), F.col("__since").alias("__s"))
        found = df.withColumn("__k", F.col(on)).join(s, ["page_id", "__k"], "left")
        return found.withColumn(name, F.when(F.col("__s") <= F.col("line_no"), F.col(on))).drop("__k", "__s")

    def flag(df: DataFrame, on: str, side: DataFrame, name: str, value: Column | None = None) -> DataFrame:
        s = side.select(F.col(side.columns[0]).alias("__k")).distinct().withColumn("__f", F.lit(True))
        return lookup_join(df.withColumn("__k", F.col(on)), s, ["__k"]).withColumn(name, F.col("__f") if value is None else F.when(F.col("__f"), value)).drop("__k", "__f")

    one = see(see(one, "alias", "seen_entity"), "__to", "seen_redirect")
    one = flag(flag(one, "alias", popular.select("entity"), "popular_entity", F.col("alias")), "__to", popular.select("entity"), "popular_redirect", F.col("__to"))
    one = flag(flag(one, "alias", human.select("title"), "human"), "alias", geo.select("title"), "geo")
    one = materialize(one, "facts")
    open_ = one.where("tag <> 'annotation'").select("__m", "page_id", F.col(linked_id).alias("__page"), "title", "line_no", "alias").distinct()
    pairs = materialize(lookup_join(open_, counts.select("alias", "entity"), ["alias"], "inner"), "pairs")
    of = pairs.groupBy("__m").agg(F.array_sort(F.collect_set("entity")).alias("candidates"), F.max(F.col("entity") == F.col("title")).alias("__own"))
    here = one.where("tag = 'annotation'").select("page_id", "line_no", "entity").distinct()
    inline = pairs.join(here, ["page_id", "line_no", "entity"]).groupBy("__m").agg(F.array_sort(F.collect_set("entity")).alias("line_candidates"))
    all_persons = dictionary.all_entities_in(pairs, "__m", persons).withColumnRenamed("all_in", "all_persons")
    numbered = lookup_join(pairs, ids.select(F.col("title").alias("entity"), F.col("page_id").alias("entity_id")), ["entity"], "inner")
    linked = dictionary.best_linked(numbered.drop("page_id").withColumnRenamed("__page", "page_id"), edges, "__m").select("__m", F.col("entity").alias("best_linked"))
    words = seen.select("page_id", "__since", F.col("entity").alias("__e"), F.explode(F.split("entity", r"\s+")).alias("alias")).where(m.starts_upper(F.col("alias")))
    part = open_.join(words, ["page_id", "alias"]).where("__since <= line_no").groupBy("__m").agg(F.array_sort(F.collect_set("__e")).alias("part_of"))
    for side in (of, inline, all_persons, linked, part):
        one = one.join(side, "__m", "left")
    return one.withColumn("is_title", (F.col("alias") == F.col("title")) | F.coalesce("__own", F.lit(False))).drop("__m", "__to", "__own")
