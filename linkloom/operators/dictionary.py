"""Alias and link dictionaries: counting, redirect resolution, case folding and pruning, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import markup as m
from linkloom.langpack import ENGLISH, LanguagePack
from linkloom.operators.routing import is_media
from linkloom.session import lookup_join, materialize, salted_join


def page_links(pages: DataFrame, key: str, text: str = "text", pattern: str = m.LINK_WITH_BRACKETS) -> DataFrame:
    """(key, pos, entity, alias): the links of each page in text order."""
    return pages.select(key, F.posexplode(m.links(F.col(text), pattern)).alias("pos", "l")).select(key, "pos", "l.entity", "l.alias")


def resolve_redirects(df: DataFrame, redirects: DataFrame, column: str = "entity") -> DataFrame:
    """column replaced by its redirect's target, one step, where there is one. redirects: (source, target), source unique."""
    to = redirects.select(F.col("source").alias(column), F.col("target").alias("__target"))
    return lookup_join(df, to, [column]).withColumn(column, F.coalesce("__target", column)).drop("__target")


def alias_counts(links: DataFrame, redirects: DataFrame, pack: LanguagePack = ENGLISH) -> DataFrame:
    """(alias, entity, n) of links to articles; counts are made before redirects are looked up, so hot names move once."""
    counted = links.where(~is_media(F.col("entity"), pack)).groupBy("alias", "entity").agg(F.count(F.lit(1)).alias("n"))
    return resolve_redirects(counted, redirects).groupBy("alias", "entity").agg(F.sum("n").alias("n"))


def merge_alias_counts(partial: DataFrame, alias: Column | None = None) -> DataFrame:
    """(alias, entity, n) of partial counts, aliases trimmed and without a trailing 's or '; empty ones are dropped."""
    name = m.alias_trim(F.col("alias") if alias is None else alias)
    return partial.select(name.alias("alias"), "entity", "n").where("alias is not null").groupBy("alias", "entity").agg(F.sum("n").alias("n"))


def link_edges(links: DataFrame, title_ids: DataFrame, src: str) -> DataFrame:
    """(src_id, dst_id, n): links whose entity has an id."""
    counted = links.groupBy(F.col(src).alias("src_id"), F.col("entity").alias("title")).agg(F.count(F.lit(1)).alias("n"))
    ids = title_ids.select("title", F.col("page_id").alias("dst_id"))
    return lookup_join(counted, ids, ["title"], "inner").groupBy("src_id", "dst_id").agg(F.sum("n").alias("n"))


def merge_edges(partial: DataFrame) -> DataFrame:
    return partial.groupBy("src_id", "dst_id").agg(F.sum("n").alias("n"))


def prune_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of which both ends are in ids (id)."""
    kept = ids.select("id").distinct()
    return edges.join(kept.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(kept.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")


def redirects_reverse(redirects: DataFrame) -> DataFrame:
    """(target, sources): sorted sources of each target."""
    return redirects.groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def page_categories(pages: DataFrame, title: str = "title", text: str = "text", pack: LanguagePack = ENGLISH) -> DataFrame:
    """(title, pos, category)."""
    return pages.select(F.col(title).alias("title"), F.posexplode(m.categories(F.col(text), pack)).alias("pos", "category"))


def disambiguation_entries(pages: DataFrame, key: str, text: str = "text", pack: LanguagePack = ENGLISH) -> DataFrame:
    """(key, pos, entity): first link of each line before the first closing section; pos counts lines."""
    lines = pages.select(key, F.posexplode(F.split(m.cut_sections(F.col(text), pack), "\n")).alias("pos", "line"))
    return lines.select(key, "pos", m.link_entity(F.regexp_extract("line", m.LINK, 1)).alias("entity")).where("entity <> ''")


def fold_case(df: DataFrame, titles: DataFrame, column: str = "entity") -> DataFrame:
    """column as the title that exists: with its first letter in lower case, else in upper case; rows without one go."""
    first = F.substring(column, 1, 1)
    rest = F.substring(F.col(column), 2, 1 << 30)
    names = titles.select(F.col("title"))
    both = df.withColumn("__low", F.concat(F.lower(first), rest)).withColumn("__up", F.concat(F.upper(first), rest))
    both = lookup_join(both, names.select(F.col("title").alias("__low"), F.lit(True).alias("__has_low")).distinct(), ["__low"])
    both = lookup_join(both, names.select(F.col("title").alias("__up"), F.lit(True).alias("__has_up")).distinct(), ["__up"])
    found = F.when(F.col("__has_low"), F.col("__low")).when(F.col("__has_up"), F.col("__up"))
    return both.withColumn(column, found).where(F.col(column).isNotNull()).drop("__low", "__up", "__has_low", "__has_up")


def prune_aliases(counts: DataFrame, titles: DataFrame, excluded: DataFrame, least: int = 2) -> DataFrame:
    """(alias, entity, n) fit for matching: aliases of more than one sign, entities not excluded (title), at least
    `least` uses of the pair as counted, entities as existing titles, counts added up again."""
    kept = counts.where((F.char_length("alias") > 1) & (F.col("n") >= least))
    kept = kept.join(excluded.select(F.col("title").alias("entity")).distinct(), "entity", "left_anti")
    return fold_case(kept, titles).groupBy("alias", "entity").agg(F.sum("n").alias("n"))


def named_entities(counts: DataFrame) -> DataFrame:
    """Counts of entities used with a capital at least as often as without; a digit is no capital."""
    upper = m.starts_upper(F.col("alias"))
    names = counts.groupBy("entity").agg(F.sum(F.when(upper, F.col("n")).otherwise(-F.col("n"))).alias("more")).where("more >= 0")
    return counts.join(names.select("entity"), "entity", "left_semi")


def popular(counts: DataFrame, top: int = 10_000) -> DataFrame:
    """(entity, n): the entities used most; the name decides between equals."""
    return counts.groupBy("entity").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "entity").limit(top)


def surviving_titles(titles: DataFrame, counts: DataFrame) -> DataFrame:
    return titles.join(counts.select(F.col("entity").alias("title")).distinct(), "title", "left_semi")


def best_entity(counts: DataFrame) -> DataFrame:
    """(alias, entity, n): the entity an alias names most often, the first name between equals."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("entity").alias("entity")))
    return counts.groupBy("alias").agg(best.alias("b")).select("alias", "b.entity", (-F.col("b.neg")).alias("n"))


def two_hops(edges: DataFrame) -> DataFrame:
    """(src_id, dst_id): what the pages that src links to link to, without src's own links and src itself. A page
    that a large part of all pages link to is salted."""
    edges = materialize(edges.select("src_id", "dst_id").distinct(), "edges")
    second = edges.select(F.col("src_id").alias("mid"), "dst_id")
    reached = salted_join(edges.select("src_id", F.col("dst_id").alias("mid")), second, ["mid"], "inner").where("src_id <> dst_id").select("src_id", "dst_id", F.lit(False).alias("own"))
    # own links join the pairs, so that one shuffle with map-side combine both drops them and makes the pairs distinct
    pairs = reached.unionByName(edges.withColumn("own", F.lit(True)))
    return pairs.groupBy("src_id", "dst_id").agg(F.max("own").alias("own")).where("not own").drop("own")


def all_entities_in(candidates: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """(key, all_in): whether every candidate of a key is in members (entity)."""
    flag = members.select("entity").distinct().withColumn("__in", F.lit(True))
    return lookup_join(candidates, flag, ["entity"]).groupBy(key).agg(F.bool_and(F.coalesce("__in", F.lit(False))).alias("all_in"))


def best_linked(candidates: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, entity, n): of each key's candidates (key, page_id, entity_id, entity) the one that links the page most.

    Candidates without a link to the page have no part; the first name between equals.
    """
    n = edges.select(F.col("src_id").alias("entity_id"), F.col("dst_id").alias("page_id"), "n")
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("entity").alias("entity")))
    return candidates.join(n, ["entity_id", "page_id"]).where("n > 0").groupBy(key).agg(best.alias("b")).select(key, "b.entity", (-F.col("b.neg")).alias("n"))
