"""Queries p2 to p6 over the given tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.readings import alias_reading, sql_alias, sql_squeeze, sql_title, title_reading
from linkloom.operators import compaction, hierarchy, key_chunks, orphans, term_bitmaps
from linkloom.session import read_table, scratch_path, whole_rows_once


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return compaction.delivered_once(compaction.consolidated(read_table(spark, d, "final_articles")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies of files: (file_id, copy_id), after consolidation of the table's files."""
    return _copies(spark, d).where("copy_of <> file_id").select(F.col("copy_of").alias("file_id"), F.col("file_id").alias("copy_id")).distinct()


def p2_held(spark: SparkSession, d: str) -> DataFrame:
    """The articles and revisions that are held, each once, with the number of deliveries of each."""
    return _copies(spark, d).groupBy(F.col("copy_of").alias("file_id")).agg(F.count(F.lit(1)).alias("deliveries"))


def p2_small_files(spark: SparkSession, d: str) -> DataFrame:
    """final_articles laid out as a thousand small files, consolidated and read again: every row with a digest of its text."""
    small = scratch_path(spark, "small")
    read_table(spark, d, "final_articles").repartition(1_000, "file_id").write.parquet(small)
    table = compaction.consolidated(spark.read.parquet(small))
    return table.select("file_id", "title", "page_id", F.md5("text").alias("digest"), F.size("article_names").cast("long").alias("names"))


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "aliases").withColumn("alias_key", alias_reading(F.col("alias")))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return term_bitmaps.marked_terms(_aliases(spark, d), "alias_key", "title_id", "n")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Aliases on too few or too many pages: (alias, mark)."""
    return _marked(spark, d).where("mark is not null").select(F.col("term").alias("alias"), "mark")


def p3_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Every alias with its uses, rows, pages and mark."""
    return _marked(spark, d).select(F.col("term").alias("alias"), F.col("occurrences").alias("uses"), F.col("rows").alias("n_rows"), F.col("records").alias("pages"), "mark")


def _strongest(spark: SparkSession, d: str) -> DataFrame:
    once = whole_rows_once(read_table(spark, d, "aliases")).withColumn("alias_key", alias_reading(F.col("alias"))).where("alias_key is not null")
    entity = F.nullif(title_reading(F.col("entity")), F.lit(""))
    kinds = F.array(
        F.struct(F.lit("alias").alias("key_kind"), F.col("alias_key").alias("key_value"), entity.alias("value")),
        F.struct(F.lit("title_id").alias("key_kind"), F.col("title_id").cast("string").alias("key_value"), F.col("alias_key").alias("value")),
    )
    rows = once.select("n", F.explode(kinds).alias("k")).select("k.*", "n").where("key_value is not null")
    return key_chunks.strongest_value(rows, ["key_kind", "key_value"], "value", "n")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Per alias the strongest entity, per page the strongest alias: (key_kind, key_value, winner)."""
    return _strongest(spark, d).select("key_kind", "key_value", "winner")


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """As p4_found, with the winner's sum."""
    return _strongest(spark, d)


def _links(spark: SparkSession, d: str) -> DataFrame:
    """The link of each source that counts: the latest with a target; redirect_id, then target, decide between equals."""
    rows = read_table(spark, d, "redirect").select(title_reading(F.col("source")).alias("source"), title_reading(F.col("target")).alias("target"), "seen_at", "redirect_id")
    rows = rows.where("source <> '' and target <> ''")
    return rows.groupBy("source").agg(F.max_by("target", F.struct("seen_at", "redirect_id", "target")).alias("target"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The title each redirect source reaches in the end: (source, root), root empty for loops."""
    return hierarchy.resolve_roots(_links(spark, d), "source", "target").select(F.col("node").alias("source"), F.when(F.col("looped"), "").otherwise(F.col("root")).alias("root"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path, depth and root of every source; loops have root '' and no path."""
    full = hierarchy.resolve_roots(_links(spark, d), "source", "target", with_paths=True)
    path = F.when(~F.col("looped"), F.concat_ws(" > ", F.concat("path", F.array("root"))))
    return full.select(F.col("node").alias("source"), "depth", F.coalesce("root", F.lit("")).alias("root"), path.alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every title that leads to a title, with the number of links between them."""
    return hierarchy.descendants(hierarchy.resolve_roots(_links(spark, d), "source", "target", with_paths=True)).select(F.col("ancestor").alias("title"), F.col("node").alias("source"), "distance")


def p5_loops(spark: SparkSession, d: str) -> DataFrame:
    """Titles on a loop, each with the smallest title of the loop."""
    links = _links(spark, d)
    return hierarchy.loop_members(links, hierarchy.resolve_roots(links, "source", "target").where("looped"), "source", "target").select(F.col("node").alias("title"), "loop")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    parents = read_table(spark, d, "title2id").withColumn("name", title_reading(F.col("title")))
    files = read_table(spark, d, "final_articles").select("file_id", "committed_at", F.explode("article_names").alias("name"))
    files = files.select(F.lit("final_articles").alias("ref_table"), F.col("file_id").alias("row_id"), title_reading(F.col("name")).alias("ref_value"), F.col("committed_at").alias("at"))
    uses = read_table(spark, d, "aliases").where("title_id is not null").select(F.lit("aliases").alias("ref_table"), F.col("alias_row_id").alias("row_id"), F.col("title_id").alias("ref_value"), F.col("seen_at").alias("at"))
    by_name = orphans.find_orphans(files, parents, "ref_value", "at", "name", "created_at", "deleted_at")
    by_id = orphans.find_orphans(uses, parents, "ref_value", "at", "title_id", "created_at", "deleted_at").withColumn("ref_value", F.col("ref_value").cast("string"))
    return by_name.unionByName(by_id).withColumn("ref_month", F.date_format("at", "yyyy-MM"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """References without a living title: (ref_table, row_id, ref_value, status, ref_month)."""
    return _orphans(spark, d).select("ref_table", "row_id", "ref_value", "status", "ref_month").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month and status."""
    return p6_found(spark, d).groupBy("ref_table", "ref_month", "status").agg(F.count(F.lit(1)).alias("n_references"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_held, p2_small_files, p3_found, p3_frequencies, p4_found, p4_totals, p5_found, p5_paths, p5_descendants, p5_loops, p6_found, p6_report)}


_P2 = f"""WITH k AS (SELECT DISTINCT file_id, coalesce({sql_title("title")}, chr(1)) AS t, coalesce({sql_squeeze("text")}, chr(1)) AS x FROM final_articles),
g AS (SELECT file_id, min(file_id) OVER (PARTITION BY t, x) AS copy_of FROM k)
"""
_ONCE = "WITH o AS (SELECT DISTINCT * FROM aliases), "
_P3 = _ONCE + f"""a AS (SELECT {sql_alias("alias")} AS alias, title_id, n FROM o),
f AS (SELECT alias, CAST(sum(coalesce(n, 0)) AS BIGINT) AS uses, count(*) AS n_rows, count(DISTINCT title_id) AS pages FROM a WHERE alias IS NOT NULL GROUP BY alias),
m AS (SELECT *, CASE WHEN pages < 3 THEN 'rare' WHEN pages >= 0.1 * (SELECT count(DISTINCT title_id) FROM aliases) THEN 'common' END AS mark FROM f)
"""
_P4 = _ONCE + f"""a AS (SELECT {sql_alias("alias")} AS alias, nullif({sql_title("entity")}, '') AS entity, title_id, n FROM o),
u AS (SELECT 'alias' AS key_kind, alias AS key_value, entity AS value, n FROM a WHERE alias IS NOT NULL
      UNION ALL SELECT 'title_id', CAST(title_id AS VARCHAR), alias, n FROM a WHERE alias IS NOT NULL AND title_id IS NOT NULL),
s AS (SELECT key_kind, key_value, value, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total FROM u WHERE value IS NOT NULL GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY key_kind, key_value ORDER BY total DESC, value) AS r FROM s)
"""
_P5 = f"""WITH RECURSIVE q AS (SELECT {sql_title("source")} AS source, {sql_title("target")} AS target, seen_at, redirect_id FROM redirect),
l AS (SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seen_at DESC NULLS LAST, redirect_id DESC NULLS LAST, target DESC) AS r FROM q WHERE source <> '' AND target <> '') WHERE r = 1),
p AS (SELECT source, target AS hit, 1 AS depth, [source] AS path FROM l
      UNION ALL SELECT p.source, l.target, p.depth + 1, list_append(p.path, l.source) FROM p JOIN l ON p.hit = l.source WHERE NOT list_contains(p.path, p.hit)),
r AS (SELECT p.source, p.hit, p.depth, p.path FROM p ANTI JOIN l ON p.hit = l.source)
"""
_P6 = f"""WITH t AS (SELECT {sql_title("title")} AS name, title_id, created_at, deleted_at FROM title2id),
r AS (SELECT 'final_articles' AS ref_table, file_id AS row_id, {sql_title("name")} AS ref_value, committed_at AS seen FROM (SELECT file_id, committed_at, unnest(article_names) AS name FROM final_articles)
      UNION SELECT 'aliases', alias_row_id, CAST(title_id AS VARCHAR), seen_at AS seen FROM aliases WHERE title_id IS NOT NULL),
k AS (SELECT 'final_articles' AS ref_table, name AS ref_value, created_at, deleted_at FROM t WHERE name IS NOT NULL UNION ALL SELECT 'aliases', CAST(title_id AS VARCHAR), created_at, deleted_at FROM t WHERE title_id IS NOT NULL),
j AS (SELECT r.ref_table, r.row_id, r.ref_value, r.seen, count(k.ref_table) AS known, coalesce(bool_or(k.created_at <= r.seen AND (k.deleted_at IS NULL OR k.deleted_at > r.seen)), false) AS fine, coalesce(bool_or(k.created_at <= r.seen), false) AS begun
      FROM r LEFT JOIN k ON r.ref_table = k.ref_table AND r.ref_value = k.ref_value WHERE r.ref_value IS NOT NULL GROUP BY ALL),
z AS (SELECT DISTINCT ref_table, row_id, ref_value, CASE WHEN known = 0 THEN 'missing' WHEN begun THEN 'deleted' ELSE 'late' END AS status, strftime(seen, '%Y-%m') AS ref_month FROM j WHERE NOT fine)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2 + "SELECT DISTINCT copy_of AS file_id, file_id AS copy_id FROM g WHERE copy_of <> file_id",
        "p2_held": _P2 + "SELECT copy_of AS file_id, count(*) AS deliveries FROM g GROUP BY 1",
        "p2_small_files": "SELECT file_id, title, page_id, md5(text) AS digest, CAST(len(article_names) AS BIGINT) AS names FROM final_articles",
        "p3_found": _P3 + "SELECT alias, mark FROM m WHERE mark IS NOT NULL",
        "p3_frequencies": _P3 + "SELECT alias, uses, n_rows, pages, mark FROM m",
        "p4_found": _P4 + "SELECT key_kind, key_value, value AS winner FROM w WHERE r = 1",
        "p4_totals": _P4 + "SELECT key_kind, key_value, value AS winner, total FROM w WHERE r = 1",
        "p5_found": _P5 + "SELECT l.source, coalesce(r.hit, '') AS root FROM l LEFT JOIN r ON l.source = r.source",
        "p5_paths": _P5 + "SELECT l.source, CAST(r.depth AS BIGINT) AS depth, coalesce(r.hit, '') AS root, array_to_string(r.path, ' > ') || ' > ' || r.hit AS path FROM l LEFT JOIN r ON l.source = r.source",
        "p5_descendants": _P5 + "SELECT p.hit AS title, p.source, CAST(p.depth AS BIGINT) AS distance FROM p WHERE p.source IN (SELECT source FROM r)",
        "p5_loops": _P5 + ", m AS (SELECT source AS title, list_min(path) AS loop FROM p WHERE hit = source) SELECT title, loop FROM m",
        "p6_found": _P6 + "SELECT * FROM z",
        "p6_report": _P6 + "SELECT ref_table, ref_month, status, count(*) AS n_references FROM z GROUP BY ALL",
    }
