"""Queries of sources, sinks, streams and small operators: what is written comes back, what is looked up is found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import markup as m
from linkloom.langpack import MONTHS, WEEKDAYS
from linkloom.operators import baseline, dictionary, linker, spans
from linkloom.plans.reference_queries import C_SQL, E_SQL, EV_SQL, I_SQL, SPAN_SQL, _counts, _edges, _events, _ids, _spans, _stream, _vectors
from linkloom.session import materialize, read_table, scratch_path
from linkloom.sources import dump, sinks
from linkloom.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Sources and sinks

#: JSON objects that a dictionary is written as.
OBJECTS = 64
BEST_SQL = f"WITH {C_SQL}, b AS (SELECT alias, entity, n FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY n DESC, entity) AS k FROM c) WHERE k = 1)"


def _objects(pairs: DataFrame, path: str) -> None:
    """JSON objects of (key, value), each a file of its own."""
    parts = pairs.groupBy(F.pmod(F.xxhash64("key"), F.lit(OBJECTS)).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("json"))
    parts.select("json").write.option("maxRecordsPerFile", 1).text(path)


@query(f"{BEST_SQL} SELECT alias AS key, entity AS value FROM b WHERE n > 3")
def dictionary_read(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "dictionary")
    _objects(dictionary.best_entity(_counts(spark, d)).where("n > 3").select(F.col("alias").alias("key"), F.col("entity").alias("value")), path)
    return dump.read_dictionary(spark, path)


@query(f"WITH {E_SQL} SELECT src_id AS key, dst_id AS item, CAST(n AS BIGINT) AS n FROM e")
def counts_read(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "counts")
    of = _edges(spark, d).groupBy(F.col("src_id").cast("string").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("dst_id").cast("string").alias("k"), F.col("n").alias("v")))).alias("value"))
    _objects(of, path)
    return dump.read_counts(spark, path, keys="long")


@query("SELECT text, count(*) AS n FROM eval_items WHERE text IS NOT NULL GROUP BY text")
def page_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts as files of a folder with subfolders, read at any depth."""
    path = scratch_path(spark, "files")
    rows = read_table(spark, d, "eval_items").where("text is not null").select("text", F.pmod("item_id", F.lit(7)).alias("folder"))
    rows.write.partitionBy("folder").option("maxRecordsPerFile", 1).text(path)
    return dump.read_page_files(spark, path).select(F.regexp_replace("text", r"\n\z", "").alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH k AS (SELECT *, rpad(substr(regexp_replace(lower(title), '[^0-9a-z]+', '_', 'g'), 1, 3), 3, '_') AS key FROM final_articles)
SELECT file_id, title, text, substr(key, 1, 1) AS part, substr(key, 1, 1) || '/' || substr(key, 1, 2) || '/' || key AS shard FROM k""")
def pages_written(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "pages")
    sinks.write_pages(read_table(spark, d, "final_articles").select("file_id", "title", "text"), path)
    return spark.read.parquet(path).select("file_id", "title", "text", F.col("part").cast("string").alias("part"), "shard")


@query("SELECT title_id, title, CASE WHEN title LIKE '%(footballer)' THEN 'human' WHEN title LIKE '%(river)' THEN 'geo' ELSE 'article' END AS page_class FROM title2id")
def classes_written(spark: SparkSession, d: str) -> DataFrame:
    path, t = scratch_path(spark, "classes"), F.col("title")
    kind = F.when(t.endswith("(footballer)"), "human").when(t.endswith("(river)"), "geo").otherwise("article")
    sinks.write_classes(read_table(spark, d, "title2id").select("title_id", "title", kind.alias("page_class")), path)
    return spark.read.parquet(path).select("title_id", "title", "page_class")


@query("SELECT redirect_id, source, target FROM redirect")
def published_once(spark: SparkSession, d: str) -> DataFrame:
    """What is published stays: a second table under the same name changes nothing."""
    first, second, target = (scratch_path(spark, n) for n in ("first", "second", "published"))
    rows = read_table(spark, d, "redirect").select("redirect_id", "source", "target")
    rows.write.parquet(first)
    rows.where("redirect_id % 2 = 0").write.parquet(second)
    sinks.publish(spark, first, target)
    sinks.publish(spark, second, target)
    return spark.read.parquet(target)


@query(f"WITH {E_SQL} SELECT src_id, dst_id, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY ALL")
def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    """Link counts of two halves of the files, added up."""
    halves = []
    for k in (0, 1):
        pages = read_table(spark, d, "final_articles").where(f"page_id is not null and pmod(file_id, 2) = {k}").select("page_id", F.explode("article_names").alias("entity"))
        halves.append(dictionary.link_edges(pages, _ids(spark, d), "page_id"))
    return dictionary.merge_edges(halves[0].unionByName(halves[1]))


# Streams


@query("SELECT title, count(DISTINCT title) AS n FROM final_articles WHERE title IS NOT NULL GROUP BY title")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are delivered again pass once."""
    pages = ingest.once_per_key(_stream(spark, d, "final_articles").where("title is not null"), "title", "committed_at", late="3650 days")
    path = scratch_path(spark, "once")
    q = pages.select("title").writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("title string").parquet(path).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


# Links of the rival annotator

_GUARD = ", ".join(f"'{w}'" for w in (*MONTHS, *WEEKDAYS))


@query(rf"""WITH {C_SQL}, r AS (SELECT DISTINCT source FROM redirect WHERE source IS NOT NULL),
b AS (SELECT file_id, unnest(regexp_extract_all(text, '\[\[([^\[\]]*)\]\]', 1)) AS body FROM final_articles),
l AS (SELECT DISTINCT file_id, split_part(body, '|', 1) AS entity, CASE WHEN contains(body, '|') THEN split_part(body, '|', 2) ELSE body END AS alias FROM b)
SELECT file_id, entity, alias FROM l WHERE alias <> '' AND alias NOT IN ({_GUARD}) AND try_cast(alias AS DOUBLE) IS NULL AND NOT regexp_matches(alias, '^(\p{{Ll}}|\p{{N}})') AND NOT regexp_matches(entity, '^\p{{Ll}}')
AND entity IN (SELECT entity FROM c) AND entity NOT IN (SELECT source FROM r)""")
def baseline_guard(spark: SparkSession, d: str) -> DataFrame:
    """Links that name something to be looked for elsewhere in their page."""
    links = read_table(spark, d, "final_articles").select("file_id", F.explode(m.links(F.col("text"))).alias("l")).select("file_id", "l.entity", F.substring_index("l.alias", "|", 1).alias("alias"))
    return baseline.linkable(links.distinct(), _counts(spark, d), read_table(spark, d, "redirect").select(F.col("source").alias("entity")))


@query(f'WITH {SPAN_SQL} SELECT event_id, coalesce(lag("start") OVER w < "end" AND "start" < lag("end") OVER w, false) AS crosses FROM sp WINDOW w AS (PARTITION BY user_id ORDER BY "start", "end", event_id)')
def overlap_guard(spark: SparkSession, d: str) -> DataFrame:
    """Whether a span overlaps the one that begins before it."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("start", "end", "event_id")
    return _spans(spark, d).select("event_id", F.coalesce(spans.overlap(F.lag("start").over(w), F.lag("end").over(w), F.col("start"), F.col("end")), F.lit(False)).alias("crosses"))


# Numeric linking


@query(f"""WITH {EV_SQL}, t AS (SELECT DISTINCT user_id, 'w' || v AS word FROM ev), v AS (SELECT 'w' || vec_id AS word, embedding FROM embeddings), n AS (SELECT embedding FROM embeddings WHERE vec_id = 0)
SELECT user_id, word, round(CAST(coalesce(v.embedding, (SELECT embedding FROM n))[1] AS DOUBLE), 6) AS first FROM t LEFT JOIN v USING (word)""")
def embedding_gather(spark: SparkSession, d: str) -> DataFrame:
    """The vector of every token of a bag, that of the unknown word where it has none."""
    words = _events(spark, d).select("user_id", F.concat(F.lit("w"), F.col("v").cast("string")).alias("word")).distinct()
    bags = words.groupBy("user_id").agg(F.array_sort(F.collect_set("word")).alias("tokens"))
    vectors = _vectors(spark, d).select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("v").alias("vector"))
    found = linker.embed(bags, "user_id", "tokens", vectors, unknown="w0")
    return found.join(bags, "user_id").select("user_id", F.get("tokens", F.col("pos")).alias("word"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


WID_SQL = f"WITH {I_SQL}, a AS (SELECT DISTINCT entity FROM aliases WHERE entity IS NOT NULL), w AS (SELECT a.entity, i.page_id AS wid FROM a JOIN i ON translate(i.title, ' ', '_') = translate(a.entity, ' ', '_'))"


@query(WID_SQL + " SELECT entity, wid, wid * 3 + 1 AS idx FROM w WHERE wid % 4 <> 0")
def ids_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Entities to known ids and their places in a vocabulary."""
    return _resolved(spark, d)


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    ids = _ids(spark, d).select(F.translate("title", " ", "_").alias("title"), F.col("page_id").alias("wid"))
    known = ids.select("wid").distinct().where("wid % 4 <> 0").withColumn("idx", F.col("wid") * 3 + 1)
    names = read_table(spark, d, "aliases").where("entity is not null").select("entity").distinct()
    return linker.resolve_ids(names, ids, known).select("entity", "wid", "idx")


@query(WID_SQL + ", k AS (SELECT DISTINCT wid FROM w WHERE wid % 4 <> 0) SELECT k.wid * 3 + 1 AS idx, i.title FROM k JOIN i ON i.page_id = k.wid")
def titles_of_places(spark: SparkSession, d: str) -> DataFrame:
    """The way back: places in the vocabulary to ids to titles."""
    places = _resolved(spark, d).select("idx", "wid").distinct()
    return linker.titles_of(places.select("idx"), places, _ids(spark, d).select("title", F.col("page_id").alias("wid"))).select("idx", "title")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding[1:8]) AS DOUBLE))) AS e FROM embeddings)
SELECT vec_id, CAST(unnest(range(8)) AS INTEGER) AS pos, round(unnest(list_transform(e, lambda x: x / list_sum(e))), 6) AS p FROM e""")
def softmax_rows(spark: SparkSession, d: str) -> DataFrame:
    """Softmax over the first scores of each vector: the function takes an array of candidates' scores."""
    return _vectors(spark, d).select("vec_id", F.posexplode(linker.softmax(F.slice("v", 1, 8))).alias("pos", "p")).select("vec_id", "pos", F.round("p", 6).alias("p"))


@query("SELECT DISTINCT title, '[[ ' || string_split(title, ' ')[1] || ' ]]' || array_to_string(list_transform(string_split(title, ' ')[2:], lambda x: ' ' || x), '') AS marked FROM title2id WHERE title IS NOT NULL")
def bracket_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The first word of each title between link signs."""
    rows = read_table(spark, d, "title2id").where("title is not null").select("title").distinct()
    return rows.select("title", F.array_join(linker.bracket_mention(F.split("title", " "), 0, 0), " ").alias("marked"))


@query(f"{BEST_SQL} SELECT alias, CASE WHEN length(alias) % 2 = 0 THEN 'N:' || alias ELSE entity END AS entity FROM b")
def fallback_choice(spark: SparkSession, d: str) -> DataFrame:
    """The numeric linker's choice where it has one, else the greedy one."""
    greedy = materialize(dictionary.best_entity(_counts(spark, d)).select("alias", "entity"), "greedy")
    neural = greedy.where(F.char_length("alias") % 2 == 0).select("alias", F.concat(F.lit("N:"), "alias").alias("entity"))
    return linker.with_fallback(greedy.select("alias"), neural, greedy, "alias")


@query(f"WITH {C_SQL} SELECT DISTINCT entity AS page, translate(alias, ' ', '_') AS item FROM c")
def coherence_bags(spark: SparkSession, d: str) -> DataFrame:
    return linker.coherence_bag(_counts(spark, d), "entity", "alias").select(F.col("entity").alias("page"), "item")
