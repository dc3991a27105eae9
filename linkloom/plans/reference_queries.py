"""Queries of the entity-link engine's operators over the given tables, with their oracle SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import markup as m
from linkloom.functions import rewriting, viewer
from linkloom.langpack import ENGLISH
from linkloom.operators import baseline, cascade, coref, dictionary, evaluation, linker, mentions, metrics, routing, spans
from linkloom.session import lookup_join, materialize, read_table, scratch_path, spread
from linkloom.sources import dump, sinks
from linkloom.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Base tables of several queries


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", "title", "text").where("text is not null")


def _redirects(spark: SparkSession, d: str) -> DataFrame:
    """One target per source, as written: the latest, then the smallest."""
    rows = read_table(spark, d, "redirect").where("source <> '' and target <> ''")
    best = F.min(F.struct((-F.unix_micros(F.col("seen_at").cast("timestamp"))).alias("t"), "target"))
    return rows.groupBy("source").agg(best.alias("b")).select("source", "b.target")


R_SQL = "r AS (SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY seen_at DESC, target) AS k FROM redirect WHERE source <> '' AND target <> '') WHERE k = 1)"
LINK_SQL = r"\[\[([^\[\]]*)\]\]"
# Letters, word signs and white space as Unicode has them, spelled out for an engine whose \\w and \\s know ASCII only.
ALPHABETIC_SQL = r"\p{L}\p{Nl}\x{24b6}-\x{24e9}\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}"
WORD_SQL = ALPHABETIC_SQL + r"\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}"
SPACE_SQL = r"\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LINES_SQL = "SELECT file_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM final_articles WHERE text IS NOT NULL"
TOKEN_SQL = f"[{WORD_SQL}]+|[^{WORD_SQL}{SPACE_SQL}]"
L_SQL = f"""b AS (SELECT doc_id, unnest(regexp_extract_all(text, '{LINK_SQL}', 1)) AS body, unnest(range(len(regexp_extract_all(text, '{LINK_SQL}', 1)))) AS pos FROM documents),
l AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, split_part(body, '|', 1) AS entity, CASE WHEN instr(body, '|') > 0 THEN substr(body, instr(body, '|') + 1) ELSE body END AS alias FROM b)"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.merge_alias_counts(read_table(spark, d, "aliases").where("entity is not null").select("alias", "entity", "n"))


C_SQL = "c AS (SELECT alias, entity, CAST(sum(n) AS BIGINT) AS n FROM (SELECT nullif(regexp_replace(regexp_replace(trim(alias, ' '), '''s$', ''), '''$', ''), '') AS alias, entity, n FROM aliases WHERE entity IS NOT NULL) WHERE alias IS NOT NULL GROUP BY ALL)"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return dump.title_ids(read_table(spark, d, "title2id").select("title", F.col("title_id").alias("page_id")))


I_SQL = "i AS (SELECT title, min(title_id) AS page_id FROM title2id WHERE title IS NOT NULL GROUP BY title)"


def _article_links(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "final_articles").select("file_id", F.explode("article_names").alias("entity"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, d, "final_articles").where("page_id is not null").select("page_id", F.explode("article_names").alias("entity"))
    return dictionary.link_edges(pages, _ids(spark, d), "page_id")


E_SQL = I_SQL + ", e AS (SELECT a.page_id AS src_id, i.page_id AS dst_id, count(*) AS n FROM (SELECT page_id, unnest(article_names) AS entity FROM final_articles WHERE page_id IS NOT NULL) a JOIN i ON i.title = a.entity GROUP BY ALL)"


# Links, aliases and their dictionaries


@query(f"WITH {L_SQL} SELECT * FROM l")
def link_parse(spark, d):
    return dictionary.page_links(_docs(spark, d), "doc_id")


@query(f"""WITH {L_SQL}, {R_SQL}, n AS (SELECT alias, entity, count(*) AS n FROM l WHERE NOT regexp_matches(lower(entity), '^(file:|image:|list of)') GROUP BY ALL)
SELECT n.alias, coalesce(r.target, n.entity) AS entity, CAST(sum(n) AS BIGINT) AS n FROM n LEFT JOIN r ON r.source = n.entity GROUP BY ALL""")
def alias_counts(spark, d):
    return dictionary.alias_counts(dictionary.page_links(_docs(spark, d), "doc_id"), _redirects(spark, d))


@query(f"WITH {C_SQL} SELECT * FROM c")
def alias_normalised_counts(spark, d):
    return _counts(spark, d)


@query(f"WITH {C_SQL} SELECT alias, entity, n FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY n DESC, entity) AS k FROM c) WHERE k = 1")
def alias_best_entity(spark, d):
    return dictionary.best_entity(_counts(spark, d))


@query(f"WITH {C_SQL}, {R_SQL} SELECT alias, coalesce(target, entity) AS entity, CAST(sum(n) AS BIGINT) AS n FROM c LEFT JOIN r ON source = entity GROUP BY ALL")
def redirect_resolved_counts(spark, d):
    return dictionary.resolve_redirects(_counts(spark, d), _redirects(spark, d)).groupBy("alias", "entity").agg(F.sum("n").alias("n"))


@query(f"WITH {E_SQL} SELECT * FROM e")
def link_edges(spark, d):
    return _edges(spark, d)


@query(f"WITH {E_SQL}, {C_SQL}, s AS (SELECT page_id FROM i WHERE title IN (SELECT entity FROM c WHERE n > 1)) SELECT * FROM e WHERE src_id IN (SELECT page_id FROM s) AND dst_id IN (SELECT page_id FROM s)")
def link_edges_pruned(spark, d):
    kept = _ids(spark, d).join(_counts(spark, d).where("n > 1").select(F.col("entity").alias("title")).distinct(), "title", "left_semi")
    return dictionary.prune_edges(_edges(spark, d), kept.select(F.col("page_id").alias("id")))


@query(f"WITH {E_SQL}, x AS (SELECT DISTINCT a.src_id, b.dst_id FROM e a JOIN e b ON a.dst_id = b.src_id WHERE a.src_id <> b.dst_id) SELECT x.src_id, x.dst_id FROM x ANTI JOIN e ON x.src_id = e.src_id AND x.dst_id = e.dst_id")
def two_hop_neighbourhood(spark, d):
    return dictionary.two_hops(_edges(spark, d))


@query(f"WITH {R_SQL} SELECT target, array_to_string(list_sort(list(DISTINCT source)), '; ') AS sources FROM r GROUP BY target")
def redirects_reverse(spark, d):
    return dictionary.redirects_reverse(_redirects(spark, d)).select("target", F.array_join("sources", "; ").alias("sources"))


@query(f"WITH {C_SQL}, {R_SQL} SELECT c.* FROM c ANTI JOIN r ON c.entity = r.source")
def exclusion_anti_join(spark, d):
    return _counts(spark, d).join(_redirects(spark, d).select(F.col("source").alias("entity")), "entity", "left_anti")


FOLD_SQL = "f AS (SELECT c.alias, coalesce(a.title, b.title) AS entity, c.n FROM c LEFT JOIN (SELECT DISTINCT title FROM title2id) a ON a.title = lower(substr(c.entity, 1, 1)) || substr(c.entity, 2) LEFT JOIN (SELECT DISTINCT title FROM title2id) b ON b.title = upper(substr(c.entity, 1, 1)) || substr(c.entity, 2) WHERE coalesce(a.title, b.title) IS NOT NULL)"


@query(f"WITH {C_SQL}, {FOLD_SQL} SELECT * FROM f")
def casefold_title_join(spark, d):
    return dictionary.fold_case(_counts(spark, d), read_table(spark, d, "title2id").select("title").distinct())


@query(f"WITH {C_SQL} SELECT * FROM c WHERE n > 1 AND length(alias) > 1")
def min_support_aliases(spark, d):
    return _counts(spark, d).where((F.col("n") > 1) & (F.char_length("alias") > 1))


PRUNED_SQL = f"{R_SQL}, {C_SQL.replace('c AS', 'c0 AS', 1)}, c AS (SELECT * FROM c0 WHERE n > 1 AND length(alias) > 1 AND entity NOT IN (SELECT source FROM r)), {FOLD_SQL}, p AS (SELECT alias, entity, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY ALL)"


def _pruned(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.prune_aliases(_counts(spark, d), read_table(spark, d, "title2id").select("title").distinct(), _redirects(spark, d).select(F.col("source").alias("title")))


@query(f"WITH {PRUNED_SQL} SELECT * FROM p")
def pruned_aliases(spark, d):
    return _pruned(spark, d)


NAMED_SQL = r"g AS (SELECT entity FROM p GROUP BY entity HAVING sum(CASE WHEN regexp_matches(alias, '^\p{Lu}') THEN n ELSE -n END) >= 0)"


@query(f"WITH {PRUNED_SQL}, {NAMED_SQL} SELECT p.* FROM p WHERE entity IN (SELECT entity FROM g)")
def named_entity_filter(spark, d):
    return dictionary.named_entities(_pruned(spark, d))


@query(f"WITH {PRUNED_SQL}, {NAMED_SQL} SELECT entity, CAST(sum(n) AS BIGINT) AS n FROM p WHERE entity IN (SELECT entity FROM g) GROUP BY entity ORDER BY n DESC, entity LIMIT 10000")
def popular_topk(spark, d):
    return dictionary.popular(dictionary.named_entities(_pruned(spark, d)))


@query(f"WITH {PRUNED_SQL} SELECT * FROM i WHERE title IN (SELECT entity FROM p)".replace("WITH ", f"WITH {I_SQL}, ", 1))
def surviving_titles(spark, d):
    return dictionary.surviving_titles(_ids(spark, d), _pruned(spark, d))


@query(f"WITH {I_SQL} SELECT * FROM i")
def first_id_per_title(spark, d):
    return _ids(spark, d)


@query("SELECT alias_row_id, length(alias) AS chars FROM aliases WHERE title_id IN (SELECT title_id FROM title2id) AND alias IS NOT NULL AND alias_row_id NOT IN (SELECT alias_row_id FROM aliases WHERE n > 5)")
def resume_left_anti(spark, d):
    rows = read_table(spark, d, "aliases")
    known = rows.where("alias is not null").join(read_table(spark, d, "title2id").select("title_id").distinct(), "title_id", "left_semi")
    return sinks.still_to_do(known, rows.where("n > 5"), "alias_row_id").select("alias_row_id", F.char_length("alias").cast("long").alias("chars"))


# Routing


NS_SQL = "^(" + "|".join(ENGLISH.namespaces) + "):"


@query(f"""SELECT redirect_id, source, CASE WHEN starts_with(lower(source), 'category:') THEN 'category' WHEN starts_with(lower(source), 'list of') THEN 'list'
WHEN NOT regexp_matches(lower(source), '{NS_SQL}') THEN 'article' END AS route FROM redirect WHERE source IS NOT NULL""")
def namespace_route(spark, d):
    return read_table(spark, d, "redirect").where("source is not null").select("redirect_id", "source", routing.route(F.col("source")).alias("route"))


@query(f"""WITH t AS (SELECT DISTINCT source, target FROM redirect WHERE source IS NOT NULL AND target IS NOT NULL),
k AS (SELECT source, target, CASE WHEN starts_with(lower(source), 'list of') OR starts_with(lower(target), 'list of') THEN 'list' WHEN starts_with(lower(source), 'category:') OR starts_with(lower(target), 'category:') THEN 'category'
WHEN NOT regexp_matches(lower(source), '{NS_SQL}') AND NOT regexp_matches(lower(target), '{NS_SQL}') THEN 'article' END AS kind FROM t) SELECT * FROM k WHERE kind IS NOT NULL""")
def redirect_element_route(spark, d):
    rows = read_table(spark, d, "redirect").select(F.col("source").alias("title"), F.col("target").alias("redirect_title"), F.lit("").alias("text")).where("title is not null").distinct()
    return routing.redirects(rows)


@query(f"""WITH t AS (SELECT redirect_id, '#REDIRECT [[' || translate(target, ' ', '_') || '|x]]' AS text FROM redirect WHERE target IS NOT NULL)
SELECT redirect_id, nullif(translate(split_part(regexp_extract(text, '{LINK_SQL}', 1), '|', 1), '_', ' '), '') AS target FROM t""")
def text_redirects(spark, d):
    rows = read_table(spark, d, "redirect").where("target is not null")
    text = F.concat(F.lit("#REDIRECT [["), F.translate("target", " ", "_"), F.lit("|x]]"))
    return rows.select("redirect_id", routing.text_redirect(text).alias("target"))


_MARK = "CASE doc_id % 8 WHEN 0 THEN '{{Rivers-stub}}' WHEN 1 THEN '{{hndis|x}}' WHEN 2 THEN '{{Geodis}}' WHEN 3 THEN '{{numberdis}}' WHEN 4 THEN '{{Disambiguation}}' WHEN 5 THEN '{{surname}}' WHEN 6 THEN '[[Category:Given names]]' ELSE '' END"


@query(f"""WITH t AS (SELECT doc_id, coalesce(title, '') AS title, text || {_MARK} AS text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN contains(lower(text), 'stub}}}}') THEN 'stub' WHEN contains(lower(text), '{{{{hndis|') THEN 'human' WHEN contains(lower(text), '{{{{geodis}}}}') THEN 'geo' WHEN contains(lower(text), '{{{{numberdis}}}}') THEN 'number'
WHEN contains(lower(text), '{{{{disambiguation}}}}') THEN 'other' WHEN NOT regexp_matches(lower(title), '{NS_SQL}') THEN 'article' END AS page_class,
contains(text, '[[Category:Given names]]') AS given_name, contains(text, '{{{{surname}}}}') AS surname FROM t""".replace("{{{{", "{{").replace("}}}}", "}}"))
def page_class_route(spark, d):
    text = F.concat("text", F.expr(_MARK))
    rows = _docs(spark, d).select("doc_id", F.coalesce("title", F.lit("")).alias("title"), text.alias("text"))
    return rows.select("doc_id", routing.page_class(F.col("title"), F.col("text")).alias("page_class"), routing.is_given_name(F.col("text")).alias("given_name"), routing.is_surname(F.col("text")).alias("surname"))


@query("""SELECT redirect_id, source AS title, flag FROM (SELECT redirect_id, source, unnest(CASE redirect_id % 3 WHEN 0 THEN ['stub'] WHEN 1 THEN ['given_name', 'surname'] ELSE [] END) AS flag FROM redirect) WHERE source IS NOT NULL""")
def name_flags(spark, d):
    text = F.expr("CASE redirect_id % 3 WHEN 0 THEN 'x {{geo-stub}}' WHEN 1 THEN '{{given name}} [[Category:Surnames]]' ELSE '{{Surname}}' END")
    rows = read_table(spark, d, "redirect").where("source is not null").select("redirect_id", F.struct(F.col("source").alias("title"), text.alias("text")).alias("p"))
    flat = rows.select("redirect_id", "p.*")
    return routing.page_flags(flat.withColumn("title", F.struct("redirect_id", "title"))).select("title.redirect_id", "title.title", "flag")


@query("SELECT redirect_id, source AS name FROM redirect WHERE source IS NOT NULL AND source <> '' AND NOT contains(source, '|') UNION ALL SELECT redirect_id, 'Second name' FROM redirect WHERE source IS NOT NULL")
def hatnote_redirects(spark, d):
    text = F.concat(F.lit("{{Redirect|"), "source", F.lit("|x}}\n{{redirect|Second name}}\nText\n{{redirect|no hatnote}}"))
    return read_table(spark, d, "redirect").where("source is not null").select("redirect_id", F.explode(routing.hatnote_redirects(text)).alias("name"))


@query("SELECT redirect_id, 'Category:' || target AS target FROM redirect WHERE target IS NOT NULL AND NOT regexp_matches(target, '[{}]')")
def category_redirects(spark, d):
    text = F.concat(F.lit("a {{Category redirect|"), "target", F.lit("}} b"))
    return read_table(spark, d, "redirect").where("target is not null").select("redirect_id", F.explode(routing.category_redirects(text)).alias("target"))


# Markup functions


def _each(spark: SparkSession, d: str, c: Column) -> DataFrame:
    return _docs(spark, d).select("doc_id", c.alias("out"))


def _text_query(name: str, function, sql: str) -> None:
    def run(spark, d):
        return _each(spark, d, function(F.col("text")))

    run.__name__ = name
    query(f"SELECT doc_id, {sql} AS out FROM documents WHERE text IS NOT NULL")(run)


_text_query("strip_tags", m.drop_tags, r"regexp_replace(text, '<(?s:.*?)>', '', 'g')")
_text_query("strip_comments", m.drop_comments, r"regexp_replace(text, '<!--(?s:.*?)-->', '', 'g')")
_text_query("strip_references", m.drop_references, r"regexp_replace(text, '<ref[> ](?s:.*?)(</ref>|/>)', '', 'g')")
_text_query("strip_math", m.drop_math, r"regexp_replace(text, '<math[> ](?s:.*?)(</math>|/>)', '', 'g')")
_text_query("drop_note_lines", m.drop_notes, r"regexp_replace(text, '(?m)^:[^\n]*\n?', '', 'g')")
_text_query("drop_pipe_lines", m.drop_pipe_lines, r"regexp_replace(text, '(?m)^\|[^\n]*\n?', '', 'g')")
_text_query("collapse_breaks", lambda c: F.regexp_replace(c, r"\n{2,}", "\n\n"), r"regexp_replace(text, '\n{2,}', E'\n\n', 'g')")
_text_query("collapse_spaces", lambda c: F.regexp_replace(c, " +", " "), "regexp_replace(text, ' +', ' ', 'g')")
_text_query("cut_sections", m.cut_sections, r"regexp_replace(text, '==[ \t\n\v\f\r]*(See also|References|Bibliography|Sources|Notes|Further Reading|External links)(?s:.*)$', '')")
_text_query("simple_tables_removed", lambda c: m.drop_simple_tables(F.regexp_replace(c, r"\{\|", "{|"), 1), r"regexp_replace(text, '\{\|([^{|]|\|[^}]|\{[^|])*?\|\}', '', 'g')")
_text_query("external_links_removed", lambda c: m.drop_external_links(F.concat(c, F.lit(" [http://a.b/c some label] end"))), r"regexp_replace(text || ' [http://a.b/c some label] end', '\[\w+://[^\]\n]*\]', '', 'g')")
_text_query("galleries_removed", lambda c: m.drop_galleries(F.concat(F.lit("<Gallery x>\n"), c, F.lit("</gallery> tail"))), r"regexp_replace('<Gallery x>' || chr(10) || text || '</gallery> tail', '(?is)<gallery.*?</gallery>', '', 'g')")
_text_query("infobox_prefix_cut", lambda c: m.drop_infobox_prefix(F.concat(F.lit("{{note}} "), F.substring(c, 1, 20), F.lit("{{Infobox x}}"), c)), "'{{Infobox x}}' || text")
_text_query("files_removed_simple", m.drop_files, r"regexp_replace(text, '(?i)\[\[(file|image)\s*:([^\[\]]|\[\[[^\[\]]*\]\])*\]\]', '', 'g')")
_text_query("links_unwrapped", m.unlink, r"regexp_replace(text, '\[\[([^\[\]]*\|)?([^\[\]|]*)\]\]', '\2', 'g')")
_text_query("intro_cut", m.intro, "split_part(text, '==', 1)")
_text_query("punctuation_once", m.punctuation_once, r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\(( ?[;,] ?)*\) ?', '', 'g'), '\(( ?[;,] ?)+', '(', 'g'), ' ,', ',', 'g'), ' \)', ')', 'g'), ',,+ ', ', ', 'g'), ',\)', ')', 'g'), ';\)', ')', 'g')")
_text_query("word_count", lambda c: F.size(m.word_tokens(c)).cast("long"), rf"len(regexp_extract_all(text, '{TOKEN_SQL}'))")


@query(r"SELECT doc_id, unnest(list_transform(regexp_extract_all(text || '[[Category:' || source || '|key]]', '(?i)\[\[category:([^\[\]]*)\]\]', 1), lambda x: split_part(x, '|', 1))) AS category FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def category_arrays(spark, d):
    rows = read_table(spark, d, "documents").where("text is not null and source is not null")
    text = F.concat("text", F.lit("[[Category:"), "source", F.lit("|key]]"))
    return rows.select("doc_id", F.explode(m.categories(text)).alias("category"))


@query(f"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '==[ \\t\\n\\v\\f\\r]*(See also|References|Bibliography|Sources|Notes|Further Reading|External links)(?s:.*)$', ''), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM t)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, split_part(regexp_extract(line, '{LINK_SQL}', 1), '|', 1) AS entity FROM u WHERE split_part(regexp_extract(line, '{LINK_SQL}', 1), '|', 1) <> ''""")
def disambiguation_lists(spark, d):
    return dictionary.disambiguation_entries(_docs(spark, d), "doc_id")


@query(r"SELECT title_id, title, regexp_replace(lower(strip_accents(title)), '[^a-z0-9]', '', 'g') AS surface FROM title2id WHERE title IS NOT NULL")
def surface_normalise(spark, d):
    return read_table(spark, d, "title2id").where("title is not null").select("title_id", "title", m.surface_key(F.col("title")).alias("surface"))


@query("""WITH k AS (SELECT file_id, title, rpad(substr(regexp_replace(lower(title), '[^0-9a-z]+', '_', 'g'), 1, 3), 3, '_') AS key FROM final_articles)
SELECT file_id, substr(key, 1, 1) || '/' || substr(key, 1, 2) || '/' || key || '/' || translate(title, ' /', '__') || '.txt' AS path FROM k""")
def shard_path(spark, d):
    return read_table(spark, d, "final_articles").select("file_id", m.page_path(F.col("title")).alias("path"))


@query("SELECT o_orderkey, monthname(o_orderdate) AS by_number, monthname(o_orderdate) AS by_name FROM orders")
def month_name(spark, d):
    at = F.col("o_orderdate")
    return read_table(spark, d, "orders").select("o_orderkey", m.month_name(F.date_format(at, "MM")).alias("by_number"), m.month_name(F.date_format(at, "d MMMM").substr(3, 20)).alias("by_name"))


@query(r"""SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y') AS INTEGER) AS year, CAST(strftime(o_orderdate, '%m') AS INTEGER) AS month, CAST(strftime(o_orderdate, '%d') AS INTEGER) AS day, 'date' AS kind FROM orders
UNION ALL SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y') AS INTEGER), CAST(strftime(o_orderdate, '%m') AS INTEGER), CAST(strftime(o_orderdate, '%d') AS INTEGER), 'iso' FROM orders""")
def french_dates(spark, d):
    at = F.col("o_orderdate")
    name = F.element_at(F.array(*[F.lit(x) for x in m.FRENCH_MONTHS]), F.month(at))
    text = F.concat(F.lit("Construit le "), F.dayofmonth(at).cast("string"), F.lit(" "), name, F.lit(" "), F.year(at).cast("string"), F.lit(", soit "), F.date_format(at, "yyyy-MM-dd"), F.lit("."))
    rows = read_table(spark, d, "orders").select("o_orderkey", F.explode(m.temporal_expressions(text, "fr")).alias("t"))
    return rows.select("o_orderkey", "t.year", "t.month", "t.day", "t.kind")


@query()
def time_expressions(spark, d):
    docs = read_table(spark, d, "documents").where("lang in ('fr', 'de') and text is not null")
    fr = docs.where("lang = 'fr'").select("doc_id", F.explode(m.temporal_expressions(F.col("text"), "fr")).alias("t"))
    return fr.unionByName(docs.where("lang = 'de'").select("doc_id", F.explode(m.temporal_expressions(F.col("text"), "de")).alias("t"))).select("doc_id", "t.*")


@query("""SELECT o_orderkey, try_cast(o_orderpriority AS DOUBLE) IS NOT NULL AS numeric, regexp_matches(o_orderpriority, '[A-Z]') AS upper, CASE WHEN contains(o_orderpriority, 'URGENT') THEN 1 ELSE 0 END AS shared FROM orders""")
def scalar_predicates(spark, d):
    p = F.col("o_orderpriority")
    return read_table(spark, d, "orders").select("o_orderkey", m.is_number(p).alias("numeric"), m.has_upper(p).alias("upper"), m.shared_words(F.regexp_replace(p, "-", " "), F.lit("URGENT things")).alias("shared"))


@query("SELECT alias_row_id, nullif(regexp_replace(regexp_replace(trim(alias, ' '), '''s$', ''), '''$', ''), '') AS alias FROM aliases")
def alias_trim(spark, d):
    return read_table(spark, d, "aliases").select("alias_row_id", m.alias_trim(F.col("alias")).alias("alias"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\{\{lang\|[^|{}]*\|([^{}]*)\}\}', '\1', 'g'), '\{\{convert\|([^|{}]*)\|([^|{}]*)\|[^{}]*\}\}', '\1 \2', 'g'), '\{\{quote\|([^{}|]*)\|[^{}]*\}\}', '"\1"', 'g'), '\{\{[^{}]*\}\}', '', 'g') AS out FROM documents WHERE text IS NOT NULL""")
def templates_rewrite(spark, d):
    return _each(spark, d, rewriting.rewrite_templates_column(F.col("text")))


@query(r"SELECT doc_id, regexp_replace(text, '(?i)\[\[\s*(file|image)\s*:([^\[\]]|\[\[[^\[\]]*\]\])*\]\]', '', 'g') AS out FROM documents WHERE text IS NOT NULL")
def files_removed(spark, d):
    return _each(spark, d, rewriting.drop_files_column(F.col("text")))


@query(r"SELECT doc_id, regexp_replace(text, '\{\|(?s:.*?)\|\}', '', 'g') AS out FROM documents WHERE text IS NOT NULL")
def tables_removed(spark, d):
    return _each(spark, d, rewriting.drop_tables_column(F.col("text")))


@query()
def bold_to_link(spark, d):
    return _docs(spark, d).select("doc_id", rewriting.link_bold_mentions_column(F.col("text"), F.col("title")).alias("out"))


@query()
def punctuation_fixpoint(spark, d):
    return _each(spark, d, rewriting.repair_punctuation_column(F.col("text")))


def _clean_sql() -> str:
    foreign = r"(?:\n\[\[[a-z][a-z][\w-]*:[^:\]]+\]\])+(\n?)$"
    steps = [
        ("&nbsp;", " "), ("<!--(?s:.*?)-->", ""), (foreign, r"\1"), ("<ref[> ](?s:.*?)(</ref>|/>)", ""), ("<math[> ](?s:.*?)(</math>|/>)", ""), ("<(?s:.*?)>", ""), (r"\n{2,}", r"\n\n"),
        (f"^[{SPACE_SQL}]+|[{SPACE_SQL}]+$", ""), (r"(?m)^\|[^\n]*\n?", ""), (r"(\n ?|\t|  )[|!](?:[^\[\]\n|]*\|)*", r"\1"), (foreign, r"\1"),
    ]
    out = "text"
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', " + ("E'\\n\\n'" if to == r"\n\n" else f"'{to}'") + ", 'g')"
    names = "|".join(m.CELL_ATTRIBUTES)
    lines = f"string_split({out}, chr(10))"
    kept = f"list_concat(list_transform({lines}[1:1], lambda x: CASE WHEN regexp_matches(x, '^.{{0,2}}(?:{names.removesuffix('|scope=')})') THEN '' ELSE x END), list_filter({lines}[2:], lambda x: NOT regexp_matches(x, '^.{{0,4}}(?:{names})')))"
    out = f"""replace(replace(replace(array_to_string({kept}, chr(10)), '''''''', ''), '''''', '"'), '&thinsp;', '')"""
    return f"regexp_replace(regexp_replace({out}, ' +', ' ', 'g'), ' ?\\( *\\)', '', 'g')"


@query(f"SELECT doc_id, {_clean_sql()} AS out FROM documents WHERE text IS NOT NULL")
def clean_text(spark, d):
    return _each(spark, d, m.clean_text(F.col("text")))


@query()
def strip_page(spark, d):
    return _docs(spark, d).select("doc_id", rewriting.strip_page(F.col("text"), F.coalesce("title", F.lit(""))).alias("out"))


@query(r"SELECT file_id, regexp_replace(replace(text, '[[' || title || ']]', title), '\[\[' || regexp_escape(title) || '\|([^\[\]]*)\]\]', '\1', 'g') AS out FROM final_articles")
def own_links_removed(spark, d):
    return read_table(spark, d, "final_articles").select("file_id", m.drop_own_links(F.col("text"), F.col("title")).alias("out"))


@query(r"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN starts_with(x, '=') THEN regexp_replace(x, '\[\[([^\[\]]*\|)?([^\[\]|]*)\]\]', '\2', 'g') ELSE x END), chr(10)) AS out FROM documents WHERE text IS NOT NULL")
def headers_flattened(spark, d):
    return _each(spark, d, m.flatten_headers(F.col("text")))


_REJOIN_ONCE = r"(^|[^\n=])\n([^\n=]|$)', '\1 \2', 'g')"


def _rejoin_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{_REJOIN_ONCE}, '{_REJOIN_ONCE}"  # twice: a place takes its neighbours with it


@query(f"SELECT doc_id, {_rejoin_sql('text')} AS out FROM documents WHERE text IS NOT NULL")
def lines_rejoined(spark, d):
    return _each(spark, d, m.rejoin_lines(F.col("text")))


# Annotated text


ANN_SQL = f"""a AS (SELECT file_id, string_split(body, '|') AS p, CAST(pos AS INTEGER) AS pos FROM (SELECT file_id, unnest(regexp_extract_all(text, '{LINK_SQL}', 1)) AS body, unnest(range(len(regexp_extract_all(text, '{LINK_SQL}', 1)))) AS pos FROM final_articles))"""


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "final_articles").select("file_id", F.posexplode(mentions.parse_annotations(F.col("text"))).alias("pos", "a"))
    return rows.select("file_id", "pos", "a.*")


@query(f"WITH {ANN_SQL} SELECT file_id, pos, CASE WHEN len(p) > 2 THEN p[1] END AS entity, CASE WHEN len(p) > 1 THEN p[-2] ELSE p[1] END AS alias, CASE WHEN len(p) > 1 THEN p[-1] END AS tag, CAST(len(p) AS INTEGER) AS parts FROM a")
def annotation_parse(spark, d):
    return _annotations(spark, d)


@query(f"""WITH t AS (SELECT file_id, string_split_regex(text, '{LINK_SQL}') AS gaps, list_transform(regexp_extract_all(text, '{LINK_SQL}', 1), lambda b: string_split(b, '|')) AS links FROM final_articles WHERE text IS NOT NULL),
a AS (SELECT file_id, list_transform(gaps, lambda g: length(g)) AS g, list_transform(links, lambda p: CASE WHEN len(p) > 1 THEN p[-2] ELSE p[1] END) AS alias, links FROM t),
u AS (SELECT file_id, g, alias, links, unnest(range(1, len(links) + 1)) AS k FROM a)
SELECT file_id, CAST(list_sum(g[1:k]) + coalesce(list_sum(list_transform(alias[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS start, CAST(length(alias[k]) AS INTEGER) AS len, CASE WHEN len(links[k]) > 2 THEN links[k][1] END AS entity, alias[k] AS alias, CASE WHEN len(links[k]) > 1 THEN links[k][-1] END AS tag FROM u""")
def annotation_spans(spark, d):
    return read_table(spark, d, "final_articles").select("file_id", F.explode(mentions.annotation_spans(F.col("text"))).alias("s")).select("file_id", "s.*")


@query("SELECT file_id, text FROM final_articles WHERE text IS NOT NULL")
def annotation_render_roundtrip(spark, d):
    rows = read_table(spark, d, "final_articles").where("text is not null").select("file_id", mentions.bare_text(F.col("text")).alias("bare"), mentions.annotation_spans(F.col("text")).alias("s"))
    return rows.select("file_id", mentions.render(F.col("bare"), F.col("s")).alias("text"))


@query("SELECT file_id, pos, regexp_matches(tag, 'multiple|part_of_seen_entity') AND contains(entity, '###') AS needs FROM (SELECT file_id, pos, coalesce(p[1], '') AS entity, coalesce(p[-1], '') AS tag FROM a WHERE len(p) > 2)".replace("SELECT", f"WITH {ANN_SQL} SELECT", 1))
def needs_linker(spark, d):
    return _annotations(spark, d).where("parts > 2").select("file_id", "pos", mentions.needs_linker(F.col("entity"), F.col("tag")).alias("needs"))


_NER_SQL = "', '".join(mentions.NER_TAGS)


@query(f"""WITH l AS (SELECT file_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM final_articles),
b AS (SELECT file_id, no, unnest(regexp_extract_all(line, '{LINK_SQL}', 1)) AS body FROM l),
x AS (SELECT DISTINCT file_id, no FROM b WHERE len(string_split(body, '|')) <> 3 AND NOT (len(string_split(body, '|')) > 1 AND string_split(body, '|')[-1] IN ('{_NER_SQL}')))
SELECT l.file_id, CAST(l.no AS INTEGER) AS line_no, x.file_id IS NOT NULL OR regexp_matches(l.line, '\\[\\[[^\\]]*\\[\\[') AS dropped FROM l LEFT JOIN x ON l.file_id = x.file_id AND l.no = x.no""")
def malformed_lines(spark, d):
    lines = read_table(spark, d, "final_articles").select("file_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("file_id", "line_no", mentions.is_malformed(F.col("line")).alias("dropped"))


@query(f"WITH {ANN_SQL}, q AS (SELECT file_id, pos, CASE WHEN len(p) > 2 THEN p[1] END AS entity, p[-2] AS alias, p[-1] AS tag FROM a WHERE len(p) > 1) SELECT file_id, pos FROM q WHERE entity IS NOT NULL AND NOT contains(tag, 'coref') AND NOT regexp_matches(alias, '^\\p{{Ll}}') AND try_cast(alias AS DOUBLE) IS NULL")
def comparison_filter(spark, d):
    return _annotations(spark, d).where("parts > 1").where(~mentions.droppable(F.col("entity"), F.col("alias"), F.col("tag"))).select("file_id", "pos")


@query("SELECT file_id, '###FILENAME### ' || title || chr(10) || text || repeat(chr(10), 4) AS block FROM final_articles")
def corpus_export(spark, d):
    return sinks.corpus_blocks(read_table(spark, d, "final_articles"), F.col("title"), keep=["file_id"]).select("file_id", "block")


@query(f"WITH {C_SQL}, s AS (SELECT alias, entity, n FROM c WHERE n > 1) SELECT alias AS key, CAST(count(*) AS INTEGER) AS items, CAST(sum(n) AS BIGINT) AS total FROM s GROUP BY alias")
def dictionary_json_roundtrip(spark, d):
    made = sinks.dictionary_json(_counts(spark, d).where("n > 1"), "alias", "entity", "n")
    back = made.select("key", F.from_json("json", "map<string,bigint>").alias("m"))
    return back.select("key", F.size("m").alias("items"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


_ESCAPED = "replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(rf"""WITH {I_SQL}, l AS ({_LINES_SQL}), s AS (SELECT file_id, line_no, {_ESCAPED} AS line FROM l),
g AS (SELECT file_id, line_no, string_split_regex(line, '{LINK_SQL}') AS gaps, regexp_extract_all(line, '{LINK_SQL}', 1) AS links FROM s),
u AS (SELECT file_id, line_no, unnest(range(1, len(gaps) + 1)) AS k, unnest(gaps) AS gap, unnest(list_concat(links, [NULL])) AS body FROM g), v AS (SELECT *, string_split(body, '|') AS p FROM u),
w AS (SELECT v.*, i.page_id, CASE WHEN len(p) > 1 THEN p[-2] ELSE p[1] END AS alias FROM v LEFT JOIN i ON i.title = p[1]),
x AS (SELECT file_id, line_no, string_agg(gap || CASE WHEN body IS NULL THEN '' WHEN len(p) <= 2 THEN '<a class="name">' || alias || '</a>' WHEN page_id IS NOT NULL THEN '<a style="color:blue" href="?curid=' || page_id || '">' || alias || '</a>' ELSE '<a style="color:green">' || alias || '</a>' END, '' ORDER BY k) AS body FROM w GROUP BY ALL),
y AS (SELECT file_id, line_no, CASE WHEN starts_with(body, '===') THEN '<h4>' || trim(regexp_replace(body, '^=+|=+$', '', 'g'), ' ') || '</h4>' WHEN starts_with(body, '==') THEN '<h2>' || trim(regexp_replace(body, '^=+|=+$', '', 'g'), ' ') || '</h2>' WHEN trim(body, ' ') = '' THEN '' ELSE '<p>' || body || '</p>' END AS html FROM x)
SELECT file_id AS page_id, string_agg(html, chr(10) ORDER BY line_no) AS html FROM y GROUP BY file_id""")
def html_render(spark, d):
    lines = read_table(spark, d, "final_articles").select(F.col("file_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return viewer.render_page(lines, _ids(spark, d))


@query()
def line_mentions(spark, d):
    pages = read_table(spark, d, "final_articles").select("file_id", "title", "text")
    lines = mentions.find_mentions(pages, _pruned(spark, d), _redirects(spark, d), "file_id")
    return lines.select("file_id", F.explode("mentions").alias("x")).select("file_id", "x.*")


@query()
def acronym_pairs(spark, d):
    @F.pandas_udf("array<struct<start:int,name:string,at:int,acronym:string>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [dict(zip(("start", "name", "at", "acronym"), p)) for p in mentions.acronym_pairs(t)])

    text = F.concat("title", F.lit(" ("), F.regexp_replace("title", "[^A-Z]", ""), F.lit(") "), "text")
    return _docs(spark, d).select("doc_id", F.explode(find(text)).alias("p")).select("doc_id", "p.*")


@query(r"""SELECT entity, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(\p{Lu}\p{Ll}+)', 1)) AS entity FROM documents) GROUP BY entity""")
def capitalised_mentions(spark, d):
    return _docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{Ll}+)"), F.lit(1))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


# Cascade


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Files stand as pages, as one page_id may have several; linked_id is the page that links are counted for."""
    lines = read_table(spark, d, "final_articles").select(F.col("file_id").alias("page_id"), F.col("page_id").alias("linked_id"), "title", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = lines.select("page_id", "linked_id", "title", "line_no", F.explode(mentions.annotation_spans(F.col("line"))).alias("s"))
    met = rows.select("page_id", "linked_id", "title", "line_no", "s.start", "s.alias", "s.entity", F.when(F.col("s.tag").startswith("a") & (F.pmod("page_id", F.lit(3)) > 0), "annotation").otherwise("alias_match").alias("tag"))
    counts = _pruned(spark, d)
    names = read_table(spark, d, "title2id").select(F.col("title").alias("entity")).where("title like '%(footballer)'").distinct()
    geo = read_table(spark, d, "title2id").select("title").where("title like '%(river)'").distinct()
    return cascade.gather_facts(met.distinct(), counts, _redirects(spark, d), dictionary.popular(counts), _edges(spark, d), _ids(spark, d), names, names.select(F.col("entity").alias("title")), geo, "linked_id")


@query()
def candidate_cascade(spark, d):
    return cascade.resolve(_facts(spark, d)).select(F.col("page_id").alias("file_id"), "line_no", "start", "alias", "resolved", "final_tag")


@query("""SELECT alias_row_id, CASE WHEN alias_row_id % 11 = 0 THEN alias WHEN alias_row_id % 7 = 0 THEN entity WHEN alias_row_id % 5 = 0 THEN 'A###B' WHEN alias_row_id % 3 = 0 THEN 'B' END AS resolved,
CASE WHEN alias_row_id % 11 = 0 THEN 'alias_match_match_candidate' WHEN alias_row_id % 7 = 0 THEN 'alias_match_popular_entity' WHEN alias_row_id % 5 = 0 THEN 'alias_match_multiple_candidates' WHEN alias_row_id % 3 = 0 THEN 'alias_match_single_line_candidate' ELSE 'alias_match' END AS final_tag
FROM aliases WHERE alias <> ''""")
def cascade_case(spark, d):
    rows = read_table(spark, d, "aliases").where("alias <> ''")
    mod = lambda n: F.col("alias_row_id") % n == 0
    two, none, text = F.array(F.lit("A"), F.lit("B")), F.array().cast("array<string>"), F.lit(None).cast("string")
    facts = rows.select(
        "alias_row_id", "alias", F.lit("alias_match").alias("tag"), text.alias("entity"), text.alias("previous_alias"), F.lit(False).alias("is_title"), text.alias("title"),
        F.when(mod(11), F.col("alias")).alias("seen_entity"), text.alias("seen_redirect"), F.when(mod(7), F.col("entity")).alias("popular_entity"), text.alias("popular_redirect"),
        F.when(mod(5) | mod(3), two).otherwise(none).alias("candidates"), F.lit(False).alias("all_persons"), text.alias("best_linked"),
        F.when(mod(3) & ~mod(5), F.array(F.lit("B"))).otherwise(none).alias("line_candidates"), F.lit(False).alias("human"), F.lit(False).alias("geo"), none.alias("part_of"),
    )
    return cascade.resolve(facts).select("alias_row_id", "resolved", "final_tag")


@query(f"WITH {E_SQL}, k AS (SELECT file_id AS key, page_id, unnest(article_names) AS entity FROM final_articles WHERE page_id IS NOT NULL), c AS (SELECT DISTINCT k.key, k.page_id, k.entity, i.page_id AS entity_id FROM k JOIN i ON i.title = k.entity), s AS (SELECT c.key, c.entity, e.n, row_number() OVER (PARTITION BY c.key ORDER BY e.n DESC, c.entity) AS r FROM c JOIN e ON e.src_id = c.entity_id AND e.dst_id = c.page_id) SELECT key, entity, n FROM s WHERE r = 1")
def candidate_argmax_links(spark, d):
    rows = read_table(spark, d, "final_articles").where("page_id is not null").select(F.col("file_id").alias("key"), "page_id", F.explode("article_names").alias("entity")).distinct()
    with_id = rows.join(_ids(spark, d).select(F.col("title").alias("entity"), F.col("page_id").alias("entity_id")), "entity")
    return dictionary.best_linked(with_id, _edges(spark, d), "key")


@query(f"""WITH {C_SQL}, o AS (SELECT alias, list_sort(list(entity)) AS cands FROM c GROUP BY alias HAVING count(*) > 1), x AS (SELECT alias, unnest(cands) AS entity, unnest(range(len(cands))) AS pos FROM o)
SELECT alias, entity FROM (SELECT x.alias, x.entity, row_number() OVER (PARTITION BY x.alias ORDER BY c.n DESC, x.pos) AS r FROM x JOIN c ON c.alias = x.alias AND c.entity = x.entity) WHERE r = 1""")
def greedy_disambiguate(spark, d):
    counts = _counts(spark, d)
    open_ = counts.groupBy("alias").agg(F.array_sort(F.collect_list("entity")).alias("c")).where(F.size("c") > 1).select("alias", F.array_join("c", cascade.JOIN).alias("candidates"))
    return linker.greedy_choice(open_.withColumn("key", F.col("alias")), counts, "key").select(F.col("key").alias("alias"), "entity")


@query(f"WITH {C_SQL} SELECT alias, bool_and(contains(entity, '(footballer)')) AS all_in FROM c GROUP BY alias")
def all_candidates_persons(spark, d):
    counts = _counts(spark, d)
    persons = counts.where(F.contains("entity", F.lit("(footballer)"))).select("entity").distinct()
    return dictionary.all_entities_in(counts.select("alias", "entity"), "alias", persons)


# Coreference and spans


def _events(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return read_table(spark, d, "events").select("event_id", "user_id", "event_type", at.alias("at"), F.floor(F.col("value")).alias("v"))


EV_SQL = "ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS seen, CAST(floor(value) AS BIGINT) AS v FROM events)"


@query(f"""WITH {EV_SQL}, g AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'male' WHEN 'signup' THEN 'female' END AS gender, CASE event_type WHEN 'click' THEN 'male' WHEN 'view' THEN 'female' END AS pronoun FROM ev)
SELECT event_id, CASE pronoun WHEN 'male' THEN last_value(CASE WHEN gender = 'male' THEN event_id END IGNORE NULLS) OVER w WHEN 'female' THEN last_value(CASE WHEN gender = 'female' THEN event_id END IGNORE NULLS) OVER w END AS antecedent
FROM g WINDOW w AS (PARTITION BY user_id ORDER BY seen, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def coref_carry_forward(spark, d):
    t = F.col("event_type")
    rows = _events(spark, d).withColumns({"gender": F.when(t == "purchase", "male").when(t == "signup", "female"), "pronoun": F.when(t == "click", "male").when(t == "view", "female")})
    return coref.antecedents(rows, "user_id", ["at", "event_id"], entity="event_id").select("event_id", "antecedent")


@query(f"""WITH {EV_SQL}, l AS (SELECT user_id, event_id, seen, seen + 1000000 AS fin, CAST(v % 3 AS VARCHAR) AS key FROM ev WHERE event_type IN ('purchase', 'signup')),
dcl AS (SELECT user_id, key, coalesce(lag(fin) OVER (PARTITION BY user_id ORDER BY seen, event_id), 0) AS pos, seen AS ord, event_id FROM l), o AS (SELECT event_id, user_id, seen, CAST(v % 3 AS VARCHAR) AS key FROM ev WHERE event_type NOT IN ('purchase', 'signup'))
SELECT event_id, antecedent FROM (SELECT o.event_id, arg_max(dcl.event_id, struct_pack(a := dcl.pos, b := dcl.ord)) AS antecedent FROM o LEFT JOIN dcl ON o.user_id = dcl.user_id AND o.key = dcl.key AND dcl.pos <= o.seen GROUP BY o.event_id)""")
def nonperson_carry(spark, d):
    rows = _events(spark, d).withColumn("key", (F.col("v") % 3).cast("string"))
    links = rows.where("event_type in ('purchase', 'signup')").select("user_id", "at", (F.col("at") + 1000000).alias("end"), F.col("event_id").cast("string").alias("entity"), "key")
    corefs = links.select("entity", F.col("key").alias("coref"))
    asked = rows.where("event_type not in ('purchase', 'signup')").select("event_id", "user_id", "at", "key")
    return coref.keyed_antecedents(asked, links.drop("key"), corefs, "user_id").select("event_id", F.col("antecedent").cast("long").alias("antecedent"))


SPAN_SQL = EV_SQL + ", sp AS (SELECT event_id, user_id, event_type, seen // 60000000 AS \"start\", seen // 60000000 + v AS \"end\" FROM ev)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    start = F.floor(F.col("at") / 60_000_000)
    return _events(spark, d).select("event_id", "user_id", "event_type", start.alias("start"), (start + F.col("v")).alias("end"))


@query(f"""WITH {SPAN_SQL} SELECT n.event_id FROM sp n WHERE n.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM sp o WHERE o.event_type = 'view' AND o.user_id = n.user_id AND o."start" < o."end" AND o."start" < n."end" AND n."start" < o."end")""")
def span_overlap_anti(spark, d):
    s = _spans(spark, d)
    return spans.free_spans(s.where("event_type = 'click'"), s.where("event_type = 'view'"), ["user_id"]).select("event_id")


@query(f"""WITH {SPAN_SQL} SELECT event_id, coalesce(lag("end") OVER w > "start", false) OR coalesce(lead("start") OVER w < "end", false) AS overlaps FROM sp WINDOW w AS (PARTITION BY user_id ORDER BY "start", "end", event_id)""")
def overlap_flags(spark, d):
    return spans.overlap_flags(_spans(spark, d), ["user_id"], tie="event_id").select("event_id", "overlaps")


@query(f"""WITH {SPAN_SQL}, p AS (SELECT *, CASE WHEN "start" - lag("end") OVER w <= 240 THEN 0 ELSE 1 END AS fresh FROM sp WINDOW w AS (PARTITION BY user_id ORDER BY "start", "end", event_id)),
q AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY "start", "end", event_id) AS run FROM p), z AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY "start", "end", event_id) - 1) // 2 AS pair FROM q)
SELECT user_id, min("start") AS "start", max("end") AS "end", count(*) AS parts FROM z GROUP BY user_id, run, pair""")
def adjacent_merge(spark, d):
    return spans.merge_adjacent(_spans(spark, d), ["user_id"], F.col("start") - F.col("prev_end") <= 240, tie="event_id")


@query(f"""WITH {SPAN_SQL}, a AS (SELECT * FROM sp WHERE event_type = 'signup'), s AS (SELECT * FROM sp WHERE event_type = 'purchase')
SELECT s.event_id, least((SELECT min(s."start" - a."start") FROM a WHERE a.user_id = s.user_id AND a."start" <= s."start"), (SELECT min(a."end" - s."end") FROM a WHERE a.user_id = s.user_id AND a."end" >= s."end")) AS distance FROM s""")
def nearest_same_entity(spark, d):
    s = _spans(spark, d)
    return spans.nearest_anchor(s.where("event_type = 'purchase'"), s.where("event_type = 'signup'"), ["user_id"]).select("event_id", "distance")


@query(f"""WITH {EV_SQL}, f AS (SELECT user_id, v, min(seen) AS first FROM ev WHERE event_type = 'view' GROUP BY ALL) SELECT ev.event_id FROM ev JOIN f ON ev.user_id = f.user_id AND ev.v = f.v AND f.first < ev.seen WHERE ev.event_type = 'click'""")
def visible_aliases_range_join(spark, d):
    e = _events(spark, d)
    return spans.visible(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id", "v"], "at").select("event_id")


@query(f"""WITH {SPAN_SQL}, l AS (SELECT * FROM sp WHERE event_type = 'view'), r AS (SELECT * FROM sp WHERE event_type = 'click')
SELECT coalesce(l.user_id, r.user_id) AS user_id, l."start" AS l_start, l."end" AS l_end, r."start" AS r_start, r."end" AS r_end FROM l FULL OUTER JOIN r ON l.user_id = r.user_id AND l."start" < r."end" AND r."start" < l."end\"""")
def interval_merge_join(spark, d):
    s = _spans(spark, d)
    return spans.interval_join(s.where("event_type = 'view'"), s.where("event_type = 'click'"), ["user_id"])


@query(f"""WITH {SPAN_SQL}, x AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > "start" THEN 0 ELSE 1 END AS fresh FROM sp)
SELECT user_id, count(*) AS n, CAST(sum(fresh) AS BIGINT) AS islands FROM x GROUP BY user_id""")
def overlap_islands(spark, d):
    return spans.overlap_islands(_spans(spark, d), ["user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("island").alias("islands"))


@query(f"WITH {EV_SQL} SELECT event_id, CAST(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM ev")
def running_offset(spark, d):
    return spans.running_offset(_events(spark, d), ["user_id"], F.col("v"), "event_id").select("event_id", "shift")


@query(f"WITH {EV_SQL}, s AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS stopped FROM ev) SELECT event_id FROM s WHERE stopped = 0")
def prefix_before_cut(spark, d):
    return spans.before_first(_events(spark, d), ["user_id"], "event_id", F.col("event_type") == "purchase").select("event_id")


@query(f"WITH {EV_SQL} SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY seen, event_id) AS previous FROM ev")
def previous_alias(spark, d):
    return spans.previous_value(_events(spark, d), ["user_id"], ["at", "event_id"], "event_type").select("event_id", "previous")


@query("""WITH n AS (SELECT DISTINCT title_id, title FROM title2id WHERE title IS NOT NULL), w AS (SELECT title_id, title, unnest(string_split(title, ' ')) AS name FROM n), g AS (SELECT DISTINCT title_id, title, name, CASE WHEN length(name) % 5 = 0 THEN 'male' WHEN length(name) % 7 = 0 THEN 'female' END AS gender FROM w),
c AS (SELECT w.title_id, w.title, count(*) FILTER (length(w.name) % 5 = 0) AS male, count(*) FILTER (length(w.name) % 5 <> 0 AND length(w.name) % 7 = 0) AS female FROM w GROUP BY ALL)
SELECT title_id, title, male, female, CASE WHEN male > 0 AND female = 0 THEN 'male' WHEN female > 0 AND male = 0 THEN 'female' END AS gender FROM c""")
def gender_votes(spark, d):
    rows = read_table(spark, d, "title2id").where("title is not null").select("title_id", "title").distinct()
    n = F.char_length("name")
    names = rows.select(F.explode(F.split("title", " ")).alias("name")).distinct()
    genders = names.withColumn("gender", F.when(n % 5 == 0, "male").when(n % 7 == 0, "mostly_female"))
    return coref.gender_votes(rows.withColumn("key", F.struct("title_id", "title")), "key", "title", genders).select("key.*", "male", "female", "gender")


# Numeric linking


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Mentions (vectors divisible by 100) scored against all vectors of the same label; few labels are a skewed key."""
    v = _vectors(spark, d)
    mine = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("mention_id"), "label", F.col("v").alias("context"))
    given = spread(v).select(F.col("vec_id").alias("wid"), "label", F.col("v").alias("vector"))
    return lookup_join(given, mine, ["label"], "inner").select("mention_id", "wid", linker.dot(F.col("context"), F.col("vector")).alias("score"), (1 + F.col("wid") % 5).cast("double").alias("prior"))


V_SQL = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT m.vec_id AS mention_id, c.vec_id AS wid, list_inner_product(m.v, c.v) AS score, CAST(1 + c.vec_id % 5 AS DOUBLE) AS prior FROM v m JOIN v c ON m.label = c.label WHERE m.vec_id % 100 = 0),
x AS (SELECT *, exp(score - max(score) OVER (PARTITION BY mention_id)) AS e FROM s), p AS (SELECT mention_id, wid, prior, e / sum(e) OVER (PARTITION BY mention_id) AS posterior FROM x)"""
FUSE_SQL = """q AS (SELECT *, prior / sum(prior) OVER (PARTITION BY mention_id) AS a, posterior / sum(posterior) OVER (PARTITION BY mention_id) AS b FROM p), j AS (SELECT *, a + b - a * b AS ab FROM q), z AS (SELECT mention_id, wid, prior, posterior, ab / sum(ab) OVER (PARTITION BY mention_id) AS joint FROM j)"""


@query(f"WITH {V_SQL} SELECT mention_id, wid, round(posterior, 6) AS posterior FROM p")
def entity_posterior_softmax(spark, d):
    return linker.posterior(_scored(spark, d), "mention_id", F.col("score")).select("mention_id", "wid", F.round("posterior", 6).alias("posterior"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return linker.fuse(linker.posterior(_scored(spark, d), "mention_id", F.col("score")), "mention_id", "prior", "posterior")


@query(f"WITH {V_SQL}, {FUSE_SQL} SELECT mention_id, wid, round(joint, 6) AS joint FROM z")
def prior_context_fusion(spark, d):
    return _fused(spark, d).select("mention_id", "wid", F.round("joint", 6).alias("joint"))


@query(f"WITH {V_SQL} SELECT mention_id, wid, round(0.5 * prior + 0.5 * posterior, 6) AS joint FROM p")
def linear_fusion(spark, d):
    return linker.fuse_linear(linker.posterior(_scored(spark, d), "mention_id", F.col("score")), "prior", "posterior").select("mention_id", "wid", F.round("joint", 6).alias("joint"))


@query(f"WITH {V_SQL}, {FUSE_SQL}, r AS (SELECT mention_id, wid, row_number() OVER (PARTITION BY mention_id ORDER BY round(joint, 9) DESC, wid) AS k FROM z) SELECT mention_id, wid FROM r WHERE k = 1")
def joint_selection(spark, d):
    return linker.select_best(_fused(spark, d).withColumn("joint", F.round("joint", 9)), "mention_id", "joint", "wid")


@query(f"WITH {V_SQL}, r AS (SELECT mention_id, wid, row_number() OVER (PARTITION BY mention_id ORDER BY round(score, 9) DESC, wid) AS rank FROM s) SELECT mention_id, wid, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30")
def candidate_ranking(spark, d):
    return linker.top_candidates(_scored(spark, d).withColumn("score", F.round("score", 9)), "mention_id", "score", "wid").select("mention_id", "wid", "rank")


@query(f"WITH {V_SQL}, k AS (SELECT *, CASE WHEN wid % 3 = 0 THEN prior END AS known FROM s), w AS (SELECT mention_id, wid, known, bool_or(known IS NOT NULL) OVER (PARTITION BY mention_id) AS any_known, count(*) OVER (PARTITION BY mention_id) AS n FROM k) SELECT mention_id, wid, round(CASE WHEN any_known THEN known ELSE 1.0 / n END, 6) AS prior FROM w WHERE NOT any_known OR known IS NOT NULL")
def prior_fallback(spark, d):
    s = _scored(spark, d).select("mention_id", F.col("wid").cast("string").alias("wid"), "prior")
    own = s.select("mention_id", F.concat(F.lit("m"), F.col("mention_id").cast("string")).alias("surface")).distinct()
    known = s.where("wid % 3 = 0").join(own, "mention_id").select("surface", "wid", F.col("prior").alias("p"))
    got = linker.prior_candidates(own, s.select("mention_id", "wid"), known, "mention_id", "surface")
    return got.select("mention_id", F.col("wid").cast("long").alias("wid"), F.round("prior", 6).alias("prior"))


@query("""SELECT vec_id, array_to_string(labels, ',') AS labels FROM (SELECT vec_id, list_transform(list_filter(range(10), lambda i: 1 / (1 + exp(-4 * CAST(embedding[i + 1] AS DOUBLE))) >= 0.75), lambda i: CAST(i AS INTEGER)) AS labels FROM embeddings
WHERE len(list_filter(range(10), lambda i: 1 / (1 + exp(-4 * CAST(embedding[i + 1] AS DOUBLE))) >= 0.75)) > 0 UNION ALL
SELECT vec_id, [CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INTEGER)] FROM embeddings WHERE len(list_filter(range(10), lambda i: 1 / (1 + exp(-4 * CAST(embedding[i + 1] AS DOUBLE))) >= 0.75)) = 0)""")
def type_threshold(spark, d):
    scores = F.transform(F.slice("v", 1, 10), lambda x: linker.sigmoid(4 * x))
    return _vectors(spark, d).select("vec_id", F.array_join(linker.type_labels(scores).cast("array<string>"), ",").alias("labels"))


@query("""WITH w AS (SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), b AS (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) AS item FROM events),
x AS (SELECT b.user_id, unnest(range(64)) AS d, unnest(w.v) AS y FROM b JOIN w ON b.item = w.item) SELECT user_id, CAST(d AS INTEGER) AS d, round(greatest(sum(y), 0.0), 6) AS value FROM x GROUP BY ALL""")
def coherence_relu(spark, d):
    weights = _vectors(spark, d).select(F.col("vec_id").alias("item"), F.col("v").alias("vector"))
    bags = _events(spark, d).select("user_id", F.col("v").alias("item"))
    return linker.coherence(bags, weights, "user_id").select("user_id", "d", F.round("value", 6).alias("value"))


@query("""SELECT vec_id, round(greatest(list_inner_product(CAST(embedding[1:4] AS DOUBLE[]), [1.0, -1.0, 0.5, 2.0]), 0.0), 6) AS j0, round(greatest(list_inner_product(CAST(embedding[1:4] AS DOUBLE[]), [0.0, 1.0, 1.0, -1.0]), 0.0), 6) AS j1 FROM embeddings""")
def joint_encoder(spark, d):
    rows = F.array(F.array(*map(F.lit, (1.0, -1.0, 0.5, 2.0))), F.array(*map(F.lit, (0.0, 1.0, 1.0, -1.0))))
    out = linker.joint([F.slice("v", 1, 2), F.slice("v", 3, 2)], rows)
    return _vectors(spark, d).select("vec_id", F.round(out[0], 6).alias("j0"), F.round(out[1], 6).alias("j1"))


@query("""WITH x AS (SELECT label, unnest(range(64)) AS d, unnest(CAST(embedding AS DOUBLE[])) AS y FROM embeddings) SELECT label, CAST(d AS INTEGER) AS d, round(avg(y), 6) AS mean FROM x GROUP BY ALL""")
def mean_context(spark, d):
    mean = linker.mean_vector(_vectors(spark, d).withColumnRenamed("v", "vector"), ["label"])
    return mean.select("label", F.posexplode("vector").alias("d", "x")).select("label", "d", F.round("x", 6).alias("mean"))


@query(f"WITH {V_SQL} SELECT round(avg(-ln(greatest(posterior, 1e-12))), 6) AS loss, count(*) AS n FROM p")
def posterior_loss(spark, d):
    p = linker.posterior(_scored(spark, d), "mention_id", F.col("score"))
    return p.agg(F.round(F.avg(linker.cross_entropy(F.col("posterior"))), 6).alias("loss"), F.count(F.lit(1)).alias("n"))




def _mentions_sql(line: str) -> str:
    """u: each annotation of a line with its number k, the text before it, and the line's bare text."""
    return rf"""l AS ({_LINES_SQL}), s AS (SELECT file_id, line_no, {line} AS line FROM l),
g AS (SELECT file_id, line_no, string_split_regex(line, '{LINK_SQL}') AS gaps, list_transform(regexp_extract_all(line, '{LINK_SQL}', 1), lambda b: string_split(b, '|')) AS links FROM s),
h AS (SELECT *, list_transform(links, lambda p: CASE WHEN len(p) > 1 THEN p[-2] ELSE p[1] END) AS names FROM g),
u AS (SELECT file_id, line_no, k, coalesce(array_to_string(list_transform(range(1, k), lambda i: gaps[i] || names[i]), ''), '') || gaps[k] AS before, names[k] AS alias, links[k] AS p,
array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(names[i], '')), '') AS bare FROM (SELECT *, unnest(range(1, len(links) + 1)) AS k FROM h))"""


@query(rf"""WITH {_mentions_sql(f"regexp_replace(line, '({LINK_SQL})', ' \\1 ', 'g')")}, t AS (SELECT *, regexp_extract_all(bare, '{TOKEN_SQL}') AS t, len(regexp_extract_all(before, '{TOKEN_SQL}')) AS n, len(regexp_extract_all(alias, '{TOKEN_SQL}')) AS w FROM u),
c AS (SELECT file_id, line_no, k, t[1:n + w] AS l, list_reverse(t[n + 1:]) AS r FROM t), m AS (SELECT max(len(l)) AS l, max(len(r)) AS r FROM c)
SELECT file_id, line_no, CAST(k - 1 AS INTEGER) AS pos, array_to_string(list_concat(c.l, list_transform(range(m.l - len(c.l)), lambda i: '_')), ' ') AS "left", array_to_string(list_concat(c.r, list_transform(range(m.r - len(c.r)), lambda i: '_')), ' ') AS "right" FROM c, m""")
def token_contexts(spark, d):
    """Whole contexts of every annotation in its line, filled up to the longest of all; documents hold no annotations."""
    lines = read_table(spark, d, "final_articles").select("file_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", m.LINK, " $0 "))  # a mention is cut into tokens by itself
    found = lines.select("file_id", "line_no", m.word_tokens(mentions.bare_text(F.col("line"))).alias("t"), F.posexplode(linker.token_mentions(F.col("line"))).alias("pos", "x"))
    c = linker.contexts(F.col("t"), F.col("x.token_start"), F.col("x.token_start") + F.col("x.token_len") - 1)
    rows = materialize(found.select("file_id", "line_no", "pos", c.alias("c")), "contexts")
    longest = rows.agg(F.max(F.size("c.left")).alias("l"), F.max(F.size("c.right")).alias("r"))
    out = rows.crossJoin(F.broadcast(longest))
    fill = lambda side, n: F.array_join(linker.pad(F.col(f"c.{side}"), F.col(n), F.lit("_")), " ").alias(side)
    return out.select("file_id", "line_no", "pos", fill("left", "l"), fill("right", "r"))


ACC_SQL = f"""WITH {V_SQL}, {FUSE_SQL}, b AS (SELECT mention_id, arg_max(wid, struct_pack(a := round(prior, 9), b := -wid)) AS prior, max(prior) AS prior_p, arg_max(wid, struct_pack(a := round(posterior, 9), b := -wid)) AS context, max(posterior) AS context_p, arg_max(wid, struct_pack(a := round(joint, 9), b := -wid)) AS joint, max(joint) AS joint_p FROM z GROUP BY mention_id),
t AS (SELECT *, CASE WHEN mention_id % 75 = 0 THEN '<unk_wid>' ELSE CAST(mention_id AS VARCHAR) END AS truth FROM b),
u AS (SELECT 'prior' AS kind, CAST(prior AS VARCHAR) = truth AND prior_p <> 0 AS ok FROM t WHERE truth <> '<unk_wid>' UNION ALL SELECT 'context', CAST(context AS VARCHAR) = truth AND context_p <> 0 FROM t WHERE truth <> '<unk_wid>' UNION ALL SELECT 'joint', CAST(joint AS VARCHAR) = truth AND joint_p <> 0 FROM t WHERE truth <> '<unk_wid>')
SELECT kind, count(*) FILTER (ok) AS correct, count(*) AS known, round(count(*) FILTER (ok) / count(*), 6) AS accuracy FROM u GROUP BY kind"""


@query(ACC_SQL)
def linking_accuracy(spark, d):
    z = _fused(spark, d)
    best = {}
    for kind, score in (("prior", "prior"), ("context", "posterior"), ("joint", "joint")):
        best[kind] = F.min(F.struct((-F.round(score, 9)).alias("neg"), "wid")).alias(kind)
    rows = z.groupBy("mention_id").agg(*best.values())
    flat = rows.select(F.when(F.col("mention_id") % 75 == 0, metrics.UNKNOWN).otherwise(F.col("mention_id").cast("string")).alias("truth"), *[F.col(f"{k}.wid").cast("string").alias(k) for k in best], *[(-F.col(f"{k}.neg")).alias(f"{k}_p") for k in best])
    return metrics.linking_accuracy(flat).withColumn("accuracy", F.round("accuracy", 6))


TYPE_SQL = """WITH t AS (SELECT CAST(label AS INTEGER) AS label, list_distinct([CAST(label AS INTEGER), CAST(vec_id % 10 AS INTEGER)]) AS p, list_distinct([CAST(label AS INTEGER), CAST(vec_id % 4 AS INTEGER)]) AS t FROM embeddings),
c AS (SELECT len(list_intersect(p, t)) AS b, len(p) AS np, len(t) AS nt, list_sort(p) = list_sort(t) AS same FROM t),
s AS (SELECT avg(CAST(same AS INTEGER)) AS strict, avg(b / np) AS macro_p, avg(b / nt) AS macro_r, sum(b) / sum(np) AS micro_p, sum(b) / sum(nt) AS micro_r FROM c)
SELECT round(strict, 6) AS strict, round(macro_p, 6) AS macro_p, round(macro_r, 6) AS macro_r, round(2 * macro_p * macro_r / (macro_p + macro_r), 6) AS macro_f1, round(micro_p, 6) AS micro_p, round(micro_r, 6) AS micro_r, round(2 * micro_p * micro_r / (micro_p + micro_r), 6) AS micro_f1 FROM s"""


@query(TYPE_SQL)
def typing_metrics(spark, d):
    rows = read_table(spark, d, "embeddings").select(F.array(F.col("label").cast("int"), (F.col("vec_id") % 10).cast("int")).alias("predicted"), F.array(F.col("label").cast("int"), (F.col("vec_id") % 4).cast("int")).alias("true"))
    out = metrics.typing_metrics(rows)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"WITH {V_SQL}, r AS (SELECT mention_id, wid, round(posterior, 9) AS q, row_number() OVER (PARTITION BY mention_id ORDER BY wid) - 1 AS pos FROM p), b AS (SELECT mention_id, arg_max(pos, struct_pack(a := q, b := -pos)) AS pos FROM r GROUP BY mention_id) SELECT count(*) FILTER (pos = 0) AS correct, count(*) AS mentions FROM b")
def correct_context_count(spark, d):
    from pyspark.sql.window import Window

    p = linker.posterior(_scored(spark, d), "mention_id", F.col("score"))
    ranked = p.withColumns({"pos": F.row_number().over(Window.partitionBy("mention_id").orderBy("wid")) - 1, "q": F.round("posterior", 9)})
    return metrics.correct_context(ranked, "mention_id", "q", "pos")


# Rival annotator


@query()
def baseline_rounds(spark, d):
    """Every file is annotated on its own; its page only tells the entities two links away, none without a page_id."""
    files = read_table(spark, d, "final_articles").select("file_id", "page_id", "title", "text")
    hops = dictionary.two_hops(_edges(spark, d)).select(F.col("src_id").alias("page_id"), F.col("dst_id").alias("id"))
    names = _ids(spark, d).select(F.col("title").alias("entity"), F.col("page_id").alias("id"))
    out = baseline.annotate(files, _pruned(spark, d), hops, "file_id", ids=names, source="page_id")
    return out.select("file_id", F.explode("mentions").alias("x")).select("file_id", "x.*")


@query("SELECT alias, entity, length(alias) AS chars FROM (SELECT DISTINCT alias, entity, row_number() OVER (PARTITION BY entity ORDER BY length(alias) DESC, alias) AS r FROM (SELECT DISTINCT alias, entity FROM aliases WHERE alias IS NOT NULL AND entity IS NOT NULL)) WHERE r = 1")
def longest_alias(spark, d):
    rows = read_table(spark, d, "aliases").where("alias is not null and entity is not null").select("alias", "entity").distinct()
    best = F.min(F.struct((-F.char_length("alias")).alias("neg"), "alias"))
    return rows.groupBy("entity").agg(best.alias("b")).select("b.alias", "entity", (-F.col("b.neg")).cast("long").alias("chars"))


@query(r"SELECT title FROM (SELECT DISTINCT title FROM title2id WHERE regexp_matches(title, '^\p{L}')) ORDER BY md5(title || '7'), title LIMIT 1000")
def title_sample(spark, d):
    """Seeded sample of 1,000 titles that begin with a letter: the sample is the feature."""
    return evaluation.sample(read_table(spark, d, "title2id").select("title"), "title", 1000, seed=7)


# Comparison of two annotators


def _rivals(spark: SparkSession, d: str) -> DataFrame:
    """final_articles against itself with every third text changed and all tags replaced."""
    rows = read_table(spark, d, "final_articles").where("text is not null").select(F.col("file_id").cast("string").alias("title"), "text")
    other = rows.select("title", F.when(F.col("title").cast("long") % 3 == 0, F.concat("text", F.lit(" x"))).otherwise(F.regexp_replace("text", r"\|[a-z_]+\]\]", "|FIRST]]")).alias("text"))
    return evaluation.comparable(rows, other)


@query("SELECT DISTINCT CAST(file_id AS VARCHAR) AS title FROM final_articles WHERE text IS NOT NULL AND file_id % 3 <> 0")
def comparable_pages(spark, d):
    return _rivals(spark, d).select("title").distinct()


def _side_sql(name: str, text: str) -> str:
    """Spans of one annotator's introductions: those it added, neighbours merged two and two."""
    return rf"""{name}0 AS (SELECT title, {_rejoin_sql(f"regexp_replace(split_part({text}, '==', 1), '^[{SPACE_SQL}]+|[{SPACE_SQL}]+$', '', 'g')")} AS t FROM pairs),
{name}1 AS (SELECT title, string_split_regex(t, '{LINK_SQL}') AS gaps, list_transform(regexp_extract_all(t, '{LINK_SQL}', 1), lambda b: string_split(b, '|')) AS links FROM {name}0),
{name}2 AS (SELECT *, list_transform(links, lambda p: CASE WHEN len(p) > 1 THEN p[-2] ELSE p[1] END) AS names FROM {name}1),
{name}3 AS (SELECT title, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(names[i], '')), '') AS bare, length(coalesce(array_to_string(list_transform(range(1, k), lambda i: gaps[i] || names[i]), ''), '') || gaps[k]) AS s, length(names[k]) AS n, links[k] AS p FROM (SELECT *, unnest(range(1, len(links) + 1)) AS k FROM {name}2)),
{name}4 AS (SELECT title, bare, s, s + n AS e FROM {name}3 WHERE (len(p) > 1 AND p[-1] NOT IN ('ANCHOR', 'annotation')) OR (len(p) > 2 AND p[1] = title)),
{name}5 AS (SELECT *, CASE WHEN lag(e) OVER w <= s AND trim(substr(bare, CAST(lag(e) OVER w + 1 AS INTEGER), CAST(s - lag(e) OVER w AS INTEGER)), ' ') = '' THEN 0 ELSE 1 END AS fresh FROM {name}4 WINDOW w AS (PARTITION BY title ORDER BY s, e)),
{name}6 AS (SELECT *, sum(fresh) OVER (PARTITION BY title ORDER BY s, e) AS run FROM {name}5), {name}7 AS (SELECT *, (row_number() OVER (PARTITION BY title, run ORDER BY s, e) - 1) // 2 AS pair FROM {name}6),
{name} AS (SELECT title, min(s) AS s, max(e) AS e FROM {name}7 GROUP BY title, run, pair)"""


@query(rf"""WITH pairs AS (SELECT CAST(file_id AS VARCHAR) AS title, text AS a, regexp_replace(text, '\|[a-z_]+\]\]', '|FIRST]]', 'g') AS b FROM final_articles WHERE text IS NOT NULL AND file_id % 3 <> 0),
{_side_sql('x', 'a')}, {_side_sql('y', 'b')}, j AS (SELECT x.s AS l, y.s AS r FROM x FULL OUTER JOIN y ON x.title = y.title AND x.s < y.e AND y.s < x.e)
SELECT count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS both, count(*) FILTER (r IS NULL) AS left_only, count(*) FILTER (l IS NULL) AS right_only FROM j""")
def annotator_agreement(spark, d):
    return evaluation.agreement(evaluation.side_by_side(_rivals(spark, d)))


@query(rf"""WITH {_mentions_sql("line")} SELECT file_id, line_no, CAST(len(regexp_extract_all(before, '{TOKEN_SQL}')) AS INTEGER) AS token_start, CAST(len(regexp_extract_all(alias, '{TOKEN_SQL}')) AS INTEGER) AS token_len, CAST(length(before) AS INTEGER) AS char_start,
CASE WHEN len(p) > 2 THEN p[1] END AS entity, alias, CASE WHEN len(p) > 1 THEN p[-1] END AS tag FROM u WHERE line_no <= 3000""")
def token_mentions(spark, d):
    rows = read_table(spark, d, "final_articles").select("file_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return linker.first_lines(rows).select("file_id", "line_no", F.explode(linker.token_mentions(F.col("line"))).alias("x")).select("file_id", "line_no", "x.*")


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[{ALPHABETIC_SQL}\p{{M}}\x{{200c}}\x{{200d}}]+'))), ' ') AS bag FROM documents WHERE text IS NOT NULL""")
def document_bag(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{IsAlphabetic}\p{M}\p{IsJoin_Control}]+"), F.lit(0))
    return _docs(spark, d).select("doc_id", F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("bag"))


@query("SELECT title, count(*) AS n FROM (SELECT title FROM title2id WHERE title IS NOT NULL UNION SELECT source FROM redirect WHERE source IS NOT NULL) GROUP BY title")
def title_union(spark, d):
    a = read_table(spark, d, "title2id").select("title").where("title is not null")
    b = read_table(spark, d, "redirect").select(F.col("source").alias("title")).where("title is not null")
    return a.unionByName(b).distinct().groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source AS title FROM redirect WHERE source IS NOT NULL INTERSECT SELECT target FROM redirect WHERE target IS NOT NULL")
def chained_redirects(spark, d):
    rows = read_table(spark, d, "redirect")
    return rows.select(F.col("source").alias("title")).where("title is not null").intersect(rows.select("target").where("target is not null"))


@query("SELECT DISTINCT target AS title FROM redirect WHERE target IS NOT NULL EXCEPT SELECT source FROM redirect WHERE source IS NOT NULL")
def final_targets(spark, d):
    rows = read_table(spark, d, "redirect")
    return rows.select(F.col("target").alias("title")).where("title is not null").distinct().join(rows.select(F.col("source").alias("title")), "title", "left_anti")


@query(f"WITH {C_SQL} SELECT entity, list_sum(list(n)) :: BIGINT AS n, count(*) AS aliases FROM c GROUP BY entity".replace(":: BIGINT", "::BIGINT"))
def aliases_by_entity(spark, d):
    return _counts(spark, d).groupBy("entity").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("aliases"))


@query("SELECT page_class, count(*) AS pages FROM (SELECT CASE WHEN title LIKE '%(footballer)' THEN 'human' WHEN title LIKE '%(river)' OR title LIKE 'Mount %' THEN 'geo' ELSE 'article' END AS page_class FROM title2id WHERE title IS NOT NULL) GROUP BY page_class")
def class_totals(spark, d):
    t = F.col("title")
    kind = F.when(t.endswith("(footballer)"), "human").when(t.endswith("(river)") | t.startswith("Mount "), "geo").otherwise("article")
    return read_table(spark, d, "title2id").where("title is not null").select(kind.alias("page_class")).groupBy("page_class").agg(F.count(F.lit(1)).alias("pages"))


# Streams


def _stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    schema = read_table(spark, d, table).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{table}.parque[t]")  # a pattern, as the table may be one file


@query(f"WITH {L_SQL} SELECT alias, entity, count(*) AS n FROM l WHERE NOT regexp_matches(lower(entity), '^(file:|image:|list of)') GROUP BY ALL")
def stream_alias_counts(spark, d):
    counts = ingest.alias_counts(_stream(spark, d, "documents"))
    return ingest.run_to_files(counts, scratch_path(spark, "stream"), scratch_path(spark, "state"))


@query("SELECT strftime(committed_at, '%Y-%m-%d') AS day, count(*) AS pages FROM final_articles WHERE committed_at IS NOT NULL GROUP BY day")
def stream_daily_revisions(spark, d):
    daily = ingest.revisions_per_window(_stream(spark, d, "final_articles"), "committed_at")
    out = ingest.run_to_files(daily, scratch_path(spark, "stream"), scratch_path(spark, "state"))
    return out.select(F.date_format("from", "yyyy-MM-dd").alias("day"), "pages")
