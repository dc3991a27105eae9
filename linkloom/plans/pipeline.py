"""From a dump to the annotated corpus: the stages as tables, each read from where the one before was written."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions import rewriting
from linkloom.functions.markup import word_tokens
from linkloom.langpack import ENGLISH, LanguagePack
from linkloom.operators import cascade, coref, dictionary, linker, mentions, routing
from linkloom.session import lookup_join
from linkloom.sources import dump


@dataclass(frozen=True)
class Supplied:
    """Tables that no stage makes. Each may be left out."""

    persons: DataFrame | None = None  # entity
    corefs: DataFrame | None = None  # entity, coref
    genders: DataFrame | None = None  # name, gender
    ner: DataFrame | None = None  # page_id, line_no, start, end, alias, tag
    word_vectors: DataFrame | None = None  # word, vector: with entity_vectors, open mentions are decided by their context
    entity_vectors: DataFrame | None = None  # entity, vector
    sentence_end: DataFrame | None = None  # page_id, line_no, end_char: ends of the sentences in the lines without links


class Corpus:
    """The stages of one run under a folder; a stage whose tables are there already is not run again."""

    def __init__(self, spark: SparkSession, path: str, pack: LanguagePack = ENGLISH, supplied: Supplied = Supplied()):
        self.spark, self.path, self.pack, self.supplied = spark, path.rstrip("/"), pack, supplied

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("ignore").parquet(f"{self.path}/{name}")
        return self.table(name)

    def _given(self, df: DataFrame | None, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema) if df is None else df

    def dictionaries(self, dump_path: str) -> None:
        """Stage 1: titles, redirects, articles, category and list pages."""
        pages = self._keep("page", dump.first_pages(dump.read_dump(self.spark, dump_path)))
        self._keep("title_id", dump.title_ids(pages))
        hat = pages.select(F.explode(routing.hatnote_redirects(F.col("text"), self.pack)).alias("source"), F.col("title").alias("target")).withColumn("kind", F.lit("article"))
        links = routing.redirects(pages, self.pack).unionByName(hat).groupBy("source").agg(F.min(F.struct("target", "kind")).alias("r"))
        self._keep("redirect", links.select("source", "r.target", "r.kind"))
        self._keep("routed", pages.withColumn("kind", routing.route(F.col("title"), self.pack)).where("kind is not null"))

    def articles(self) -> None:
        """Stage 2: page classes, stripped texts, alias and link counts, and their pruned forms."""
        routed, redirects = self.table("routed"), self.table("redirect")
        live = routed.join(redirects.select(F.col("source").alias("title")), "title", "left_anti")
        classed = live.withColumn("page_class", F.when(F.col("kind") == "article", routing.page_class(F.col("title"), F.col("text"), self.pack)).otherwise(F.col("kind")))
        classed = self._keep("classed", classed.where("page_class is not null"))
        self._keep("page_flag", routing.page_flags(classed.where("kind = 'article'"), self.pack))
        self._keep("page_category", dictionary.page_categories(classed, pack=self.pack))
        special = classed.where("page_class in ('human', 'geo', 'number', 'other')")
        self._keep("disambiguation", dictionary.disambiguation_entries(special.select(F.struct("title", "page_class").alias("k"), "text"), "k", pack=self.pack).select("k.*", "pos", "entity"))
        text = rewriting.strip_page(F.col("text"), F.col("title"), self.pack)
        self._keep("article", classed.where("page_class = 'article'").select("page_id", "title", text.alias("text")))
        links = dictionary.page_links(classed.where("page_class in ('article', 'stub', 'list')"), "page_id")
        counts = self._keep("alias_count", dictionary.merge_alias_counts(dictionary.alias_counts(links, redirects, self.pack)))
        of_articles = links.join(classed.where("page_class = 'article'").select("page_id"), "page_id", "left_semi")
        edges = dictionary.link_edges(dictionary.resolve_redirects(of_articles, redirects), self.table("title_id"), "page_id")
        excluded = self.table("page_flag").select("title").unionByName(special.select("title"))
        pruned = self._keep("alias", dictionary.named_entities(dictionary.prune_aliases(counts, self.table("title_id").select("title"), excluded)))
        self._keep("popular", dictionary.popular(pruned))
        kept = dictionary.surviving_titles(self.table("title_id"), pruned)
        self._keep("link", dictionary.prune_edges(edges, kept.select(F.col("page_id").alias("id"))))

    def annotate(self) -> None:
        """Stage 3: mentions, their candidates, and the annotated lines."""
        counts, redirects = self.table("alias"), self.table("redirect")
        pages = self.table("article")
        lines = self._keep("line", mentions.find_mentions(pages, counts, redirects, pack=self.pack))
        titles = pages.select("page_id", "title")
        met = lines.select("page_id", "line_no", F.explode("mentions").alias("x")).select("page_id", "line_no", F.col("x.start").cast("long").alias("start"), (F.col("x.start") + F.col("x.len")).cast("long").alias("end"), "x.entity", "x.alias", "x.tag")
        if self.supplied.ner is not None:
            known = met.where("tag = 'acronym_entity'").select("page_id", F.regexp_replace("alias", "[^A-Z]", "").alias("__a"), F.col("alias").alias("entity")).withColumnRenamed("__a", "alias").dropDuplicates(["page_id", "alias"])
            met = mentions.merge_ner(met, self.supplied.ner, ["page_id", "line_no"], known)
        special = self.table("disambiguation")
        facts = cascade.gather_facts(
            lookup_join(met, titles, ["page_id"]), counts, redirects, self.table("popular"), self.table("link"), self.table("title_id"),
            self._given(self.supplied.persons, "entity string"), special.where("page_class = 'human'").select("title"), special.where("page_class = 'geo'").select("title"),
        )
        done = cascade.resolve(facts).select("page_id", "line_no", F.struct(F.col("start").cast("int").alias("start"), (F.col("end") - F.col("start")).cast("int").alias("len"), F.col("resolved").alias("entity"), "alias", F.col("final_tag").alias("tag")).alias("x"))
        grouped = done.groupBy("page_id", "line_no").agg(F.array_sort(F.collect_list("x")).alias("x"))
        both = lines.select("page_id", "line_no", "text").join(grouped, ["page_id", "line_no"], "left")
        none = F.array().cast("array<struct<start:int,len:int,entity:string,alias:string,tag:string>>")
        ends = self._given(self.supplied.sentence_end, "page_id long, line_no int, end_char int")
        ends = ends.groupBy("page_id", "line_no").agg(F.array_sort(F.collect_set(F.col("end_char").cast("int"))).alias("ends"))
        both = lookup_join(both.withColumn("x", F.coalesce("x", none)), ends, ["page_id", "line_no"])
        text = mentions.render(F.col("text"), F.col("x"))
        text = F.when(F.col("ends").isNull(), text).otherwise(mentions.split_at(text, mentions.shifted_ends(F.col("ends"), F.col("x"))))
        parts = both.select("page_id", F.col("line_no").alias("__line"), F.posexplode(F.split(text, "\n")).alias("__part", "text"))
        order = Window.partitionBy("page_id").orderBy("__line", "__part")  # one sentence a line, counted anew
        self._keep("annotated_line", parts.select("page_id", (F.row_number().over(order) - 1).alias("line_no"), "text"))

    def resolve(self) -> None:
        """Stage 4: malformed lines dropped, candidates decided by context where vectors are supplied and else by use,
        coreferences carried forward, final texts."""
        lines = self.table("annotated_line").where(~mentions.is_malformed(F.col("text")))
        spans_ = lines.select("page_id", "line_no", F.posexplode(mentions.parse_annotations(F.col("text"))).alias("pos", "a"))
        context = lines.select("page_id", "line_no", word_tokens(mentions.bare_text(F.col("text"))).alias("context"))
        open_ = spans_.where(mentions.needs_linker(F.col("a.entity"), F.col("a.tag"))).join(context, ["page_id", "line_no"])
        open_ = self._keep("open_mention", open_.select(F.concat_ws("/", "page_id", "line_no", "pos").alias("key"), F.col("a.alias").alias("alias"), F.col("a.entity").alias("candidates"), "context"))
        best = linker.greedy_choice(open_, self.table("alias"), "key")
        if self.supplied.word_vectors is not None and self.supplied.entity_vectors is not None:
            by_context = linker.context_choice(open_, self.table("alias"), self.supplied.word_vectors, self.supplied.entity_vectors, "key")
            best = linker.with_fallback(open_, by_context, best, "key")
        best = best.withColumnRenamed("entity", "choice")
        chosen = lookup_join(spans_.withColumn("key", F.concat_ws("/", "page_id", "line_no", "pos")), best, ["key"])
        people = chosen.select("page_id", F.coalesce("choice", "a.entity").alias("entity")).where("entity is not null").distinct()
        genders = coref.gender_votes(people.select("entity").distinct(), "entity", "entity", self._given(self.supplied.genders, "name string, gender string")).where("gender is not null")
        persons = self._given(self.supplied.persons, "entity string").distinct()
        gendered = lookup_join(people, genders.select("entity", "gender").join(persons, "entity", "left_semi"), ["entity"], "inner")
        keys = lookup_join(people, self._given(self.supplied.corefs, "entity string, coref string").groupBy("entity").agg(F.array_sort(F.collect_set("coref")).alias("keys")), ["entity"], "inner")
        by_page = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("lines"))
        sides = {
            "choices": chosen.where("choice is not null").groupBy("page_id").agg(F.collect_list(F.struct("line_no", "pos", "choice")).alias("choices")),
            "people": gendered.groupBy("page_id").agg(F.collect_list(F.struct("entity", "gender")).alias("people")),
            "keys": keys.groupBy("page_id").agg(F.collect_list(F.struct("entity", "keys")).alias("keys")),
        }
        for side in sides.values():
            by_page = by_page.join(side, "page_id", "left")
        lang, persons_tags = self.pack.code, self.pack.persons

        @F.pandas_udf("string")
        def finish(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            rows = lambda x: [] if x is None else list(x)
            for pages in batches:
                out = []
                for text, choices, people, keys in zip(*pages):
                    chosen = {(c["line_no"], c["pos"]): c["choice"] for c in rows(choices)}
                    gender = {p["entity"]: p["gender"] for p in rows(people)}
                    names = {k["entity"]: list(k["keys"]) for k in rows(keys)}
                    state: dict = {}
                    out.append("\n".join(coref.resolve_line(replace_entities(x["text"], x["line_no"], chosen), state, names, gender, lang, persons_tags) for x in text))
                yield pd.Series(out)

        final = by_page.select("page_id", finish("lines", "choices", "people", "keys").alias("text"))
        self._keep("final", lookup_join(final, self.table("article").select("page_id", "title"), ["page_id"], "inner"))

    def run(self, dump_path: str) -> DataFrame:
        self.dictionaries(dump_path)
        self.articles()
        self.annotate()
        self.resolve()
        return self.table("final")


def replace_entities(line: str, line_no: int, chosen: dict[tuple[int, int], str]) -> str:
    """The line with the entity of each decided link replaced."""
    import re

    at = iter(range(1 << 30))

    def one(hit: re.Match) -> str:
        entity = chosen.get((line_no, next(at)))
        parts = hit[1].split("|")
        return hit[0] if entity is None else "[[" + "|".join([entity, *parts[1:]]) + "]]"

    return re.sub(r"\[\[([^\[\]]*)\]\]", one, line)
