"""A rival annotator for comparison: three rounds of alias matching with overlaps resolved page by page."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import markup as m
from linkloom.langpack import MONTHS, WEEKDAYS
from linkloom.operators.dictionary import page_links
from linkloom.operators.mentions import alias_places, first_word
from linkloom.operators.orphans import bloom_shards, might_contain
from linkloom.session import lookup_join, materialize, spread

#: Words by which names are brought to the pages they may stand on; of a longer name the first so many. With fewer, all
#: names of a family ("Treaty of ..") would go to each page that holds one of them.
KEY_WORDS = 8

_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
Found = tuple[int, int, str, str, str]  # start, end, entity, alias, round


def linkable(links: DataFrame, counts: DataFrame, excluded: DataFrame) -> DataFrame:
    """Links (.., entity, alias) that name something that may be looked for elsewhere: no month, weekday or number, no
    lower-case name, an entity that is known (counts: entity) and not excluded (entity)."""
    named = links.where(_nameable()).join(counts.select("entity").distinct(), "entity", "left_semi")
    return named.join(excluded.select("entity").where("entity is not null").distinct(), "entity", "left_anti").select(links.columns)


def _nameable() -> Column:
    a, e = F.col("alias"), F.col("entity")
    return (a != "") & ~a.isin(*MONTHS, *WEEKDAYS) & ~m.is_number(a) & ~a.rlike(r"^[\p{Ll}\p{N}]") & ~e.rlike(r"^\p{Ll}")


def anchors(text: str, masked: bool = False) -> tuple[str, list[Found]]:
    """The text without link signs, or with links as '#', and the links as spans of it."""
    out, at, size, found = [], 0, 0, []
    for h in _LINK.finditer(text):
        gap = text[at : h.start()]
        parts = h[1].split("|")
        entity, alias = parts[0], (parts[1] if len(parts) > 1 else parts[0])
        out += [gap, "#" * len(alias) if masked else alias]
        size += len(gap)
        found.append((size, size + len(alias), entity, alias, "ANCHOR"))
        size += len(alias)
        at = h.end()
    return "".join(out) + text[at:], found


def matches(text: str, aliases: list[tuple[str, str]], taken: list[Found], name: str) -> list[Found]:
    """Every place of every alias (alias, entity), the longest first; two of one entity do not overlap, and none
    overlaps an anchor."""
    by_word: dict[str, list[str]] = {}
    entities: dict[str, list[str]] = {}
    for alias, entity in sorted(set(aliases)):
        if alias not in entities:
            by_word.setdefault(first_word(alias), []).append(alias)
        entities.setdefault(alias, []).append(entity)
    held = bytearray(len(text))
    for s, e, *_ in taken:
        held[s:e] = b"\x01" * (e - s)
    found: list[Found] = []
    by_entity: dict[str, list[tuple[int, int]]] = {}
    for size, alias, at in sorted((-len(a), a, at) for at, a in alias_places(text, by_word)):
        end = at - size
        if held.find(1, at, end) >= 0:
            continue
        for entity in entities[alias]:
            own = by_entity.setdefault(entity, [])
            if all(at >= e or end <= s for s, e in own):
                own.append((at, end))
                found.append((at, end, entity, alias, name))
    return found


def nearest(x: Found, others: list[Found]) -> int:
    """Distance to the nearest annotation of the same entity: starts to the left, ends to the right."""
    return min((x[0] - o[0] if o[0] <= x[0] else o[1] - x[1] for o in others if o[2] == x[2]), default=1 << 30)


def settle(found: list[Found], fixed: list[Found]) -> list[Found]:
    """Overlaps decided: spans that overlap no neighbour stand; of two that do, the longer, then the one nearer to an
    annotation of its entity, then the later one."""
    rows = sorted(set(found))
    sure = [x for i, x in enumerate(rows) if (not i or rows[i - 1][1] <= x[0]) and (i + 1 == len(rows) or rows[i + 1][0] >= x[1])]
    known = fixed + sure
    certain = set(sure)
    doubtful = [x for x in rows if x not in certain]
    kept: list[Found] = []
    for x in doubtful:
        if kept and kept[-1][1] > x[0]:
            last = kept[-1]
            a, b = last[1] - last[0], x[1] - x[0]
            if b > a or (b == a and nearest(x, known) <= nearest(last, known)):
                kept[-1] = x
        else:
            kept.append(x)
    return sorted(sure + kept)


def three_rounds(text: str, first: list[tuple[str, str]], second: list[tuple[str, str]], third: list[tuple[str, str]]) -> tuple[str, list[Found]]:
    """Plain text and annotations: the links, then names of linked entities, titles and names of entities two links away."""
    plain, done = anchors(text)
    for aliases, name in ((first, "FIRST"), (second, "SECOND"), (third, "THIRD")):
        if not aliases:
            continue
        masked = list(plain)
        for s, e, *_ in done:
            masked[s:e] = "#" * (e - s)
        done += settle(matches("".join(masked), aliases, done, name), done)
    return plain, sorted(done)


def annotate(
    pages: DataFrame, counts: DataFrame, near: DataFrame, page: str = "page_id", title: str = "title", text: str = "text", excluded: DataFrame | None = None,
    ids: DataFrame | None = None, source: str | None = None,
) -> DataFrame:
    """(page, text, mentions) of the three rounds. counts (alias, entity, n); near (page, entity): two links away; the links
    of a page name what is looked for in the first round, but for excluded entities (entity).

    With ids (entity, id), near is (source, id), each pair once, where source is a column of pages: pairs stay numbers, and
    are only compared with the names that stand on a page.

    Names are first joined to the word sequences of the pages, so a page receives only names whose first words stand on it,
    however many names its entities have; it is then read on its own. Until then names are numbers.
    """
    if ids is None:
        near = near.select(F.col(page).alias("__source"), F.col("entity").alias("__id")).where("__id is not null").distinct()
        ids, source = near.select(F.col("__id").alias("entity"), "__id").distinct(), page
    else:
        near, ids = near.select(F.col(source).alias("__source"), F.col("id").alias("__id")), ids.select("entity", F.col("id").alias("__id"))
    own = materialize(pages.select(page, F.col(source).alias("__source"), m.drop_own_links(F.col(text), F.col(title)).alias("__plain")), "plain")
    linked = page_links(own, page, "__plain").select(page, "entity", F.substring_index("alias", "|", 1).alias("alias")).where(_nameable())
    if excluded is not None:
        linked = linked.join(excluded.select("entity").where("entity is not null").distinct(), "entity", "left_anti")
    # that its entity is known goes without saying where one of its names is found
    linked = linked.select(page, F.xxhash64("entity").alias("hash"), F.col("entity").alias("linked")).distinct()
    names = counts.select("entity", "alias").where((F.char_length("alias") > 1) & m.starts_upper(F.col("alias"))).withColumn("kind", F.lit("name"))
    titles = ids.select("entity", F.col("entity").alias("alias"), F.lit("title").alias("kind"))
    keyed = names.unionByName(titles).where("entity is not null").withColumn("words", _words(F.col("alias"))).where("words is not null and size(words) > 0")
    keyed = keyed.select("entity", F.struct("alias", "kind").alias("name"), F.least(F.size("words"), F.lit(KEY_WORDS)).alias("n"), _sequence(F.slice("words", 1, KEY_WORDS)).alias("key"))
    keyed = lookup_join(keyed.groupBy("entity", "n", "key").agg(F.collect_set("name").alias("names")), ids, ["entity"])
    keyed = materialize(keyed.select("entity", "n", "key", "names", "__id", F.xxhash64("entity").alias("hash"), F.monotonically_increasing_id().alias("no")), "names")
    lengths = sorted(r["n"] for r in keyed.select("n").distinct().collect())  # KEY_WORDS at most
    filters = materialize(bloom_shards(keyed, F.col("key"), keyed.count()), "filters")
    words = own.select(page, "__source", _words(_bare(F.col("__plain"))).alias("words"))
    spans = [_runs(F.col("words"), n) for n in lengths] or [F.array().cast("array<bigint>")]
    stands = words.select(page, "__source", F.explode(F.array_distinct(F.concat(*spans))).alias("key")).where(might_contain(filters, F.col("key")))
    hits = lookup_join(stands, keyed.select("key", "no", "hash", "__id"), ["key"], "inner", written=True).drop("key")
    hits = hits.join(linked, [page, "hash"], "left").drop("hash").join(near.withColumn("near", F.lit(True)), ["__source", "__id"], "left")
    hits = hits.where("near or linked is not null").select(page, "no", "linked", "near")
    hits = lookup_join(hits, keyed.select("no", "entity", "names"), ["no"], "inner", written=True).withColumn("linked", F.col("linked") == F.col("entity"))
    found = hits.where("linked or near").select(page, "entity", "linked", "near", F.explode("names").alias("name")).select(page, "entity", "linked", "near", "name.*")
    pair = F.struct("alias", "entity")
    of = lambda when, name: F.array_sort(F.collect_set(F.when(when, pair))).alias(name)
    named = F.col("kind") == "name"
    sides = found.groupBy(page).agg(of(named & F.col("linked"), "first"), of(~named & F.col("near"), "second"), of(named & F.col("near"), "third"))
    rows = spread(own.select(page, "__plain")).join(sides, [page], "left")  # sides lie by page already

    @F.pandas_udf("text string, mentions array<struct<start:int,end:int,entity:string,alias:string,tag:string>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pairs = lambda x: [(p["alias"], p["entity"]) for p in x] if x is not None else []
        for texts, a, b, c in batches:
            done = [three_rounds(t or "", pairs(x), pairs(y), pairs(z)) for t, x, y, z in zip(texts, a, b, c)]
            yield pd.DataFrame({"text": [d[0] for d in done], "mentions": [[dict(zip(("start", "end", "entity", "alias", "tag"), f)) for f in d[1]] for d in done]})

    # else the optimizer copies the rounds into a filter below an explode
    return rows.select(page, run.asNondeterministic()("__plain", "first", "second", "third").alias("r")).select(page, "r.text", "r.mentions")


def _bare(text: Column) -> Column:
    """The text with each link as its alias, which stands second, or alone."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\[[^\[\]|]*\|([^\[\]|]*)[^\[\]]*\]\]", "$1"), r"\[\[([^\[\]|]*)\]\]", "$1")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def _runs(words: Column, n: int) -> Column:
    """Keys of all runs of n words."""
    made = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: _sequence(F.slice(words, i, n)))
    return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<bigint>"))


def _sequence(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))
