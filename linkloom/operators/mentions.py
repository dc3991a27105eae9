"""Mentions: unlinking with positions, alias matching inside the gaps, acronyms, NER spans, parsing and rendering."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import markup as m
from linkloom.langpack import ENGLISH, LanguagePack
from linkloom.operators.spans import free_spans
from linkloom.session import lookup_join, spread

# Labels of the entity recogniser that may stand last in a two-part link.
NER_TAGS = ("SET", "ORDINAL", "PER", "LOC", "ORG", "DATE", "NUMBER", "MISC", "LOCATION", "PERSON", "ORGANIZATION", "DURATION", "MONEY", "PERCENT", "TIME")
#: A word as alias_places reads it, for the JVM.
WORD = r"[\p{L}\p{N}_]+"
#: Hashes of words that go with each entity of a page to its names, at most: 256 bytes.
MAX_HASHES = 128
MENTION = "struct<line_no:int,start:int,len:int,entity:string,alias:string,tag:string>"


# Annotated text as columns


def parse_annotations(line: Column) -> Column:
    """Array of (entity, alias, tag, parts): the alias stands second to last, the tag last; two-part links have no entity."""

    def one(body: Column) -> Column:
        p = F.split(body, r"\|")
        n = F.size(p)
        return F.struct(
            F.when(n > 2, p[0]).alias("entity"), F.when(n > 1, F.element_at(p, -2)).otherwise(p[0]).alias("alias"), F.when(n > 1, F.element_at(p, -1)).alias("tag"), n.alias("parts")
        )

    return F.transform(m.link_bodies(line), one)


def annotation_spans(line: Column) -> Column:
    """Array of (start, len, entity, alias, tag) with positions in the text without link signs."""
    spans = "array<struct<start:int,len:int,entity:string,alias:string,tag:string>>"
    # gaps and links travel as one array: what a lambda captures would be computed anew for each of its steps
    pairs = F.zip_with(F.split(line, m.LINK, -1), parse_annotations(line), lambda g, x: F.struct(F.char_length(g).alias("gap"), x.alias("link")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        link, start = x["link"], acc["at"] + x["gap"]
        size = F.char_length(link["alias"])
        span = F.struct(start.alias("start"), size.alias("len"), link["entity"].alias("entity"), link["alias"].alias("alias"), link["tag"].alias("tag"))
        return F.struct((start + size).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(F.filter(pairs, lambda x: x["link"].isNotNull()), zero, step, lambda acc: acc["out"])


def bare_text(line: Column) -> Column:
    """The text with each link as its alias."""
    return F.regexp_replace(F.regexp_replace(line, r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\|[^\[\]|]*\]\]", "$1"), r"\[\[([^\[\]|]*)\]\]", "$1")


def render_link(entity: Column, alias: Column, tag: Column) -> Column:
    """[[entity|alias|tag]], [[alias|tag]] without an entity, the bare alias without a tag."""
    return F.when(tag.isNull(), alias).otherwise(F.concat(F.lit("[["), F.concat_ws("|", entity, alias, tag), F.lit("]]")))


def render(text: Column, mentions: Column) -> Column:
    """text with mentions (start, len, entity, alias, tag), sorted and free of overlaps, written into it."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct((x["start"] + x["len"]).alias("at"), F.concat(acc["out"], gap, render_link(x["entity"], x["alias"], x["tag"])).alias("out"))

    return F.aggregate(mentions, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def split_at(line: Column, ends: Column) -> Column:
    """The line with a break at each of the sorted positions, all but the last, and no space at the front of the parts."""
    cuts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), F.array(F.char_length(line)))
    parts = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.substring(line, cuts[i - 1] + 1, cuts[i] - cuts[i - 1]))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i > 0, F.ltrim(p)).otherwise(p)), "\n")


def shifted_ends(ends: Column, mentions: Column) -> Column:
    """Sentence ends of a text as positions in it once rendered with mentions; an end inside a mention moves behind it."""

    def moved(end: Column) -> Column:
        before = F.filter(mentions, lambda x: x["start"] < end)
        zero = F.greatest(end, F.coalesce(F.array_max(F.transform(before, lambda x: x["start"] + x["len"])), end))
        return F.aggregate(before, zero, lambda s, x: s + F.char_length(render_link(x["entity"], x["alias"], x["tag"])) - x["len"])

    return F.array_distinct(F.transform(ends, moved))


def is_malformed(line: Column) -> Column:
    """Whether a line must be dropped: a link with other than three parts, unless it ends with a known label, or brackets
    inside a link."""
    links = parse_annotations(line)
    bad = F.exists(links, lambda x: (x["parts"] != 3) & ~F.coalesce(x["tag"].isin(*NER_TAGS), F.lit(False)))
    return bad | line.rlike(r"\[\[[^\]]*\[\[")


def needs_linker(entity: Column, tag: Column) -> Column:
    return F.coalesce(tag.rlike("multiple|part_of_seen_entity") & F.contains(entity, F.lit("###")), F.lit(False))


def droppable(entity: Column, alias: Column, tag: Column) -> Column:
    """Annotations a comparison leaves out: coreferences, lower-case and numeric aliases, and those without an entity."""
    return entity.isNull() | F.contains(tag, F.lit("coref")) | alias.rlike(r"^\p{Ll}") | m.is_number(alias)


# Matching


_ACRONYM = re.compile(r"\s\(([A-Z.]+)\)")


def acronym_pairs(text: str) -> list[tuple[int, str, int, str]]:
    """(start, expansion, start of the acronym, acronym) for each ' (ABC)' spelled by the last capitals before it.

    Each bracket is read against the text from its right end to the left: the capitals met must be the acronym's letters
    backwards. Where the last of them fits, the expansion begins.
    """
    out = []
    for hit in _ACRONYM.finditer(text):
        wanted = [c for c in reversed(hit[1]) if c != "."]
        at = hit.start()
        while wanted and at:
            at -= 1
            if text[at].isupper():
                if text[at] != wanted[0]:
                    break
                del wanted[0]
        if wanted or not hit[1].strip("."):
            continue
        name = text[at : hit.start()].rstrip()
        out.append((at, name if name[-1].isalnum() else name[:-1], hit.start(1), hit[1]))
    return out


_WORD = re.compile(r"\w+")


def alias_places(text: str, by_word: dict[str, list[str]]) -> Iterator[tuple[int, str]]:
    """(start, alias) of every place of every alias between word borders, in one pass over the words of text. by_word holds
    the aliases under their first word; under '' those that begin with another sign."""
    word = lambda c: c.isalnum() or c == "_"
    for a in by_word.get("", ()):
        for hit in re.finditer(rf"\b{re.escape(a)}\b", text):
            yield hit.start(), a
    for w in _WORD.finditer(text):
        for a in by_word.get(w[0], ()):
            at, end = w.start(), w.start() + len(a)
            if text.startswith(a, at) and word(a[-1]) != (end < len(text) and word(text[end])):
                yield at, a


def first_word(alias: str) -> str:
    head = _WORD.match(alias)
    return head[0] if head else ""


class AliasSet:
    """Aliases of a page, matched longest first at word borders, case-sensitive; entities may add theirs later."""

    def __init__(self, aliases: list[str]):
        self.aliases: set[str] = set()
        self.by_word: dict[str, list[str]] = {}
        self.add(aliases)

    def add(self, aliases: list[str]) -> None:
        for a in aliases:
            if a and a not in self.aliases:
                self.aliases.add(a)
                self.by_word.setdefault(first_word(a), []).append(a)

    def find(self, text: str) -> list[tuple[int, str]]:
        """Longer aliases win wherever they stand: all places of the longest are taken, then those of the next."""
        places = sorted((-len(a), a, at) for at, a in alias_places(text, self.by_word))
        taken, found = bytearray(len(text)), []
        for size, a, at in places:
            if taken.find(1, at, at - size) < 0:
                taken[at : at - size] = b"\x01" * -size
                found.append((at, a))
        return sorted(found)


def usable(alias: str) -> bool:
    return bool(alias) and not alias[0].islower() and not alias.isnumeric()


def page_mentions(lines: list[str], own: list[str], entity_aliases: dict[str, list[str]], pack: LanguagePack = ENGLISH) -> tuple[list[str], list[dict]]:
    """Unlinked lines and mentions of a page.

    own are the aliases known from the start; entity_aliases holds the aliases of every entity that links may name. A
    link to another name, or to a part of a page (#), is plain text. The aliases of an entity can be matched behind
    its first link only, in this line and later ones.
    """
    known, texts, out = AliasSet([a for a in own if usable(a)]), [], []
    skip = re.compile(rf"\[\[(?:{'|'.join(pack.namespaces)}):", re.I)
    for no, line in enumerate(lines):
        if skip.match(line):
            texts.append("")
            continue
        text, spans, at = "", [], 0

        def gap(part: str, base: int, no=no, spans=spans) -> None:
            spans += [(base + i, len(a), None, a, "alias_match") for i, a in known.find(part)]

        for hit in re.finditer(r"\[\[((?:(?!\[\[).)*?)\]\]", line):
            part = line[at : hit.start()]
            gap(part, len(text))
            text += part
            entity, bar, alias = hit[1].partition("|")
            alias = alias if bar else entity
            if entity in entity_aliases and "#" not in entity:
                spans.append((len(text), len(alias), entity, alias, "annotation"))
                known.add([a for a in entity_aliases[entity] if usable(a)])
            text += alias
            at = hit.end()
        gap(line[at:], len(text))
        text += line[at:]
        held = bytearray(len(text))
        for b, k, *_ in spans:
            held[b : b + k] = b"\x01" * k
        free = lambda s, n: held.find(1, s, s + n) < 0
        for start, name, where, letters in acronym_pairs(text):
            for at, part, tag in ((start, name, "acronym_entity"), (where, letters, "acronym")):
                if free(at, len(part)):
                    spans.append((at, len(part), None, part, tag))
                    held[at : at + len(part)] = b"\x01" * len(part)
        texts.append(text)
        out += [dict(zip(("line_no", "start", "len", "entity", "alias", "tag"), (no, *s))) for s in sorted(spans, key=lambda s: s[:2])]
    return texts, out


def word_hashes(text: Column) -> Column:
    """Short hashes of the words outside links, each once; null for null, and beyond MAX_HASHES."""
    gaps = F.regexp_replace(text, r"\[\[(?:(?!\[\[)[^\n])*?\]\]", " ")
    hashes = F.array_distinct(F.transform(F.regexp_extract_all(gaps, F.lit(WORD), F.lit(0)), _word_hash))
    return F.when(F.size(hashes) <= MAX_HASHES, hashes)


def _word_hash(word: Column) -> Column:
    return (F.pmod(F.xxhash64(word), F.lit(1 << 16)) - (1 << 15)).cast("smallint")


def find_mentions(pages: DataFrame, counts: DataFrame, redirects: DataFrame, page: str = "page_id", title: str = "title", text: str = "text", pack: LanguagePack = ENGLISH) -> DataFrame:
    """(page, line_no, text, mentions) of linked pages. Links of heading lines are read as plain words.

    counts (alias, entity, n) and redirects (source, target) give the names of the page itself and of the entities it
    links to. They are joined to the pages' entities, never sent whole: a page receives only the names of its own
    entities that begin with a word it has outside links, and is then read on its own.
    """
    pages = pages.withColumn(text, m.flatten_headers(F.col(text)))
    entities = F.transform(m.link_bodies(F.col(text)), m.link_entity)
    own = F.array_union(F.coalesce(entities, F.array().cast("array<string>")), F.array(title))
    wanted = pages.select(page, word_hashes(F.col(text)).alias("words"), F.explode(own).alias("entity"))
    names = counts.select("entity", "alias").unionByName(redirects.select(F.col("target").alias("entity"), F.regexp_replace("source", "'s$", "").alias("alias"))).distinct()
    head = F.regexp_extract("alias", rf"^{WORD}", 0)
    of = names.groupBy("entity").agg(F.collect_list(F.struct("alias", F.when(head != "", _word_hash(head)).alias("head"))).alias("aliases"))
    # a page without word hashes and a name that begins with another sign are not told apart here
    fit = F.filter("aliases", lambda a: a["alias"].isNotNull() & F.coalesce(F.array_contains("words", a["head"]), F.lit(True)))
    met = lookup_join(wanted, of, ["entity"], "inner").select(page, "entity", F.transform(fit, lambda a: a["alias"]).alias("aliases"))
    given = met.groupBy(page).agg(F.collect_list(F.struct("entity", "aliases")).alias("names"))
    rows = spread(pages.select(page, title, text)).join(given, [page], "left")  # given lies by page already: written nowhere, moved once

    @F.pandas_udf(f"array<struct<text:string,mentions:array<{MENTION}>>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for titles, texts, names in batches:
            done = []
            for t, x, n in zip(titles, texts, names):
                aliases: dict[str, list[str]] = {}
                for e in n if n is not None else ():
                    aliases.setdefault(e["entity"], []).extend(e["aliases"])
                lines, found = page_mentions((x or "").split("\n"), [t or "", *aliases.get(t, [])], aliases, pack)
                of: list[list[dict]] = [[] for _ in lines]
                for f in found:
                    of[f["line_no"]].append(f)
                done.append([{"text": line, "mentions": own} for line, own in zip(lines, of)])
            yield pd.Series(done)

    # else the optimizer copies the reading of a page into a filter below the explode
    read = rows.select(page, run.asNondeterministic()(title, text, "names").alias("r"))
    return read.select(page, F.posexplode("r").alias("line_no", "x")).select(page, "line_no", "x.text", "x.mentions")


def merge_ner(mentions: DataFrame, ner: DataFrame, keys: list[str], acronyms: DataFrame | None = None) -> DataFrame:
    """mentions (keys, start, end, entity, alias, tag) with the recogniser's spans (keys, start, end, alias, tag) that
    overlap none; a span whose text is a known acronym of its page (first key, alias, entity) gets it as entity."""
    new = free_spans(ner, mentions, keys)
    if acronyms is not None:
        known = acronyms.select(keys[0], "alias", F.col("entity").alias("__long"))
        new = new.join(known, [keys[0], "alias"], "left")
        new = new.withColumns({"entity": F.col("__long"), "tag": F.when(F.col("__long").isNotNull(), "acronym_ner").otherwise(F.col("tag"))}).drop("__long")
    return mentions.unionByName(new, allowMissingColumns=True)
