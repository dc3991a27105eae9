"""Which pages are articles, categories, lists, redirects, stubs or disambiguations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import markup as m
from linkloom.langpack import ENGLISH, LanguagePack


def in_namespace(title: Column, pack: LanguagePack = ENGLISH) -> Column:
    return F.lower(title).rlike(rf"^(?:{'|'.join(pack.namespaces)}):")


def is_category(title: Column, pack: LanguagePack = ENGLISH, compat: bool = False) -> Column:
    """Title of a category page; compat=True takes any title that begins with the word."""
    return F.lower(title).startswith(pack.category if compat else pack.category + ":")


def is_list(title: Column, pack: LanguagePack = ENGLISH) -> Column:
    return F.lower(title).startswith(pack.list_of)


def route(title: Column, pack: LanguagePack = ENGLISH, compat: bool = False) -> Column:
    """'category', 'list', 'article', or null for pages of other namespaces."""
    return F.when(is_category(title, pack, compat), "category").when(is_list(title, pack), "list").when(~in_namespace(title, pack), "article")


def text_redirect(text: Column, pack: LanguagePack = ENGLISH) -> Column:
    """Target of a page whose text is a redirect: its first link up to a bar, underscores as spaces; else null."""
    target = F.translate(F.substring_index(F.regexp_extract(text, m.LINK, 1), "|", 1), "_", " ")
    return F.when(F.lower(text).startswith("#" + pack.redirect), F.nullif(target, F.lit("")))


def redirects(pages: DataFrame, pack: LanguagePack = ENGLISH, compat: bool = False) -> DataFrame:
    """(source, target, kind) of pages (title, redirect_title, text). A redirect in the text goes before the element's.

    kind is 'list' if either side is a list, else 'category' if either is a category, else 'article' if neither side
    lies in another namespace; other redirects are left out, as are pages that redirect to nothing.
    """
    source, target = F.col("source"), F.col("target")
    rows = pages.select(F.col("title").alias("source"), F.coalesce(text_redirect(F.col("text"), pack), F.col("redirect_title")).alias("target")).where("target is not null")
    kind = F.when(is_list(source, pack) | is_list(target, pack), "list").when(is_category(source, pack, compat) | is_category(target, pack, compat), "category").when(~in_namespace(source, pack) & ~in_namespace(target, pack), "article")
    return rows.withColumn("kind", kind).where("kind is not null")


def hatnote_redirects(text: Column, pack: LanguagePack = ENGLISH, ignore_case: bool = True) -> Column:
    """Names that the leading {{redirect|name|...}} lines send to this page."""
    lines = F.split(text, "\n")
    head = F.concat(F.lit("{{"), F.lit(pack.redirect))
    is_head = lambda x: (F.lower(x) if ignore_case else x).startswith(head)
    upto = F.array_position(F.transform(lines, lambda x: is_head(x)), False)
    run = F.when(upto > 0, F.slice(lines, 1, F.greatest(upto.cast("int") - 1, F.lit(0)))).otherwise(lines)
    names = F.transform(run, lambda x: F.regexp_extract(x, rf"(?i)^\{{\{{{pack.redirect}\|([^|}}]*)", 1))
    return F.filter(names, lambda x: x != "")


def category_redirects(text: Column, pack: LanguagePack = ENGLISH) -> Column:
    """Targets of category redirect templates, with their namespace."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\{{\{{{re.escape(pack.category_redirect)}\|([^{{}}]*)\}}\}}"), F.lit(1))
    return F.transform(found, lambda x: F.concat(F.lit(pack.category.capitalize() + ":"), x))


def _names(names: tuple[str, ...]) -> str:
    one = "|".join(re.escape(n) for n in names)
    return rf"\{{\{{(?:{one})(?:\||\}}\}})|\|(?:{one})\}}\}}"


def page_class(title: Column, text: Column, pack: LanguagePack = ENGLISH) -> Column:
    """'stub', 'human', 'geo', 'number', 'other' (disambiguations) or 'article', in this order; null in other namespaces."""
    low = F.lower(text)
    other = low.rlike(_names(pack.disambiguation)) | F.contains(F.lower(title), F.lit("(disambiguation)"))
    return F.when(F.contains(low, F.lit(pack.stub)), "stub").when(low.rlike(_names(pack.human)), "human").when(low.rlike(_names(pack.geo)), "geo").when(low.rlike(_names(pack.number)), "number").when(other, "other").when(~in_namespace(title, pack), "article")


def _any(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in markers:
        out = out | F.contains(text, F.lit(x))
    return out


def is_given_name(text: Column, pack: LanguagePack = ENGLISH) -> Column:
    return _any(text, pack.given_names)


def is_surname(text: Column, pack: LanguagePack = ENGLISH) -> Column:
    return _any(text, pack.surnames)


def page_flags(pages: DataFrame, pack: LanguagePack = ENGLISH) -> DataFrame:
    """(title, flag): 'stub', 'given_name', 'surname'; a page may have several."""
    text = F.col("text")
    flags = F.filter(F.array(F.when(F.contains(F.lower(text), F.lit(pack.stub)), "stub"), F.when(is_given_name(text, pack), "given_name"), F.when(is_surname(text, pack), "surname")), lambda x: x.isNotNull())
    return pages.select("title", F.explode(flags).alias("flag"))


def is_media(entity: Column, pack: LanguagePack = ENGLISH) -> Column:
    """Entities that are no names: files, images and lists."""
    return F.lower(entity).rlike(rf"^(?:{'|'.join(f + ':' for f in pack.file)}|{pack.list_of})")
