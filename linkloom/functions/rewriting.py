"""Wiki markup that must be rewritten sequentially: templates, nested file links and tables, bold mentions, punctuation.

Each function has a plain Python core, which tests call, and a column form that runs it over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.markup import REPAIRS
from linkloom.langpack import CONVERT_SEPARATORS, DASHES, ENGLISH, MONTHS, LanguagePack


def over(core: Callable[[str], str]) -> Callable[[Column], Column]:
    """Column form of a text function; null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: core(t) if isinstance(t, str) else None)

    return run


# Templates


def _arguments(body: str) -> list[str]:
    """Bars separate arguments, except inside a link."""
    return re.split(r"\|(?![^\[\]]*\]\])", body)


def _month(token: str, compat: bool) -> str:
    low = token.lower()
    digits = re.search(r"\d{1,2}", low)
    for i, name in enumerate(MONTHS, 1):
        if name[:3].lower() in low or (str(i) in low if compat else digits and int(digits[0]) == i):
            return name
    return ""


def as_of(args: list[str], compat: bool = False) -> str:
    """'As of' phrase of a template's arguments: year, month, day and the flags lc, df, since, alt, pre, post."""
    named: dict[str, str] = {}
    given: list[str] = []
    for a in args:
        key, eq, value = a.partition("=")
        if eq:
            named[key.strip()] = value.strip()
        elif a.strip():
            given.append(a.strip())
    yes = lambda k: k in named and not named[k].startswith("n") and named[k] != ""
    word = "since" if yes("since") else "as of"
    out = (word if yes("lc") else word.capitalize()) + " "
    if named.get("alt"):
        out = named["alt"]
    if named.get("pre"):
        out += named["pre"] + " "
    if not named.get("alt"):
        year, month, day = (given + ["", "", ""])[:3]
        month = _month(month, compat) if month else ""
        if day and month:
            out += f"{month} {day}, {year}" if "df" in named else f"{day} {month} {year}"
        else:
            out += f"{month} {year}" if month else year
    return out + (named["post"] + " " if named.get("post") else "")


def convert(args: list[str]) -> str:
    """Value, or two values with their separator, and the unit; empty without a unit."""
    if not args or not args[0]:
        return ""
    value, rest, sep = args[0], args[1:], ""
    if rest and rest[0] in CONVERT_SEPARATORS:
        sep, rest = CONVERT_SEPARATORS[rest[0]], rest[1:]
        if rest:
            value, rest = value + sep + rest[0], rest[1:]
    return f"{value} {rest[0]}" if rest and rest[0] else ""


def template_text(body: str, pack: LanguagePack = ENGLISH, compat: bool = False) -> str:
    """What a template leaves in the text."""
    name, *args = _arguments(body)
    low = name.lower()
    if low.startswith(pack.quote):
        return f'"{args[0]}"' if args else ""
    if low.startswith(pack.lang):
        return next((a for a in reversed([name, *args]) if "=" not in a), "")
    if low.startswith(pack.as_of):
        return as_of(args, compat) if args else ""
    if low.startswith(pack.convert):
        return convert(args)
    return ""


_INNER = re.compile(r"\{\{([^{}]*)\}\}")


def rewrite_templates(text: str, pack: LanguagePack = ENGLISH, compat: bool = False) -> str:
    """Dash templates as ' - '; templates rewritten from the inside out; balanced rests removed, except template pages."""
    for dash in DASHES:
        text = text.replace(dash, " - ")
    while True:
        text, n = _INNER.subn(lambda m: template_text(m[1], pack, compat), text)
        if not n:
            break
    keep, depth, start, out = 0, 0, 0, []
    for m in re.finditer(r"\{\{|\}\}", text):
        if m[0] == "{{":
            start = m.start() if not depth else start
            depth += 1
        elif depth:
            depth -= 1
            if not depth and not text[start : m.end()].lower().startswith("{{" + pack.template):
                out.append(text[keep:start])
                keep = m.end()
    return "".join(out) + text[keep:]


# Nested brackets


def _nested(text: str, opens: re.Pattern, pair: re.Pattern, opening: str, line_end: bool) -> str:
    """text without the spans that begin at `opens` and end where the brackets of `pair` are balanced."""
    out, at = [], 0
    while m := opens.search(text, at):
        depth, end = 0, None
        for p in pair.finditer(text, m.start()):
            depth += 1 if p[0] == opening else -1
            if not depth:
                end = p.end()
                break
        if end is None:
            if not line_end:
                break
            end = text.find("\n", m.start())
            end = len(text) if end < 0 else end
        out.append(text[at : m.start()])
        at = end
    return "".join(out) + text[at:]


def drop_files(text: str, pack: LanguagePack = ENGLISH) -> str:
    """File and image links with all links inside them; an unclosed one ends with its line."""
    return _nested(text, re.compile(rf"\[\[\s*(?:{'|'.join(pack.file)})\s*:", re.I), re.compile(r"\[\[|\]\]"), "[[", True)


def drop_tables(text: str) -> str:
    """Tables with all tables inside them; an unclosed one stays."""
    return _nested(text, re.compile(r"\{\|"), re.compile(r"\{\||\|\}"), "{|", False)


# Bold mentions


_BOLD = re.compile(r"'''(.*?)'''", re.S)
_LINK_SPAN = re.compile(r"\[\[(?:(?!\[\[).)*?\]\]", re.S)


def link_bold_mentions(text: str, title: str) -> str:
    """Bold runs of the first line as links to the page; bold inside or around a link loses its signs only."""
    text = text.strip()
    line, newline, rest = text.partition("\n")
    spans = [m.span() for m in _LINK_SPAN.finditer(line)]

    def one(m: re.Match) -> str:
        body = m[1]
        if "[[" in body and "]]" in body or any(a < m.start() and m.end() <= b for a, b in spans):
            return body
        return f"[[{title}|{body.replace('[[', '').replace(']]', '')}]]"

    return _BOLD.sub(one, line) + newline + rest


# Punctuation

_REPAIRS = [(re.compile(p), to) for p, to in REPAIRS]


def repair_punctuation(text: str) -> str:
    """The repairs until none applies; each round makes each repair once, at its first place."""
    while True:
        was = text
        for pattern, to in _REPAIRS:
            text = pattern.sub(to, text, count=1)
        if text == was:
            return text


def rewrite_templates_column(c: Column, pack: LanguagePack = ENGLISH, compat: bool = False) -> Column:
    return over(lambda t: rewrite_templates(t, pack, compat))(c)


def drop_files_column(c: Column, pack: LanguagePack = ENGLISH) -> Column:
    return over(lambda t: drop_files(t, pack))(c)


def drop_tables_column(c: Column) -> Column:
    return over(drop_tables)(c)


def repair_punctuation_column(c: Column) -> Column:
    return over(repair_punctuation)(c)


def link_bold_mentions_column(c: Column, title: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, titles in batches:
            yield pd.Series([link_bold_mentions(t, n or "") if isinstance(t, str) else None for t, n in zip(texts, titles)])

    return run(c, title)


def strip_page(c: Column, title: Column, pack: LanguagePack = ENGLISH) -> Column:
    """All cleaning of one page in its fixed order; the sequential steps share two passes through Arrow."""
    from linkloom.functions import markup as m

    c = m.drop_infobox_prefix(c, pack)
    c = over(lambda t: rewrite_templates(t, pack))(c)
    c = m.drop_galleries(m.drop_notes(c))
    c = m.drop_categories(over(lambda t: drop_files(t, pack))(c), pack)
    c = over(drop_tables)(m.cut_sections(c, pack))
    return m.drop_external_links(m.clean_text(link_bold_mentions_column(c, title)))
