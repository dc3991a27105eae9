"""Wiki markup as built-in column expressions: everything here stays in generated JVM code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.langpack import ENGLISH, MONTHS, LanguagePack

#: Innermost links; the form a plain regular-expression engine shares with Java.
LINK = r"\[\[([^\[\]]*)\]\]"
#: Innermost links whose body may hold single brackets.
LINK_WITH_BRACKETS = r"(?s)\[\[((?:(?!\[\[).)*?)\]\]"


def _drop(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


# Links


def link_bodies(c: Column, pattern: str = LINK) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def link_entity(body: Column) -> Column:
    """What stands before the first bar."""
    return F.substring_index(body, "|", 1)


def link_alias(body: Column) -> Column:
    """What stands after the first bar, further bars included; the whole body where there is none."""
    return F.when(F.instr(body, "|") > 0, F.substring(body, F.instr(body, "|") + 1, F.char_length(body))).otherwise(body)


def links(c: Column, pattern: str = LINK) -> Column:
    """Array of (entity, alias) in text order."""
    return F.transform(link_bodies(c, pattern), lambda b: F.struct(link_entity(b).alias("entity"), link_alias(b).alias("alias")))


def unlink(c: Column) -> Column:
    """Each link as its last part."""
    return F.regexp_replace(c, r"\[\[(?:[^\[\]]*\|)?([^\[\]|]*)\]\]", "$1")


def flatten_headers(c: Column) -> Column:
    """Links of heading lines as plain words; other lines stay."""
    lines = F.split(c, "\n")
    return F.array_join(F.transform(lines, lambda x: F.when(x.startswith("="), unlink(x)).otherwise(x)), "\n")


def drop_own_links(c: Column, title: Column) -> Column:
    """Links to the page itself as their text."""
    own = F.concat(F.lit(r"\[\["), F.regexp_replace(title, r"([\\\[\](){}.*+?^$|])", r"\\$1"), F.lit(r"(?:\|([^\[\]]*))?\]\]"))
    bare = F.regexp_replace(c, F.concat(F.lit(r"\[\["), F.regexp_replace(title, r"([\\\[\](){}.*+?^$|])", r"\\$1"), F.lit(r"\]\]")), F.regexp_replace(title, r"([\\$])", r"\\$1"))
    return F.regexp_replace(bare, own, F.lit("$1"))


# Removal


def drop_notes(c: Column) -> Column:
    """Lines that start with a colon."""
    return _drop(c, r"(?m)^:.*\n?")


def drop_galleries(c: Column) -> Column:
    return _drop(c, r"(?is)<gallery.*?</gallery>")


def cut_sections(c: Column, pack: LanguagePack = ENGLISH) -> Column:
    """Text up to the first closing section."""
    names = "|".join(re.escape(s).replace(r"\ ", " ") for s in pack.cut_sections)
    return _drop(c, rf"(?s)==\s*(?:{names}).*$")


def drop_infobox_prefix(c: Column, pack: LanguagePack = ENGLISH, ignore_case: bool = True) -> Column:
    """Text from the first infobox on, where there is one. ignore_case=False finds the lower-case spelling only."""
    at = F.instr(F.lower(c) if ignore_case else c, "{{" + pack.infobox)
    return F.when(at > 0, F.substring(c, at, F.char_length(c))).otherwise(c)


def drop_simple_tables(c: Column, depth: int = 4) -> Column:
    """Tables, innermost first, up to `depth` levels; see rewriting.drop_tables for any depth."""
    for _ in range(depth):
        c = _drop(c, r"(?s)\{\|(?:(?!\{\|)(?!\|\}).)*\|\}")
    return c


def drop_files(c: Column, pack: LanguagePack = ENGLISH) -> Column:
    """File and image links with at most one level of links inside; see rewriting.drop_files for any depth."""
    return _drop(c, rf"(?i)\[\[(?:{'|'.join(pack.file)})\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]")


def drop_external_links(c: Column) -> Column:
    """[proto://address label] with its label."""
    return _drop(c, r"\[\w+://[^\]\n]*\]")


def external_labels(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\[\w+://[^\s\]]*([^\]\n]*)\]"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def categories(c: Column, pack: LanguagePack = ENGLISH) -> Column:
    """Categories in text order, without sort keys."""
    found = F.regexp_extract_all(c, F.lit(rf"(?i)\[\[{pack.category}:([^\[\]]*)\]\]"), F.lit(1))
    return F.transform(found, lambda x: F.substring_index(x, "|", 1))


def drop_categories(c: Column, pack: LanguagePack = ENGLISH) -> Column:
    return _drop(c, rf"(?i)\[\[{pack.category}:[^\[\]]*\]\]")


def drop_tags(c: Column) -> Column:
    return _drop(c, r"(?s)<.*?>")


def drop_comments(c: Column) -> Column:
    return _drop(c, r"(?s)<!--.*?-->")


def drop_references(c: Column) -> Column:
    return _drop(c, r"(?s)<ref[> ].*?(?:</ref>|/>)")


def drop_math(c: Column) -> Column:
    return _drop(c, r"(?s)<math[> ].*?(?:</math>|/>)")


def drop_pipe_lines(c: Column) -> Column:
    return _drop(c, r"(?m)^\|.*\n?")


def drop_interlanguage_links(c: Column) -> Column:
    """Links to other editions at the end of the text."""
    return F.regexp_replace(c, r"(?:\n\[\[[a-z][a-z][\w-]*:[^:\]]+\]\])+(\n?)\z", "$1")


def strip_space(c: Column) -> Column:
    return _drop(c, r"(?U)^\s+|\s+\z")


# Attributes by which a line is known as the rest of a table cell.
CELL_ATTRIBUTES = ("bgcolor", "colspan", "rowspan", "style=", "class=", "align=", "scope=")
#: Signs that may stand in front of such an attribute: on the first line, where the last attribute is none, on any other.
CELL_INDENT = (2, 4)


def drop_cell_lines(c: Column) -> Column:
    """Text without the lines that begin with an attribute of a table cell; the first line is emptied, others go whole."""
    first, other = (rf"^.{{0,{n}}}(?:{'|'.join(names)})" for n, names in zip(CELL_INDENT, (CELL_ATTRIBUTES[:-1], CELL_ATTRIBUTES)))
    lines = F.split(c, "\n")
    rest = F.filter(F.slice(lines, 2, 1 << 30), lambda x: ~x.rlike(other))
    return F.array_join(F.concat(F.array(F.when(lines[0].rlike(first), "").otherwise(lines[0])), rest), "\n")


def drop_bars(c: Column) -> Column:
    """Text without the bars and exclamation marks that open a cell: behind a line break, a tab or two spaces, together
    with what stands up to the last bar that no bracket comes before."""
    return F.regexp_replace(c, r"(\n ?|\t|  )[|!](?:[^\[\]\n|]*\|)*", "$1")


def clean_text(c: Column, comments: bool = True) -> Column:
    """Removes what is left of the markup, in this order: comments (unless comments=False), links to other editions,
    references, formulas, tags; runs of line breaks become two; pipe lines, bars outside tables, cell attributes; bold
    and italic signs; thin spaces; runs of spaces; empty brackets."""
    c = F.regexp_replace(c, "&nbsp;", " ")
    for f in ([drop_comments] if comments else []) + [drop_interlanguage_links, drop_references, drop_math, drop_tags]:
        c = f(c)
    c = strip_space(F.regexp_replace(c, r"\n{2,}", "\n\n"))
    for f in (drop_pipe_lines, drop_bars, drop_interlanguage_links, drop_cell_lines):
        c = f(c)
    c = F.regexp_replace(_drop(c, "'''"), "''", '"')
    c = F.regexp_replace(_drop(c, "&thinsp;"), " +", " ")
    return _drop(c, r" ?\( *\)")


# The repairs of punctuation, in order.
REPAIRS = ((r"\(( ?(;|,) ?)*\) ?", ""), (r"\(( ?(;|,) ?)+", "("), (r" ,", ","), (r" \)", ")"), (r",,+ ", ", "), (r",\)", ")"), (r";\)", ")"))


def punctuation_once(c: Column) -> Column:
    """One round of punctuation repair, all places at once: an approximation of rewriting.repair_punctuation."""
    for pattern, to in REPAIRS:
        c = F.regexp_replace(c, pattern, to)
    return c


def rejoin_lines(c: Column) -> Column:
    """Undo one-sentence-per-line text: single breaks inside a paragraph become spaces, headings keep their lines."""
    return F.regexp_replace(c, r"(?<![\n=])\n(?![\n=])", " ")


def intro(c: Column) -> Column:
    """Text before the first heading."""
    return F.split(c, "==", 2)[0]


# Names, paths, dates


def alias_trim(c: Column) -> Column:
    """Trimmed; one trailing 's, then one trailing ' cut off; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(c), "'s$", ""), "'$", ""), F.lit(""))


def surface_key(c: Column) -> Column:
    """Letters without accents and digits in lower case, nothing else."""
    plain = F.when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), c, F.lit(False)))
    return _drop(F.lower(_drop(plain, r"\p{M}+")), "[^a-z0-9]")


def shard(title: Column) -> Column:
    """Three-level folder of a title: first one, two, three signs of its lower-case form, other signs as '_'."""
    key = F.rpad(F.substring(F.regexp_replace(F.lower(title), "[^0-9a-z]+", "_"), 1, 3), 3, "_")
    return F.concat_ws("/", F.substring(key, 1, 1), F.substring(key, 1, 2), key)


def page_path(title: Column) -> Column:
    return F.concat(shard(title), F.lit("/"), F.translate(title, " /", "__"), F.lit(".txt"))


def month_name(c: Column, compat: bool = False) -> Column:
    """Month of a word or number. compat=True reads any text with the digit 1 as January, as the first match wins."""
    low = F.lower(c)
    number = F.try_to_number(F.regexp_extract(low, r"(\d{1,2})", 1), F.lit("99")).cast("int")
    out = F.lit("")
    for i in range(12, 0, -1):
        name = F.contains(low, F.lit(MONTHS[i - 1][:3].lower()))
        digit = F.contains(low, F.lit(str(i))) if compat else (number == i)
        out = F.when(name | F.coalesce(digit, F.lit(False)), MONTHS[i - 1]).otherwise(out)
    return out


# Month and weekday words of the two rule sets.
FRENCH_MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
GERMAN_MONTHS = ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember")
FRENCH_DAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")
GERMAN_DAYS = ("montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag")
RELATIVE_DAYS = {"fr": {"aujourd'hui": 0, "hier": -1, "demain": 1, "avant-hier": -2, "après-demain": 2}, "de": {"heute": 0, "gestern": -1, "morgen": 1, "vorgestern": -2, "übermorgen": 2}}


def temporal_expressions(c: Column, lang: str) -> Column:
    """Array of (text, kind, year, month, day) of French or German time expressions.

    kind: date (day month year), day_month, month_year, month, iso, weekday, relative (day holds the offset in days).
    """
    months, days = (FRENCH_MONTHS, FRENCH_DAYS) if lang == "fr" else (GERMAN_MONTHS, GERMAN_DAYS)
    m, dot = "|".join(months), r"(?:er)?" if lang == "fr" else r"\.?"
    relative = RELATIVE_DAYS[lang]
    pattern = rf"(?iU)\b(?:\d{{4}}-\d{{2}}-\d{{2}}|(?:\d{{1,2}}{dot} )?(?:{m})(?: \d{{4}})?|{'|'.join(days)}|{'|'.join(sorted(relative, key=len, reverse=True))})\b"

    def parse(x: Column) -> Column:
        low = F.lower(x)
        iso = low.rlike(r"^\d{4}-\d{2}-\d{2}$")
        month = F.lit(None).cast("int")
        for i, name in enumerate(months):
            month = F.when(F.contains(low, F.lit(name)), i + 1).otherwise(month)
        day = F.nullif(F.regexp_extract(low, r"^(\d{1,2})(?!\d)", 1), F.lit("")).cast("int")
        year = F.nullif(F.regexp_extract(low, r"(\d{4})$", 1), F.lit("")).cast("int")
        offset = F.lit(None).cast("int")
        for word, by in relative.items():
            offset = F.when(low == word, by).otherwise(offset)
        kind = F.when(iso, "iso").when(offset.isNotNull(), "relative").when(month.isNull(), "weekday").when(day.isNotNull() & year.isNotNull(), "date").when(day.isNotNull(), "day_month").when(year.isNotNull(), "month_year").otherwise("month")
        y = F.when(iso, F.substring(low, 1, 4).try_cast("int")).otherwise(year)
        mo = F.when(iso, F.substring(low, 6, 2).try_cast("int")).otherwise(month)
        d = F.when(iso, F.substring(low, 9, 2).try_cast("int")).when(offset.isNotNull(), offset).otherwise(day)
        return F.struct(x.alias("text"), kind.alias("kind"), y.alias("year"), mo.alias("month"), d.alias("day"))

    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), parse)


# Scalars


def is_number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").isNotNull(), F.lit(False))


def has_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}")


def starts_upper(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\p{IsUppercase}"), F.lit(False))


def shared_words(a: Column, b: Column) -> Column:
    words = lambda x: F.array_distinct(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(a), words(b)))


def word_tokens(c: Column) -> Column:
    """Words and single punctuation signs."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
