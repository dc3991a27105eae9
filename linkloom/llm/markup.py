"""Markup residue: pages in wiki, HTML, Markdown and LaTeX syntax, alone or mixed, to clean text that keeps its structure.

Each page is read once into a tree: elements are the tags that hold blocks, with their attributes; blocks have a kind
(heading, list, code, formula, table, text) and a content; marks are the pieces of markup that a block is or holds, named by
their syntax. Clean text is written from the blocks in one plain notation. `found_kinds` merges the page trees of one site,
tells on the merged tree of which kind of markup each element and mark is, and maps every page back onto it.
`style_tree` merges the page trees of one site, element by element along their tag paths, into a site style tree: for
every element the pages it is on, its presentations (the child sequences it has there) and its contents, each with their
entropy over these pages, and from the leaves up the importance of the whole branch. `clean` drops the branches whose
importance is low: page furniture, even if it differs a little from page to page.

The importance cannot tell markup from plain text, and markup on page furniture is markup too: it decides what `clean` drops,
not the kinds. Which characters are markup is decided where the page's tree is built.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.session import distinct_over, lookup_join, materialize

KINDS = ("heading", "list", "code", "formula", "table", "other")

#: Kinds of the marks by their name; all other marks, and the elements, are 'other'.
KIND_OF = {
    **dict.fromkeys(("wiki:heading", "md:heading", "tex:heading", "html:heading"), "heading"),
    **dict.fromkeys(("line:item", "tex:list", "tex:item", "html:item"), "list"),
    **dict.fromkeys(("md:code", "tex:code", "html:code"), "code"),
    **dict.fromkeys(("tex:formula", "html:formula"), "formula"),
    **dict.fromkeys(("wiki:table", "md:table", "tex:table", "html:table"), "table"),
}

# Tag names that are markup.
BLOCK_TAGS = "html body head header footer nav main section article aside div p center blockquote hr br ul ol dl dt dd li table tr td th thead tbody tfoot caption h1 h2 h3 h4 h5 h6 form figure figcaption title meta link script style noinclude includeonly onlyinclude gallery references".split()
INLINE_TAGS = "a b i u s em strong small big sub sup span font tt code kbd samp var cite q abbr acronym img del ins strike nowiki ref label mark time bdi wbr poem noscript button input".split()
TAG = re.compile(r"</?(?:%s)(?:\s[^<>]*)?/?>" % "|".join(BLOCK_TAGS + INLINE_TAGS), re.I)
BLOCK_TAG = re.compile(r"</?(?:%s)(?:\s[^<>]*)?/?>" % "|".join(BLOCK_TAGS), re.I)

CODE = re.compile(
    r"^(?P<f>`{3,}|~{3,})[^\n`]*\n(?P<fence>.*?)(?:\n?^(?P=f)[`~]*[ \t]*$|\Z)"
    r"|<(?P<t>pre|syntaxhighlight|source)\b[^>]*>(?P<tag>.*?)</(?P=t)\s*>"
    r"|\\begin\{(?P<e>verbatim|Verbatim|lstlisting|minted|alltt)\*?\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*(?P<env>.*?)\\end\{(?P=e)\*?\}",
    re.M | re.S | re.I,
)
FORMULA = re.compile(
    r"<math\b(?P<ma>[^>]*)>(?P<m>.*?)</math\s*>"
    r"|\\begin\{(?P<e>equation|align|aligned|gather|multline|eqnarray|displaymath|math|alignat|flalign)(?P<s>\*?)\}(?P<env>.*?)\\end\{(?P=e)(?P=s)\}"
    r"|(?<!\\)\$\$(?P<dd>[^$]+?)\$\$"
    r"|(?<!\\)\\\[(?P<br>.+?)(?<!\\)\\\]"
    r"|(?<!\\)\\\((?P<pa>.+?)(?<!\\)\\\)"
    r"|(?<![\\$\w])\$(?P<d>[^\s$](?:[^$\n]*[^\s$\\])?)\$(?![\d$])",
    re.S | re.I,
)
MATHLIKE = re.compile(r"[\\^_=<>{}+]|^[A-Za-z](?:'|\d)?$|[A-Za-z0-9]\s*[*/\-]\s*[A-Za-z0-9]")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
REFERENCE = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*\n(.*?)^[ \t]*\|\}", re.M | re.S)
HTML_TABLE = re.compile(r"<table\b[^>]*>(.*?)</table\s*>", re.S | re.I)
TEX_TABLE = re.compile(r"\\begin\{(tabular|tabularx|longtable|array)\*?\}(?:\{[^{}]*\})*(.*?)\\end\{\1\*?\}", re.S)
PIPE_TABLE = re.compile(r"^(?=[^\n]*\|)[^\n]+\n[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*(?:\n[^\n]*\|[^\n]*)*$", re.M)
TEX_HEADING = re.compile(r"\\(part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}")
TEX_LIST = re.compile(r"[ \t]*\\(begin|end)\{(itemize|enumerate|description)\}(?:\[[^\]\n]*\])?[ \t]*")
TEX_ITEM = re.compile(r"^[ \t]*\\item\b(?:\[([^\]\n]*)\])?[ \t]*", re.M)
TEX_FRAME = re.compile(r"^[ \t]*\\(?:documentclass|usepackage|begin|end|title|author|date|maketitle|newcommand|bibliography|bibliographystyle|centering|caption|includegraphics|tableofcontents)\b(?:\[[^\]\n]*\]|\{[^{}\n]*\})*[ \t]*$", re.M)
HTML_HEADING = re.compile(r"<(h[1-6])\b([^>]*)>(.*?)</\1\s*>", re.S | re.I)
HTML_ITEM = re.compile(r"(?:<(?P<k>ul|ol)\b[^>]*>\s*)?<li\b[^>]*>|</li\s*>|</?(?:ul|ol)\b[^>]*>", re.I)
WIKI_HEADING = re.compile(r"^[ \t]*(={1,6})[ \t]*([^=\n](?:[^\n]*[^=\n])?)[ \t]*\1[ \t]*$", re.M)
MD_HEADING = re.compile(r"^ {0,3}(#{2,6})[ \t]*([^#\n][^\n]*?)[ \t]*#*[ \t]*$", re.M)
SETEXT = re.compile(r"^(?=[^\s*#+|>\x00-])([^\n\x00]+)\n[ \t]*(={3,}|-{3,})[ \t]*$", re.M)
RULE = re.compile(r"^[ \t]*(?:-{4,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})[ \t]*$", re.M)
LIST_LINE = re.compile(r"^[ \t]*(?:(?P<w>[*#]{1,6})(?P<gap>[ \t]*)(?=\S)|(?P<d>[+•-])[ \t]+(?=\S)|(?P<n>\d{1,3}[.)])[ \t]+(?=\S))(?P<rest>[^\n]+)$", re.M)
STARRED = re.compile(r"(\*{1,3})(?=[^\s*])[^*\n]*[^\s*]\1(?!\*)|\*\*\*?(?=[^\s*]).*?[^\s*]\*\*")
INDENT_MARK = re.compile(r"^[:;]+[ \t]*(?=\S)", re.M)

WIKI_FILE = re.compile(r"\[\[\s*(?:file|image|media|datei|bild|fichier|archivo|imagen|category|kategorie|catégorie|categoría)\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", re.I)
WIKI_LINK = re.compile(r"\[\[([^\[\]\n|]*)(?:\|([^\[\]\n]*))?\]\]")
MD_IMAGE = re.compile(r"!\[([^\[\]\n]*)\](?:\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)|\[[^\[\]\n]*\])")
MD_LINK = re.compile(r"\[([^\[\]\n]+)\](?:\((?:[^()\s]*)(?:[ \t]+\"[^\"\n]*\")?\)|\[[^\[\]\n]*\])")
MD_NOTE = re.compile(r"\[\^[^\[\]\s]{1,40}\]:?")
WEB_LINK = re.compile(r"\[(?:https?:|ftp:|mailto:|//)[^\s\[\]]*(?:[ \t]+([^\[\]\n]*))?\]")
TEX_DROP = re.compile(r"~?\\(?:cite[a-z]*|ref|eqref|pageref|label|index|nocite|vspace|hspace|footnotemark)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}")
TEX_NOTE = re.compile(r"\\(?:footnote|marginpar|thanks)\{((?:[^{}]|\{[^{}]*\})*)\}")
TEX_WRAP = re.compile(r"\\(?:text(?:bf|it|tt|sc|rm|sf|up|sl|normal)?|emph|underline|uline|mbox|url|href\{[^{}]*\}|textcolor\{[^{}]*\}|textsuperscript|textsubscript|title|caption)\{([^{}]*)\}")
TEX_SWITCH = re.compile(r"\{\\(?:it|bf|em|tt|sc|rm|sf|sl|itshape|bfseries|ttfamily|small|large|Large|tiny|footnotesize)\b[ \t]*([^{}]*)\}")
TEX_BREAK = re.compile(r"\\\\(?:\[[^\]\n]*\])?[ \t]*$|\\(?:newline|newpage|clearpage|noindent|par|smallskip|medskip|bigskip|hline|toprule|midrule|bottomrule)\b[ \t]*", re.M)
ESCAPE = re.compile(r"\\([*_`#\[\]{}()~|<>!+.&%$\-])")
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
INLINE_CODE = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+)\1(?!`)")
STRIKE = re.compile(r"(?<![~\w])~~(?=\S)([^~\n]+?)(?<=\S)~~(?!~)")
WIKI_QUOTES = re.compile(r"('{2,5})(?=[^\s'])([^\n]*?[^\n']|[^\s'])\1(?!')")
STRONG = re.compile(r"(?<![\w*])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\1(?![\w*])")
STRONG_IN = re.compile(r"\*\*(?=[^\s*])([^*\n]*[^\s*])\*\*")
UNDER = re.compile(r"(?<![\w_])(_{1,3})(?=[^\s_])([^_\n]*[^\s_])\1(?![\w_])")
SWITCH = re.compile(r"__(?:NO)?(?:TOC|INDEX|EDITSECTION|FORCETOC|NEWSECTIONLINK)__")
SOME_MARKUP = re.compile(r"[*#=\[{}<&\\$`~_|]|''|^[ \t]*(?:[+•-]|\d{1,3}[.)])[ \t]|^[ \t]*-{3}|^[:;]", re.M)
ENDS_REF = "</ref"
HOLD = re.compile("\x00([A-Z])(\\d+)\x00")
TEXT_BREAK = re.compile(r"\n\s*\n")


@dataclass
class Page:
    held: list[tuple[str, str]] = field(default_factory=list)
    marks: list[list[str]] = field(default_factory=list)  # of each piece held
    loose: list[str] = field(default_factory=list)  # marks that have no place yet
    placed: set[int] = field(default_factory=set)  # pieces held whose marks have one

    def hold(self, kind: str, text: str, *marks: str) -> str:
        self.held.append((kind, text))
        self.marks.append([*marks])
        return f"\x00{kind[0].upper()}{len(self.held) - 1}\x00"

    def sub(self, pattern: re.Pattern, to, text: str, mark: str) -> str:
        out, n = pattern.subn(to, text)
        if n:
            self.loose.append(mark)
        return out

    def inline(self, text: str) -> tuple[str, list[str]]:
        """Text without the markup inside lines, and the marks of that."""
        at = len(self.loose)
        plain = _inline(self, text)
        marks = self.loose[at:]
        del self.loose[at:]
        return plain, marks

    def place(self, text: str) -> list[str]:
        """Marks of the pieces held in the text, and of those held in them."""
        out = []
        for m in HOLD.finditer(text):
            k = int(m[2])
            if k not in self.placed:
                self.placed.add(k)
                out += self.marks[k] + self.place(self.held[k][1])
        return out

    def rest(self) -> list[str]:
        """Marks of what left nothing in the text: comments, templates, references, rules and what they held."""
        return self.loose + [x for k, marks in enumerate(self.marks) if k not in self.placed for x in marks]


def _template(body: str) -> str:
    """What a template leaves in the text."""
    parts = re.split(r"\|(?![^\[]*\]\])", body)
    name, args = parts[0].strip().lower(), [p.strip() for p in parts[1:]]
    plain = [a for a in args if "=" not in a]
    if name.startswith("lang") and plain:
        return plain[-1]
    if name in ("quote", "cquote", "quotation") and plain:
        return f'"{plain[0]}"'
    if name in ("convert", "cvt") and len(plain) > 1:
        return f"{plain[0]} {plain[1]}"
    return ""


def _rows(rows: list[list[str]]) -> str:
    return "\n".join("| " + " | ".join(re.sub(r"\s*\n\s*", " ", c.strip()) for c in r) + " |" for r in rows if any(c.strip() for c in r))


def _wiki_rows(body: str) -> list[list[str]]:
    rows: list[list[str]] = [[]]
    for line in body.split("\n"):
        s = line.strip()
        if s.startswith("|-"):
            rows.append([])
        elif s.startswith("|+"):
            rows.append([s[2:]])
            rows.append([])
        elif s[:1] in ("|", "!"):
            cells = re.split(r"\|\||!!" if s[0] == "!" else r"\|\|", s[1:])
            rows[-1] += [re.sub(r"^[^|\[\]{}]*=[^|\[\]{}]*\|(?!\|)", "", c) for c in cells]
        elif s and rows[-1]:
            rows[-1][-1] += " " + s
    return rows


def _inline(page: Page, t: str) -> str:
    """Text without the markup inside lines."""
    sub = page.sub
    if "[" in t:
        if "[[" in t:
            t = sub(WIKI_FILE, "", t, "wiki:file")
            t = sub(WIKI_LINK, lambda m: m[2] if m[2] is not None else m[1], t, "wiki:link")
        if "![" in t:
            t = sub(MD_IMAGE, "", t, "md:image")
        if "](" in t or "][" in t:
            t = sub(MD_LINK, r"\1", t, "md:link")
        if "[^" in t:
            t = sub(MD_NOTE, "", t, "md:note")
        if "//" in t or "mailto:" in t:
            t = sub(WEB_LINK, lambda m: m[1] or "", t, "wiki:weblink")
    if "\\" in t:
        t = sub(TEX_NOTE, "", t, "tex:note")
        t = sub(TEX_DROP, "", t, "tex:reference")
        while True:
            was = t
            t = sub(TEX_WRAP, r"\1", t, "tex:style")
            t = sub(TEX_SWITCH, r"\1", t, "tex:switch")
            if t == was:
                break
        t = sub(TEX_BREAK, "\n", t, "tex:break")
        t = sub(ESCAPE, r"\1", t, "md:escape")
    if "`" in t:
        t = sub(INLINE_CODE, r"\2", t, "md:inlinecode")
    if "~~" in t:
        t = sub(STRIKE, r"\1", t, "md:strike")
    if "''" in t:
        while True:
            was = t
            t = sub(WIKI_QUOTES, r"\2", t, "wiki:emphasis")
            if t == was:
                break
    if "*" in t:
        t = sub(STRONG, r"\2", t, "md:emphasis")
        if "**" in t:
            t = sub(STRONG_IN, r"\1", t, "md:emphasis")
    if "_" in t:
        t = sub(SWITCH, "", t, "wiki:switch")
        t = sub(UNDER, r"\2", t, "md:emphasis")
    if "<" in t:
        t = sub(BLOCK_TAG, "\n", t, "html:block")
        if "<" in t:
            t = sub(TAG, "", t, "html:inline")
    if "&" in t and ENTITY.search(t):
        new = html.unescape(html.unescape(ENTITY.sub(lambda m: html.unescape(m[0]) if m[0].startswith("&amp") else m[0], t)))
        if new != t:
            page.loose.append("html:character")
            t = new.replace("\xa0", " ")
    return t


def _formula(page: Page, m: re.Match) -> str:
    d = m["d"]
    if d is not None and not MATHLIKE.search(d):
        return m[0]
    body = next(m[g] for g in ("m", "env", "dd", "br", "pa", "d") if m[g] is not None).strip()
    block = m["env"] is not None or m["dd"] is not None or m["br"] is not None or 'display="block"' in (m["ma"] or "")
    return page.hold("formula", f"$$\n{body}\n$$" if block else f"${body}$", "tex:formula" if m["m"] is None else "html:formula")


def _code(page: Page, m: re.Match) -> str:
    body = next(m[g] for g in ("fence", "tag", "env") if m[g] is not None)
    if m["tag"] is not None:
        body = html.unescape(re.sub(r"^\s*<code\b[^>]*>|</code\s*>\s*$", "", body, flags=re.I))
    mark = "md:code" if m["fence"] is not None else "html:code" if m["tag"] is not None else "tex:code"
    return "\n\n" + page.hold("code", "```\n" + body.strip("\n") + "\n```", mark) + "\n\n"


def _list_line(page: Page, m: re.Match) -> str:
    mark, rest = m["w"], m["rest"]
    if mark and set(mark) == {"#"} and len(mark) > 1:
        return m[0]
    if mark and "*" in mark and not m["gap"]:
        whole = m[0].lstrip()
        if STARRED.match(whole):
            return m[0]
    ordered = m["n"] or (mark and mark[-1] == "#")
    depth = len(mark) - 1 if mark else 0
    return "\n" + page.hold("list", "  " * depth + ("1. " if ordered else "- "), "line:item") + rest.strip() + "\n"


def _structure(page: Page, text: str) -> str:
    """The text with its structure held by the page: blocks stand as marks, only markup inside lines is left."""
    t = text.replace("\x00", "")
    if "```" in t or "~~~" in t or "<" in t or "\\begin" in t:
        t = CODE.sub(lambda m: _code(page, m), t)
    if "$" in t or "\\" in t or "<" in t:
        t = FORMULA.sub(lambda m: _formula(page, m), t)
    if "<!--" in t:
        t = page.sub(COMMENT, "", t, "html:comment")
    if "{{" in t:
        while True:
            was = t
            t = page.sub(TEMPLATE, lambda m: _template(m[1]), t, "wiki:template")
            if t == was:
                break
    if "<" in t and ENDS_REF in t.lower() or "/>" in t:
        t = page.sub(REFERENCE, "", t, "html:reference")

    def table(rows: list[list[str]], mark: str) -> str:
        cells = [[page.inline(c) for c in r] for r in rows]
        inside = dict.fromkeys(x for r in cells for _, marks in r for x in marks)
        return "\n\n" + page.hold("table", _rows([[c for c, _ in r] for r in cells]), mark, *inside) + "\n\n"

    if "{|" in t:
        t = WIKI_TABLE.sub(lambda m: table(_wiki_rows(m[1]), "wiki:table"), t)
    if "<" in t:
        t = HTML_TABLE.sub(lambda m: table([re.findall(r"<t[dh]\b[^>]*>(.*?)(?=</?t[dhr]\b|\Z)", r, re.S | re.I) for r in re.split(r"<tr\b[^>]*>", m[1], flags=re.I)], "html:table"), t)
    if "|" in t:
        t = PIPE_TABLE.sub(lambda m: table([re.split(r"(?<!\\)\|", r.strip().strip("|")) for i, r in enumerate(m[0].strip("\n").split("\n")) if i != 1], "md:table"), t)

    def heading(level: int, body: str, style: str) -> str:  # from two signs on: a line with one is a list item
        plain, inside = page.inline(body)
        return "\n\n" + page.hold("heading", style + "\n" + "#" * max(2, level) + " " + " ".join(plain.split()), style.partition(":")[0] + ":heading", *inside) + "\n\n"

    if "\\" in t:
        t = TEX_TABLE.sub(lambda m: table([r.split("&") for r in re.split(r"\\\\|\\hline|\\toprule|\\midrule|\\bottomrule", m[2])], "tex:table"), t)
        t = TEX_HEADING.sub(lambda m: heading(min(6, max(1, m[1].count("sub") + (2 if "section" in m[1] else 1))), m[2], "tex:" + m[1]), t)
        t = page.sub(TEX_LIST, "\n\n", t, "tex:list")
        t = TEX_ITEM.sub(lambda m: "\n" + page.hold("list", "- ", "tex:item") + (f"{m[1]}: " if m[1] else ""), t)
        t = page.sub(TEX_FRAME, "", t, "tex:frame")
    if "<" in t:
        t = HTML_HEADING.sub(lambda m: heading(int(m[1][1]), m[3], f"html:{m[1].lower()}{m[2].lower()}"), t)
        ordered = [False]

        def item(m: re.Match) -> str:
            tag = m[0].lower()
            if m["k"]:
                ordered[0] = m["k"].lower() == "ol"
            if "<li" in tag:
                return ("\n\n" if m["k"] else "\n") + page.hold("list", "1. " if ordered[0] else "- ", "html:item")
            return "\n\n" if "l>" in tag else "\n"

        t = page.sub(HTML_ITEM, item, t, "html:item")
    if "=" in t:
        t = WIKI_HEADING.sub(lambda m: heading(len(m[1]), m[2], f"wiki:h{len(m[1])}"), t)
    if "##" in t:
        t = MD_HEADING.sub(lambda m: heading(len(m[1]), m[2], f"md:h{len(m[1])}"), t)
    if "===" in t or "---" in t:
        t = SETEXT.sub(lambda m: heading(1 if m[2][0] == "=" else 2, m[1], "md:h" + m[2][0]), t)
    if "----" in t or "*" in t or "_" in t:
        t = page.sub(RULE, "\n", t, "wiki:rule")
    t = LIST_LINE.sub(lambda m: _list_line(page, m), t)
    return INDENT_MARK.sub("", t) if page.held or page.loose else t


Node = tuple[int, str, str, str, str]  # element above (-1: the page), tag path, kind, content, child sequence


def nodes(text: str) -> tuple[list[Node], set[str]]:
    """The page's tree, elements (kind 'tag') before what they hold, marks (kind 'mark', their name the last step of their path)
    behind all others, and the kinds of markup of its elements and marks."""
    if not SOME_MARKUP.search(text):
        return [(-1, "", "text", text, "")], set()
    page = Page()
    found = _tree(page, _structure(page, text))
    return found, {KIND_OF.get(step(path), "other") for _, path, kind, _, _ in found if kind in ("tag", "mark")}


def step(path: str) -> str:
    return path[path.rindex("/") + 1 :]


def running_text(text: str) -> str | None:
    """The text without its markup and list marks in one piece, for matching words; None if it has no markup."""
    if not SOME_MARKUP.search(text):
        return None
    page = Page()
    t = _inline(page, _structure(page, text))

    def put(m: re.Match) -> str:
        kind, body = page.held[int(m[2])]
        return body.partition("\n")[2] if kind == "heading" else "" if kind == "list" else body

    return HOLD.sub(put, t) if page.held or page.loose else None


#: Tags that hold blocks, and so are the elements of a page's tree.
ELEMENT = re.compile(r"<(/?)(p|div|section|article|nav|header|footer|aside|main|center|blockquote|form|figure)\b([^<>]*)>", re.I)
#: Elements deeper than this are held by the one at this depth.
MAX_DEPTH = 32


def _tree(page: Page, t: str) -> list[Node]:
    out: list[Node] = []
    stack = [(-1, "", "")]  # index, tag path, tag of the open elements
    children: dict[int, list[str]] = {}
    marks: dict[Node, None] = {}
    paths: dict[tuple[str, str], str] = {}  # one string each, as a path may be long and hold many blocks

    def mark(at: int, path: str, names: list[str]) -> None:
        for x in names:
            if (path, x) not in paths:
                paths[path, x] = f"{path}/{x}"
            marks[at, paths[path, x], "mark", "", ""] = None

    def held(part: str) -> None:
        at, path, _ = stack[-1]
        for kind, body, names in _blocks(page, part):
            if kind is None:
                mark(at, path, names)
                continue
            out.append((at, path, kind, body, ""))
            _next(children.setdefault(at, []), kind)
            mark(len(out) - 1, path, names)

    pos = 0
    for m in ELEMENT.finditer(t) if "<" in t else ():
        held(t[pos : m.start()])
        pos = m.end()
        tag = m[2].lower()
        if m[1]:
            if any(x[2] == tag for x in stack[1:]):
                while stack.pop()[2] != tag:
                    pass
            else:
                mark(*stack[-1][:2], ["html:block"])
            continue
        if stack[-1][2] == "p":  # a paragraph ends where another block begins
            stack.pop()
        if len(stack) <= MAX_DEPTH and not m[3].endswith("/"):
            style = f"{tag}{re.sub(r'[^a-z0-9=.-]+', '.', m[3].lower())}"
            at, path, _ = stack[-1]
            out.append((at, f"{path}/{style}", "tag", "", ""))
            _next(children.setdefault(at, []), style)
            stack.append((len(out) - 1, f"{path}/{style}", tag))
        elif m[3].endswith("/"):
            mark(*stack[-1][:2], ["html:block"])
    held(t[pos:])
    mark(-1, "", page.rest())
    return [(a, path, kind, body, ",".join(children.get(k, ())) if kind == "tag" else "") for k, (a, path, kind, body, _) in enumerate(out)] + [*marks]


def _next(sequence: list[str], child: str) -> None:
    """A run of equal children is one entry, so that a list of articles of any length is one presentation."""
    if not sequence or sequence[-1] != child:
        sequence.append(child)


def _blocks(page: Page, t: str) -> list[tuple[str | None, str, list[str]]]:
    """(kind, content, marks) of the blocks of a piece of text without elements; kind is None where markup left no block."""
    out: list[tuple[str | None, str, list[str]]] = []
    for part in TEXT_BREAK.split(t):
        if not part.strip():
            continue
        plain, marks = page.inline(part)
        plain = "\n".join(x for x in (re.sub(r"[ \t]+", " ", x).strip() if x.strip() != "" else "" for x in plain.split("\n")) if x)
        marks += page.place(plain)
        kind = "text"
        hold = HOLD.fullmatch(plain)
        if hold:
            kind, body = page.held[int(hold[2])]
            out.append((kind, body.partition("\n")[2] if kind == "heading" else body, marks))
            continue

        def put(m: re.Match) -> str:
            kind, body = page.held[int(m[2])]
            return body.partition("\n")[2] if kind == "heading" else body

        if HOLD.search(plain):
            if HOLD.match(plain) and HOLD.match(plain)[1] == "L":
                kind = "list"
            plain = HOLD.sub(put, plain)
        if plain or marks:
            out.append((kind if plain else None, plain, marks))
    return out


def clean_text(text: str) -> tuple[str, set[str]]:
    """Clean text and the kinds of markup found. Text without markup comes back as it is."""
    found, kinds = nodes(text)
    if not kinds:
        return text, kinds
    return "\n\n".join(body for _, _, kind, body, _ in found if kind not in ("tag", "mark")), kinds


def markup_kinds(texts: Column) -> Column:
    """Array of the kinds of markup in each text."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: sorted(nodes(t)[1]) if isinstance(t, str) else [])

    return run(texts)


_NODES = "array<struct<above:int,style:string,kind:string,content:string,children:string>>"


def page_nodes(df: DataFrame, id_col: str, text: str, site: Column) -> DataFrame:
    """(id, site, kinds, nodes): one row per distinct id and text, elements and blocks in page order, without marks."""
    names = ("above", "style", "kind", "content", "children")

    @F.pandas_udf(f"kinds array<string>, nodes {_NODES}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [nodes(t) if isinstance(t, str) else ([], set()) for t in batch]
            yield pd.DataFrame({"kinds": [sorted(k) for _, k in made], "nodes": [[dict(zip(names, x)) for x in n if x[2] != "mark"] for n, _ in made]})

    rows = df.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"), site.alias("site"))
    return distinct_over(rows).select(F.col("__id").alias(id_col), "site", F.col("__text").isNull().alias("no_text"), run.asNondeterministic()("__text").alias("p")).select(id_col, "site", "no_text", "p.kinds", "p.nodes")


def page_elements(df: DataFrame, id_col: str, text: str, site: Column) -> DataFrame:
    """(id, site, elements): the elements and marks of each page's tree, once each, as a hash of their path and its last step,
    attributes left out."""

    @F.pandas_udf("array<struct<style:long,step:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [{"style": int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "big", signed=True), "step": step(x).partition(".")[0]} for x in sorted({path for _, path, kind, _, _ in nodes(t)[0] if kind in ("tag", "mark")})] if isinstance(t, str) else [])

    return df.select(F.col(id_col), F.coalesce(site, F.lit("")).alias("site"), run.asNondeterministic()(text).alias("elements"))


def merged(each: DataFrame, id_col: str, *element: str) -> DataFrame:
    """(site, element, style_pages): what the pages' trees have at the same place is one element of their site's tree."""
    return each.select(id_col, "site", *element).distinct().groupBy("site", *element).agg(F.count(F.lit(1)).alias("style_pages"))


def found_kinds(df: DataFrame, id_col: str, text: str = "text", site: Column | None = None) -> DataFrame:
    """(id, markup_kind): the kinds of markup of each page.

    The page trees of a site are merged, the elements and marks of the merged tree get their kind, and each page is mapped
    onto the tree: its kinds are those of the elements it has there. Those of low importance count as well, as what
    all pages of a site share is on each of them.
    """
    each = materialize(page_elements(df, id_col, text, F.lit("") if site is None else site), "pages").select(id_col, "site", F.explode("elements").alias("e")).select(id_col, "site", "e.*")
    kind = F.create_map(*[F.lit(x) for pair in KIND_OF.items() for x in pair])[F.col("step")]
    tree = merged(each, id_col, "style", "step").select("site", "style", "step", F.coalesce(kind, F.lit("other")).alias("markup_kind"))
    return lookup_join(each, tree, ["site", "style", "step"], "inner").select(id_col, "markup_kind").distinct()


#: How much less a branch's own presentation counts with each presentation it has.
DAMPING = 0.9


def style_tree(pages: DataFrame, id_col: str) -> DataFrame:
    """(site, style, style_pages, styles, contents, presentation, content, importance): the elements of the merged trees of
    each site, style being an element's tag path.

    presentation is the entropy of an element's child sequences over its pages, to the base of their number and 1 at most:
    0 if it looks the same on all, 1 if on each another way. content is the mean, over the blocks that lie directly in it and
    the pages each is on, of one minus the entropy of the block over these pages: 0 for what all pages share, 1 for what
    is on one page. importance of an element without elements in it is that of its content. That of a branch is
    (1 - g) presentation + g (mean of its contents' and its branches' importance, by their pages), g = DAMPING to the
    power of its number of presentations. Elements on one page have importance 1. Counts are partial aggregates over
    (site, element, content), so a site that holds most pages stays spread over all tasks; levels are merged from the
    deepest up, MAX_DEPTH at most.
    """
    each = materialize(pages.select(id_col, "site", F.explode("nodes").alias("n")).where("n.style <> ''").select(id_col, "site", "n.style", "n.kind", F.xxhash64("n.content").alias("content"), "n.children").distinct(), "elements")
    tags = each.where("kind = 'tag'")
    total = materialize(merged(tags, id_col, "style"), "totals")
    looks = tags.groupBy("site", "style", "children").agg(F.countDistinct(id_col).alias("pages"))
    looks = looks.groupBy("site", "style").agg(F.count(F.lit(1)).alias("styles"), (F.log(F.sum("pages")) - F.sum(F.col("pages") * F.log("pages")) / F.sum("pages")).alias("nats"))
    held = each.where("kind <> 'tag'").groupBy("site", "style", "content").agg(F.countDistinct(id_col).alias("pages"))
    own = F.when(F.col("style_pages") > 1, 1 - F.log("pages") / F.log("style_pages")).otherwise(F.lit(1.0))
    held = lookup_join(held, total, ["site", "style"], "inner", written=True).groupBy("site", "style").agg(F.count(F.lit(1)).alias("contents"), F.sum("pages").alias("weight"), (F.sum(F.col("pages") * own) / F.sum("pages")).alias("content"))
    rows = lookup_join(lookup_join(total, looks, ["site", "style"]), held, ["site", "style"])
    rows = rows.withColumn("presentation", F.when(F.col("style_pages") > 1, F.least(F.lit(1.0), F.col("nats") / F.log("style_pages"))).otherwise(F.lit(0.0)))
    rows = materialize(rows.withColumn("depth", F.size(F.split("style", "/")) - 1).fillna(0, ["contents", "weight"]), "tree")
    out, below = None, None
    for depth in range(rows.agg(F.max("depth")).first()[0] or 0, 0, -1):
        level = rows.where(F.col("depth") == depth)
        level = level.withColumns({"below": F.lit(0).cast("long"), "of_below": F.lit(0.0)}) if below is None else lookup_join(level, below, ["site", "style"]).fillna(0, ["below", "of_below"])
        inner = (F.col("weight") * F.coalesce("content", F.lit(0.0)) + F.col("of_below")) / (F.col("weight") + F.col("below"))
        g = F.pow(F.lit(DAMPING), F.col("styles"))
        branch = F.when(F.col("style_pages") < 2, 1.0).when(F.col("weight") + F.col("below") == 0, 1.0).when(F.col("below") == 0, inner).otherwise((1 - g) * F.col("presentation") + g * inner)
        level = materialize(level.withColumn("importance", branch), "level")
        below = level.groupBy("site", F.regexp_replace("style", "/[^/]*$", "").alias("style")).agg(F.sum("style_pages").alias("below"), F.sum(F.col("style_pages") * F.col("importance")).alias("of_below"))
        out = level if out is None else out.unionByName(level)
    columns = ("site", "style", "style_pages", "styles", "contents", "presentation", "content", "importance")
    return (rows.withColumn("importance", F.lit(1.0)).limit(0) if out is None else out).select(*columns)


def clean(df: DataFrame, id_col: str, text: str = "text", site: Column | None = None, least_importance: float = 0.25, least_pages: int = 20) -> DataFrame:
    """(id, clean, kinds, dropped): clean text of every distinct (id, text).

    Branches whose element is on at least least_pages pages of a site and has an importance below least_importance are
    left out with all that is in them; dropped counts their blocks. Null text stays null, empty text empty, plain text
    unchanged. Other columns are not carried over.
    """
    site = F.lit("") if site is None else site
    pages = materialize(page_nodes(df, id_col, text, F.coalesce(site, F.lit(""))), "pages")
    weak = style_tree(pages, id_col).where((F.col("importance") < least_importance) & (F.col("style_pages") >= least_pages))
    weak = weak.groupBy("site").agg(F.collect_set("style").alias("weak"))
    joined = lookup_join(pages, weak, ["site"])  # few elements per site: each is on many of its pages
    blocks = F.filter("nodes", lambda n: n["kind"] != "tag")
    gone = lambda n: F.exists("weak", lambda w: (n["style"] == w) | n["style"].startswith(F.concat(w, F.lit("/"))))
    out = joined.withColumn("blocks", blocks).withColumn("kept", F.filter("blocks", lambda n: ~F.coalesce(gone(n), F.lit(False))))
    body = F.when(~F.col("no_text"), F.array_join(F.transform("kept", lambda n: n["content"]), "\n\n"))
    return out.select(id_col, body.alias("clean"), "kinds", (F.size("blocks") - F.size("kept")).alias("dropped"))
