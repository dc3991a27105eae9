"""Sentence boundaries across languages and scripts.

Every character is tagged boundary (B: last character of a sentence) or inside (I) by a linear-chain model with
averaged-perceptron weights and Viterbi decoding. Characters that no sentence of the script can end with (they are no
stop of any script, no closing mark after one, no space between letters of a script that parts sentences by spaces) have
the tag I fixed, so the chain is decoded over the others only, which gives the same best path. Which of these a place is
depends on the letters around it, not on the line. Edge weights see the tag before and whether a quotation was opened
right there.

Training labels come from the text itself: `silver` labels the stops of a bounded sample of documents by the
orthography around them, the model generalises from the parts of that evidence. Long stretches of a script without
spaces between words, in which there is no stop and no space at all, are cut by a second tagger (`train_unspaced`): it
is trained on the same sample with stops and spaces stripped and reads character n-grams.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.session import distinct_over

#: Documents the model is trained on, drawn by a hash of their text. A bound on the sample only; all rows are tagged.
TRAIN_DOCUMENTS = 2_000
#: Longer documents are not drawn, which bounds what the driver receives.
TRAIN_CHARS = 20_000
EPOCHS = 4
#: Rounds of the tagger for stretches without stops, which reads every character.
UNSPACED_EPOCHS = 6
#: Scores that a tagger keeps by their facts.
KNOWN_SCORES = 200_000

# Abbreviations that stand before a name, number or explanation and so end no sentence.
NEVER = set(
    "mr mrs ms dr prof rev gen capt col lt sgt maj hon st fr mt no nos vol vols pp ch chap fig figs ed eds cf sec art ca approx env aprox "
    "e.g i.e viz vs vgl bd bde nr abb hptm mio mrd tsd z.b u.a d.h c.-à-d p.ex pág págs sr sra srta dra dña mme mlle mgr me "
    "см им акад проф г-н т.е т.к напр стр рис гл ул тов डॉ श्री कि.मी सन् पृ د أ م ص".split()
)
# Abbreviations that may also be the last word of a sentence.
MAYBE = set("etc usw a.m p.m inc ltd co corp bros jr al km cm mm kg др пр كم bzw s.a".split())
# What follows a German ordinal.
AFTER_ORDINAL = set("januar februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts jahrtausend".split())
# Verbs of saying, which name who said the quotation before them.
SAID = {
    "en": "asked said wrote replied answered cried shouted noted added",
    "ar": "سأل سألت قال قالت أجاب أجابت صرخ كتب أضاف",
    "hi": "पूछा कहा बोला बोली लिखा बताया",
    "zh": "问道 说道 答道 喊道 写道 叫道 笑道",
}
OPEN = {"(": ")", "[": "]", "{": "}", "«": "»", "„": "“", "“": "”", "‘": "’", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "［": "］", "【": "】", "‹": "›"}
CLOSE = {c: o for o, c in OPEN.items()} | {"“": "„"}
MARK = re.compile("[\"%s]" % re.escape("".join([*OPEN, *CLOSE])))
QUOTES = set("«„“‘「『\"'‹")
TITLES = set("《〈")
#: Sentence terminals of all scripts by their Unicode property, without the Burmese comma, which has it too; and marks that
#: end sentences though the property leaves them out: ellipsis and Tibetan strokes.
STOPS = set(regex.findall(r"\p{Sentence_Terminal}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)])))) - {"\u104a"} | set("…།༎")
#: Stops that mean more than one thing, or that are followed by a space like them; all others end a sentence by themselves.
NARROW = set(".!?؟।॥۔\u2024‼‽⁇⁈⁉")
WIDE = STOPS - NARROW
LINE = re.compile(r"\r\n|[\n\r\v\f\x85\u2028\u2029]")
ANNOTATION = re.compile(r"\[\[[^\[\]\n]*\]\]")
ANCHOR = re.compile("[%s]+" % re.escape("".join(sorted(STOPS))))
#: The stops of most lines, which are found faster by themselves; and all others.
USUAL = re.compile("[.!?…。！？।॥؟]+")
UNUSUAL = STOPS - set(".!?…。！？।॥؟")
WORD_ENDS = set("([«„“‘”»\"「『（,;:/—–")
NEXT_WORD = re.compile(r"[\w.\-’']+")
LIST_LINE = re.compile(r"\s*(?:[*#•;:]|[-–]\s)")
#: Scripts that part sentences, not words, by spaces: Thai, Lao.
THAI = re.compile("[\u0e00-\u0eff]")
#: Scripts without spaces between words: those, Burmese, Khmer, kana and Chinese characters.
UNSPACED = "\u0e00-\u0eff\u1000-\u1049\u1050-\u109f\u1780-\u17d3\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
HAN = re.compile("[\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
#: Characters without stop and space that are too many for one sentence.
LONG_STRETCH = 60
STRETCH = re.compile(f"[{UNSPACED}]{{{LONG_STRETCH},}}")
NUMBER = re.compile(r"[\d.,:/]+")
INITIALS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
SAID_EN = re.compile(r"(?:[^\W\d_][\w’'\-]* ){1,3}(?:%s)\b" % "|".join(SAID["en"].split()))
SAID_AR = re.compile(r"(?:و|ف)?(?:%s)\b" % "|".join(SAID["ar"].split()))
SAID_HI = re.compile(r"\S+(?: \S+)? ने [^।?!]{0,20}?(?:%s)" % "|".join(SAID["hi"].split()))
SAID_ZH = re.compile(r"[^。！？，、“”「」《》]{1,6}?(?:%s)[。！？…，]" % "|".join(SAID["zh"].split()))
GOES_ON_ZH = re.compile(r"然后|便|就|并|而|地|的")
STARTER = re.compile(r"al-[^\W\d_]|[a-zа-я][A-ZА-Я]|(?:г-н|г-жа|им\.|акад\.|проф\.|св\.)\s?")


def _shadow(line: str) -> str:
    """The line with each annotation as a plain word of its length that begins and ends like its alias."""

    def word(m: re.Match) -> str:
        parts = m.group()[2:-2].split("|")
        alias = (parts[-2] if len(parts) > 1 else parts[0]).strip() or "x"
        if alias.isdigit():
            return alias[0] + "0" * (len(m.group()) - 1)
        end = alias[-1] if THAI.match(alias[-1]) or HAN.match(alias[-1]) else "x"
        return (alias[0] if alias[0].isalnum() else "X") + "x" + "_" * (len(m.group()) - 3) + end

    return ANNOTATION.sub(word, line) if "[[" in line else line


def _near(s: str, at: int, step: int, least: int, most: int) -> str:
    """The nearest letter from `at` on in the direction of step, '' if there is none nearby."""
    while least <= at < most:
        c = s[at]
        if c.isalpha() or THAI.match(c):
            return c
        at += step
    return ""


def _parting(s: str, i: int, j: int, unstopped: bool) -> bool:
    """Whether the white space s[i:j] may end a sentence by itself: between letters of a script that does so, with most
    letters around of that script; and between Chinese or Japanese letters in lines without any stop."""
    left, right = _near(s, i - 1, -1, max(0, i - 40), i), _near(s, j, 1, j, min(len(s), j + 40))
    if left and right and THAI.match(left) and THAI.match(right):
        around = s[max(0, i - 40) : j + 40]
        own = len(THAI.findall(around))
        return own >= sum(c.isalpha() and not THAI.match(c) for c in around)
    return bool(unstopped and HAN.match(s[i - 1]) and HAN.match(s[j]))


def _pairs(s: str) -> dict[int, int]:
    """Positions of opening marks and of the marks that close them, unmatched ones left out."""
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = defaultdict(int)  # how many of each opening mark the stack holds
    pairs: dict[int, int] = {}
    n = len(s)

    def close(mark: str, at: int) -> None:
        while True:
            o, i = stack.pop()
            held[o] -= 1
            if o == mark:
                pairs[i] = at
                return

    for m in MARK.finditer(s):
        i, c = m.start(), m[0]
        mark = CLOSE.get(c, c)
        if c == "“" and not held["„"]:
            mark = ""
        elif c == "’" and 0 < i < n - 1 and s[i - 1].isalpha() and s[i + 1].isalpha():
            continue
        if (c == '"' or c in CLOSE) and mark and held[mark]:
            close(mark, i)
        elif c == '"' or c in OPEN:
            stack.append((c, i))
            held[c] += 1
    return pairs


class Spot:
    """A place where a sentence may end: `end` is the position after its last character, facts what is known around it."""

    __slots__ = ("end", "facts", "edge", "silver")

    def __init__(self, end: int, facts: tuple, edge: str, silver: bool | None):
        self.end, self.facts, self.edge, self.silver = end, facts, edge, silver

    @property
    def features(self) -> list[str]:
        return _features(self.facts)


def _features(facts: tuple) -> list[str]:
    """Names of the model's features of a place; facts without a stop's details are those of a space or a character."""
    if len(facts) != 14:
        return list(facts)
    inside, stop, word, low, kind, gap, spaced, quoted, opens, said, goes_on, ordinal, devanagari, tail = facts
    return [
        "bias",
        f"in:{inside}",
        f"a:{stop}:{word}:{kind}:{gap}",
        f"b:{stop}:{quoted}:{kind}:{opens in ('first', 'after')}",
        f"c:{stop}:{quoted}:{opens}:{said}:{goes_on}:{kind}",
        f"d:{ordinal}:{word}",
        f"e:{stop}:{spaced}:{kind}",
        f"f:{low}:{kind}" if low else f"f:{word}",
        f"g:{word}:{gap}:{kind}:{tail}",
        f"h:{devanagari}:{stop}",
        f"all:{stop}:{word}:{quoted}:{opens}:{kind}:{gap}:{spaced}:{said}:{goes_on}:{inside}:{ordinal}:{devanagari}:{tail or gap}",
    ]


def _next_kind(s: str, j: int, n: int) -> tuple[str, int]:
    """Kind of what follows position j, and where it begins."""
    while j < n and s[j].isspace():
        j += 1
    if j >= n:
        return "end", j
    c = s[j]
    if c in "—–-" and j + 1 < n:
        k = j + 1
        while k < n and s[k].isspace():
            k += 1
        return ("said" if k < n and s[k].islower() and not STARTER.match(s, k) else "dash"), j
    if STARTER.match(s, j):
        return "starter", j
    if c.isdigit():
        return "digit", j
    if c.isalpha():
        if c.islower():
            return "lower", j
        return ("upper" if c.isupper() else "letter"), j
    if c in OPEN or c in "\"'¿¡":
        return "open", j
    return "mark", j


_stop_kinds: dict[str, str] = {}


def _stop_kind(stop: str) -> str:
    """Kind of a run of stops: what it may mean besides the end of a sentence."""
    if set(stop) <= WIDE and stop[0] != "…" or stop == "……":
        kind = "wide"
    elif len(stop) > 1 and set(stop) <= set(".…") or stop == "…":
        kind = "dots"
    else:
        kind = "danda" if stop[0] in "।॥" else stop[-1] if stop[-1] in NARROW else "wide"
    if len(_stop_kinds) < KNOWN_SCORES:
        _stop_kinds[stop] = kind
    return kind


_kinds: dict[str, tuple[str, str]] = {}


def _plain_kind(word: str) -> tuple[str, str]:
    """Kind and lower-cased form of a word that tells its kind by itself."""
    low = word.lower().strip("'’")
    if word.isdigit() or NUMBER.fullmatch(word):
        return "number", low
    if low in MAYBE:
        return "maybe", low
    if low in NEVER:
        return "never", low
    return ("initial" if INITIALS.fullmatch(word) else "word"), low


def _word_kind(s: str, start: int) -> tuple[str, str]:
    """Kind and lower-cased form of the word before a full stop at start."""
    begin, least = start, max(0, start - 40)
    while begin > least and s[begin - 1] not in WORD_ENDS and not s[begin - 1].isspace():
        begin -= 1
    word = s[begin:start]
    if not word:
        return ("closed" if start and s[start - 1] in "”»)）」』\"“" else "none"), ""
    if len(word) == 1 and word.isalpha() and word.lower() not in MAYBE:
        low, before = word.lower(), s[max(0, start - 60) : start - 1]
        if word == "A" and re.search(r"[^\W\d_]*[a-zà-ÿ] S\. $", before) and re.search(r"(?:^|\s)[A-ZÀ-Þ][^\W\d_]+ S\. $", before):
            return "maybe", "s.a"
        if low == "е" and before.endswith("т. "):
            return "never", low
        return "initial", low
    kind = _kinds.get(word)
    if kind is None:
        if len(_kinds) > KNOWN_SCORES:
            _kinds.clear()
        kind = _kinds[word] = _plain_kind(word)
    return kind


def spots(line: str, label: bool = False) -> list[Spot]:
    """The places of a line where a sentence may end, without its very end, in order."""
    s = _shadow(line)
    n = len(s.rstrip())
    if not n or LIST_LINE.match(s) or (s.lstrip()[0] == "=" and s[:n][-1] == "="):
        return []
    found: list[Spot] = []
    pairs = _pairs(s)
    opener = {c: o for o, c in pairs.items()}
    opens_at = sorted(pairs)
    reach = list(accumulate((pairs[o] for o in opens_at), max))  # how far the marks opened so far are open
    places = [m.span() for m in (USUAL if UNUSUAL.isdisjoint(s) else ANCHOR).finditer(s, 0, n)]
    parting: set[int] = set()  # where the spaces are that may end a sentence
    if THAI.search(s) or (not places and HAN.search(s)):
        for m in re.finditer(r"\s+", s[:n]):
            if m.start() and _parting(s, *m.span(), not places):
                parting.add(m.start())
        places = sorted({*[(i, j) for i, j in places if j not in parting and not (s[i] == "." and THAI.match(_near(s, i - 1, -1, max(0, i - 40), i)))], *[(i, -1) for i in parting]})
    last_end, first = 0, len(s) - len(s.lstrip())

    def covered(start: int, end: int) -> bool:
        k = bisect_left(opens_at, start)
        return k > 0 and reach[k - 1] >= end

    for i, j in places:
        if j < 0:
            j = i + len(s[i:n]) - len(s[i:n].lstrip())
            near = s[i - 1].isdigit() or s[j].isdigit()
            inside = covered(i, i + 1)
            f = (f"th:{near}:{inside}", f"th1:{s[i - 1]}|{s[j]}")
            found.append(Spot(i, f, "parting", not near and not inside if label else None))
            continue
        if s[i] == "." and j - i == 1 and 0 < i < n - 1 and s[i - 1].isdigit() and s[i + 1].isdigit():
            continue
        end, o = j, None  # o: where the last mark closed behind the stop was opened, -1 if nowhere
        while end < n:  # closing marks after the stop, in French with a space before them
            k = end
            while k < n and s[k] in " \xa0\u202f" and end - k > -3:
                k += 1
            if k < n and k in opener and (k == end or s[k] == "»") and opener[k] < i:
                o = opener[k]
                end = k + 1
            elif s[end] in "”»）」』" and end not in opener and end not in pairs:
                o = -1
                end += 1
            else:
                break
        if end >= n:
            continue  # the end of the line, which is a boundary anyway
        inside = bool(pairs) and covered(i, end)
        stop = s[i:j]
        kind, at = _next_kind(s, end, n)
        stop_kind = _stop_kinds.get(stop) or _stop_kind(stop)
        word, low = _word_kind(s, i) if stop == "." else ("-", "")
        quoted = opens = ""
        said = goes_on = False
        if o is not None:
            ahead = s[at : at + 40]
            quoted = "lost" if o < 0 else "title" if s[o] in TITLES else "quote" if s[o] in QUOTES else "bracket"
            opens = "" if o < 0 else "first" if o == first else "after" if s[last_end:o].strip() == "" else "colon" if o and s[o - 1] in "：:" else "mid"
            said = bool(SAID_EN.match(ahead) if kind == "upper" else kind == "letter" and (SAID_AR.match(ahead) or SAID_HI.match(ahead) or SAID_ZH.match(ahead) or (quoted == "quote" and ahead[0] == "と")))
            goes_on = kind == "letter" and (bool(GOES_ON_ZH.match(ahead)) or ahead[0] in "はがをにのとも")
        ordinal = False
        if word == "number":
            nxt = NEXT_WORD.match(s, at, at + 40)
            ordinal = bool(nxt) and nxt.group().lower().rstrip(".") in AFTER_ORDINAL
        spaced, devanagari = i > 0 and s[i - 1].isspace(), i > 0 and "ऀ" <= s[i - 1] <= "ॿ"
        tail, gap = s[at + 1 : at + 2], at > end
        f = (inside, stop_kind, word, low if word in ("never", "maybe", "initial") else "", kind, gap, spaced, quoted, opens, said, goes_on, ordinal, devanagari, tail.islower())
        spot = Spot(end, f, opens or "none", None)
        if label:
            spot.silver = silver(inside, stop_kind, word, kind, gap, spaced, quoted, opens, said, goes_on, ordinal, devanagari, tail)
        found.append(spot)
        last_end = end
    return found


def silver(inside, stop, word, kind, gap, spaced, quoted, opens, said, goes_on, ordinal, devanagari, tail) -> bool:
    """Training label of a place by the orthography around it."""
    if inside or said or goes_on or kind in ("mark", "said") or quoted == "title":
        return False
    new = kind in ("upper", "letter", "open", "dash", "digit", "starter")
    if quoted == "bracket":
        return new and opens in ("first", "after")
    if stop in ("wide", "danda"):
        return True
    if stop == "dots":
        return new and not (spaced and kind == "starter")
    if stop in "!?؟":
        return new
    if quoted:
        return new
    if devanagari:
        return False
    if word in ("never", "initial", "none"):
        return False
    if word == "maybe":
        return new and kind != "digit"
    if word == "number":
        return new and not ordinal
    if not gap and kind in ("upper", "letter"):
        return tail.islower() or not tail.isupper()
    return new


class Tagger:
    """Averaged structured perceptron over spots; tags 0 (inside) and 1 (boundary)."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}
        self.known: dict | None = {}  # scores by facts; None while the weights still change

    def _emit(self, facts: tuple) -> float:
        w = self.weights.get
        return sum(w(f, 0.0) for f in _features(facts))

    def _edges(self, edge: str) -> tuple[float, float, float, float]:
        w = self.weights.get
        return tuple(w(f"t:{p}{t}", 0.0) + w(f"o:{p}{t}:{edge}", 0.0) for t in (0, 1) for p in (0, 1))

    def decode(self, chain: list[Spot]) -> list[int]:
        """The best tags by Viterbi's recursion; a tie keeps the tag 0."""
        if not chain:
            return []
        known, back, low, high = self.known, [], 0.0, 0.0
        if known and len(known) > KNOWN_SCORES:
            known.clear()
        for k, spot in enumerate(chain):
            if known is None:
                emit, edges = self._emit(spot.facts), self._edges(spot.edge)
            else:
                emit = known.get(spot.facts)
                if emit is None:
                    emit = known[spot.facts] = self._emit(spot.facts)
                edges = known.get(spot.edge)
                if edges is None:
                    edges = known[spot.edge] = self._edges(spot.edge)
            if not k:
                low, high = 0.0, emit
                back.append((0, 0))
                continue
            a, b, c, d = low + edges[0], high + edges[1], low + edges[2], high + edges[3]
            back.append((int(b > a), int(d > c)))
            low, high = (b if b > a else a), (d if d > c else c) + emit
        tag, tags = int(high > low), []
        for k in range(len(chain) - 1, -1, -1):
            tags.append(tag)
            tag = back[k][tag]
        return tags[::-1]

    @classmethod
    def train(cls, chains: list[tuple[list[Spot], list[int]]], epochs: int = EPOCHS) -> Tagger:
        tagger = cls()
        tagger.known = None
        total: dict[str, float] = defaultdict(float)
        step = 1

        def bump(name: str, by: float) -> None:
            tagger.weights[name] = tagger.weights.get(name, 0.0) + by
            total[name] += by * step

        for _ in range(epochs):
            for chain, gold in chains:
                tags = tagger.decode(chain)
                step += 1
                for k, (spot, tag, true) in enumerate(zip(chain, tags, gold)):
                    if tag != true:
                        for f in spot.features:
                            bump(f, true - tag)
                    if k and (tag, tags[k - 1]) != (true, gold[k - 1]):
                        for name, by in ((f"{gold[k - 1]}{true}", 1.0), (f"{tags[k - 1]}{tag}", -1.0)):
                            bump(f"t:{name}", by)
                            bump(f"o:{name}:{spot.edge}", by)
        tagger.weights = {k: v - total[k] / step for k, v in tagger.weights.items() if v or total[k]}
        tagger.known = {}
        return tagger


def train(texts: list[str], epochs: int = EPOCHS) -> Tagger:
    """Model from raw documents, labelled by `silver`."""
    chains = []
    for text in texts:
        for line in LINE.split(text or ""):
            chain = spots(line, label=True)
            if chain:
                chains.append((chain, [int(x.silver) for x in chain]))
    return Tagger.train(chains, epochs)


def ends(text: str, tagger: Tagger, unspaced: Tagger | None = None) -> list[int]:
    """Positions after the last character of each sentence of text; `unspaced` cuts stretches without stop and space."""
    out, at = [], 0
    for m in [*LINE.finditer(text), None]:
        line = text[at : m.start() if m else len(text)]
        length = len(line.rstrip())
        if length:
            chain = spots(line)
            own = [x.end for x, tag in zip(chain, tagger.decode(chain)) if tag]
            if unspaced is not None:
                for run in STRETCH.finditer(line):
                    own += [run.start() + e for e in ends_unspaced(run[0], unspaced)[:-1]]
                own.sort()
            out += [at + e for e in own]
            out.append(at + length)
        if m:
            at = m.end()
    return out


# Scripts written without stops: characters of text whose spaces were stripped, tagged from the n-grams around them.


STRIPPED = regex.compile(r"[^\p{L}\p{M}\p{N}]+")


def _unspaced_chain(s: str) -> list[Spot]:
    padded = f"^^^{s}$$$"
    out = []
    for i in range(1, len(s)):
        a = i + 3  # boundary lies before padded[a]
        out.append(Spot(i, ("bias", f"l2{padded[a - 2 : a]}", f"l3{padded[a - 3 : a]}", f"r2{padded[a : a + 2]}", f"r3{padded[a : a + 3]}", f"m{padded[a - 1 : a + 1]}", f"M{padded[a - 2 : a + 2]}"), "char", None))
    return out


def train_unspaced(texts: list[str], epochs: int = 3 * EPOCHS, tagger: Tagger | None = None) -> Tagger:
    """Tagger for unspaced, unpunctuated text, from the lines in such scripts of documents whose sentences `tagger` (else
    silver labels) can tell, those that have stretches without stops left out. All else than letters, marks and digits is
    stripped from them."""
    tagger = tagger or train(texts)
    chains = []
    for text in texts:
        for line in LINE.split(text or ""):
            if 2 * sum(map(len, re.findall(f"[{UNSPACED}]+", line))) < len(line) or STRETCH.search(line):
                continue
            cuts, stripped, seen, at = [], [], 0, 0
            for end in ends(line, tagger):
                part = STRIPPED.sub("", line[at:end])
                stripped.append(part)
                seen += len(part)
                cuts.append(seen)
                at = end
            s = "".join(stripped)
            chain = _unspaced_chain(s)
            if chain:
                gold = set(cuts)
                chains.append((chain, [int(x.end in gold) for x in chain]))
    return Tagger.train(chains, epochs)


def ends_unspaced(line: str, tagger: Tagger) -> list[int]:
    chain = _unspaced_chain(line)
    return [x.end for x, tag in zip(chain, tagger.decode(chain)) if tag] + ([len(line)] if line else [])


def sample(df: DataFrame, text: str = "text", documents: int = TRAIN_DOCUMENTS) -> list[str]:
    """At most `documents` distinct texts of at most TRAIN_CHARS characters, those whose hash is lowest."""
    rows = df.select(F.col(text).alias("text"), F.xxhash64(text).alias("h")).where(F.char_length("text") <= TRAIN_CHARS)
    last = rows.select("h").distinct().orderBy("h").limit(documents).agg(F.max("h")).first()[0]  # only hashes are moved
    if last is None:
        return []
    own = rows.where(F.col("h") <= last).distinct().orderBy("h", "text").limit(documents)
    return [r["text"] for r in own.collect()]


def fit(df: DataFrame, text: str = "text", documents: int = TRAIN_DOCUMENTS, epochs: int = EPOCHS) -> Tagger:
    """Tagger trained on a bounded sample of df."""
    return train(sample(df, text, documents), epochs)


def has_stretches(df: DataFrame, text: str = "text") -> bool:
    """Whether any text has a stretch that only the second tagger can cut."""
    # tried where a run of such letters begins only, so each character is looked at once or twice
    return not df.where(F.col(text).rlike(f"(?<![{UNSPACED}])[{UNSPACED}]{{{LONG_STRETCH}}}")).isEmpty()


def sentence_ends(texts: Column, tagger: Tagger, unspaced: Tagger | None = None) -> Column:
    """Column of arrays: for each text the character positions at which its sentences end."""
    weights, more = dict(tagger.weights), None if unspaced is None else dict(unspaced.weights)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, second = Tagger(weights), None if more is None else Tagger(more)
        for batch in batches:
            yield batch.map(lambda t: ends(t, own, second) if isinstance(t, str) else [])

    # else the optimizer copies the tagging into a filter below the distinct, and every text is tagged twice
    return run.asNondeterministic()(texts)


def sentences(df: DataFrame, id_col: str, text: str = "text", tagger: Tagger | None = None, unspaced: Tagger | None = None) -> DataFrame:
    """(id, start_char, end_char, sentence), one row per sentence of every distinct (id, text).

    Positions count code points; start is that of the sentence's first character that is no white space. Null, empty
    and blank texts have no sentences. Very long texts are read line by line and never cut. Other columns of df are
    not carried over. Taggers that are not given are trained on a sample of df, the one for stretches without stops only
    where there are any.
    """
    if tagger is None or unspaced is None and has_stretches(df, text):
        texts = sample(df, text)
        tagger = tagger or train(texts)
        unspaced = unspaced or (train_unspaced(texts, UNSPACED_EPOCHS, tagger) if has_stretches(df, text) else None)
    rows = df.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).where("__text is not null")
    cut = distinct_over(rows).withColumn("__ends", sentence_ends(F.col("__text"), tagger, unspaced))
    each = cut.select("__id", "__text", F.posexplode("__ends").alias("pos", "end_char"), "__ends")
    raw_start = F.when(F.col("pos") == 0, 0).otherwise(F.element_at("__ends", F.greatest(F.col("pos"), F.lit(1))))
    piece = F.substring(F.col("__text"), raw_start + 1, F.col("end_char") - raw_start)
    trimmed = F.regexp_replace(piece, r"(?U)^[\s\x1c-\x1f]+", "")
    return each.select(F.col("__id").alias(id_col), (F.col("end_char") - F.char_length(trimmed)).alias("start_char"), "end_char", trimmed.alias("sentence"))
