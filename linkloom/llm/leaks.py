"""Evaluation texts leaking into training text: q-gram lemma filtering over diagonal bands, then banded alignment.

Texts are compared as their words (letters and digits, without case, accents, invisible characters or markup) joined by
single spaces. A part of an item of at least n characters that occurs with at most e edits shares n + 1 - q(e + 1)
character q-grams with the document inside a band of e + 1 diagonals. Shared q-grams are counted per item and band over
overlapping bands; only regions that reach the bound are aligned inside their band. Each item has the longest q, a power
of two times the least, that still leaves the bound some q-grams to ask for: long q-grams are rare in any text. What a
document shares with the items is counted in tiles, stretches of the document against some of the items, that hold a
bounded number of pairs of places, however often a q-gram occurs on both sides.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.markup import running_text
from linkloom.session import materialize, spread

Q = 8
EDITS = 2
MIN_WORDS = 12
#: Characters of items that one pass holds; larger sets are taken in blocks, each against all documents.
BLOCK_CHARS = 16_000_000

#: Characters of documents whose q-grams a task holds at a time.
AT_ONCE = 2_000_000
#: Pairs of places, in a document and in an item, that are counted at a time.
PAIRS_AT_ONCE = 1_000_000
#: Regions that are aligned at a time.
JOBS_AT_ONCE = 8_192
#: Shared q-grams that the bound must ask for before an item gets q-grams of twice the length.
LEAST_SHARED = 8
#: The longest q-grams, in lengths of the shortest.
LONGEST = 4

WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def _dropped() -> np.ndarray:
    """Whether a code point is a mark or format character: accents after decomposition, soft hyphens, zero-width signs."""
    drop = np.zeros(0x110000, dtype=bool)
    for c in [*range(0x80, 0x20000), *range(0xE0000, 0xE0200)]:
        drop[c] = unicodedata.category(chr(c)) in ("Mn", "Me", "Cf")
    return drop


def words(text: str) -> list[str]:
    if not text.isascii():
        codes = _codes(unicodedata.normalize("NFKD", text))
        text = codes[~_dropped()[codes]].tobytes().decode("utf-32-le", "surrogatepass")
    return WORD.findall(text.casefold())


def streams(text: str, min_words: int = 1) -> list[str]:
    """The words of a document without its markup, and as they stand where that differs, joined by single spaces; those of
    fewer than min_words words are left out."""
    raw, bare = words(text), running_text(text)
    plain = raw if bare is None else words(bare)
    return [" ".join(w) for w in ([plain, raw] if plain != raw else [raw]) if len(w) >= min_words]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Rolling hash of each run of q characters."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h


class Items:
    """A bounded set of items, and an index of their q-grams for each q in use."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edits: int = EDITS, min_words: int = MIN_WORDS):
        self.q, self.edits, self.min_words = q, edits, min_words
        self.ids, self.codes, self.words, self.hashes, self.need, self.q_of = [], [], [], [], [], []
        span: list[int] = []
        for ident, text in items:
            w = words(text)
            if len(w) < min_words:
                continue
            lengths = np.array([len(x) for x in w])
            least = int(np.convolve(lengths, np.ones(min_words, dtype=int), "valid").min()) + min_words - 1
            own = q
            while own < LONGEST * q and least + 1 - 2 * own * (edits + 1) >= LEAST_SHARED:
                own *= 2
            self.ids.append(ident)
            self.codes.append(_codes(" ".join(w)))
            self.words.append(w)
            self.hashes.append(word_hashes(w))
            self.q_of.append(own)
            # with short words the bound allows fewer edits than asked for; one shared q-gram is always needed
            self.need.append(max(1, least + 1 - own * (edits + 1)))
            span.append(least + edits - own)
        self.indexes = [Index(self, [k for k, own in enumerate(self.q_of) if own == x], x, span) for x in sorted(set(self.q_of))]


class Index:
    """The q-grams of the items of one q."""

    def __init__(self, items: Items, members: list[int], q: int, span: list[int]):
        self.q, self.edits, self.members = q, items.edits, np.array(members)
        grams = [_grams(items.codes[k], q) for k in members]
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.keys, first, count = np.unique(flat[order], return_index=True, return_counts=True)
        self.first, self.count = first.astype(np.int64), count.astype(np.int64)
        self.owner = np.repeat(np.arange(len(members)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.by_owner = np.repeat(np.arange(len(self.keys)), self.count) * len(members) + self.owner  # sorted: key, then owner
        self.need = np.array([items.need[k] for k in members], dtype=np.int64)
        self.span = np.array([span[k] for k in members], dtype=np.int64)
        self.low_bits = np.zeros(1 << 22, dtype=bool)  # most q-grams of a corpus are told apart by these alone
        self.low_bits[self.keys & np.uint64((1 << 22) - 1)] = True

    def shared(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in grams of q-grams that items have, and the index of each in keys."""
        at = np.flatnonzero(self.low_bits[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
        key = np.searchsorted(self.keys, grams[at])
        key[key == len(self.keys)] = 0
        same = self.keys[key] == grams[at]
        return at[same], key[same]

    def regions(self, at: np.ndarray, key: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(member, diagonal from, to, document from, to, shared q-grams) of the bands that reach the bound; at, key: shared
        q-grams, in text order. Stretches of the text overlap by the longest part looked for, so each such part lies in one of them."""
        reach, most = int(self.span.max()) + 1, len(self.members)
        upto = np.cumsum(self.count[key])
        found: list[np.ndarray] = []
        i = 0
        while i < len(at):
            before = int(upto[i - 1]) if i else 0
            j = max(int(np.searchsorted(upto, before + PAIRS_AT_ONCE, "right")), int(np.searchsorted(at, at[i] + 2 * reach, "right")), i + 1)
            self._tile(at[i:j], key[i:j], 0, most, found)
            if j >= len(at):
                break
            i = max(int(np.searchsorted(at, at[j] - reach)), i + 1)
        rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 6), dtype=np.int64)
        # a region inside the one before it, in the order of where they begin and how long they are, says nothing new
        rows = rows[np.lexsort((-rows[:, 4], rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        same = (np.diff(rows[:, :3], axis=0, prepend=-1) == 0).all(axis=1) if len(rows) else np.zeros(0, dtype=bool)
        inside = same & np.append(False, rows[1:, 4] <= rows[:-1, 4]) if len(rows) else same
        return [tuple(r) for r in rows[~inside].tolist()]

    def _tile(self, at: np.ndarray, key: np.ndarray, low: int, high: int, found: list[np.ndarray]) -> None:
        """Bands of the members low to high inside a stretch; with too many pairs of places, half of the members at a time."""
        if (low, high) == (0, len(self.members)):
            first, n = self.first[key], self.count[key]
        else:
            first = np.searchsorted(self.by_owner, key * len(self.members) + low)
            n = np.searchsorted(self.by_owner, key * len(self.members) + high) - first
        pairs = int(n.sum())
        if not pairs:
            return
        if pairs > PAIRS_AT_ONCE and high - low > 1:
            middle = (low + high) // 2
            self._tile(at, key, low, middle, found)
            self._tile(at, key, middle, high, found)
            return
        doc = np.repeat(at, n)
        slot = np.repeat(first, n) + np.arange(pairs) - np.repeat(np.cumsum(n) - n, n)
        item = self.owner[slot]
        live = (np.bincount(item - low, minlength=high - low) >= self.need[low:high])[item - low]
        if not live.any():
            return
        doc, item, diagonal = doc[live], item[live], (doc - self.place[slot])[live]
        band = (diagonal - diagonal.min()) // (self.edits + 1)
        many = int(band.max()) // 2 + 2
        for shift in (0, 1):  # bands two widths broad, each overlapping the next by one
            code = (item - low) * many + (band + shift) // 2
            if many * (high - low) <= 1 << 22:
                size = np.bincount(code)[code]
            else:
                _, back, count = np.unique(code, return_inverse=True, return_counts=True)
                size = count[back]
            full = np.flatnonzero(size >= self.need[item])
            order = full[np.lexsort((doc[full], code[full]))]
            if not len(order):
                continue
            # the bound must be met inside a stretch as long as the shortest part looked for
            where, of, group = doc[order], item[order], code[order]
            upto = np.arange(len(order)) + self.need[of] - 1
            last = np.minimum(upto, len(order) - 1)
            near = np.flatnonzero((upto < len(order)) & (group[last] == group) & (where[last] - where <= self.span[of]))
            if not len(near):
                continue
            begin = np.flatnonzero(np.diff(group[near], prepend=-1))
            first, end = near[begin], last[near[np.append(begin[1:], len(near)) - 1]]
            d = np.append(diagonal[order], 0)
            cuts = np.stack([first, end + 1], axis=1).ravel()
            lows, highs = np.minimum.reduceat(d, cuts)[::2], np.maximum.reduceat(d, cuts)[::2]
            found.append(np.stack([of[first], lows, highs, where[first], where[end] + self.q, end - first + 1], axis=1))


def aligned(jobs: list[tuple[np.ndarray, np.ndarray, int, int]], edits: int, at_once: int = 1024) -> np.ndarray:
    """Per job (item, text part, lowest and highest diagonal) the longest piece of the text part that equals a piece of
    the item with at most `edits` edits, on diagonals (text position minus item position) not further off than `edits`.

    All jobs of a round advance together, one text character at a time, over arrays (job, diagonal, edits).
    """
    best = np.zeros(len(jobs), dtype=np.int64)
    order = sorted(range(len(jobs)), key=lambda k: len(jobs[k][1]))
    for r in range(0, len(order), at_once):
        rows = order[r : r + at_once]
        n = len(rows)
        long_item, long_text = max(len(jobs[k][0]) for k in rows), max(len(jobs[k][1]) for k in rows)
        item = np.zeros((n, long_item), dtype=np.uint32)
        text = np.zeros((n, long_text), dtype=np.uint32)
        low = np.array([jobs[k][2] - edits for k in rows])
        width = max(jobs[k][3] - jobs[k][2] for k in rows) + 2 * edits + 1
        size, length = np.array([len(jobs[k][0]) for k in rows]), np.array([len(jobs[k][1]) for k in rows])
        for x, k in enumerate(rows):
            item[x, : size[x]], text[x, : length[x]] = jobs[k][0], jobs[k][1]
        above = np.zeros((edits + 1, n, width + 2), dtype=np.int32)
        top = np.zeros(n, dtype=np.int64)
        span, line = np.arange(width), np.arange(n)[:, None]
        for j in range(long_text):
            i = j - low[:, None] - span
            inside = (i >= 0) & (i < size[:, None]) & (j < length)[:, None]
            same = item[line, np.clip(i, 0, long_item - 1)] == text[:, j][:, None]
            row = np.zeros_like(above)
            for e in range(edits + 1):
                # a character more in the text comes from the diagonal below, one more in the item from the one above
                cell = np.where(same, above[e][:, 1:-1] + 1, 0)
                if e:
                    less, up = above[e - 1][:, 1:-1], above[e - 1][:, :-2]
                    cell = np.maximum(cell, np.where(~same & (less > 0), less + 1, 0))
                    cell = np.maximum(cell, np.where(up > 0, up + 1, 0))
                    cell = np.maximum(cell, np.maximum(row[e - 1][:, 2:], row[e - 1][:, 1:-1]))
                row[e][:, 1:-1] = np.where(inside, cell, 0)
            top = np.maximum(top, row[edits].max(axis=1))
            above = row
        best[rows] = top
    return best


def longest_run(a: list[str], b: list[str]) -> int:
    """Most words in a row that a and b share."""
    where: dict[str, list[int]] = {}
    for i, w in enumerate(b):
        where.setdefault(w, []).append(i)
    best, before = 0, {}
    for w in a:
        now = {}
        for i in where.get(w, ()):
            now[i] = n = before.get(i - 1, 0) + 1
            if n > best:
                best = n
        before = now
    return best


def word_hashes(w: list[str]) -> np.ndarray:
    return np.array([hash(x) & 0xFFFFFFFFFFFFFFFF for x in w], dtype=np.uint64)


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by doubling."""
    out, length, step = None, 0, h
    size, left = 1, n
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                out = step[: len(h) - size + 1] if out is None else out[: len(h) - length - size + 1] * np.uint64(0x9E3779B97F4A7C15) + step[length : len(h) - size + 1] * np.uint64(size * 2 + 1)
                length += size
            left >>= 1
            if left:
                step = step[: len(h) - 2 * size + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + (step[size:] ^ (step[size:] >> np.uint64(31)))
                size *= 2
    return out


def run_length(a: list[str], b: list[str], ha: np.ndarray, hb: np.ndarray) -> int:
    """longest_run by hashes of runs: the longest n of which both have a common run, found by halving, and then compared."""

    def common(n: int) -> tuple[int, int] | None:
        x, y = _windows(ha, n), _windows(hb, n)
        order = np.argsort(y)
        at = np.searchsorted(y[order], x)
        at[at == len(y)] = 0
        hit = np.flatnonzero(y[order[at]] == x)
        return (int(hit[0]), int(order[at[hit[0]]])) if len(hit) else None

    low, high, where = 0, min(len(a), len(b)), (0, 0)
    while low < high:
        n = (low + high + 1) // 2
        hit = common(n)
        if hit:
            low, where = n, hit
        else:
            high = n - 1
    same = a[where[0] : where[0] + low] == b[where[1] : where[1] + low]
    return low if same else longest_run(a, b)


def find(texts: list[list[str] | None], items: Items) -> list[list[tuple[int, int, int]]]:
    """Per text, given as its streams of words joined by spaces, the items in it: (item id, characters aligned, words in a
    row)."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts, owner = [], []
    for k, text in enumerate(texts):
        for stream in text if text is not None else ():
            parts.append(stream)
            owner.append(k)
    if not parts or not items.ids:
        return out
    codes = [_codes(p) for p in parts]
    longest = items.indexes[-1].q
    gap = np.full(longest, 0x7FFFFFFF, dtype=np.uint32)  # no character: no q-gram lies across two texts
    starts, flat, at = [], [], 0
    for c in codes:
        starts.append(at)
        flat += [c, gap]
        at += len(c) + longest
    whole, starts = np.concatenate(flat), np.array(starts)
    jobs, of, reach = [], [], []
    for index in items.indexes:
        hit, slot = index.shared(_grams(whole, index.q))
        part = np.searchsorted(starts, hit, side="right") - 1
        enough = np.bincount(part, minlength=len(parts))[part] >= index.need.min()  # no band can hold more than all
        hit, slot, part = hit[enough], slot[enough], part[enough]
        for rows in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(part)) + 1) if len(hit) else ():
            p = int(part[rows[0]])
            slack = index.q + items.edits
            for member, low, high, begin, end, held in index.regions(hit[rows] - starts[p], slot[rows]):
                k = int(index.members[member])
                a, b = max(0, begin - slack), min(len(codes[p]), end + slack)
                jobs.append((items.codes[k], codes[p][a:b], low - a, high - a))
                of.append((p, k))
                # by the same lemma nothing longer can be in a region that shares so few q-grams
                reach.append(min(min(b - a, len(items.codes[k])) + items.edits, held + index.q * (items.edits + 1) - 1))
    best: dict[tuple[int, int], int] = {}
    order = sorted(range(len(jobs)), key=lambda x: -reach[x])
    for r in range(0, len(order), JOBS_AT_ONCE):
        todo = [x for x in order[r : r + JOBS_AT_ONCE] if best.get(of[x], 0) < reach[x]]  # else nothing longer can come of it
        for x, n in zip(todo, aligned([jobs[x] for x in todo], items.edits)):
            best[of[x]] = max(best.get(of[x], 0), int(n))
    split: dict[int, tuple[list[str], np.ndarray]] = {}
    for (p, k), n in best.items():
        if n >= items.need[k] + items.q_of[k] - 1:
            if p not in split:
                w = parts[p].split(" ")
                split[p] = (w, word_hashes(w))
            out[owner[p]].append((items.ids[k], n, run_length(split[p][0], items.words[k], split[p][1], items.hashes[k])))
    return out


def passages(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(id, text) of the items without their first line, the instruction."""
    return items.select(F.col(item_id).alias("id"), F.regexp_replace(F.col(text), r"^[^\n]*\n?", "").alias("text")).where("id is not null and text is not null").distinct()


def _portions(texts: list[list[str]]) -> Iterator[list[list[str]]]:
    """The texts in runs of about AT_ONCE characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        n = sum(map(len, t))
        if run and size + n > AT_ONCE:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


_indexed: dict[tuple, Items] = {}


def _index(held, name: str, q: int, edits: int, min_words: int) -> Items:
    """The index of a block of items, made once by each Python worker."""
    key = (name, q, edits, min_words)
    if key not in _indexed:
        _indexed.clear()
        _indexed[key] = Items(held.value, q, edits, min_words)
    return _indexed[key]


def _finder(held, name: str, q: int, edits: int, min_words: int, raw: bool):
    @F.pandas_udf("array<struct<item_id:long,characters:int,words:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index(held, name, q, edits, min_words)
        for batch in batches:
            out = []
            for texts in _portions([(streams(t, min_words) if raw else list(t)) if t is not None else [] for t in batch]):
                out += [[{"item_id": i, "characters": c, "words": w} for i, c, w in found] for found in find(texts, index)]
            yield pd.Series(out)

    return run.asNondeterministic()  # else the optimizer copies the search into a filter below the explode


def _word_streams(min_words: int):
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: streams(t, min_words))

    return run


def leaks(df: DataFrame, id_col: str, items: DataFrame, text: str = "text", q: int = Q, edits: int = EDITS, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item_id, characters, words): the items (id, text) of which each document contains a part.

    characters is the longest part aligned within `edits` edits, words the most words in a row without any. Documents
    are read whole and are not shuffled; items are sent to them in blocks of block_chars characters. With more than one
    block the documents' words are written once, the blocks follow one another, and each is released before the next is
    collected. Items of fewer than min_words words cannot be found. Null and empty texts contain nothing.
    """
    spark = df.sparkSession
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    docs = spread(df.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).where(F.octet_length("__text") > 2 * min_words - 2))
    if blocks > 1:
        docs = materialize(docs.select("__id", _word_streams(min_words)("__text").alias("__text")), "words")
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()
        held = spark.sparkContext.broadcast([(r["id"], r["text"]) for r in rows])
        run = _finder(held, uuid.uuid4().hex, q, edits, min_words, blocks == 1)
        part = docs.select("__id", F.explode(run("__text")).alias("f")).select("__id", "f.*")
        if blocks > 1:
            part = materialize(part, "found")
            held.destroy()
        out = part if out is None else out.unionByName(part)
    return out.groupBy(F.col("__id").alias(id_col), "item_id").agg(F.max("characters").alias("characters"), F.max("words").alias("words"))
