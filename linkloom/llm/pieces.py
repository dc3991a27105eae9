"""Splitting oversized items at natural boundaries, by dynamic programming over boundary positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.tokens import DEFAULT_TOKENIZER, Tokenizer, load
from linkloom.session import distinct_over

MAX_TOKENS = 2_000
OVERLAP = 100
#: Penalty of a cut after: a paragraph, a line, a sentence, a clause, a word, and inside a word.
PENALTIES = {"paragraph": 0.0, "line": 1.0, "sentence": 2.0, "clause": 5.0, "word": 9.0, "inside": 40.0}
NAMES = list(PENALTIES)
#: Penalty of a cut whose overlap begins inside a word.
SPLIT_START = 1.5
#: Penalty of a piece that is twice its even share.
IMBALANCE = 6.0
#: Weights up to which boundaries are tried, one after the other, until no heavier one can help.
LEVELS = (1.0, 3.5, 6.5, 11.0, np.inf)

_KIND = re.compile(r"(?P<paragraph>\n[^\S\n]*\n\s*)|(?P<line>[\n\r\v\f\x85\u2028\u2029]\s*)|(?P<sentence>(?:[.!?…؟।]+[\"'”’»)\]]*(?=\s)|[。！？]+[”」』）]*))|(?P<clause>[,;:،，、；：]+)")

# White space.
SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)


def _kinds(text: str) -> np.ndarray:
    """For each position between characters the best kind of cut there, as an index into NAMES.

    Cuts lie before white space: a byte-level token often begins with it, and at the end of a piece it would merge.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = np.isin(codes, SPACES)
    kind = np.full(len(text) + 1, NAMES.index("inside"), dtype=np.int8)
    kind[:-1][space & ~np.concatenate([[False], space[:-1]])] = NAMES.index("word")
    for m in _KIND.finditer(text):
        a = m.start() + len(m[0].rstrip())
        kind[a] = min(kind[a], NAMES.index(m.lastgroup))
    return kind


def cut_positions(n: int, kinds: np.ndarray, allowed: np.ndarray, limit: int, overlap: int, extra: np.ndarray | None = None) -> list[int] | None:
    """Cuts 0 < c < n (in tokens) of least penalty and imbalance with all pieces within limit; None if there are none.

    The first piece holds limit new tokens at most, each later one limit - overlap. kinds[c] is the kind of a cut,
    allowed[c] whether one may be made at c, and extra[c] a further penalty of it. The program runs over the lighter
    boundaries first: costs are never negative, so once the next heavier boundary and the least that all further cuts
    cost come to more than what was found, no cut there can be part of anything better, and the result is that of all.
    """
    count = 1 + -(-(n - limit) // (limit - overlap))
    share = (n + (count - 1) * overlap) / count
    weight = np.array([PENALTIES[k] for k in NAMES])[kinds] + (0.0 if extra is None else extra)
    at = np.flatnonzero(allowed[:n])
    at = at[at > overlap]
    own = weight[at]
    least = float(own.min(initial=np.inf))
    for level in LEVELS:
        heavier = own[own > level]
        if len(heavier) and len(heavier) == len(own):
            continue
        cost, cuts = _program(n, at[own <= level], weight, share, limit, overlap)
        if not len(heavier):
            return cuts
        if cuts is not None and cost <= float(heavier.min()) + max(0, count - 2) * least:
            return cuts
    return None


def _program(n: int, at: np.ndarray, weight: np.ndarray, share: float, limit: int, overlap: int) -> tuple[float, list[int] | None]:
    """The least cost over cuts at the places `at`, and these cuts."""
    room = limit - overlap
    points = np.concatenate([[0], at, [n]])
    first = np.searchsorted(points, points - room).tolist()  # the earliest place a piece that ends here may follow
    scale = IMBALANCE / share**2
    before = points - (overlap - share)
    cost = np.full(len(points), np.inf)
    back = np.zeros(len(points), dtype=np.int64)
    cost[0] = 0.0
    whole = scale * (points - share) ** 2
    add = weight[points]
    add[-1] = 0.0
    for j in range(1, len(points)):
        lo, best = max(1, first[j]), np.inf
        if points[j] <= limit:
            best = whole[j]
        if lo < j:
            c = points[j] - before[lo:j]
            c *= c
            c *= scale
            c += cost[lo:j]
            k = int(c.argmin())
            if c[k] < best:
                best, back[j] = c[k], lo + k
        cost[j] = best + add[j]
    if not np.isfinite(cost[-1]):
        return np.inf, None
    cuts, j = [], len(points) - 1
    while back[j]:
        j = back[j]
        cuts.append(int(points[j]))
    return float(cost[-1]), cuts[::-1]


def _parted(text: str, at: int) -> bool:
    return at == 0 or at == len(text) or (text[at].isspace() and not text[at - 1].isspace())


def check_limits(limit: int, overlap: int) -> None:
    if overlap < 0 or limit < 2 * overlap + 8:
        raise ValueError(f"pieces of {limit} tokens cannot overlap by {overlap}: the limit must be at least twice the overlap and 8")


def split_text(text: str, tokenizer: Tokenizer, limit: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start_char, end_char, tokens, kind of the cut at its end) of each piece; one piece if the text is within limit.

    Tokens are those of the whole text. Each piece starts with the last `overlap` tokens of the one before; both borders
    are character borders, and the piece encoded by itself is within limit too. Where no cuts have their overlap begin
    between characters (all characters of several tokens), it begins with the character those tokens lie in. Limits that
    leave no room beside the overlap raise ValueError, as does a text that cannot be cut within them.
    """
    check_limits(limit, overlap)
    if len(text.encode("utf-8", "surrogatepass")) <= limit:
        n = tokenizer.count(text)
        if n <= limit:
            return [(0, len(text), n, "end")]
    ends = tokenizer.borders(text)
    n = len(ends)
    if n <= limit:
        return [(0, len(text), n, "end")]
    widths = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    char_ends = np.concatenate([[0], np.cumsum(1 + (widths > 0x7F) + (widths > 0x7FF) + (widths > 0xFFFF))])
    borders = np.concatenate([[0], ends])  # byte position before token i
    char_at = np.searchsorted(char_ends, borders)
    whole = char_ends[np.minimum(char_at, len(text))] == borders
    kinds = _kinds(text)[np.minimum(char_at, len(text))]
    starts_word = np.zeros(n + 1, dtype=bool)
    starts_word[whole] = kinds[whole] < len(NAMES) - 1
    shifted = lambda a: np.concatenate([np.zeros(overlap, dtype=bool), a])[: n + 1]
    extra = np.where(shifted(starts_word), 0.0, SPLIT_START)
    border_before = np.maximum.accumulate(np.where(whole, np.arange(n + 1), 0))
    room = limit
    while room > 2 * overlap + 4:
        exact, cuts = True, None
        for exact, places in ((True, kinds < len(NAMES) - 1), (True, True), (False, True)):  # inside words only where no other cuts keep within room
            cuts = cut_positions(n, kinds, whole & places & (shifted(whole) | (not exact)), room if exact else room - 4, overlap, extra)
            if cuts is not None:
                break
        if cuts is None:
            break
        edges = [0, *cuts, n]
        pieces = []
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            first = int(border_before[a - overlap]) if k else 0
            pieces.append((int(char_at[first]), int(char_at[b]), b - first, NAMES[kinds[b]] if b < n else "end"))
        # between a sign and white space a pattern cuts anyway: such a piece has the tokens counted already
        over = max(0 if tokenizer.kind == "tiktoken" and _parted(text, s) and _parted(text, e) else tokenizer.count(text[s:e]) - limit for s, e, _, _ in pieces)
        if over <= 0:
            return pieces
        room -= max(over, 8)
    raise ValueError(f"a text of {n} tokens cannot be cut into pieces of {limit} that overlap by {overlap}")


def split_documents(df: DataFrame, id_col: str, text: str = "text", limit: int = MAX_TOKENS, overlap: int = OVERLAP, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(id, piece, pieces, start_char, end_char, tokens, cut, piece_text): the pieces of every distinct (id, text).

    Texts within limit come out as one piece, empty ones as one empty piece, null ones not at all. Texts that hold no
    more bytes than limit need no tokens counted to be known as short. Other columns are not carried over. Limits that
    leave no room beside the overlap raise ValueError.
    """
    check_limits(limit, overlap)

    @F.pandas_udf("array<struct<start_char:int,end_char:int,tokens:int,cut:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load(tokenizer)
        for batch in batches:
            yield batch.map(lambda x: [dict(zip(("start_char", "end_char", "tokens", "cut"), p)) for p in split_text(x, t, limit, overlap)])

    rows = df.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).where("__text is not null")
    cut = distinct_over(rows).withColumn("p", run.asNondeterministic()("__text"))
    each = cut.select("__id", "__text", F.size("p").alias("pieces"), F.posexplode("p").alias("piece", "c"))
    return each.select(F.col("__id").alias(id_col), "piece", "pieces", "c.start_char", "c.end_char", "c.tokens", "c.cut", F.substring(F.col("__text"), F.col("c.start_char") + 1, F.col("c.end_char") - F.col("c.start_char")).alias("piece_text"))


def oversized(df: DataFrame, id_col: str, text: str = "text", limit: int = MAX_TOKENS, overlap: int = OVERLAP, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Pieces of the documents over the limit only. Texts of at most limit bytes are left out before Python sees them."""
    return split_documents(df.where(F.octet_length(text) > limit), id_col, text, limit, overlap, tokenizer).where("pieces > 1")
