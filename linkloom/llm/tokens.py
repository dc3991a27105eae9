"""Token counts and token borders by a public tokenizer's vocabulary file, whose path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary file used where none is named.
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how texts are split before byte pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    """encode(text) gives ids; borders(text) the byte positions in UTF-8 at which tokens end."""

    def __init__(self, path: str):
        self.kind = path.rsplit(".", 1)[-1]
        if self.kind == "tiktoken":
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            for token, rank in ranks.items():
                self.lengths[rank] = len(token)
            self.model = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        elif self.kind == "json":
            import tokenizers

            self.model = tokenizers.Tokenizer.from_file(path)
            self.model.encode_special_tokens = True
        elif self.kind == "model":
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            raise ValueError(f"{path}: a .tiktoken, .json or .model file is needed")

    def encode(self, text: str) -> list[int]:
        if self.kind == "tiktoken":
            return self.model.encode_ordinary(text)
        if self.kind == "json":
            return self.model.encode(text, add_special_tokens=False).ids
        return self.model.encode(text, num_threads=1)

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def borders(self, text: str) -> np.ndarray:
        """Byte positions at which tokens end. A token that ends inside a character, or shares its end with the next, has
        the position of a byte inside that character. White space that a vocabulary drops belongs to the token after it;
        at the end of the text it belongs to the last one."""
        if not text:
            return np.zeros(0, dtype=np.int64)
        if self.kind == "tiktoken":
            return np.cumsum(self.lengths[self.encode(text)])
        if self.kind == "json":
            spans = self.model.encode(text, add_special_tokens=False).offsets
            widths = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            at = np.concatenate([[0], np.cumsum(1 + (widths > 0x7F) + (widths > 0x7FF) + (widths > 0xFFFF))])
            begins, ends = (at[np.array([s[k] for s in spans], dtype=np.int64)] for k in (0, 1))
        else:
            pieces = self.model.encode(text, return_type="proto").pieces
            begins, ends = (np.array([getattr(p, k) for p in pieces], dtype=np.int64) for k in ("begin", "end"))
        ends = np.maximum.accumulate(ends)
        if len(ends):
            inside = np.append((begins[1:] < ends[:-1]) | (ends[1:] <= ends[:-1]), False)
            ends = ends - inside
            ends[-1] = len(text.encode("utf-8", "surrogatepass"))
        return ends


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


def token_count(texts: Column, tokenizer: str = DEFAULT_TOKENIZER) -> Column:
    """Number of tokens of each whole text; null for null."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load(tokenizer)
        for batch in batches:
            yield pd.Series([t.count(x) if isinstance(x, str) else None for x in batch], dtype="Int64")

    return run(texts)
