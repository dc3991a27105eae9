"""Penalties decide between kinds of cuts: an uneven cut at a line loses to an even one at a sentence. Limits, overlaps
and vocabularies at their borders."""

import os
import random

import pytest

from linkloom.llm import pieces
from linkloom.llm.tokens import DEFAULT_TOKENIZER, load


def test_even_sentence_beats_uneven_line():
    sentence = "The old mill stands by the river now. "
    got = pieces.split_text(sentence * 10 + "\n" + sentence * 2, load(DEFAULT_TOKENIZER), 100, 5)
    assert [p[3] for p in got] == ["sentence", "end"]
    assert max(p[2] for p in got) < 70


@pytest.mark.parametrize("limit, overlap", [(100, 60), (100, 50), (10, 5), (100, -1)])
def test_impossible_limits_are_refused(spark, limit, overlap):
    with pytest.raises(ValueError, match="overlap"):
        pieces.split_text("one two three " * 200, load(DEFAULT_TOKENIZER), limit, overlap)
    with pytest.raises(ValueError, match="overlap"):
        pieces.split_documents(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "doc_id", limit=limit, overlap=overlap)


@pytest.mark.parametrize("text", ["\U00013000" * 900, "\U0001F98A" * 700, "\u1b05" * 500 + " " + "\u1b05" * 500, "a\u0300" * 900])
def test_characters_of_several_tokens(text):
    t = load(DEFAULT_TOKENIZER)
    out = pieces.split_text(text, t, 100, 7)
    assert out[0][0] == 0 and out[-1][1] == len(text) and len(out) > 1
    assert all(t.count(text[a:b]) <= 100 for a, b, *_ in out)
    for (_, end, *_), (start, *_) in zip(out, out[1:]):
        assert 7 <= t.count(text[start:end]) <= 11


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"])
def test_other_vocabularies(name):
    path = os.path.join(os.path.dirname(DEFAULT_TOKENIZER), name)
    if not os.path.exists(path):
        pytest.skip("no such vocabulary here")
    t, rng = load(path), random.Random(3)
    words = ["town", "h\u00e9llo", "\u0e19\u0e35\u0e48", "\u6771\u4eac", "\U0001F600\U0001F44D\U0001F3FD", "\U00013000", "river", "Gr\u00f6\u00dfe"]
    text = " ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(900))
    out = pieces.split_text(text, t, 200, 20)
    assert out[0][0] == 0 and out[-1][1] == len(text) and len(out) > 5
    for (a, b, n, _), (c, d, m, _) in zip(out, out[1:]):
        assert a < c < b < d
    assert all(t.count(text[a:b]) <= 200 for a, b, *_ in out)
    if name == "byte_bpe_50k.json":
        assert out == pieces.split_text(text, load(DEFAULT_TOKENIZER), 200, 20)


def test_levels_give_the_result_of_all_boundaries(monkeypatch):
    import numpy as np

    rng = random.Random(11)
    for _ in range(60):
        n, limit, over = rng.randrange(120, 400), 60, 6
        kinds = np.array([rng.choices(range(6), [1, 2, 4, 8, 40, 45])[0] for _ in range(n + 1)])
        allowed = np.array([rng.random() < 0.8 for _ in range(n + 1)])
        extra = np.array([rng.choice([0.0, 1.5]) for _ in range(n + 1)])
        weight = np.array([pieces.PENALTIES[k] for k in pieces.NAMES])[kinds] + extra
        count = 1 + -(-(n - limit) // (limit - over))
        share = (n + (count - 1) * over) / count
        at = np.flatnonzero(allowed[:n])
        best, cuts = pieces._program(n, at[at > over], weight, share, limit, over)
        got = pieces.cut_positions(n, kinds, allowed, limit, over, extra)
        assert (got is None) == (cuts is None)
        if got is not None:
            edges = [0, *got, n]
            cost = sum(weight[c] for c in got) + sum(6.0 * ((b - a + (over if k else 0) - share) / share) ** 2 for k, (a, b) in enumerate(zip(edges, edges[1:])))
            assert abs(cost - best) < 1e-9
