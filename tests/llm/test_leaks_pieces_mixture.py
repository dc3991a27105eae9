"""Leak search against brute force, pieces as exact round trips, mixtures against their targets."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import leaks, mixture, pieces
from linkloom.llm.tokens import DEFAULT_TOKENIZER, load

needs_vocabulary = pytest.mark.skipif(not os.path.exists(DEFAULT_TOKENIZER), reason="no vocabulary files here")


def _words(rng, n):
    return ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def _planted(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(_words(rng, rng.randrange(5, 80)))) for i in range(30)]
    docs = []
    for k in range(200):
        text = _words(rng, rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            w = items[rng.randrange(30)][1].split()
            n = rng.randrange(4, 30)
            a = rng.randrange(max(1, len(w) - n))
            part = w[a : a + n]
            if rng.random() < 0.3:
                part = [f"'''{x}'''" if rng.random() < 0.2 else x.upper() for x in part]
            if rng.random() < 0.3:
                part = [x[:1] + "\u200b" + x[1:] for x in part]
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((k, rng.choice([" ", "  ", "\n", ", "]).join(text)))
    return items, docs


def _brute(items, docs, n):
    grams = defaultdict(set)
    for i, t in items:
        w = leaks.words(t)
        for k in range(len(w) - n + 1):
            grams[tuple(w[k : k + n])].add(i)
    return {(d, i) for d, t in docs for s in map(str.split, leaks.streams(t or "")) for k in range(len(s) - n + 1) for i in grams.get(tuple(s[k : k + n]), ())}


@pytest.mark.parametrize("seed", range(3))
def test_leaks_against_brute_force(seed):
    items, docs = _planted(seed)
    index = leaks.Items(items)
    got = {(d, i) for (d, _), found in zip(docs, leaks.find([leaks.streams(t) for _, t in docs], index)) for i, _, w in found if w >= 12}
    assert got == _brute(items, docs, 12)


def test_near_matches_within_the_budget():
    w = "the quick brown foxes jumped over seventeen lazy dogs beside nine quiet rivers yesterday evening".split()
    index = leaks.Items([(7, " ".join(w))])
    changed = " ".join(w[:7] + ["laxy"] + w[8:])
    assert [(i, run) for i, _, run in leaks.find([leaks.streams(changed)], index)[0]] == [(7, 7)]
    assert leaks.find([leaks.streams("nothing of it"), [], None], index) == [[], [], []]


def test_repetitive_documents_stay_small():
    """A 40 KB document of twelve words against 300 such items: bounded memory, and all that brute force finds."""
    import tracemalloc

    rng = random.Random(1)
    vocabulary = "river mountain bridge town old market lake valley castle harbour road church".split()
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(350))) for i in range(300)]
    doc = " ".join(rng.choice(vocabulary) for _ in range(6_600))
    doc += " " + " ".join(items[7][1].split()[40:60])
    index = leaks.Items(items)
    tracemalloc.start()
    found = leaks.find([leaks.streams(doc)], index)[0]
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert {(0, i) for i, _, w in found if w >= 12} == _brute(items, [(0, doc)], 12)


@pytest.mark.parametrize("pairs", [50, 3_000])
def test_tiles_change_nothing(monkeypatch, pairs):
    items, docs = _planted(4)
    texts = [leaks.streams(t) for _, t in docs]
    want = leaks.find(texts, leaks.Items(items))
    monkeypatch.setattr(leaks, "PAIRS_AT_ONCE", pairs)
    got = leaks.find(texts, leaks.Items(items))
    assert [{(i, w) for i, _, w in f if w >= 12} for f in got] == [{(i, w) for i, _, w in f if w >= 12} for f in want]


def test_runs_by_hashes():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(1, 60))] for _ in range(2))
        assert leaks.run_length(a, b, leaks.word_hashes(a), leaks.word_hashes(b)) == leaks.longest_run(a, b)


def test_alignment_by_itself():
    code = lambda t: np.array([ord(c) for c in t], dtype=np.uint32)
    for a, b, want in (("abcdef", "abcdef", 6), ("abcdef", "abXdef", 6), ("abcdef", "abdef", 5), ("abcdef", "abcXdef", 7), ("abc", "xyz", 0)):
        assert leaks.aligned([(code(a), code(b), 0, 0)], 1)[0] == want


def test_leak_operator(spark):
    items, docs = _planted(9)
    i = spark.createDataFrame([(k, "Do this.\n" + t) for k, t in items] + [(90, None), (91, ""), (92, "Do this.")], "item_id long, text string")
    d = spark.createDataFrame([*docs, *docs[:5], (900, None), (901, "")], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    passages = leaks.passages(i, "item_id", "text")
    for block in (16_000_000, 900):
        got = leaks.leaks(d, "doc_id", passages, block_chars=block).where("words >= 12")
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == _brute(items, docs, 12)
    assert leaks.leaks(d.limit(0), "doc_id", passages).count() == 0
    assert leaks.leaks(d, "doc_id", passages.limit(0)).count() == 0


@needs_vocabulary
@pytest.mark.parametrize("kind", ["paragraphs", "sentences", "solid", "thai", "chinese", "emoji", "spaces"])
def test_pieces_are_exact(kind):
    rng = random.Random(1)
    text = {
        "paragraphs": "\n\n".join(" ".join(_words(rng, 60)).capitalize() + "." for _ in range(60)),
        "sentences": " ".join(" ".join(_words(rng, 9)).capitalize() + "." for _ in range(400)),
        "solid": "".join(_words(rng, 2000)),
        "thai": " ".join("".join(rng.choice(["ชาว", "เมือง", "ขาย", "สะพาน", "ให้แก่", "เขา"]) for _ in range(rng.randrange(3, 9))) for _ in range(300)),
        "chinese": "运河不会再开。谁买下了桥梁？" * 250,
        "emoji": "😀👍🏽é" * 800,
        "spaces": ("a" + " " * 40 + "\n") * 900,
    }[kind]
    t = load(DEFAULT_TOKENIZER)
    out = pieces.split_text(text, t)
    assert len(out) > 1 and out[0][0] == 0 and out[-1][1] == len(text)
    ids, at = t.encode(text), 0
    for k, (a, b, n, _) in enumerate(out):
        assert n <= 2000 and t.count(text[a:b]) <= 2000
        start = at - 100 if k else 0
        assert text[a:b].encode() == b"".join(t.model.decode_single_token_bytes(x) for x in ids[start : start + n])
        at = start + n
    assert at == len(ids)
    if kind == "paragraphs":
        assert {c for *_, c in out[:-1]} == {"paragraph"}
    if kind in ("sentences", "chinese"):
        assert {c for *_, c in out[:-1]} == {"sentence"}
    if kind == "thai":
        assert {c for *_, c in out[:-1]} == {"word"}


def test_cuts_are_the_best(monkeypatch):
    from itertools import combinations

    monkeypatch.setattr(pieces, "IMBALANCE", 6.0)
    rng = random.Random(4)
    for _ in range(30):
        n, limit, over = 26, 11, 3
        kinds = np.array([rng.randrange(6) for _ in range(n + 1)])
        allowed = np.array([rng.random() < 0.7 for _ in range(n + 1)])
        count = 1 + -(-(n - limit) // (limit - over))
        share = (n + (count - 1) * over) / count
        weight = [pieces.PENALTIES[k] for k in pieces.NAMES]

        def cost(cuts, kinds=kinds, weight=weight, share=share, n=n, over=over):
            edges = [0, *cuts, n]
            out = sum(weight[kinds[c]] for c in cuts)
            return out + sum(6.0 * ((b - a + (over if k else 0) - share) / share) ** 2 for k, (a, b) in enumerate(zip(edges, edges[1:])))

        options = [c for r in range(1, 6) for c in combinations([x for x in range(over + 1, n) if allowed[x]], r) if c[0] <= limit and all(b - a <= limit - over for a, b in zip(c, [*c[1:], n]))]
        got = pieces.cut_positions(n, kinds, allowed, limit, over)
        assert (got is None) == (not options)
        if options:
            assert abs(cost(got) - min(map(cost, options))) < 1e-9


@needs_vocabulary
def test_piece_operator(spark):
    long = "word " * 5000
    df = spark.createDataFrame([(1, long), (1, long), (2, None), (3, ""), (4, "short")], "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = pieces.split_documents(df, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("t"), F.max("pieces").alias("p")).collect()
    rows = {r["doc_id"]: (r["n"], r["p"]) for r in got}
    assert rows[3] == (1, 1) and rows[4] == (1, 1) and rows[1][0] == rows[1][1] >= 3 and 2 not in rows
    assert {r["doc_id"] for r in pieces.oversized(df, "doc_id").collect()} == {1}
    assert pieces.oversized(df.limit(0), "doc_id").count() == 0


@needs_vocabulary
def test_mixture_reaches_its_shares(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(_words(rng, rng.randrange(5, 60))), rng.choice(["Big ", "big", "BIG"]) if i % 10 < 7 else rng.choice(["small", "Sm-all"]) if i % 10 < 9 else rng.choice([None, "unlisted"])) for i in range(2000)]
    docs = [(i, t, "sm_all" if s == "Sm-all" else s) for i, t, s in docs] + [(5000, None, "big"), (5001, "", "big"), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("rank", F.lit(1))
    w = spark.createDataFrame([("big", 0.4, 1), ("small", 0.3, 5), ("sm_all", 0.2, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeat int")
    mixed, report = mixture.mixture(df, w, "doc_id")
    shares = {r["source"]: r["share"] for r in report.collect()}
    assert shares["none"] == 0 and all(abs(shares[s] - t / 0.9) < 0.01 for s, t in (("big", 0.4), ("small", 0.3), ("sm_all", 0.2)))
    rows = mixed.collect()
    limits = {"big": 1, "small": 5, "sm_all": 3}
    assert all(1 <= r["copies"] <= limits[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    assert sorted(map(tuple, mixture.mixture(df.repartition(7), w, "doc_id")[0].collect())) == sorted(map(tuple, rows))
    small, _ = mixture.mixture(df, w, "doc_id", total_tokens=3000)
    assert abs(small.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] - 3000) < 200
    assert mixture.mixture(df.limit(0), w, "doc_id")[0].count() == 0
    assert mixture.mixture(df, w.limit(0), "doc_id")[0].count() == 0


@needs_vocabulary
def test_heavier_documents_are_taken_more_often(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, " ".join(_words(rng, 20)), "a", 4.0 if i % 2 else 1.0) for i in range(3000)], "doc_id long, text string, source string, weight double")
    w = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeat int")
    total = 3000 * 20
    mixed, _ = mixture.mixture(df, w, "doc_id", weight=F.col("weight"), total_tokens=total)
    odd = mixed.where("doc_id % 2 = 1").count() / mixed.count()
    assert 0.7 < odd < 0.88


def test_queries_run(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    from linkloom.llm import queries

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, f in queries.queries().items():
        if name == "p7_clean":
            assert f(spark, data).count() == docs.count()
        else:
            assert not f(spark, data).isEmpty(), name
    items = [(r["item_id"], r["text"].split("\n", 1)[1]) for r in spark.read.parquet(f"{data}/eval_items.parquet").collect()]
    rows = queries.p9_shares(spark, data).collect()
    assert abs(sum(r["share"] for r in rows) - 1) < 1e-9 and all(r["copies"] <= r["documents"] * r["max_repeat"] for r in rows)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.p8_found(spark, data).collect()} == _brute(items, docs, 12)
