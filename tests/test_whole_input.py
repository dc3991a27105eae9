"""Queries read the whole input: brute force over all rows of the smallest tables."""

import hashlib
import math
import os
from collections import defaultdict

import pytest

from linkloom.plans import reference_queries as q
from linkloom.session import scratch_root

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_every_vector_is_a_candidate(spark):
    rows = [(r["vec_id"], r["label"], [float(x) for x in r["embedding"]]) for r in q.read_table(spark, DATA, "embeddings").collect()]
    want = {}
    for m, label, v in rows:
        if m % 100 == 0:
            scores = {w: sum(a * b for a, b in zip(v, u)) for w, k, u in rows if k == label}
            top = max(scores.values())
            e = {w: math.exp(s - top) for w, s in scores.items()}
            want |= {(m, w): x / sum(e.values()) for w, x in e.items()}
    got = {(r["mention_id"], r["wid"]): r["posterior"] for r in q.entity_posterior_softmax(spark, DATA).collect()}
    assert max(w for _, w in got) >= 200
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    losses = [-math.log(max(p, 1e-12)) for p in want.values()]
    loss = q.posterior_loss(spark, DATA).first()
    assert loss["n"] == len(want) and abs(loss["loss"] - sum(losses) / len(losses)) < 2e-6
    right = sum(max((p, -w) for (m, w), p in want.items() if m == mention)[1] == -mention for mention in {m for m, _ in want} if mention % 75)
    assert {r["kind"]: r["correct"] for r in q.linking_accuracy(spark, DATA).collect()}["context"] == right > 0


def test_every_item_finds_its_vector(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in q.read_table(spark, DATA, "embeddings").collect()}
    bags = defaultdict(set)
    for r in q.read_table(spark, DATA, "events").collect():
        bags[r["user_id"]].add(math.floor(r["value"]))
    got = {(r["user_id"], r["d"]): r["value"] for r in q.coherence_relu(spark, DATA).collect()}
    want = {(u, d): max(sum(float(vectors[i][d]) for i in items if i in vectors), 0.0) for u, items in bags.items() if items & vectors.keys() for d in range(64)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_words_of_every_script(spark, tmp_path):
    rows = [(1, "T", "Größe: l’été 3_x."), (2, "T", "東京 は"), (3, "T", "हिन्दी भाषा"), (4, "T", "Мир، مرحبا"), (5, "T", "ภาษาไทย"), (6, "T", "a B a")]
    spark.createDataFrame(rows, "doc_id long, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {r["doc_id"]: r["out"] for r in q.queries()["word_count"](spark, str(tmp_path)).collect()}
    assert counts == {1: 7, 2: 2, 3: 2, 4: 3, 5: 1, 6: 3}
    bags = {r["doc_id"]: r["bag"] for r in q.document_bag(spark, str(tmp_path)).collect()}
    assert bags == {1: "größe l x été", 2: "は 東京", 3: "भाषा हिन्दी", 4: "мир مرحبا", 5: "ภาษาไทย", 6: "a b"}


def test_contexts_of_every_annotation(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "[[Ann Lee|Ann|annotation]] met新[[東京|DATE]]都."), (2, f"É.\n{long} [[B|b c|annotation]] {long} Ende"), (3, "none")]
    spark.createDataFrame(rows, "file_id long, text string").write.parquet(f"{tmp_path}/final_articles.parquet")
    got = {(r["file_id"], r["line_no"], r["pos"]): (r["left"].split(), r["right"].split()) for r in q.token_contexts(spark, str(tmp_path)).collect()}
    words = long.split()
    left, right = [*words, "b", "c"], ["Ende", *reversed(words), "c", "b"]

    def full(part, whole):
        return [*part, *["_"] * (len(whole) - len(part))]

    assert got == {
        (1, 0, 0): (full(["Ann"], left), full([".", "都", "東京", "met新", "Ann"], right)),
        (1, 0, 1): (full(["Ann", "met新", "東京"], left), full([".", "都", "東京"], right)),
        (2, 1, 0): (left, right),
    }


@pytest.fixture
def files(spark, tmp_path):
    """Writes final_articles beside empty or given tables of the link queries."""

    def write(rows, ids=(), aliases=(), redirects=()):
        save = lambda name, rows, schema: spark.createDataFrame(list(rows), schema).write.parquet(f"{tmp_path}/{name}.parquet")
        save("final_articles", rows, "file_id long, page_id long, title string, text string, article_names array<string>")
        save("title2id", ids, "title string, title_id long")
        save("aliases", aliases, "alias string, entity string, n long")
        save("redirect", redirects, "source string, target string, kind string, seen_at timestamp")
        return str(tmp_path)

    return write


def test_every_file_is_annotated(spark, files):
    d = files([
        (1, 10, "T", "[[Ann|Ann|annotation]] one. Cyd Moor", ["Ann"]), (2, 10, "T", "[[Ann|Ann|annotation]] two. Cyd Moor", ["Ann"]), (3, None, "T", "[[Ann|Ann|annotation]] and Cyd Moor", ["Ann"]),
        (4, 20, "Ann", "x", ["Cyd Moor"]),
    ], [("T", 10), ("Ann", 20), ("Cyd Moor", 30)])
    got = {(r["file_id"], r["entity"], r["tag"]) for r in q.baseline_rounds(spark, d).collect()}
    assert got == {(1, "Ann", "ANCHOR"), (2, "Ann", "ANCHOR"), (3, "Ann", "ANCHOR"), (1, "Cyd Moor", "SECOND"), (2, "Cyd Moor", "SECOND")}


def test_cascade_reads_lines_and_page_ids(spark, files):
    people = ["A (footballer)", "B (footballer)"]
    texts = [
        (2, 500, "T", "[[x|Sam|non_person_coref]] ran.\n[[x|Berlin|non_person_coref]] and [[x|Sam|non_person_coref]].", []), (8, 501, "U", "[[x|Berlin|non_person_coref]] [[Berlin|Berlin|annotation]]", []),
        (4, 502, "V", "[[x|Berlin|non_person_coref]].\n[[Berlin|Berlin|annotation]]", []), (5, 20, people[0], "x", ["T", "T"]), (6, 30, people[1], "x", ["T"]), (7, None, "W", "[[x|Sam|non_person_coref]]", []),
    ]
    pages = [("T", 500), (people[0], 20), (people[1], 30), ("Berlin", 40), *[(f"P{i}", 100 + i) for i in range(60)]]
    uses = [("Sam", people[0], 3), ("Sam", people[1], 4), ("Berlin", "Berlin", 2), *[(f"P{i}", f"P{i}", 9) for i in range(60)]]
    d = files(texts, pages, uses)
    got = {(r["file_id"], r["line_no"], r["start"]): (r["resolved"], r["final_tag"]) for r in q.candidate_cascade(spark, d).collect()}
    best = (people[0], "alias_match_best_links")  # links to page 500, which file 2 holds
    assert got[2, 0, 0] == got[2, 1, 11] == best
    assert got[2, 1, 0] == ("Berlin", "alias_match_popular_entity")  # rank 61 of the entities
    assert got[7, 0, 0] == ("###".join(people), "alias_match_multiple_candidates")
    assert got[8, 0, 0] == ("Berlin", "alias_match_match_candidate")
    assert got[4, 0, 0] == ("Berlin", "alias_match_popular_entity")  # its link stands in a later line


def test_pages_get_only_names_they_may_hold(spark, files):
    names = [[f"Q{hashlib.md5(b'%d %d' % (i, k)).hexdigest()} Quarter" for k in range(200)] for i in range(300)]
    texts = [f"[[Town{i}|the town|annotation]] and {own[i % 200]}, ½ {own[-1]} [[Other]]\n{own[7]}." for i, own in enumerate(names)]
    towns = [(f"Town{i}", i) for i in range(300)]
    d = files([(i, i, "T", t, ["Town"]) for i, t in enumerate(texts)], towns, [(a, f"Town{i}", 3) for i, own in enumerate(names) for a in own] + [("+ and", "Town1", 2)])
    root = scratch_root(spark).removeprefix("file://")
    used = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, fs in os.walk(root) for f in fs)
    before = used()
    got = {(r["file_id"], r["line_no"], r["alias"]) for r in q.line_mentions(spark, d).where("tag = 'alias_match'").collect()}
    assert got == {(i, *x) for i, own in enumerate(names) for x in ((0, own[i % 200]), (0, own[-1]), (1, own[7]))}
    assert used() - before < 3 << 20  # all names once, not once more with the pages


def test_a_page_is_not_annotated_through_a_whole_family(spark, files):
    titles = [f"Treaty of Town{i:04d}" for i in range(2000)]
    texts = [(i, i, f"P{i}", f"[[Hub|Hub|annotation]] signed the {titles[i]}.", ["Hub"]) for i in range(300)]
    d = files([*texts, (900, 900, "Hub", "x", titles)], [("Hub", 900), *((t, 1000 + i) for i, t in enumerate(titles)), *((f"P{i}", i) for i in range(300))])
    root = scratch_root(spark).removeprefix("file://")
    used = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, fs in os.walk(root) for f in fs)
    before = used()
    got = {(r["file_id"], r["entity"], r["tag"]) for r in q.baseline_rounds(spark, d).collect()}
    assert got == {(i, *x) for i in range(300) for x in (("Hub", "ANCHOR"), (titles[i], "SECOND"))}
    assert used() - before < 1 << 20  # pages with the titles of all treaties take more
