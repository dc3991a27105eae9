"""Golden cases of routing, dictionaries, mentions, cascade, coreference, linking, rival annotator, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from linkloom.functions import viewer
from linkloom.langpack import PACKS
from linkloom.operators import baseline, cascade, coref, dictionary, linker, mentions, metrics, routing, spans
from linkloom.sources import dump, sinks

XML = """<mediawiki><page><title>Paris</title><ns>0</ns><id>1</id><revision><id>9</id><contributor><id>77</id></contributor>
<text xml:space="preserve">A [[B|c]]</text></revision></page>
<page><title>Paname</title><ns>0</ns><id>2</id><redirect title="Paris"/><revision><id>10</id><text>#REDIRECT [[Paris]]</text></revision></page></mediawiki>"""


def test_dump(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML)
    pages = dump.read_dump(spark, str(tmp_path / "d.xml"))
    assert {(r["title"], r["page_id"]) for r in dump.title_ids(pages).collect()} == {("Paris", 1), ("Paname", 2)}
    assert [(r["source"], r["target"], r["kind"]) for r in routing.redirects(pages).collect()] == [("Paname", "Paris", "article")]
    assert pages.where("title = 'Paris'").first()["text"] == "A [[B|c]]"
    assert dump.first_pages(pages.union(pages)).count() == 2


def test_routing(spark):
    rows = [("Category:A", "category"), ("Category theory", "article"), ("List of x", "list"), ("File:x", None), ("MediaWiki:x", None), ("A", "article")]
    df = spark.createDataFrame(rows, "t string, w string")
    assert all(r["w"] == r["k"] for r in df.withColumn("k", routing.route(F.col("t"))).collect())
    assert spark.createDataFrame([("Category theory",)], "t string").select(routing.route(F.col("t"), compat=True)).first()[0] == "category"
    assert spark.createDataFrame([("{{redirect|Foo|x}}\nText",)], "t string").select(routing.hatnote_redirects(F.col("t"))).first()[0] == ["Foo"]
    assert spark.createDataFrame([("x {{Homonymie}}",)], "t string").select(routing.page_class(F.lit("X"), F.col("t"), PACKS["fr"])).first()[0] == "other"


def test_alias_merge(spark):
    df = spark.createDataFrame([("Paris's", "X", 2), (" Paris ", "X", 1), ("Paris'", "Y", 1), ("'", "Z", 1)], "alias string, entity string, n long")
    assert {(r["alias"], r["entity"], r["n"]) for r in dictionary.merge_alias_counts(df).collect()} == {("Paris", "X", 3), ("Paris", "Y", 1)}


def test_pruning(spark):
    titles = spark.createDataFrame([("Paris",), ("france",), ("City",)], "title string")
    counts = spark.createDataFrame([("Paris", "Paris", 3), ("capital", "Paris", 1), ("France", "France", 5), ("city", "City", 4)], "alias string, entity string, n long")
    pruned = dictionary.prune_aliases(counts, titles, titles.limit(0))
    named = dictionary.named_entities(pruned)
    assert {(r["alias"], r["entity"], r["n"]) for r in named.collect()} == {("Paris", "Paris", 3), ("France", "france", 5)}
    assert [(r["entity"], r["n"]) for r in dictionary.popular(named).collect()] == [("france", 5), ("Paris", 3)]


def test_acronyms_and_aliases():
    assert mentions.acronym_pairs("the World Health Organization (WHO) said") == [(4, "World Health Organization", 31, "WHO")]
    assert mentions.AliasSet(["New York City", "New York"]).find("New York City and New York") == [(0, "New York City"), (18, "New York")]
    assert mentions.AliasSet(["c++", "a.b"]).find("c++ a.b axb") == [(4, "a.b")]


def test_visible_after_first_link(spark):
    texts, found = mentions.page_mentions(["Foo met [[Foobar|Foo]]. Foo left.", "[[File:x]]", "Foo"], [], {"Foobar": ["Foo"]})
    assert texts == ["Foo met Foo. Foo left.", "", "Foo"]
    assert [(x["line_no"], x["start"], x["tag"]) for x in found] == [(0, 8, "annotation"), (0, 13, "alias_match"), (2, 0, "alias_match")]
    pages = spark.createDataFrame([(1, "T", "Foo met [[Foobar|Foo]]. Foo left."), (2, None, None)], "page_id long, title string, text string")
    counts = spark.createDataFrame([("Foo", "Foobar", 3)], "alias string, entity string, n long")
    lines = mentions.find_mentions(pages, counts, spark.createDataFrame([], "source string, target string"))
    met = lines.select("page_id", F.lit("T").alias("title"), "text", F.explode("mentions").alias("x")).select("page_id", "title", "x.*")
    assert met.count() == 2
    empty = spark.createDataFrame([], "source string, target string")
    facts = cascade.gather_facts(met, counts.withColumn("alias", F.lit("Foo")), empty, spark.createDataFrame([], "entity string, n long"), spark.createDataFrame([], "src_id long, dst_id long, n long"), spark.createDataFrame([], "title string, page_id long"), spark.createDataFrame([], "entity string"), spark.createDataFrame([], "title string"), spark.createDataFrame([], "title string"))
    got = {r["start"]: (r["resolved"], r["final_tag"]) for r in cascade.resolve(facts).collect()}
    assert got == {8: ("Foobar", "annotation"), 13: ("Foobar", "alias_match_single_candidate")}


def test_render_and_parse(spark):
    text = "Foo met [[Foobar|Foo|annotation]]. [[1999|DATE]] [[x]]"
    row = spark.createDataFrame([(text,)], "t string").select(mentions.bare_text(F.col("t")).alias("b"), mentions.annotation_spans(F.col("t")).alias("s")).first()
    assert row["b"] == "Foo met Foo. 1999 x"
    assert [(s["start"], s["entity"], s["alias"], s["tag"]) for s in row["s"]] == [(8, "Foobar", "Foo", "annotation"), (13, None, "1999", "DATE"), (18, None, "x", None)]
    lines = [("x [[a|b]] y", True), ("x [[a|DATE]] y", False), ("[[a|b|c]]", False), ("[[a [[b|c|d]]", True), ("plain", False)]
    df = spark.createDataFrame(lines, "t string, w boolean")
    assert all(r["w"] == r["m"] for r in df.withColumn("m", mentions.is_malformed(F.col("t"))).collect())
    assert spark.createDataFrame([("A b. C d. E",)], "t string").select(mentions.split_at(F.col("t"), F.array(F.lit(4), F.lit(9), F.lit(11)))).first()[0] == "A b.\nC d.\nE"


def test_ner_merge(spark):
    a = spark.createDataFrame([(1, 0, 5, "E", "Alpha", "annotation")], "page_id long, start long, end long, entity string, alias string, tag string")
    b = spark.createDataFrame([(1, 3, 8, "x", "PERSON"), (1, 5, 8, "WHO", "ORG")], "page_id long, start long, end long, alias string, tag string")
    known = spark.createDataFrame([(1, "WHO", "World Health Organization")], "page_id long, alias string, entity string")
    got = {(r["start"], r["entity"], r["tag"]) for r in mentions.merge_ner(a, b, ["page_id"], known).collect()}
    assert got == {(0, "E", "annotation"), (5, "World Health Organization", "acronym_ner")}


def test_cascade_order(spark):
    base = {"alias": "X", "tag": "alias_match", "entity": None, "previous_alias": None, "is_title": False, "title": "T", "seen_entity": None, "seen_redirect": None, "popular_entity": None, "popular_redirect": None, "candidates": None, "all_persons": None, "best_linked": None, "line_candidates": None, "human": None, "geo": None, "part_of": None}
    cases = [
        ({"alias": ""}, (None, None)),
        ({"tag": "DATE"}, (None, "DATE")),
        ({"tag": "acronym_entity"}, ("X", "acronym_entity")),
        ({"tag": "acronym", "previous_alias": "Long"}, ("Long", "acronym")),
        ({"tag": "annotation", "entity": "E"}, ("E", "annotation")),
        ({"tag": "annotation", "entity": "E", "alias": "low"}, (None, None)),
        ({"is_title": True, "seen_entity": "S"}, ("T", "alias_match_article_entity")),
        ({"seen_entity": "S", "popular_entity": "P"}, ("S", "alias_match_match_candidate")),
        ({"seen_redirect": "R", "popular_entity": "P"}, ("R", "alias_match_redirect_candidate")),
        ({"popular_redirect": "P", "candidates": ["A"]}, ("P", "alias_match_popular_redirect")),
        ({"candidates": ["A"]}, ("A", "alias_match_single_candidate")),
        ({"candidates": ["A", "B"], "all_persons": True, "best_linked": "B"}, ("B", "alias_match_best_links")),
        ({"candidates": ["A", "B"], "line_candidates": ["B"]}, ("B", "alias_match_single_line_candidate")),
        ({"candidates": ["A", "B", "C"], "line_candidates": ["A", "B"]}, ("A###B", "alias_match_multiple_line_candidates")),
        ({"candidates": ["A", "B"], "human": True}, ("A###B", "alias_match_multiple_candidates")),
        ({"human": True, "geo": True}, ("X", "alias_match_human_disambiguation")),
        ({"geo": True}, ("X", "alias_match_geo_disambiguation")),
        ({"part_of": ["Q", "R"]}, ("Q###R", "alias_match_part_of_seen_entity")),
        ({"tag": "acronym_ner", "entity": "Pre"}, ("Pre", "acronym_ner")),
    ]
    types = "i int, alias string, tag string, entity string, previous_alias string, is_title boolean, title string, seen_entity string, seen_redirect string, popular_entity string, popular_redirect string, candidates array<string>, all_persons boolean, best_linked string, line_candidates array<string>, human boolean, geo boolean, part_of array<string>"
    df = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(cases)], types)
    got = {r["i"]: (r["resolved"], r["final_tag"]) for r in cascade.resolve(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_coreference():
    state: dict = {}
    assert coref.resolve_line("[[Ann Lee|Ann Lee|annotation]] won. [[She|PERSON]] left.", state, {}, {"Ann Lee": "female"}) == "[[Ann Lee|Ann Lee|annotation]] won. [[Ann Lee|She|PERSON_coref]] left."
    assert coref.resolve_line("[[He|PERSON]] [[her|PER]]", state, {}, {}) == "[[He|PERSON]] [[Ann Lee|her|PERSON_coref]]"
    line = "[[Acme Corp|Acme|annotation]] grew; the company sold."
    assert coref.resolve_line(line, {}, {"Acme Corp": ["the company"]}, {}) == "[[Acme Corp|Acme|annotation]] grew; [[Acme Corp|the company|non_person_coref]] sold."
    assert coref.resolve_line("The company [[Acme Corp|Acme|annotation]]", {}, {"Acme Corp": ["the company"]}, {}).startswith("[[Acme Corp|the company|non_person_coref]]")


def test_greedy_and_fusion(spark):
    m = spark.createDataFrame([(1, "x", "A###B"), (2, "y", "A###B")], "key long, alias string, candidates string")
    counts = spark.createDataFrame([("x", "A", 2), ("x", "B", 5)], "alias string, entity string, n long")
    assert {r["key"]: r["entity"] for r in linker.greedy_choice(m, counts, "key").collect()} == {1: "B", 2: "A"}
    s = spark.createDataFrame([(1, "a", 0.6, 0.2), (1, "b", 0.4, 0.8)], "k int, w string, prior double, context double")
    assert {r["w"]: round(r["joint"], 6) for r in linker.fuse(s, "k").collect()} == {"a": 0.435897, "b": 0.564103}
    t = spark.createDataFrame([([0.8, 0.76, 0.1],), ([0.5, 0.6, 0.1],)], "s array<double>")
    assert [r[0] for r in t.select(linker.type_labels(F.col("s"))).collect()] == [[0, 1], [1]]
    none = linker.prior_candidates(spark.createDataFrame([(1, "foo")], "key long, surface string"), spark.createDataFrame([(1, "3"), (1, "7")], "key long, wid string"), spark.createDataFrame([], "surface string, wid string, p double"), "key", "surface")
    assert {r["wid"]: r["prior"] for r in none.collect()} == {"3": 0.5, "7": 0.5}


def test_embedding_and_contexts(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("unk", [9.0, 9.0])], "word string, vector array<double>")
    df = spark.createDataFrame([(1, ["a", "zz", "a"])], "k long, t array<string>")
    assert [r["vector"] for r in linker.embed(df, "k", "t", v).orderBy("pos").collect()] == [[1.0, 0.0], [9.0, 9.0], [1.0, 0.0]]
    c = spark.createDataFrame([(list("abcde"),)], "t array<string>").select(linker.contexts(F.col("t"), F.lit(1), F.lit(2)).alias("c"), linker.contexts(F.col("t"), F.lit(1), F.lit(2), strict=True).alias("s")).first()
    assert (c["c"]["left"], c["c"]["right"]) == (list("abc"), list("edcb"))
    assert (c["s"]["left"], c["s"]["right"]) == (["a"], list("ed"))
    soft = spark.createDataFrame([([1.0, 1.0],)], "s array<double>").select(linker.softmax(F.col("s")), linker.pad(F.col("s"), 3, F.lit(0.0))).first()
    assert soft[0] == [0.5, 0.5] and soft[1] == [1.0, 1.0, 0.0]
    known = linker.resolve_ids(spark.createDataFrame([("New York",), ("No",)], "entity string"), spark.createDataFrame([("New_York", "w1")], "title string, wid string"), spark.createDataFrame([("w1", 4)], "wid string, idx int"))
    assert [(r["wid"], r["idx"]) for r in known.collect()] == [("w1", 4)]


def test_metrics(spark):
    p = spark.createDataFrame([("1", "1", 0.5, "2", 0.5, "1", 0.0), ("<unk_wid>", "1", 1.0, "1", 1.0, "1", 1.0)], "truth string, prior string, prior_p double, context string, context_p double, joint string, joint_p double")
    assert {r["kind"]: (r["correct"], r["known"]) for r in metrics.linking_accuracy(p).collect()} == {"prior": (1, 1), "context": (0, 1), "joint": (0, 1)}
    t = spark.createDataFrame([([1, 2], [1]), ([3], [4])], "predicted array<int>, true array<int>")
    r = metrics.typing_metrics(t).first()
    assert (r["strict"], r["macro_p"], r["macro_r"], round(r["micro_p"], 4), r["micro_r"]) == (0.0, 0.25, 0.5, 0.3333, 0.5)
    assert spark.range(1).select(metrics.f1(F.lit(0.0), F.lit(0.0))).first()[0] == 0.0


def test_rival_annotator(spark):
    found = [(0, 13, "E1", "New York City", "FIRST"), (0, 8, "E2", "New York", "FIRST")]
    assert [x[2] for x in baseline.settle(found, [])] == ["E1"]
    text, done = baseline.three_rounds("[[Paris]] and Paris near Lyon", [("Paris", "Paris")], [("Lyon", "Lyon")], [])
    assert text == "Paris and Paris near Lyon" and [(x[0], x[4]) for x in done] == [(0, "ANCHOR"), (10, "FIRST"), (21, "SECOND")]
    names = ["Paris", "May", "lower", "7th", "12", "Out", "Unknown", ""]
    links = spark.createDataFrame([(1, n, n) for n in names] + [(1, "eBay", "Bay"), (1, "May", "Merry May")], "page_id long, entity string, alias string")
    known = spark.createDataFrame([(n,) for n in [*names[:6], "eBay"]], "entity string")
    kept = baseline.linkable(links, known, spark.createDataFrame([("Out",)], "entity string"))
    assert {(r["entity"], r["alias"]) for r in kept.collect()} == {("Paris", "Paris"), ("May", "Merry May")}
    pages = spark.createDataFrame([(1, "T", "[[Paris]] and Paris near Lyon")], "page_id long, title string, text string")
    counts = spark.createDataFrame([("Paris", "Paris", 2)], "alias string, entity string, n long")
    near = spark.createDataFrame([(1, "Lyon")], "page_id long, entity string")
    assert len(baseline.annotate(pages, counts, near).first()["mentions"]) == 3


def test_span_helpers(spark):
    s = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 5, 9), (1, 20, 22)], "p int, start long, end long")
    merged = spans.merge_adjacent(s, ["p"], F.col("start") == F.col("prev_end"))
    assert {(r["start"], r["end"], r["parts"]) for r in merged.collect()} == {(0, 5, 2), (5, 9, 1), (20, 22, 1)}
    assert spans.running_offset(s, ["p"], F.lit(4)).orderBy("start").select("shift").collect()[2][0] == 8


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "B b", "text b"), (2, "A/a", "text a")], "page_id long, title string, text string")
    sinks.write_pages(df, str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 2
    sinks.write_corpus(df, F.col("title"), str(tmp_path / "corpus"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "corpus").glob("*.txt")))
    assert whole == "###FILENAME### A/a\ntext a\n\n\n\n###FILENAME### B b\ntext b\n\n\n\n"
    sinks.publish(spark, str(tmp_path / "pages"), str(tmp_path / "public"))
    sinks.publish(spark, str(tmp_path / "pages"), str(tmp_path / "public"))
    assert spark.read.parquet(str(tmp_path / "public")).count() == 2
    assert sinks.archive(str(tmp_path / "corpus"), str(tmp_path / "all")).endswith("all.zip")
    assert sinks.still_to_do(df, df.where("page_id = 1"), "page_id").count() == 1
    (tmp_path / "d.json").write_text(json.dumps({"1": {"2": 3}}, indent=1))
    assert [tuple(r) for r in dump.read_counts(spark, str(tmp_path / "d.json"), "long").collect()] == [(1, 2, 3)]
    (tmp_path / "e.json").write_text(json.dumps({"a": "b"}))
    assert [tuple(r) for r in dump.read_dictionary(spark, str(tmp_path / "e.json")).collect()] == [("a", "b")]
    sub = tmp_path / "t" / "x" / "y"
    sub.mkdir(parents=True)
    (sub / "p.txt").write_text("one\ntwo")
    assert dump.read_page_files(spark, str(tmp_path / "t")).first()["text"] == "one\ntwo"
    (tmp_path / "c.json").write_text(json.dumps({"wikipath": "w", "outputpath": "o", "model": "m"}))
    assert dump.load_run_config(str(tmp_path / "c.json")).extra == (("model", "m"),)
    (tmp_path / "c.ini").write_text("[a]\nroot = /r\npath = ${root}/x\n")
    assert dump.load_paths(str(tmp_path / "c.ini"))["a.path"] == "/r/x"
    ids = spark.createDataFrame([("Foo", 5)], "title string, page_id long")
    lines = spark.createDataFrame([(1, 0, "== H =="), (1, 1, "a < b [[Foo|x|annotation]] [[Bar|y|z]] [[w|DATE]]")], "page_id long, line_no int, text string")
    html = viewer.render_page(lines, ids).first()["html"]
    assert "<h2>H</h2>" in html and '?curid=5">x</a>' in html and 'green">y</a>' in html and "a &lt; b" in html


def test_streaming(spark, tmp_path):
    from linkloom.streaming import ingest

    df = spark.createDataFrame([(1, "A", "[[B|c]] [[B|c]]", "2024-01-01 00:00:00"), (2, "File:x", "[[B]]", "2024-01-02 00:00:00")], "page_id long, title string, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.page_stream(spark, str(tmp_path / "in"), "page_id long, title string, text string, at timestamp")
    q = ingest.run_to_table(ingest.alias_counts(ingest.routed(stream)), "alias_stream", "complete", str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("alias_stream").collect()] == [("c", "B", 2)]
    q = ingest.run_to_table(ingest.revisions_per_window(stream, "at"), "window_stream", "complete", str(tmp_path / "ck2"))
    q.awaitTermination(60)
    assert spark.table("window_stream").count() == 2


@pytest.mark.parametrize("code", ["en", "fr", "es", "de"])
def test_language_packs(spark, code):
    pack = PACKS[code]
    row = spark.createDataFrame([(f"#{pack.redirect.upper()} [[Ziel_x|y]]",)], "t string").select(routing.text_redirect(F.col("t"), pack)).first()
    assert row[0] == "Ziel x"
