"""A small dump through all stages, and two annotators compared."""

from pyspark.sql import functions as F

from linkloom.operators import evaluation, linker
from linkloom.plans.pipeline import Corpus, Supplied


def page(n, title, text, redirect=None):
    red = f'<redirect title="{redirect}"/>' if redirect else ""
    return f"<page><title>{title}</title><ns>0</ns><id>{n}</id>{red}<revision><id>{n + 900}</id><text>{text}</text></revision></page>"


DUMP = "<mediawiki>" + "".join(
    [
        page(1, "Ann Lee", "'''Ann Lee''' is a painter. She lives in [[Paris]].\n\n== See also ==\nx"),
        page(2, "Paris", "'''Paris''' is a city{{cn}}. [[Ann Lee|Ann Lee]] met [[Acme Corp|Acme]]. Acme grew; the company sold. In [[Paris]] it rained."),
        page(3, "Acme Corp", "[[Acme Corp|Acme]] is in [[Paname|Paris]]. [[Ann Lee|Ann Lee]] likes [[Paris]]."),
        page(4, "Paname", "#REDIRECT [[Paris]]", "Paris"),
        page(5, "Category:Cities", "text"),
        page(6, "List of cities", "* [[Paris]]\n* [[Acme Corp|Acme]]"),
        page(7, "Lee", "{{hndis}}\n* [[Ann Lee]], painter"),
        page(8, "File:x.png", "no article"),
    ]
) + "</mediawiki>"


def test_pipeline(spark, tmp_path):
    (tmp_path / "dump.xml").write_text(DUMP)
    supplied = Supplied(
        persons=spark.createDataFrame([("Ann Lee",)], "entity string"),
        corefs=spark.createDataFrame([("Acme Corp", "the company")], "entity string, coref string"),
        genders=spark.createDataFrame([("Ann", "female")], "name string, gender string"),
        ner=spark.createDataFrame([(1, 0, 22, 25, "She", "PERSON")], "page_id long, line_no int, start long, end long, alias string, tag string"),
    )
    corpus = Corpus(spark, str(tmp_path / "run"), supplied=supplied)
    texts = {r["title"]: r["text"] for r in corpus.run(str(tmp_path / "dump.xml")).collect()}
    assert set(texts) == {"Ann Lee", "Paris", "Acme Corp"}
    assert texts["Ann Lee"] == "[[Ann Lee|Ann Lee|annotation]] is a painter. [[Ann Lee|She|PERSON_coref]] lives in [[Paris|Paris|annotation]]."
    assert "[[Acme Corp|Acme|annotation]]" in texts["Paris"] and "[[Acme Corp|the company|non_person_coref]]" in texts["Paris"]
    assert "[[Acme Corp|Acme|alias_match" in texts["Paris"]
    assert {(r["alias"], r["entity"]) for r in corpus.table("alias_count").collect()} >= {("Paris", "Paris"), ("Acme", "Acme Corp")}
    assert {r["title"] for r in corpus.table("disambiguation").collect()} == {"Lee"}
    again = {r["title"]: r["text"] for r in Corpus(spark, str(tmp_path / "run")).run(str(tmp_path / "dump.xml")).collect()}
    assert again == texts


def test_side_by_side(spark):
    left = spark.createDataFrame([("T", "[[A|Foo|alias_match]] [[A|bar|alias_match]] met [[B|Baz|annotation]].\nEnd\n== H ==\nrest"), ("U", "x")], "title string, text string")
    right = spark.createDataFrame([("T", "[[A|Foo bar|FIRST]] met [[C|Baz|SECOND]].\nEnd"), ("U", "y")], "title string, text string")
    pairs = evaluation.comparable(left, right)
    assert [r["title"] for r in pairs.collect()] == ["T"]
    joined = evaluation.side_by_side(pairs)
    assert {(r["l_start"], r["l_end"], r["r_start"], r["r_end"]) for r in joined.collect()} == {(0, 7, 0, 7), (None, None, 12, 15)}
    assert tuple(evaluation.agreement(joined).first()) == (1, 0, 1)


def test_token_mentions(spark):
    df = spark.createDataFrame([("He met [[Ann Lee|Ann Lee|annotation]] in [[1999|DATE]].",)], "t string")
    got = df.select(linker.token_mentions(F.col("t")).alias("m")).first()["m"]
    assert [(x["token_start"], x["token_len"], x["char_start"]) for x in got] == [(2, 2, 7), (5, 1, 18)]
    toks = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    assert toks.select(linker.bracket_mention(F.col("t"), 1, 1)).first()[0] == ["a", "[[", "b", "]]", "c"]
    lines = spark.range(5000).select(F.col("id").alias("line_no"))
    assert linker.first_lines(lines).count() == 3001
