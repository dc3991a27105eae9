"""Functions under their SQL names, the viewer by title, and the choice by context."""

from pyspark.sql import functions as F

from linkloom.functions import markup as m
from linkloom.functions import sql, viewer
from linkloom.operators import linker


TEXTS = ["'''A''' met [[B|bee]] {{cn}} in\n== [[C]] ==\n:note\nend", "<gallery>x</gallery> [http://a.b c] Ann's ", "12.5", "it's", ""]


def test_functions_in_sql(spark):
    names = sql.register(spark, "t_")
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    df.createOrReplaceTempView("texts")
    for name in sql.EXPRESSIONS:
        got = [r[0] for r in spark.sql(f"select t_{name}(t) from texts").collect()]
        assert got == [r[0] for r in df.select(getattr(m, name)(F.col("t"))).collect()], name
    for name, core in sql.REWRITERS.items():
        assert [r[0] for r in spark.sql(f"select t_{name}(t) from texts").collect()] == [core(t) for t in TEXTS], name
    assert len(names) == len(sql.EXPRESSIONS) + len(sql.REWRITERS)


def test_page_by_title(spark):
    lines = spark.createDataFrame([(1, 0, "[[A|a|annotation]]"), (2, 0, "x")], "page_id long, line_no int, text string")
    titles = spark.createDataFrame([(1, "One"), (2, "Two")], "page_id long, title string")
    ids = spark.createDataFrame([("A", 7)], "title string, page_id long")
    got = viewer.page_by_title(lines, titles, ids, "One").collect()
    assert [r["page_id"] for r in got] == [1] and "curid=7" in got[0]["html"]
    assert viewer.page_by_title(lines, titles, ids, "None").count() == 0


def test_choice_by_context_and_fallback(spark):
    mentions = spark.createDataFrame([("m1", "Lee", "Ann Lee###Lee (river)", ["the", "water", "of", "Lee"]), ("m2", "Lee", "Ann Lee###Lee (river)", ["Lee", "paints"]), ("m3", "Bo", "X###Y", ["Bo"])], "key string, alias string, candidates string, context array<string>")
    counts = spark.createDataFrame([("Lee", "Ann Lee", 3), ("Lee", "Lee (river)", 2), ("Bo", "Y", 1)], "alias string, entity string, n long")
    words = spark.createDataFrame([("water", [0.0, 9.0]), ("paints", [9.0, 0.0]), ("unk", [0.0, 0.0])], "word string, vector array<double>")
    entities = spark.createDataFrame([("Ann Lee", [1.0, 0.0]), ("Lee (river)", [0.0, 1.0])], "entity string, vector array<double>")
    chosen = linker.context_choice(mentions, counts, words, entities, "key")
    assert {r["key"]: r["entity"] for r in chosen.collect()} == {"m1": "Lee (river)", "m2": "Ann Lee"}
    both = linker.with_fallback(mentions, chosen, linker.greedy_choice(mentions, counts, "key"), "key")
    assert {r["key"]: r["entity"] for r in both.collect()} == {"m1": "Lee (river)", "m2": "Ann Lee", "m3": "Y"}
