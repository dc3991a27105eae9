"""Markup: the marks in a page's tree, and the kinds read from the merged tree of a site."""

from pyspark.sql import functions as F

from linkloom.llm import markup as m
from linkloom.llm.queries import p7_found


def test_every_piece_of_markup_stands_in_the_tree():
    found, kinds = m.nodes('<div class="a">one [[b]] \'\'c\'\'\n\n== H $y_1$ ==\n\n* i</div></p>{{t}}\n\n| A | $x^2$ |\n|---|---|\n| a | `b` |')
    at = {(path, found[above][2] if above >= 0 else "page") for above, path, kind, _, _ in found if kind == "mark"}
    assert at == {
        ("/div.class=.a./wiki:link", "text"), ("/div.class=.a./wiki:emphasis", "text"), ("/div.class=.a./wiki:heading", "heading"), ("/div.class=.a./tex:formula", "heading"), ("/div.class=.a./line:item", "list"),
        ("/html:block", "page"), ("/wiki:template", "page"), ("/md:table", "table"), ("/tex:formula", "table"), ("/md:inlinecode", "table"),
    }
    assert kinds == {"heading", "list", "formula", "table", "other"}


def test_found_comes_through_the_merged_tree(spark, tmp_path, monkeypatch):
    rows = [(1, "== h ==\n\n'''a'''", "S"), (2, "<div>\n* i\n</div>", None), (3, "plain", "S"), (4, None, "S"), (5, "", "S"), (6, "'''b'''", "T"), (7, "$x_1$", "S")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(1, "heading"), (1, "other"), (2, "other"), (2, "list"), (6, "other"), (7, "formula")}
    assert {tuple(r) for r in p7_found(spark, str(tmp_path)).collect()} == want
    whole = m.merged
    monkeypatch.setattr(m, "merged", lambda *a: whole(*a).where("step <> 'wiki:heading'"))
    assert {tuple(r) for r in p7_found(spark, str(tmp_path)).collect()} == want - {(1, "heading")}


def test_merged_tree(spark):
    rows = [(1, "<p>a ''b''</p>", "s"), (1, "<p>a ''b''</p>", "s"), (2, "<p>c</p>", "s"), (3, "<p>''d''</p>", "t"), (4, "''e''", "s"), (None, "== h ==", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string")
    each = m.page_elements(df, "doc_id", "text", F.col("host")).select("doc_id", "site", F.explode("elements").alias("e")).select("doc_id", "site", "e.*")
    got = sorted((r["site"], r["step"], r["style_pages"]) for r in m.merged(each, "doc_id", "style", "step").collect())
    assert got == [("", "wiki:heading", 1), ("s", "p", 2), ("s", "wiki:emphasis", 1), ("s", "wiki:emphasis", 1), ("t", "p", 1), ("t", "wiki:emphasis", 1)]
    found = {tuple(r) for r in m.found_kinds(df, "doc_id", site=F.col("host")).collect()}
    assert found == {(1, "other"), (2, "other"), (3, "other"), (4, "other"), (None, "heading")}
    assert m.found_kinds(df.limit(0), "doc_id").count() == 0


def test_markup_of_shared_branches_counts(spark):
    rows = [(i, f'<div class="nav">\n== Menu ==\n</div>\n\nText {i} of its own.', "a") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string")
    assert {r["dropped"] for r in m.clean(df, "doc_id", site=F.col("host")).collect()} == {1}
    got = m.found_kinds(df, "doc_id", site=F.col("host")).groupBy("markup_kind").count().collect()
    assert {tuple(r) for r in got} == {("heading", 40), ("other", 40)}


def test_a_long_path_is_held_once():
    page = f'<div style="{"x" * 10000}">' + "\n\n".join(["a ''b''"] * 500) + "</div>"
    found, _ = m.nodes(page)
    assert len({id(path) for _, path, kind, _, _ in found if kind == "mark"}) == 1
