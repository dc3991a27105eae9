"""Markup: kinds and clean text of golden pages, plain text, the style tree, edge cases."""

import pytest
from pyspark.sql import functions as F

from linkloom.llm import markup as m

CASES = [
    ("== Head ==\ntext", {"heading"}, "## Head\n\ntext"),
    ("Head\n====\n\ntext", {"heading"}, "## Head\n\ntext"),
    ("### Head\n\ntext", {"heading"}, "### Head\n\ntext"),
    (r"\section{Head} text", {"heading"}, "## Head\n\ntext"),
    ("<h3 class='t'>Head</h3>text", {"heading"}, "### Head\n\ntext"),
    ("# item", {"list"}, "1. item"),
    ("* a\n** b", {"list"}, "- a\n\n  - b"),
    ("- a", {"list"}, "- a"),
    ("<ol><li>a</li>\n<li>b</ol>", {"list"}, "1. a\n\n1. b"),
    ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", {"list"}, "- a\n\n- b"),
    ("```py\n* x == '''y'''\n```", {"code"}, "```\n* x == '''y'''\n```"),
    ("<pre><code>a &lt; b\n# c</code></pre>", {"code"}, "```\na < b\n# c\n```"),
    ("\\begin{verbatim}\n$x$\n\\end{verbatim}", {"code"}, "```\n$x$\n```"),
    ("So $n_k = 3$ holds.", {"formula"}, "So $n_k = 3$ holds."),
    ("<math>x^2</math>", {"formula"}, "$x^2$"),
    ("\\[ x^2 \\]", {"formula"}, "$$\nx^2\n$$"),
    ("\\begin{align*}\nx &= y\n\\end{align*}", {"formula"}, "$$\nx &= y\n$$"),
    ('{| class="w"\n|-\n! A !! B\n|-\n| a || b\n|}', {"table"}, "| A | B |\n| a | b |"),
    ("| A | B |\n|---|---|\n| a | b |", {"table"}, "| A | B |\n| a | b |"),
    ("<table><tr><td>a</td><td>b</td></tr></table>", {"table"}, "| a | b |"),
    ("\\begin{tabular}{ll}\na & b \\\\\nc & d\n\\end{tabular}", {"table"}, "| a | b |\n| c | d |"),
    ("'''b''' ''i'' [[A|x]] [[y]]", {"other"}, "b i x y"),
    ("**b** *i* __u__ `c` ~~s~~ [t](/u) [r][1] [^2] ![i](/p)", {"other"}, "b i u c s t r"),
    (r"\textbf{b} {\it i} \emph{e}\cite{x}~\ref{y}\footnote{z}", {"other"}, "b i e"),
    ("a<ref>x</ref><ref name='q' />{{cn|d=1}}<!-- c -->b", {"other"}, "ab"),
    ('<p>a<br/>b &amp; c&nbsp;d</p>', {"other"}, "a\nb & c d"),
    ('a <span style="x"\n id="y">b</span>', {"other"}, "a b"),
    ("\\documentclass{article}\n\\begin{document}\na\n\\end{document}", {"other"}, "a"),
]
PLAIN = [
    "The yard measured 5 * 3 * 2 metres.", "Seats cost $20 to $30, and a box $45.", "The C# edition, as a < b and b > c.", "The scale 1 = 51 = worst was used.", "~37 degrees (or <22)", "The tag reads X [sic] in it.",
    "A^B and the word \\ORVAND\\ in relief.", "page_one_two.txt", "Lot #29 went to A & Sons for 78.", "On 3.5. the mill reopened [see X, ch. 5].", "«Est-il ouvert ?» — 50% de 34/5", "", "a\n\nb  c", "—¿Qué? —dijo",
]


@pytest.mark.parametrize(("text", "kinds", "clean"), CASES)
def test_golden(text, kinds, clean):
    got, found = m.clean_text(text)
    assert found == kinds and got == clean


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_is_left_alone(text):
    assert m.clean_text(text) == (text, set())


def test_clean_text_is_stable():
    for text, _, _ in CASES:
        once, _ = m.clean_text(text)
        again, _ = m.clean_text(once)
        assert again.split() == once.split() or "```" in once or "|" in once or "$" in once


def test_operator_edge_cases(spark):
    rows = [(1, "'''a'''", "s"), (1, "'''a'''", "s"), (2, None, "s"), (3, "", None), (4, "plain", None), (None, "== h ==", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, nodes string")
    got = {r["doc_id"]: r["clean"] for r in m.clean(df, "doc_id", site=F.col("nodes")).collect()}
    assert got == {1: "a", 2: None, 3: "", 4: "plain", None: "## h"}
    assert m.clean(df.limit(0), "doc_id").count() == 0
    kinds = df.select("doc_id", m.markup_kinds(F.col("text")).alias("k")).collect()
    assert {r["doc_id"]: r["k"] for r in kinds} == {1: ["other"], 2: [], 3: [], 4: [], None: ["heading"]}


def test_shared_branches_are_pruned(spark):
    rows = [(i, f'<div class="nav">Home | About</div>\n\n<p>Text {i} of its own.</p>', "a") for i in range(40)] + [(100 + i, '<div class="nav">Home | About</div>', "b") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string")
    got = {r["doc_id"]: r["clean"] for r in m.clean(df, "doc_id", site=F.col("host")).collect()}
    assert got[5] == "Text 5 of its own." and got[101] == "Home | About"
    tree = {(r["site"], r["style"]): r["importance"] for r in m.style_tree(m.page_nodes(df, "doc_id", "text", F.col("host")), "doc_id").where("site = 'a' and style like '%nav%'").collect()}
    assert len(tree) == 1 and min(tree.values()) < 1e-9


def test_nested_markup_to_any_depth():
    deep = "x"
    for _ in range(60):
        deep = "{{a|" + deep + "}}"
    assert m.clean_text("one " + deep + " two")[0].split() == ["one", "two"]
    wrapped = "x"
    for _ in range(12):
        wrapped = r"\textbf{" + wrapped + "}"
    assert m.clean_text(wrapped)[0] == "x"


def test_page_tree():
    tree, kinds = m.nodes('<div class="a"><p>one</p><p>two<div>three</div></div> four <section>five')
    assert kinds == {"other"}
    assert [(above, path, kind, body) for above, path, kind, body, _ in tree] == [
        (-1, "/div.class=.a.", "tag", ""), (0, "/div.class=.a./p", "tag", ""), (1, "/div.class=.a./p", "text", "one"), (0, "/div.class=.a./p", "tag", ""), (3, "/div.class=.a./p", "text", "two"),
        (0, "/div.class=.a./div", "tag", ""), (5, "/div.class=.a./div", "text", "three"), (-1, "", "text", "four"), (-1, "/section", "tag", ""), (8, "/section", "text", "five"),
    ]
    assert tree[0][4] == "p,div" and tree[8][4] == "text"
    assert len(m.nodes("<div>" * 500 + "x")[0]) == m.MAX_DEPTH + 1


def test_branches_that_differ_a_little_are_pruned(spark):
    page = '<div class="top"><div class="menu">Home</div><div class="menu">About</div><p>Contact</p><p>Help</p><p>Page {0}</p></div><article><p>Text {0} of its own.</p><p>More on {0}.</p></article><footer>All rights</footer>'
    rows = [(i, page.format(i), "a") for i in range(40)] + [(100 + i, page.format(i), "b") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string")
    got = {r["doc_id"]: (r["clean"], r["dropped"]) for r in m.clean(df, "doc_id", site=F.col("host")).collect()}
    assert got[7] == ("Text 7 of its own.\n\nMore on 7.", 6)
    assert got[101][1] == 0 and "Home" in got[101][0]
    tree = {(r["site"], r["style"]): r for r in m.style_tree(m.page_nodes(df, "doc_id", "text", F.col("host")), "doc_id").collect()}
    assert tree["a", "/article/p"]["importance"] == 1 and tree["a", "/footer"]["importance"] < 1e-9
    p = tree["a", "/div.class=.top./p"]
    assert p["style_pages"] == 40 and p["contents"] == 42 and abs(p["content"] - 40 / 120) < 1e-9
    top = tree["a", "/div.class=.top."]
    assert abs(top["importance"] - 0.9 * (p["importance"] * 40 / 80)) < 1e-9
