"""Stage 3 writes one sentence a line where sentence ends are supplied."""

from linkloom.plans.pipeline import Corpus, Supplied

TEXT = "[[Ann Lee|Ann]] met [[Paris]]. It rained in [[Paris]]. End"
DUMP = "<mediawiki>" + "".join(
    f"<page><title>{t}</title><ns>0</ns><id>{n}</id><revision><id>{n + 900}</id><text>{x}</text></revision></page>" for n, t, x in ((1, "Ann Lee", TEXT), (2, "Paris", "'''Paris''' is a city. [[Ann Lee|Ann]] left.\n\nOther [[Ann Lee|Ann]]."))
) + "</mediawiki>"


def test_sentences(spark, tmp_path):
    (tmp_path / "dump.xml").write_text(DUMP)
    ends = [(1, 0, 14), (1, 0, 34), (1, 0, 38)]  # of "Ann met Paris. It rained in Paris. End"
    corpus = Corpus(spark, str(tmp_path / "run"), supplied=Supplied(sentence_end=spark.createDataFrame(ends, "page_id long, line_no int, end_char int")))
    texts = {r["title"]: r["text"].split("\n") for r in corpus.run(str(tmp_path / "dump.xml")).collect()}
    lines = {(r["page_id"], r["line_no"]): r["text"] for r in corpus.table("annotated_line").where("page_id = 1").collect()}
    paris = "[[Paris|Paris|annotation]]"
    assert [x.count(paris) for x in texts["Ann Lee"]] == [1, 1, 0]
    assert texts["Ann Lee"][0].endswith(f"met {paris}.") and texts["Ann Lee"][1:] == [f"It rained in {paris}.", "End"]
    assert sorted(lines) == [(1, 0), (1, 1), (1, 2)]
    assert texts["Paris"][0].endswith("left.") and " is a city. " in texts["Paris"][0]
