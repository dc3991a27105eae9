"""Golden cases of the markup functions."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import markup as m
from linkloom.functions import readings, rewriting
from linkloom.langpack import PACKS


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("o")).first()["o"]


def test_links(spark):
    got = one(spark, r"A [[B|c]] [[D]] [[E [[F|g|h]] i]]", m.links)
    assert [(x["entity"], x["alias"]) for x in got] == [("B", "c"), ("D", "D"), ("F", "g|h")]
    assert [x["entity"] for x in one(spark, "[[a [1] b|c]]", lambda c: m.links(c, m.LINK_WITH_BRACKETS))] == ["a [1] b"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (m.drop_notes, ":indent\nkeep", "keep"),
        (m.cut_sections, "Body\n== See also ==\nx", "Body\n"),
        (m.drop_categories, "a[[Category:X|key]]b[[Category:Y]]", "ab"),
        (m.drop_external_links, "see [http://x.y label here] end", "see  end"),
        (m.clean_text, "a&nbsp;b<ref name=x>r</ref> ''it''  c ( )", 'a b "it" c'),
        (m.clean_text, "x <!-- a > b --> y<math>z</math>\n\n\n\nn\n[[fr:Autre]]", "x y\n\nn"),
        (m.surface_key, "Éa-B 9", "eab9"),
        (m.page_path, "A/B Test!", "a/a_/a_b/A_B_Test!.txt"),
        (m.page_path, "É", "_/__/___/É.txt"),
        (m.unlink, "a [[B|c|d]] [[e]]", "a d e"),
        (m.flatten_headers, "== [[A|b]] ==\n[[A|b]]", "== b ==\n[[A|b]]"),
        (m.drop_galleries, "a<Gallery>x\ny</gallery>b", "ab"),
        (m.drop_infobox_prefix, "junk {{Infobox a}} b", "{{Infobox a}} b"),
        (m.drop_files, "a[[File:x|[[b]] c]]d[[image:y]]", "ad"),
        (m.drop_simple_tables, "a{|x{|y|}z|}b", "ab"),
        (m.month_name, "12", "December"),
        (m.month_name, "1", "January"),
        (lambda c: m.month_name(c, compat=True), "12", "January"),
        (m.month_name, "sept", "September"),
        (m.alias_trim, " Paris's ", "Paris"),
        (m.alias_trim, "'", None),
        (m.intro, "a == b ==", "a "),
        (readings.title_reading, " école__x  y#z", "École x y"),
        (readings.alias_reading, " a  b’s", "a b"),
        (readings.alias_reading, "'s", None),
    ],
)
def test_golden(spark, f, text, want):
    assert one(spark, text, f) == want


def test_nulls_stay_null(spark):
    for f in (m.clean_text, m.surface_key, m.page_path, m.month_name, readings.title_reading, readings.alias_reading, rewriting.rewrite_templates_column):
        assert one(spark, None, f) in (None, "")


def test_labels_and_categories(spark):
    assert one(spark, "see [http://x.y label here] end", m.external_labels) == ["label here"]
    assert one(spark, "a[[Category:X|key]]b[[Category:Y]]", m.categories) == ["X", "Y"]


def test_own_links(spark):
    df = spark.createDataFrame([("[[A (b)|x]] y [[A (b)]] [[C]]", "A (b)")], "t string, n string")
    assert df.select(m.drop_own_links(F.col("t"), F.col("n"))).first()[0] == "x y A (b) [[C]]"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{{convert|5|km|mi}}", "5 km"),
        ("{{convert|3|-|5|km}}", "3-5 km"),
        ("{{convert|3}}", ""),
        ("{{lang|fr|Bonjour}}", "Bonjour"),
        ("{{quote|Hi|x}}", '"Hi"'),
        ("{{foo|bar}}", ""),
        ("{{a|{{lang|de|Haus}}}}", ""),
        ("{{as of|2010|3|5}}", "As of 5 March 2010"),
        ("{{as of|2010|3|5|df=US}}", "As of March 5, 2010"),
        ("{{as of|2010|12|lc=y}}", "as of December 2010"),
        ("{{as of|2010|since=y}}", "Since 2010"),
        ("{{as of|2010|alt=then}}", "then"),
        ("a{{snd}}b", "a - b"),
        ("x {{lang|fr|[[A|b]]}} y", "x [[A|b]] y"),
        ("a {{b} {{c|d}} }} e", "a  e"),
        ("{{template {x} }} {{open", "{{template {x} }} {{open"),
    ],
)
def test_templates(text, want):
    assert rewriting.rewrite_templates(text) == want


def test_templates_compat_and_languages():
    assert rewriting.rewrite_templates("{{as of|2010|12|lc=y}}", compat=True) == "as of January 2010"
    assert rewriting.rewrite_templates("{{zitat|Hi}} {{einheitenumrechnung|5|km}}", PACKS["de"]) == '"Hi" 5 km'


def test_nested_files_tables_bold_punctuation():
    assert rewriting.drop_files("a[[File:x|[[b|[[c]]]] d]]e\n[[File:open [[x]]\nf") == "ae\n\nf"
    assert rewriting.drop_tables("a{|x{|y{|z|}|}|}b{|c") == "ab{|c"
    assert rewriting.link_bold_mentions("'''Paris''' is '''x'''\n'''y'''", "Paris") == "[[Paris|Paris]] is [[Paris|x]]\n'''y'''"
    assert rewriting.link_bold_mentions("[['''Foo''']] x", "Paris") == "[[Foo]] x"
    assert rewriting.repair_punctuation("a (; b), c ,,, d ( )") == "a (b), c, d "
    for text in ("(a,,, , ,b", "((;;))", "x ,,,, y (,)"):
        assert rewriting.repair_punctuation(rewriting.repair_punctuation(text)) == rewriting.repair_punctuation(text)


def test_dates(spark):
    got = one(spark, "Le 5 mars 1999, mars 2001, 1er mai, hier, lundi, 2020-01-02", lambda c: m.temporal_expressions(c, "fr"))
    assert [(x["kind"], x["year"], x["month"], x["day"]) for x in got] == [("date", 1999, 3, 5), ("month_year", 2001, 3, None), ("day_month", None, 5, 1), ("relative", None, None, -1), ("weekday", None, None, None), ("iso", 2020, 1, 2)]
    got = one(spark, "Am 3. Oktober 1990, übermorgen", lambda c: m.temporal_expressions(c, "de"))
    assert [(x["kind"], x["year"], x["month"], x["day"]) for x in got] == [("date", 1990, 10, 3), ("relative", None, None, 2)]
