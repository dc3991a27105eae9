"""Queries p1 and p7 to p10 over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import leaks, markup, mixture, pieces, sentences
from linkloom.llm.sql import oracle_sql  # noqa: F401
from linkloom.session import read_table, spread


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Where the sentences of every article end: (page_id, end_char)."""
    return sentences.sentences(read_table(spark, d, "articles_3"), "page_id").select("page_id", "end_char").distinct()


def p1_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every article, one row each."""
    return sentences.sentences(read_table(spark, d, "articles_3"), "page_id").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of markup of each document, by its source's style tree: (doc_id, markup_kind)."""
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text", "source").where("text <> ''"))
    return markup.found_kinds(docs, "doc_id", site=_site())


def _site() -> F.Column:
    return mixture.source_reading(F.col("source"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every document."""
    return markup.clean(read_table(spark, d, "documents"), "doc_id", site=_site()).select("doc_id", "clean", "dropped")


def p7_style_tree(spark: SparkSession, d: str) -> DataFrame:
    """The elements of each source's merged page trees, with the entropies of their looks and contents."""
    tree = markup.style_tree(markup.page_nodes(read_table(spark, d, "documents"), "doc_id", "text", F.coalesce(_site(), F.lit(""))), "doc_id")
    return tree.withColumns({c: F.round(c, 6) for c in ("presentation", "content", "importance")})


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(read_table(spark, d, "documents"), "doc_id", leaks.passages(read_table(spark, d, "eval_items"), "item_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with 12 or more words in a row of an item: (doc_id, item_id)."""
    return _leaks(spark, d).where(F.col("words") >= leaks.MIN_WORDS).select("doc_id", "item_id")


def p8_regions(spark: SparkSession, d: str) -> DataFrame:
    """All near matches, with the characters aligned and the words in a row."""
    return _leaks(spark, d)


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Longer documents are likelier to be drawn: their inclusion odds grow with the logarithm of their length."""
    docs = read_table(spark, d, "documents")
    return mixture.mixture(docs, read_table(spark, d, "source_weights"), "doc_id", weight=F.log2(F.char_length("text") + 2.0))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: (doc_id, source, tokens, copies)."""
    return _mixture(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mixture(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of more than 2,000 tokens: (doc_id)."""
    return pieces.oversized(read_table(spark, d, "documents"), "doc_id").select("doc_id").distinct()


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of these documents."""
    return pieces.oversized(read_table(spark, d, "documents"), "doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_sentences, p7_found, p7_clean, p7_style_tree, p8_found, p8_regions, p9_mixture, p9_shares, p10_found, p10_pieces)}
