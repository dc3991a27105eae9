"""The text functions under names for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from linkloom.functions import rewriting

#: Functions of one text that are expressions: SQL functions, which the optimizer writes out where they are called.
EXPRESSIONS: dict[str, tuple[str, str]] = {
    "drop_notes": (r"regexp_replace(__text, r'(?m)^:.*\n?', '')", "string"),
    "drop_galleries": (r"regexp_replace(__text, r'(?is)<gallery.*?</gallery>', '')", "string"),
    "drop_external_links": (r"regexp_replace(__text, r'\[\w+://[^\]\n]*\]', '')", "string"),
    "drop_tags": (r"regexp_replace(__text, r'(?s)<.*?>', '')", "string"),
    "unlink": (r"regexp_replace(__text, r'\[\[(?:[^\[\]]*\|)?([^\[\]|]*)\]\]', '$1')", "string"),
    "rejoin_lines": (r"regexp_replace(__text, r'(?<![\n=])\n(?![\n=])', ' ')", "string"),
    "intro": (r"split(__text, '==', 2)[0]", "string"),
    "alias_trim": ("nullif(regexp_replace(regexp_replace(trim(__text), \"'s$\", ''), \"'$\", ''), '')", "string"),
    "word_tokens": (r"regexp_extract_all(__text, r'(?U)\w+|[^\w\s]', 0)", "array<string>"),
    "link_bodies": (r"regexp_extract_all(__text, r'\[\[([^\[\]]*)\]\]', 1)", "array<string>"),
    "is_number": ("try_cast(__text AS DOUBLE) IS NOT NULL", "boolean"),
    "has_upper": (r"__text RLIKE r'\p{Lu}'", "boolean"),
}
#: Functions of one text that rewrite it step by step, over Arrow batches.
REWRITERS: dict[str, Callable[[str], str]] = {"rewrite_templates": rewriting.rewrite_templates, "drop_files": rewriting.drop_files, "drop_tables": rewriting.drop_tables, "repair_punctuation": rewriting.repair_punctuation}


def register(spark: SparkSession, prefix: str = "wiki_") -> list[str]:
    """Make the functions callable in SQL for this session, as prefix + name; returns the names."""
    for name, (text, kind) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(__text STRING) RETURNS {kind} RETURN {text}")
    for name, core in REWRITERS.items():
        spark.udf.register(prefix + name, rewriting.over(core))
    return [prefix + name for name in (*EXPRESSIONS, *REWRITERS)]
