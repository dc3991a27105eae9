"""Oracle SQL of the queries of this subpackage. None of them can be said in SQL over whole texts: sentence tagging,
markup parsing, alignment and tokenizers are tested against brute force and exact round trips instead."""


def oracle_sql() -> dict[str, str]:
    return {}
