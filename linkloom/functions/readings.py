"""How titles and aliases are read: Unicode form, white space, marks and case. All expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode and Python's str.split see it.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def _compose(c: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))


def nfc(c: Column) -> Column:
    """Unicode NFC. Text whose code points all lie below U+0300 is its own NFC and is passed on; null stays null."""
    return F.when(c.isNotNull() & c.rlike(r"[^\x00-\u02ff]"), _compose(c)).otherwise(c)


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


# Signs that every reading leaves as they are: visible, in NFC with whatever stands beside them, no mark of a part or space.
_PLAIN = r"[!-\"$-^`-~\u00a1-\u02ff\u2010-\u2027]+"
#: Plain words with single spaces between them. Most names are, and need no further look.
PLAIN = rf"^{_PLAIN}(?: {_PLAIN})*\z"


def title_reading(c: Column) -> Column:
    """NFC; cut at the first '#'; underscores are spaces; one space for a run, trimmed; first character in upper case."""
    return F.when(c.rlike(PLAIN), _capital(c)).otherwise(_full_title_reading(c))


def _capital(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def _full_title_reading(c: Column) -> Column:
    s = F.trim(F.regexp_replace(F.regexp_replace(nfc(c), r"(?s)#.*$", ""), r"(?U)[\s_\x1c-\x1f]+", " "))
    return _capital(s)


def alias_reading(c: Column) -> Column:
    """NFC; one space for a run, trimmed; one final 's, ’s, ' or ’ cut off; trimmed again; null where nothing is left."""
    s = F.trim(F.regexp_replace(F.when(c.rlike(PLAIN), c).otherwise(squeeze(nfc(c))), "['’]s?$", ""))
    return F.nullif(s, F.lit(""))


def text_reading(c: Column) -> Column:
    """NFC with white space squeezed: two texts of one reading are copies."""
    return squeeze(nfc(c))


# The same readings for DuckDB, used by the oracle queries. Its regular expressions know ASCII \s only.
SQL_SPACE = r"\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({c}), '[{SQL_SPACE}]+', ' ', 'g'))"


def sql_title(c: str) -> str:
    s = f"trim(regexp_replace(regexp_replace(nfc_normalize({c}), '#(.|\\n)*$', ''), '[_{SQL_SPACE}]+', ' ', 'g'))"
    return f"(upper(substr({s}, 1, 1)) || substr({s}, 2))"


def sql_alias(c: str) -> str:
    return f"nullif(trim(regexp_replace({sql_squeeze(c)}, '[''’]s?$', '')), '')"
