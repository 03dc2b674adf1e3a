"""Column expressions for text used by many operators; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() and \s take for white space.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The public WordPunct tokenizer: runs of word characters (Unicode letters, numbers, underscore) and of other non-space characters.
WORDPUNCT = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]+"


def strip(c: Column) -> Column:
    """Without white space of any Unicode kind at either end."""
    return F.regexp_replace(F.regexp_replace(c, f"^[{SPACE}]+", ""), f"[{SPACE}]+$", "")


def missing(c: Column) -> Column:
    """NULL, empty, blank or the word null in any letter case; never NULL itself."""
    return c.isNull() | c.rlike(f"^[{SPACE}]*(?i:null)?[{SPACE}]*$")


def present(c: Column) -> Column:
    return ~missing(c)


def key(c: Column) -> Column:
    """Ids and split names as they are compared: lower case and trimmed; missing ones become NULL."""
    return F.when(present(c), F.lower(strip(c)))


def wordpunct_count(c: Column) -> Column:
    """Tokens of the public WordPunct tokenizer; 0 for NULL."""
    return F.coalesce(F.regexp_count(c, F.lit(WORDPUNCT)), F.lit(0)).cast("long")
