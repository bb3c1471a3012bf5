"""Whitespace handling that follows Python's ``str.strip``/``split``/``splitlines``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# every character for which str.isspace() holds
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"  # the same set as a class the regex engine tests fast
# where str.splitlines() breaks
LINE_BREAK = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Whitespace-separated words; a blank text gives ``[""]``, so test for blanks apart."""
    return F.split(strip(text), SPACE_RUN)


def word_count(text: Column) -> Column:
    stripped = strip(text)
    return F.when(stripped == "", F.lit(0)).otherwise(F.size(F.split(stripped, SPACE_RUN)))


def lines(text: Column) -> Column:
    return F.split(strip(text), LINE_BREAK)
