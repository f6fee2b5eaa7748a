"""White space at the ends of values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: the characters that count as white space in Unicode text, with the four ASCII separators
WHITE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
         "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column | str) -> Column:
    """``c`` without white space at either end; Spark's trim takes the plain space only."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE))


def is_blank(c: Column | str) -> Column:
    """Is ``c`` empty or white space alone? Looked at from one end, up to the first other character."""
    return F.ltrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE)) == ""
