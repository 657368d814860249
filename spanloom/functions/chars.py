"""Character semantics: offsets are code points, classes are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
ALNUM = r"[\p{L}\p{N}]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def has_alnum(c: Column) -> Column:
    """Whether a letter or digit occurs."""
    return c.rlike(ALNUM)


def trimmed(c: Column) -> Column:
    """``c`` without white space at its ends, of every Unicode kind."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def casefolded(c: Column) -> Column:
    """``c`` in lower case with ß as ss, which upper and lower alone leave apart."""
    low = F.translate(F.lower(c), "ςſ", "σs")
    for letter, out in (("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        low = F.replace(low, F.lit(letter), F.lit(out))
    return low


def normalized(c: Column) -> Column:
    """Case folded, white space collapsed and trimmed: the key for duplicates."""
    return F.trim(F.regexp_replace(casefolded(c), rf"{SPACE}+", " "))


def characters(c: Column) -> Column:
    """The characters of ``c``, one array element each; empty for an empty text."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` in code points."""
    return F.substring(text, start + 1, end - start)
