"""Character classes with the same meaning in Java, RE2 and Python regular expressions, and line handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python takes as white space, word characters and decimal digits.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


#: The characters of SPACE and, but for the pair of carriage return and line feed, of LINE_END.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_ENDS = "".join(map(chr, [0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]))


def strip(c: Column) -> Column:
    """``c`` without white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def lines(c: Column) -> Column:
    """The lines of a text; a line end at the very end opens no further line, and an empty text has none."""
    plain = F.translate(F.replace(c, F.lit("\r\n"), F.lit("\n")), LINE_ENDS, "\n" * len(LINE_ENDS))
    return let(F.split(plain, "\n"), without_last_blank)


def without_last_blank(a: Column) -> Column:
    """The lines of the joined ``a``: a blank one at its end is none."""
    return F.when(F.try_element_at(a, F.lit(-1)) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)


def word_count(c: Column) -> Column:
    """How many white-space separated words a text has."""
    return F.regexp_count(F.translate(c, SPACES, " " * len(SPACES)), F.lit("[^ ]+"))


def words(c: Column) -> Column:
    """The white-space separated words of a text."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where it is used inside the function of an array expression."""
    return F.transform(F.array(value), body)[0]
