"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    """Without leading and trailing blanks of any kind; looks at the two ends only."""
    return F.btrim(text, F.lit(_BLANKS))


def strip_long(text: Column) -> Column:
    """`strip` for long texts. Trimming an end goes through all characters, so a text whose last byte is plain ASCII is trimmed at its start only."""
    last = F.substring(text.cast("binary"), -1, 1)
    plain_end = (last > F.lit(b"\x20")) & (last < F.lit(b"\x7f"))
    return F.when(plain_end, F.ltrim(text, F.lit(_BLANKS))).otherwise(F.btrim(text, F.lit(_BLANKS)))


def folded(text: Column) -> Column:
    """Lower case, with the four letters that match an ASCII letter when case is ignored.

    Translating goes through all characters one by one, so plain ASCII, of as many bytes as characters, is spared it.
    """
    plain = F.octet_length(text) == F.length(text)
    return F.lower(F.when(plain, text).otherwise(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk")))


def contains_any(text: Column, needles: list[str]) -> Column:
    first, *others = [text.contains(needle) for needle in needles]
    for other in others:
        first = first | other
    return first


def lines_of(text: Column) -> Column:
    """Split on newline only; a carriage return stays in its line."""
    return F.split(text, "\n")


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    without = F.replace(text, F.lit(needle), F.lit(""))
    return ((F.length(text) - F.length(without)) / len(needle)).cast("int")


def extension(path: Column) -> Column:
    """Text after the last dot of the whole path, empty when there is no dot."""
    return F.regexp_extract(path, r"\.([^.]*)\z", 1)


def stem(path: Column) -> Column:
    """Base name without its last extension."""
    base = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.regexp_replace(base, r"\.[^.]*\z", "")


def ratio4(count: Column, total: Column) -> Column:
    """``count / total`` rounded to four places from its exact binary value, ties to even.

    Decimal rounding of the shortest printed form goes wrong where the quotient prints as a tie but
    is a little above or below it, so ties are decided by the exact remainder ``ratio * total -
    count``, taken in two halves that both fit a double.
    """
    n, m = count.cast("bigint"), total.cast("bigint")
    doubled = n * 20000 + m
    up = F.floor(doubled / (m * 2))
    up = F.when(up * m * 2 > doubled, up - 1).otherwise(up)
    ratio = n.cast("double") / m.cast("double")
    high = ratio * 134217729.0 - (ratio * 134217729.0 - ratio)
    rest = (high * m - n) + (ratio - high) * m
    below = (rest < 0) | ((rest == 0) & (up % 2 == 1))
    tie = doubled % (m * 2) == 0
    return F.when(tie & below, up - 1).otherwise(up).cast("double") / 10000.0


def percent(share: Column) -> Column:
    """Whole per cent of a share, ties to even."""
    return F.bround(share * 100.0, 0).cast("int")
