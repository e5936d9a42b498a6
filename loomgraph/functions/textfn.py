"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(x: str | Column) -> Column:
    """Case-folded, with everything but Latin and Cyrillic letters, digits and underscores deleted (dots too)."""
    return F.regexp_replace(F.replace(F.lower(_c(x)), F.lit("ß"), F.lit("ss")), "[^0-9a-zа-яё_]+", "")


def last_segment(x: str | Column, by: str = ".") -> Column:
    return F.substring_index(_c(x), by, -1)


def first_segment(x: str | Column, by: str = ".") -> Column:
    return F.substring_index(_c(x), by, 1)


def capitalized(x: str | Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(_c(x), 1, 1)), F.expr("''") if x is None else _c(x).substr(F.lit(2), F.length(_c(x))))


def words(x: str | Column) -> Column:
    """Runs of Latin or Cyrillic letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit("([0-9a-zа-яё_]+)"), 1)


def slug(x: str | Column, most_words: int = 7, most_chars: int = 80, default: str = "question") -> Column:
    short = F.substring(F.array_join(F.slice(words(x), 1, most_words), "-"), 1, most_chars)
    return F.when(F.length(short) > 0, short).otherwise(F.lit(default))


def stem(x: str | Column, suffixes: list[str], least: int = 4) -> Column:
    """x without the longest of the suffixes that leaves at least `least` characters."""
    x, out = _c(x), None
    for s in sorted(suffixes, key=lambda s: (-len(s), s)):
        hit = x.endswith(s) & (F.length(x) >= least + len(s))
        cut = x.substr(F.lit(1), F.length(x) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(x)


def ngrams(items: Column, n: int) -> Column:
    """Runs of n neighbours joined by spaces; none if there are fewer."""
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), " "))


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def holds_lowered(x: str | Column, term: str) -> Column:
    """Whether x holds the term, both in lower case, whatever their script."""
    return F.lower(_c(x)).contains(F.lower(F.lit(term)))


def like_ascii(x: str | Column, term: str) -> Column:
    """Contains, with % and _ of the term as wildcards; upper and lower case differ for letters beyond ASCII only."""
    return ascii_lower(_c(x)).like("%" + "".join(c.lower() if c.isascii() else c for c in term) + "%")


def display_name(owner: str | Column, name: str | Column) -> Column:
    return F.concat_ws(".", _c(owner), F.coalesce(_c(name), F.lit("<module>")))


def first_marker(x: str | Column, markers: dict[str, str]) -> Column:
    """The kind of the marker word that stands first; null without one."""
    found = F.regexp_extract(F.lower(_c(x)), "(?U)\\b(" + "|".join(markers) + ")\\b", 1)
    out = None
    for word, kind in markers.items():
        out = F.when(found == word, F.lit(kind)) if out is None else out.when(found == word, F.lit(kind))
    return out
