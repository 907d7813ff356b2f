"""Text predicates shared by the scans."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, also where ``use`` holds a lambda."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def has_any(text: Column, terms) -> Column:
    """True if any literal term is a substring of ``text``."""
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def word_pattern(term: Column) -> Column:
    """Regex matching ``term`` as a whole word: no letter or digit on either side."""
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), term, F.lit(r"\E(?![\p{L}\p{N}])"))


def term_found(text: Column, term: Column, mode: str = "substring") -> Column:
    if mode == "substring":
        return F.contains(text, term)
    if mode == "word":
        return F.regexp_like(text, word_pattern(F.trim(term)))
    raise ValueError(f"mode must be 'substring' or 'word', not {mode!r}")


def anywhere(location: Column) -> Column:
    """A lower-cased job location that takes candidates from everywhere.

    Substring rule: "germany" holds "any" and counts.
    """
    return has_any(location, ["remote", "any"])


def either_contains(a: Column, b: Column) -> Column:
    """Containment in either direction; the empty string is contained in every string."""
    return F.contains(a, b) | F.contains(b, a)


def lowered(skills: Column) -> Column:
    """Lower-cased array without nulls; a null array is empty."""
    return F.transform(
        F.filter(F.coalesce(skills, F.array().cast("array<string>")), lambda s: s.isNotNull()),
        F.lower,
    )


def present(*parts: Column) -> Column:
    """Array of the non-null parts."""
    return F.array_compact(F.array(*parts))


def lacks_any(text: Column, terms) -> Column:
    return ~has_any(text, terms)


def stripped(text: Column) -> Column:
    """Without white space at either end: tabs and line ends as well as blanks."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"))
