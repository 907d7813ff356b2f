"""Skill names: synonym expansion, canonical form, fuzzy ratio."""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import SYNONYMS
from .text import stripped


def closure(synonyms=None) -> dict[str, list[str]]:
    """One-hop expansion of every term that is a key or a synonym, itself included.

    A term takes every entry it occurs in, as key or as synonym: not transitive.
    """
    synonyms = SYNONYMS if synonyms is None else synonyms
    groups = [[key, *others] for key, others in synonyms.items()]
    terms = sorted({term for group in groups for term in group})
    return {t: sorted({x for group in groups if t in group for x in group}) for t in terms}


def _lookup(table: dict) -> Column:
    cells = []
    for key, value in table.items():
        cells.append(F.lit(key))
        cells.append(F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value))
    return F.create_map(*cells)


def expand(skills: Column, synonyms=None) -> Column:
    """Sorted set of the lower-cased, trimmed skills and all their synonyms."""
    table = closure(synonyms)
    lookup = _lookup(table) if table else None
    clean = F.transform(
        F.filter(F.coalesce(skills, F.array().cast("array<string>")), lambda s: s.isNotNull()),
        lambda s: stripped(F.lower(s)),
    )
    if lookup is None:
        return F.sort_array(F.array_distinct(clean))
    # Few skills have synonyms: look up those only.
    known = F.array_intersect(clean, F.array(*[F.lit(t) for t in table]))
    groups = F.flatten(F.transform(known, lambda s: F.element_at(lookup, s)))
    return F.sort_array(F.array_union(clean, groups))


def canonical(skill: Column, synonyms=None) -> Column:
    """Lower, trim, drop dots and blanks; a key then becomes its first synonym."""
    synonyms = SYNONYMS if synonyms is None else synonyms
    bare = F.regexp_replace(stripped(F.lower(skill)), "[. ]", "")
    first = _lookup({key: others[0] for key, others in synonyms.items()})
    return F.coalesce(F.try_element_at(first, bare), bare)


@F.pandas_udf(T.DoubleType())
def similarity(jd_skill: pd.Series, cand_skill: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; the argument order matters."""
    return pd.Series(
        [SequenceMatcher(None, a, b).ratio() for a, b in zip(jd_skill, cand_skill)],
        dtype="float64",
    )
