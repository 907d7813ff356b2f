"""Fuzzy skill pairs: Ratcliff-Obershelp ratio of at least 0.85, on distinct names.

The ratio is 2M/T for M matched of T characters in both names. At 0.85 or more, at most
u = 3T/20 characters stay unmatched, so the match consists of at most u + 1 runs, each
shifted by at most u places. Working this out for every T: the names are equal, or the
longest run has at least three characters, but for T = 7, 9 and 14 only at least two. So names
are joined on (gram, position), which is exact and leaves few pairs for the ratio itself.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skills import similarity

MIN_RATIO = 0.85


def _grams(name: Column, n: int, last: Column) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(last - n, F.lit(0)))
    grams = F.transform(
        starts, lambda i: F.struct(F.substring(name, i + 1, F.lit(n)).alias("gram"), i.alias("at"))
    )
    return F.filter(grams, lambda g: F.length(g.gram) == n)


def _placed(names: DataFrame, column: str) -> DataFrame:
    name = F.col(column)
    size = F.length(name)
    short = F.when(size <= 8, _grams(name, 2, size)).otherwise(
        F.array().cast("array<struct<gram:string,at:int>>")
    )
    return names.select(
        column, F.inline(F.concat(_grams(name, 3, size), short))
    )


def fuzzy_pairs(jd_skills: DataFrame, cand_skills: DataFrame) -> DataFrame:
    """``jd_skill, cand_skill, ratio`` over two tables of distinct lower-cased names."""
    a, b = F.length("jd_skill"), F.length("cand_skill")
    longest = F.floor(a * 23 / 17)
    reach = F.floor((a + longest) * 3 / 20).cast("int")
    left = (
        _placed(jd_skills, "jd_skill")
        .withColumn("at", F.explode(F.transform(F.sequence(-reach, reach), lambda d: F.col("at") + d)))
        .filter("at >= 0")
    )
    near = (F.abs(a - b) * 20 <= (a + b) * 3) & (F.col("jd_skill") != F.col("cand_skill"))
    gram_fits = (F.length("gram") == 3) | (a + b).isin(7, 9, 14)
    return (
        left.join(_placed(cand_skills, "cand_skill"), ["gram", "at"])
        .filter(near & gram_fits)
        .select("jd_skill", "cand_skill")
        .distinct()
        # The edit distance never exceeds the unmatched characters.
        .filter(F.levenshtein("jd_skill", "cand_skill") * 20 <= (a + b) * 3)
        .withColumn("ratio", similarity("jd_skill", "cand_skill"))
        .filter(F.col("ratio") >= MIN_RATIO)
    )
