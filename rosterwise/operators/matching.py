"""Deep match of discovered pairs: skills 40, experience 25, salary 20, location 15."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import is_whole, number_text, py_round1, whole_text
from ..functions.skills import expand
from ..functions.text import anywhere, either_contains
from ..session import cut_lineage
from .fuzzy import fuzzy_pairs

RAW_CANDIDATE = [
    "name", "location", "experience_years", "current_role", "skills",
    "salary_expectation_lpa", "notice_period_days", "email", "bio",
]


def _strings(column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _names(rows: DataFrame, terms: str, name: str) -> DataFrame:
    return rows.select(F.explode(terms).alias(name)).distinct()


def _near(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """``jd_terms, near``: for each set of wanted terms that has any, the similar (wanted, held) names, in order.

    Looked for among distinct names and put beside the wanted terms, so that no pair is exploded. A held name
    that is wanted itself is no leftover of any pair with these terms.
    """
    # Written by itself: the plan of the scores stays small.
    similar = cut_lineage(
        fuzzy_pairs(_names(wanted, "jd_terms", "jd_skill"), _names(held, "cand_terms", "cand_skill")).select("jd_skill", "cand_skill")
    )
    terms = wanted.select("jd_terms").distinct().select("jd_terms", F.explode("jd_terms").alias("jd_skill"))
    return cut_lineage(
        terms.join(similar.hint("merge"), "jd_skill")
        .filter(~F.array_contains("jd_terms", F.col("cand_skill")))
        .groupBy("jd_terms")
        .agg(F.sort_array(F.collect_list(F.struct("jd_skill", "cand_skill"))).alias("near"))
    )


def _overlapped(rows: DataFrame, keys) -> DataFrame:
    """Put ``direct, fuzzy, jd_rest, total`` in place of ``jd_terms, cand_terms, near``.

    Rows of one key share the fuzzy pairs of all of them.
    """
    no_pairs = F.array().cast("array<struct<jd_skill:string,cand_skill:string>>")
    held, wanted = F.col("cand_terms"), F.col("jd_terms")
    left_over = F.filter(
        "near", lambda p: F.array_contains(held, p.cand_skill) & ~F.array_contains(held, p.jd_skill)
    )
    keyed = reduce(and_, [F.col(k).isNotNull() for k in keys])
    shared = F.flatten(F.collect_list("fuzzy").over(W.partitionBy(*keys)))
    return (
        rows.withColumn("fuzzy", F.when(F.col("near").isNotNull() & keyed, left_over).otherwise(no_pairs))
        .withColumn("direct", F.sort_array(F.array_intersect(wanted, held)))
        .withColumn("jd_rest", F.array_except(wanted, "direct"))
        .withColumn("total", F.size(wanted))
        .drop("jd_terms", "cand_terms", "near")
        .withColumn("fuzzy", F.sort_array(shared))
    )


def _matched_count() -> Column:
    return F.size("direct") + F.size("fuzzy")


def _percentage() -> Column:
    return py_round1(_matched_count() / F.greatest("total", F.lit(1)) * 100)


def _overlap() -> Column:
    return F.struct(
        F.col("direct").alias("direct_matches"),
        F.col("fuzzy").alias("fuzzy_matches"),
        F.col("total").alias("total_jd_skills"),
        _matched_count().alias("matched_count"),
        _percentage().alias("match_percentage"),
        F.array_except("jd_rest", F.transform("fuzzy", lambda p: p.jd_skill)).alias(
            "unmatched_jd_skills"
        ),
    )


def semantic_overlap(pairs: DataFrame, keys, synonyms=None) -> DataFrame:
    """Put ``overlap`` in place of ``jd_skills`` in rows of ``jd_skills`` and ``cand_skills``.

    Direct matches are shared names after synonym expansion. Fuzzy matches are pairs of the
    names left over on either side. They count as pairs, so the percentage can exceed 100.
    """
    base = cut_lineage(
        pairs.withColumn("jd_terms", expand(F.col("jd_skills"), synonyms))
        .withColumn("cand_terms", expand(F.col("cand_skills"), synonyms))
        .drop("jd_skills")
    )
    rows = _overlapped(base.join(_near(base, base), "jd_terms", "left"), keys)
    return rows.withColumn("overlap", _overlap()).drop("total", "direct", "jd_rest", "fuzzy")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _gap(a: Column, b: Column) -> Column:
    """Text of the distance of two numbers, which is whole if both are."""
    return number_text(F.abs(a - b), is_whole(a, b))


def _experience():
    """Score, note, and whether the score is a whole number by rule: of whole numbers, or cut at a bound."""
    years = F.coalesce("experience_years", F.lit(0))
    wanted = F.col("job_experience")
    exact = F.coalesce(wanted["exact"], F.lit(0))
    low = F.coalesce(wanted["min"], F.lit(0))
    top = F.coalesce(wanted["max"], F.lit(0))
    high = F.when(top == 0, F.lit(10)).otherwise(top)
    off, said = F.abs(years - exact), number_text(years)
    inside = years.between(low, high)
    from_middle = F.abs(years - (low + high) / 2)
    score = (
        F.when(exact != 0, F.when(off == 0, F.lit(25.0)).otherwise(F.greatest(F.lit(0), 25 - off * 5)))
        .when(inside, 25 - from_middle / (high - low + 1) * 5)
        .when(years < low, F.greatest(F.lit(0), 25 - (low - years) * 4))
        .otherwise(F.greatest(F.lit(15), 25 - (years - high) * 2))
        .cast("double")
    )
    note = (
        F.when(
            exact != 0,
            F.when(off == 0, _text("Exact match: ", said, " years")).otherwise(
                _text(said, " yrs vs required ", number_text(exact), " yrs (diff: ", _gap(years, exact), ")")
            ),
        )
        .when(inside, _text(said, " yrs — within range ", number_text(low), "-", number_text(high)))
        .when(years < low, _text(said, " yrs — ", _gap(low, years), " yrs below minimum"))
        .otherwise(_text(said, " yrs — ", _gap(years, high), " yrs above range (overqualified)"))
    )
    whole = (
        F.when(exact != 0, (off != 0) & (is_whole(years, exact) | (off * 5 >= 25)))
        .when(inside, F.lit(False))
        .when(years < low, is_whole(years, low) | ((low - years) * 4 >= 25))
        .otherwise(is_whole(years, high) | ((years - high) * 2 >= 10))
    )
    return score, note, whole


def _salary():
    asked = F.coalesce("salary_expectation_lpa", F.lit(0))
    said = number_text(asked)
    low = F.coalesce(F.col("job_salary")["min"], F.lit(0))
    high = F.coalesce(F.col("job_salary")["max"], F.lit(100))
    over = F.when(high > 0, (asked - high) / high).otherwise(F.lit(1.0))
    score = (
        F.when(asked.between(low, high), F.lit(20.0))
        .when(asked < low, F.lit(18.0))
        .otherwise(F.greatest(F.lit(0.0), 20 - over * 20))
    )
    note = (
        F.when(asked.between(low, high), _text("₹", said, " LPA within budget ₹", number_text(low), "-", number_text(high), " LPA"))
        .when(asked < low, _text("₹", said, " LPA — under budget (good for company)"))
        .otherwise(_text("₹", said, " LPA — ", whole_text(over * 100), "% over max budget"))
    )
    return score, note


def _location():
    wanted = F.coalesce("job_location", F.lit("Any"))
    own = F.coalesce("location", F.lit(""))
    near = either_contains(F.lower(wanted), F.lower(own))
    score = F.when(anywhere(F.lower(wanted)) | near, F.lit(15.0)).otherwise(F.lit(6.0))
    note = (
        F.when(anywhere(F.lower(wanted)), F.lit("Remote/Any location — full points"))
        .when(near, _text("Exact location match: ", own))
        .otherwise(_text(own, " vs ", wanted, " — different city, assume open to relocate"))
    )
    return score, note


def _factor(score: Column, most: int, note: Column, whole=None) -> Column:
    """``label`` is the score as text; scores that are whole by rule have no decimal."""
    rounded = py_round1(score)
    label = rounded.cast("string")
    if whole is not None:
        label = F.when(whole, rounded.cast("int").cast("string")).otherwise(label)
    return F.struct(
        rounded.alias("score"),
        F.lit(most).alias("max"),
        py_round1(score / most * 100).alias("percentage"),
        note.alias("note"),
        F.concat(label, F.lit(f"/{most}")).alias("label"),
    )


def _scored(pairs: DataFrame, jobs: DataFrame, candidates: DataFrame, synonyms=None) -> DataFrame:
    """Every (job_id, candidate_id) row of ``pairs`` with its scores and what their explanation takes.

    Synonyms are looked up once per job and once per person found, not once per pair.
    """
    wanted = cut_lineage(
        jobs.select(
            "job_id",
            F.col("location").alias("job_location"),
            F.col("experience_years").alias("job_experience"),
            F.col("salary_range_lpa").alias("job_salary"),
            _strings(F.col("required_skills")).alias("required_skills"),
            expand(F.concat(_strings(F.col("required_skills")), _strings(F.col("nice_to_have"))), synonyms).alias("jd_terms"),
        )
    )
    people = candidates.select(
        "candidate_id", *[c if c in candidates.columns else F.lit(None).alias(c) for c in RAW_CANDIDATE]
    ).withColumn("cand_skills", _strings(F.col("skills"))).drop("skills")
    found = people.join(pairs.select("candidate_id").distinct(), "candidate_id", "left_semi")
    found = cut_lineage(found.withColumn("cand_terms", expand(F.col("cand_skills"), synonyms)))
    wanted = wanted.join(_near(wanted, found), "jd_terms", "left")
    rows = _overlapped(pairs.join(found, "candidate_id").join(wanted, "job_id"), ["job_id", "candidate_id"])
    total = F.col("skill_raw") + F.col("experience_raw") + F.col("salary_raw") + F.col("location_raw")
    return (
        rows.withColumn("skill_raw", _percentage() * 0.4)
        .withColumn("experience_raw", _experience()[0])
        .withColumn("salary_raw", _salary()[0])
        .withColumn("location_raw", _location()[0])
        .withColumn("match_score", py_round1(total))
    )


def _explained(rows: DataFrame, first, last=()) -> DataFrame:
    """Notes and breakdowns of rows of ``_scored``, between the columns ``first`` and ``last``."""
    _, experience_note, experience_whole = _experience()
    salary_note, location_note = _salary()[1], _location()[1]
    overlap = F.col("overlap")
    matched = F.concat(
        overlap["direct_matches"],
        F.transform(
            overlap["fuzzy_matches"],
            lambda p: F.concat(p["jd_skill"], F.lit("≈"), p["cand_skill"]),
        ),
    )
    rows = rows.withColumn("overlap", _overlap()).withColumn(
        "skill_breakdown",
        F.struct(
            "required_skills",
            F.col("cand_skills").alias("candidate_skills"),
            matched.alias("matched_skills"),
            overlap["unmatched_jd_skills"].alias("missing_skills"),
            overlap["match_percentage"].alias("semantic_match_pct"),
            F.size(overlap["fuzzy_matches"]).alias("fuzzy_matches_found"),
        ),
    )
    skills_note = _text(
        F.size("skill_breakdown.matched_skills"), " matched, ",
        F.size("skill_breakdown.missing_skills"), " missing",
    )
    rows = rows.withColumn(
        "factor_breakdown",
        F.struct(
            _factor(F.col("skill_raw"), 40, skills_note).alias("skills"),
            _factor(F.col("experience_raw"), 25, experience_note, experience_whole).alias("experience"),
            _factor(F.col("salary_raw"), 20, salary_note, F.col("salary_raw") == 0).alias("salary"),
            _factor(F.col("location_raw"), 15, location_note).alias("location"),
        ),
    )
    factors = F.col("factor_breakdown")
    explanation = F.concat_ws(
        " | ",
        *[
            _text(f"{title} ", whole_text(factors[key]["score"]), f"/{most} — ", factors[key]["note"])
            for title, key, most in [
                ("Skills", "skills", 40),
                ("Experience", "experience", 25),
                ("Salary", "salary", 20),
                ("Location", "location", 15),
            ]
        ],
    )
    return rows.select(
        *first,
        F.col("name").alias("candidate_name"),
        "match_score",
        *[
            factors[key]["score"].alias(name)
            for key, name in [
                ("skills", "skill_match_score"),
                ("experience", "experience_match_score"),
                ("salary", "salary_match_score"),
                ("location", "location_match_score"),
            ]
        ],
        explanation.alias("overall_explanation"),
        "skill_breakdown",
        "factor_breakdown",
        F.struct(
            *[F.col("cand_skills").alias(c) if c == "skills" else F.col(c) for c in RAW_CANDIDATE]
        ).alias("raw_candidate"),
        *last,
    )


def match_pairs(pairs: DataFrame, jobs: DataFrame, candidates: DataFrame, synonyms=None) -> DataFrame:
    """Score every (job_id, candidate_id) row of ``pairs``; nothing is filtered."""
    return _explained(_scored(pairs, jobs, candidates, synonyms), pairs.columns)


def best_matches(
    pairs: DataFrame, jobs: DataFrame, candidates: DataFrame, min_score: float = 45.0, top_k: int = 10, synonyms=None
) -> DataFrame:
    """``find_matches`` of ``match_pairs``; every pair is scored, those that are kept get their notes and breakdowns."""
    kept = find_matches(_scored(pairs, jobs, candidates, synonyms), min_score, top_k)
    return _explained(kept, pairs.columns, ["threshold", "match_rank"])


def find_matches(scored: DataFrame, min_score: float = 45.0, top_k: int = 10, adaptive: bool = True) -> DataFrame:
    """Threshold and best ``top_k`` per job.

    With ``adaptive``, a job with fewer than three matches at ``min_score`` (above 35) is cut at
    ten points less. Ties keep discovery order.
    """
    per_job = W.partitionBy("job_id")
    best = per_job.orderBy(F.desc("match_score"), "discovery_rank")
    # Those over a bar are the first of their job, so places hold whatever the bar. Ranked first, the rows of a job are sorted once.
    scored = scored.withColumn("match_rank", F.row_number().over(best))
    bar = F.lit(float(min_score))
    if adaptive and min_score > 35:
        passing = F.least(F.count_if(F.col("match_score") >= min_score).over(per_job), F.lit(top_k))
        scored = scored.withColumn("passing", passing)
        bar = F.when(F.col("passing") < 3, F.lit(min_score - 10.0)).otherwise(bar)
    return (
        scored.withColumn("threshold", bar)
        .drop("passing")
        .filter((F.col("match_score") >= F.col("threshold")) & (F.col("match_rank") <= top_k))
    )
