"""Market view of a job: category, seniority, salary benchmark, supply, difficulty, advice."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import has_any, lacks_any, lowered, present


def _first_rule(text: Column, rules, default: Column) -> Column:
    out = default
    for value, terms in reversed(rules):
        out = F.when(has_any(text, terms), F.lit(value)).otherwise(out)
    return out


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def role_category(title: Column, skills: Column) -> Column:
    """First title rule that hits ("ai" also in "maintenance"); else by two AI skills."""
    ai = F.size(F.array_intersect(skills, _strings(K.AI_SKILLS))) >= 2
    return _first_rule(title, K.CATEGORY_TITLES, F.when(ai, F.lit("ai")).otherwise(F.lit("default")))


def seniority(title: Column, min_years: Column) -> Column:
    by_years = (
        F.when(min_years >= 8, F.lit("lead"))
        .when(min_years >= 4, F.lit("senior"))
        .when(min_years >= 2, F.lit("mid"))
        .otherwise(F.lit("junior"))
    )
    return _first_rule(title, K.SENIORITY_TITLES, by_years)


def benchmark(category: Column, level: Column, table=None) -> Column:
    """``struct<lo, hi>``: an unknown category falls back to default, an unknown level to mid."""
    table = K.SALARY_BENCHMARK if table is None else table
    cells = []
    for name, levels in table.items():
        for key, (low, high) in levels.items():
            cells += [F.lit(f"{name}|{key}"), F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))]
    lookup = F.create_map(*cells)
    known = F.when(category.isin(list(table)), category).otherwise(F.lit("default"))

    def at(key):
        return F.try_element_at(lookup, F.concat(known, F.lit("|"), key))

    return F.coalesce(at(level), at(F.lit("mid")))


# The texts below, up to the advice, are fixed values as well.
def salary_assessment(offered_max: Column, lo: Column, hi: Column) -> Column:
    return (
        F.when(offered_max == 0, F.lit("Not specified — may deter candidates who value transparency"))
        .when(offered_max >= hi, F.lit("💰 Above market — strong competitive advantage"))
        .when(offered_max >= (lo + hi) / 2, F.lit("✅ Competitive — within market range"))
        .when(offered_max >= lo, F.lit("⚠️ Below market median — may struggle to attract top talent"))
        .otherwise(F.lit("🔴 Below market — high risk of candidate rejection"))
    )


def talent_supply(hot: Column, common: Column) -> Column:
    return (
        F.when(hot >= 3, F.lit("🔴 Scarce — multiple high-demand skills required. Expect longer time-to-hire."))
        .when(hot >= 1, F.lit("🟡 Limited — some niche skills required. Moderate talent pool."))
        .when(common >= 3, F.lit("🟢 Abundant — mostly common skills. Large talent pool available."))
        .otherwise(F.lit("🟡 Moderate — mixed skill requirements."))
    )


def market_intel(jobs: DataFrame, benchmarks=None, high_demand=None, common_skills=None) -> DataFrame:
    hot_list = _strings(K.HIGH_DEMAND_SKILLS if high_demand is None else high_demand)
    common_list = _strings(K.COMMON_SKILLS if common_skills is None else common_skills)
    years, pay = F.col("experience_years"), F.col("salary_range_lpa")
    rows = jobs.select(
        "job_id",
        F.lower(F.coalesce("title", F.lit(""))).alias("title"),
        F.lower(F.coalesce("location", F.lit("Any"))).alias("loc"),
        F.lower(F.coalesce("location", F.lit(""))).alias("loc_or_blank"),
        lowered(F.col("required_skills")).alias("skills"),
        F.coalesce(F.size("nice_to_have"), F.lit(0)).alias("n_nice"),
        F.coalesce(years["min"], F.lit(0)).alias("low"),
        F.when(F.coalesce(years["max"], F.lit(0)) == 0, F.lit(10)).otherwise(years["max"]).alias("high"),
        F.coalesce(pay["min"], F.lit(0)).alias("pay_low"),
        F.coalesce(pay["max"], F.lit(0)).alias("pay_high"),
    )
    rows = (
        rows.withColumn("role_category", role_category(F.col("title"), F.col("skills")))
        .withColumn("seniority_level", seniority(F.col("title"), F.col("low")))
        .withColumn("bench", benchmark(F.col("role_category"), F.col("seniority_level"), benchmarks))
        .withColumn("hot", F.filter("skills", lambda s: F.array_contains(hot_list, s)))
        .withColumn("common", F.filter("skills", lambda s: F.array_contains(common_list, s)))
    )
    lo, hi, pay_high = F.col("bench.lo"), F.col("bench.hi"), F.col("pay_high")
    points = (
        F.size("hot") * 15
        + F.when(F.col("high") - F.col("low") < 3, F.lit(10)).otherwise(F.lit(0))
        + F.when((pay_high > 0) & (pay_high < 15), F.lit(20)).otherwise(F.lit(0))
        + F.when(lacks_any(F.col("loc"), ["remote", "any", "hybrid"]), F.lit(10)).otherwise(F.lit(0))
    )
    rows = (
        rows.withColumn("assessment", salary_assessment(pay_high, lo, hi))
        .withColumn("talent_supply", talent_supply(F.size("hot"), F.size("common")))
        .withColumn("difficulty_score", points)
    )
    score = F.col("difficulty_score")

    def by_difficulty(hard, moderate, easy):
        return F.when(score >= 40, F.lit(hard)).when(score >= 20, F.lit(moderate)).otherwise(F.lit(easy))

    n_skills = F.size("skills")
    # The wording of the advice.
    advice = present(
        F.when(
            F.contains(F.lower("assessment"), F.lit("below market")),
            F.lit("Consider increasing salary range to market median to attract stronger candidates."),
        ),
        F.when(
            F.size("hot") >= 3,
            F.lit("Consider making some niche skills 'nice-to-have' instead of required to widen the funnel."),
        ),
        F.when(
            score >= 40,
            F.lit("This is a competitive hire. Consider offering remote/hybrid flexibility to expand the talent pool."),
        ),
        F.when(
            n_skills > 7,
            F.concat(
                F.lit("JD has "), n_skills.cast("string"),
                F.lit(" required skills. Trim to 4-5 core skills to avoid deterring qualified candidates."),
            ),
        ),
        F.when(
            F.col("n_nice") <= 0,
            F.lit("Add a 'Nice-to-have' section — it helps candidates self-assess and increases application rate."),
        ),
        F.when(
            lacks_any(F.col("loc_or_blank"), ["remote", "hybrid"]),
            F.lit("Consider adding remote/hybrid option — 68% of tech candidates prefer flexible work arrangements."),
        ),
    )
    fine = F.array(F.lit("JD looks competitive and well-structured. No major adjustments needed."))

    def span(low, high):
        return F.concat(F.lit("₹"), low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" LPA"))

    return rows.withColumn("advice", advice).select(
        "job_id",
        "role_category",
        "seniority_level",
        F.struct(
            span(lo, hi).alias("market_range"),
            F.floor((lo + hi) / 2).cast("int").alias("market_median"),
            span(F.col("pay_low"), pay_high).alias("offered_range"),
            F.col("assessment").alias("assessment"),
        ).alias("salary_benchmark"),
        "talent_supply",
        "difficulty_score",
        by_difficulty(
            "🔴 Hard — expect 4-8 weeks to fill",
            "🟡 Moderate — expect 2-4 weeks to fill",
            "🟢 Easy — expect 1-2 weeks to fill",
        ).alias("hiring_difficulty"),
        by_difficulty("4-8 weeks", "2-4 weeks", "1-2 weeks").alias("estimated_time_to_hire"),
        F.when(F.size("advice") > 0, F.col("advice")).otherwise(fine).alias("recommendations"),
        F.col("hot").alias("hot_skills_in_jd"),
        F.col("common").alias("common_skills_in_jd"),
    )
