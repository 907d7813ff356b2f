"""Candidate personas and templated outreach transcripts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import number_text
from ..functions.text import lowered


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _joined(matches: DataFrame, jobs: DataFrame) -> DataFrame:
    wanted = jobs.select(
        "job_id",
        F.coalesce("title", F.lit("the role")).alias("title"),
        F.coalesce("location", F.lit("the listed location")).alias("job_location"),
        lowered(F.col("required_skills")).alias("required"),
        F.col("salary_range_lpa")["max"].alias("salary_max"),
    )
    person = F.col("raw_candidate")
    return matches.join(wanted, "job_id").select(
        "job_id",
        "candidate_id",
        "title",
        "job_location",
        "required",
        "salary_max",
        F.coalesce(person["name"], F.lit("the candidate")).alias("name"),
        F.coalesce(person["current_role"], F.lit("professional")).alias("role"),
        F.coalesce(person["skills"], F.array().cast("array<string>")).alias("skills"),
        F.coalesce(person["experience_years"], F.lit(0)).alias("years"),
        F.coalesce(person["salary_expectation_lpa"], F.lit(0)).alias("salary"),
        person["notice_period_days"].alias("notice"),
    )


def personas(matches: DataFrame, jobs: DataFrame) -> DataFrame:
    """``job_id, candidate_id, segment, persona``: how a candidate is likely to answer."""
    wanted = F.array_distinct("required")
    overlap = F.size(F.array_intersect(wanted, lowered(F.col("skills")))) / F.greatest(
        F.size(wanted), F.lit(1)
    )
    affordable = F.col("salary") <= F.coalesce("salary_max", F.lit(100))
    segment = (
        F.when((overlap > 0.5) & affordable, F.lit("enthusiastic"))
        .when(overlap > 0.3, F.lit("cautious"))
        .otherwise(F.lit("non-committal"))
    )
    tone = (
        F.when(
            F.col("segment") == "enthusiastic",
            F.lit("enthusiastic and engaged — this role aligns well with their career goals"),
        )
        .when(
            F.col("segment") == "cautious",
            F.lit("curious but cautious — interested but has some questions about fit"),
        )
        .otherwise(F.lit("polite but non-committal — open to hearing more but not actively looking"))
    )
    budget = F.when(affordable, F.lit("Salary is within budget.")).otherwise(
        F.lit("Salary expectation exceeds budget — may raise this concern.")
    )
    persona = _text(
        F.col("name"), " is a ", F.col("role"), " with ", number_text(F.col("years")), " years experience. They are ",
        tone, ". Notice period: ", number_text(F.coalesce("notice", F.lit(60))), " days. Salary expectation: ₹",
        number_text(F.col("salary")), " LPA. ", budget,
    )
    return (
        _joined(matches, jobs)
        .withColumn("segment", segment)
        .select("job_id", "candidate_id", "segment", persona.alias("persona"))
    )


def templated_transcripts(matches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Six turns per (job, candidate), from the rows alone."""
    matched = F.filter("skills", lambda s: F.array_contains("required", F.lower(s)))
    has_match = F.size(matched) > 0
    primary = F.coalesce(
        F.try_element_at(matched, F.lit(1)),
        F.try_element_at(F.col("skills"), F.lit(1)),
        F.lit("the required stack"),
    )
    affordable = (F.coalesce("salary_max", F.lit(0)) != 0) & (F.col("salary") <= F.col("salary_max"))
    money = F.when(
        affordable, F.lit("The salary range looks aligned with my expectations.")
    ).otherwise(F.lit("I would want to discuss the compensation range in more detail."))
    keen = F.when(
        has_match, F.lit("I am very interested because the role matches my recent work.")
    ).otherwise(
        F.lit("I am open to learning more, though I would want to understand the fit better.")
    )
    skill, title = F.col("primary_skill"), F.col("title")
    # The wording of the six turns.
    turns = [
        ("recruiter", "intro", _text(
            "Hi ", F.col("name"), ", your background as a ", F.col("role"), " looks relevant for our ", title,
            " role, especially around ", skill, ". Would you be open to a quick discussion?")),
        ("candidate", "initial_response", _text(
            "Thanks for reaching out. ", keen, " The ", title, " opportunity sounds worth exploring.")),
        ("recruiter", "deep_dive", _text(
            "Great. Could you share a recent example of how you used ", skill, " in a project?")),
        ("candidate", "technical_response", _text(
            "I have used ", skill, " in production work and can walk through the architecture, "
            "tradeoffs, and outcomes in an interview.")),
        ("recruiter", "availability_probe", _text(
            "What is your notice period, salary expectation, and comfort with the role location: ",
            F.col("job_location"), "?")),
        ("candidate", "commitment_signal", _text(
            "My notice period is around ", number_text(F.coalesce("notice", F.lit(30))), " days. ", money,
            " I am open to the next step if the team, scope, and offer are aligned.")),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("turn"), F.lit(speaker).alias("speaker"),
                message.alias("message"), F.lit(intent).alias("intent"),
            )
            for n, (speaker, intent, message) in enumerate(turns, 1)
        ]
    )
    return (
        _joined(matches, jobs)
        .withColumn("primary_skill", primary)
        .select("job_id", "candidate_id", F.inline(rows))
    )
