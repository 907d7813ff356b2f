"""Biased wording and narrow ranges in job descriptions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import bind, present, term_found


def bias_lexicon(gendered=None, age=None, exclusionary=None, inflation=None) -> list[dict]:
    """Lexicon rows ``type, term, severity, suggestion``; pass own lists to replace the defaults."""

    def row(kind, term, severity, suggestion):
        return {"type": kind, "term": term, "severity": severity, "suggestion": suggestion}

    rows = [
        row("gendered_language", t, "medium", f"Consider using '{r}' instead of '{t.strip()}'")
        for t, r in (K.GENDERED_TERMS if gendered is None else gendered).items()
    ]
    rows += [
        row("age_bias", t, "high", f"Remove age-related term '{t}' — focus on skills and experience instead")
        for t in (K.AGE_TERMS if age is None else age)
    ]
    rows += [
        row("exclusionary", t, "high", f"Remove exclusionary term '{t}' — may violate equal opportunity guidelines")
        for t in (K.EXCLUSIONARY_TERMS if exclusionary is None else exclusionary)
    ]
    rows += [
        row("requirement_inflation", t, "low", s)
        for t, s in (K.INFLATION_TERMS if inflation is None else inflation).items()
    ]
    return rows


def bias_issues(text: Column, lexicon=None, mode: str = "substring") -> Column:
    """``array<struct<type, term, severity, suggestion>>`` in lexicon order.

    The default is a plain substring scan ("he " is found in "the "); ``mode='word'`` asks for
    whole words.
    """
    lexicon = bias_lexicon() if lexicon is None else lexicon
    entries = F.array(
        *[F.struct(*[F.lit(e[k]).alias(k) for k in ("type", "term", "severity", "suggestion")]) for e in lexicon]
    )
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hits = bind(lowered, lambda low: F.filter(entries, lambda e: term_found(low, e.term, mode)))
    # Gendered terms carry a blank that marks the word end; it is not part of the report.
    return F.transform(
        hits,
        lambda e: e.withField(
            "term", F.when(e.type == "gendered_language", F.trim(e.term)).otherwise(e.term)
        ),
    )


def range_suggestions() -> Column:
    years, salary = F.col("experience_years"), F.col("salary_range_lpa")
    low = F.coalesce(years["min"], F.lit(0))
    high = F.when(F.coalesce(years["max"], F.lit(0)) == 0, F.lit(10)).otherwise(years["max"])
    pay_low, pay_high = F.coalesce(salary["min"], F.lit(0)), F.coalesce(salary["max"], F.lit(0))
    skills = F.size(F.coalesce("required_skills", F.array().cast("array<string>")))
    return present(
        F.when(
            (high - low < 2) & (low > 0),
            F.lit("Very narrow experience range may exclude qualified candidates. Consider widening by 1-2 years."),
        ),
        F.when(
            (pay_high > 0) & (pay_low > 0) & ((pay_high - pay_low) / F.nullif(pay_high, F.lit(0)) < 0.2),
            F.lit("Narrow salary band may limit negotiation flexibility and reduce applicant pool."),
        ),
        F.when(
            skills > 8,
            F.concat(
                F.lit("JD lists "), skills.cast("string"),
                F.lit(
                    " required skills — consider splitting into 'required' (3-5) and 'nice-to-have'. "
                    "Long requirement lists deter qualified candidates."
                ),
            ),
        ),
    )


def bias_report(jobs: DataFrame, lexicon=None, mode: str = "substring") -> DataFrame:
    """One row per job: issues, distinct types, suggestions, fairness score, summary."""

    def of(severity):
        return F.size(F.filter("issues", lambda i: i.severity == severity))

    high, medium, advice = F.col("high_severity"), F.col("medium_severity"), F.size("suggestions")
    summary = F.when(
        (F.size("issues") == 0) & (advice == 0),
        F.lit("✅ No significant bias detected. JD appears inclusive and well-structured."),
    ).otherwise(
        F.concat_ws(
            " | ",
            F.when(high > 0, F.concat(F.lit("🔴 "), high.cast("string"), F.lit(" high-severity bias issue(s) found"))),
            F.when(medium > 0, F.concat(F.lit("🟡 "), medium.cast("string"), F.lit(" medium-severity language issue(s)"))),
            F.when(advice > 0, F.concat(F.lit("💡 "), advice.cast("string"), F.lit(" improvement suggestion(s)"))),
        )
    )
    return (
        jobs.withColumn("issues", bias_issues(F.col("raw_text"), lexicon, mode))
        .withColumn("suggestions", range_suggestions())
        .withColumn("high_severity", of("high"))
        .withColumn("medium_severity", of("medium"))
        .select(
            "job_id",
            F.size("issues").alias("issues_found"),
            "issues",
            F.sort_array(F.array_distinct(F.transform("issues", lambda i: i.type))).alias("issue_types"),
            "suggestions",
            "high_severity",
            "medium_severity",
            F.greatest(F.lit(0), 100 - F.size("issues") * 15 - advice * 5).alias("fairness_score"),
            summary.alias("summary"),
        )
    )
