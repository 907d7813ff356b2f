"""Combined score, tiers, rank, funnel, verdict and status."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import py_round1
from .jd import reject_reason

# --- Fixed values: tier, lowest combined score, message --------------------------------
TIERS = [
    ("PRIORITY HIRE", 85, "🔥 PRIORITY HIRE: Exceptional fit + high enthusiasm. Contact immediately!"),
    ("FAST-TRACK", 75, "⚡ FAST-TRACK: Strong match, good interest. Schedule interview this week."),
    ("RECOMMENDED", 65, "✅ RECOMMENDED: Solid fit, moderate interest. Good interview prospect."),
    ("BACKUP", 55, "📝 BACKUP: Decent on one dimension, weak on other. Keep in pipeline."),
    ("PASS", None, "❌ PASS: Low combined score. Focus on higher-ranked candidates."),
]
# --- Fixed values: recruiter action per tier --------------------------------------------
ACTIONS = {
    "PRIORITY HIRE": ("Send offer discussion invite", "Within 24 hours"),
    "FAST-TRACK": ("Schedule technical interview", "This week"),
    "RECOMMENDED": ("Send culture-fit interview invite", "Next week"),
}
OTHER_ACTION = ("Keep warm, reach out in 2 weeks", "Flexible")


def _by_score(score: Column, steps) -> Column:
    """First value whose bound the score reaches; the last one has no bound."""
    out = F.lit(steps[-1][1])
    for bound, value in reversed(steps[:-1]):
        out = F.when(score >= bound, F.lit(value)).otherwise(out)
    return out


def tier_code(combined: Column) -> Column:
    """Tier of the unrounded combined score."""
    return _by_score(combined, [(bound, code) for code, bound, _ in TIERS])


def display_tier(rounded: Column) -> Column:
    """Tier shown in lists, from the rounded score; there is no PASS."""
    return _by_score(
        rounded, [(85, "🔥 PRIORITY"), (75, "⚡ FAST-TRACK"), (65, "✅ RECOMMENDED"), (None, "📝 BACKUP")]
    )


def score_band(rounded: Column) -> Column:
    return _by_score(rounded, [(85, "good"), (65, "warn"), (None, "plain")])


def recruiter_action(tier: Column) -> Column:
    out = F.struct(F.lit(OTHER_ACTION[0]).alias("next_step"), F.lit(OTHER_ACTION[1]).alias("timeline"))
    for code, (step, when) in ACTIONS.items():
        out = F.when(
            tier == code, F.struct(F.lit(step).alias("next_step"), F.lit(when).alias("timeline"))
        ).otherwise(out)
    return out


def rank_candidates(
    matches: DataFrame, interest: DataFrame, match_weight: float = 0.6, interest_weight: float = 0.4
) -> DataFrame:
    """Join match and interest, weigh, rank 1..n per job; ties keep match order."""
    signals = interest.select(
        "job_id", "candidate_id", "total_interest_score", "positive_signals", "negative_signals",
        "availability_commitment", "conversation_preview", "conversation_completed",
    )
    combined = F.col("match_score") * match_weight + F.col("total_interest_score") * interest_weight
    rows = (
        matches.join(signals, ["job_id", "candidate_id"])
        .withColumn("combined", combined)
        .withColumn("combined_score", py_round1(F.col("combined")))
        .withColumn("tier", tier_code(F.col("combined")))
    )
    best = W.partitionBy("job_id").orderBy(F.desc("combined_score"), "match_rank")
    explanation = F.concat(
        F.col("availability_commitment"), F.lit(". "),
        F.size("positive_signals").cast("string"), F.lit(" positive signals, "),
        F.size("negative_signals").cast("string"), F.lit(" concerns."),
    )
    action = recruiter_action(F.col("tier"))
    return rows.select(
        "job_id",
        F.row_number().over(best).alias("rank"),
        "candidate_id",
        "candidate_name",
        "match_score",
        F.col("total_interest_score").alias("interest_score"),
        "combined_score",
        F.col("overall_explanation").alias("match_explanation"),
        explanation.alias("interest_explanation"),
        F.col("availability_commitment").alias("availability_timeline"),
        F.col("negative_signals").alias("concerns"),
        F.col("positive_signals").alias("enthusiasm_signals"),
        "skill_breakdown",
        "factor_breakdown",
        "conversation_preview",
        _by_score(F.col("combined"), [(bound, text) for _, bound, text in TIERS]).alias("recommendation"),
        "tier",
        display_tier(F.col("combined_score")).alias("display_tier"),
        score_band(F.col("combined_score")).alias("score_band"),
        action["next_step"].alias("next_step"),
        action["timeline"].alias("timeline"),
        "conversation_completed",
    )


def tier_counts(ranked: DataFrame) -> DataFrame:
    """Per job: counts by tier, averages of the rounded scores, and the best candidate."""

    def mean1(column):
        # Scores are whole tenths: summed as such, the order of rows does not matter.
        tenths = F.sum(F.round(F.col(column) * 10).cast("bigint"))
        return py_round1(tenths / F.lit(10.0) / F.count(F.lit(1)))

    return ranked.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_candidates_considered"),
        F.count_if(F.col("tier") == "PRIORITY HIRE").alias("priority_hires"),
        F.count_if(F.col("tier") == "FAST-TRACK").alias("fast_track"),
        F.count_if(F.col("tier") == "RECOMMENDED").alias("recommended"),
        mean1("match_score").alias("average_match_score"),
        mean1("interest_score").alias("average_interest_score"),
        F.count_if("conversation_completed").alias("conversations_completed"),
        F.min_by(F.struct("candidate_id", "candidate_name", "combined_score"), "rank").alias("best"),
    )


def verdict(priority: Column, fast_track: Column, recommended: Column) -> Column:
    def counted(before, n, after):
        return F.concat(F.lit(before), n.cast("string"), F.lit(after))

    return (
        F.when(
            priority > 0,
            counted("🔥 Strong pipeline! ", priority, " priority hire(s) identified. Recruiter should contact immediately."),
        )
        .when(
            fast_track > 0,
            counted("⚡ Good pipeline. ", fast_track, " fast-track candidate(s). Schedule interviews this week."),
        )
        .when(
            recommended > 0,
            counted("✅ Viable candidates found. ", recommended, " recommended for interview. Pipeline needs nurturing."),
        )
        .otherwise(F.lit("📝 Weak pipeline. Consider revising JD requirements or expanding search channels."))
    )


def funnel(jobs: DataFrame, candidates: DataFrame, discovered: DataFrame, matches: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per job, also for jobs without results: counters, status, error, verdict.

    ``widened`` marks jobs that were searched with fewer than three finds. Raising their limit
    cannot change the result, since the limit was not what held it down. A text that is too short
    (see ``jd.reject_reason``) is rejected before anything else; jobs without a text are not.
    """
    parsed = (F.coalesce("title", F.lit("")) != "") & (F.size(F.coalesce("required_skills", F.array())) > 0)
    pool_size = candidates.agg(F.count(F.lit(1))).scalar()
    rejected = F.when(F.col("raw_text").isNotNull(), reject_reason(F.col("raw_text")))
    base = jobs.select("job_id", parsed.alias("parsed"), rejected.alias("rejected"), pool_size.alias("pool_size"))
    found = discovered.groupBy("job_id").agg(F.count(F.lit(1)).alias("discovered"))
    kept = matches.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("matched"), F.first("threshold").alias("threshold")
    )
    rows = (
        base.join(found, "job_id", "left")
        .join(kept, "job_id", "left")
        .join(tier_counts(ranked), "job_id", "left")
        .na.fill(
            0,
            ["discovered", "matched", "conversations_completed", "priority_hires", "fast_track", "recommended"],
        )
    )
    status = (
        F.when(F.col("rejected").isNotNull(), F.lit("rejected"))
        .when(~F.col("parsed"), F.lit("parse_failed"))
        .when(F.col("discovered") == 0, F.lit("no_candidates"))
        .when(F.col("matched") == 0, F.lit("no_matches"))
        .otherwise(F.lit("ok"))
    )
    error = (
        F.when(
            F.col("status") == "parse_failed",
            F.lit("Could not parse JD. Please include a clear job title and requirements."),
        )
        .when(F.col("status") == "rejected", F.col("rejected"))
        .when(F.col("status") == "no_candidates", F.lit("No matching candidates found in talent pool."))
        .when(F.col("status") == "no_matches", F.lit("No candidates met minimum match threshold."))
    )
    return (
        rows.withColumn("status", status)
        .withColumn("error", error)
        .select(
            "job_id",
            "pool_size",
            "discovered",
            "matched",
            "conversations_completed",
            "priority_hires",
            "fast_track",
            "recommended",
            (~F.col("status").isin("rejected", "parse_failed") & (F.col("discovered") < 3)).alias("widened"),
            "threshold",
            "status",
            "error",
            F.when(
                F.col("status") == "ok",
                verdict(F.col("priority_hires"), F.col("fast_track"), F.col("recommended")),
            ).alias("verdict"),
            F.col("best"),
        )
    )
