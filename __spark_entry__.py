
from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracles  # noqa: E402
from rosterwise.functions.constants import POOL_HEADERS  # noqa: E402
from rosterwise.functions.skills import canonical, expand  # noqa: E402
from rosterwise.operators import (  # noqa: E402
    bias, cleaning, discovery, fuzzy, generate, interest, jd, market, matching, poolstats,
    ranking, report, transcripts,
)
from rosterwise.plans import driver_views as views  # noqa: E402
from rosterwise.plans.shortlist import build_shortlist, discover_and_match, indexed  # noqa: E402
from rosterwise.session import cut_lineage  # noqa: E402

TOP_K = 10
# A bar that some jobs of the test tables miss, so that the adaptive step shows.
HIGH_BAR = oracles.HIGH_BAR


def _inputs(spark, sf_dir):
    """Jobs, written once since several branches of a plan read them, and the index of the pool."""
    return cut_lineage(views.jobs(spark, sf_dir)), indexed(views.candidates(spark, sf_dir), TOP_K)


def _joined(column):
    return F.array_join(column, ", ")


def _shortlist(spark, sf_dir, **options):
    return build_shortlist(*_inputs(spark, sf_dir), views.recorded_talks(spark, sf_dir), top_k=TOP_K, **options)


def discovery_topk(spark, sf_dir):
    return discovery.discover(views.jobs(spark, sf_dir), views.candidates(spark, sf_dir), 3 * TOP_K)


def discovery_top1(spark, sf_dir):
    return discovery.discover(views.jobs(spark, sf_dir), views.candidates(spark, sf_dir), 1)


def skill_overlap(spark, sf_dir):
    jobs, index = _inputs(spark, sf_dir)
    people = index.people
    found = discovery.discover(jobs, index, 3 * TOP_K).select("job_id", "candidate_id")
    pairs = found.join(
        jobs.select("job_id", F.concat("required_skills", "nice_to_have").alias("jd_skills")), "job_id"
    ).join(people.select("candidate_id", F.col("skills").alias("cand_skills")), "candidate_id")
    overlap = F.col("overlap")
    fuzzy_text = F.transform(
        overlap["fuzzy_matches"], lambda p: F.concat(p["jd_skill"], F.lit("≈"), p["cand_skill"])
    )
    return matching.semantic_overlap(pairs, ["job_id", "candidate_id"]).select(
        "job_id", "candidate_id",
        _joined(overlap["direct_matches"]).alias("direct_matches"),
        _joined(fuzzy_text).alias("fuzzy_matches"),
        overlap["total_jd_skills"].alias("total_jd_skills"),
        overlap["matched_count"].alias("matched_count"),
        overlap["match_percentage"].alias("match_percentage"),
        _joined(F.sort_array(overlap["unmatched_jd_skills"])).alias("unmatched_jd_skills"),
    )


def _vocabulary(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    return part.select(views.skill_of_part(F.col("p_name")).alias("skill")).distinct()


def skill_expansion(spark, sf_dir):
    skill = F.col("skill")
    return _vocabulary(spark, sf_dir).select(
        "skill", _joined(expand(F.array(skill))).alias("expanded"), canonical(skill).alias("canonical")
    )


def fuzzy_pairs(spark, sf_dir):
    terms = (
        _vocabulary(spark, sf_dir).select(F.explode(expand(F.array("skill"))).alias("term")).distinct()
    )
    return fuzzy.fuzzy_pairs(
        terms.select(F.col("term").alias("jd_skill")), terms.select(F.col("term").alias("cand_skill"))
    )


def match_factors(spark, sf_dir):
    jobs, index = _inputs(spark, sf_dir)
    found = cut_lineage(discovery.discover(jobs, index, 3 * TOP_K))
    factor = F.col("factor_breakdown")
    return matching.match_pairs(found, jobs, index.people).select(
        "job_id", "candidate_id", "match_score", "skill_match_score", "experience_match_score",
        "salary_match_score", "location_match_score",
        *[factor[k]["percentage"].alias(f"{k}_percentage") for k in ("skills", "experience", "salary", "location")],
        *[factor[k]["label"].alias(f"{k}_label") for k in ("skills", "experience", "salary", "location")],
        "overall_explanation",
        _joined("skill_breakdown.matched_skills").alias("matched_skills"),
        F.col("skill_breakdown.fuzzy_matches_found").alias("fuzzy_matches_found"),
    )


def match_topk_adaptive(spark, sf_dir):
    _, matches = discover_and_match(*_inputs(spark, sf_dir), min_score=HIGH_BAR, top_k=TOP_K)
    return matches.select("job_id", "candidate_id", "match_rank", "match_score", "threshold")


def bias_issues(spark, sf_dir):
    issues = bias.bias_issues(F.col("raw_text"))
    return views.jd_documents(spark, sf_dir).select("job_id", F.inline(issues))


def bias_issues_own_lexicon(spark, sf_dir):
    lexicon = bias.bias_lexicon(gendered=oracles.OWN_GENDERED, age=oracles.OWN_AGE, exclusionary=[], inflation={})
    issues = bias.bias_issues(F.col("raw_text"), lexicon, mode="word")
    return views.jd_documents(spark, sf_dir).select("job_id", F.inline(issues))


def bias_report(spark, sf_dir):
    return bias.bias_report(views.jd_documents(spark, sf_dir)).select(
        "job_id", "issues_found", _joined("issue_types").alias("issue_types"),
        F.array_join("suggestions", " / ").alias("suggestions"),
        "high_severity", "medium_severity", "fairness_score", "summary",
    )


def market_intel(spark, sf_dir):
    pay = F.col("salary_benchmark")
    return market.market_intel(views.jobs(spark, sf_dir)).select(
        "job_id", "role_category", "seniority_level",
        *[pay[c].alias(c) for c in ("market_range", "market_median", "offered_range", "assessment")],
        "talent_supply", "difficulty_score", "hiring_difficulty", "estimated_time_to_hire",
        F.array_join("recommendations", " / ").alias("recommendations"),
        _joined("hot_skills_in_jd").alias("hot_skills_in_jd"),
        _joined("common_skills_in_jd").alias("common_skills_in_jd"),
    )


def _matches(spark, sf_dir):
    jobs, index = _inputs(spark, sf_dir)
    return jobs, discover_and_match(jobs, index, top_k=TOP_K)[1]


def personas(spark, sf_dir):
    jobs, matches = _matches(spark, sf_dir)
    return transcripts.personas(matches, jobs)


def transcripts_templated(spark, sf_dir):
    jobs, matches = _matches(spark, sf_dir)
    return transcripts.templated_transcripts(matches, jobs)


def question_and_length_stats(spark, sf_dir):
    talks = views.conversations(spark, sf_dir)
    signals = interest.transcript_signals(talks, ["candidate_id"])
    return signals.select(
        "candidate_id", "n", "chars", "questions",
        (F.col("chars") / F.greatest(F.col("n"), F.lit(1))).alias("avg_length"),
    )


def transcript_markers(spark, sf_dir):
    markers = interest.Markers(oracles.OWN_MARKERS, [], [], [], [])
    signals = interest.transcript_signals(views.conversations(spark, sf_dir), ["candidate_id"], markers)
    return signals.select("candidate_id", _joined("found").alias("found"))


def interest_scores(spark, sf_dir):
    _, matches = _matches(spark, sf_dir)
    return interest.score_interest(matches, views.recorded_talks(spark, sf_dir)).select(
        "job_id", "candidate_id", "enthusiasm_score", "engagement_score", "commitment_score",
        "total_interest_score", F.array_join("positive_signals", " / ").alias("positive_signals"),
        F.array_join("negative_signals", " / ").alias("negative_signals"),
        "questions_asked", "availability_commitment", "conversation_preview",
    )


def ranked_shortlist(spark, sf_dir):
    return _shortlist(spark, sf_dir).ranked.select(
        "job_id", "rank", "candidate_id", "candidate_name", "match_score", "interest_score",
        "combined_score", "interest_explanation", "recommendation", "tier", "display_tier",
        "score_band", "next_step", "timeline",
    )


def tier_counts(spark, sf_dir):
    best = F.col("best")
    return _shortlist(spark, sf_dir).tier_counts().select(
        "job_id", "total_candidates_considered", "priority_hires", "fast_track", "recommended",
        "average_match_score", "average_interest_score", best["candidate_id"].alias("best_candidate"),
    )


def job_funnel(spark, sf_dir):
    funnel = _shortlist(spark, sf_dir, min_score=HIGH_BAR).funnel().drop("best")
    return funnel.na.fill(0.0, ["threshold"])


def flat_shortlist(spark, sf_dir):
    flat = _shortlist(spark, sf_dir).flat()
    return flat.toDF(*[c.lower().replace(" ", "_") for c in flat.columns])


def summary_unpivot(spark, sf_dir):
    # The time of the run has no counterpart in the SQL.
    return _shortlist(spark, sf_dir).summary().filter("label <> 'Report Generated'")


def report_documents(spark, sf_dir):
    """The nested report, opened again to one row per candidate of each document."""
    rows = _shortlist(spark, sf_dir).documents().select(
        "job_id", "job_title", "job_location", "total_candidates_considered",
        F.col("summary.priority_hires").alias("priority_hires"),
        F.col("market_intelligence.role_category").alias("role_category"),
        F.explode("candidates").alias("c"),
    )
    return rows.select(
        "job_id", "job_title", "job_location", "total_candidates_considered", "priority_hires",
        "role_category", F.col("c.rank").alias("rank"), F.col("c.candidate_id").alias("candidate_id"),
        F.col("c.combined_score").alias("combined_score"),
        F.coalesce("c.conversation_turns", F.lit(0)).alias("turns"),
    )


def report_parts(spark, sf_dir):
    """Whole documents in parts: every turn of every shortlisted candidate, and the document head."""
    parts = _shortlist(spark, sf_dir).document_parts()
    said = F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["turn"], t["speaker"], t["message"])), "|")
    return parts.select(
        "job_id", "rank", "chunk", F.coalesce("candidate_id", F.lit("")).alias("candidate_id"),
        F.coalesce(F.get_json_object("head", "$.job_title"), F.lit("")).alias("job_title"),
        F.coalesce(F.array_size("turns"), F.lit(0)).alias("turns"), F.md5(F.coalesce(said, F.lit(""))).alias("said_md5"),
    )


def pool_stats(spark, sf_dir):
    return poolstats.pool_stats(views.candidates(spark, sf_dir))


def pool_locations(spark, sf_dir):
    return poolstats.pool_locations(views.candidates(spark, sf_dir))


def top_locations(spark, sf_dir):
    return poolstats.top_locations(views.candidates(spark, sf_dir))


def experience_bands(spark, sf_dir):
    return poolstats.experience_bands(views.candidates(spark, sf_dir))


def source_files(spark, sf_dir):
    return poolstats.source_files(views.table(spark, sf_dir, "customer"))


def clean_pool(spark, sf_dir):
    """Customers as an untidy sheet: odd headers, blanks, text for numbers."""
    key = F.col("c_custkey")

    def unless(remainder, divisor, value):
        return F.when(key % divisor != remainder, value)

    cells = {
        "ID": unless(0, 4, F.concat(F.lit("K"), key.cast("string"))),
        " Name ": F.col("c_name"),
        "Experience (Years)": F.when(key % 6 == 0, F.lit("many")).when(key % 6 == 1, F.lit(None)).otherwise(
            F.concat((key % 13).cast("string"), F.lit(".75"))
        ),
        "Skills": F.when(key % 8 == 0, F.lit(None)).otherwise(
            F.concat(F.lit(" sql ,, "), F.lower("c_mktsegment"), F.lit(" ,"))
        ),
        "Salary": F.format_string("%.2f", F.col("c_acctbal")),
        "Notice Days": unless(2, 5, (key % 90).cast("string")),
        "Role": unless(0, 7, F.col("c_mktsegment")),
        "Shoe Size": F.lit("42"),
    }
    raw = views.table(spark, sf_dir, "customer").select(
        key.alias("pool_order"), *[v.cast("string").alias(name) for name, v in cells.items()]
    )
    return cleaning.clean_pool(raw).select(
        "candidate_id", "name", "location", "experience_years", "current_role",
        F.array_join("skills", "|").alias("skills"), "education", "salary_expectation_lpa",
        "notice_period_days", "bio", "pool_order",
    )


def header_check(spark, sf_dir):
    """Columns of every customer row under the expected headers, if those pass the check."""
    customer = views.table(spark, sf_dir, "customer")
    wide = customer.select(
        *[(F.col("c_name") if f == "name" else F.lit("x")).alias(h) for f, h in POOL_HEADERS.items()]
    )
    return cleaning.map_headers(cleaning.validate_schema(wide)).groupBy("education").agg(
        F.count_distinct("name").alias("names")
    )


def generate_pool(spark, sf_dir):
    ids = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return generate.generate_candidates(ids, seed=oracles.SEED).select(
        "id", "domain", "experience_years", "salary_expectation_lpa", "notice_period_days", "location",
        "phone", "preferred_work_mode", "availability_status",
        (F.size(F.split("skills", ", ")).between(5, 10)).alias("skill_count_ok"),
        (F.col("github") == "").alias("no_github"),
    )


def jd_extraction(spark, sf_dir):
    """Jobs written out as labelled text and read back."""
    jobs = views.jobs(spark, sf_dir)
    low, high = F.col("experience_years.min"), F.col("experience_years.max")

    def bullets(skills):
        return F.array_join(F.transform(skills, lambda s: F.concat(F.lit("- Work with "), s, F.lit(" daily"))), "\n")

    years = F.when(high.isNull(), F.concat(low.cast("string"), F.lit("+ years"))).otherwise(
        F.concat_ws("-", low.cast("string"), F.concat(high.cast("string"), F.lit(" years")))
    )
    text = F.concat(
        F.lit("Job Title: "), "title", F.lit("\n\nLocation: "), "location",
        F.lit("\n\nRequirements:\n- "), years, F.lit(" of practice\n"), bullets("required_skills"),
        F.lit("\n\nNice to Have:\n"), bullets("nice_to_have"),
        F.lit("\n\nSalary Range: "), F.col("salary_range_lpa.min").cast("string"), F.lit("-"),
        F.col("salary_range_lpa.max").cast("string"), F.lit(" LPA\nNotice Period: 30-60 days"),
    )
    texts = jobs.select("job_id", text.alias("raw_text"))
    pay, span = F.col("salary_range_lpa"), F.col("experience_years")
    return jd.extract_jobs(texts, _vocabulary(spark, sf_dir)).select(
        "job_id", "title", "location", _joined("required_skills").alias("required_skills"),
        _joined("nice_to_have").alias("nice_to_have"), span["min"].alias("exp_min"), F.coalesce(span["max"], F.lit(-1)).alias("exp_max"),
        pay["min"].alias("sal_min"), pay["max"].alias("sal_max"), "notice_preference_days",
    )


def _quarters(key):
    """0, 0.25, 0.5 or 0.75, by a number."""
    return F.col(key).cast("bigint") % 4 / 4


def fraction_scores(spark, sf_dir):
    """Discovery and match where years and pay have quarters on both sides."""
    jobs = cut_lineage(views.jobs(spark, sf_dir).withColumns({
        "experience_years": F.col("experience_years").withField("min", F.col("experience_years.min") + _quarters("job_id")),
        "salary_range_lpa": F.col("salary_range_lpa").withField("max", F.col("salary_range_lpa.max") + _quarters("job_id")),
    }))
    pool = views.candidates(spark, sf_dir).withColumns({
        c: F.col(c) + _quarters("candidate_id") for c in ("experience_years", "salary_expectation_lpa")
    })
    index = indexed(pool, TOP_K)
    found = cut_lineage(discovery.discover(jobs, index, 3 * TOP_K))
    factors = F.col("factor_breakdown")
    return matching.match_pairs(found, jobs, index.people).select(
        "job_id", "candidate_id", "discovery_rank", "discovery_score", "match_score",
        *[factors[f][part].alias(f"{f}_{part}") for f in ("experience", "salary") for part in ("score", "label", "note")],
    )


def jd_decode(spark, sf_dir):
    """Jobs as replies: JSON wrapped in prose, some of the numbers with quarters, some beyond 32 bits."""
    jobs = views.jobs(spark, sf_dir).withColumn("salary_range_lpa", F.col("salary_range_lpa").withField(
        "max", F.col("salary_range_lpa.max") + _quarters("job_id")
    )).withColumn("notice_preference_days", F.when(F.col("job_id").cast("bigint") % 3 == 0, F.lit(3000000000)).otherwise(
        F.col("notice_preference_days")
    ))
    body = F.to_json(F.struct(*[c for c in jobs.columns if c not in ("job_id", "raw_text")]))
    reply = F.concat(F.lit("Here you are:\n```json\n"), body, F.lit("\n```"))
    decoded = jd.decode_replies(jobs.select("job_id", reply.alias("reply"), "raw_text"))
    return decoded.select(
        "job_id", "title", "location", _joined("required_skills_lower").alias("required_skills"),
        _joined("nice_to_have_lower").alias("nice_to_have"), F.col("experience_years.min").alias("exp_min"),
        F.coalesce("experience_years.max", F.lit(-1)).alias("exp_max"),
        F.col("salary_range_lpa.max").alias("sal_max"),
        "notice_preference_days", jd.is_sufficient().alias("sufficient"),
    )


def jd_rejects(spark, sf_dir):
    return views.jd_documents(spark, sf_dir).select(
        "job_id", F.length("raw_text").alias("chars"), jd.reject_reason(F.col("raw_text")).alias("reject_reason")
    )


def jd_skill_scan(spark, sf_dir):
    """Every run of three words of whole benchmark texts, looked for as a skill in whole documents."""
    word = r"[\p{L}\p{N}]+"
    every = rf"(?<![\p{{L}}\p{{N}}])(?=({word} {word} {word}))"
    phrases = F.regexp_extract_all(F.lower("text"), F.lit(every), F.lit(1))
    vocabulary = views.table(spark, sf_dir, "benchmark").select(F.explode(phrases).alias("skill")).distinct()
    documents = views.jd_documents(spark, sf_dir)
    return jd.mentioned_skills(documents, ["job_id"], "raw_text", vocabulary)


_QUERIES = [
    discovery_topk, discovery_top1, skill_overlap, skill_expansion, fuzzy_pairs, match_factors,
    match_topk_adaptive, bias_issues, bias_issues_own_lexicon, bias_report, market_intel, personas,
    transcripts_templated, question_and_length_stats, transcript_markers, interest_scores,
    ranked_shortlist, tier_counts, job_funnel, flat_shortlist, summary_unpivot, report_documents,
    report_parts,
    pool_stats, pool_locations, top_locations, experience_bands, source_files, clean_pool,
    header_check, generate_pool, jd_extraction, jd_decode, fraction_scores, jd_rejects, jd_skill_scan,
]


def _text_queries():
    """Queries and SQL of ``rosterwise.llm`` and the pipeline; none if they aren't there."""
    try:
        import corpus_pipeline
        from rosterwise.llm import oracles as sql
        from rosterwise.llm import queries as text
    except ModuleNotFoundError as gone:
        if not (gone.name or "").startswith(("corpus_pipeline", "rosterwise.llm")):
            raise
        return {}, {}
    found = dict(sql.oracle_sql())
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**text.queries(), "pipeline": corpus_pipeline.run}, found


def entry(spark: SparkSession) -> DataFrame:
    """Ranked shortlist of every job on the smallest tables."""
    return ranked_shortlist(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{q.__name__: q for q in _QUERIES}, **_text_queries()[0]}


def oracle_sql() -> dict[str, str]:
    return {**oracles.oracle_sql(), **_text_queries()[1]}
