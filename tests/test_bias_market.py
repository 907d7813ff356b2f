from fixtures import GOLD_JOB, job, jobs_df
from pyspark.sql import functions as F

from rosterwise.operators.bias import bias_report
from rosterwise.operators.market import market_intel, role_category, seniority


def reports(spark, rows, **options):
    return {r.job_id: r for r in bias_report(jobs_df(spark, rows), **options).collect()}


def test_bias_scan_keeps_the_substring_rule(spark):
    text = "The ROCKSTAR monitoring team, young blood and a tier 1 college"
    got = reports(spark, [job("J", text=text)])["J"]
    assert [i.term for i in got.issues] == ["he", "rockstar", "young", "young blood", "nit", "tier 1 college"]
    assert got.issue_types == ["age_bias", "gendered_language", "requirement_inflation"]
    assert got.fairness_score == 10
    assert got.summary == "🔴 2 high-severity bias issue(s) found | 🟡 2 medium-severity language issue(s)"
    word = reports(spark, [job("J", text=text)], mode="word")["J"]
    assert [i.term for i in word.issues] == ["rockstar", "young", "young blood", "tier 1 college"]


def test_bias_summary_edges(spark):
    rows = [
        job("low", text="iit only"),
        job("clean", text="A role for a kind person", pay=(10, 30)),
        job("narrow", ["s"] * 9, text="ok", exp=(3, 4, None), pay=(9, 10)),
        job("wide", text=None, exp=(0, 1, None), pay=(20, 25)),
    ]
    got = reports(spark, rows)
    assert got["low"].summary == "" and got["low"].fairness_score == 85
    assert got["clean"].summary.startswith("✅") and got["clean"].fairness_score == 100
    assert len(got["narrow"].suggestions) == 3 and got["narrow"].fairness_score == 85
    assert got["wide"].suggestions == []


def test_market_of_the_worked_example(spark):
    row = market_intel(jobs_df(spark, [GOLD_JOB])).collect()[0]
    assert (row.role_category, row.seniority_level) == ("ai", "senior")
    assert row.salary_benchmark.market_range == "₹25-45 LPA" and row.salary_benchmark.market_median == 35
    assert row.salary_benchmark.assessment.startswith("⚠️ Below market median")
    assert row.talent_supply.startswith("🟡 Limited") and row.difficulty_score == 30
    assert row.estimated_time_to_hire == "2-4 weeks" and len(row.recommendations) == 1
    assert row.hot_skills_in_jd == ["llm", "langchain"] and row.common_skills_in_jd == ["python"]


def test_market_rules(spark):
    rows = [
        job("none", ["Cobol"], ["x"], "Remote", (None, None, None), None),
        job("hard", ["Rust", "Go", "RAG"] + ["a"] * 5, None, "Goa", (2, 3, None), (1, 10), "Maintenance Clerk"),
        job("common", ["SQL", "Git", "Java"], ["x"], "Hybrid", (0, 9, None), (90, 99), "Staff Accountant"),
    ]
    got = {r.job_id: r for r in market_intel(jobs_df(spark, rows)).collect()}
    assert got["none"].salary_benchmark.assessment.startswith("Not specified")
    assert got["none"].recommendations == ["JD looks competitive and well-structured. No major adjustments needed."]
    assert got["hard"].role_category == "ai" and got["hard"].difficulty_score == 85
    assert got["hard"].talent_supply.startswith("🔴 Scarce") and len(got["hard"].recommendations) == 6
    assert got["common"].seniority_level == "lead" and got["common"].talent_supply.startswith("🟢 Abundant")


def test_title_rules_in_order(spark):
    titles = {
        "data analyst": "data", "sre": "devops", "ui artist": "frontend", "server admin": "backend",
        "full stack dev": "fullstack", "product owner": "product", "clerk": "default",
    }
    df = spark.createDataFrame(list(titles.items()), "t string, want string")
    none = F.array().cast("array<string>")
    assert df.filter(role_category(F.col("t"), none) != F.col("want")).count() == 0
    levels = [("head of x", 0, "lead"), ("sr. dev", 9, "senior"), ("intern", 9, "junior"), ("dev", 8, "lead"), ("dev", 4, "senior"), ("dev", 2, "mid"), ("dev", 1, "junior")]
    df = spark.createDataFrame(levels, "t string, y int, want string")
    assert df.filter(seniority(F.col("t"), F.col("y")) != F.col("want")).count() == 0
