import itertools
import json
import random
import time

from fixtures import job, jobs_df, person, pool_df
from pyspark.sql import functions as F

from rosterwise.operators import jd
from rosterwise.operators.transcripts import templated_transcripts
from rosterwise.plans.shortlist import build_shortlist, discover_and_match
from rosterwise.streaming.jd_stream import jd_text_stream, shortlist_stream

TEXT = """Job Title: Senior Data Engineer

Location: Hyderabad

About the Role:
We build pipelines with Cobol.

Requirements:
- 4+ years of experience in data engineering
- Strong SQL and Python skills
- Apache Spark, CI/CD or C# (any)

Nice to Have:
- Kafka and SQL

Salary Range: 18-28 LPA
Notice Period: 30-60 days preferred"""
SKILLS = ["SQL", "Python", "Apache Spark", "Spark", "CI/CD", "C", "C#", "Kafka", "Go", "Cobol", "engine"]


def vocabulary(spark):
    return spark.createDataFrame([(s,) for s in SKILLS], "skill string")


def test_extraction(spark):
    texts = spark.createDataFrame([("a", TEXT), ("b", "no labels here"), ("c", None)], "job_id string, raw_text string")
    rows = {r.job_id: r for r in jd.extract_jobs(texts, vocabulary(spark)).collect()}
    a = rows["a"]
    assert (a.title, a.location, a.notice_preference_days) == ("Senior Data Engineer", "Hyderabad", 30)
    # Word mode: "C" is a word of "C#" by letters, "engine" is not one of "engineering".
    assert a.required_skills == ["Apache Spark", "C", "C#", "CI/CD", "Python", "SQL", "Spark"]
    assert a.nice_to_have == ["Kafka"]
    assert (a.experience_years.min, a.experience_years.max) == (4, None)
    assert (a.salary_range_lpa.min, a.salary_range_lpa.max) == (18, 28)
    assert rows["b"].title is None and rows["b"].required_skills == []
    assert rows["c"].location == "Any"


def test_phrases_against_plain_search(spark):
    """A word in every text, overlapping phrases, signs at either end, wide gaps, odd texts and skills."""
    rng = random.Random(5)
    words, gaps = ["go", "sql", "c", "x1", "Über", "net", "ci", "cd"], [" ", " ", " ", "/", "#", "# ", " .", ".", "  ", ", ", "-"]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 30))) + " go" for _ in range(60)]
    texts += ["", "go", "#go", ".net", "c#", " .net c# ", "go go go", "漢字 go", None, "!?"]
    skills = [" ".join(p) for n in (1, 2, 3) for p in itertools.product(words, repeat=n) if rng.random() < 0.3]
    skills += ["go", "Go", "C#", ".NET", "ci/cd", "c# .net", "go  sql", "#", "", None, " go ", "/cd", "go go", "漢字"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    vocabulary = spark.createDataFrame([(s,) for s in skills], "skill string")
    got = [tuple(r) for r in jd.mentioned_skills(rows, ["id"], "t", vocabulary).collect()]
    wordy = lambda c: c.isalpha() or c.isdigit()

    def occurs(text, name):
        at = text.find(name)
        while at >= 0:
            if not (at and wordy(text[at - 1])) and not (at + len(name) < len(text) and wordy(text[at + len(name)])):
                return True
            at = text.find(name, at + 1)
        return False

    named = {s for s in skills if s and any(map(wordy, s))}
    want = {(i, s) for i, t in enumerate(texts) if t for s in named if occurs(t.lower(), s.lower().strip(" "))}
    assert len(got) == len(set(got)) and set(got) == want
    assert jd.mentioned_skills(rows, ["id"], "t", vocabulary.limit(0)).collect() == []


def test_decoding(spark):
    good = {"title": "T", "required_skills": ["Go", "SQL"], "salary_range_lpa": {"min": 1, "max": None}, "experience_years": {"min": 2}}
    replies = [
        ("a", "Sure!\n```json\n" + json.dumps(good) + "\n``` bye"), ("b", "no json"), ("c", '{"title": "T", '),
        ("d", '{"title": "T"} and {"title": "U"}'), ("e", None), ("f", '{"title": ""}'),
    ]
    df = spark.createDataFrame(replies, "job_id string, reply string").withColumn("raw_text", F.lit("text"))
    rows = {r.job_id: r for r in jd.decode_replies(df).withColumn("ok", jd.is_sufficient()).collect()}
    assert rows["a"].required_skills_lower == ["go", "sql"] and rows["a"].ok
    assert rows["a"].salary_range_lpa.max is None and rows["a"].nice_to_have_lower == []
    for broken in "bcde":
        assert rows[broken].title == "Unknown" and rows[broken].salary_range_lpa.max == 100 and not rows[broken].ok
    assert rows["f"].title == "" and not rows["f"].ok


def test_fractions_do_not_spoil_a_reply(spark):
    reply = '{"title": "Dev", "required_skills": ["Go"], "salary_range_lpa": {"min": 12.5, "max": 20}, "notice_preference_days": 30.0}'
    row = jd.decode_replies(spark.createDataFrame([("a", reply, "")], "job_id string, reply string, raw_text string")).collect()[0]
    assert (row.title, row.required_skills, tuple(row.salary_range_lpa), row.notice_preference_days) == ("Dev", ["Go"], (12.5, 20), 30)


def test_length_check(spark):
    df = spark.createDataFrame([("x" * 49 + " \n",), ("x" * 50,), (None,)], "t string")
    assert [r[0] is None for r in df.select(jd.reject_reason(F.col("t"))).collect()] == [False, True, False]


def test_funnel_keeps_every_job(spark):
    jobs = [
        job("ok", ["Go"], ["SQL"], "Pune", (2, 5, None), (5, 15)),
        job("unparsed", []),
        job("nobody", ["Rust"], location="Goa", exp=(60, 70, None)),
        job("weak", ["Rust"], location="Goa", exp=(3, 4, None), pay=(1, 2)),
        job("short", ["Go"], text="Go"),
    ]
    pool = [person(i, ["Go", "SQL"] if i % 2 else ["Go"], 3, "Pune", 10 + i) for i in range(6)]
    jobs, pool = jobs_df(spark, jobs), pool_df(spark, pool)
    talks = templated_transcripts(discover_and_match(jobs, pool, min_score=60)[1], jobs)
    plan = build_shortlist(jobs, pool, talks, min_score=60)
    rows = {r.job_id: r for r in plan.funnel().collect()}
    assert {k: r.status for k, r in rows.items()} == {"ok": "ok", "unparsed": "parse_failed", "nobody": "no_candidates", "weak": "no_matches", "short": "rejected"}
    assert rows["ok"].discovered == rows["ok"].matched == rows["ok"].conversations_completed == 6
    assert rows["ok"].pool_size == rows["nobody"].pool_size == 6
    assert rows["ok"].verdict and rows["weak"].verdict is None and rows["nobody"].widened
    assert not rows["unparsed"].widened and not rows["short"].widened and "too short" in rows["short"].error
    ranks = [r.rank for r in plan.ranked.orderBy("rank").collect()]
    assert ranks == list(range(1, 7))


def test_stream_of_descriptions(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    pool = pool_df(spark, [person(i, ["SQL", "Python", "Kafka"], 5, "Hyderabad", 20) for i in range(4)])

    def run():
        shortlist_stream(
            jd_text_stream(spark, str(inbox)), pool, vocabulary(spark), out, str(tmp_path / "state"), top_k=3
        ).awaitTermination(240)

    (inbox / "one.txt").write_text(TEXT)
    run()
    time.sleep(0.1)
    (inbox / "two.txt").write_text(TEXT.replace("Senior", "Junior"))
    run()
    rows = spark.read.parquet(out).collect()
    assert {(r.job_id, r.batch) for r in rows} == {("one", 0), ("two", 1)} and len(rows) == 6
