import json

import pytest
from fixtures import GOLD_JOB, GOLD_PERSON, jobs_df, person, pool_df, turns_df
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rosterwise.functions.constants import POOL_HEADERS
from rosterwise.operators import cleaning
from rosterwise.operators.pool_index import build_index
from rosterwise.operators.poolstats import experience_bands, pool_locations, pool_stats, source_files, top_locations
from rosterwise.operators.report import whole_documents
from rosterwise.operators.transcripts import templated_transcripts
from rosterwise.plans.shortlist import build_shortlist, discover_and_match
from rosterwise.schemas import CANDIDATES
from rosterwise.sources.pool import open_pool, read_pool, scan_pool, with_file_order
from rosterwise.sources.sinks import read_document_parts, write_document_parts, write_reports, write_table
from rosterwise.sources.texts import read_jd_texts
from rosterwise.streaming.jd_stream import jd_text_stream, shortlist_stream

HEADER = ",".join(POOL_HEADERS.values())


def test_csv_pool_is_cleaned_in_file_order(spark, tmp_path):
    lines = [
        HEADER,
        'K7,Asha Rao,a@x,1,Pune,4.9,Dev,Co," Go ,, SQL ",BSc,12.2,15,l,g,b,Remote,Open',
        ",,,,,,,,,,,,,,,,",
        "K8,,a@x,1,Pune,4,Dev,Co,Go,BSc,12,15,l,g,b,Remote,Open",
        ",Ben Roy,,,,many,,,,,,soon,,,,,",
    ]
    path = tmp_path / "pool.csv"
    path.write_text("\n".join(lines))
    rows = read_pool(spark, str(path), strict=True).orderBy("pool_order").collect()
    assert rows[0].__fields__ == CANDIDATES.names
    asha, ben = rows
    assert (asha.candidate_id, asha.experience_years, asha.salary_expectation_lpa, asha.skills) == ("K7", 4, 12, ["Go", "SQL"])
    assert (ben.candidate_id, ben.experience_years, ben.notice_period_days, ben.skills) == ("C0005", 0, 30, [])
    assert (ben.location, ben.current_role, ben.education, ben.bio, ben.phone) == ("Unknown", "Software Engineer", "B.Tech", "", None)


def test_file_order_does_not_depend_on_splits(spark, tmp_path):
    for part in range(3):
        lines = ["n,name"] + [f"{part * 400 + i},name {i}" for i in range(400)]
        (tmp_path / f"part{part}.csv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "4k", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = with_file_order(scan_pool(spark, str(tmp_path), "csv"))
            assert got.count() == 1200
            assert got.filter(F.col("pool_order") != F.col("n").cast("bigint")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_json_pool_and_default_choice(spark, tmp_path):
    people = [{"id": f"C{i:03d}", "name": f"P{i}", "skills": ["Go"], "experience_years": i} for i in range(5)]
    (tmp_path / "candidates.json").write_text(json.dumps(people))
    rows = open_pool(spark, str(tmp_path)).orderBy("pool_order").collect()
    assert [r.candidate_id for r in rows] == [p["id"] for p in people]
    assert rows[3].location is None and rows[3].experience_years == 3
    (tmp_path / "candidates.csv").write_text("Name,Exp Years\nZoe,2\n")
    assert [r.name for r in open_pool(spark, str(tmp_path)).collect()] == ["Zoe"]
    assert open_pool(spark, "unused", str(tmp_path / "candidates.json")).count() == 5
    with pytest.raises(ValueError, match="unsupported pool format"):
        read_pool(spark, str(tmp_path / "candidates.xml"))
    files = source_files(scan_pool(spark, str(tmp_path / "candidates.csv"))).collect()[0]
    assert (files.file_name, files.rows) == ("candidates.csv", 1)


def test_header_rules():
    good = list(POOL_HEADERS.values())
    assert cleaning.header_problem(good) is None
    assert cleaning.header_problem([*good[1:], "Employee ID"]).endswith("Missing columns: ID.")
    assert "(Shoe Size)" in cleaning.header_problem([*good, "Shoe Size"])
    assert "(extra columns)" in cleaning.header_problem([*good, "Role"])
    assert "no header row" in cleaning.header_problem([None, " "])
    few = cleaning.header_problem(["Name"])
    assert few.endswith("Missing columns: ID, Email, Phone, Location, Experience (Years), Current Role.")


def test_later_alias_wins_where_it_is_set(spark):
    df = spark.createDataFrame([("1", None, "A", 0), ("2", "3", "B", 1)], "Salary string, `Salary (LPA)` string, NAME string, pool_order bigint")
    assert [r.salary_expectation_lpa for r in cleaning.clean_pool(df).orderBy("pool_order").collect()] == [1, 3]


def test_empty_pool_is_rejected(spark):
    with pytest.raises(cleaning.SchemaError, match="no valid candidate rows"):
        cleaning.require_rows(pool_df(spark, []))
    jobs = jobs_df(spark, [GOLD_JOB])
    with pytest.raises(cleaning.SchemaError, match="no valid candidate rows"):
        build_shortlist(jobs, pool_df(spark, []))
    stats = pool_stats(pool_df(spark, [])).collect()[0]
    assert tuple(stats) == (0, 0, 0.0, 0.0)


def test_statistics(spark):
    pool = pool_df(spark, [person(i, exp=e, location=loc, salary=s) for i, (e, loc, s) in enumerate(
        [(1, "Goa", 5), (3, "Pune", 6), (6, None, 7), (12, "Pune", 9), (2, "Goa", 1)])])
    assert tuple(pool_stats(pool).collect()[0]) == (5, 3, 4.8, 5.6)
    assert {tuple(r) for r in pool_locations(pool).collect()} == {("Goa", 2), ("Pune", 2), ("Unknown", 1)}
    assert [tuple(r) for r in top_locations(pool, 2).collect()] == [("Goa", 2), ("Pune", 2)]
    assert {r.band[:3]: r.candidates for r in experience_bands(pool).collect()} == {"Jun": 2, "Mid": 1, "Sen": 1, "Lea": 1}


def test_sinks_and_text_source(spark, tmp_path):
    jobs, pool = jobs_df(spark, [(*GOLD_JOB[:-1], "x" * 60)]), pool_df(spark, [GOLD_PERSON])
    plan = build_shortlist(jobs, pool, templated_transcripts(discover_and_match(jobs, pool)[1], jobs))
    write_reports(plan.documents(), str(tmp_path / "reports"))
    document = json.loads("".join(f.read_text() for f in (tmp_path / "reports").glob("part*.json")))
    assert document["job_title"] == "Senior AI Engineer" and document["summary"]["fast_track"] == 1
    person_out = document["candidates"][0]
    assert person_out["rank"] == 1 and len(person_out["conversation_transcript"]) == 6
    assert set(person_out["factor_breakdown"]["skills"]) == {"score", "max", "percentage", "note"}
    assert document["bias_analysis"]["issues_found"] == 0 and document["market_intelligence"]["role_category"] == "ai"
    write_table(plan.flat(), str(tmp_path / "flat"))
    header, row = "".join(f.read_text() for f in (tmp_path / "flat").glob("part*.csv")).splitlines()
    assert header.startswith("job_id,Rank,Name,Combined Score") and row.startswith("G,1,Priya Sharma,84.8,92.7,73.0")
    write_table(plan.summary(), str(tmp_path / "summary"), "parquet")
    assert spark.read.parquet(str(tmp_path / "summary")).count() == 9
    with pytest.raises(ValueError):
        write_table(plan.flat(), str(tmp_path / "x"), "xlsx")
    (tmp_path / "jds").mkdir()
    (tmp_path / "jds" / "first.txt").write_text("line one\nline two")
    assert [tuple(r) for r in read_jd_texts(spark, str(tmp_path / "jds")).collect()] == [("first", "line one\nline two")]


def test_texts_of_other_folders_keep_their_own_ids(spark, tmp_path):
    for folder in ("a", "b/c"):
        (tmp_path / "all jds" / folder).mkdir(parents=True)
        (tmp_path / "all jds" / folder / "jd.txt").write_text(folder)
    rows = read_jd_texts(spark, str(tmp_path / "all jds")).collect()
    assert {tuple(r) for r in rows} == {("a/jd", "a"), ("b/c/jd", "b/c")}


def test_cells_are_read_as_numbers_or_not_at_all(spark):
    df = spark.createDataFrame(
        [("5f", "a,\tb\n", 0), (" 7.9 ", "x", 1), ("1e1", None, 2), ("NaN", "", 3), ("Infinity", "", 4), ("3000000000.5", "", 5)],
        "experience string, skills string, pool_order bigint",
    ).selectExpr("*", "'N' AS name")
    rows = cleaning.clean_pool(df).orderBy("pool_order").collect()
    assert [r.experience_years for r in rows] == [0, 7, 10, 0, 0, 3000000000]
    assert rows[0].skills == ["a", "b"]


def test_numbers_in_json_pools_stay_as_given(spark, tmp_path):
    person = {"id": "A", "name": "N", "experience_years": 3.5, "salary_expectation_lpa": 18.5, "notice_period_days": 3000000000}
    (tmp_path / "p.json").write_text(json.dumps([person]))
    row = read_pool(spark, str(tmp_path / "p.json")).collect()[0]
    assert (row.candidate_id, row.experience_years, row.salary_expectation_lpa, row.notice_period_days) == ("A", 3.5, 18.5, 3000000000)


def test_transcripts_of_any_length_come_back_whole(spark, tmp_path):
    talks = [(None, "C001", None, "candidate", "no number")] + [(None, "C001", t, "candidate", f"message {t}") for t in range(5000)]
    talks += [(None, "C2", 0, "recruiter", None)]
    pool = pool_df(spark, [GOLD_PERSON, person(2, ["Python", "LLM"], 4, "Bangalore", 20), person(3, ["Python", "LLM"], 4, "Goa", 20)])
    jobs = [GOLD_JOB, ("H", *GOLD_JOB[1:])]
    plan = build_shortlist(jobs_df(spark, jobs), pool, turns_df(spark, talks).drop("job_id"))
    path = str(tmp_path / "parts")
    write_document_parts(plan.document_parts(), path)
    parts = read_document_parts(spark, path)
    assert parts.filter("candidate_id = 'C001'").count() == 2 * 6 and parts.agg({"chunk": "max"}).collect()[0][0] == 5
    whole = {r.job_id: r for r in whole_documents(parts).collect()}
    assert set(whole) == {"G", "H"}
    for r in whole.values():
        head = json.loads(r.head)
        assert [c["candidate_id"] for c in head["candidates"]][:2] and "conversation_transcript" not in head["candidates"][0]
        said = {t.candidate_id: [(x.turn, x.message) for x in t.turns] for t in r.transcripts}
        assert said == {"C001": [(None, "no number"), *[(t, f"message {t}") for t in range(5000)]], "C2": [(0, None)]}
    # A part that is gone is noticed.
    lost = str(tmp_path / "lost")
    write_document_parts(plan.document_parts(), lost)
    parts.filter("chunk <> 3").write.mode("overwrite").parquet(f"{lost}/parts")
    with pytest.raises(ValueError, match="manifest"):
        read_document_parts(spark, lost)
    with pytest.raises(AnalysisException):
        read_document_parts(spark, str(tmp_path / "nothing"))


def test_two_batches_read_the_pool_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = pool_df(spark, [GOLD_PERSON, *[person(i, ["Python", "LLM"], 4, "Bangalore", 20) for i in range(2, 30)]])
    pool = rows.mapInArrow(counted, rows.schema)
    texts = tmp_path / "jds"
    texts.mkdir()
    body = "Job Title: Senior AI Engineer\n\nLocation: Bangalore\n\nRequirements:\n- 3-6 years of practice\n- Python\n- LLM\n"
    skills = spark.createDataFrame([("Python",), ("LLM",)], "skill string")
    index = build_index(pool, str(tmp_path / "index"), keep=30)
    out = str(tmp_path / "out")
    for name in ("first", "second"):
        (texts / f"{name}.txt").write_text(body)
        query = shortlist_stream(jd_text_stream(spark, str(texts)), index, skills, out, str(tmp_path / "state"))
        query.awaitTermination()
    found = spark.read.parquet(out)
    assert found.select("batch").distinct().count() == 2 and found.groupBy("job_id").count().collect()[0][1] == 10
    assert read.value == 29
