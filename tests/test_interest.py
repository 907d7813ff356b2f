import random

import plans
import pytest
from fixtures import GOLD_JOB, GOLD_PERSON, job, jobs_df, person, pool_df, turns_df
from pyspark.sql import functions as F

from rosterwise.operators import interest as I
from rosterwise.operators.matching import match_pairs
from rosterwise.operators.ranking import rank_candidates
from rosterwise.operators.transcripts import personas, templated_transcripts
from rosterwise.plans.shortlist import build_shortlist, discover_and_match
from rosterwise.session import cut_lineage


def matched(spark, jobs, pool):
    pairs = spark.createDataFrame(
        [(j[0], p[0], n) for j in jobs for n, p in enumerate(pool, 1)],
        "job_id string, candidate_id string, discovery_rank int",
    )
    return match_pairs(pairs, jobs_df(spark, jobs), pool_df(spark, pool)).withColumn("match_rank", F.col("discovery_rank"))


def test_worked_example_from_pool_to_rank(spark):
    jobs, pool = jobs_df(spark, [GOLD_JOB]), pool_df(spark, [GOLD_PERSON])
    talks = templated_transcripts(discover_and_match(jobs, pool)[1], jobs)
    plan = build_shortlist(jobs, pool, talks)
    signals = plan.interest.collect()[0]
    assert (signals.enthusiasm_score, signals.engagement_score, signals.commitment_score) == (30.0, 13.0, 30.0)
    assert signals.total_interest_score == 73.0
    assert signals.conversation_preview == "Enthusiasm: 30.0/40 | Engagement: 13.0/30 | Commitment: 30/30"
    assert set(signals.positive_signals) >= {"Enthusiasm marker: 'aligned with'", "Self-identified skill fit: python"}
    best = plan.ranked.collect()[0]
    assert (best.rank, best.combined_score, best.tier) == (1, 84.8, "FAST-TRACK")


def test_unrounded_score_sets_the_tier_and_rounded_the_display(spark):
    matches = matched(spark, [GOLD_JOB], [GOLD_PERSON]).withColumn("match_score", F.lit(92.6))
    signals = I.score_interest(matches, templated_transcripts(matches, jobs_df(spark, [GOLD_JOB])))
    row = rank_candidates(matches, signals.withColumn("total_interest_score", F.lit(73.5))).collect()[0]
    assert row.combined_score == 85.0 and row.tier == "FAST-TRACK" and row.display_tier == "🔥 PRIORITY"


def test_missing_transcript_and_silent_candidate(spark):
    matches = matched(spark, [GOLD_JOB], [person(1, ["Go"], notice=None), person(2, ["Go"], notice=90)])
    talks = turns_df(spark, [("G", "C2", 1, "recruiter", "Are you excited about Go?")])
    got = {r.candidate_id: r for r in I.score_interest(matches, talks).collect()}
    assert got["C1"].total_interest_score == 45.0 and not got["C1"].conversation_completed
    assert got["C1"].negative_signals == ["Conversation simulation failed"]
    quiet = got["C2"]
    assert (quiet.enthusiasm_score, quiet.engagement_score, quiet.commitment_score) == (20.0, 5.0, 12.0)
    assert quiet.negative_signals == ["Long notice period (3+ months)", "Very short responses (low engagement)"]


def test_talks_are_folded_before_the_scores_are_planned(spark):
    matches = cut_lineage(matched(spark, [GOLD_JOB], [person(1, ["Go"])]))
    talks = turns_df(spark, [("G", "C1", 1, "candidate", "I love Go. When can we talk?")])
    scores = I.score_interest(matches, talks)
    assert not [line for line in plans.lines(scores) if "collect_list" in line]
    assert scores.first().questions_asked == 1


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_chunks_give_what_the_whole_text_gives(spark, monkeypatch, chunk):
    monkeypatch.setattr(I, "TURNS_PER_CHUNK", chunk)
    rng = random.Random(chunk)
    words = ["not", "sure", "open", "to", "can", "join", "?", "x", "", "love", "LEARNING", "go", "we"]
    rows = [
        ("J", f"C{c}", t * rng.choice([1, 1, 2]) + 100 * t, rng.choice(["candidate", "candidate", "recruiter"]), " ".join(rng.choices(words, k=rng.randrange(0, 4))))
        for c in range(40) for t in range(rng.randrange(1, 25))
    ]
    # 70 markers need two words of bits.
    markers = I.Markers(
        ["not sure", "open to", "can join", "love to", "learning", "sure open to can join", "x x x", "  "],
        [f"absent {i}" for i in range(60)], ["to can"], ["go we"], [],
    )
    skills = F.array(F.lit("go"), F.lit("learning"), F.lit("sure open"))
    talks = turns_df(spark, rows).withColumn("known", skills)
    got = {r.candidate_id: r for r in I.transcript_signals(talks, ["job_id", "candidate_id"], markers, "known").collect()}
    assert len(got) == 40
    for c, r in got.items():
        said = [row[4] for row in sorted(rows, key=lambda row: row[2]) if row[1] == c and row[3] == "candidate"]
        text = " ".join(m.lower() for m in said)
        assert r.found == [t for t in dict.fromkeys(markers.all()) if said and t in text]
        assert (r.n, r.chars, r.questions) == (len(said), sum(map(len, said)), text.count("?"))
        assert set(r.mentioned) == {s for s in ("go", "learning", "sure open") if any(s in m.lower() for m in said)}


def test_talks_without_a_job_count_for_every_job_of_their_candidate(spark):
    matches = spark.createDataFrame([("a", "p"), ("b", "p"), ("a", "q")], "job_id string, candidate_id string")
    talks = spark.createDataFrame([("p", 1, "hi"), ("p", 2, None), ("x", 1, "no")], "candidate_id string, turn int, message string")
    rows = I.for_each_job(matches, talks).select("job_id", "candidate_id", "turn", "message").collect()
    assert {tuple(r) for r in rows} == {(j, "p", *t) for j in "ab" for t in ((1, "hi"), (2, None))} and len(rows) == 4
    kept = talks.withColumn("job_id", F.lit("b"))
    assert I.for_each_job(matches, kept) is kept


def test_template_and_persona(spark):
    jobs = [job("J", ["go", "SQL"], pay=(5, 12), location="Goa", title="Data Engineer"), job("K", ["Rust"], pay=None)]
    pool = [person(1, ["Java", "Sql", "Go"], salary=12, notice=45), person(2, [], salary=1, notice=None)]
    matches = matched(spark, jobs, pool)
    turns = templated_transcripts(matches, jobs_df(spark, jobs)).collect()
    text = {(r.job_id, r.candidate_id, r.turn): r.message for r in turns}
    assert len(turns) == 24
    assert "especially around Sql." in text["J", "C1", 1] and "Person 1" in text["J", "C1", 1]
    assert "I am very interested" in text["J", "C1", 2] and "around Java." in text["K", "C1", 1]
    assert "the required stack" in text["K", "C2", 3] and "around 30 days" in text["K", "C2", 6]
    assert "looks aligned" in text["J", "C1", 6] and "compensation range" in text["K", "C1", 6]
    who = {(r.job_id, r.candidate_id): r for r in personas(matches, jobs_df(spark, jobs)).collect()}
    assert who["J", "C1"].segment == "enthusiastic" and who["J", "C2"].segment == "non-committal"
    assert who["J", "C1"].persona.endswith("Notice period: 45 days. Salary expectation: ₹12 LPA. Salary is within budget.")


def test_documents_say_what_goes_on_in_chunks(spark, monkeypatch):
    from rosterwise.operators import report

    monkeypatch.setattr(report, "CHUNK_TURNS", 3)
    talks = [("G", "C001", t, "candidate", f"message {t}") for t in range(7)]
    talks += [("G", "C2", t, "candidate", f"message {t}") for t in (2, 1)]
    pool = pool_df(spark, [GOLD_PERSON, person(2, ["Python", "LLM"], 4, "Bangalore", 20)])
    plan = build_shortlist(jobs_df(spark, [GOLD_JOB]), pool, turns_df(spark, talks))
    people = {c.candidate_id: c for c in plan.documents().collect()[0].candidates}
    assert [t.turn for t in people["C001"].conversation_transcript] == [0, 1, 2] and people["C001"].conversation_turns == 7
    assert [t.turn for t in people["C2"].conversation_transcript] == [1, 2] and people["C2"].conversation_turns == 2
    chunks = {(r.candidate_id, r.chunk): [t.turn for t in r.turns] for r in plan.transcript_chunks().collect()}
    assert chunks == {("C001", 0): [0, 1, 2], ("C001", 1): [3, 4, 5], ("C001", 2): [6], ("C2", 0): [1, 2]}
    assert plan.turns().count() == 9


def test_chunks_number_turns_within_slices(spark, monkeypatch):
    from rosterwise.operators import report

    monkeypatch.setattr(report, "CHUNK_TURNS", 4)
    numbers = [None, None, -3, 0, 1, 1, 1, 2, 9, 9, 40, 41, 42, 43, 44, 45, 900]
    said = [("j", "c", n, "s", f"m{i:02d}", "x") for i, n in enumerate(numbers)] + [("j", "d", 5000, "s", "only", "x")]
    turns = spark.createDataFrame(said, "job_id string, candidate_id string, turn int, speaker string, message string, intent string")
    ranked = spark.createDataFrame([("j", "c", 1), ("j", "d", 2)], "job_id string, candidate_id string, rank int")
    chunks = report.transcript_chunks(ranked, turns)
    got = {(r.candidate_id, r.chunk): [t.message for t in r.turns] for r in chunks.collect()}
    names = [f"m{i:02d}" for i in range(len(numbers))]
    assert got == {("c", i // 4): names[i : i + 4] for i in range(0, len(names), 4)} | {("d", 0): ["only"]}
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [row_number()" in x]
    assert windows and all("_slice" in x for x in windows)


def test_without_talks_every_pair_has_the_default_signals(spark):
    plan = build_shortlist(jobs_df(spark, [GOLD_JOB]), pool_df(spark, [GOLD_PERSON]))
    signals = plan.interest.collect()[0]
    assert (signals.enthusiasm_score, signals.engagement_score, signals.commitment_score) == (20.0, 10.0, 15.0)
    assert not signals.conversation_completed and plan.turns().count() == 0
    assert plan.documents().collect()[0].candidates[0].conversation_transcript is None


def test_a_talk_is_folded_once_however_many_jobs_match(spark, monkeypatch):
    folded = []
    plain = I.transcript_signals

    def counted(turns, *args):
        folded.append(turns.count())
        return plain(turns, *args)

    monkeypatch.setattr(I, "transcript_signals", counted)
    jobs = [job(f"J{i}", ["Go", "SQL"]) for i in range(1000)]
    pool = [person(1, ["Go", "Rust"]), person(2, ["SQL"], notice=90), person(3, ["Go"])]
    matches = matched(spark, jobs, pool)
    said = [(None, "C1", t, "candidate", f"I love Go? open to {t}") for t in range(5)] + [(None, "C2", 0, "candidate", "not sure")]
    talks = turns_df(spark, said).drop("job_id")
    got = {(r.job_id, r.candidate_id): tuple(r)[2:] for r in I.score_interest(matches, talks).collect()}
    assert folded == [6] and len(got) == 3000
    copied = matches.select("job_id", "candidate_id").join(talks, "candidate_id")
    assert got == {(r.job_id, r.candidate_id): tuple(r)[2:] for r in I.score_interest(matches, copied).collect()}
    assert folded == [6, 6000]
    assert all(got[f"J{i}", "C1"] == got["J0", "C1"] for i in range(1000)) and got["J7", "C1"] != got["J7", "C2"]


def test_one_id_with_two_sets_of_skills(spark):
    """Skills said are those of the row that was matched, also where an id stands for two people."""
    matches = matched(spark, [job("A", ["Go"])], [person(1, ["Go"])]).union(matched(spark, [job("B", ["Rust"])], [person(1, ["Rust"])]))
    talks = turns_df(spark, [(None, "C1", 0, "candidate", "go and rust")]).drop("job_id")
    got = {r.job_id: r.positive_signals for r in I.score_interest(matches, talks).collect()}
    assert "Self-identified skill fit: go" in got["A"] and "Self-identified skill fit: rust" in got["B"]
    assert "Self-identified skill fit: rust" not in got["A"] and "Self-identified skill fit: go" not in got["B"]
