import random

import pytest
from pyspark.sql import functions as F

import plans
from fixtures import GOLD_JOB, GOLD_PERSON, job, jobs_df, person, pool_df

from rosterwise.operators import discovery, pool_index
from rosterwise.operators.cleaning import SchemaError
from rosterwise.operators.discovery import discover, location_pairs
from rosterwise.session import cut_lineage


def scored_by_hand(j, c):
    """Plain rules for one pair; None below the threshold."""
    req = {s.lower() for s in j.required_skills or []}
    nice = {s.lower() for s in j.nice_to_have or []}
    own = {s.lower() for s in c.skills or []}
    wanted = ("Any" if j.location is None else j.location).lower()
    here = (c.location or "").lower()
    low, high = j.experience_years.min or 0, j.experience_years.max or 10
    points, why = 0.0, []
    if req:
        points += len(req & own) / len(req) * 50
        why += [f"{len(req & own)} required skills match"] if len(req & own) >= 2 else []
    if nice:
        points += len(nice & own) / len(nice) * 15
        why += [f"{len(nice & own)} nice-to-have skills"] if nice & own else []
    years = c.experience_years or 0
    if low <= years <= high:
        points, why = points + 20, [*why, "Experience in range"]
    elif years >= low * 0.7:
        points, why = points + 10, [*why, "Experience close to range"]
    if "remote" in wanted or "any" in wanted:
        points += 15
    elif wanted in here or here in wanted:
        points, why = points + 15, [*why, "Location match"]
    else:
        points += 5
    return (round(points, 1), "; ".join(why) or "Partial skill match") if points >= 25 else None


def by_hand(jobs, pool, keep):
    out = {}
    people = sorted(pool.collect(), key=lambda c: (c.pool_order, c.candidate_id))
    for j in jobs.collect():
        found = [(c.candidate_id, *s) for c in people if (s := scored_by_hand(j, c))]
        out[j.job_id] = sorted(found, key=lambda f: -f[1])[:keep]
    return {k: v for k, v in out.items() if v}


def by_plan(jobs, pool, keep):
    out = {}
    for r in sorted(discover(jobs, pool, keep).collect(), key=lambda r: r.discovery_rank):
        out.setdefault(r.job_id, []).append((r.candidate_id, r.discovery_score, r.discovery_reason))
    return out


def random_case(spark, seed):
    rng = random.Random(seed)
    names = [f"S{i}" for i in range(14)] + ["Python", "SQL"]
    weights = [2 ** (-i / 3) for i in range(16)]
    places = ["Pune", "pune east", "Remote", "Germany", "", None, "Goa", "Bangalore (Hybrid)", "bangalore", "a"]

    def some(n):
        return list(dict.fromkeys(rng.choices(names, weights, k=rng.randrange(n + 1))))

    jobs = [
        job(
            f"J{i}", some(5) if rng.random() > 0.1 else None, some(3) if rng.random() > 0.1 else None, rng.choice(places),
            (rng.choice([0, 2, 5, None, -3]), rng.choice([0, None, 4, 7, 130]), None),
        )
        for i in range(25)
    ]
    jobs += [(f"copy{i}", *jobs[0][1:]) for i in range(8)]
    pool = [
        person(i, some(6) if rng.random() > 0.1 else None, rng.choice([0, 1, 3, 4, 6, 9, 120, 150, -2, None]), rng.choice(places))
        for i in range(150)
    ]
    pool += [person(1000 + i, ["Python", "SQL", "S0"], 3, "Pune") for i in range(60)]
    rng.shuffle(pool)
    return jobs_df(spark, jobs), pool_df(spark, pool)


@pytest.mark.parametrize("seed,keep", [(1, 5), (2, 30), (3, 1)])
def test_plan_equals_scoring_every_pair(spark, seed, keep):
    jobs, pool = random_case(spark, seed)
    assert by_plan(jobs, pool, keep) == by_hand(jobs, pool, keep)


def test_fractions_and_vast_numbers(spark):
    jobs, pool = random_case(spark, 5)
    part = lambda key: F.pmod(F.xxhash64(key), F.lit(8)) / 8
    years = F.col("experience_years")
    jobs = jobs.withColumn("experience_years", years.withField("min", years["min"] + part("job_id")))
    vast = F.when(F.pmod(F.xxhash64("candidate_id"), F.lit(5)) == 0, F.lit(3e9)).otherwise(F.lit(0.0))
    pool = pool.withColumn("experience_years", years + part("candidate_id") + vast)
    assert by_plan(jobs, pool, 4) == by_hand(jobs, pool, 4)


def test_same_result_with_tiny_salts_and_few_known_skills(spark, monkeypatch):
    monkeypatch.setattr(discovery, "FREQUENT", 6)
    monkeypatch.setattr(discovery, "SEEKERS_PER_SALT", 2)
    monkeypatch.setattr(discovery, "PAIRS_PER_CELL", 7)
    monkeypatch.setattr(discovery, "KEYED_PLACES", 2)
    monkeypatch.setattr(pool_index, "WORDS", 2)
    monkeypatch.setattr(pool_index, "BITS", 2)
    jobs, pool = random_case(spark, 4)
    assert by_plan(jobs, pool.repartition(7), 6) == by_hand(jobs, pool, 6)


def test_worked_example(spark):
    got = by_plan(jobs_df(spark, [GOLD_JOB]), pool_df(spark, [GOLD_PERSON]), 30)
    assert got == {"G": [("C001", 85.0, "3 required skills match; Experience in range; Location match")]}


def test_location_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("ab c") for _ in range(rng.randrange(0, 7))) for _ in range(150)})
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = location_pairs(df.toDF("j_loc"), df.toDF("c_loc")).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a in names for b in names if a in b or b in a)


def test_plan_has_no_product_and_cuts_before_shuffling(spark, capsys):
    jobs, pool = random_case(spark, 5)
    discover(jobs, pool, 5).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan


def test_driver_gets_small_plans_and_no_multiplied_rows(spark, monkeypatch):
    """Each step is a plan of one join or two, and rows that are multiplied in it are never broadcast."""
    written = []

    def cut(df):
        written.append(plans.lines(df))
        return cut_lineage(df)

    jobs, pool = random_case(spark, 5)
    index = pool_index.build_index(pool, keep=5)
    monkeypatch.setattr(discovery, "cut_lineage", cut)
    written.append(plans.lines(discover(jobs, index, 5)))
    assert max(map(len, written)) < 100
    made = [line for plan in written for part in plans.broadcast_parts(plan) for line in part]
    assert made and not [line for line in made if "Generate explode(sequence" in line]


def test_stored_index_serves_many_job_tables_and_grows(spark, tmp_path):
    jobs, pool = random_case(spark, 6)
    rows = sorted(pool.collect(), key=lambda c: c.pool_order)
    half = len(rows) // 2
    first = spark.createDataFrame(rows[:half], pool.schema)
    # A later file counts its rows from 0; the index puts them behind those it has.
    offset = rows[half - 1].pool_order + 1
    second = spark.createDataFrame(rows[half:], pool.schema).withColumn("pool_order", F.col("pool_order") - offset)
    index = pool_index.build_index(first, str(tmp_path / "index"), keep=6)
    assert by_plan(jobs, index, 6) == by_hand(jobs, first, 6)
    grown = index.extend(second)
    assert grown.segments == (0, 1) and grown.people.count() == len(rows)
    assert by_plan(jobs, grown, 6) == by_hand(jobs, pool, 6)
    again = pool_index.open_index(spark, str(tmp_path / "index"))
    some = jobs.filter("job_id like 'J1%'")
    assert by_plan(some, again, 4) == by_hand(some, pool, 4)
    with pytest.raises(ValueError, match="heads"):
        discover(jobs, again, 7)


def test_segment_without_manifest_does_not_count(spark, tmp_path):
    _, pool = random_case(spark, 7)
    path = str(tmp_path / "index")
    with pytest.raises(ValueError, match="no index"):
        pool_index.open_index(spark, path)
    index = pool_index.build_index(pool, path, keep=3)
    pool.write.parquet(f"{path}/segment-1/people")  # cut off before its end
    assert pool_index.open_index(spark, path).segments == (0,)
    more = index.extend(pool.limit(0))
    assert more.segments == (0, 1) and more.people.count() == pool.count()
    with pytest.raises(SchemaError):  # a pool without a row is an error, a later segment is not
        pool_index.build_index(pool.limit(0), keep=3)


@pytest.mark.parametrize("seed,keep", [(8, 3), (9, 12)])
def test_slices_of_the_pool_give_the_result_of_the_whole(spark, monkeypatch, seed, keep):
    monkeypatch.setattr(discovery, "FIRST_SLICE", 10)
    monkeypatch.setattr(discovery, "LONGER", 2)
    jobs, pool = random_case(spark, seed)
    assert by_plan(jobs, pool, keep) == by_hand(jobs, pool, keep)


def test_jobs_with_full_lists_leave_the_rest_of_the_pool_alone(spark, monkeypatch):
    """What meets of the pool doesn't grow with the profiles that come after a full list of best scores."""
    monkeypatch.setattr(discovery, "FIRST_SLICE", 40)
    jobs = jobs_df(spark, [job(f"J{i}", ["Python", "SQL"], ["Go"], "Remote", (2, 5, None)) for i in range(2)])
    pool = pool_df(spark, [person(i, ["Python", "SQL", "Go", f"S{i}"], 3 + i % 2) for i in range(400)])
    met, meet = [], discovery._meet

    def counted(seekers, postings, *rest):
        met.append(seekers.select("j_no").distinct().count() * postings.count())
        return meet(seekers, postings, *rest)

    monkeypatch.setattr(discovery, "_meet", counted)
    assert by_plan(jobs, pool, 5) == by_hand(jobs, pool, 5)
    assert 0 < sum(met) < 400
