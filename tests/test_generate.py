from pyspark.sql import functions as F

from rosterwise.operators.cleaning import clean_pool, header_problem
from rosterwise.operators.generate import DOMAIN_WEIGHTS, EXPERIENCE_WEIGHTS, generate_candidates


def test_rows_depend_on_seed_and_id_only(spark):
    ids = spark.range(300)
    one = {tuple(r) for r in generate_candidates(ids, 1).collect()}
    assert one == {tuple(r) for r in generate_candidates(ids.repartition(7), 1).collect()}
    assert {tuple(r) for r in generate_candidates(ids.filter("id < 20"), 1).collect()} < one
    assert one != {tuple(r) for r in generate_candidates(ids, 2).collect()}


def test_distributions_and_uniqueness(spark):
    pool = generate_candidates(spark.range(6000), 3).cache()
    n = pool.count()
    assert pool.select("email").distinct().count() == n
    for column, weights in [("domain", DOMAIN_WEIGHTS), ("experience_years", EXPERIENCE_WEIGHTS)]:
        share = {r[0]: r[1] / n for r in pool.groupBy(column).count().collect()}
        total = sum(weights.values())
        assert all(abs(share[k] - w / total) < 0.025 for k, w in weights.items())
    assert pool.filter("experience_years <= 2 and current_role like '%Senior%'").count() == 0
    assert pool.filter("experience_years >= 7 and current_role like '%Junior%'").count() == 0
    assert pool.filter("bio like '%{%' or skills = ''").count() == 0
    blank = pool.filter("github = ''").count() / n
    assert 0.25 < blank < 0.35
    sizes = pool.select(F.size(F.split("skills", ", ")).alias("k"))
    assert sizes.filter("k > 10 or k < 4").count() == 0


def test_generated_pool_passes_its_own_check(spark):
    pool = generate_candidates(spark.range(50), 3)
    assert header_problem([c for c in pool.columns if c != "domain"]) is None
    cleaned = clean_pool(pool.withColumn("pool_order", F.expr("cast(substring(id, 2) as bigint) - 1")))
    assert cleaned.count() == 50 and cleaned.filter("size(skills) = 0").count() == 0
