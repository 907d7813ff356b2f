import random

from pyspark.sql import functions as F

from rosterwise.functions.numbers import clamp_text, py_round1, whole_text


def test_round_follows_python_on_ties_and_near_ties(spark):
    rng = random.Random(5)
    xs = [n / 20 for n in range(-200, 2400)] + [n * 0.4 for n in range(0, 1200)]
    xs += [a * 0.6 + b * 0.4 for a, b in ((rng.randrange(1000) / 10, rng.randrange(1000) / 10) for _ in range(3000))]
    xs += [rng.random() * 10 ** rng.randrange(-3, 5) for _ in range(2000)] + [33.35, 0.05, 0.15, 0.25, 99.95, 0.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", py_round1(F.col("x")).alias("r")).collect()
    assert [r.r for r in rows] == [round(r.x, 1) for r in rows]


def test_whole_text_and_clamped_text(spark):
    xs = [0.5, 1.5, 2.5, 12.4, 24.4, 24.5, 25.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(whole_text(F.col("x"))).collect()] == [f"{x:.0f}" for x in xs]
    df = spark.createDataFrame([(40.0,), (0.0,), (13.0,)], "x double")
    assert [r[0] for r in df.select(clamp_text(F.col("x"), 0, 40)).collect()] == ["40", "0", "13.0"]
