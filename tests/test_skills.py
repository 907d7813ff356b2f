import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from rosterwise.functions.skills import canonical, closure, expand
from rosterwise.operators.fuzzy import fuzzy_pairs
from rosterwise.operators.matching import semantic_overlap


def test_expansion_takes_every_entry_but_is_not_transitive(spark):
    table = closure()
    assert table["python"] == ["py", "python", "python3"]
    assert table["rest apis"] == ["rest", "rest api", "rest apis", "restful"]
    df = spark.createDataFrame([(["  Python", "Rust", None, "Rust"],), (None,)], "s array<string>")
    assert [r[0] for r in df.select(expand(F.col("s"))).collect()] == [["py", "python", "python3", "rust"], []]


def test_canonical(spark):
    df = spark.createDataFrame([("React.js",), (" Node JS ",), ("Go",)], "s string")
    assert [r[0] for r in df.select(canonical(F.col("s"))).collect()] == ["react", "node", "go"]


def alike(a, b):
    return a != b and SequenceMatcher(None, a, b).ratio() >= 0.85


@pytest.mark.parametrize("seed", range(3))
def test_fuzzy_pairs_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    names = {"cicd", "ci/cd", "react.js", "reactjs", "old bolt", "cold bolt", "postgres", "postgresql"}
    while len(names) < 220:
        word = "".join(rng.choice("abc /") for _ in range(rng.randrange(1, 24))).strip()
        if word:
            names.add(word)
            spot = rng.randrange(len(word) + 1)
            names.add((word[:spot] + rng.choice(["", "x", "yz"]) + word[spot + rng.randrange(2):]) or "q")
    df = spark.createDataFrame([(n,) for n in sorted(names)], "n string")
    got = fuzzy_pairs(df.select(F.col("n").alias("jd_skill")), df.select(F.col("n").alias("cand_skill"))).collect()
    assert {(r.jd_skill, r.cand_skill) for r in got} == {(a, b) for a in names for b in names if alike(a, b)}
    assert len(got) == len({(r.jd_skill, r.cand_skill) for r in got})


def test_overlap_counts_pairs_and_may_pass_100(spark):
    rows = [(1, ["kubernetes admin"], ["kubernetes admins", "kubernetes admin1"]), (2, [], ["Go"]), (3, ["Go"], None)]
    df = spark.createDataFrame(rows, "k int, jd_skills array<string>, cand_skills array<string>")
    got = {r.k: r.overlap for r in semantic_overlap(df, ["k"]).collect()}
    assert got[1].match_percentage == 200.0 and got[1].unmatched_jd_skills == []
    assert got[2].match_percentage == 0.0 and got[2].total_jd_skills == 0
    assert got[3].unmatched_jd_skills == ["go"]
