"""Spark queries against their SQL twins on the smallest tables.

``python tests/compare.py SF_DIR`` runs every query; here are the light ones and the ones
whose plans contain all the others.
"""

import compare
import pytest

import __spark_entry__ as driver

FULL = ["discovery_topk", "match_factors", "interest_scores", "flat_shortlist", "job_funnel"]
SHORT = [
    "skill_expansion", "fuzzy_pairs", "bias_issues", "bias_issues_own_lexicon", "bias_report", "market_intel",
    "question_and_length_stats", "transcript_markers", "pool_stats", "pool_locations", "top_locations",
    "experience_bands", "clean_pool", "generate_pool", "jd_extraction", "jd_decode", "jd_rejects", "jd_skill_scan",
]


@pytest.mark.parametrize("name", SHORT + FULL)
def test_same_rows(spark, sf_dir, name):
    query, sql = driver.queries()[name], driver.oracle_sql()[name]
    assert compare.differences(query(spark, sf_dir), compare.connect(sf_dir), sql) is None


def test_every_twin_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
