import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterwise.llm import hard_negatives as hard


def brute(rows):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        said = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        best[i] = min(best.get(i, said), said)
    out = []
    for a in sorted(i for i in best if i % 100 == 0):
        label, q = best[a]
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other == label) for i, (other, v) in best.items() if i != a)
        for positive, p, _ in [s for s in scored if s[2]][:5]:
            fit = [s for s in scored if not s[2] and 80 * -positive <= 100 * -s[0] <= 100 * -positive][:5]
            out += [(a, p, rank, n, -positive, -score) for rank, (score, n, _) in enumerate(fit, 1)]
    return sorted(out)


def sample():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        label = 1 if i % 3 == 0 else int(rng.integers(0, 10))
        centre = np.eye(12)[label] * 0.6
        rows.append((i, [float(np.float32(x)) for x in centre + rng.normal(0, 0.3, 12)], label))
    rows += [(i, rows[100][1], int(rng.integers(0, 10))) for i in range(1500, 1620)]  # copies
    rows += [(3000, [0.0] * 12, 2), (3100, [-0.5] * 12, 1), (3200, [0.7] * 4, 1), (3300, [], 4), (3400, [1.0] * 12, 77)]
    rows += [rows[200], rows[200], (200, [9.0] * 12, 9)]
    rows += [(3500, None, 1), (3600, [1.0] * 12, None), (None, [1.0] * 12, 1), (3700, [None] * 12, 1), (3800, [float("nan")] * 12, 1),
             (3900, [float("inf")] * 12, 1), (-100, rows[100][1], 1)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, block int, anchor string, vec int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(6)


def test_against_brute_force(spark):
    rows = sample()
    df, want = frame(spark, rows), brute(rows)
    assert len(want) > 200
    assert sorted(map(tuple, hard.hard_negatives(df).collect())) == want
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    ready = hard.candidates(df, label, F.col("vec_id") % 100 == 0)
    small = hard.mine(ready, block=8, shard=3, group=4)
    assert sorted(map(tuple, small.collect())) == want


def test_few_rows_and_none(spark):
    rows = [r for r in sample() if r[0] in (100, 3, 6, 9, 40)]
    assert sorted(map(tuple, hard.hard_negatives(frame(spark, rows)).collect())) == brute(rows)
    assert hard.hard_negatives(frame(spark, rows).limit(0)).count() == 0
    assert hard.hard_negatives(frame(spark, [(100, [1.0], 1)])).count() == 0
    assert hard.hard_negatives(frame(spark, [(100, [], 1), (101, [], 1), (102, [], 2)])).count() == 1


def test_scores_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        hard.hard_negatives(frame(spark, [(100, [1e30], 1), (101, [1e30], 1)])).count()


def test_curve_visits_neighbours():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = hard.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_zone_maps_bound_and_prune(spark):
    """Bounds hold for every row of a block, and blocks out of a window's reach are not chosen."""
    rng = np.random.default_rng(5)
    anchors = rng.integers(-50, 50, (7, 6)).astype(np.int32)
    rows = rng.integers(-50, 50, (40, 6)).astype(np.int32)
    least, most = hard.bounds(anchors, rows.min(0)[None, :], rows.max(0)[None, :])
    scores = anchors.astype(int) @ rows.T
    assert (least[:, 0] <= scores.min(1)).all() and (most[:, 0] >= scores.max(1)).all()
    requests = spark.createDataFrame([(0, 1, 5, [1, 0], [90], [100])], "group int, anchor_id long, label long, vec array<int>, lows array<long>, highs array<long>").toPandas()
    zones = spark.createDataFrame(
        [(1, 1, 2, [0, 0], [89, 9]), (1, 2, 2, [80, 0], [90, 9]), (1, 3, 5, [80, 0], [90, 9]), (1, 4, 2, [101, 0], [120, 9])],
        "shard long, block long, label long, low array<int>, high array<int>",
    ).toPandas()
    assert list(hard._choosing(False)(requests, zones)["block"]) == [2]
    assert list(hard._choosing(True)(requests, zones)["block"]) == [3]
