"""Pairs of bundles against brute force, with frequent items in tiles, wide bundles, and rows that lack something."""

import random

import numpy as np
import pytest

from scriptorium.operators import linkage, meetings


def bundles(seed, widest):
    rng = random.Random(seed)
    rows = [(b, i, rng.choice([None, 0.0, 1.0, 2.0, 4.0, 32.0])) for b in range(60) for i in rng.sample(range(30), rng.randint(1, widest))]
    # All have one item, two lack theirs, and some rows lack a bundle.
    return [*rows, *((b, 99, 1.0) for b in range(60)), (3, None, 1.0), (4, None, 1.0), (None, 5, 1.0), (None, 99, 1.0), (77, None, 2.0)]


def by_force(rows):
    held = {}
    for b, i, d in rows:
        if b is not None:
            held.setdefault(b, {})[i] = d
    for a in held:
        for b in held:
            both = [i for i in held[a] if i is not None and i in held[b]]
            if a < b and both:
                near = sum(min(x, y) / max(x, y) for i in both if (x := held[a][i] or 0) > 0 and (y := held[b][i] or 0) > 0)
                yield a, b, len(both), sum(held[a][i] != held[b][i] for i in both), near, len(held[a]), len(held[b])


@pytest.mark.parametrize("widest, side", [(4, 1000), (4, 7), (20, 7)])
def test_pairs_and_nearest_equal_brute_force(spark, widest, side):
    rows = bundles(widest, widest)
    one = spark.createDataFrame(rows, "bag long, item long, dose double")
    want = sorted(by_force(rows))
    got = sorted(tuple(r) for r in meetings.pairs(one, side=side).select("a", "b", "shared", "changed", "closeness", "na", "nb").collect())
    assert [(*r[:4], *r[5:]) for r in got] == [(*r[:4], *r[5:]) for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want])
    few = meetings.pairs(one, linkage.little_changed(3), side)
    assert sorted((r["a"], r["b"]) for r in few.collect()) == [(a, b) for a, b, s, c, _, na, nb in want if 0 < na + nb - 2 * s + c <= 3]

    scores = {}
    for a, b, s, _, near, na, nb in want:
        for x, y in ((a, b), (b, a)):
            scores.setdefault(x, []).append((-meetings.rounded(np.array([near / (na + nb - s)]), 6)[0], y))
    best = {r["bag"]: (r["other"], r["score"]) for r in meetings.nearest(one, side=side).collect()}
    assert best == {x: (min(s)[1], -min(s)[0] / 10**6) for x, s in scores.items()}


def test_rounding_is_spark_s(spark):
    values = [0.0078125, 0.0234375, 1 / 3, 0.1234565, 0.1234575, 0.0, 1.0, 0.9999995, 0.0000005]
    want = [r["x"] for r in spark.createDataFrame([(x,) for x in values], "x double").selectExpr("round(x, 6) AS x").collect()]
    assert (meetings.rounded(np.array(values), 6) / 10**6).tolist() == want


def test_no_pair_of_bundles_is_shuffled(spark):
    """What stands above the exchange by tiles keeps its rows where they are."""
    one = spark.createDataFrame([(b, i, 1.0) for b in range(9) for i in range(3)], "bag long, item long, dose double")
    plan = meetings.pairs(one)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("RepartitionByExpression")]
    assert "MapInArrow" in above and "Join" not in above and "Aggregate" not in above
