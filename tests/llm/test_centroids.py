"""Clusters against a loop in whole numbers of any size."""

import hashlib
import math
import random

import pytest

from weftline.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, key string"


def by_hand(rows, k, rounds, size):
    sound = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v) for i, v in sound)
    points = [v for _, _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(points))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in sound]
        held = [[v for (_, v), a in zip(sound, at, strict=True) if a == j] for j in range(len(points))]
        points = [[sum(x) // len(h) for x in zip(*h, strict=True)] if h else p for h, p in zip(held, points, strict=True)]
    last = [(i, *near(v)) for i, v in sound]
    sums = [sum(d for _, d, c in last if c == j) for j in range(len(points))]
    return sorted((i, c, d, sums[c], sum(sums), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for i, d, c in last)


def found(spark, rows, **settings):
    df = centroids.clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), **settings)
    return sorted(tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize("scale", [1.0, 300.0, 1e6])
def test_clusters(spark, scale):
    rng = random.Random(int(scale))
    rows = [(i, [rng.uniform(-1, 1) * scale for _ in range(3)], "x", "y") for i in range(80)]
    rows += [(100 + i, rows[4][1], None, None) for i in range(60)] + [rows[7], rows[7]]  # copies, and a row three times over
    rows += [(200, None, "x", "y"), (201, [1.0, None, 2.0], "x", "y"), (202, [1.0, float("nan"), 2.0], "x", "y"), (203, [float("inf"), 0.0, 0.0], "x", "y"), (204, [1.0, 2.0], "x", "y"), (205, [], "x", "y"), (None, [1.0, 2.0, 3.0], "x", "y")]
    assert found(spark, rows, k=6, size=3) == by_hand(rows, 6, 3, 3)


def test_equal_starts_and_few_vectors(spark):
    rows = [(i, [0.5, -0.5], None, None) for i in range(4)] + [(9, [0.0, 3.0], None, None)]
    assert found(spark, rows, k=16, size=2) == by_hand(rows, 16, 3, 2)
    assert found(spark, [], size=2) == []


def test_components_as_large_as_an_answer_allows(spark):
    rows = [(i, [2.0**30 + i, -(2.0**30)], None, None) for i in range(5)] + [(7, [-(2.0**24), 5.0], None, None)]
    assert found(spark, rows, k=6, rounds=1, size=2) == by_hand(rows, 6, 1, 2)
    with pytest.raises(Exception, match="fit a long"):
        found(spark, [(1, [1e300, 0.0], None, None)], size=2)
