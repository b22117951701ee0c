"""Components: few links in one task, more by rounds. Markov clusters: small components as matrices, larger ones in stripes."""

import random

import pytest

from weftline.operators import graph
from weftline.operators.graph import components


def by_hand(edges):
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a in root and b in root and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                moved = True
    return root


@pytest.mark.parametrize("kind", ["long", "string"])
def test_few_links_are_joined_as_by_rounds(spark, kind):
    draw = random.Random(5)
    edges = [(draw.randrange(-90, 90), draw.randrange(-90, 90)) for _ in range(110)] + [(7, 7), (None, 3), (200, None)]
    edges += edges[:20]
    if kind == "string":
        names = "aÄzé￮\U0001f600Z"
        edges = [tuple(None if x is None else names[x % 7] + str(x) for x in e) for e in edges]
    df, hand = spark.createDataFrame(edges, f"a {kind}, b {kind}"), by_hand(edges)
    assert sorted(components(df).collect()) == sorted(hand.items())
    assert sorted(components(df, few=0).collect()) == sorted(hand.items())
    assert components(df.limit(0)).count() == 0
    assert components(df.limit(0)).dtypes == components(df, few=0).dtypes


def test_few_links_take_few_jobs(spark):
    """A round is ten stages or so, of as many tasks as the session has shuffle partitions, however few the links are."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    spark.sparkContext.setJobGroup("few links", "")
    try:
        assert {x.root for x in components(edges).collect()} == {0}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 6


def test_stripes_find_what_matrices_find(spark, monkeypatch):
    """Graphs of several blocks and stripes, with links twice, both ways and to themselves; and the work of a round isn't rows by rows."""
    draw = random.Random(3)
    edges = [(100 * g + i, 100 * g + j, draw.uniform(0.5, 1) if i // 8 == j // 8 else draw.uniform(0, 0.05)) for g in range(3) for i in range(30) for j in range(30) if i < j and (i // 8 == j // 8 or draw.random() < 0.2)]
    edges += [(b, a, w / 2) for a, b, w in edges[:40]] + [(a, a, 0.4) for a, _, _ in edges[:5]] + [(7, None, 1.0)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    whole = {r.node: r.cluster for r in graph.markov_clusters(df, 1.7).collect()}
    assert len(set(whole.values())) == 12
    monkeypatch.setattr(graph, "CELLS", 250)
    monkeypatch.setattr(graph, "HEIGHT", 7)
    assert {r.node: r.cluster for r in graph.markov_clusters(df, 1.7, dense=10).collect()} == whole


def test_columns_of_dense_components_arent_emptied(spark):
    """All 1e-3 before they are scaled, at an inflation of 2 below what is pruned: the largest of a column stay."""
    n = 400
    df = spark.range(n).selectExpr("id AS a", f"explode(sequence(id, {n - 1}L)) AS b").where("a < b").selectExpr("a", "b", "if(a div 200 = b div 200, 1.0D, 0.9D) AS w")
    for dense in (1000, 10):
        found = {r.node: r.cluster for r in graph.markov_clusters(df, 2.0, dense).collect()}
        assert len(found) == n and set(found.values()) <= {0, 200}
