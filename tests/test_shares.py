"""Shares and similarities of many small groups and long sets."""

import random

from weftline.operators import loci, tree


def test_shares_go_by_tasks_not_by_groups(spark):
    """Scaffolds of several batches, and batches of several scaffolds, in one task."""
    rng = random.Random(1)
    rows = [(c, o, 1, f, f + rng.randint(0, 4), f"s{rng.randint(0, 9)}", float(rng.randint(1, 5))) for c in "xy" for o in range(15) for f in (rng.randint(0, 60) for _ in range(20))]
    df = spark.createDataFrame(rows, "clan string, ome long, scaffold int, first int, last int, set_id string, score double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, loci.shares(df).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, taken = [], set()
    for c, o, s, f, t, i, x in sorted(rows, key=lambda r: (r[0], r[1], -r[6], r[3], r[4], r[5])):
        free = [p for p in range(f, t + 1) if (c, o, p) not in taken]
        heads = [p for p in free if p - 1 not in free]
        want += [(c, o, s, p, next(q for q in range(p, t + 1) if q + 1 not in free), i, x) for p in heads]
        taken |= {(c, o, p) for p in free}
    assert got == sorted(want)
    assert "FlatMapGroups" not in loci.shares(df)._jdf.queryExecution().optimizedPlan().toString()


def test_genomes_travel_with_sets_not_with_pairs(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(0, None, 0.0, None)] + [(i, 0 if i < 3 else rng.randrange(1, min(i, 10)), rng.randint(1, 9) / 8, f"t{i}" if i > 9 else None) for i in range(1, 60)]
    t = tree.tree_frame(spark, rows)
    closure = tree.closure(t)
    stats = tree.node_stats(t, closure)
    held = {f"s{i}": sorted({f"t{k}" for k in rng.choices(range(10, 62), k=rng.randint(1, 25))}) for i in range(25)} | {"none": ["u"], "empty": []}
    sets = spark.createDataFrame(list(held.items()), "set_id string, omes array<string>")
    asked = [(a, b) for a in held for b in held if rng.random() < 0.5] + [("none", "empty"), ("s1", "unknown")]
    df = spark.createDataFrame(sorted(set(asked)), "a string, b string")
    monkeypatch.setattr(tree, "BLOCK", 100)
    monkeypatch.setattr(tree, "ASKED", 20)
    monkeypatch.setattr(tree, "PIECE", 60)
    found = tree.similarity_of(sets, stats, closure)(df)
    assert "array_union" not in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(tree, "BROADCAST_NODES", 0)
    show = lambda df: sorted((r.a, r.b, round(r.similarity, 9)) for r in df.collect())
    assert show(found) == show(tree.similarity_of(sets, stats, closure)(df)) and found.count() > 100
