"""Spans of sets in windows, against a loop."""

import random

from weftline.operators import positional


def test_spans_meet_sets_by_two_groups(spark):
    rng = random.Random(2)
    genes = [(o, s, p, f"{o}_{s}_{p}", rng.choice([None, *range(7)])) for o in range(4) for s in range(2) for p in range(40)]
    sets = [(str(i), sorted(rng.sample(range(7), k))) for i, k in enumerate([1, 1, 2, 2, 3, 3, 3, 4, 5])]
    at = {(o, s, p): h for o, s, p, _, h in genes}
    wanted = set()
    for o, s, p, _, h in genes:
        near = {q: at[o, s, q] for q in range(p - 2, p + 3) if (o, s, q) in at}
        for name, items in sets:
            held = [q for q, x in near.items() if x in items]
            if h in items and {near[q] for q in held} == set(items):
                wanted.add((o, s, p, name, min(held), max(held)))
    found = positional.spans(spark.createDataFrame(genes, "ome int, scaffold int, pos int, gene string, hg int"), spark.createDataFrame(sets, "set_id string, items array<int>"))
    assert {tuple(r) for r in found.select("ome", "scaffold", "pos", "set_id", "first", "last").collect()} == wanted and found.count() == len(wanted)
    # By its own group alone, a gene would meet all sets of the group.
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x]
    assert len(joins) == 1 and "other" in joins[0]
