"""Steps whose tasks and shuffles must not grow faster than the input."""

import itertools
import random

from weftline.functions import frames
from weftline.operators import loci, positional, similarity, statistics


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_loci_share_groups_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(frames, "TASK_ROWS", 40)
    rng = random.Random(1)
    rows = [(b, 10 * b + i, rng.choice([None, *range(8)])) for b in range(6) for i in range(10) for _ in range(6)]
    df = spark.createDataFrame(rows, "block int, locus int, hg int")
    found = similarity.shared_groups(df, 2)
    assert "REPARTITION_BY_NUM" in plan(found)
    held = {}
    for b, locus, hg in rows:
        held.setdefault((b, locus), set()).update({hg} - {None})
    want = sorted((b, i, j, len(x & y), len(x), len(y)) for ((b, i), x), ((c, j), y) in itertools.combinations(sorted(held.items()), 2) if b == c and len(x & y) >= 2)
    assert sorted(map(tuple, found.collect())) == want


def test_rules_meet_loci_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(frames, "TASK_ROWS", 10)
    terms = spark.createDataFrame([(i, t) for i in range(20) for t in "abcd"[: i % 5]] + [(3, None), (4, "a")], "locus int, term string")
    rules = spark.createDataFrame([("x", 1, "a"), ("x", 2, "c"), ("x", 2, "d"), ("y", 1, "b"), ("z", 1, None)], "label string, clause int, term string")
    found = statistics.rule_labels(terms, rules, "locus")
    assert "REPARTITION_BY_NUM" in plan(found)
    assert {r.locus: r.labels for r in found.collect()} == {i: "x$y" if i % 5 > 2 else "y" for i in range(20) if i % 5 > 1}


def test_contrasts_of_rows_that_hold_their_terms(spark):
    rng = random.Random(2)
    rows = [(rng.choice("TU"), f"g{rng.randint(0, 40)}", rng.choice(["f", "h", None]), rng.choice([1, 2, 3, None]), rng.choice(["p", "q", None])) for _ in range(120)]
    named = spark.createDataFrame(rows, "taxon string, gene string, family string, cluster int, term string")
    got = {(r.taxon, r.contrast, r.term): (r.clusters, r.k_background, r.k) for r in statistics.term_contrasts(named.drop("term"), named).collect()}
    want = {}
    for name, back, side in (("cluster_total", lambda r: True, 3), ("cluster_family", lambda r: r[2] is not None, 3), ("family_total", lambda r: True, 2)):
        for taxon, term in itertools.product("TU", ["p", "q", None]):
            own = [r for r in rows if (r[0], r[4]) == (taxon, term) and back(r)]
            fore = [r for r in own if r[side] is not None]
            if own:
                want[taxon, name, term] = (len({r[side] for r in fore}), len({r[1] for r in own}), len({r[1] for r in fore}))
    assert got == want


def test_loci_are_extended_without_unrolling_missing_groups(spark):
    genes = spark.createDataFrame([(1, 1, p, h) for p, h in enumerate([7, 5, 4, 1, 2, 3, 5, 6, None, 8])], "ome int, scaffold int, pos int, hg int")
    families = spark.createDataFrame([(0, [*range(1, 9)])], "family int, hgs array<int>")
    found = loci.extended(spark.createDataFrame([(0, 1, 1, 3, 5)], "family int, ome int, scaffold int, first int, last int"), genes, families)
    # Both ends take a step at a time; down: 4, then 5 is taken by neither end or both; up: 5, 6, then no group.
    assert "size(missing" not in plan(found)
    assert [(r.new_first, r.new_last) for r in found.collect()] == [(2, 7)]


def test_combinations_of_written_genes_are_shuffled_once(spark):
    genes = frames.once(spark.createDataFrame([(o, 1, p, (o * p) % 7) for o in range(5) for p in range(20)], "ome int, scaffold int, pos int, hg int"))
    assert plan(positional.window_combinations(genes, 3)).count("Exchange hashpartitioning") == 1
    assert plan(positional.window_pairs(genes)).count("Exchange hashpartitioning") == 1
