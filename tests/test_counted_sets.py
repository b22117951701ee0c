"""Common sets from counts, species and missing tips, against loops and the pairs they replace."""

import hashlib
import random

from weftline.operators import itemsets, tree


def test_counts_give_what_pairs_of_windows_give(spark):
    rng = random.Random(6)
    rows = [(a, b, f"g{i}", i % 5, sorted({a, b, *rng.sample(range(10, 16), rng.randint(0, 4))})) for a, b in ((1, 2), (2, 3)) for i in range(40)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "hg0 int, hg1 int, anchor string, ome int, items array<int>")
    show = lambda found: sorted((tuple(r["items"]), r.n_loci, r.n_omes, tuple(r.omes)) for r in found.collect())
    for least in (3, 4):
        counted = show(itemsets.rolled_shared(df, least))
        assert counted and counted == show(itemsets.roll_up(itemsets.shared_sets(df, least)))


def test_windows_arent_met_in_pairs(spark):
    """3000 equal windows of 3000 genomes: 4.5 million pairs, 3000 rows of counts."""
    df = spark.range(3000).selectExpr("1 AS hg0", "2 AS hg1", "cast(id AS string) AS anchor", "id AS ome", "array(1, 2, 3) AS items")
    found = itemsets.rolled_shared(df)
    assert [(r["items"], r.n_loci, r.n_omes) for r in found.collect()] == [([1, 2, 3], 3000, 3000)]
    assert "a <" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_species_keeps_the_genome_of_least_hash(spark):
    rng = random.Random(8)
    species = {o: None if o % 9 == 8 else o % 4 for o in range(30)}
    sets = [(i, sorted(rng.sample(range(32), 12))) for i in range(20)]
    found = tree.one_genome_a_species(spark.createDataFrame(sets, "set_id int, omes array<long>"), spark.createDataFrame(list(species.items()), "ome long, species int"))
    least = lambda omes: {min((hashlib.md5(str(o).encode()).hexdigest(), o) for o in omes if o in species and species[o] == s)[1] for s in {species[o] for o in omes if o in species}}
    assert {r.set_id: r.omes for r in found.collect()} == {i: sorted(least(omes)) for i, omes in sets}


def test_missing_tips_are_made_in_bounded_lists(spark, monkeypatch):
    """A set of two far tips lacks all others, however few its own are."""
    rows = [(0, None, 0.0, None), *[(1 + i, 0, 1.0, f"t{i}") for i in range(60)]]
    t = tree.tree_frame(spark, rows)
    closure = tree.closure(t)
    stats = tree.node_stats(t, closure)
    sets = spark.createDataFrame([(i, [f"t{i}", f"t{i + 30}"]) for i in range(30)], "set_id int, omes array<string>").coalesce(1)
    monkeypatch.setattr(tree, "PIECE", 100)
    found = tree.missing_tips(sets, stats, closure)
    lists = found._jdf.queryExecution().optimizedPlan().toString()
    assert "tips" in lists  # unrolled by Spark
    assert {(r.set_id, r.tip) for r in found.collect()} == {(i, f"t{k}") for i in range(30) for k in range(60) if k not in (i, i + 30)}


def test_missing_tips_are_unrolled_from_short_lists(spark, monkeypatch):
    """All rows of a list are held at once, each with its set's name: long names make short lists."""
    t = tree.tree_frame(spark, [(0, None, 0.0, None), *[(1 + i, 0, 1.0, f"t{i}") for i in range(90)]])
    closure = tree.closure(t)
    stats = tree.node_stats(t, closure)
    held = {"x" * k: [f"t{i}" for i in range(k % 7 + 2)] for k in (1, 50, 200, 900, 5000)} | {"whole": [f"t{i}" for i in range(90)], "none": []}
    sets = spark.createDataFrame(list(held.items()), "set_id string, omes array<string>").coalesce(1)
    monkeypatch.setattr(tree, "UNROLLED", 2000)
    lists = tree.missing_lists(sets, stats).collect()
    assert all(len(r.tips) == 1 or len(r.tips) * len(r.set_id) <= 2000 for r in lists) and max(len(r.tips) for r in lists) > 50
    want = sorted((k, f"t{i}") for k, omes in held.items() if omes for i in range(90) if f"t{i}" not in omes)
    assert sorted(map(tuple, tree.missing_tips(sets, stats, closure).collect())) == want
    assert sorted((r.set_id, x) for r in lists for x in r.tips) == want
