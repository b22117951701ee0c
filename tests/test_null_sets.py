"""Draws and thresholds write no itemsets, and trees of the genomes of 6 GB are broadcast."""

import os
import random

import pytest

from weftline.functions import frames
from weftline.operators import nulls, tree
from weftline.plans import thresholds_and_loci

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["null_draws", "hgp_filter"])
def test_itemsets_arent_written(spark, monkeypatch, name):
    """They are many times the genes."""
    written = {}

    def once(df):
        df = frames.once(df)
        written[",".join(df.columns)] = df.count()
        return df

    for module in (thresholds_and_loci, nulls, tree):
        monkeypatch.setattr(module, "once", once)
    thresholds_and_loci.QUERIES[name](spark, SF).collect()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert not {c for c in written if "omes" in c.split(",")} and not {c: n for c, n in written.items() if n > lines and c != "part,i,ome,key" and "o" not in c.split(",")}


def test_large_trees_are_broadcast(spark):
    """360,000 genomes; and a subtree whose root is missing counts for nothing, as by joins."""
    assert tree.BROADCAST_NODES > 360_031
    rng = random.Random(7)
    rows = [(0, None, 0.0, None)] + [(i, rng.randrange(0, i) if i < 12 else rng.randrange(0, 12), rng.randint(1, 9) / 8, f"t{i}" if i > 11 else None) for i in range(1, 60)]
    rng.shuffle(rows)
    t = tree.tree_frame(spark, rows)
    closure = tree.closure(t)
    stats = tree.node_stats(t, closure)
    sets = spark.createDataFrame([(i, [f"t{k}" for k in rng.sample(range(10, 62), rng.randint(1, 20))]) for i in range(60)], "set_id int, omes array<string>")
    show = lambda df: sorted((r.set_id, r.mrca, round(r.tmd, 9), round(r.mmd, 9), round(r.pds, 9), r.n_missing) for r in df.collect())
    assert show(tree.set_distances(sets, stats, closure)) == show(tree.distances_by_joins(sets, stats, closure))
    whole = show(tree.set_distances(sets, stats, closure))
    lost = spark.createDataFrame([(900, 800, 1.0, None, 0.0, 1, 1.0, 0.0), (901, 900, 1.0, "t1", 0.0, 1, 2.0, 0.0)], "node long, parent long, length double, tip string, desc_len double, n_tips long, depth double, max_tip_dist double")
    assert show(tree.set_distances(sets, stats.select("node", "parent", "length", "tip", "desc_len", "n_tips", "depth", "max_tip_dist").unionAll(lost), closure)) == whole
