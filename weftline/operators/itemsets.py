"""Supports of itemsets, their roll-up from shared loci, and closed itemsets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.frames import once


def supports(combos: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """keys, n_omes, omes: ascending genomes of each itemset that ``least`` or more hold. combos: (ome, keys), distinct."""
    found = combos.groupBy(*keys).agg(F.sort_array(F.collect_set("ome")).alias("omes"))
    return found.withColumn("n_omes", F.size("omes").cast("long")).where(F.col("n_omes") >= least)


def shared_sets(rows: DataFrame, least: int = 3) -> DataFrame:
    """hg0, hg1, a, b, items: what the windows of two genomes that share a pair have in common, if ``least`` or more.

    rows: (hg0, hg1, anchor, ome, items). Both windows hold the pair itself, so they are met by another common group:
    an equi-join on (pair, group), which leaves out window pairs that share nothing more.
    """
    distinct = rows.dropDuplicates(["hg0", "hg1", "anchor"])
    apart = distinct.withColumn("item", F.explode(F.array_except("items", F.array("hg0", "hg1")))).select("hg0", "hg1", "item", "anchor", "ome")
    left = apart.withColumnsRenamed({"anchor": "a", "ome": "ome_a"})
    right = apart.withColumnsRenamed({"anchor": "b", "ome": "ome_b"})
    met = left.join(right, ["hg0", "hg1", "item"]).where("a < b and ome_a <> ome_b")
    common = met.groupBy("hg0", "hg1", "a", "b", "ome_a", "ome_b").agg(F.collect_set("item").alias("more"))
    return common.select("hg0", "hg1", "a", "b", "ome_a", "ome_b", F.array_sort(F.concat(F.array("hg0", "hg1"), "more")).alias("items")).where(F.size("items") >= least)


def roll_up(shared: DataFrame) -> DataFrame:
    """items, n_loci, n_omes, omes: distinct anchors and genomes of each common set."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("anchor"), F.col("ome_a").alias("ome")), F.struct(F.col("b").alias("anchor"), F.col("ome_b").alias("ome")))).alias("e")
    return _rolled(shared.select("items", ends).select("items", "e.*").distinct())


def _rolled(found: DataFrame) -> DataFrame:
    """Of distinct (items, anchor, ome)."""
    rolled = found.groupBy("items").agg(F.count("*").alias("n_loci"), F.array_sort(F.collect_set("ome")).alias("omes"))
    return rolled.withColumn("n_omes", F.size("omes").cast("long"))


def rolled_shared(rows: DataFrame, least: int = 3) -> DataFrame:
    """The same as ``roll_up(shared_sets(rows, least))``, from counts instead of pairs of windows.

    How many windows of other genomes have exactly a set in common with a window is an alternating sum, over the window's sets that
    hold this one, of how many such windows hold each. So windows meet counts of their own sets (2 ** n for n groups besides
    the pair, 8 for windows of two genes either side), never each other.
    """
    own = F.array_sort(F.array_distinct(F.array_except("items", F.array("hg0", "hg1"))))
    windows = rows.where("ome is not null").dropDuplicates(["hg0", "hg1", "anchor"]).select("hg0", "hg1", "anchor", "ome", own.alias("more")).where("size(more) > 0")
    chosen = "filter(more, (x, i) -> (shiftright({0}, i) & 1) = 1)"
    masks = windows.withColumn("mask", F.explode(F.sequence(F.lit(1), F.expr("shiftleft(1, size(more)) - 1"))))
    entries = once(masks.withColumn("held", F.expr(chosen.format("mask"))))
    key = ["hg0", "hg1", "held"]
    by_ome = entries.groupBy(*key, "ome").agg(F.count("*").alias("same"))
    by_ome = once(by_ome)
    others = by_ome.join(by_ome.groupBy(*key).agg(F.sum("same").alias("all")), key).where("all > same").select(*key, "ome", (F.col("all") - F.col("same")).alias("c"))
    met = entries.join(others, [*key, "ome"]).groupBy("hg0", "hg1", "anchor", "ome", "more").agg(F.collect_list(F.struct("mask", "c")).alias("hits"))
    exactly = F.expr("aggregate(filter(hits, x -> (x.mask & mask) = mask), 0L, (n, x) -> n + if(bit_count(x.mask ^ mask) % 2 = 0, x.c, -x.c))")
    found = met.withColumn("mask", F.explode("hits.mask")).where(exactly > 0)
    found = found.select(F.sort_array(F.concat(F.array("hg0", "hg1"), F.expr(chosen.format("mask")))).alias("items"), "anchor", "ome").where(F.size("items") >= least).distinct()
    return _rolled(found)


def closed(sets: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Itemsets (items, omes) with no proper superset of the same genomes. Each larger set names its subsets of the
    smaller sizes, which an anti-join removes. A superset's genomes are among those of its subset, so equal numbers are equal
    genomes, and only numbers are compared."""
    counted = sets.withColumn("_n", F.size("omes"))
    small = []
    for size in sizes:
        for k in (k for k in sizes if k < size):
            subsets = F.array(*[F.array(*[F.get("items", F.lit(i)) for i in c]) for c in combinations(range(size), k)])
            small.append(counted.where(F.size("items") == size).select(F.explode(subsets).alias("items"), "_n"))
    for s in small:
        counted = counted.join(s.distinct(), ["items", "_n"], "left_anti")
    return counted.select(*sets.columns)
