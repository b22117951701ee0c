"""Operators on ordered genes: genes(ome, scaffold, pos, gene, hg), hg null for a gene of no group."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.frames import known

PLACE = ("ome", "scaffold")


def scaffold_order(*place: str):
    return Window.partitionBy(*(place or PLACE)).orderBy("pos")


def locus_windows(genes: DataFrame, w: int = 2) -> DataFrame:
    """Each gene with its window of ``w`` genes either side, cut at scaffold ends: members array<struct<pos,hg,gene>>."""
    return genes.withColumn("members", F.collect_list(F.struct("pos", "hg", "gene")).over(scaffold_order().rowsBetween(-w, w)))


def _following(genes: DataFrame, n: int) -> DataFrame:
    """Each gene with the groups of the ``n`` genes after it, f1 ... fn; by genome, so that what is made distinct by genome isn't shuffled again."""
    order = scaffold_order()
    return genes.select(*PLACE, "pos", "hg").repartition("ome").select("ome", "hg", *[F.lead("hg", i).over(order).alias(f"f{i}") for i in range(1, n + 1)])


def window_combinations(genes: DataFrame, k: int, w: int = 2) -> DataFrame:
    """Distinct (ome, items): ascending arrays of ``k`` different groups that some window of a genome holds.

    A window holds k genes if and only if they lie within 2w places, so each combination is built once, at its first
    gene, from the genes after it: no self-join, one sort by place, and partial distinct before the shuffle.
    """
    reach = 2 * w
    rows = _following(genes, reach).where("hg is not null")
    # Null for a combination with a gene of no group or a group twice: plain comparisons, as functions of lambdas aren't compiled.
    combos = []
    for c in combinations(range(1, reach + 1), k - 1):
        names = ["hg", *[f"f{i}" for i in c]]
        whole = reduce(and_, [F.col(n).isNotNull() for n in names[1:]] + [F.col(x) != F.col(y) for x, y in combinations(names, 2)], F.lit(True))
        combos.append(F.when(whole, F.sort_array(F.array(*names))))
    return rows.select("ome", F.explode(F.array(*combos)).alias("items")).where("items is not null").distinct()


def window_pairs(genes: DataFrame, w: int = 2) -> DataFrame:
    """Distinct (ome, hg0, hg1), hg0 < hg1, of groups that some window of a genome holds."""
    rows = _following(genes, 2 * w).where("hg is not null").select("ome", "hg", F.explode(F.array(*[f"f{i}" for i in range(1, 2 * w + 1)])).alias("other"))
    return rows.where("other is not null and other <> hg").select("ome", F.least("hg", "other").alias("hg0"), F.greatest("hg", "other").alias("hg1")).distinct()


def runs(genes: DataFrame, wanted: Column, least: int = 3) -> DataFrame:
    """Runs of ``least`` or more consecutive genes for which ``wanted`` holds: ome, scaffold, first, last, n."""
    picked = genes.where(wanted).withColumn("island", F.col("pos") - F.row_number().over(scaffold_order()))
    return picked.groupBy(*PLACE, "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def merge_neighbours(loci: DataFrame, max_between: int = 2, exact: bool = False, by: tuple[str, ...] = ("ome", "scaffold", "family")) -> DataFrame:
    """Loci (by, first, last) merged over gaps of at most ``max_between`` genes; ``exact``: of 0 or exactly so many."""
    order = Window.partitionBy(*by).orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("first") - before - 1
    joins = (gap <= 0) | (gap == max_between) if exact else gap <= max_between
    marked = loci.withColumn("island", F.when(joins, 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("island").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n_loci")).drop("island")


def seeded_windows(genes: DataFrame, pairs: DataFrame, w: int = 2) -> DataFrame:
    """hg0, hg1, anchor, ome, items: for each anchor gene and window partner that complete a given pair, the groups
    of the anchor's window. pairs: hg0 < hg1; joined by group, so the window's groups travel only with matches."""
    around = locus_windows(genes, w).where("hg is not null")
    groups = F.array_sort(F.array_distinct(F.filter(F.transform("members", lambda m: m["hg"]), lambda h: h.isNotNull())))
    rows = around.select("ome", F.col("gene").alias("anchor"), "hg", groups.alias("items"))
    partner = rows.withColumn("other", F.explode("items")).where("other <> hg")
    keyed = partner.select(F.least("hg", "other").alias("hg0"), F.greatest("hg", "other").alias("hg1"), "ome", "anchor", "items")
    return keyed.join(pairs.select("hg0", "hg1"), ["hg0", "hg1"], "left_semi")


def spans(genes: DataFrame, sets: DataFrame, w: int = 2) -> DataFrame:
    """ome, scaffold, pos (of the anchor), set_id, first, last: the stretch of an anchor's window that a set covers.

    sets: set_id, items. An anchor belongs to a set if its own group does and its window holds all of the set.
    """
    order = scaffold_order()
    near = [i for i in range(-w, w + 1) if i]
    beside = [F.struct(F.lag("pos", -i).over(order).alias("pos"), F.lag("hg", -i).over(order).alias("hg")) for i in near]
    around = genes.select(*PLACE, "pos", "hg", F.filter(F.array(F.struct("pos", "hg"), *beside), lambda m: m["hg"].isNotNull()).alias("members")).where("hg is not null")
    # An anchor meets a set by its own group and one other of the set: the least, or the next, if it is the least itself. Groups
    # alone would meet each gene with all sets of its group.
    kinds = sets.select("set_id", F.array_sort(F.array_distinct("items")).alias("items"))
    wanted = known(kinds.select("set_id", "items", F.explode("items").alias("hg")).withColumn("other", F.when(F.size("items") == 1, F.col("hg")).when(F.get("items", F.lit(0)) == F.col("hg"), F.get("items", F.lit(1))).otherwise(F.get("items", F.lit(0)))))
    groups = F.array_distinct(F.transform("members", lambda m: m["hg"]))
    met = around.withColumn("other", F.explode(groups)).join(wanted, ["hg", "other"])
    has = F.filter("members", lambda m: F.array_contains("items", m["hg"]))
    met = met.withColumn("inside", has).where(F.size(F.array_distinct(F.transform("inside", lambda m: m["hg"]))) == F.size("items"))
    at = F.transform("inside", lambda m: m["pos"])
    return met.select(*PLACE, "pos", "set_id", F.array_min(at).alias("first"), F.array_max(at).alias("last"))


def genes_between(genes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Genes inside ranges (ome, scaffold, first, last and others), both ends included.

    A range is unrolled to its places, so this is an equi-join on (ome, scaffold, pos), not a range join.
    """
    places = ranges.withColumn("pos", F.explode(F.sequence("first", "last")))
    return places.join(genes, [*PLACE, "pos"])


def named_loci(loci: DataFrame) -> DataFrame:
    """Loci (ome, scaffold, first ...) with name: the scaffold and the locus's rank on it, from 0."""
    rank = F.row_number().over(Window.partitionBy(*PLACE).orderBy("first", "last")) - 1
    return loci.withColumn("name", F.concat_ws("_", F.col("scaffold").cast("string"), rank.cast("string")))
