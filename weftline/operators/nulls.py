"""Null distributions by seeded draws, percentile thresholds, and the filters that use them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.frames import finished, known, once
from weftline.functions.scalars import percentile_index


def pick(seed: str, *parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 fixed by its arguments, the same on any partitioning and in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 8), 16, 10).cast("long")


def partitions(genomes: DataFrame, rank: str) -> DataFrame:
    """ome, part: a number for each value of a taxonomic rank, in its order; null values have no part."""
    known = genomes.where(F.col(rank).isNotNull())
    names = known.select(rank).distinct().withColumn("part", F.dense_rank().over(Window.orderBy(rank)) - 1)  # a row for each taxon
    return known.join(F.broadcast(names), rank).select("ome", "part")


def draws(combos: DataFrame, parts: DataFrame, samples: int, seed: str = "null") -> DataFrame:
    """part, i, ome, key: ``samples`` draws for each part: a genome evenly, then an itemset of it evenly.

    combos: (ome, key), distinct. Only as many rows as there are draws meet the itemsets, by (ome, place).
    """
    counts = once(combos.groupBy("ome").agg(F.count("*").alias("n")))
    order = Window.partitionBy("part").orderBy("ome")
    omes = parts.join(counts, "ome").withColumn("o", F.row_number().over(order) - 1)
    sizes = omes.groupBy("part").agg(F.count("*").alias("n_omes"))
    rows = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    rows = rows.withColumn("o", pick(seed, F.col("part"), F.col("i"), F.lit("ome")) % F.col("n_omes")).join(omes.select("part", "o", "ome", "n"), ["part", "o"])
    rows = rows.withColumn("place", pick(seed, F.col("part"), F.col("i"), F.lit("set")) % F.col("n"))
    rows = once(rows)
    # Only genomes that a draw names are sorted.
    placed = combos.join(known(rows.select("ome").distinct()), "ome", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("ome").orderBy("key")) - 1)
    return rows.join(placed, ["ome", "place"]).select("part", "i", "ome", "key")


def thresholds(values: DataFrame, share: float) -> DataFrame:
    """part, threshold: the percentile of each part's values (part, value), which hold a zero for each draw without support."""
    order = Window.partitionBy("part").orderBy("value")
    ranked = values.withColumns({"at": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("part"))})
    return ranked.where(F.col("at") == F.least(F.col("n") - 1, percentile_index(share, F.col("n")))).select("part", F.col("value").alias("threshold"))


def tallied_thresholds(tallies: DataFrame, share: float) -> DataFrame:
    """size, part, threshold of counted values (size, part, value, n): the same order statistic, from a row for each value.

    Tallies of several runs add up, so draws can be made in parts.
    """
    sums = tallies.groupBy("size", "part", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("size", "part")
    ranked = sums.withColumns({"upto": F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(group)})
    at = F.least(F.col("total") - 1, percentile_index(share, F.col("total")))
    return ranked.where((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)).select("size", "part", F.col("value").alias("threshold"))


def carried(bars: DataFrame) -> DataFrame:
    """Bars (size, part, threshold) in which a zero holds for all larger sizes of its part as well: where sets of one size pass
    without support, larger ones do."""
    before = Window.partitionBy("part").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("threshold", F.when(F.min("threshold").over(before) > 0, F.col("threshold")).otherwise(0.0))


def stored_tallies(spark: SparkSession, folder: str, sizes: list[int], parts: list[int], make: Callable[[int, list[int]], DataFrame], group: int = 64) -> DataFrame:
    """size, part, value, n of null distributions kept under ``folder``.

    ``make(size, parts)`` gives (part, value) of the draws of parts; it is asked for some parts at a time, and only for those of
    which no whole tally is there yet, so a run that was stopped goes on where it stopped. A part without draws is kept, too.
    """
    wanted = spark.createDataFrame([(p,) for p in parts], "part long")
    frames = []
    for size in sizes:
        kept = finished(spark, f"{folder}/size={size}")
        there = {r.part for r in spark.read.parquet(*kept).select("part").distinct().collect()} if kept else set()
        lacking = [p for p in parts if p not in there]
        for at in range(0, len(lacking), group):
            some = lacking[at : at + group]
            tally = make(size, some).groupBy(F.col("part").cast("long").alias("part"), "value").agg(F.count("*").alias("n"))
            marks = wanted.where(F.col("part").isin(some)).select("part", F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("n"))
            kept.append(f"{folder}/size={size}/{uuid.uuid4().hex}")
            tally.unionByName(marks).write.parquet(kept[-1])
        frames.append(spark.read.parquet(*kept).where("value is not null").join(wanted, "part", "left_semi").select(F.lit(size).alias("size"), "part", "value", "n"))
    return reduce(DataFrame.unionAll, frames)


def supported(sets: DataFrame, parts: DataFrame, bars: DataFrame, strict: bool, strict_partition: bool = False) -> DataFrame:
    """Sets (key, omes, score) that reach the smallest threshold of the parts they occur in; ``strict``: pass it.

    Genomes without a part are left out; ``strict_partition`` drops the sets that have one.
    """
    rows = sets.select("key", F.explode("omes").alias("ome")).join(parts, "ome", "left").join(F.broadcast(bars), "part", "left")
    bar = rows.groupBy("key").agg(F.min("threshold").alias("bar"), F.count_if(F.col("part").isNull()).alias("loose"))
    met = sets.join(bar.where("bar is not null" + (" and loose = 0" if strict_partition else "")), "key")
    return met.where("score > bar" if strict else "score >= bar").drop("loose")


def numbered(sets: DataFrame, by: str) -> DataFrame:
    """Sets with hgx_id: dense numbers from 0 in the order of ``by``, without one task for all: a range sort writes the
    sets once, and each partition's numbers start after those of the partitions before."""
    ordered = once(sets.orderBy(by).withColumns({"_p": F.spark_partition_id(), "_s": F.monotonically_increasing_id()}))
    counts = ordered.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy("_s")) - 1
    return ordered.withColumn("_r", within).join(F.broadcast(starts), "_p").withColumn("hgx_id", F.col("_b") + F.col("_r")).drop("_p", "_s", "_r", "_b")
