"""Threshold filters on families and what belongs to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import substitution_bias


def log_scaled(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Rows with ``out``: the logarithm of a positive value, spread from 0 to 1 over all rows; null for others."""
    logs = F.when(F.col(value) > 0, F.ln(value))
    ends = rows.agg(F.min(logs).alias("_low"), F.max(logs).alias("_high"))
    share = F.when(F.col("_high") > F.col("_low"), (logs - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.when(logs.isNotNull(), 0.0))
    return rows.join(F.broadcast(ends)).withColumn(out, share).drop("_low", "_high")


def passing(families: DataFrame, tmd: float = 0, gcl: float = 0, pds: float = 0, mmi: float = 0, mmp: float = 0, csb: float = 0, positives: bool = True) -> DataFrame:
    """Families (nrm_log_tmd, gcl, pds, mmi[, mmp]) at or above all thresholds. A threshold of 0 tests nothing; mmp and
    csb are tested only with ``positives`` and where a family has them."""
    tests: list[Column] = [F.col(c) >= t for c, t in (("nrm_log_tmd", tmd), ("gcl", gcl), ("pds", pds), ("mmi", mmi)) if t]
    if positives:
        bias = substitution_bias(F.col("mmi"), F.col("mmp"))
        tests += [F.col("mmp").isNull() | test for t, test in ((mmp, F.col("mmp") >= mmp), (csb, bias >= csb)) if t]
    for test in tests:
        families = families.where(test)
    return families


def of_families(rows: DataFrame, families: DataFrame, key: str = "hlg") -> DataFrame:
    """Rows (loci, genes) whose family is among ``families``."""
    return rows.join(families.select(key), key, "left_semi")


def many_genomes(members: DataFrame, key: str, ome: str = "ome", least: int = 3) -> DataFrame:
    """key, n_omes of those in ``least`` genomes or more."""
    return members.groupBy(key).agg(F.count_distinct(ome).alias("n_omes")).where(F.col("n_omes") >= least)


def satisfied(tunes: DataFrame, families: DataFrame) -> DataFrame:
    """name, satisfied: whether some family holds all groups and genomes of a known cluster and none that it excludes.

    tunes: (name, hgs, omes, false_omes); families: (hgs, omes). Families meet a cluster by its first group.
    """
    by_group = families.select(F.explode("hgs").alias("first"), F.col("hgs").alias("h"), F.col("omes").alias("o"))
    rows = tunes.withColumn("first", F.array_min("hgs")).join(by_group, "first")
    fits = (F.size(F.array_except("hgs", "h")) == 0) & (F.size(F.array_except("omes", "o")) == 0) & (F.size(F.array_intersect("false_omes", "o")) == 0)
    found = rows.where(fits).select("name").distinct().withColumn("satisfied", F.lit(True))
    return tunes.select("name").join(found, "name", "left").select("name", F.coalesce("satisfied", F.lit(False)).alias("satisfied"))


def populous_taxa(genomes: DataFrame, rank: str, least: int = 1) -> DataFrame:
    """ome, taxon of genomes whose taxon has more than ``least`` genomes."""
    known = genomes.where(F.col(rank).isNotNull()).select("ome", F.col(rank).alias("taxon"))
    return known.join(known.groupBy("taxon").agg(F.count_distinct("ome").alias("n")).where(F.col("n") > least).select("taxon"), "taxon", "left_semi")


def taxa_by_size(genomes: DataFrame, rank: str) -> DataFrame:
    """taxon, n_omes, place: taxa in the order of their genomes' number, then of their names. A row for each taxon goes through one task."""
    sizes = genomes.where(F.col(rank).isNotNull()).groupBy(F.col(rank).alias("taxon")).agg(F.count_distinct("ome").alias("n_omes"))
    return sizes.withColumn("place", F.row_number().over(Window.orderBy("n_omes", "taxon")) - 1)
