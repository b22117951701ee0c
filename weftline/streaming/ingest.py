"""Micro-batch ingest of genomes: distances only for genome sets that aren't known yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import itemsets, positional, tree


def known(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that batches append to; empty before the first."""
    empty = spark.createDataFrame([], schema)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(empty.schema).parquet(path) if there else empty


def ingest_pairs(genes: DataFrame, stats: DataFrame, closure: DataFrame, folder: str, checkpoint: str, w: int = 2) -> StreamingQuery:
    """Streams genes (whole scaffolds a batch) into ``folder``/pairs (ome, hg0, hg1) and ``folder``/distances (omes, tmd).

    Each batch writes its pairs under its own number, so a batch that is run again replaces what it wrote; then
    distances are computed for the genome sets that have none.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        positional.window_pairs(rows, w).write.mode("overwrite").parquet(f"{folder}/pairs/batch={number}")
        pairs = spark.read.parquet(f"{folder}/pairs").select("ome", "hg0", "hg1").distinct()
        sets = itemsets.supports(pairs, ["hg0", "hg1"])
        memo = known(spark, f"{folder}/distances", "omes array<bigint>, tmd double")
        new = tree.unseen(sets, memo).select(F.col("omes").alias("set_id"), "omes")
        tree.set_distances(new, stats, closure).select(F.col("set_id").alias("omes"), "tmd").write.mode("append").parquet(f"{folder}/distances")

    return genes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pair_distances(spark: SparkSession, folder: str) -> DataFrame:
    """hg0, hg1, n_omes, tmd of all batches so far."""
    pairs = spark.read.parquet(f"{folder}/pairs").select("ome", "hg0", "hg1").distinct()
    memo = spark.read.parquet(f"{folder}/distances").groupBy("omes").agg(F.first("tmd").alias("tmd"))
    return itemsets.supports(pairs, ["hg0", "hg1"]).join(memo, "omes").select("hg0", "hg1", "n_omes", "tmd")
