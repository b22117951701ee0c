"""Writers of results: tab-separated tables, per-genome loci, and exports of genes and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.frames import replaced
from weftline.functions.scalars import substitution_bias
from weftline.operators.filters import log_scaled


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as comma-separated text, nulls as na."""
    one = lambda name, kind: F.array_join(name, ",") if kind.startswith("array") else F.col(name).cast("string")
    return df.select(*[F.coalesce(one(n, k), F.lit("na")).alias(n) for n, k in df.dtypes])


def table(df: DataFrame, path: str, by: Column | None = None) -> None:
    """A gzipped table with a header, globally sorted over its files if an order is given."""
    flat = _flat(df.orderBy(by) if by is not None else df)
    flat.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def pairs(df: DataFrame, path: str) -> None:
    table(df.select("hg0", "hg1", "n_omes", "score"), path, F.col("score").asc())


def itemsets(df: DataFrame, path: str) -> None:
    """items, nrm_log_score, omes of itemsets (items, omes, score), by falling score."""
    scaled = log_scaled(df, "score", "nrm_log_score")
    table(scaled.select("items", "nrm_log_score", "omes"), path, F.col("nrm_log_score").desc_nulls_last())


def family_store(df: DataFrame, path: str) -> None:
    """Families as Parquet, sorted by their score over all files: a threshold reads only the row groups that can pass."""
    replaced(df.sparkSession, path, lambda to: df.orderBy(F.col("nrm_log_tmd").desc_nulls_last()).write.parquet(to))


def group_fasta(records: DataFrame, path: str) -> None:
    """One file of FASTA records (hg, name, sequence), sorted by name, for each group: hg=<group>/part-....txt.

    A group's records are written by one task, as they make one file; they are sorted on disk, not held. All files take their
    place at once, when the last is written.
    """
    line = F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value")
    sorted_ = records.repartition("hg").sortWithinPartitions("hg", "name").select("hg", line)
    replaced(records.sparkSession, path, lambda to: sorted_.write.partitionBy("hg").text(to))


def families(df: DataFrame, path: str, positives: bool = True) -> None:
    """hgs, hlg, hlc, scores and genomes; csb as a percentage, only with positives."""
    shown = [c for c in ("hgs", "hlg", "hlc", "nrm_log_tmd", "pds", "gcl", "mmi") if c in df.columns]
    if positives:
        df = df.withColumn("csb", 100 * substitution_bias(F.col("mmi"), F.col("mmp")))
        shown += [c for c in ("mmp", "csb", "apds") if c in df.columns]
    table(df.select(*shown, "omes"), path, F.col("nrm_log_tmd").desc())


def loci(df: DataFrame, path: str) -> None:
    """Loci in a folder for each genome: name, groups (blank for none), genes, families."""
    blank = F.array_join(F.transform("hgs", lambda h: F.coalesce(h.cast("string"), F.lit(""))), ",")
    rows = df.select("ome", "name", blank.alias("hgs"), F.array_join("genes", ",").alias("genes"), F.array_join("families", ",").alias("families"))
    rows.repartition("ome").sortWithinPartitions("ome", "name").write.mode("overwrite").partitionBy("ome").option("sep", "\t").option("header", True).csv(path)


def gff(genes: DataFrame, path: str, by: str = "hlg") -> None:
    """GFF3 lines of genes (seqid, first, last, strand, gene) in a folder for each family."""
    line = F.concat_ws("\t", "seqid", F.lit("."), F.lit("gene"), F.col("first").cast("string"), F.col("last").cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit("ID="), "gene", F.lit(";Alias="), "gene"))
    genes.select(F.col(by), line.alias("value")).repartition(by).write.mode("overwrite").partitionBy(by).text(path)


def fasta(records: DataFrame, path: str, by: str = "hlg") -> None:
    """FASTA records (name, sequence) in a folder for each family."""
    records.select(F.col(by), F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value")).repartition(by).write.mode("overwrite").partitionBy(by).text(path)


def network(edges: DataFrame, vertices: DataFrame, path: str) -> None:
    """Edges and vertices of a network, for any drawing tool."""
    table(edges, f"{path}/edges")
    table(vertices, f"{path}/vertices")


def points(df: DataFrame, path: str, axes: list[str]) -> None:
    """The axes of a scatter plot, a row a point."""
    table(df.select("hlg", *axes), path)
