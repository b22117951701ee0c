"""Commands on the results of a run, as ``Run.outputs`` writes them.

    python -m weftline.plans.tools rethreshold --results results --out again --gcl 0.5 --pds 0.1
    python -m weftline.plans.tools annotate --results results --domains domains.txt --rules rules.tsv --out named --extract
    python -m weftline.plans.tools network --results results --out net --most 500
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.frames import once
from weftline.functions.scalars import percent_flag
from weftline.operators import filters, graph, statistics
from weftline.sources import formats, sinks

THRESHOLDS = ("tmd", "gcl", "pds", "mmi", "mmp", "csb")


def rethreshold(spark: SparkSession, results: str, out: str, **thresholds: float) -> None:
    """Families of a run at other thresholds, and their loci: only the store's row groups that can pass are read."""
    kept = filters.passing(spark.read.parquet(f"{results}/store"), **thresholds)
    sinks.families(kept, f"{out}/gcfs")
    held = formats.loci(spark, f"{results}/loci").withColumn("hlg", F.explode("families"))
    held = held.join(kept.select("hlg"), "hlg", "left_semi").groupBy("ome", "name", "hgs", "genes").agg(F.array_sort(F.collect_set("hlg")).alias("families"))
    sinks.loci(held, f"{out}/loci")


def genes_of(loci: DataFrame) -> DataFrame:
    """ome, name, gene, hg of loci's genes."""
    rows = loci.select("ome", "name", F.explode(F.arrays_zip("genes", "hgs")).alias("g"))
    return rows.select("ome", "name", F.col("g.genes").alias("gene"), F.col("g.hgs").alias("hg"))


def annotate(spark: SparkSession, results: str, domains: str, rules: str, out: str, extract: bool = False) -> None:
    """Loci named for the rules that their genes' domains meet, and each gene's domains, by label where a rule knows them."""
    loci = once(formats.loci(spark, f"{results}/loci").withColumn("locus", F.struct("ome", "name")))
    known = once(formats.rules(spark, rules))
    found = formats.domains(spark, domains).select("gene", F.col("pfam").alias("term"))
    terms = once(genes_of(loci).join(found, "gene").select(F.struct("ome", "name").alias("locus"), "gene", "term"))
    named = statistics.labelled(loci, statistics.rule_labels(terms, known, "locus"), "locus", extract=extract)
    sinks.loci(named.select("ome", "name", "hgs", "genes", "families"), f"{out}/loci")
    shown = statistics.renamed_terms(terms, known).select("locus.ome", F.col("locus.name").alias("locus"), "gene", F.col("name").alias("annotation"))
    sinks.table(shown.distinct(), f"{out}/genes")


def network(spark: SparkSession, results: str, out: str, most: int = 500) -> None:
    """Groups that stand in one locus, weighted by how often, the heaviest edges alone; a row for the whole graph beside them."""
    rows = genes_of(formats.loci(spark, f"{results}/loci")).select("ome", F.col("name").alias("locus"), "hg")
    counts = statistics.pair_counts(rows).groupBy(F.col("hg0").alias("a"), F.col("hg1").alias("b")).agg(F.sum("n").alias("w"))
    edges = once(graph.capped_edges(counts, most))
    vertices = graph.local_clustering(edges)
    sinks.network(edges, vertices, out)
    sinks.table(graph.graph_summary(edges).join(F.broadcast(graph.weighted_transitivity(edges).withColumnRenamed("transitivity", "weighted_transitivity"))), f"{out}/summary")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    own = {name: commands.add_parser(name) for name in ("rethreshold", "annotate", "network")}
    for c in own.values():
        c.add_argument("--results", required=True)
        c.add_argument("--out", required=True)
    for name in THRESHOLDS:
        own["rethreshold"].add_argument(f"--{name}", type=float if name in ("mmi", "mmp") else percent_flag, default=0.0)
    own["annotate"].add_argument("--domains", required=True)
    own["annotate"].add_argument("--rules", required=True)
    own["annotate"].add_argument("--extract", action="store_true")
    own["network"].add_argument("--most", type=int, default=500)
    a = vars(p.parse_args(argv))
    {"rethreshold": rethreshold, "annotate": annotate, "network": network}[a.pop("command")](SparkSession.builder.appName("weftline").getOrCreate(), **a)


if __name__ == "__main__":
    main()
