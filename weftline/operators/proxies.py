"""Commitment of families to their loci, from alignments ordered by score."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.frames import known, once

FAMILY = ("hlg", "hg")


class Aligner(NamedTuple):
    """Alignments that are made as they are asked for, so that most of all pairs never are: ``bests(members, score)`` (hlg, hg, q, s_ome, best), the best
    score of each member with those of its family's group in each other genome; and ``reaching(bars, score)`` (hg, q, s, ...), with all whose
    query has a bar (hg, gene, bar) that they reach."""

    bests: Callable[[DataFrame, str], DataFrame]
    reaching: Callable[[DataFrame, str], DataFrame]


def hits_until_complete(algn: DataFrame | Aligner, members: DataFrame, score: str = "ppos") -> DataFrame:
    """hlg, hg, q, q_ome, s, s_ome, kind (in or out), rank, seen, n: each member's alignments, best first, up to the one
    at which every other genome of the family has been hit.

    members: (hlg, hg, gene, ome). algn: (hg, q, s, q_ome, s_ome, pident, ppos). Subjects of a family genome that are no
    members are left out. seen: family genomes hit up to this row; n: genomes of the family.
    """
    members = once(members.select(*FAMILY, "gene", "ome"))
    sizes = members.groupBy(*FAMILY).agg(F.count_distinct("ome").alias("n")).where("n > 1")
    queries = known(members.select(*FAMILY, F.col("gene").alias("q")).join(sizes, [*FAMILY]))
    subjects = known(members.select(*FAMILY, F.col("gene").alias("s"), F.lit(True).alias("member")))
    family_omes = known(members.select(*FAMILY, F.col("ome").alias("s_ome"), F.lit(True).alias("inside")).distinct())
    kind = F.when(F.col("member") & (F.col("s_ome") != F.col("q_ome")), "in").when(F.col("inside").isNull(), "out")

    def met(asked: DataFrame, algn: DataFrame) -> DataFrame:
        found = algn.join(asked, ["hg", "q"])
        if "bar" in asked.columns:
            found = found.where(F.col("bar").isNull() | (F.col(score) >= F.col("bar"))).drop("bar")
        found = found.join(subjects, [*FAMILY, "s"], "left").join(family_omes, [*FAMILY, "s_ome"], "left")
        return found.withColumn("kind", kind).where("kind is not null").drop("member", "inside")

    # A scan ends at the worst of its genomes' best scores; what lies below needn't be sorted. Alignments are read twice for this.
    if isinstance(algn, Aligner):
        best = algn.bests(members.join(sizes, [*FAMILY], "left_semi"), score).join(sizes, [*FAMILY])
    else:
        best = met(queries, algn).where("kind = 'in'").groupBy(*FAMILY, "q", "n", "s_ome").agg(F.max(score).alias("best"))
    ends = best.groupBy(*FAMILY, "q", "n").agg(F.min("best").alias("bar"), F.count("best").alias("k")).where("k >= n - 1").select(*FAMILY, "q", "bar")
    asked = known(queries.join(ends, [*FAMILY, "q"], "left"))
    if isinstance(algn, Aligner):
        bars = asked.groupBy("hg", F.col("q").alias("gene")).agg(F.min(F.coalesce("bar", F.lit(float("-inf")))).alias("bar"))
        algn = algn.reaching(bars, score)
    rows = met(asked, algn).repartition(*FAMILY, "q")
    order = Window.partitionBy(*FAMILY, "q").orderBy(F.desc(score), "s")
    first = F.row_number().over(Window.partitionBy(*FAMILY, "q", "kind", "s_ome").orderBy(F.desc(score), "s")) == 1
    rows = rows.withColumn("new", ((F.col("kind") == "in") & first).cast("int"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"rank": F.row_number().over(order), "seen": F.sum("new").over(upto)})
    return rows.where(F.col("seen") - F.col("new") < F.col("n") - 1).drop("new")


def gene_commitment(hits: DataFrame) -> DataFrame:
    """hlg, hg, q, q_ome, n, gcl, mi, mp of each member: the share of family genomes among what its best hits are, and
    the least identity and positives among its first hits of each genome; 0 if a genome is missing."""
    inside = F.col("kind") == "in"
    sums = hits.groupBy(*FAMILY, "q", "q_ome").agg(
        F.first("n").alias("n"), F.count_if(inside).alias("hits"), F.count_if(~inside).alias("outside"), F.max("seen").alias("seen"),
        F.min(F.when(inside, F.col("pident"))).alias("mi"), F.min_by("ppos", F.when(inside, F.struct("pident", "ppos"))).alias("mp"),
    )
    found = F.when(F.col("hits") < F.col("n") - 1, F.col("hits")).otherwise(F.col("n") - 1)
    whole = F.col("seen") >= F.col("n") - 1
    return sums.select(*FAMILY, "q", "q_ome", "n", (found / (found + F.col("outside"))).alias("gcl"), F.when(whole, F.col("mi")).otherwise(0.0).alias("mi"), F.when(whole, F.col("mp")).otherwise(0.0).alias("mp"))


def best_by_genome(genes: DataFrame) -> DataFrame:
    """The gene of the highest commitment for each family, group and genome; of equals, the smaller gene."""
    order = Window.partitionBy(*FAMILY, "q_ome").orderBy(F.desc("gcl"), "q")
    return genes.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def family_scores(best: DataFrame) -> DataFrame:
    """hlg, gcl, mmi, mmp: means weighted by the genomes of each group; mmp is null if a group lacks positives."""
    groups = best.groupBy(*FAMILY).agg(F.sum("gcl").alias("gcl"), F.max("n").alias("n"), F.avg("mi").alias("mi"), F.avg("mp").alias("mp"), F.count_if(F.col("mp").isNull()).alias("bare"))
    total = F.sum("n")
    rolled = groups.groupBy("hlg").agg((F.sum("gcl") / total).alias("gcl"), (F.sum(F.col("mi") * F.col("n")) / total).alias("mmi"), (F.sum(F.col("mp") * F.col("n")) / total).alias("mmp"), F.sum("bare").alias("bare"))
    return rolled.select("hlg", "gcl", "mmi", F.when(F.col("bare") == 0, F.col("mmp")).alias("mmp"))


def lost_genomes(algn: DataFrame | Aligner, members: DataFrame, missing: DataFrame, least_evidence: float = 0.5, kind: str = "array<bigint>") -> DataFrame:
    """hlg, lost: missing genomes of which a gene stands before a member's hits are complete, by identity, in any group.

    missing: (hlg, ome). Only scans that complete are evidence, and a family needs it for ``least_evidence`` of its groups.
    """
    hits = hits_until_complete(algn, members, "pident")
    done = once(hits.withColumn("whole", F.max("seen").over(Window.partitionBy(*FAMILY, "q")) >= F.col("n") - 1).where("whole"))
    evidence = done.groupBy("hlg").agg(F.count_distinct("hg").alias("judged"))
    groups = members.groupBy("hlg").agg(F.count_distinct("hg").alias("groups"))
    fit = groups.join(evidence, "hlg").where(F.col("judged") >= F.lit(least_evidence) * F.col("groups")).select("hlg")
    lost = done.where("kind = 'out'").select("hlg", F.col("s_ome").alias("ome")).join(missing, ["hlg", "ome"], "left_semi")
    return fit.join(lost.groupBy("hlg").agg(F.array_sort(F.collect_set("ome")).alias("lost")), "hlg", "left").withColumn("lost", F.coalesce("lost", F.array().cast(kind)))


def failing(algn: DataFrame, members: DataFrame) -> DataFrame:
    """hlg, hg, gene of members that have alignments, but none with a member of another genome or with a genome outside of the
    family, and of all members of groups with one genome."""
    omes = members.groupBy(*FAMILY).agg(F.count_distinct("ome").alias("n"))
    lone = members.join(omes.where("n = 1"), [*FAMILY], "left_semi").select(*FAMILY, "gene")
    members = once(members.select(*FAMILY, "gene", "ome"))
    rows = algn.where("q <> s").select("hg", "q", "s", "s_ome").join(known(members.select(*FAMILY, F.col("gene").alias("q"), F.col("ome").alias("q_ome"))), ["hg", "q"])
    rows = rows.join(known(members.select(*FAMILY, F.col("gene").alias("s"), F.lit(True).alias("member"))), [*FAMILY, "s"], "left")
    rows = rows.join(known(members.select(*FAMILY, F.col("ome").alias("s_ome"), F.lit(True).alias("inside")).distinct()), [*FAMILY, "s_ome"], "left")
    counts = (F.col("member").isNotNull() & (F.col("s_ome") != F.col("q_ome"))) | F.col("inside").isNull()
    bare = rows.groupBy(*FAMILY, "q").agg(F.max(counts).alias("counts")).where("not counts").select(*FAMILY, F.col("q").alias("gene"))
    return lone.unionAll(bare).distinct()


def pruned(algn: DataFrame, members: DataFrame, loci: DataFrame, least_genomes: int = 3, through: bool = False) -> DataFrame:
    """hlg, locus, genes, failed, stays of all loci: what is left when genes, then loci, then families without support are gone.

    members: (hlg, hg, gene, ome); loci: (hlg, locus, gene, ome), with all of a locus's genes. Groups of one gene are not
    judged. Genes that fail leave their groups, and groups that lost one are judged again, they alone, until none fails. A locus
    goes with all of its genes but one, a family with fewer than ``least_genomes`` genomes in its loci. ``through``: genes that go
    with their locus or family count as failed in their groups, and all starts again from these.
    """
    several = members.groupBy(*FAMILY).agg(F.count_distinct("gene").alias("n")).where("n > 1")
    now = once(members.select(*FAMILY, "gene", "ome").distinct().join(several, [*FAMILY], "left_semi"))
    loci = once(loci.select("hlg", "locus", "gene", "ome").distinct())
    failed, touched = None, now.select(*FAMILY).distinct()
    while True:
        bad = once(failing(algn, now.join(touched, [*FAMILY], "left_semi")))
        while not bad.isEmpty():
            failed = bad if failed is None else once(failed.unionAll(bad))
            now, touched = once(now.join(bad, [*FAMILY, "gene"], "left_anti")), bad.select(*FAMILY).distinct()
            bad = once(failing(algn, now.join(touched, [*FAMILY], "left_semi")))
        gone = failed.select("hlg", "gene", F.lit(1).alias("gone")).distinct() if failed is not None else loci.select("hlg", "gene", F.lit(1).alias("gone")).limit(0)
        judged = loci.join(gone, ["hlg", "gene"], "left").groupBy("hlg", "locus").agg(F.count("*").alias("genes"), F.count("gone").alias("failed"))
        judged = judged.withColumn("whole", (F.col("failed") == 0) | (F.col("failed") < F.col("genes") - 1))
        large = loci.join(judged.where("whole"), ["hlg", "locus"], "left_semi").groupBy("hlg").agg(F.count_distinct("ome").alias("n")).where(F.col("n") >= least_genomes)
        out = once(judged.join(large.select("hlg", F.lit(True).alias("large")), "hlg", "left").select("hlg", "locus", "genes", "failed", (F.col("whole") & F.col("large").isNotNull()).alias("stays")))
        if not through:
            return out
        # A gene stays in its groups as long as one of its loci stays.
        kept = loci.join(out.where("stays"), ["hlg", "locus"], "left_semi").select("hlg", "gene")
        fallen = once(now.join(kept, ["hlg", "gene"], "left_anti"))
        if fallen.isEmpty():
            return out
        failed = once((fallen if failed is None else failed.unionAll(fallen.select(*FAMILY, "gene"))).select(*FAMILY, "gene"))
        now, touched = once(now.join(fallen, [*FAMILY, "gene"], "left_anti")), fallen.select(*FAMILY).distinct()
