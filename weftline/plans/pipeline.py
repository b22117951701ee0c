"""The detection run as stages over DataFrames, each kept under a hash of what it depends on.

    python -m weftline.plans.pipeline --genes genes.parquet --tree tree.nwk --alignments algn.parquet --out results

A stage's folder is named by the settings that it and the stages before it use, so a changed setting computes that
stage and those after it anew, and a changed filter only re-reads the families.
"""

from __future__ import annotations

import argparse
import dataclasses
import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.frames import once, written
from weftline.functions.scalars import percent_flag
from weftline.operators import filters, graph, itemsets, loci, nulls, positional, proxies, similarity, tree
from weftline.sources import formats, sinks


@dataclasses.dataclass(frozen=True)
class Settings:
    window: int = 2
    samples: int = 10_000
    seed: str = "null"
    rank: str = "species"
    pair_percentile: float = 0.20
    set_percentile: float = 0.61
    max_distance: bool = False
    unique_species: bool = False
    coefficient: str = "sorensen"
    least_identity: float = 45.0
    least_locus_weight: float = 0.30
    domain_inflation: float = 1.1
    family_inflation: float = 1.3
    least_genomes: int = 3
    least_branch_similarity: float = 0.25
    tune: str = ""
    tmd: float = 0.0
    gcl: float = 0.0
    pds: float = 0.0
    mmi: float = 0.0
    mmp: float = 0.0
    csb: float = 0.0

    def __post_init__(self) -> None:
        if self.max_distance and self.unique_species:
            raise ValueError("max_distance and unique_species exclude each other")
        if self.least_identity < 30:
            raise ValueError("least_identity is 30 or more")


#: Settings that each stage adds to those before it.
USES = {
    "pairs": ("window",),
    "pair_scores": ("max_distance", "unique_species", "rank", "samples", "seed", "pair_percentile"),
    "sets": ("set_percentile",),
    "clans": (),
    "loci": ("least_branch_similarity",),
    "families": ("coefficient", "least_identity", "least_locus_weight", "domain_inflation", "family_inflation", "least_genomes", "tune"),
    "family_loci": (),
    "scores": (),
}


def stage_key(settings: Settings, stage: str) -> str:
    names = []
    for name, uses in USES.items():
        names += uses
        if name == stage:
            break
    return hashlib.sha256(json.dumps({n: getattr(settings, n) for n in names}, sort_keys=True).encode()).hexdigest()[:16]


class Run:
    """genes(ome, scaffold, pos, gene, hg), genomes(ome, ranks ...), tree(node, parent, length, tip), alignments(q, s, ppos, pident)."""

    def __init__(self, genes: DataFrame, genomes: DataFrame, tree_rows: DataFrame, alignments: DataFrame, out: str, settings: Settings | None = None):
        self.spark, self.genes, self.genomes, self.algn, self.out = genes.sparkSession, genes, genomes, alignments, out
        self.settings = settings or Settings()
        self.closure = tree.closure(tree_rows)
        self.stats = tree.node_stats(tree_rows, self.closure)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.out}/{name}-{stage_key(self.settings, name)}"
        if not written(self.spark, path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def distances(self, sets: DataFrame) -> DataFrame:
        """omes, score of distinct genome sets."""
        ids = sets.select(F.col("omes").alias("set_id"), "omes").distinct()
        if self.settings.unique_species:
            ids = tree.one_genome_a_species(ids, self.genomes.select("ome", "species"))
        column = "mmd" if self.settings.max_distance else "tmd"
        return tree.set_distances(ids, self.stats, self.closure).select(F.col("set_id").alias("omes"), F.col(column).alias("score"))

    def parts(self) -> DataFrame:
        return nulls.partitions(self.genomes, self.settings.rank)

    def significant(self, combos: DataFrame, share: float, strict: bool) -> DataFrame:
        """key, omes, score of the itemsets (ome, key) that reach the null percentile of their partitions."""
        s = self.settings
        picks = nulls.draws(combos, self.parts(), s.samples, s.seed)
        sets = combos.groupBy("key").agg(F.array_sort(F.collect_set("ome")).alias("omes"))
        scored = sets.join(self.distances(sets.where(F.size("omes") > 1)), "omes", "left").withColumn("score", F.when(F.size("omes") > 1, F.coalesce("score", F.lit(0.0))).otherwise(0.0))
        values = picks.join(scored.select("key", F.col("score").alias("value")), "key").select("part", "value")
        return nulls.supported(scored.where(F.size("omes") > 1), self.parts(), nulls.thresholds(values, share), strict)

    def pairs(self) -> DataFrame:
        return self.stage("pairs", lambda: positional.window_pairs(self.genes, self.settings.window))

    def pair_scores(self) -> DataFrame:
        """hg0, hg1, n_omes, score of significant pairs."""

        def make() -> DataFrame:
            kept = self.significant(self.pairs().select("ome", F.array("hg0", "hg1").alias("key")), self.settings.pair_percentile, False)
            return kept.select(F.get("key", F.lit(0)).alias("hg0"), F.get("key", F.lit(1)).alias("hg1"), F.size("omes").cast("long").alias("n_omes"), "score")

        return self.stage("pair_scores", make)

    def bars(self, sizes: list[int]) -> DataFrame:
        """size, part, threshold of itemsets of these sizes; the draws' tallies are kept by size and part."""
        parts = once(self.parts())

        def make(size: int, wanted: list[int]) -> DataFrame:
            combos = positional.window_combinations(self.genes, size, self.settings.window).select("ome", F.col("items").alias("key"))
            picks = once(nulls.draws(combos, parts.where(F.col("part").isin(wanted)), self.settings.samples, self.settings.seed))
            held = once(combos.join(picks.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("ome")).alias("omes")))
            drawn = picks.join(held, "key").join(self.distances(held.where(F.size("omes") > 1)), "omes", "left")
            return drawn.select("part", F.coalesce("score", F.lit(0.0)).alias("value"))

        ids = [r.part for r in parts.select("part").distinct().orderBy("part").collect()]  # a row for each taxon
        if not ids:
            return self.spark.createDataFrame([], "size int, part long, threshold double")
        tallies = nulls.stored_tallies(self.spark, f"{self.out}/nulls-{stage_key(self.settings, 'pair_scores')}", sizes, ids, make)
        return nulls.carried(nulls.tallied_thresholds(tallies, self.settings.set_percentile))

    def sets(self) -> DataFrame:
        """hgx_id, items, omes, score of significant itemsets; each size has its own null distribution, and where sets of one size
        pass without support, larger ones do."""

        def make() -> DataFrame:
            seeded = positional.seeded_windows(self.genes, self.pair_scores(), self.settings.window)
            # Counts take 2 ** (2 w - 1) sets a window, so very wide ones are met in pairs.
            found = (itemsets.rolled_shared(seeded) if self.settings.window <= 4 else itemsets.roll_up(itemsets.shared_sets(seeded))).select("items", "omes")
            scored = once(found.join(self.distances(found), "omes"))
            sizes = list(range(3, 2 * self.settings.window + 2))
            bars, out = once(self.bars(sizes)), None
            for size in sizes:
                own = bars.where(F.col("size") == size).select("part", "threshold")
                kept = nulls.supported(scored.where(F.size("items") == size).withColumnRenamed("items", "key"), self.parts(), own, True)
                out = kept if out is None else out.unionByName(kept)
            return nulls.numbered(out.select(F.col("key").alias("items"), "omes", "score"), "items")

        return self.stage("sets", make)

    def spans(self) -> DataFrame:
        return positional.spans(self.genes, self.sets().select(F.col("hgx_id").alias("set_id"), "items"), self.settings.window)

    def clans(self) -> DataFrame:
        """set_id, clan: itemsets linked by genes that both annotate."""

        def make() -> DataFrame:
            notes = positional.genes_between(self.genes, self.spans().drop("pos")).select("ome", "gene", "set_id").distinct()
            return graph.clans(self.sets().select(F.col("hgx_id").alias("set_id")), similarity.gene_links(notes))

        return self.stage("clans", make)

    def loci(self) -> DataFrame:
        """locus, clan, ome, scaffold, first, last, set_ids: disjoint loci of each clan."""

        def make() -> DataFrame:
            sets = self.sets().select(F.col("hgx_id").alias("set_id"), "omes", "score")
            rows = self.spans().join(self.clans(), "set_id").join(sets.select("set_id", "score"), "set_id")
            alike = tree.similarity_of(sets.select("set_id", "omes"), self.stats, self.closure)
            found = loci.clan_loci(rows, alike, 2 * self.settings.window + 1, self.settings.least_branch_similarity)
            return nulls.numbered(found.withColumn("place", F.struct("clan", "ome", "scaffold", "first")), "place").withColumnRenamed("hgx_id", "locus").drop("place")

        return self.stage("loci", make)

    def members(self) -> DataFrame:
        """block, locus, hg, gene, ome of the genes of loci."""
        found = positional.genes_between(self.genes, self.loci())
        return found.select(F.col("clan").alias("block"), "locus", "hg", "gene", "ome")

    def grouped_loci(self) -> DataFrame:
        """hlg, hlc, n_loci, omes, hgs of families, and ome, scaffold, first, last of each of their loci."""

        def make() -> DataFrame:
            s = self.settings
            places = self.loci().select(F.col("clan").alias("block"), "locus", "ome", "scaffold", "first", "last")
            known = None
            if s.tune:
                own = f"array<{dict(self.genes.dtypes)['ome']}>"
                known = formats.tunes(self.spark, s.tune, self.genes).withColumns({c: F.col(c).cast(own) for c in ("omes", "false_omes")})
            families, members, placed, _ = loci.rounds(
                places, self.members().drop("ome"), self.algn.select("q", "s", "pident"), self.genes, known, s.coefficient, s.least_identity, s.least_locus_weight, (s.domain_inflation, s.family_inflation), s.least_genomes
            )
            found = families.join(members.withColumnRenamed("node", "locus"), "cluster").join(placed.drop("block"), "locus")
            return found.select(F.col("cluster").alias("hlg"), F.col("block").alias("hlc"), "n_loci", "omes", "hgs", "ome", "scaffold", "first", "last")

        return self.stage("families", make)

    def families(self) -> DataFrame:
        """hlg, hlc, n_loci, omes, hgs."""
        return self.grouped_loci().select("hlg", "hlc", "n_loci", "omes", "hgs").dropDuplicates(["hlg"])

    def ends_of(self, algn: DataFrame) -> DataFrame:
        """Alignments (q, s, ...) with hg, q_ome, s_ome."""
        genes = self.genes.where("hg is not null").select("gene", "hg", "ome")
        return algn.join(genes.select(F.col("gene").alias("q"), "hg", F.col("ome").alias("q_ome")), "q").join(genes.select(F.col("gene").alias("s"), F.col("ome").alias("s_ome")), "s")

    def family_loci(self) -> DataFrame:
        """hlg, ome, scaffold, first, last, gene, hg, member: the genes of the families' loci, when these have been extended, have
        claimed scaffold ends and have lost what has no support. member: whether a gene's group is the family's."""

        def make() -> DataFrame:
            groups = once(self.families().select(F.col("hlg").alias("family"), F.coalesce("hgs", F.array().cast("array<int>")).alias("hgs")))
            grown = once(loci.extended(self.grouped_loci().select(F.col("hlg").alias("family"), "ome", "scaffold", "first", "last"), self.genes, groups))
            wide = grown.select("family", "ome", "scaffold", F.col("new_first").alias("first"), F.col("new_last").alias("last"))
            wide = wide.unionByName(loci.edge_claims(grown, self.genes, groups)).distinct()
            inside = positional.genes_between(self.genes, wide).join(groups, "family")
            inside = once(inside.select(F.col("family").alias("hlg"), F.struct("ome", "scaffold", "first", "last").alias("locus"), "ome", "gene", "hg", F.coalesce(F.array_contains("hgs", F.col("hg")), F.lit(False)).alias("member")))
            judged = proxies.pruned(once(self.ends_of(self.algn)), inside.where("member").select("hlg", "hg", "gene", "ome"), inside, self.settings.least_genomes)
            kept = inside.join(judged.where("stays").select("hlg", "locus"), ["hlg", "locus"], "left_semi")
            return kept.select("hlg", "locus.*", "gene", "hg", "member")

        return self.stage("family_loci", make)

    def scores(self) -> DataFrame:
        """Families with the genomes that are left, nrm_log_tmd, pds, apds, gcl, mmi, mmp."""

        def make() -> DataFrame:
            rows = self.family_loci()
            omes = once(rows.groupBy("hlg").agg(F.array_sort(F.collect_set("ome")).alias("omes")))
            families = self.families().drop("omes").join(omes, "hlg")
            sets = omes.select(F.col("hlg").alias("set_id"), "omes")
            far = tree.set_distances(sets, self.stats, self.closure).select(F.col("set_id").alias("hlg"), "tmd", "pds")
            members = once(rows.where("member").select("hlg", "hg", "gene", "ome").distinct())
            algn = once(self.ends_of(self.algn))
            best = proxies.best_by_genome(proxies.gene_commitment(proxies.hits_until_complete(algn, members)))
            missing = tree.missing_tips(sets, self.stats, self.closure).select(F.col("set_id").alias("hlg"), F.col("tip").alias("ome"))
            lost = proxies.lost_genomes(algn, members, missing, kind=dict(omes.dtypes)["omes"]).join(omes, "hlg").select(F.col("hlg").alias("set_id"), F.array_union("omes", "lost").alias("omes"))
            apds = tree.set_distances(lost, self.stats, self.closure).select(F.col("set_id").alias("hlg"), F.col("pds").alias("apds"))
            return filters.log_scaled(families.join(far, "hlg").join(proxies.family_scores(best), "hlg").join(apds, "hlg", "left"), "tmd", "nrm_log_tmd")

        return self.stage("scores", make)

    def outputs(self, path: str) -> None:
        """All result tables under ``path``: pairs, itemsets, families, those that pass, and the loci of these in a folder for each genome."""
        passing = self.clusters()
        sinks.pairs(self.pair_scores(), f"{path}/hgps")
        sinks.itemsets(self.sets(), f"{path}/hgxs")
        sinks.families(self.scores(), f"{path}/hlgs")
        sinks.families(passing, f"{path}/gcfs")
        sinks.family_store(self.scores(), f"{path}/store")
        kept = self.family_loci().join(passing.select("hlg"), "hlg", "left_semi").join(self.genes.select("gene", "pos"), "gene")
        at = F.array_sort(F.collect_list(F.struct("pos", "gene", "hg")))
        whole = kept.dropDuplicates(["hlg", "ome", "scaffold", "first", "last", "gene"]).groupBy("ome", "scaffold", "first", "last", "hlg").agg(at.alias("at"))
        several = whole.groupBy("ome", "scaffold", "first", "last").agg(F.first("at").alias("at"), F.array_sort(F.collect_set("hlg")).alias("families"))
        named = positional.named_loci(several)
        sinks.loci(named.select("ome", "name", F.transform("at", lambda x: x["hg"]).alias("hgs"), F.transform("at", lambda x: x["gene"]).alias("genes"), "families"), f"{path}/loci")

    def clusters(self) -> DataFrame:
        """Families that pass the thresholds: read from the scores, nothing before them is computed again."""
        s = self.settings
        return filters.passing(self.scores(), s.tmd, s.gcl, s.pds, s.mmi, s.mmp, s.csb)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("genes", "genomes", "tree", "alignments", "out"):
        p.add_argument(f"--{name}", required=True)
    shares = ("pair_percentile", "set_percentile", "least_locus_weight", "least_branch_similarity", "tmd", "gcl", "pds", "csb")
    for f in dataclasses.fields(Settings):
        kind = percent_flag if f.name in shares else type(f.default)
        p.add_argument(f"--{f.name.replace('_', '-')}", **({"action": "store_true"} if f.default is False else {"type": kind, "default": f.default}))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    text = "".join(r.value for r in spark.read.text(a.tree).collect())
    rows = spark.createDataFrame(formats.newick(text), "node long, parent long, length double, tip string")
    read = spark.read.parquet
    run = Run(read(a.genes), read(a.genomes), rows, read(a.alignments), a.out, Settings(**{f.name: getattr(a, f.name) for f in dataclasses.fields(Settings)}))
    run.outputs(f"{a.out}/results")


if __name__ == "__main__":
    main()
