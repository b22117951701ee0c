"""Loci: shares of overlapping candidates, what becomes of the rests, extension, and the two rounds that turn loci into families."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.frames import known, once
from weftline.operators.filters import satisfied
from weftline.operators.graph import clustered, markov_clusters, placed_links
from weftline.operators.positional import merge_neighbours
from weftline.operators.similarity import locus_similarity


PLACE = ("clan", "ome", "scaffold")


def shares(candidates: DataFrame) -> DataFrame:
    """clan, ome, scaffold, first, last, set_id, score: disjoint shares of candidates with the same columns.

    By falling score (then first, last, set_id), a candidate takes its places; what later ones lose is cut out, and each
    contiguous rest is a share of its own. The order decides, so each clan's scaffold is worked through in one task, in the order in which Spark
    has sorted it; a task goes through its scaffolds row by row, and holds the taken places of one.
    """
    columns = [*PLACE, "first", "last", "set_id", "score"]
    kinds = dict(candidates.dtypes)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = None, set()
        for batch in batches:
            rows, starts, ends = [], [], []
            for row, (key, first, last) in enumerate(zip(zip(*(batch.column(c).to_pylist() for c in PLACE), strict=True), batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True)):
                if key != now:
                    now, taken = key, set()
                start = None
                for p in range(first, last + 1):
                    if p in taken:
                        if start is not None:
                            rows.append(row), starts.append(start), ends.append(p - 1)
                        start = None
                    else:
                        taken.add(p)
                        start = p if start is None else start
                if start is not None:
                    rows.append(row), starts.append(start), ends.append(last)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(starts, kept.column(c).type) if c == "first" else pa.array(ends, kept.column(c).type) if c == "last" else kept.column(c) for c in columns], columns)

    placed = candidates.select(*columns).repartition(*PLACE).sortWithinPartitions(*PLACE, F.desc("score"), "first", "last", "set_id")
    return placed.mapInArrow(settle, ", ".join(f"{c} {kinds[c]}" for c in columns))


def places(loci: DataFrame, *more: str) -> DataFrame:
    """clan, ome, scaffold, pos (and others) of what the loci hold."""
    return loci.select(*PLACE, *more, F.explode(F.sequence("first", "last")).alias("pos"))


def islands(singles: DataFrame, least: int = 1) -> DataFrame:
    """clan, ome, scaffold, first, last of runs of ``least`` or more neighbouring places."""
    at = Window.partitionBy(*PLACE).orderBy("pos")
    marked = singles.select(*PLACE, "pos").distinct().withColumn("_island", F.col("pos") - F.row_number().over(at))
    return marked.groupBy(*PLACE, "_island").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).where(F.col("last") - F.col("first") + 1 >= least).drop("_island")


def rematched(runs: DataFrame, known: DataFrame, longest: int, by: tuple[str, ...] = PLACE, least: int = 3) -> DataFrame:
    """Known loci (by, first, last and others) that lie within runs (by, run_first, run_last), with rank in the run: by falling
    score, then the longer, then the first.

    A run's stretches of ``least`` to ``longest`` places index it: they are met by equality, not by ranges.
    """
    sizes = F.sequence(F.lit(least), F.least(F.lit(longest), F.col("run_last") - F.col("run_first") + 1))
    stretches = runs.where(F.col("run_last") - F.col("run_first") + 1 >= least).withColumn("_size", F.explode(sizes))
    stretches = stretches.withColumn("first", F.explode(F.sequence("run_first", F.col("run_last") - F.col("_size") + 1)))
    stretches = stretches.withColumn("last", F.col("first") + F.col("_size") - 1).drop("_size")
    order = Window.partitionBy(*by, "run_first").orderBy(F.desc("score"), F.desc(F.col("last") - F.col("first")), "first")
    return stretches.join(known, [*by, "first", "last"]).withColumn("rank", F.row_number().over(order))


def attached(singles: DataFrame, loci: DataFrame, similarity: Callable[[DataFrame], DataFrame], least: float = 0.25) -> DataFrame:
    """Singles (clan, ome, scaffold, pos, set_id) with the locus that each joins, null if none.

    loci: clan, ome, scaffold, locus, first, last, set_id; similarity: of pairs of sets (a, b), with a column similarity. In rounds,
    every single beside a locus, or beside a single that has joined one, joins the one of the two sides whose set is more
    similar to its own, if it is so by more than ``least``; of equal ones, the smaller locus. Within a run of singles only
    the loci at its two ends can be joined, each by an unbroken row of similar singles from its end on, and each place in
    the round that its distance from the end tells. So the rounds needn't be run: a single joins the side that reaches it first.
    """
    at = Window.partitionBy(*PLACE).orderBy("pos")
    rows = singles.dropDuplicates([*PLACE, "pos"]).withColumn("_island", F.col("pos") - F.row_number().over(at))
    run = Window.partitionBy(*PLACE, "_island")
    rows = rows.withColumns({"_from_left": F.col("pos") - F.min("pos").over(run) + 1, "_from_right": F.max("pos").over(run) - F.col("pos") + 1})
    beside = loci.select(*PLACE, "locus", F.col("set_id").alias("other"), "first", "last")
    for side, end, step in (("left", "last", 1), ("right", "first", -1)):
        edge = F.col("pos") - step * (F.col(f"_from_{side}") - 1)  # the run's first place on this side
        near = beside.select(*PLACE, (F.col(end) + step).alias("_edge"), F.col("locus").alias(f"_{side}"), F.col("other").alias(f"_{side}_set"))
        rows = rows.withColumn("_edge", edge).join(near, [*PLACE, "_edge"], "left").drop("_edge")
    rows = once(rows)
    asked = rows.select("set_id", F.explode(F.array("_left_set", "_right_set")).alias("b")).where("b is not null").select(F.col("set_id").alias("a"), "b").distinct()
    known = once(similarity(asked).select("a", "b", "similarity"))
    for side in ("left", "right"):
        rows = rows.join(known.toDF("set_id", f"_{side}_set", f"_{side}_similarity"), ["set_id", f"_{side}_set"], "left")
        up_to = run.orderBy(f"_from_{side}").rowsBetween(Window.unboundedPreceding, 0)
        unbroken = F.min(F.coalesce(f"_{side}_similarity", F.lit(-1.0))).over(up_to) > least
        rows = rows.withColumn(f"_{side}_round", F.when(unbroken, F.col(f"_from_{side}")))
    choice = lambda side: F.when(F.col(f"_{side}_round").isNotNull(), F.struct(F.col(f"_{side}_round").alias("round"), (-F.col(f"_{side}_similarity")).alias("far"), F.col(f"_{side}").alias("locus")))
    return rows.withColumn("locus", F.least(choice("left"), choice("right"))["locus"]).select(*singles.columns, "locus")


def chained(singles: DataFrame, similarity: Callable[[DataFrame], DataFrame], least: float = 0.25) -> DataFrame:
    """clan, ome, scaffold, first, last, set_ids of runs of two or more neighbouring singles, each similar to the next by more than ``least``."""
    at = Window.partitionBy(*PLACE).orderBy("pos")
    rows = once(singles.dropDuplicates([*PLACE, "pos"]).withColumns({"_before": F.lag("pos").over(at), "_set": F.lag("set_id").over(at)}))
    known = similarity(rows.where("_before = pos - 1").select(F.col("_set").alias("a"), F.col("set_id").alias("b")).distinct())
    rows = rows.join(known.select(F.col("a").alias("_set"), F.col("b").alias("set_id"), "similarity"), ["_set", "set_id"], "left")
    joins = (F.col("_before") == F.col("pos") - 1) & (F.col("similarity") > least)
    rows = rows.withColumn("_island", F.sum(F.when(joins, 0).otherwise(1)).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy(*PLACE, "_island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.array_sort(F.collect_set("set_id")).alias("set_ids"))
    return found.where("last > first").drop("_island")


def clan_loci(candidates: DataFrame, similarity: Callable[[DataFrame], DataFrame], longest: int, least_similarity: float = 0.25, least: int = 3) -> DataFrame:
    """clan, ome, scaffold, first, last, set_ids: disjoint loci.

    candidates: (clan, ome, scaffold, first, last, set_id, score), of ``longest`` places at most. Shares of ``least`` places or
    more are loci. Runs of the remaining places that hold known loci give these another try, until none does. Shares of two
    places are loci where none of the two was taken. Single places join loci beside them by the similarity of their sets;
    what is left forms loci of its own where neighbours are similar.
    """
    columns = [*PLACE, "first", "last", "set_id", "score"]
    size = F.col("last") - F.col("first") + 1
    candidates = once(candidates.select(*columns).distinct())
    cut = once(shares(candidates))
    known = candidates.groupBy(*PLACE, "first", "last").agg(F.max_by("set_id", F.struct("score", "set_id")).alias("set_id"), F.max("score").alias("score"))
    placed, rest = cut.where(size >= least), cut.where(size < least)
    open_ = places(rest)
    while True:
        runs = islands(open_, least).withColumnsRenamed({"first": "run_first", "last": "run_last"})
        again = once(shares(rematched(runs, known, longest).select(*columns)))
        if again.isEmpty():
            break
        placed, open_ = placed.unionAll(again.where(size >= least)), places(again.where(size < least))
    taken = once(places(placed).distinct())
    pairs = rest.where(size == 2)
    free = places(pairs, "first", "last").join(taken, [*PLACE, "pos"], "left_anti").groupBy(*PLACE, "first", "last").agg(F.count("*").alias("n")).where("n = 2")
    placed = placed.unionAll(pairs.join(free.drop("n"), [*PLACE, "first", "last"], "left_semi").select(*columns))
    placed = once(placed.withColumn("locus", F.struct(*PLACE, "first")))
    single = places(rest, "set_id", "score").join(places(placed), [*PLACE, "pos"], "left_anti").drop("score")
    joined = once(attached(single.select(*PLACE, "pos", "set_id"), placed, similarity, least_similarity))
    grown = joined.where("locus is not null").groupBy("locus").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    wide = placed.join(grown, "locus", "left").select(*PLACE, F.least("first", "low").alias("first"), F.greatest("last", "high").alias("last"), F.array("set_id").alias("set_ids"))
    return wide.unionByName(chained(joined.where("locus is null").drop("locus"), similarity, least_similarity))


def extended(loci: DataFrame, genes: DataFrame, families: DataFrame) -> DataFrame:
    """Loci (family, ome, scaffold, first, last) with new_first, new_last.

    families: (family, hgs), the groups of a family. In each step both ends move outwards by a gene whose group the family has
    and the locus lacked when the step began, and which no locus holds; an end stops at its first gene that isn't such. A
    step takes a missing group at least. Loci meet whole stretches of free genes of their family's groups, which windows find, not genes.
    """
    loci = once(loci.select("family", "ome", "scaffold", "first", "last").distinct())
    key = ["family", "ome", "scaffold", "first", "last"]
    spot = ["ome", "scaffold", "pos"]
    none = F.array().cast(dict(families.dtypes)["hgs"])
    marked = genes.select(*spot, "hg").join(loci.withColumn("pos", F.explode(F.sequence("first", "last"))), spot, "left")
    held = marked.where("first is not null").groupBy(*key).agg(F.collect_set("hg").alias("held"))
    rows = loci.join(held, key, "left").join(families, "family").select(*key, F.array_except(F.array_distinct("hgs"), F.coalesce("held", F.array().cast(dict(families.dtypes)["hgs"]))).alias("missing"))
    # Unbroken rows of free genes of a family's groups, as far as they lie beside a locus.
    at = Window.partitionBy("ome", "scaffold").orderBy("pos")
    taken = F.col("first").isNotNull()
    beside = F.coalesce(F.lag(taken).over(at), F.lit(False)) | F.coalesce(F.lead(taken).over(at), F.lit(False))
    own = known(families.select(F.col("family").alias("of"), F.explode("hgs").alias("hg")).where("hg is not null").distinct())
    free = marked.withColumn("beside", beside).where("first is null").select(*spot, "hg", "beside").join(own, "hg")
    free = free.withColumn("row", F.col("pos") - F.row_number().over(Window.partitionBy("ome", "scaffold", "of").orderBy("pos")))
    stretch = free.groupBy("ome", "scaffold", "of", "row").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.bool_or("beside").alias("beside"), F.array_sort(F.collect_list(F.struct("pos", "hg"))).alias("g"))
    stretch = stretch.where("beside").select("ome", "scaffold", F.col("of").alias("family"), "low", "high", F.col("g.hg").alias("hgs"))
    below = stretch.select("ome", "scaffold", "family", (F.col("high") + 1).alias("first"), F.reverse("hgs").alias("below"))
    above = stretch.select("ome", "scaffold", "family", (F.col("low") - 1).alias("last"), F.col("hgs").alias("above"))

    def fit(side):
        """The groups up to the first that isn't missing."""
        stop = F.array_position(F.transform(side, lambda h: F.array_contains("missing", h)), False)
        return F.coalesce(F.when(stop > 0, F.slice(side, F.lit(1), (stop - 1).cast("int"))).otherwise(F.col(side)), none)

    def step(state, i):
        """One gene further at each end that is still open."""
        goes = {side: state[f"{side}_open"] & (i <= F.size(side)) & ~F.coalesce(F.array_contains(state["taken"], F.get(side, i - 1)), F.lit(False)) for side in ("down", "up")}
        new = F.concat(*[F.when(goes[side], F.array(F.get(side, i - 1))).otherwise(none) for side in goes])
        return F.struct(*[x for side in goes for x in ((state[side] + goes[side].cast("int")).alias(side), goes[side].alias(f"{side}_open"))], F.concat(state["taken"], new).alias("taken"))

    start = F.struct(*[x for side in ("down", "up") for x in (F.lit(0).alias(side), F.lit(True).alias(f"{side}_open"))], none.alias("taken"))
    steps = F.sequence(F.lit(1), F.greatest(F.size("down"), F.size("up"), F.lit(1)))
    tracks = rows.join(below, ["family", "ome", "scaffold", "first"], "left").join(above, ["family", "ome", "scaffold", "last"], "left").select(*key, fit("below").alias("down"), fit("above").alias("up"))
    grown = tracks.withColumn("g", F.when((F.size("down") > 0) | (F.size("up") > 0), F.aggregate(steps, start, step)))
    moved = lambda side: F.coalesce(F.col(f"g.{side}"), F.lit(0))
    return grown.select(*key, (F.col("first") - moved("down")).alias("new_first"), (F.col("last") + moved("up")).alias("new_last"))


def edge_claims(grown: DataFrame, genes: DataFrame, families: DataFrame, least: int = 2) -> DataFrame:
    """family, ome, scaffold, first, last of scaffold ends that families claim for loci cut off by a scaffold's end.

    grown: what ``extended`` returns. A locus that began or ended its scaffold before it was extended, and still lacks ``least``
    groups or more, looks at the genome's other scaffolds in their order: the first of which an end, its first or last ``least`` genes,
    is free of loci and holds so many of the missing groups is claimed, or both ends, if both do and differ. Claims are
    settled in the order of family, scaffold and first; one whose genes another locus or claim holds by then falls.
    An end is claimed or free as a whole, and only the two ends of a scaffold can share genes, so its first claim wins, and the
    first on the other end if the two are apart.
    """
    key = ["family", "ome", "scaffold", "first", "last"]
    at = Window.partitionBy("ome", "scaffold")
    placed = genes.select("ome", "scaffold", "pos", "hg", F.max("pos").over(at).alias("end"))
    ends = placed.where((F.col("pos") < least) | (F.col("pos") > F.col("end") - least)).where(F.col("end") >= least - 1)
    ends = ends.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).where(F.when(F.col("side") == 0, F.col("pos") < least).otherwise(F.col("pos") > F.col("end") - least))
    ends = ends.groupBy("ome", "scaffold", "end", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("hg", F.lit(-1)).alias("hg")))), lambda x: x["hg"]).alias("hgs"))
    ends = ends.select("ome", "scaffold", "side", "hgs", F.when(F.col("side") == 0, 0).otherwise(F.col("end") - least + 1).cast("int").alias("first"), F.when(F.col("side") == 0, least - 1).otherwise(F.col("end")).cast("int").alias("last"), (F.col("end") >= 2 * least - 1).alias("apart"))
    # A scaffold has two ends, so these meet its loci as stretches, not place by place.
    used = lambda first, last: grown.select("ome", "scaffold", F.col(first).alias("low"), F.col(last).alias("high"))
    hit = lambda df, used: df.select("ome", "scaffold", "side", "first", "last").join(used, ["ome", "scaffold"]).where("low <= last and high >= first").select("ome", "scaffold", "side").distinct()
    free = once(ends.join(hit(ends, used("first", "last")), ["ome", "scaffold", "side"], "left_anti"))
    lengths = genes.groupBy("ome", "scaffold").agg(F.max("pos").alias("end"))
    cut_off = grown.join(lengths, ["ome", "scaffold"]).where((F.col("first") == 0) | (F.col("last") == F.col("end"))).drop("end")
    inside = cut_off.withColumn("pos", F.explode(F.sequence("new_first", "new_last"))).join(genes.select("ome", "scaffold", "pos", "hg"), ["ome", "scaffold", "pos"])
    held = inside.groupBy(*key).agg(F.collect_set("hg").alias("held"))
    lack = cut_off.join(held, key, "left").join(families, "family").withColumn("missing", F.array_except(F.array_distinct("hgs"), F.coalesce("held", F.array().cast(dict(families.dtypes)["hgs"])))).where(F.size("missing") >= least)
    # Ends meet loci by their first group, which must be missing like all others.
    asked = lack.select(*key, "missing", F.explode("missing").alias("hg"))
    other = free.select("ome", F.col("scaffold").alias("other"), "side", "hgs", F.col("first").alias("a"), F.col("last").alias("b"), "apart", F.element_at("hgs", 1).alias("hg"))
    met = asked.join(other, ["ome", "hg"]).where("other <> scaffold").where((F.size(F.array_distinct("hgs")) == least) & (F.size(F.array_except("hgs", "missing")) == 0))
    near = met.withColumn("r", F.dense_rank().over(Window.partitionBy(*key).orderBy("other"))).where("r = 1")
    same = F.lag("hgs").over(Window.partitionBy(*key).orderBy("side"))
    near = near.withColumn("same", same).where("same is null or same <> hgs")
    claims = near.select(F.struct(*key).alias("order"), "family", "ome", F.col("other").alias("scaffold"), "side", F.col("a").alias("first"), F.col("b").alias("last"), "apart")
    claims = once(claims.join(hit(claims, used("new_first", "new_last")), ["ome", "scaffold", "side"], "left_anti"))
    by_end = claims.withColumn("r", F.row_number().over(Window.partitionBy("ome", "scaffold", "side").orderBy("order"))).where("r = 1")
    won = by_end.withColumn("r", F.row_number().over(at.orderBy("order", "side"))).where("r = 1 or apart")
    return won.select("family", "ome", "scaffold", "first", "last")


def modules(members: DataFrame, loci: DataFrame, locus_genes: DataFrame, least_genomes: int = 3) -> DataFrame:
    """cluster, block, n_loci, hgs, omes of clusters with two loci and ``least_genomes`` genomes or more.

    members: (node, cluster), node being a locus; loci: (block, locus, ome). hgs: the groups that occur in two or more
    of the cluster's loci.
    """
    placed = members.withColumnRenamed("node", "locus").join(loci, "locus")
    kept = placed.groupBy("cluster").agg(F.min("block").alias("block"), F.count("*").alias("n_loci"), F.array_sort(F.collect_set("ome")).alias("omes")).where((F.col("n_loci") > 1) & (F.size("omes") >= least_genomes))
    common = placed.select("cluster", "locus").join(locus_genes.where("hg is not null").select("locus", "hg").distinct(), "locus").groupBy("cluster", "hg").agg(F.count("*").alias("n")).where("n > 1")
    return kept.join(common.groupBy("cluster").agg(F.array_sort(F.collect_set("hg")).alias("hgs")), "cluster", "left")


def linked(weights: DataFrame) -> DataFrame:
    """Similarities of loci as links, written once."""
    return once(weights.select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("weight").alias("w")))


def tuned(weights: DataFrame, loci: DataFrame, locus_genes: DataFrame, tunes: DataFrame, inflations: list[float], least_genomes: int = 3) -> tuple[float, DataFrame, DataFrame]:
    """(inflation, members, families) of the first inflation at which all known clusters (name, hgs, omes, false_omes) are found.

    weights: the similarities of loci (i, j, weight), whose components are found and which are written once, to be clustered for each
    inflation. A ValueError names the clusters that the last one missed.
    """
    nodes, links = placed_links(linked(weights))
    links = once(links)
    missed: list[str] = []
    for inflation in inflations:
        members = once(clustered(nodes, links, inflation))
        families = once(modules(members, loci, locus_genes, least_genomes))
        missed = [r.name for r in satisfied(tunes, families.select("hgs", "omes")).where("not satisfied").orderBy("name").limit(20).collect()]
        if not missed:
            return inflation, members, families
    raise ValueError(f"no inflation finds {', '.join(missed)}")


def merged_loci(placed: DataFrame, genes: DataFrame, max_between: int = 2) -> tuple[DataFrame, DataFrame]:
    """(block, locus, ome, scaffold, first, last) of loci of one block that stand next to each other on a scaffold, as one, and their
    genes (block, locus, hg, gene). A merged locus has the number of its first."""
    order = Window.partitionBy("block", "ome", "scaffold").orderBy("first", "last")
    gap = F.col("first") - F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)) - 1
    marked = placed.withColumn("_new", F.when(gap <= max_between, 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    wide = numbered.groupBy("block", "ome", "scaffold", "_island").agg(F.min_by("locus", F.struct("first", "last", "locus")).alias("locus"), F.min("first").alias("first"), F.max("last").alias("last"))
    wide = once(wide.select("block", "locus", "ome", "scaffold", "first", "last"))
    inside = wide.withColumn("pos", F.explode(F.sequence("first", "last"))).join(genes.select("ome", "scaffold", "pos", "hg", "gene"), ["ome", "scaffold", "pos"])
    return wide, once(inside.select("block", "locus", "hg", "gene"))


def rounds(loci: DataFrame, locus_genes: DataFrame, identities: DataFrame, genes: DataFrame | None = None, tunes: DataFrame | None = None, coefficient: str = "sorensen", least_identity: float = 30.0, least_weight: float = 0.0, inflations: tuple[float, float] = (1.1, 1.3), least_genomes: int = 3) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(families, members, loci, locus_genes) of two rounds: blocks of similar loci by overlap and a coarse clustering, then, within
    these, a finer one, over the loci as the second round saw them.

    loci: (block, locus, ome, scaffold, first, last); locus_genes: (block, locus, hg, gene). With all ``genes``, neighbouring loci of
    a block are merged between the rounds; with ``tunes``, the second round's inflation is the first from 1.2 to 3 that finds these.
    """
    weights = locus_similarity(locus_genes, identities, "overlap", least_identity, 1, least_weight)
    first = once(markov_clusters(linked(weights), inflations[0]))
    domains = modules(first, loci, locus_genes, least_genomes).select("cluster")
    placed = loci.drop("block").join(first.withColumnRenamed("node", "locus"), "locus").join(domains, "cluster").withColumnRenamed("cluster", "block")
    if genes is None:
        again = locus_genes.drop("block").join(placed.select("locus", "block"), "locus")
    else:
        placed, again = merged_loci(placed, genes)
    weights = locus_similarity(again, identities, coefficient, least_identity, 1, least_weight)
    if tunes is not None:
        _, second, families = tuned(weights, placed, again, tunes, [i / 10 for i in range(12, 31)], least_genomes)
    else:
        second = once(markov_clusters(linked(weights), inflations[1]))
        families = modules(second, placed, again, least_genomes)
    return families, second, placed, again


def two_rounds(loci: DataFrame, locus_genes: DataFrame, identities: DataFrame, **settings) -> DataFrame:
    """The families of ``rounds``."""
    return rounds(loci, locus_genes, identities, **settings)[0]


__all__ = ["attached", "chained", "clan_loci", "edge_claims", "extended", "islands", "merge_neighbours", "merged_loci", "modules", "rematched", "rounds", "shares", "tuned", "two_rounds"]
