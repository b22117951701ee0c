"""Distances of genome sets on a rooted tree.

tree(node, parent, length, tip): tip holds the genome of a leaf, null for inner nodes; no inner node has one child.

Tips are numbered in preorder, so that a clade is an interval of numbers and a set of genomes a few runs of them. A tree of up to
``BROADCAST_NODES`` nodes is broadcast as a table of intervals, and each distinct set is worked through where it lies; a
larger tree is met by joins with its closure. Lengths count with nine decimals: a branch below 1e-9 counts as none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.frames import known, once

#: Nodes of a tree that is broadcast (some 80 bytes each), and genomes of sets that a task works through at a time.
BROADCAST_NODES, PIECE = 1 << 20, 1 << 18
#: Bytes of the rows that a list of missing tips is unrolled to, about: Spark keeps all rows of a list at once, each with its set's name.
UNROLLED = 1 << 24
NANO = 10**9

def exact_sum(value: Column) -> Column:
    """A sum of doubles that is the same in any order: of their nine decimals."""
    return F.sum(value.cast("decimal(28,9)")).cast("double")


def closure(tree: DataFrame, max_depth: int = 64) -> DataFrame:
    """(anc, node, up): every node with each of its ancestors, itself included, and the distance between them.

    A join a level; the loop ends at the tree's height, so this suits trees, not chains of thousands of nodes.
    """
    tree = once(tree)
    step = tree.select("node", F.col("node").alias("anc"), F.lit(0.0).alias("up"))
    parents = tree.where("parent is not null").select(F.col("node").alias("anc"), "parent", "length")
    out = step
    for _ in range(max_depth):
        step = once(step.join(parents, "anc").select("node", F.col("parent").alias("anc"), (F.col("up") + F.col("length")).alias("up")))
        if step.isEmpty():
            return once(out)
        out = out.unionAll(step)
    raise ValueError(f"the tree is deeper than {max_depth}, or has a cycle")


def node_stats(tree: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """node, parent, length, tip, n_tips, desc_len, depth, max_tip_dist.

    desc_len: total length strictly below; max_tip_dist: largest distance of two tips below (0 for a tip).
    """
    pairs = closure(tree) if pairs is None else pairs
    below = pairs.join(tree.select("node", "length", "tip"), "node")
    sums = below.groupBy("anc").agg(exact_sum(F.when(F.col("node") != F.col("anc"), F.col("length")).otherwise(0.0)).alias("desc_len"), F.count("tip").alias("n_tips"), F.max(F.when(F.col("tip").isNotNull(), F.col("up"))).alias("reach"))
    depth = pairs.groupBy("node").agg((F.count("*") - 1).alias("depth"))
    # The longest path whose top is a node joins its two children of farthest reach; below it, another may be longer.
    arms = tree.where("parent is not null").join(sums.select(F.col("anc").alias("node"), "reach"), "node").select(F.col("parent").alias("anc"), (F.col("reach") + F.col("length")).alias("arm"))
    far = arms.withColumn("r", F.row_number().over(Window.partitionBy("anc").orderBy(F.desc("arm")))).where("r <= 2").groupBy("anc").agg(F.sum("arm").alias("across"))
    widest = pairs.join(far.withColumnRenamed("anc", "node"), "node").groupBy("anc").agg(F.max("across").alias("max_tip_dist"))
    out = tree.join(sums.drop("reach").withColumnRenamed("anc", "node"), "node").join(depth, "node").join(widest.withColumnRenamed("anc", "node"), "node", "left")
    return once(out.withColumn("max_tip_dist", F.coalesce("max_tip_dist", F.lit(0.0))))


def set_nodes(sets: DataFrame, stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """set_id, size, and for every ancestor of a member: node, c (members below), and the node's statistics."""
    members = once(sets.select("set_id", F.explode(F.array_distinct("omes")).alias("tip")).join(stats.where("tip is not null").select("node", "tip"), "tip").select("set_id", "node"))
    counts = members.join(pairs.select("node", "anc"), "node").groupBy("set_id", "anc").agg(F.count("*").alias("c"))
    sizes = members.groupBy("set_id").agg(F.count("*").alias("size"))
    return counts.withColumnRenamed("anc", "node").join(stats, "node").join(sizes, "set_id")


class Intervals:
    """A tree's nodes: the interval of tips below each, lengths as whole numbers of 1e-9."""

    def __init__(self, table: pa.Table, tip_type: pa.DataType):
        """Of columns node, parent, tip, n_tips, own, desc_len, max_tip_dist; nodes that no root reaches are left out."""
        while True:
            column = lambda c: table.column(c).combine_chunks()  # noqa: B023, E731
            self.node = column("node").cast(pa.int64())
            above = pc.index_in(column("parent").cast(pa.int64()), value_set=self.node)
            lost = pc.and_(column("parent").is_valid(), above.is_null())
            if not pc.any(lost).as_py():
                break
            table = table.filter(pc.invert(lost))
        self.parent = above.fill_null(-1).to_numpy().astype(np.int64)
        many = column("n_tips").to_numpy().astype(np.int64)
        # Tips before a node: those of its earlier siblings, and of its ancestors' earlier siblings.
        order = np.argsort(self.parent, kind="stable")
        before, group = np.cumsum(many[order]) - many[order], self.parent[order]
        first = np.searchsorted(group, group)
        earlier = np.empty_like(many)
        earlier[order] = before - before[first]
        self.low, up = earlier.copy(), self.parent.copy()
        while (on := np.flatnonzero(up >= 0)).size:
            self.low[on] += earlier[up[on]]
            up[on] = self.parent[up[on]]
        self.high = self.low + many - 1
        leaf = np.flatnonzero(column("tip").is_valid().to_numpy(zero_copy_only=False))
        self.leaf = leaf[np.argsort(self.low[leaf], kind="stable")]
        self.tips = column("tip").take(pa.array(self.leaf)).cast(tip_type)
        self.own = column("own").fill_null(0).to_numpy().astype(np.int64)
        self.desc_len, self.across = (column(c).to_numpy(zero_copy_only=False) for c in ("desc_len", "max_tip_dist"))

    def places(self, omes: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(row, tip) of the members of each list that the tree has, in order and without repeats."""
        rows = np.repeat(np.arange(len(omes)), pc.list_value_length(omes).fill_null(0).to_numpy())
        at = pc.index_in(omes.flatten(), value_set=self.tips).fill_null(-1).to_numpy().astype(np.int64)
        keys = np.unique(rows[at >= 0] * len(self.tips) + at[at >= 0])
        return keys // len(self.tips), keys % len(self.tips)

    def tops(self, rows: np.ndarray, tips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row that has members: its number, how many they are, and the place of their common ancestor."""
        found, first, sizes = np.unique(rows, return_index=True, return_counts=True)
        top, last = self.leaf[tips[first]], tips[first + sizes - 1]
        while (up := self.high[top] < last).any():
            top[up] = self.parent[top[up]]
        return found, sizes, top

    def covered(self, rows: np.ndarray, tips: np.ndarray, found: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Summed lengths of the largest clades below the ancestor whose tips are all members."""
        sums = np.zeros(len(found), np.int64)
        if not len(rows):
            return sums
        starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (tips[1:] != tips[:-1] + 1)]))
        stops = np.append(starts[1:], len(rows)) - 1
        run = np.repeat(np.arange(len(starts)), stops - starts + 1)
        least, most = tips[starts][run], tips[stops][run]
        row = np.searchsorted(found, rows)
        # From its first tip a clade climbs while its parent holds nothing but the run's tips; a tip inside a larger one drops out.
        clade, head, open_ = self.leaf[tips], np.ones(len(tips), bool), np.arange(len(tips))
        while len(open_):
            up = self.parent[clade[open_]]
            whole = (up >= 0) & (up != top[row[open_]]) & (self.low[up] >= least[open_]) & (self.high[up] <= most[open_])
            open_, up = open_[whole], up[whole]
            first = self.low[up] == tips[open_]
            head[open_[~first]] = False
            open_ = open_[first]
            clade[open_] = up[first]
        np.add.at(sums, row[head], self.own[clade[head]])
        return sums


def stretches(ends: np.ndarray, room: int) -> Iterator[tuple[int, int]]:
    """Where to cut what ends at ``ends``, so that each stretch has about ``room`` at most, or one thing."""
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room, side="right")))
        yield at, to
        at = to


def pieces(batch: pa.RecordBatch, column: str, room: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose lists have about ``room`` members in all."""
    for at, to in stretches(np.cumsum(pc.list_value_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64) + 1), room):
        yield batch.slice(at, to - at)


def shared_tree(stats: DataFrame, omes: str) -> Broadcast | None:
    """``Intervals`` of a tree for lists of the type ``omes``, or of None for a tree without nodes; None for one too large to be broadcast."""
    if stats.count() > BROADCAST_NODES:
        return None
    nano = (F.when(F.col("tip").isNotNull(), F.col("length")).otherwise(F.col("desc_len")).cast("decimal(28,9)") * F.lit(NANO)).cast("long")
    rows = stats.select("node", "parent", "tip", "n_tips", nano.alias("own"), "desc_len", "max_tip_dist").toArrow()
    kinds = {"string": pa.string(), "int": pa.int32()}
    return stats.sparkSession.sparkContext.broadcast(Intervals(rows, kinds.get(omes[6:-1], pa.int64())) if rows.num_rows else None)


def by_intervals(sets: DataFrame, stats: DataFrame, each: Callable[[Intervals, pa.RecordBatch], Iterator[pa.RecordBatch]], fields: str) -> DataFrame | None:
    """``each`` of the tree and of pieces of (set_id, omes), as rows of ``fields``; None for a tree that is too large to be broadcast."""
    shared = shared_tree(stats, dict(sets.dtypes)["omes"])
    if shared is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "omes", PIECE):
                yield from each(shared.value, piece)

    return sets.select("set_id", "omes").where(F.lit(shared.value is not None)).mapInArrow(run, fields)


def set_distances(sets: DataFrame, stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """set_id, mrca, tmd, mmd, pds, n_missing of genome sets (set_id, omes).

    tmd: summed length of the largest clades below the common ancestor whose tips all belong to the set (a tip's own
    branch, or what lies strictly below an inner node). pds: the share of the ancestor's clade that these leave out.
    Genomes that the tree lacks don't count; a set without any has no row.
    """

    def each(tree: Intervals, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, tips = tree.places(piece.column("omes"))
        found, sizes, top = tree.tops(rows, tips)
        tmd = np.where(sizes > 1, tree.covered(rows, tips, found, top) / NANO, 0.0)
        below = tree.high[top] - tree.low[top] + 1
        whole = below == sizes
        pds = np.where(whole, 0.0, 1 - tmd / np.where(whole, 1.0, tree.desc_len[top]))
        columns = [piece.column("set_id").take(pa.array(found)), tree.node.take(pa.array(top)), *map(pa.array, (tmd, tree.across[top], pds, below - sizes))]
        yield pa.RecordBatch.from_arrays(columns, ["set_id", "mrca", "tmd", "mmd", "pds", "n_missing"])

    fields = f"set_id {dict(sets.dtypes)['set_id']}, mrca long, tmd double, mmd double, pds double, n_missing long"
    found = by_intervals(sets, stats, each, fields)
    return distances_by_joins(sets, stats, pairs) if found is None else found


def distances_by_joins(sets: DataFrame, stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same for a tree of any size: members meet their ancestors, and ancestors their parents."""
    rows = once(set_nodes(sets, stats, pairs))
    top = rows.where("c = size").groupBy("set_id").agg(F.max_by("node", "depth").alias("mrca"))
    rows = rows.join(top, "set_id").withColumn("full", F.col("c") == F.col("n_tips"))
    up = rows.select("set_id", F.col("node").alias("parent"), F.col("full").alias("parent_full"))
    largest = rows.where("full and node <> mrca").join(up, ["set_id", "parent"]).where("parent = mrca or not parent_full")
    patch = largest.groupBy("set_id").agg(exact_sum(F.when(F.col("tip").isNotNull(), F.col("length")).otherwise(F.col("desc_len"))).alias("tmd"))
    head = rows.where("node = mrca").select("set_id", "mrca", "full", "n_tips", "size", "desc_len", F.col("max_tip_dist").alias("mmd")).join(patch, "set_id", "left")
    tmd = F.when(F.col("size") > 1, F.coalesce("tmd", F.lit(0.0))).otherwise(0.0)
    return head.select("set_id", "mrca", tmd.alias("tmd"), "mmd", F.when(F.col("full"), 0.0).otherwise(1 - tmd / F.col("desc_len")).alias("pds"), (F.col("n_tips") - F.col("size")).alias("n_missing"))


def missing_tips(sets: DataFrame, stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, tip): genomes below a set's common ancestor that it lacks."""
    found = missing_lists(sets, stats)
    return missing_by_joins(sets, stats, pairs) if found is None else found.select("set_id", F.explode("tips").alias("tip"))


def missing_lists(sets: DataFrame, stats: DataFrame) -> DataFrame | None:
    """set_id, tips: the same in lists, for Spark to unroll, so that a set's name stands once for many tips; None for a tree that is too large
    to be broadcast.

    A set may lack many more tips than it has, and its name may be long: lists end where their rows would take ``UNROLLED`` bytes.
    """

    def each(tree: Intervals, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, tips = tree.places(piece.column("omes"))
        found, _, top = tree.tops(rows, tips)
        n = tree.high[top] - tree.low[top] + 1
        for at, to in stretches(np.cumsum(n), PIECE):
            low, many = tree.low[top[at:to]], n[at:to]
            row = np.repeat(np.arange(to - at), many)
            below = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]
            own = slice(*np.searchsorted(rows, [found[at], found[to - 1] + 1]))
            lacks = ~np.isin(found[at:to][row] * len(tree.tips) + below, rows[own] * len(tree.tips) + tips[own])
            lacked = tree.tips.take(pa.array(below[lacks]))
            held = np.bincount(row[lacks], minlength=to - at)
            names = piece.column("set_id").take(pa.array(found[at:to]))
            text = pa.types.is_string(names.type) or pa.types.is_large_string(names.type)
            width = 32 + (pc.binary_length(names).to_numpy().astype(np.int64) if text else np.full(to - at, names.nbytes // (to - at)))
            room = np.maximum(1, UNROLLED // width)
            lists = -(-held // room)
            of = np.repeat(np.arange(to - at), lists)
            within = np.arange(len(of)) - np.repeat(np.cumsum(lists) - lists, lists)
            starts = np.append((np.cumsum(held) - held)[of] + within * room[of], len(lacked))
            for first, last in stretches(np.cumsum(width[of]), UNROLLED):
                kept = pa.ListArray.from_arrays(pa.array(starts[first : last + 1] - starts[first], pa.int32()), lacked.slice(starts[first], starts[last] - starts[first]))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(of[first:last])), kept], ["set_id", "tips"])

    return by_intervals(sets, stats, each, f"set_id {dict(sets.dtypes)['set_id']}, tips array<{dict(stats.dtypes)['tip']}>")


def missing_by_joins(sets: DataFrame, stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same for a tree of any size."""
    top = set_nodes(sets, stats, pairs).where("c = size").groupBy("set_id").agg(F.max_by("node", "depth").alias("mrca"))
    tips = stats.where("tip is not null").select("node", "tip")
    below = top.join(pairs.select(F.col("anc").alias("mrca"), "node"), "mrca").join(tips, "node").select("set_id", "tip")
    return below.join(sets.select("set_id", F.explode("omes").alias("tip")), ["set_id", "tip"], "left_anti")


def branch_similarity(pairs_of_sets: DataFrame, stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, similarity: distance of two sets' intersection over that of their union. Input: pair_id, a, b."""
    both = pairs_of_sets.select(F.col("pair_id"), F.array_intersect("a", "b").alias("i"), F.array_union("a", "b").alias("u"))
    sets = both.select(F.struct("pair_id", F.lit("i").alias("k")).alias("set_id"), F.col("i").alias("omes")).unionAll(both.select(F.struct("pair_id", F.lit("u").alias("k")).alias("set_id"), F.col("u").alias("omes")))
    found = set_distances(sets, stats, pairs).groupBy("set_id.pair_id").agg(F.coalesce(F.max(F.when(F.col("set_id.k") == "i", F.col("tmd"))), F.lit(0.0)).alias("i"), F.max(F.when(F.col("set_id.k") == "u", F.col("tmd"))).alias("u"))
    return found.select("pair_id", F.when(F.col("u") == 0, 0.0).otherwise(F.col("i") / F.col("u")).alias("similarity"))


#: Genomes of the sets of a block, about, and pairs of sets that a task is asked for.
BLOCK, ASKED = 1 << 22, 1 << 18


def similarity_of(sets: DataFrame, stats: DataFrame, pairs: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function that gives pairs of sets (a, b) their branch similarity. sets: set_id, omes.

    Sets are dealt to blocks, and a task holds two blocks and is asked for pairs between them: genomes travel with sets, not with pairs.
    """
    shared = shared_tree(stats, dict(sets.dtypes)["omes"])

    def by_pairs(asked: DataFrame) -> DataFrame:
        named = asked.join(sets.select(F.col("set_id").alias("a"), F.col("omes").alias("x")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("omes").alias("y")), "b")
        found = branch_similarity(named.select(F.struct("a", "b").alias("pair_id"), F.col("x").alias("a"), F.col("y").alias("b")), stats, pairs)
        return found.select("pair_id.a", "pair_id.b", "similarity")

    if shared is None or shared.value is None:
        return by_pairs

    def far(rows: np.ndarray, tips: np.ndarray, out: np.ndarray) -> np.ndarray:
        found, sizes, top = shared.value.tops(rows, tips)
        out[found] = np.where(sizes > 1, shared.value.covered(rows, tips, found, top) / NANO, 0.0)
        return out

    def met(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Similarities of sets of tips; NaN of pairs without any."""
        tips = len(shared.value.tips)
        row = np.repeat(np.arange(len(a)), [len(x) + len(y) for x, y in zip(a, b, strict=True)])
        keys = np.sort(row * tips + np.concatenate([np.concatenate([x, y]) for x, y in zip(a, b, strict=True)]), kind="stable")
        twice = keys[1:] == keys[:-1]
        both, either = keys[1:][twice], keys[np.append(True, ~twice)] if len(keys) else keys
        u = far(either // tips, either % tips, np.full(len(a), np.nan))
        i = far(both // tips, both % tips, np.zeros(len(a)))
        with np.errstate(all="ignore"):
            return np.where(u == 0, 0.0, i / u)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by blocks, first their sets (a, omes), then pairs (a, b)."""
        now, held = None, {}
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("x", "y", "deal")])
            pair = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0) | (pair[1:] != pair[:-1])) + 1
            for at, to in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                if now != (now := tuple(key[:, at])):
                    held = {}
                part = batch.slice(at, to - at)
                if not pair[at]:
                    for piece in pieces(part, "omes", PIECE):
                        rows, tips = shared.value.places(piece.column("omes"))
                        held |= zip(piece.column("a").to_pylist(), np.split(tips.astype(np.int32), np.searchsorted(rows, np.arange(1, piece.num_rows))), strict=True)
                    continue
                a, b = ([held.get(x) for x in part.column(c).to_pylist()] for c in "ab")
                known = np.flatnonzero([x is not None and y is not None for x, y in zip(a, b, strict=True)])
                for low, high in stretches(np.cumsum([len(a[i]) + len(b[i]) + 1 for i in known]), PIECE):
                    some = known[low:high]
                    values = met([a[i] for i in some], [b[i] for i in some])
                    there = pa.array(some[~np.isnan(values)])
                    yield pa.RecordBatch.from_arrays([part.column("a").take(there), part.column("b").take(there), pa.array(values[~np.isnan(values)])], ["a", "b", "similarity"])

    total = sets.agg(F.sum(F.size("omes"))).first()[0] or 1
    blocks = -(-total // BLOCK)
    kind, omes = dict(sets.dtypes)["set_id"], dict(sets.dtypes)["omes"]
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")

    def similarity(asked: DataFrame) -> DataFrame:
        asked = once(asked.select("a", "b").where("a is not null and b is not null"))
        meetings = blocks * (blocks + 1) // 2
        deals = max(1, -(-asked.count() // (ASKED * meetings)))
        place = lambda x, y, deal: (F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), deal.alias("deal"))
        ways = sets.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
        first = ways.select(*place(own("set_id"), F.col("_other"), F.col("_deal")), F.col("set_id").alias("a"), F.lit(None).cast(kind).alias("b"), "omes")
        then = asked.select(*place(own("a"), own("b"), F.pmod(F.xxhash64("b", "a"), F.lit(deals)).cast("int")), "a", "b", F.lit(None).cast(omes).alias("omes"))
        dealt = first.unionAll(then).repartition(min(meetings * deals, 1 << 14), "x", "y", "deal")
        return dealt.sortWithinPartitions("x", "y", "deal", F.col("b").isNotNull()).mapInArrow(meet, f"a {kind}, b {kind}, similarity double")

    return similarity


def unseen(sets: DataFrame, memo: DataFrame, column: str = "omes") -> DataFrame:
    """Distinct genome sets that a table of known distances lacks."""
    return sets.select(column).distinct().join(memo.select(column), column, "left_anti")


def one_genome_a_species(sets: DataFrame, species: DataFrame) -> DataFrame:
    """set_id, omes with one genome for each species: the one whose hash is smallest. species: ome, species."""
    numbered = once(sets.select("set_id", "omes").withColumn("_n", F.monotonically_increasing_id()))  # members carry a number, not their set
    rank = F.row_number().over(Window.partitionBy("species").orderBy(F.md5(F.col("ome").cast("string")), "ome"))
    ranked = known(species.select("ome", "species").distinct().withColumn("_rank", rank))
    members = numbered.select("_n", F.explode("omes").alias("ome")).join(ranked, "ome")
    first = members.groupBy("_n", "species").agg(F.min_by("ome", "_rank").alias("ome"))
    chosen = first.groupBy("_n").agg(F.sort_array(F.collect_set("ome")).alias("omes"))
    return numbered.select("set_id", "_n").join(chosen, "_n").select("set_id", "omes")


def tree_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "node long, parent long, length double, tip string")
