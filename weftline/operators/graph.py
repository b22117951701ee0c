"""Graphs as edge frames: components, clusters, and statistics of vertices and edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.frames import known, once


#: Links that one task joins by itself; more go by rounds. And the kinds of nodes that Python orders as Spark does.
FEW_LINKS = 1 << 17
ORDERED = {"tinyint", "smallint", "int", "bigint", "string", "binary"}


def joined(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """node, root of links (u, v) that are all in these batches; with ``most``, of so many nodes or few more at a time."""
    up: dict = {}

    def top(x):  # noqa: ANN001, ANN202
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    kind = None

    def found() -> pa.RecordBatch:
        nodes = list(up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(map(top, nodes), kind)], ["node", "root"])

    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        if most is not None and len(up) >= most:
            yield found()
            up.clear()
    if up:
        yield found()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = FEW_LINKS) -> DataFrame:
    """(node, root) for every node that an edge touches; root: the smallest node reachable.

    Edges are written and counted. Up to ``few`` are joined in one task: rounds over them would be hundreds of tasks with hardly a row. More
    alternate large-star and small-star steps (each a grouped minimum and a join on the node) until the edges
    stop changing. Each round is written to the checkpoint folder, so a lost executor costs a round at most and
    lineage stays short. Nulls and self-links are dropped. The driver sees one (count, checksum) row a round.
    """

    def links(df: DataFrame) -> DataFrame:
        return df.where("u > v").distinct()

    def large(df: DataFrame) -> DataFrame:
        both = df.select("u", "v").unionAll(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(df: DataFrame) -> DataFrame:
        joined = df.join(df.groupBy("u").agg(F.min("v").alias("m")), "u")
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        return joined.select(F.explode(ends).alias("e")).select("e.u", "e.v")

    both_ends = F.col(a).isNotNull() & F.col(b).isNotNull()
    now = once(edges.where(both_ends).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v"))
    kind = dict(now.dtypes)["u"]
    if kind in ORDERED and now.count() <= few:
        return once(now.coalesce(1).mapInArrow(joined, f"node {kind}, root {kind}"))
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, now = mark, once(links(small(links(large(now)))))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def clans(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """set_id, clan of every set; one that no edge touches is a clan of its own."""
    found = components(edges).withColumnsRenamed({"node": "set_id", "root": "clan"})
    return sets.join(found, "set_id", "left").withColumn("clan", F.coalesce("clan", "set_id"))


#: Nodes of a component that one task clusters as a matrix (two of 330 MB); and of larger ones: cells of a stripe of columns (64 MB, of which a
#: task holds a few), and how many of a column's cells make a row of the table.
DENSE, CELLS, HEIGHT = 6400, 1 << 23, 1024


def markov_clusters(edges: DataFrame, inflation: float = 2.0, dense: int = DENSE, rounds: int = 100, prune: float = 1e-5) -> DataFrame:
    """node, cluster of a weighted graph (a, b, w) by Markov clustering; cluster: its smallest node.

    Runs within connected components: those of up to ``dense`` nodes as matrices, one to a task; larger ones in stripes of columns, so that
    no component has to fit a task. ``prune``: the least share of a column that stays; the largest always does.
    """
    return clustered(*placed_links(edges), inflation, dense, rounds, prune)


def placed_links(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root, i, n): each node's component, its number there, and the component's size; and (root, n, i, j, w): the links of a weighted
    graph (a, b, w) by these numbers, which aren't written.

    Tasks join their own links first, so components see a few links of each node, however many it has.
    """
    kind = dict(edges.dtypes)["a"]
    links = edges.where("a is not null and b is not null and a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    if kind in ORDERED and kind == dict(edges.dtypes)["b"]:
        for tasks in (64, 8):
            own = links.coalesce(tasks).mapInArrow(lambda batches: joined(batches, 4 * FEW_LINKS), f"node {kind}, root {kind}")
            links = once(own.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    order = Window.partitionBy("root")
    members = components(links, "u", "v", few=4 * FEW_LINKS).withColumns({"i": F.row_number().over(order.orderBy("node")) - 1, "n": F.count("*").over(order).cast("int")})
    members = once(members.select("node", "root", "i", "n"))
    few = known(members)
    ends = edges.join(few.select(F.col("node").alias("a"), "root", "n", "i"), "a").join(few.select(F.col("node").alias("b"), F.col("i").alias("j")), "b")
    return members, ends.select("root", "n", "i", "j", F.col("w").cast("double").alias("w"))


def inflated(x: np.ndarray, inflation: float, prune: float) -> None:
    """Columns raised to a power and scaled to a sum of 1, in place, without what is below ``prune`` then."""
    x /= np.maximum(x.max(axis=0), 1e-300)
    np.power(x, inflation, out=x)
    x /= np.maximum(x.sum(axis=0), 1e-300)
    x[x < np.minimum(prune, x.max(axis=0))] = 0
    x /= np.maximum(x.sum(axis=0), 1e-300)


def clustered(members: DataFrame, links: DataFrame, inflation: float, dense: int = DENSE, rounds: int = 100, prune: float = 1e-5) -> DataFrame:
    """Markov clusters of what ``placed_links`` gives."""

    def cluster(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = key[1].as_py()
        m = np.zeros((n, n))
        for batch in batches:
            i, j, w = (batch.column(c).to_numpy() for c in ("i", "j", "w"))
            np.maximum.at(m, (i, j), w)
            np.maximum.at(m, (j, i), w)
        np.fill_diagonal(m, m.max(axis=0))
        m /= m.sum(axis=0)
        new = np.empty_like(m)
        for _ in range(rounds):
            # Attractors' rows only: the others are zero, and stay so.
            rows = np.flatnonzero(m.any(axis=1))
            left, gap = (m if len(rows) == n else m[np.ix_(rows, rows)]), 0.0
            if len(rows) < n:
                new[:] = 0
            for at in range(0, n, 512):
                old = m[:, at : at + 512] if len(rows) == n else m[rows, at : at + 512]
                x = left @ old
                inflated(x, inflation, prune)
                gap = max(gap, np.abs(x - old).max())
                new[rows, at : at + 512] = x
            m, new = new, m
            if gap < 1e-6:
                break
        # A node goes with the attractors its column reaches; attractors that share a node are one cluster.
        i, j = np.nonzero(m > 1e-3)
        root, before = np.arange(n), None
        while before is None or (root != before).any():
            before, root = root, root.copy()
            least = np.minimum(before[i], before[j])
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)
            root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], key[0].type).take(pa.array(np.zeros(n, np.int32))), pa.array(np.arange(n, dtype=np.int32)), pa.array(root.astype(np.int32))], ["root", "i", "c"])

    kind = dict(members.dtypes)["root"]
    found = links.where(F.col("n") <= dense).groupBy("root", "n").applyInArrow(cluster, f"root {kind}, i int, c int")
    named = known(members.select("root", "i", "node"))
    small = found.join(named, ["root", "i"]).select("root", "c", "node").join(named.select("root", F.col("i").alias("c"), F.col("node").alias("cluster")), ["root", "c"]).select("node", "cluster")
    large = members.where(F.col("n") > dense)
    return small if large.isEmpty() else small.unionAll(_markov_stripes(large, links.where(F.col("n") > dense), inflation, rounds, prune))


def _markov_stripes(members: DataFrame, links: DataFrame, inflation: float, rounds: int, prune: float) -> DataFrame:
    """The same of components that don't fit a task. A matrix is a table of pieces of columns (root, n, j, b, x), those of zeros left out;
    a task holds some columns and is passed all columns of its component, so a round shuffles a component once for each stripe."""
    kind = dict(members.dtypes)["root"]
    fields = f"root {kind}, n int, j int, b int, x array<double>, gap double"
    stripes = F.ceil(F.col("n").cast("long") * F.col("n") / CELLS).cast("int")
    stripe_of = lambda j: (F.col(j) / F.ceil(F.col("n") / stripes)).cast("int")
    tasks = int(members.select("root", stripes.alias("k")).distinct().agg(F.sum("k")).first()[0])

    def rows_of(root: pa.Scalar, n: int, low: int, x: np.ndarray, gap: float) -> Iterator[pa.RecordBatch]:
        """Columns from ``low`` on as rows, those of a block at a time."""
        for b in range(0, n, HEIGHT):
            part = x[b : b + HEIGHT]
            some = np.flatnonzero(part.any(axis=0))
            if len(some):
                cells = np.zeros((len(some), HEIGHT))
                cells[:, : len(part)] = part[:, some].T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * HEIGHT), pa.array(cells.ravel()))
                same = lambda v, t: pa.array([v], t).take(pa.array(np.zeros(len(some), np.int32)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(root.as_py(), root.type), same(n, pa.int32()), pa.array((low + some).astype(np.int32)), same(b // HEIGHT, pa.int32()), lists, same(gap, pa.float64())], ["root", "n", "j", "b", "x", "gap"])

    def first(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, stripe = key[1].as_py(), key[2].as_py()
        width = -(-n // -(-n * n // CELLS))
        low, x = stripe * width, np.zeros((n, min(width, n - stripe * width)))
        for batch in batches:
            i, j, w = (batch.column(c).to_numpy() for c in ("i", "j", "w"))
            np.maximum.at(x, (i, j - low), w)
        own = np.arange(x.shape[1])
        x[low + own, own] = x.max(axis=0)
        x /= x.sum(axis=0)
        yield from rows_of(key[0], n, low, x, 1.0)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by component and stripe, the stripe's own columns first, then all, by which these are multiplied."""
        now = old = new = None

        def done() -> Iterator[pa.RecordBatch]:
            inflated(new, inflation, prune)
            yield from rows_of(now[0], now[1], now[3], new, float(np.abs(new - old).max()))

        for batch in batches:
            root, stripe, whole = batch.column("root"), batch.column("stripe").to_numpy(), batch.column("whole").to_numpy(zero_copy_only=False)
            n, j, b = (batch.column(c).to_numpy() for c in ("n", "j", "b"))
            x = batch.column("x").flatten().to_numpy().reshape(-1, HEIGHT)
            turns = np.flatnonzero(pc.not_equal(root[1:], root[:-1]).to_numpy(zero_copy_only=False) | (stripe[1:] != stripe[:-1]) | (whole[1:] != whole[:-1])) + 1
            for at, to in zip([0, *turns], [*turns, len(j)], strict=True):
                if now is None or (root[at].as_py(), stripe[at]) != (now[0].as_py(), now[2]):
                    if now is not None:
                        yield from done()
                    width = -(-int(n[at]) // -(-int(n[at]) * int(n[at]) // CELLS))
                    now = (root[at], int(n[at]), stripe[at], int(stripe[at]) * width)
                    old = np.zeros((now[1], min(width, now[1] - now[3])))
                    new = np.zeros_like(old)
                for block in np.unique(b[at:to]):
                    here = at + np.flatnonzero(b[at:to] == block)
                    low, high = block * HEIGHT, min((block + 1) * HEIGHT, now[1])
                    if whole[at]:
                        new[low:high] += x[here, : high - low].T @ old[j[here]]
                    else:
                        old[low:high, j[here] - now[3]] = x[here, : high - low].T
        if now is not None:
            yield from done()

    both = links.unionAll(links.select("root", "n", F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    m = once(both.withColumn("stripe", stripe_of("j")).repartition(tasks, "root", "stripe").groupBy("root", "n", "stripe").applyInArrow(first, fields))
    for _ in range(rounds):
        own = m.drop("gap").withColumns({"stripe": stripe_of("j"), "whole": F.lit(False)})
        every = m.drop("gap").withColumns({"stripe": F.explode(F.sequence(F.lit(0), stripes - 1)), "whole": F.lit(True)})
        m = once(own.unionAll(every).repartition(tasks, "root", "stripe").sortWithinPartitions("root", "stripe", "whole").mapInArrow(step, fields))
        if m.agg(F.max("gap")).first()[0] < 1e-6:
            break

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cell = np.nonzero(batch.column("x").flatten().to_numpy().reshape(-1, HEIGHT) > 1e-3)
            i = (cell + HEIGHT * batch.column("b").to_numpy()[at]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("root").take(pa.array(at)), pa.array(i), batch.column("j").take(pa.array(at))], ["root", "i", "j"])

    named = known(members.select("root", "i", "node"))
    linked = m.mapInArrow(reached, f"root {kind}, i int, j int").where("i <> j").join(named.select("root", "i", F.col("node").alias("a")), ["root", "i"]).join(named.select("root", F.col("i").alias("j"), F.col("node").alias("b")), ["root", "j"])
    found = components(linked.select("a", "b"))
    return members.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("cluster"))


def wedges_closed(edges: DataFrame) -> DataFrame:
    """u, v, w, weight: the triangles of an undirected graph (a < b, weight), each once, found at its vertex of least degree;
    weight: the product of its three."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("d"))
    ranked = edges.select("a", "b", "weight").join(degree.withColumnsRenamed({"d": "da"}), "a").join(degree.withColumnsRenamed({"a": "b", "d": "db"}), "b")
    pair = lambda d, n: F.struct(F.col(d).alias("d"), F.col(n).alias("n"))
    first = pair("da", "a") < pair("db", "b")
    out = once(ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"), "weight"))
    wedges = out.withColumnRenamed("weight", "x").join(out.withColumnsRenamed({"v": "w", "weight": "y"}), "u").where("v < w")
    closing = edges.select(F.col("a").alias("v"), F.col("b").alias("w"), F.col("weight").alias("z"))
    return wedges.join(closing, ["v", "w"]).select("u", "v", "w", (F.col("x") * F.col("y") * F.col("z")).alias("weight"))


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles of an undirected graph (a < b)."""
    met = wedges_closed(edges.select("a", "b", F.lit(1).alias("weight")))
    return met.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def weighted_transitivity(edges: DataFrame) -> DataFrame:
    """One row: transitivity, spread of an undirected graph (a < b, w).

    Closed triplets over all, each counting by the product of its edges' weights (a triplet by that of its two). spread: the root of
    the summed squares of what the transitivity changes by when one vertex's triplets are left out, from sums by vertex.
    """
    weighted = edges.select("a", "b", F.col("w").cast("double").alias("weight"))
    closed = wedges_closed(weighted).select(F.explode(F.array("u", "v", "w")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("closed"))
    ends = weighted.select(F.explode(F.array("a", "b")).alias("node"), "weight").groupBy("node").agg(((F.sum("weight") * F.sum("weight") - F.sum(F.col("weight") * F.col("weight"))) / 2).alias("open"))
    nodes = once(ends.join(closed, "node", "left").withColumn("closed", F.coalesce("closed", F.lit(0.0))))
    total = nodes.agg(F.sum("closed").alias("c"), F.sum("open").alias("o"))
    share = lambda c, o: F.when(o > 0, c / o).otherwise(0.0)
    whole = share(F.col("c"), F.col("o"))
    gap = whole - share(F.col("c") - F.col("closed"), F.col("o") - F.col("open"))
    return nodes.join(F.broadcast(total)).agg(F.max(whole).alias("transitivity"), F.sqrt(F.sum(gap * gap)).alias("spread"))


def local_clustering(edges: DataFrame) -> DataFrame:
    """node, degree, triangles, clustering (0 below two neighbours)."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    t = ends.join(triangles(edges), "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return t.withColumn("clustering", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def graph_summary(edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, density, transitivity, of an undirected graph."""
    nodes = local_clustering(edges)
    wedge = F.col("degree") * (F.col("degree") - 1) / 2
    row = nodes.agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.sum("triangles").alias("t"), F.sum(wedge).alias("w"))
    density = F.when(F.col("n_nodes") > 1, 2 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)))
    return row.select("n_nodes", "n_edges", density.alias("density"), F.when(F.col("w") > 0, F.col("t") / F.col("w")).otherwise(0.0).alias("transitivity"))


def quotient(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """a, b: families with an edge between their members. membership: node, family (a node may have several)."""
    left = membership.withColumnsRenamed({"node": "a", "family": "fa"})
    right = membership.withColumnsRenamed({"node": "b", "family": "fb"})
    met = edges.select("a", "b").join(left, "a").join(right, "b").where("fa <> fb")
    return met.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).distinct()


def scaled_weights(edges: DataFrame, low: float = 1.0, high: float = 10.0) -> DataFrame:
    """Edges with scaled: the logarithm of their weight, spread from ``low`` to ``high``."""
    ends = edges.agg(F.min(F.ln("w")).alias("least"), F.max(F.ln("w")).alias("most"))
    share = F.when(F.col("most") > F.col("least"), (F.ln("w") - F.col("least")) / (F.col("most") - F.col("least"))).otherwise(0.0)
    return edges.join(F.broadcast(ends)).withColumn("scaled", F.lit(low) + share * (high - low)).drop("least", "most")


def capped_edges(edges: DataFrame, most: int) -> DataFrame:
    """The heaviest edges, ``most`` at most: those above the smallest weight that leaves no more. Ties go together, so
    there are none if more than ``most`` share the heaviest weight.

    Weights are counted first, so the ranking sees a row for each weight.
    """
    tally = edges.groupBy("w").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, 0)))
    bar = tally.where(F.col("upto") <= most).agg(F.min("w").alias("bar"))
    return edges.join(F.broadcast(bar)).where("w >= bar").drop("bar")


def labels(node_taxa: DataFrame) -> DataFrame:
    """node, label: a node's taxon, or hybrid if it has several. node_taxa: (node, taxon)."""
    found = node_taxa.groupBy("node").agg(F.array_sort(F.collect_set("taxon")).alias("taxa"))
    return found.select("node", F.when(F.size("taxa") > 1, "hybrid").otherwise(F.get("taxa", F.lit(0))).alias("label"))


def betweenness(edges: DataFrame) -> DataFrame:
    """node, betweenness of an undirected, unweighted graph, over unordered pairs.

    A component at a time (one task each): every vertex needs shortest paths through its whole component.
    """
    members = components(edges).withColumnRenamed("node", "a")
    placed = edges.select("a", "b").join(members, "a").select("root", "a", "b")

    def central(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pdf.a, pdf.b, strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        score = dict.fromkeys(near, 0.0)
        for s in near:
            order, before, paths, far = [s], {s: []}, {s: 1.0}, {s: 0}
            for v in order:
                for w in near[v]:
                    if w not in far:
                        far[w], paths[w], before[w] = far[v] + 1, 0.0, []
                        order.append(w)
                    if far[w] == far[v] + 1:
                        paths[w] += paths[v]
                        before[w].append(v)
            part = dict.fromkeys(order, 0.0)
            for w in reversed(order):
                for v in before[w]:
                    part[v] += paths[v] / paths[w] * (1 + part[w])
                if w != s:
                    score[w] += part[w]
        return pd.DataFrame({"node": list(score), "betweenness": [round(x / 2, 6) for x in score.values()]})

    return placed.groupBy("root").applyInPandas(central, f"node {dict(placed.dtypes)['a']}, betweenness double")
