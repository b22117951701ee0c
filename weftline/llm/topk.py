"""Exact top-k inner-product search by distributed histogram selection (operator 10).

Everything is scored, several times over: each pass counts the scores of a block of queries in histograms that sum over
all tasks, keeps for every query the bin that holds its kth highest score, and splits that bin further, until the
bins are single scores. A last pass emits the rows above the kth score, and of those at the kth score each
task's smallest ids, as many as can be missing: equal scores of any number cost a task k rows at most.

Queries are taken in blocks of ``block`` rows, a fixed bound on what is broadcast and on what the driver holds. A pass
recomputes scores instead of storing rows x queries of them.

Defined cases: vectors that are null, hold null or non-finite components, or whose length differs from the most
common one take no part, nor do rows without an id; rows are told apart as rows, so a repeated row is a candidate like
any other, also for its twin, and each query row has its own result under its id; a query with fewer than k candidates
gets them all; an empty table gives an empty result. If the largest norm of a query times the largest norm of another row doesn't
fit a long, a ValueError is raised before anything is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, table

#: Bins that a pass splits a query's range into.
BINS = 256
#: Scores that a task holds at a time.
TILE = 1 << 22


def integers(df: DataFrame, ident: str, vector: str, scale: float, is_query: Column) -> DataFrame:
    """row, id, v, norm, q: vectors whose components are all there and finite, as whole numbers floor(scale * x), and what their norm can't exceed."""
    values = F.transform(vector, lambda x: x.cast("double"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    fit = F.col(ident).isNotNull() & F.col(vector).isNotNull() & F.forall(values, sound)
    whole = F.transform(values, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (F.abs(x * F.lit(float(scale))) + 1) * (F.abs(x * F.lit(float(scale))) + 1))) * (1 + 1e-9)
    rows = df.where(fit & (F.size(vector) > 0)).select(F.col(ident).cast("long").alias("id"), whole.alias("v"), norm.alias("norm"), F.coalesce(is_query, F.lit(False)).alias("q"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of doubles: whole numbers whose products and sums stay exact, as the norms have shown."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def scored(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores of each query by row) in tiles."""
    kind = np.float64 if exact else np.int64
    queries, step = queries.astype(kind), max(1, TILE // len(queries))
    for i in range(0, len(rows), step):
        yield ids[i : i + step], (queries @ rows[i : i + step].astype(kind).T).astype(np.int64)


def top_k(df: DataFrame, is_query: Column, k: int = 5, ident: str = "vec_id", vector: str = "embedding", scale: float = 256.0, block: int = 2048) -> DataFrame:
    """query_id, rank, id, score: the ``k`` highest scores of each query row, ties to the smaller id."""
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    rows = cut(integers(df, ident, vector, scale, is_query))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
    common = lengths.orderBy(F.desc("rows"), "n").first()
    if common is None:
        return empty
    size = common["n"]
    rows = rows.where(F.size("v") == size)
    longest = rows.where("q").orderBy(F.desc("norm"), "row").select("row", "norm").first()
    if longest is None:
        return empty
    # No score exceeds it: another query's norm is at most that of the longest row besides this one, or this one's own.
    other = rows.where(F.col("row") != longest["row"]).agg(F.max("norm")).first()[0] or 0.0
    most = longest["norm"] * other
    if most >= 1 << 62:
        raise ValueError(f"norms up to {longest['norm']:g} and {other:g}: scores might not fit a long")
    exact, most = most < 1 << 53, max(int(most), 1)
    wanted = cut(rows.where("q").select("row", "id", "v"))
    blocks = max(1, -(-wanted.count() // block))
    out = empty
    for part in range(blocks):
        found = _select(rows, wanted.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == part), k, size, most, exact)
        if blocks == 1:
            return empty if found is None else found
        out = out if found is None else out.unionAll(cut(found))  # written, so that a block's queries needn't stay broadcast
    return out


def _select(rows: DataFrame, block: DataFrame, k: int, size: int, most: int, exact: bool) -> DataFrame | None:
    spark = rows.sparkSession
    got = block.select("row", "id", "v").toArrow()
    if not got.num_rows:
        return None
    names = got.column("row").to_numpy()
    queries = got.column("v").combine_chunks()
    queries = spark.sparkContext.broadcast((names, got.column("id").to_numpy(), np.asarray(queries.flatten().to_numpy()).reshape(-1, size)))
    width = 1
    while width * BINS <= 2 * most:
        width *= BINS
    low = np.full(len(names), -most, np.int64)  # the range in which the kth score lies, and how many of it are wanted
    need = np.full(len(names), k, np.int64)
    few = np.zeros(len(names), bool)  # fewer than k candidates: all are wanted
    while True:
        counts = _histogram(rows, queries, low, width, size, exact)
        at = counts[:, ::-1].cumsum(axis=1)
        few |= at[:, -1] < need
        bins = np.where(few, 0, counts.shape[1] - 1 - (at >= need[:, None]).argmax(axis=1))
        above = np.take_along_axis(np.concatenate([at[:, ::-1], np.zeros((len(names), 1), np.int64)], axis=1), bins[:, None] + 1, axis=1)[:, 0]
        need = np.where(few, need, need - above)
        low = np.where(few, -most, low + bins * width)
        if width == 1:
            break
        width //= BINS
    return _emit(rows, queries, low, need, k, size, exact)


def _histogram(rows: DataFrame, queries, low: np.ndarray, width: int, size: int, exact: bool) -> np.ndarray:
    """How many scores of each query lie in each bin of ``width`` from ``low`` on; scores outside aren't counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, _, vectors = queries.value
        sums = np.zeros((len(names), BINS), np.int64)
        offset = (np.arange(len(names)) * BINS)[:, None]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows_ = batch.column("row").to_numpy()
            for at, scores in scored(np.arange(batch.num_rows), matrix(batch.column("v"), size), vectors, exact):
                bins = (scores - low[:, None]) // width
                inside = (bins >= 0) & (bins < BINS) & (rows_[at][None, :] != names[:, None])
                sums += np.bincount((bins + offset)[inside], minlength=sums.size).reshape(sums.shape)
        query, bin_ = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(bin_, pa.int32()), pa.array(sums[query, bin_])], ["query", "bin", "n"])

    summed = rows.mapInArrow(count, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(low), BINS), np.int64)
    out[summed.column("query").to_numpy(), summed.column("bin").to_numpy()] = summed.column("n").to_numpy()
    return out


def _emit(rows: DataFrame, queries, kth: np.ndarray, need: np.ndarray, k: int, size: int, exact: bool) -> DataFrame:
    """The rows above each query's kth score, and each task's smallest ids among those at it."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, vectors = queries.value
        ties: dict[int, list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            rows_, all_ids = batch.column("row").to_numpy(), batch.column("id").to_numpy()
            for at, scores in scored(np.arange(batch.num_rows), matrix(batch.column("v"), size), vectors, exact):
                ids, other = all_ids[at], rows_[at][None, :] != names[:, None]
                query, place = np.nonzero((scores > kth[:, None]) & other)
                out.append((names[query], own[query], ids[place], scores[query, place]))
                query, place = np.nonzero((scores == kth[:, None]) & other)
                cuts = np.searchsorted(query, np.arange(len(names) + 1))
                for q in np.unique(query):
                    new = ids[place[cuts[q] : cuts[q + 1]]]
                    ties[q] = np.sort(np.concatenate([ties.get(q, new[:0]), new]))[: need[q]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out]), pa.int64()) for i in range(4)], ["query", "query_id", "id", "score"])
        for q, found in ties.items():
            columns = (np.full(len(found), names[q]), np.full(len(found), own[q]), found, np.full(len(found), kth[q]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query", "query_id", "id", "score"])

    found = rows.mapInArrow(pick, "query long, query_id long, id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_exact_topk": op10_exact_topk}
ORACLE_SQL = {
    "op10_exact_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, w.vec_id, list_inner_product(q.v, w.v)::BIGINT AS score
            FROM whole q JOIN whole w ON q.vec_id <> w.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
