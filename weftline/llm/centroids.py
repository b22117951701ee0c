"""Centroid clustering of deduplicated vectors (operator 13).

Vectors become whole numbers. Identical ones are grouped with their multiplicity, and Lloyd's rounds run on the distinct
vectors alone: each task assigns its vectors to the nearest centroid and adds up, for every centroid, multiplicities and
vectors times multiplicity, in whole numbers, so that no order of tasks changes a result. A new centroid is the floor of
sum over count. Last, the distinct vectors' assignments are joined back to the rows.

What the driver holds and sends is the centroids. Vectors travel as bytes, in the least width that holds their
components: a byte each for unit vectors.

Defined cases: vectors that are null, hold null or non-finite components or haven't ``size`` components take no part,
nor do rows without an id; a row twice over is two vectors, and both may start a centroid; with fewer vectors than
centroids each starts one; of equally near centroids the smaller number counts; a centroid without vectors stays; an
empty table gives an empty result; other columns aren't read. A component, distance or sum of distances that doesn't
fit a long raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import cut, table

#: Rows whose distances a task holds at a time.
STEP = 4096
WIDTHS = (1, 2, 4, 8)


def quantised(df: DataFrame, ident: str, vector: str, size: int, scale: float) -> DataFrame:
    """id, key, most: the vectors that take part, as floor(scale * x) in bytes, and their largest component without its sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tops = [], []
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            values = np.floor(scale * flat)
            most = np.abs(values).max(axis=1, initial=0)
            if (most >= 2.0**63).any():
                raise ValueError(f"a component of {most.max():g} doesn't fit a long")
            for row, top in zip(values.astype(np.int64), most.astype(np.int64), strict=True):
                width = next(w for w in WIDTHS if top < 1 << (8 * w - 1))
                keys.append(row.astype(f"<i{width}").tobytes())
                tops.append(top)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array(tops, pa.int64())], ["id", "key", "most"])

    values = F.transform(vector, lambda x: x.cast("double"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    fit = F.col(ident).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) == size) & F.forall(values, sound)
    return df.where(fit).select(F.col(ident).cast("long").alias("id"), values.alias("v")).mapInArrow(run, "id long, key binary, most long")


def numbers(keys: list[bytes], size: int, kind: type) -> np.ndarray:
    """Rows of whole numbers; ``kind``: object where longs may overflow."""
    out = np.empty((len(keys), size), kind)
    for i, key in enumerate(keys):
        out[i] = np.frombuffer(key, f"<i{len(key) // size}").astype(np.int64)
    return out


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance, exact in the kind of the arguments."""
    far = np.stack([((rows - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = far.argmin(axis=1)  # the first of equal ones
    return at, far[np.arange(len(rows)), at]


def assign(distinct: DataFrame, centroids: list[list[int]], size: int, wide: bool, then: Callable, fields: str) -> DataFrame:
    """``then(keys, n, rows, cluster, distance)`` of the distinct vectors in pieces, as rows of ``fields``."""
    kind, points = object if wide else np.int64, np.array(centroids, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = points.astype(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                piece = batch.slice(at, STEP)
                keys = piece.column("key").to_pylist()
                rows = numbers(keys, size, kind)
                yield then(piece, rows, *nearest(rows, places))

    return distinct.mapInArrow(run, fields)


def moved(distinct: DataFrame, centroids: list[list[int]], size: int, wide: bool) -> list[list[int]]:
    """The centroids after one round."""

    def sums(piece: pa.RecordBatch, rows: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        n = piece.column("n").to_numpy().astype(rows.dtype)
        out = []
        for c in np.unique(cluster):
            here = cluster == c
            total = (rows[here] * n[here][:, None]).sum(axis=0)
            out.append((int(c), int(n[here].sum()), [str(x) for x in total]))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.string()))], ["cluster", "n", "sums"])

    parts = assign(distinct, centroids, size, wide, sums, "cluster int, n long, sums array<string>")
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(size)]
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect()  # a row for each centroid
    out = [list(c) for c in centroids]
    for r in found:
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(size)]
    return out


def clusters(df: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, ident: str = "vec_id", vector: str = "embedding", size: int = 64, scale: float = 64.0) -> DataFrame:
    """``ident``, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the rows whose vectors take part."""
    rows = cut(quantised(df, ident, vector, size, scale))
    first = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "id", "key").orderBy("h", "id", "key").limit(k).collect()
    if not first:
        return df.sparkSession.createDataFrame([], f"`{ident}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    distinct = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.max("most").alias("most")))
    top = distinct.agg(F.max("most"), F.sum("n")).first()
    # Squares of differences, summed over a vector, and a task's sums of vectors fit a long below these.
    wide = size * (2 * top[0] + 1) ** 2 >= 1 << 62 or (top[0] + 1) * top[1] >= 1 << 62
    centroids = [numbers([r.key], size, np.int64)[0].tolist() for r in first]
    for _ in range(rounds):
        centroids = moved(distinct, centroids, size, wide)

    def placed(piece: pa.RecordBatch, vectors: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([piece.column("key"), piece.column("n"), pa.array(cluster, pa.int32()), pa.array(distance.tolist(), pa.int64())], ["key", "n", "cluster", "distance"])

    found = cut(assign(distinct, centroids, size, wide, placed, "key binary, n long, cluster int, distance long"))
    weighted = F.sum((F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")).cast("decimal(38,0)"))
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(weighted.alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()]
    facts = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # Both sides are written tables: AQE splits a vector that many rows hold.
    named = rows.select(F.col("id").alias(ident), "key").join(found.drop("n"), "key").join(F.broadcast(facts), "cluster")
    return named.select(ident, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_centroids": op13_centroids}


def _oracle(k: int = 16, rounds: int = 3) -> str:
    """The rounds unrolled; sums as whole numbers of 128 bits."""
    parts = [
        """kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id, v) - 1 AS c, v FROM kept QUALIFY c < {k})",
    ]
    near = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT x.r, min({{'d': {near}, 'c': c.c}}) AS best FROM kept x, c{i} c GROUP BY x.r)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT c, list(q ORDER BY j) AS v FROM (SELECT a.best.c AS c, j, (sum(x.v[j]::HUGEINT) - (sum(x.v[j]::HUGEINT) % count(*) + count(*)) % count(*)) // count(*) AS q FROM a{i} a JOIN kept x USING (r), range(1, 65) t(j) GROUP BY ALL) GROUP BY c)")
            parts.append(f"c{i + 1} AS (SELECT c.c, coalesce(m.v::BIGINT[], c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)")
    return f"""WITH {", ".join(parts)}
        SELECT x.vec_id, a.best.c::INTEGER AS cluster, a.best.d AS distance, (sum(a.best.d) OVER (PARTITION BY a.best.c))::BIGINT AS cluster_inertia,
               (sum(a.best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN kept x USING (r) JOIN c{rounds} c ON c.c = a.best.c"""


ORACLE_SQL = {"op13_centroids": _oracle()}
