"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.frames import once as cut
from weftline.functions.frames import shared_folder
from weftline.operators.graph import components as star_components

__all__ = ["bounded", "cut", "fence", "fresh", "let", "salted_join", "shared_folder", "slices", "star_components", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fence(df: DataFrame) -> DataFrame:
    """``df``, through whose last projection nothing is pushed or merged. Without it Spark puts copies of what a column
    is computed from into the filters and lambdas that use the column, and computes it again in each."""
    return df.withColumn("_fence", F.monotonically_increasing_id()).where("_fence >= 0").drop("_fence")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16, how: str = "inner", spread: Column | None = None) -> DataFrame:
    """Equi-join in which ``left`` may hold most of its rows under one key.

    Each left row goes to one of ``salts`` parts of its key, each right row to all of them, so the right side
    must be small beside the left (unique keys). ``spread`` chooses the part; by default a hash of the left row.
    """
    part = F.pmod(spread if spread is not None else F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    parts = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    salt = max(fresh(left, "salt") + fresh(right, "salt"), key=len)
    return left.withColumn(salt, part).join(right.withColumn(salt, parts), [*keys, salt], how).drop(salt)


#: Bytes up to which a counted table is broadcast.
BROADCAST_BYTES = 2 << 20


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (written, of rows of at most so many bytes), marked for broadcast if it is small enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, with as many underscores before them as it takes to differ from all columns of ``df``."""
    known = {c.lower() for c in df.columns}
    ahead = "_"
    while any(f"{ahead}{name}".lower() in known for name in names):
        ahead += "_"
    return [f"{ahead}{name}" for name in names]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that what is made of long texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
