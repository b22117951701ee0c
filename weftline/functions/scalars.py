"""Scalar functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Coefficient = Callable[[Column, Column, Column], Column]


def sorensen(shared: Column, a: Column, b: Column) -> Column:
    return 2 * shared / (a + b)


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    return shared / (a + b - shared)


def overlap(shared: Column, a: Column, b: Column) -> Column:
    return shared / F.least(a, b)


COEFFICIENTS: dict[str, Coefficient] = {"sorensen": sorensen, "jaccard": jaccard, "overlap": overlap}


def substitution_bias(identity: Column, positives: Column) -> Column:
    """1 - identity / positives; 0 if either is 0, null if either is null."""
    return F.when((identity == 0) | (positives == 0), F.lit(0.0)).otherwise(1 - identity / positives)


def genome_of(gene: Column) -> Column:
    """The part of a gene id before its first underscore."""
    return F.substring_index(gene, "_", 1)


def percentile_index(share: float, n: Column) -> Column:
    """0-based place of a percentile in an ascending list of ``n``; ties between places go to the even one."""
    return F.bround(F.lit(share) * n + F.lit(0.5)).cast("long")


def lower_median_index(n: Column, whole: bool) -> Column:
    """0-based place of the lower median: by half the count less one, rounded before (``whole``) or after."""
    return (F.bround(n / 2) - 1 if whole else F.bround(n / 2 - 1)).cast("long")


def percent_flag(value: str) -> float:
    """A percentage option as a share: 5 -> 0.05, 61 -> 0.61, 0.5 -> 0.5."""
    if "." in value:
        return float(value)
    if not value.isdigit():
        raise ValueError(f"not a percentage: {value!r}")
    return int(value) / 100


def items(text: Column) -> Column:
    """A comma- or blank-separated list, without quotes and empty parts."""
    return F.filter(F.split(F.regexp_replace(text, "[\"']", ""), r"[,\s]+"), lambda x: x != "")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of parts, in order."""
    return F.sha2(F.concat_ws("\n", *parts), 256)


def key(values: Column) -> Column:
    """A sorted, comma-separated text of a set: the key of genome sets and itemsets in results."""
    return F.array_join(F.array_sort(F.array_distinct(values)), ",")
