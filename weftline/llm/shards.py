"""Sharding by a hierarchical weighted hash tree (operator 2).

A shard sits in a rack and a rack in a region. For a key each shard draws -ln(u) / weight, u being a hash of the key and
the shard's name; a rack's draw is the smallest of its shards', a region's the smallest of its racks'. The key descends by
the smallest draw, which a subtree wins in proportion to the weight below it. Draws don't depend on what else
there is, so a shard that comes takes keys only into itself, wherever it stands, one that goes gives its keys up, and a
weight that changes moves keys only into or out of its shard.

DataFrame functions only. Slots are numbered within each (shard, input partition) and shifted by the counts of the
partitions before, so no task holds a whole shard and copies of one key are spread as the input is.

Defined cases: a row without id hashes as the text 'null'; null text has size 16 and checksum 0, as has the empty
one; repeated rows get slots of their own in one shard; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, let, table

Tree = dict[str, dict[str, dict[int, float]]]
#: Fixed bytes of a row besides its text.
OVERHEAD = 16


def tree(shards: int, racks: int = 4, per_rack: int = 2) -> Tree:
    """region -> rack -> shard -> weight: shards fill racks, racks fill regions, in order."""
    out: Tree = {}
    for shard in range(shards):
        rack = shard // per_rack
        out.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    return out


def descend(key: Column, topology: Tree) -> Column:
    """(draw, region, rack, shard) of ``key``. At each level the smallest draw wins; of equal draws, the smaller name. Null without shards."""
    levels = []
    for region, racks in topology.items():
        for rack, leaves in racks.items():
            shards = [F.struct(F.lit(f"{region}/{rack}/{shard}").alias("path"), F.lit(shard).alias("shard"), F.lit(float(w)).alias("w")) for shard, w in leaves.items() if w > 0]
            if shards:
                levels.append((region, F.struct(F.lit(rack).alias("rack"), F.array(*shards).alias("shards"))))
    regions = [F.struct(F.lit(region).alias("region"), F.array(*[r for name, r in levels if name == region]).alias("racks")) for region in dict.fromkeys(name for name, _ in levels)]
    if not regions:
        return F.lit(None).cast("struct<draw:double,region:string,rack:string,shard:int>")

    def draw(shard: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, shard["path"]), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.ln(u) / shard["w"]).alias("draw"), shard["shard"].alias("shard"))

    def of_rack(rack: Column) -> Column:
        return let(F.array_min(F.transform(rack["shards"], draw)), lambda best: F.struct(best["draw"].alias("draw"), rack["rack"].alias("rack"), best["shard"].alias("shard")))

    def of_region(region: Column) -> Column:
        return let(F.array_min(F.transform(region["racks"], of_rack)), lambda best: F.struct(best["draw"].alias("draw"), region["region"].alias("region"), best["rack"].alias("rack"), best["shard"].alias("shard")))

    return F.array_min(F.transform(F.array(*regions), of_region))


def with_slots(df: DataFrame, shard: str, out: str = "slot") -> DataFrame:
    """``df``, written once, with a number for each row of a shard, without gaps from 0."""
    placed = cut(df.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))
    counts = placed.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard), F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = Window.partitionBy(shard, "_part").orderBy("_seq")
    numbered = placed.withColumn("_row", F.row_number().over(own))
    return numbered.join(offsets, [shard, "_part"]).withColumn(out, (F.col("_offset") + F.col("_row") - 1).cast("long")).drop("_part", "_seq", "_row", "_offset")


def shard_rows(df: DataFrame, shards: int, grown: int | None = None, ident: str = "doc_id", text: str = "text", racks: int = 4, per_rack: int = 2) -> DataFrame:
    """ident, size, text_crc32, shard, slot and, with ``grown``, grown_shard: the shard among so many."""
    key = F.coalesce(F.col(ident).cast("string"), F.lit("null"))
    body = F.coalesce(F.col(text), F.lit(""))
    places = {"shard": descend(key, tree(shards, racks, per_rack))["shard"]}
    if grown:
        places["grown_shard"] = descend(key, tree(grown, racks, per_rack))["shard"]
    placed = df.select(ident, (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), *[c.alias(name) for name, c in places.items()])
    return with_slots(placed, "shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_rows(table(spark, sf_dir, "documents"), 40, 41)
    return found.withColumn("law", F.lit("key")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_sharding": op2_sharding}
