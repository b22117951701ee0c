"""SimHash near-duplicates by multi-index hashing (operator 6).

A fingerprint is cut into segments. Two fingerprints within a distance share a segment up to a small distance
(pigeonhole), so each document enumerates the Hamming ball of radius 1 around its own segments, looks the keys up in
the table of all segments, and the hits' complete distances are verified. Distinct fingerprints stand for all their
documents, so copies cost one row. Within a bucket everything is first held against the bucket's smallest member;
only what that leaves in different components is compared pairwise, so a large group of near copies doesn't
give all its pairs.

The pipeline's stage (``distinct_documents``) links by these fingerprints first. It is held to a Jaccard similarity, so it counts this for the
links, and looks exactly for what fingerprints leave apart: see there.

Defined cases: null text counts as empty; without words a fingerprint is zero and links like any other; repeated
rows share a component; a row without doc_id takes its group's component (null if no member has an id); an empty
table gives an empty result; the input's other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import bounded, cut, slices, star_components, table

SEED = 42
#: Shingles whose bits are unpacked at a time.
BLOCK = 255 * 16
#: Odd multipliers of a 64-bit mixing step (splitmix64), and its increment.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
GOLDEN = 0x9E3779B97F4A7C15
#: Documents from which common shingles are counted, about, and how many of these shingles are known at most.
SAMPLE, HOT = 20_000, 1 << 16
#: 64-bit words of a shingle set's mark, and members from which it has a tally.
MARK, LONG = 16, 1024


def shingle_hashes(data: bytes, size: int, distinct: bool) -> np.ndarray:
    """XXH64 of every run of ``size`` words; of the whole sequence if there are fewer words."""
    words = data.lower().split()  # on bytes: A-Z alone, and the six ASCII white spaces
    if not words:
        return np.zeros(0, np.uint64)
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(whole, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    found = np.fromiter((digest(whole[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    return np.unique(found) if distinct else found


def widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit words for each hash; the first is the hash itself."""
    out = [hashes]
    for i in range(1, words):
        x = hashes + np.uint64(i * GOLDEN & 0xFFFFFFFFFFFFFFFF)
        for shift, by in ((30, MIX[0]), (27, MIX[1])):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1)


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Big-endian words whose bits are set in over half of the hashes; zero for none."""
    counts = np.zeros(64 * words, np.int64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(widened(hashes[i : i + BLOCK], words).astype(">u8").view(np.uint8).reshape(-1, 8 * words), axis=1)
        for j in range(0, len(bits), 255):
            counts += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes)).view(">u8").astype(np.uint64)


def with_fingerprints(df: DataFrame, specs: dict[str, tuple[int, bool, int]], ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident`` and an array of signed 64-bit words for each spec, name -> (words a shingle, shingles distinct, 64-bit words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {name: [] for name in specs}
            for x in batch.column(text):
                data = (x.as_py() or "").encode()
                for name, (size, distinct, words) in specs.items():
                    out[name].append(majority(shingle_hashes(data, size, distinct), words).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(ident), *(pa.array(v, pa.list_(pa.int64())) for v in out.values())], [ident, *specs])

    kind = dict(df.dtypes)[ident]
    return df.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, " + ", ".join(f"{name} array<bigint>" for name in specs))


def segments(column: str, words: int, width: int, count: int):
    """The first ``count`` segments of ``width`` bits, each with its number above it: keys of the tables."""
    keys = []
    for i in range(count):
        word, at = divmod(i * width, 64)
        low = F.shiftrightunsigned(F.col(column)[word], at)
        if at + width > 64:
            low = low.bitwiseOR(F.shiftleft(F.col(column)[word + 1], 64 - at))
        keys.append(low.bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(i << width)))
    assert count * width <= 64 * words
    return F.array(*keys)


def near_components(nodes: DataFrame, width: int, most: int) -> DataFrame:
    """(node, root) of the nodes that link to others.

    nodes: id, keys (segment keys), mark (the fingerprint, 64 bits). Nodes whose keys lie within one bit of each other
    and whose marks within ``most`` bits are linked.
    """
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(width)])
    close = F.bit_count(F.col("mark").bitwiseXOR(F.col("other_mark"))) <= most

    def entries(df: DataFrame) -> DataFrame:
        return df.select(*[c for c in df.columns if c != "keys"], F.explode("keys").alias("key"))

    def probes(df: DataFrame) -> DataFrame:
        mask = entries(df).withColumn("mask", F.explode(ball))
        return mask.withColumn("key", F.col("key").bitwiseXOR(F.col("mask"))).drop("mask")

    # A written table, so that both sides of the join are plain exchanges and AQE can split a hot key.
    heads = entries(nodes).groupBy("key").agg(F.min(F.struct("id", "mark")).alias("h"), F.count("*").alias("members"))
    heads = cut(heads.select("key", F.col("h.id").alias("head"), F.col("h.mark").alias("other_mark"), "members"))
    met = probes(nodes).join(heads.drop("members"), "key").where((F.col("id") > F.col("head")) & close)
    first = cut(met.select(F.col("id").alias("a"), F.col("head").alias("b")).distinct())
    named = nodes.join(star_components(first).withColumnRenamed("node", "id"), "id", "left")
    named = cut(named.select("id", "keys", "mark", F.coalesce("root", "id").alias("part")))
    rest = entries(named).join(heads.where("members > 1").select("key", "head"), "key").where("id > head")
    rest = rest.select("key", F.col("id").alias("b"), F.col("mark").alias("other_mark"), F.col("part").alias("other"))
    apart = (F.col("id") > F.col("b")) & (F.col("part") != F.col("other")) & close
    second = cut(probes(named).join(rest, "key").where(apart).select(F.col("id").alias("a"), "b").distinct())
    return star_components(first.select("a", "b").unionAll(second.select("a", "b")))


def fingerprint_components(found: DataFrame, ident: str) -> DataFrame:
    """fp, component_id: each fingerprint of (ident, fp) once, with the smallest ``ident`` that links of 3 or fewer differing bits reach.

    Two segments of 32 bits: of 3 differing bits, one segment has at most one.
    """
    distinct = cut(found.groupBy("fp").agg(F.min(ident).alias("least")))
    nodes = distinct.select(F.col("fp").alias("id"), F.array("fp").alias("w")).select("id", segments("w", 1, 32, 2).alias("keys"), F.col("id").alias("mark"))
    linked = near_components(nodes, 32, 3)  # the mark is the whole fingerprint: its distance needs no other check
    roots = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = cut(roots)
    return roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")


def simhash_components(df: DataFrame, shingle: int = 3, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, fingerprint (16 hex digits), component_id: 64-bit fingerprints linked at 3 or fewer differing bits."""
    found = cut(with_fingerprints(df, {"words": (shingle, False, 1)}, ident, text).select(ident, F.col("words")[0].alias("fp")))
    ids = fingerprint_components(found, ident)
    # Both sides are written tables: AQE splits a fingerprint that holds a large part of the documents.
    named = found.join(cut(ids), "fp")
    return named.select(ident, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def common_shingles(df: DataFrame, shingle: int, ident: str, text: str) -> np.ndarray:
    """Hashes of the shingles that several documents of a sample hold, by ascending number of them; HOT at most.

    They only decide the order in which shingles are taken, never which pairs are found.
    """
    share = max(1, df.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes((x.as_py() or "").encode(), shingle, True).view(np.int64))], ["h"])

    some = df.where(F.pmod(F.xxhash64(ident), F.lit(share)) == 0).select(text).mapInArrow(run, "h bigint")
    top = some.groupBy("h").agg(F.count("*").alias("n")).where("n >= 5").orderBy(F.desc("n"), "h").limit(HOT)
    return np.array([r.h for r in top.collect()][::-1], np.int64)


def shingle_sets(df: DataFrame, shingle: int, ident: str, text: str) -> DataFrame:
    """``ident`` and the set of the text's shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_hashes((x.as_py() or "").encode(), shingle, True).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])

    return df.select(F.col(ident).alias("id"), text).mapInArrow(run, f"id {dict(df.dtypes)[ident]}, shingles array<bigint>")


def prefixes(df: DataFrame, similarity: Fraction, shingle: int, ident: str, text: str) -> DataFrame:
    """id, SimHash fingerprint fp and digest of the shingle set, its size n, mark, and keys: the first n - ceil(similarity * n) + 1 shingles in one
    order of all shingles, common ones last.

    mark: for each value of the hashes' last bits, whether an odd number of shingles has it. Every shingle that only one
    of two sets holds changes one bit, so marks differ in no more bits than sets in members. tally: for sets of LONG members
    or more, how many have each value; these differ by no more than the sets, too, and say more of large sets.
    """
    common = common_shingles(df, shingle, ident, text)
    places = np.argsort(common)
    known, (num, den) = common[places], similarity.as_integer_ratio()

    def first(found: np.ndarray) -> np.ndarray:
        size = len(found) + num * -len(found) // den + 1 if len(found) else 0
        if not len(known):
            return found[:size]
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        return found[np.lexsort((found, np.where(known[at] == found, places[at] + 1, 0)))][:size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, fps, sizes, marks, tallies, keys = [], [], [], [], [], []
            for x in batch.column(1):
                found = np.sort(shingle_hashes((x.as_py() or "").encode(), shingle, True).view(np.int64))
                digests.append(xxhash.xxh128_digest(found.tobytes()))
                fps.append(int(majority(found.view(np.uint64)).view(np.int64)[0]))
                sizes.append(len(found))
                counts = np.bincount(found & (64 * MARK - 1), minlength=64 * MARK)
                marks.append(np.packbits(counts & 1).view(np.int64))
                tallies.append(np.minimum(counts, 32767).astype(np.int16) if len(found) >= LONG else None)
                keys.append(first(found))
            columns = [pa.array(digests, pa.binary()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(marks, pa.list_(pa.int64())), pa.array(tallies, pa.list_(pa.int16())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "digest", "fp", "n", "mark", "tally", "keys"])

    return df.select(F.col(ident).alias("id"), text).mapInArrow(run, f"id {dict(df.dtypes)[ident]}, digest binary, fp bigint, n int, mark array<bigint>, tally array<smallint>, keys array<bigint>")


def jaccard_components(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: Fraction) -> DataFrame:
    """(node, root) of the nodes that link to others: those whose sets have at least the Jaccard similarity.

    nodes: id, fp, n, mark, tally, keys (see ``prefixes``); sets: the table (id, shingles) of the ids in a table. Each node is held against the
    smallest of those that its fingerprint reaches; where the count confirms it, they are linked. The exact search after it
    takes only pairs that this leaves apart: of two such sets, the first common member in the order stands among the keys
    of both, so equal keys find every pair. From its places it also follows how many members can be common at most; the
    rest is counted.
    """
    num, den = similarity.as_integer_ratio()
    entries = nodes.select("id", "n", F.posexplode("keys").alias("at", "key")).select("key", "id", (F.col("n") - F.col("at")).alias("ahead"), "n")
    several = cut(entries.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("key"))
    shared = cut(entries.join(bounded(several, 16), "key"))
    heads = shared.groupBy("key").agg(F.min(F.struct("id", "ahead", "n")).alias("h"), F.count("*").alias("members"))
    heads = cut(heads.select("key", "members", F.col("h.id").alias("head"), F.col("h.ahead").alias("other_ahead"), F.col("h.n").alias("other_n")))
    may = F.least("ahead", "other_ahead") * (num + den) >= num * (F.col("n") + F.col("other_n"))
    apart = sum((F.bit_count(F.col("mark")[i].bitwiseXOR(F.col("other_mark")[i])) for i in range(MARK)), F.lit(0))
    near = apart * (num + den) <= (den - num) * (F.col("n") + F.col("other_n"))

    def marked(pairs: DataFrame) -> DataFrame:
        """Pairs whose marks may belong to near copies; few of the others are left, so few sets are read."""
        marks = nodes.select("id", "n", "mark", "tally")
        gap = F.aggregate(F.zip_with("tally", "other_tally", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda x, y: x + y)
        tallied = F.when(F.col("tally").isNotNull() & F.col("other_tally").isNotNull(), gap * (num + den) <= (den - num) * (F.col("n") + F.col("other_n"))).otherwise(True)
        first = cut(pairs.select("a", "b").distinct()).join(marks.withColumnRenamed("id", "a"), "a")
        return first.join(marks.toDF("b", "other_n", "other_mark", "other_tally"), "b").where(near & tallied)

    def links(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.select("a", "b").distinct())
        own = cut(sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        both = pairs.join(own.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(own.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        alike = F.size(F.array_intersect("sa", "sb")) * (num + den) >= num * (F.size("sa") + F.size("sb"))
        return cut(both.where(alike).select("a", "b"))

    prints = cut(nodes.select("id", "fp"))
    reached = prints.join(cut(fingerprint_components(prints, "id")), "fp").where("id > component_id")
    alike = links(marked(reached.select(F.col("id").alias("a"), F.col("component_id").alias("b"))))
    settled = bounded(cut(star_components(alike)), 32)
    met = shared.join(heads.drop("members"), "key").where((F.col("id") > F.col("head")) & may).select(F.col("id").alias("a"), F.col("head").alias("b"))
    met = met.join(settled.toDF("a", "part"), "a", "left").join(settled.toDF("b", "other"), "b", "left").where("part is null or other is null or part <> other")
    first = alike.unionAll(links(marked(met)))
    # Members of a bucket that the head left apart. Few buckets have such; only they take marks along.
    rest = cut(shared.join(bounded(cut(heads.where("members > 2").select("key", "head")), 24), "key").where("id > head").drop("head"))
    parts = rest.join(star_components(first).withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("root", "id")).drop("root")
    parts = cut(parts)
    several = parts.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("key")
    parts = cut(parts.join(several, "key").join(nodes.select("id", "mark").dropDuplicates(["id"]), "id"))
    other = parts.select("key", F.col("id").alias("b"), F.col("ahead").alias("other_ahead"), F.col("n").alias("other_n"), F.col("part").alias("other"), F.col("mark").alias("other_mark"))
    second = links(marked(parts.join(other, "key").where((F.col("id") > F.col("b")) & (F.col("part") != F.col("other")) & may & near).select(F.col("id").alias("a"), "b")))
    return star_components(first.unionAll(second))


def distinct_documents(df: DataFrame, similarity: float = 0.8, shingle: int = 5, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without the documents that are near copies of one with a smaller id; all columns stay.

    Near copies have sets of ``shingle``-word runs of that Jaccard similarity or more, or are joined by such pairs.
    SimHash fingerprints of the sets are linked at 3 or fewer of 64 bits, as in ``simhash_components``, and their links counted. Pairs at 0.8
    differ in about 10 bits, which no number of segments covers, so an exact search follows for the pairs that fingerprints
    leave apart. Documents with equal sets are one node. Rows without an id stay.
    """
    least = Fraction(similarity).limit_denominator(10_000)
    known = df.where(F.col(ident).isNotNull())
    prints = cut(prefixes(known, least, shingle, ident, text))
    groups = cut(prints.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("rows"), F.count_distinct("id").alias("ids")))
    same = prints.select("digest", "id").join(groups.select("digest", F.col("id").alias("least")), "digest").where("id > least").select("digest", "id")
    nodes = prints.join(bounded(cut(same), 64), ["digest", "id"], "left_anti")

    def sets(ids: DataFrame) -> DataFrame:
        wanted = known.join(bounded(cut(ids.withColumnRenamed("id", ident)), 32), ident, "left_semi")
        return shingle_sets(wanted, shingle, ident, text).dropDuplicates(["id"])

    linked = jaccard_components(nodes, sets, least)
    stay = groups.select("id").join(linked.where("node <> root").select(F.col("node").alias("id")), "id", "left_anti")
    gone = cut(prints.select("id").distinct().join(stay, "id", "left_anti").withColumnRenamed("id", ident))
    kept = df.join(bounded(gone, 32), ident, "left_anti")
    counts = groups.agg(F.sum("rows"), F.sum("ids")).first()
    if counts[0] != counts[1]:  # a repeated row is the same document twice; rows without an id aren't known to be
        kept = kept.where(F.col(ident).isNotNull()).dropDuplicates([ident, text]).unionAll(kept.where(F.col(ident).isNull()))
    return kept


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_simhash": op6_simhash}
