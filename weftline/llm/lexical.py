"""Ranked lexical search over document-sharded postings (operator 12).

Documents are packed into blocks of bounded size. A block holds its terms in ascending order and, for each, the places
of the documents that hold it, in compressed sparse rows with a precomputed integer impact for each posting. Impacts
depend on the corpus only by its number of documents and terms, so an index is built in two passes: one counts, one turns
counts into impacts. Each term's weight is kept in a table of its own.

A search takes queries in groups of bounded size. Every block adds the weighted impacts of a query's terms, one
term after another, to a dense array of sums, and selects its best documents by a partition at the kth sum, equal sums by
smaller id. Tasks keep k documents a query, which a window merges.

Scores are whole numbers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), N documents with terms; its impact
in a document is 10^9 tf div (1000 tf + 20 m), m = 100 - 50 + 50 n N div L, n terms of the document, L of all.

Defined cases: null and empty texts have no terms and are no documents to search in; rows without an id take no
part; rows of one document id are documents of their own, with equal ids; a query's rows are one query with the terms of
all its texts, so repeated rows change nothing; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, table

#: Documents and postings of a block, at most (a document's postings stay together).
BLOCK_ROWS, BLOCK_POSTINGS = 4096, 1 << 20
#: Queries, and bytes of their terms, of a group.
GROUP_QUERIES, GROUP_BYTES = 1024, 4 << 20
#: What separates terms becomes a space, A to Z become small letters; all bytes of other characters stay.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
FOLD = bytes.maketrans(SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(SEPARATORS) + bytes(range(0x61, 0x7B)))
BLOCK = "ids array<bigint>, sizes array<int>, terms array<string>, starts array<int>, rows array<int>, counts array<int>"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def block_of(ids: list[int], found: list[Counter]) -> tuple:
    """ids, sizes, terms, starts (one more than terms), rows and counts of the postings."""
    names = sorted({t for c in found for t in c})
    number = {t: i for i, t in enumerate(names)}
    sizes = np.fromiter((len(c) for c in found), np.int64, len(found))
    term = np.fromiter((number[t] for c in found for t in c), np.int32, int(sizes.sum()))
    count = np.fromiter((n for c in found for n in c.values()), np.int32, len(term))
    order = np.argsort(term, kind="stable")
    rows = np.repeat(np.arange(len(found), dtype=np.int32), sizes)[order]
    starts = np.zeros(len(names) + 1, np.int32)
    np.cumsum(np.bincount(term, minlength=len(names)), out=starts[1:])
    return ids, [c.total() for c in found], [t.decode() for t in names], starts, rows, count[order]


def blocks(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Blocks of documents with counts: see ``BLOCK``. Documents without terms are in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        found: list[Counter] = []
        room = 0
        names = [x.split()[0] for x in BLOCK.split(", ")]
        kinds = [pa.list_(t) for t in (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())]

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(block_of(ids, found), kinds, strict=True)], names)

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = Counter(terms_of(x.as_py()))
                if not c:
                    continue
                ids.append(i)
                found.append(c)
                room += len(c)
                if len(ids) >= BLOCK_ROWS or room >= BLOCK_POSTINGS:
                    yield packed()
                    ids, found, room = [], [], 0
        if ids:
            yield packed()

    rows = df.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.col(ident).cast("long"), text)
    return rows.mapInArrow(run, BLOCK)


class Index:
    """blocks: ids, terms, starts, rows, impacts; weights: term, df, weight. Both are written tables."""

    def __init__(self, blocks_: DataFrame, weights: DataFrame, documents: int, total: int):
        self.blocks, self.weights, self.documents, self.total = blocks_, weights, documents, total


def build_index(df: DataFrame, ident: str = "doc_id", text: str = "text") -> Index:
    counted = cut(blocks(df, ident, text))
    one = counted.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")).first()
    documents, total = one.n or 0, one.total or 0

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                sizes, rows, counts = (batch.column(c)[at].values.to_numpy().astype(np.int64) for c in ("sizes", "rows", "counts"))
                m = 100 - 50 + (50 * sizes * documents) // total
                impacts = (1_000_000_000 * counts) // (1000 * counts + 20 * m[rows])
                kept = [batch.column(c).slice(at, 1) for c in ("ids", "terms", "starts", "rows")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([impacts.astype(np.int32)], pa.list_(pa.int32()))], ["ids", "terms", "starts", "rows", "impacts"])

    done = cut(counted.mapInArrow(weigh, "ids array<bigint>, terms array<string>, starts array<int>, rows array<int>, impacts array<int>"))
    # A row for each term and block: what a common word adds does not grow with its documents.
    held = done.select(F.posexplode("terms").alias("at", "term"), "starts").select("term", (F.get("starts", F.col("at") + 1) - F.get("starts", F.col("at"))).cast("long").alias("df"))
    sums = held.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.ln((F.lit(2.0) * documents + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    return Index(done, cut(sums.select("term", "df", weight.alias("weight"))), documents, total)


def query_terms(items: DataFrame, ident: str, text: str) -> DataFrame:
    """item, term: distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = [t.decode() for t in set(terms_of(x.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(words), pa.int64()), pa.array(words, pa.string())], ["item", "term"])

    rows = items.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.col(ident).cast("long"), text)
    return rows.mapInArrow(run, "item long, term string").distinct()


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, of equal ones those of smaller ids."""
    if len(scores) <= k:
        return np.arange(len(scores))
    bar = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
    above = np.flatnonzero(scores > bar)
    ties = np.flatnonzero(scores == bar)
    need = k - len(above)
    if len(ties) > need:
        ties = ties[np.argpartition(ids[ties], need - 1)[:need]]
    return np.concatenate([above, ties])


def search(index: Index, items: DataFrame, k: int = 50, ident: str = "item_id", text: str = "text") -> DataFrame:
    """query, rank, id, score: the ``k`` documents of the highest scores above 0, for each query."""
    spark = items.sparkSession
    wanted = cut(query_terms(items, ident, text).join(index.weights.select("term", "weight"), "term").where("weight > 0"))
    size = wanted.agg(F.count_distinct("item").alias("n"), F.sum(F.octet_length("term") + 16).alias("bytes")).first()
    groups = max(1, -(-size.n // GROUP_QUERIES), -(-(size.bytes or 0) // GROUP_BYTES))
    out = None
    for group in range(groups):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == group).toArrow()
        shared = spark.sparkContext.broadcast((rows.column("item").to_numpy(), rows.column("term").combine_chunks(), rows.column("weight").to_numpy()))
        found = index.blocks.mapInArrow(_searcher(shared, k), "query long, id long, score long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score")
        if groups == 1:
            return ranked
        done = cut(ranked)
        shared.unpersist()
        out = done if out is None else out.unionAll(done)
    return out


def _searcher(shared, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, weights = shared.value
        names, query = np.unique(items, return_inverse=True)
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(names)
        order = np.argsort(query, kind="stable")
        edges = np.searchsorted(query[order], np.arange(len(names) + 1))
        for batch in batches:
            for at in range(batch.num_rows):
                ids, starts, rows, impacts = (batch.column(c)[at].values.to_numpy() for c in ("ids", "starts", "rows", "impacts"))
                places = pc.index_in(terms, value_set=batch.column("terms")[at].values).fill_null(-1).to_numpy()
                impacts = impacts.astype(np.int64)
                for q in range(len(names)):
                    sums, met = np.zeros(len(ids), np.int64), False
                    for t in order[edges[q] : edges[q + 1]]:
                        if (p := places[t]) >= 0:
                            here = slice(starts[p], starts[p + 1])
                            sums[rows[here]] += weights[t] * impacts[here]  # a term's rows are distinct
                            met = True
                    if not met:
                        continue
                    hit = np.flatnonzero(sums)
                    hit = hit[best(ids[hit], sums[hit], k)]
                    known = (np.concatenate([kept[q][0], ids[hit]]), np.concatenate([kept[q][1], sums[hit]]))
                    stay = best(*known, k)
                    kept[q] = (known[0][stay], known[1][stay])
        for name, (ids, scores) in zip(names, kept, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), name, np.int64)), pa.array(ids), pa.array(scores)], ["query", "id", "score"])

    return run


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_lexical_search": op12_lexical_search}
TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op12_lexical_search": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS ts FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        sized AS (SELECT r, doc_id, len(ts)::BIGINT AS n FROM docs WHERE len(ts) > 0),
        whole AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized),
        wanted AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        tfs AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY term, big_n),
        hits AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l)) AS impact FROM tfs JOIN sized USING (r), whole),
        scores AS (SELECT item_id, doc_id, r, sum(w * impact)::BIGINT AS score FROM wanted JOIN weights USING (term) JOIN hits USING (term) GROUP BY ALL),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 50
    """,
}
