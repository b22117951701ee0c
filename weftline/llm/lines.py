"""Line dedup by winnowing over line hashes (operator 7).

A line's hash is that of its words, lower-cased; a gram is the shortest run of lines from a line on with half of
``min_words`` words, a window the shortest with ``min_words``. Each window selects the smallest hash among the grams in
it, and a position is emitted when the selection changes: these are the fingerprints, and a repeated run with so many
words holds a window, so its copies emit an equal one. Positions are joined by fingerprint. Around those that meet
others, the windows that begin or end at each line are joined by their whole content; a match grows line by line both
ways as long as such windows have an earlier place, and what they cover is deleted.

The result: a line goes if it lies in a run of lines, ``min_words`` words or more in all, that also stands wholly
earlier in the corpus, by (doc_id, line).

Defined cases: null text stays null, and text without words stays as it is; blank lines belong to no run and stay;
equal rows of one doc_id are one document, different texts of one doc_id two, in the order of their hashes; rows without
doc_id are left as they are. A document may end up empty. Of a text that repeats itself the first place stays. Columns
other than doc_id, text, n_chars, removed_lines and removed_words pass through, whatever their names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import cut, fresh, let, slices, table

MIN_WORDS = 50
#: Bytes of a 128-bit hash.
WIDE = 16


def line_hashes(text: str) -> tuple[bytes, list[int], list[int]]:
    """128-bit hashes, one after another, numbers of words and places of the lines that have words."""
    digests, counts, places = [], [], []
    for place, line in enumerate(text.split("\n")):
        words = line.lower().split()
        if words:
            digests.append(xxhash.xxh3_128_digest(" ".join(words)))
            counts.append(len(words))
            places.append(place)
    return b"".join(digests), counts, places


def ends(counts: list[int], words: int) -> np.ndarray:
    """For each line, the end of the shortest run from it with so many words; len + 1 if there is none."""
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return np.searchsorted(total, total[:-1] + words)


def starts(counts: list[int], words: int) -> np.ndarray:
    """For each line, the start of the shortest run that ends with it; -1 if there is none."""
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return np.searchsorted(total, total[1:] - words, side="right") - 1


def winnow(digests: bytes, counts: list[int], min_words: int) -> tuple[list[int], list[int]]:
    """Lines at which a selected gram starts, and the grams' hashes. Of equal hashes the last is selected, but a selection stays while it can."""
    window, gram = ends(counts, min_words).tolist(), ends(counts, -(-min_words // 2)).tolist()
    gram.append(len(counts) + 2)
    marks, keys = [], []
    queue, new = deque(), 0  # queue: (hash, line) by ascending hash, for the minimum of a sliding window
    for start, end in enumerate(window):
        if end > len(counts):
            break
        while queue and queue[0][1] < start:
            queue.popleft()
        while gram[new] <= end:
            key = xxhash.xxh3_64_intdigest(digests[WIDE * new : WIDE * gram[new]]) - (1 << 63)
            while queue and queue[-1][0] > key:
                queue.pop()
            queue.append((key, new))
            new += 1
        least = queue[0][0]
        if not marks or keys[-1] != least or marks[-1] < start:
            marks.append(max(line for key, line in queue if key == least))
            keys.append(least)
    return marks, keys


def windows(counts: list[int], marks: list[int], min_words: int) -> np.ndarray:
    """(start, end) of the windows that begin or end at each line and hold a gram that starts at one of the marks."""
    n = len(counts)
    first, last = ends(counts, min_words), starts(counts, min_words)
    forward = np.stack([np.arange(n), first], axis=1)[first <= n]
    backward = np.stack([last, np.arange(1, n + 1)], axis=1)[last >= 0]
    both = np.unique(np.concatenate([forward, backward]), axis=0)
    known = np.zeros(n + 1, np.int64)
    known[np.asarray(marks) + 1] = 1
    known = np.cumsum(known)  # marks before a line
    inside = np.searchsorted(ends(counts, -(-min_words // 2)), both[:, 1], side="right")  # grams that end by a window's end
    return both[known[np.maximum(inside, both[:, 0])] > known[both[:, 0]]]


def repeated_lines(df: DataFrame, min_words: int = MIN_WORDS, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """id, mark (a hash of the text), gone, stay, words: the places of deleted lines, the ranges (start, size) of those that stay, and the
    deleted words; only documents with such."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for x in batch.column("text"):
                digests, counts, places = line_hashes(x.as_py() or "")
                rows.append((digests, counts, places, *winnow(digests, counts, min_words), (x.as_py() or "").count("\n") + 1))
            kinds = (pa.binary(), *[pa.list_(t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())], pa.int32())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), *columns], ["id", "mark", "digests", "counts", "places", "marks", "keys", "n"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for digests, counts, marks in zip(*[batch.column(c) for c in ("digests", "counts", "found")], strict=True):
                data = digests.as_py()
                found = windows(counts.values.to_numpy(), marks.values.to_numpy(), min_words).tolist()
                out.append([{"start": s, "end": e, "key": xxhash.xxh3_128_digest(data[WIDE * s : WIDE * e])} for s, e in found])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("key", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(out, kind)], ["id", "mark", "windows"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for counts, places, n, first, last in zip(*[batch.column(c) for c in ("counts", "places", "n", "starts", "ends")], strict=True):
                counts, places = counts.values.to_numpy(), places.values.to_numpy()
                edges = np.bincount(first.values.to_numpy(), minlength=len(counts) + 1) - np.bincount(last.values.to_numpy(), minlength=len(counts) + 1)
                covered = np.cumsum(edges)[: len(counts)] > 0
                kept = np.ones(n.as_py(), np.int8)
                kept[places[covered]] = 0
                turns = np.flatnonzero(np.diff(kept, prepend=0, append=0))
                stay = [{"start": a, "size": b - a} for a, b in turns.reshape(-1, 2).tolist()]
                rows.append((places[covered], stay, int(counts[covered].sum())))
            kinds = (pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())])), pa.int64())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), *columns], ["id", "mark", "gone", "stay", "words"])

    body = F.coalesce(F.col(text), F.lit(""))
    read = df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.xxhash64(text).alias("mark"), body.alias("text"))
    kind = f"id {dict(read.dtypes)['id']}, mark bigint"
    lines = cut(read.mapInArrow(scan, f"{kind}, digests binary, counts array<int>, places array<int>, marks array<int>, keys array<bigint>, n int").where("size(marks) > 0"))
    places = lines.select("id", "mark", F.explode(F.arrays_zip("marks", "keys")).alias("m")).select("id", "mark", F.col("m.marks").alias("at"), F.col("m.keys").alias("key"))
    # A row of an id twice over holds no position twice.
    shared = places.groupBy("key").agg(F.min(F.struct("id", "mark", "at")).alias("x"), F.max(F.struct("id", "mark", "at")).alias("y")).where("x < y").select("key")
    # Joins with written tables, so that AQE can split a key that many places share.
    met = places.join(cut(shared), "key").groupBy("id", "mark").agg(F.collect_set("at").alias("found"))
    spans = met.join(lines.select("id", "mark", "digests", "counts"), ["id", "mark"]).mapInArrow(expand, f"{kind}, windows array<struct<start:int,end:int,key:binary>>")
    spans = cut(spans.select("id", "mark", F.explode("windows").alias("w")).select("id", "mark", "w.*"))
    first = spans.groupBy("key").agg(F.min(F.struct("id", "mark", "start", "end")).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    apart = (F.col("id") != F.col("first.id")) | (F.col("mark") != F.col("first.mark")) | (F.col("start") >= F.col("first.end"))
    later = spans.join(cut(first), "key").where(apart)
    # Sorted ends are enough to tell what the windows cover.
    covered = later.groupBy("id", "mark").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    both = covered.join(lines.select("id", "mark", "counts", "places", "n"), ["id", "mark"])
    found = both.mapInArrow(merge, f"{kind}, gone array<int>, stay array<struct<start:int,size:int>>, words bigint")
    return found.dropDuplicates(["id", "mark"])  # of equal rows


def dedup_lines(df: DataFrame, min_words: int = MIN_WORDS, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with later repeated runs deleted from ``text``, and removed_lines, removed_words.

    n_chars, where there is one, becomes the new text's length.
    """
    df = df.drop("removed_lines", "removed_words")
    ident_, mark, gone, stay, words, new = fresh(df, "ident", "mark", "gone", "stay", "words", "new")
    found = cut(repeated_lines(df, min_words, ident, text)).select(F.col("id").alias(ident_), F.col("mark").alias(mark), F.size("gone").alias(gone), F.col("stay").alias(stay), F.col("words").alias(words))
    joined = df.join(found, (F.col(ident) == F.col(ident_)) & (F.xxhash64(text) == F.col(mark)), "left")
    kept = let(F.split(F.col(text), "\n", -1), lambda parts: F.array_join(F.flatten(F.transform(stay, lambda r: F.slice(parts, r["start"] + 1, r["size"]))), "\n"))
    joined = joined.withColumn(new, F.when(F.col(mark).isNotNull(), kept))
    changed = F.col(new).isNotNull()
    out = {"removed_lines": F.when(changed, F.col(gone)).otherwise(0), "removed_words": F.when(changed, F.col(words)).otherwise(0)}
    if "n_chars" in df.columns:
        out["n_chars"] = F.when(changed, F.length(new)).otherwise(F.col("n_chars")).cast(df.schema["n_chars"].dataType)
    return joined.withColumns(out).withColumn(text, F.coalesce(new, text)).drop(ident_, mark, gone, stay, words, new)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_line_dedup": op7_line_dedup}
