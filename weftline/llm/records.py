"""Token ids as length-delimited binary records with an offset index (operator 11).

Texts are encoded and written in ascending order of their ids: a range exchange deals the rows to shards, each task sorts
its shard and writes one file of frames

    length (8 bytes) | masked CRC-32C of it (4) | payload | masked CRC-32C of the payload (4)

all little-endian, the framing of TFRecord files. A payload is a header (bytes an id has, whether there is a document id,
the document id) and the token ids. A file's name is new for each attempt of a task; the offset index, which Spark's
own committer writes as Parquet beside the files, names only files of attempts that counted, so what lost or
repeated tasks leave is never read. The index holds a row for each record, and serves reads in shuffled order.

The library encodes a word once for many texts: for byte-level models without normaliser, a single space or line end between
two characters that are no white space always starts a token of the pre-tokeniser, so a text's ids are those of its words,
one after another. Other models encode whole texts.

Defined cases: null text counts as empty, and has the end id alone; rows without an id come first; equal ids stand
in the order of a hash of their texts, equal rows are each written; an empty table gives an index without rows; long texts are
encoded and written whole; the input's other columns aren't read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import bounded, shared_folder, slices, table

END = 2
#: Bytes of text in a file, about; smaller tables still give each core some files.
SHARD_BYTES, LEAST_BYTES = 128 << 20, 1 << 20
#: Words in a worker's memo, and their characters; the memo before it is kept, too.
MEMO_WORDS, MEMO_CHARS = 400_000, 8 << 20
#: Bytes of texts, and of payloads, that are worked through at a time, about.
TEXT_BYTES, BATCH_BYTES = 4 << 20, 1 << 20
#: A place at which a text may be cut; characters of a stretch of a long text.
CUT, LONG = re.compile(r"(?<=\S)(?=[ \n]\S)"), 1 << 20
#: White space other than a single space or line end between words, as Arrow's expressions have it; no character beyond is white space.
ODD = "[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + r"]|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: Marks that end words, and the first character from which on letters aren't told apart from marks here.
MARKS, LATIN = ".,;:!?", "\u0250"
#: A byte-level vocabulary's signs for a space and a line end.
SPACE, LINE = "Ġ", "Ċ"
#: Format and bytes of what stands before the ids.
HEADER, HEADER_BYTES = "<BBq", 10
#: Fixed values of the framing: the reflected Castagnoli polynomial, and what a mask adds.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
LANE = 64


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """slices[k][v]: byte v with k zero bytes behind it; shifts[b][k][v]: byte k of a state, 2**b zero bytes later."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = (state >> np.uint32(1)) ^ np.where(state & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    by = [state]
    for _ in range(7):
        by.append(state[by[-1] & np.uint32(255)] ^ (by[-1] >> np.uint32(8)))
    places = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    shifts = [state[places & np.uint32(255)] ^ (places >> np.uint32(8))]
    for _ in range(40):
        shifts.append(shifted(shifts[-1], shifts[-1]))
    return np.stack(by), shifts


def shifted(table_: np.ndarray, state: np.ndarray) -> np.ndarray:
    return table_[0][state & np.uint32(255)] ^ table_[1][(state >> np.uint32(8)) & np.uint32(255)] ^ table_[2][(state >> np.uint32(16)) & np.uint32(255)] ^ table_[3][state >> np.uint32(24)]


def advanced(state: np.ndarray, counts: np.ndarray, unit: int) -> np.ndarray:
    """States after so many times 2**unit zero bytes."""
    state, bit = state.copy(), 0
    while len(counts) and int(counts.max()) >> bit:
        on = (counts >> bit) & 1 == 1
        state[on] = shifted(SHIFTS[unit + bit], state[on])
        bit += 1
    return state


SLICES, SHIFTS = _tables()


def crc32c(buffers: list[bytes]) -> np.ndarray:
    """CRC-32C of each buffer. All are cut into lanes of 64 bytes, which are worked through side by side; a lane's state is
    then moved by the zero bytes that stand for the lanes behind it, and the lanes of a buffer are summed."""
    if not buffers:
        return np.zeros(0, np.uint32)
    sizes = np.fromiter(map(len, buffers), np.int64, len(buffers))
    lanes = np.maximum(-(-sizes // LANE), 1)
    stops = np.cumsum(lanes)
    room = bytearray(int(stops[-1]) * LANE)
    for stop, size, data in zip((stops * LANE).tolist(), sizes.tolist(), buffers, strict=True):
        room[stop - size : stop] = data  # zero bytes before the data change nothing
    rows = np.frombuffer(room, np.uint8).reshape(-1, LANE)
    state = np.zeros(len(rows), np.uint32)
    for at in range(0, LANE, 8):
        word = np.ascontiguousarray(rows[:, at : at + 4]).view("<u4")[:, 0] ^ state
        state = SLICES[7][word & np.uint32(255)] ^ SLICES[6][(word >> np.uint32(8)) & np.uint32(255)] ^ SLICES[5][(word >> np.uint32(16)) & np.uint32(255)] ^ SLICES[4][word >> np.uint32(24)]
        for k in range(4):
            state = state ^ SLICES[3 - k][rows[:, at + 4 + k]]
    behind = np.repeat(stops, lanes) - 1 - np.arange(len(rows))
    sums = np.bitwise_xor.reduceat(advanced(state, behind, LANE.bit_length() - 1), stops - lanes)
    return sums ^ advanced(np.full(len(sizes), 0xFFFFFFFF, np.uint32), sizes, 0) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [b"".join((n, h.tobytes(), p, t.tobytes())) for n, h, p, t in zip(lengths, heads, payloads, tails, strict=True)]


class Words:
    """Ids of texts, as bytes: little-endian numbers of ``width`` bytes."""

    def __init__(self, blob: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(blob)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        about, vocabulary = json.loads(blob), self.model.get_vocab()
        before = about.get("pre_tokenizer") or {}
        self.by_words = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not any(about.get(k) for k in ("normalizer", "truncation", "padding")) and LINE in vocabulary
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        # By id: whether a token opens a word behind a space, or is a line end.
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True
        self.ends = np.zeros_like(self.opens)
        self.ends[vocabulary.get(LINE, 0)] = True
        self.line = self._plain(["\n"])[0]
        self.marks = dict(zip(MARKS, self._plain(list(MARKS)), strict=True))
        # Ids by words: those at the start of a text or line stand behind a line end, with its id; others have a space before them.
        self.memo: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        """Starts new memos; words that are met again are taken over from the last ones."""
        self.old, self.memo = self.memo, {"\n": self.line}
        self.parts, self.chars = {}, 0

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], ahead: str, first: np.ndarray) -> None:
        """Encodes words that the memo lacks, each behind ``ahead``, as one text, and parts it at the tokens that are ``first``.

        A mark behind a letter is a token of its own, so a word that ends with one is taken as two.
        """
        memo, old, new, marked = self.memo, self.old, set(), []
        for w in words:
            if (known := old.get(w)) is not None:
                memo[w] = known
            elif w[-1] in self.marks and len(w) > 1 and w[-2] < LATIN and w[-2].isalpha():
                marked.append(w)
                new.add(w[:-1])
            else:
                new.add(w)
        rest = [w for w in new if w not in memo]
        for at in range(0, len(rest), 1000):
            some = rest[at : at + 1000]
            ids = np.array(self.model.encode_batch_fast([ahead + ahead.join(some)], add_special_tokens=False)[0].ids, self.kind)
            cuts = (np.append(np.flatnonzero(first[ids]), len(ids)) * self.width).tolist()
            data = ids.tobytes()
            memo.update(zip(some, (data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)), strict=True))
        memo.update((w, memo[w[:-1]] + self.marks[w[-1]]) for w in marked)
        self.chars += sum(map(len, rest)) + sum(map(len, marked))

    def _joined(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts whose words are parted by single spaces and line ends. Arrow tells the words apart and puts their ids one after another."""
        lines = pc.binary_join_element_wise(pa.scalar("\n", texts.type), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", texts.type))
        split = pc.split_pattern(lines, " ")
        coded = pc.dictionary_encode(split.flatten())
        words = coded.dictionary.to_pylist()
        lacks = [w for w in words if w not in self.memo]
        self._learn([w for w in lacks if w[0] == "\n"], "", self.ends)
        self._learn([w for w in lacks if w[0] != "\n"], " ", self.opens)
        ids = pa.array(map(self.memo.__getitem__, words), pa.large_binary()).take(coded.indices)
        data, places = ids.buffers()[2], np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :]
        bounds = places[split.offsets.to_numpy()].tolist()
        # The line end before a text is not its own.
        return [data[i + len(self.line) : j].to_pybytes() for i, j in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        if not self.by_words:
            return self._plain(texts if isinstance(texts, list) else texts.to_pylist())
        if len(self.memo) + len(self.parts) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self._forget()
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        odd = pc.or_(pc.match_substring_regex(texts, ODD), pc.greater(pc.binary_length(texts), LONG))
        plain = texts.filter(pc.invert(odd))
        found = iter(self._joined(plain) if len(plain) else ())
        return [self._rest(text.as_py()) if o else next(found) for o, text in zip(odd.to_pylist(), texts, strict=True)]

    def _rest(self, text: str) -> bytes:
        """Ids of a text with other white space, or of a long one, a stretch at a time."""
        found, at = [], 0
        while at < len(text) or not found:
            cut = CUT.search(text, at + LONG)
            end = cut.start() if cut else len(text)
            parts = CUT.split(text[at:end])
            new = list({p for p in parts if p not in self.parts})
            self.parts.update(zip(new, self._plain(new), strict=True))
            self.chars += sum(map(len, new))
            found.append(b"".join(map(self.parts.__getitem__, parts)))
            at = end
        return b"".join(found)


#: Of a worker: the model's text and its words.
_known: tuple[str, Words] | None = None


def words_of(blob: str) -> Words:
    global _known
    if _known is None or _known[0] != blob:
        _known = (blob, Words(blob))
    return _known[1]


def opened(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder named as Hadoop names it, and the folder's path on it."""
    local = re.fullmatch(r"(?:file:/{0,2})?(/.*)", folder)
    return (arrow_fs.LocalFileSystem(), local[1]) if local else arrow_fs.FileSystem.from_uri(folder)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_records(df: DataFrame, folder: str, tokenizer_path: str, end: int | None = END, ident: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes ``folder``/data and ``folder``/index, and returns the index: part, file, record, offset, size (of the frame),
    first (ids before it in the file), tokens, doc_id. ``end``: an id behind each text. Ids are whole numbers."""
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = df.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(-(-total // shard_bytes), min(4 * spark.sparkContext.defaultParallelism, -(-total // LEAST_BYTES)), 1)
    # The last column tells equal rows apart, so that any number of them can be dealt to several shards.
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc(), F.col("_row").asc()]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(int(shards), *order).sortWithinPartitions(*order).drop("_row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = words_of(shared.value), TaskContext.get().partitionId()
        place, base = opened(folder)
        name = f"{part:06d}-{uuid.uuid4().hex}.rec"
        last = b"" if end is None else end.to_bytes(codec.width, "little")
        out, record, offset, first = None, 0, 0, 0
        try:
            for batch in batches:
                for ids, payloads in packed(batch.column("doc_id"), batch.column("text"), codec, last):
                    if out is None:
                        place.create_dir(f"{base}/data", recursive=True)
                        out = place.open_output_stream(f"{base}/data/{name}")
                    found = frames(payloads)
                    sizes = np.fromiter(map(len, found), np.int64, len(found))
                    tokens = (sizes - 16 - HEADER_BYTES) // codec.width
                    out.write(b"".join(found))
                    starts, firsts = offset + np.cumsum(sizes) - sizes, first + np.cumsum(tokens) - tokens
                    n = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * n, pa.int32()), pa.array([name] * n), pa.array(range(record, record + n), pa.int64()), *map(pa.array, (starts, sizes, firsts, tokens)), pa.array(ids, pa.int64())],
                        ["part", "file", "record", "offset", "size", "first", "tokens", "doc_id"],
                    )
                    record, offset, first = record + n, offset + int(sizes.sum()), first + int(tokens.sum())
        finally:
            if out is not None:
                out.close()

    index = dealt.mapInArrow(write, "part int, file string, record long, offset long, size long, first long, tokens long, doc_id long")
    index.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def packed(idents: pa.Array, texts: pa.Array, codec: Words, last: bytes) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Ids and payloads of texts, about ``TEXT_BYTES`` of these at a time."""
    ends, at, before = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0, 0
    while at < len(texts):
        end = min(int(np.searchsorted(ends, before + TEXT_BYTES)) + 1, len(texts))
        ids = idents[at:end].to_pylist()
        heads = (struct.pack(HEADER, codec.width, i is not None, i or 0) for i in ids)
        yield ids, [h + x + last for h, x in zip(heads, codec.encode(texts[at:end]), strict=True)]
        at, before = end, int(ends[end - 1])


def unframed(stream: pa.NativeFile, name: str, at: int, size: int, upto: int | None = None) -> Iterator[list[bytes]]:
    """Payloads of the frames from byte ``at`` (where the stream stands) of a file of ``size`` bytes on, some at a time; ``upto``: so
    many frames. Damaged or incomplete ones raise a ValueError."""
    left = upto
    while at < size and (left is None or left > 0):
        heads, payloads, sums, room, first = [], [], [], 0, at
        while at < size and room < BATCH_BYTES and (left is None or left > 0):
            head = stream.read(min(12, size - at))
            length = int.from_bytes(head[:8], "little")
            if len(head) < 12 or length > size - at - 16:
                raise ValueError(f"{name}: the record at byte {at} is damaged or cut off")
            body = stream.read(length + 4)
            heads.append(head[:8])
            payloads.append(body[:length])
            sums.append((int.from_bytes(head[8:], "little"), int.from_bytes(body[length:], "little")))
            room, at, left = room + length, at + length + 16, None if left is None else left - 1
        found = np.stack([masked(crc32c(heads)), masked(crc32c(payloads))], axis=1)
        if (found != np.array(sums, np.uint32)).any():
            raise ValueError(f"{name}: a record between bytes {first} and {at} is damaged")
        yield payloads


def columns(payloads: list[bytes]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """doc_id, ids (as 4-byte numbers) and their number of each payload."""
    idents, ids, counts = [], [], []
    for p in payloads:
        width, known, ident = struct.unpack_from(HEADER, p)
        found = np.frombuffer(p, f"<u{width}", offset=HEADER_BYTES)
        idents.append(ident if known else None)
        ids.append(found.astype("<u4").tobytes())
        counts.append(len(found))
    return pa.array(idents, pa.int64()), pa.array(ids, pa.binary()), np.array(counts, np.int64)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """part, record, first, doc_id, ids (binary: little-endian unsigned 32-bit numbers) of all records, from the files that the
    index names; checksums are verified, and each file's number of records."""
    files = spark.read.parquet(f"{folder}/index").groupBy("part", "file").agg(F.count("*").alias("records"))
    n = files.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = opened(folder)
        for batch in batches:
            for part, file, records in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "records")), strict=True):
                record = first = 0
                with place.open_input_file(f"{base}/data/{file}") as whole:
                    for payloads in unframed(pa.BufferedInputStream(whole, BATCH_BYTES), file, 0, whole.size()):
                        idents, ids, counts = columns(payloads)
                        at = np.arange(record, record + len(counts))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(at), pa.array(first + np.cumsum(counts) - counts), idents, ids], ["part", "record", "first", "doc_id", "ids"])
                        record, first = record + len(counts), first + int(counts.sum())
                if record != records:
                    raise ValueError(f"{file} has {record} records, its index {records}")

    return files.repartition(max(1, n)).mapInArrow(read, "part int, record long, first long, doc_id long, ids binary")


def read_shuffled(spark: SparkSession, folder: str, seed: int = 0) -> DataFrame:
    """place, doc_id, ids of all records in an order that the seed fixes: the index is sorted by a hash of the records' places,
    and each task fetches its records by their offsets."""
    index = spark.read.parquet(f"{folder}/index").withColumn("place", F.xxhash64(F.lit(seed), "part", "record"))
    tasks = max(1, index.select("file").distinct().count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = opened(folder)
        open_: dict[str, pa.NativeFile] = {}
        for batch in slices(batches):
            payloads = []
            for file, offset in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                if file not in open_:
                    if len(open_) >= 64:
                        open_.pop(next(iter(open_))).close()
                    open_[file] = place.open_input_file(f"{base}/data/{file}")
                open_[file].seek(offset)
                payloads += next(unframed(open_[file], file, offset, open_[file].size(), 1))
            idents, ids, _ = columns(payloads)
            yield pa.RecordBatch.from_arrays([batch.column("place"), idents, ids], ["place", "doc_id", "ids"])

    dealt = index.select("place", "file", "offset").repartitionByRange(tasks, "place").sortWithinPartitions("place")
    return dealt.mapInArrow(read, "place long, doc_id long, ids binary")


def file_starts(index: DataFrame) -> DataFrame:
    """part, start: ids in the files before a file. One row for each file goes through one task."""
    totals = index.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    index = write_records(table(spark, sf_dir, "documents"), folder, default_tokenizer())
    found = read_records(spark, folder).select("part", "doc_id", "first", F.octet_length("ids").alias("bytes"), F.crc32("ids").alias("ids_crc32"))
    return found.join(bounded(file_starts(index), 16), "part").select("doc_id", (F.col("start") + F.col("first")).alias("start"), (F.col("bytes") / 4).cast("long").alias("n_tokens"), "ids_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_token_records": op11_token_records}
