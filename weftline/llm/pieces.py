"""Offset-preserving SentencePiece encoding and decoding (operator 4).

A text is normalised here, not in the library: at each place the longest key of the model's compiled character
map that fits is replaced, and for every normalised byte the source byte it came from is recorded. The model then
segments the normalised text, and each piece's normalised range is projected to a byte span of the source.

Null text counts as empty; empty text gives the begin and end ids alone. Rows are independent: repeated rows and
doc ids are each encoded, long texts are encoded whole, an empty table gives an empty table.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import slices, table

SPACE = "▁".encode()
UNKNOWN_SURFACE = " ⁇ ".encode()
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters that go to the segmenter at a time.
BATCH_CHARS = 1 << 20


class CharsMap:
    """A compiled character map: a double-array trie over UTF-8 keys, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        if blob:
            length = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + length], "<u4").tolist()
            self.strings = blob[4 + length :]
        else:
            self.units, self.strings = [], b""
        starts = bytes(c for c in range(1, 256) if self._step(self._base(0), c) is not None) if self.units else b""
        self.starter = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in starts) + b"]") if starts else None

    def _base(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that ``data`` holds at ``at``."""
        found, base = None, self._base(0)
        for i in range(at, len(data)):
            node = self._step(base, data[i])
            if node is None:
                break
            base = self._base(node)
            if self.units[node] & 0x100:
                found = (self.units[base] & 0x7FFFFFFF, i + 1 - at)
        if not found:
            return None
        return self.strings[found[0] : self.strings.index(b"\0", found[0])], found[1]


class PieceCodec:
    """Encoder and decoder of one model file; built once in each Python worker."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.spec = pb.NormalizerSpec()
        self.spec.CopyFrom(proto.normalizer_spec)
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.map = CharsMap(self.spec.precompiled_charsmap)
        self.user_defined = sorted((p.piece.encode() for p in proto.pieces if p.type == USER_DEFINED), key=len, reverse=True)
        self.user_pattern = re.compile(b"|".join(map(re.escape, self.user_defined))) if self.user_defined else None
        self.types = [p.type for p in proto.pieces]
        self.surfaces = [int(p.piece[3:5], 16).to_bytes(1, "little") if p.type == BYTE else b"" if p.type == CONTROL else p.piece.encode() for p in proto.pieces]
        self.control = np.array([t == CONTROL for t in self.types])
        self.lengths = np.array([len(x) for x in self.surfaces], np.int64)
        self.decoded = [UNKNOWN_SURFACE if t == UNKNOWN else x.replace(SPACE, b" ") if t != BYTE else x for x, t in zip(self.surfaces, self.types, strict=True)]
        ids = {p.piece: i for i, p in enumerate(proto.pieces)}
        self.begin, self.end = ids[proto.trainer_spec.bos_piece], ids[proto.trainer_spec.eos_piece]
        self.unknown = self.types.index(UNKNOWN)
        # The segmenter gets normalised text and leaves it as it is.
        proto.normalizer_spec.name = "identity"
        proto.normalizer_spec.precompiled_charsmap = b""
        proto.normalizer_spec.add_dummy_prefix = False
        proto.normalizer_spec.remove_extra_whitespaces = False
        proto.normalizer_spec.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and for their end the place in the source's bytes."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.map.starter is None and self.user_pattern is None and not self.spec.remove_extra_whitespaces and self.spec.escape_whitespaces and not self.suffix:
            raw = np.frombuffer(data, np.uint8)
            align = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(SPACE), 1))
            out = data.replace(b" ", SPACE)
            if self.spec.add_dummy_prefix:
                out, align = SPACE + out, np.concatenate([np.zeros(len(SPACE), np.int64), align])
            return out, np.append(align, len(data))
        return self._normalise(data)

    def _parts(self, data: bytes) -> Iterator[tuple[bytes, int, int]]:
        """(replacement, start, length) over the source, by longest prefixes; what no key fits stays."""
        at = 0
        while at < len(data):
            user = self.user_pattern.match(data, at) if self.user_pattern else None
            if user:
                yield user[0], at, len(user[0])
                at = user.end()
                continue
            hit = self.map.longest(data, at) if self.map.starter and self.map.starter.match(data, at) else None
            if hit:
                yield hit[0], at, hit[1]
                at += hit[1]
                continue
            lead = data[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            yield data[at : at + size], at, size
            at += size

    def _normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        space = SPACE if self.spec.escape_whitespaces else b" "
        squeeze = self.spec.remove_extra_whitespaces
        out, align, done, after_space = bytearray(), [], 0, squeeze
        parts = list(self._parts(data))
        if squeeze:
            skip = 0
            while skip < len(parts) and parts[skip][0] == b" ":
                done = parts[skip][1] + parts[skip][2]
                skip += 1
            parts = parts[skip:]
            if not parts:
                return b"", np.array([done], np.int64)
        if self.spec.add_dummy_prefix and not self.suffix:
            out += space
            align += [done] * len(space)
        for new, start, size in parts:
            if after_space:
                new = new.lstrip(b" ")
            if new:
                shown = new.replace(b" ", space)
                out += shown
                align += range(start, start + size) if shown == data[start : start + size] else [start] * len(shown)
                after_space = new.endswith(b" ")
            done = start + size
            if not squeeze:
                after_space = False
        if squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                done = align[len(out)]
                del align[len(out) :]
        if self.spec.add_dummy_prefix and self.suffix:
            out += space
            align += [done] * len(space)
        return bytes(out), np.array([*align, done], np.int64)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids with the begin and end ids, and every id's span of source bytes.

        A byte that stands for itself points to its own place, so each byte piece of a character that no piece
        covers spans that byte; all bytes of a replacement point to the start of what it replaced.
        """
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j]) <= BATCH_CHARS):
                chars += len(texts[j])
                j += 1
            normal = [self.normalise(x) for x in texts[i:j]]
            shown = [x.decode() for x, _ in normal]
            for (out, align), ids, text in zip(normal, self.segmenter.encode(shown, num_threads=1), shown, strict=True):
                ids = np.array(ids, np.int64)
                sizes = self.lengths[ids]
                if self.unknown in ids:  # an unknown piece's length isn't its own
                    sizes = np.array([len(p.surface.encode()) for p in self.segmenter.encode(text, return_type="proto").pieces], np.int64)
                ends = np.cumsum(sizes)
                assert not len(out) or ends[-1] == len(out), "pieces don't cover the normalised text"
                begins = align[ends - sizes]
                yield (
                    np.concatenate([[self.begin], ids, [self.end]]),
                    np.concatenate([[0], begins, align[-1:]]),
                    np.concatenate([[0], align[ends], align[-1:]]),
                )
            i = j

    def decode(self, ids) -> str:
        """Text of ids; control ids give nothing, a lone byte that isn't UTF-8 gives U+FFFD."""
        control = self.control[np.asarray(ids, np.int64)]
        parts = list(map(self.decoded.__getitem__, ids))
        first = int(np.argmin(control)) if len(control) and not control.all() else None
        if first is not None and self.spec.add_dummy_prefix and not self.suffix and self.surfaces[ids[first]].startswith(SPACE):
            parts[first] = parts[first][1:]
        if not control[1:-1].any():  # then no run of byte pieces is broken
            with contextlib.suppress(UnicodeDecodeError):
                return b"".join(parts).decode()
        return self._decode(parts, [self.types[i] == BYTE for i in ids])

    def _decode(self, parts: list[bytes], is_byte: list[bool]) -> str:
        """Runs of bytes that no other piece breaks are read as UTF-8, character by character."""
        out, run = [], b""
        for part, byte in [*zip(parts, is_byte, strict=True), (b"", False)]:
            if byte:
                run += part
                continue
            while run:
                lead = run[0]
                size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
                try:
                    out.append(run[:size].decode())
                except UnicodeDecodeError:
                    out.append("�")
                    size = 1
                run = run[size:]
            out.append(part.decode())
        return "".join(out)


_codecs: dict[int, PieceCodec] = {}


def codec_of(model: bytes) -> PieceCodec:
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def read_model(path: str) -> bytes:
    """The model file, read on the driver and shipped to the workers (a vocabulary: some hundred KB)."""
    with open(path, "rb") as f:
        return f.read()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(df: DataFrame, model_path: str, text: str = "text", prefix: str = "piece_") -> DataFrame:
    """``df`` with ids, begins and ends of every text: three arrays named by ``prefix``. The input's own columns of
    these names give way."""
    names = [prefix + x for x in ("ids", "begins", "ends")]
    kept = [c for c in df.columns if c not in names]
    shared = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    types = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            found = list(codec.encode(texts))
            new = [pa.array([x[k] for x in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, *names])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), f"{names[0]} array<int>", f"{names[1]} array<bigint>", f"{names[2]} array<bigint>"])
    return df.select(*kept).mapInArrow(run, fields)


def decode_pieces(df: DataFrame, model_path: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that each row's ids stand for; null ids give null."""
    kept = [c for c in df.columns if c != out]
    shared = df.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in slices(batches):
            new = pa.array([None if x is None else codec.decode(x) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), new], [*kept, out])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), f"{out} string"])
    return df.select(*kept).mapInArrow(run, fields)


def digest_pieces(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256: digests of the encoder's and decoder's results,
    taken in the worker so that the ids of a corpus needn't travel."""
    shared = df.sparkSession.sparkContext.broadcast(read_model(model_path))

    def digests(codec: PieceCodec, texts: list[str]) -> Iterator[tuple]:
        for ids, begins, ends in codec.encode(texts):
            spans = np.stack([begins, ends], axis=1).astype("<u8")
            yield (len(ids), *(hashlib.sha256(x).hexdigest() for x in (ids.astype("<u4").tobytes(), codec.decode(ids.tolist()).encode(), spans.tobytes())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in slices(batches):
            found = list(digests(codec, [x or "" for x in batch.column("text").to_pylist()]))
            cols = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    kind = dict(df.dtypes)["doc_id"]
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_pieces(table(spark, sf_dir, "documents"), default_model())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_sentencepiece": op4_sentencepiece}
