import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from weftline.llm import pieces

PATH = pieces.default_model()
HARD = ["", " ", "  two  spaces ", "▁ mark", "a▁b", "naïve café", "日本語 text", "emoji 👩‍👩‍👧 ok", "\x00nul", "<s> </s> <unk>", "a\nb\tc\r\n", "x" * 5000, " " * 40 + "end", "ﬁ ﬂ Å ①", "<0x41>", "�", "é"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts(n, seed=3):
    r = random.Random(seed)
    alphabet = "ab c\n\té▁日👍 .,0９Ａ　ﬁ́"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_ids_and_decoding_equal_the_library(library):
    codec = pieces.PieceCodec(pieces.read_model(PATH))
    texts = HARD + random_texts(300)
    for text, (ids, begins, ends) in zip(texts, codec.encode(texts)):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert codec.decode(ids.tolist()) == library.decode(ids.tolist())
        assert begins[0] == 0 and ends[-1] == len(text.encode()) and (begins[1:] >= begins[:-1]).all()
        spans = b"".join(text.encode()[b:e] for b, e in zip(begins, ends))
        assert spans == text.encode()


def surfaces(codec, text, ids, begins, ends):
    """Sources of pieces; the library gives a character's bytes to the last of its byte pieces, so runs of byte pieces are joined."""
    out, joined = [], False
    for i, b, e in zip(ids[1:-1], begins[1:-1], ends[1:-1]):
        byte = codec.types[i] == pieces.BYTE
        if byte and joined:
            out[-1] += text.encode()[b:e]
        else:
            out.append(text.encode()[b:e])
        joined = byte
    return [x.decode(errors="replace") for x in out]


def library_surfaces(codec, library, text):
    out, joined = [], False
    for p in library.encode(text, return_type="proto").pieces:
        byte = codec.types[p.id] == pieces.BYTE
        if byte and joined:
            out[-1] += p.surface
        else:
            out.append(p.surface)
        joined = byte
    return out


def test_spans_equal_the_library(library):
    codec = pieces.PieceCodec(pieces.read_model(PATH))
    texts = HARD + random_texts(100)
    for text, (ids, begins, ends) in zip(texts, codec.encode(texts)):
        assert surfaces(codec, text, ids, begins, ends) == library_surfaces(codec, library, text)


def test_decoding_any_ids(library):
    codec, r = pieces.PieceCodec(pieces.read_model(PATH)), random.Random(5)
    for _ in range(500):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), 1, 2, 0]) for _ in range(r.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_map(rule, squeeze, library):
    """With a compiled map, normalised text equals the library's and every byte points into its source."""
    proto = pb.ModelProto()
    proto.ParseFromString(pieces.read_model(PATH))
    source = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = pb.ModelProto()
    spec.ParseFromString(source.serialized_model_proto())
    proto.normalizer_spec.CopyFrom(spec.normalizer_spec)
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.escape_whitespaces = True
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    model = proto.SerializeToString()
    codec, theirs = pieces.PieceCodec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = HARD + random_texts(200, 9)
    for text, (ids, begins, ends) in zip(texts, codec.encode(texts)):
        out, align = codec.normalise(text)
        assert out.decode() == theirs.normalize(text)
        assert len(align) == len(out) + 1 and (np.diff(align) >= 0).all()
        assert ids.tolist() == theirs.encode(text, add_bos=True, add_eos=True)
        assert surfaces(codec, text, ids, begins, ends) == library_surfaces(codec, theirs, text)


def test_query_and_operator(spark, library, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  wörld", "x"), (3, "Hello  wörld", "x"), (None, "a" * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.op4_sentencepiece(spark, str(tmp_path)).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    encoded = pieces.encode_pieces(df, PATH)
    assert encoded.columns == ["doc_id", "text", "piece_ids", "piece_begins", "piece_ends"]
    back = pieces.decode_pieces(encoded, PATH).collect()
    assert sorted(r.decoded for r in back) == sorted(t or "" for _, t, _ in rows)
    assert pieces.encode_pieces(df.limit(0), PATH).count() == 0
