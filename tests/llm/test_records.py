"""Token records: checksums, ids against the library, files, index and damage."""

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import records

PATH = records.default_tokenizer()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    return model


@pytest.fixture(scope="module")
def words():
    with open(PATH, encoding="utf-8") as f:
        return records.Words(f.read())


def crc32c_by_bits(data):
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = state >> 1 ^ (records.POLYNOMIAL if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_checksums():
    assert records.crc32c([b"123456789"]).tolist() == [0xE3069283]
    rng = np.random.default_rng(5)
    buffers = [rng.bytes(n) for n in (0, 1, 7, 8, 63, 64, 65, 127, 128, 129, 1000, 5000)] + [bytes(200)]
    assert records.crc32c(buffers).tolist() == [crc32c_by_bits(b) for b in buffers]
    assert records.crc32c([]).tolist() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Z9 ,é\n\n\t\r.'!\x1c\x85\xa0 é猫_-\U0001f600́"), max_size=40))
def test_ids_are_the_librarys(words, library, text):
    texts = [text, "", text.strip(), " ".join(text.split())]
    assert [np.frombuffer(x, "<u2").tolist() for x in words.encode(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_stretches_of_long_texts(words, library, monkeypatch):
    monkeypatch.setattr(records, "LONG", 7)
    for text in ("one two  three\tfour\n\nfive six", "a" * 50, " lead and trail ", "x y z " * 9):
        assert np.frombuffer(words.encode([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_word_is_looked_up_once_for_all_its_places(words, library):
    """Python's steps follow the distinct words of a batch of texts, not all their words."""

    class Counted(dict):
        lookups = 0

        def __getitem__(self, key):
            Counted.lookups += 1
            return dict.__getitem__(self, key)

    words.memo = Counted(words.memo)
    texts = ["one two, three\nfour two " * 400 + "end", "", "three " * 900 + "one", " odd  ", "two"]
    assert [np.frombuffer(x, "<u2").tolist() for x in words.encode(pa.array(texts))] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert 0 < Counted.lookups < 40


def test_a_full_memo(words, library, monkeypatch):
    monkeypatch.setattr(records, "MEMO_WORDS", 2)
    for text in ("one two three", "four five\nsix", "one seven"):
        assert np.frombuffer(words.encode([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_whole_texts_where_words_cannot_be_told(library, words):
    import json

    with open(PATH, encoding="utf-8") as f:
        about = json.load(f)
    about["pre_tokenizer"]["add_prefix_space"] = True
    other = records.Words(json.dumps(about))
    assert not other.by_words and words.by_words
    assert np.frombuffer(other.encode(["one two"])[0], "<u2").tolist() == library.encode(" one two", add_special_tokens=False).ids


ROWS = [
    (7, "a line\nand another", "x", 1), (3, None, "y", 2), (5, "", None, 3), (None, "without an id", "x", 4), (2, "equal rows", "x", 5), (2, "equal rows", "x", 5),
    (2, "an equal id", "x", 6), (-4, "  spaces \n\n  and <|endoftext|> signs ", "z", 7), (9, "very long " * 60_000, "x", 8),
]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("records") / "out")
    df = spark.createDataFrame(ROWS, "doc_id long, text string, file string, part long")
    return folder, records.write_records(df, folder, PATH, shard_bytes=1 << 18)


def test_round_trip(spark, library, written):
    folder, index = written
    found = [r for r in records.read_records(spark, folder).join(records.file_starts(index), "part").orderBy("start", "first").collect()]
    ids = lambda text: [*library.encode(text or "", add_special_tokens=False).ids, records.END]
    assert [r.doc_id for r in found] == [None, -4, 2, 2, 2, 3, 5, 7, 9]
    want = sorted((str(x[0]), ids(x[1])) for x in ROWS)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in found) == want
    counts = [len(r.ids) // 4 for r in found]
    assert [r.start + r.first for r in found] == np.cumsum([0, *counts[:-1]]).tolist()
    assert [r.tokens for r in index.orderBy("part", "record").collect()] == counts
    assert len({r.part for r in found}) > 1


def test_shuffled_reads(spark, written):
    folder, _ = written
    key = lambda r: (str(r.doc_id), zlib.crc32(r.ids))
    one, again, other = ([key(r) for r in records.read_shuffled(spark, folder, seed).orderBy("place").collect()] for seed in (1, 1, 2))
    assert one == again and one != other
    assert sorted(one) == sorted(other) == sorted(key(r) for r in records.read_records(spark, folder).collect())


def test_files_that_the_index_lacks_are_not_read(spark, written):
    folder, _ = written
    with open(f"{folder}/data/000000-lost.rec", "wb") as f:
        f.write(b"left by a lost task")
    assert records.read_records(spark, folder).count() == len(ROWS)


@pytest.mark.parametrize("damage", ["flip", "cut", "length"])
def test_damage_is_noticed(spark, tmp_path, damage):
    folder = str(tmp_path / "out")
    records.write_records(spark.createDataFrame([(1, "some words"), (2, "some more")], "doc_id long, text string"), folder, PATH)
    name = next(x for x in os.listdir(f"{folder}/data") if x.endswith(".rec"))
    with open(f"{folder}/data/{name}", "r+b") as f:
        data = bytearray(f.read())
        if damage == "cut":
            data = data[:-3]
        else:
            data[-6 if damage == "flip" else 3] ^= 1
        f.seek(0)
        f.truncate()
        f.write(data)
    with pytest.raises(Exception, match=re.escape(name)):
        records.read_records(spark, folder).collect()


def test_an_empty_table(spark, tmp_path):
    index = records.write_records(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "out"), PATH)
    assert index.count() == records.read_records(spark, str(tmp_path / "out")).count() == records.read_shuffled(spark, str(tmp_path / "out")).count() == 0
