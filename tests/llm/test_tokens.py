"""Encoder, packing and token files against the tokenizers library and exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from corpus_data import SCHEMA, frame, rows

from allocora.llm import common, packing, token_files
from allocora.llm.common import word_encoder
from allocora.llm.queries import tokenizer

WORDS, BYTES = tokenizer("word_bpe_49k.json"), tokenizer("byte_bpe_50k.json")


def ids_of(path, text, end):
    from tokenizers import Tokenizer

    if path not in ids_of.made:
        ids_of.made[path] = Tokenizer.from_file(path)
        ids_of.made[path].encode_special_tokens = True
    made = ids_of.made[path]
    return np.array([*made.encode(text or "", add_special_tokens=False).ids, end], "<u4")


ids_of.made = {}


@pytest.mark.parametrize(("path", "blanks"), [(WORDS, False), (BYTES, True)])
def test_encoder_equals_library(path, blanks):
    draw = random.Random(4)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "É", "ß", "Σ", "'s", "'", "9", "１", "　", "\x1c", "\x85", "\xa0", "!",
             "Ω", "漢字", "😀", "don't ", "<|endoftext|>", "é", "İ", "ǅ", "​", "%%", "word,"]
    encoder = word_encoder(path, blanks)
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert encoder.encode([text])[0] == ids_of(path, text, 0)[:-1].tobytes(), repr(text)
    assert encoder.encode([None, ""]) == [b"", b""]


def test_plain_text_needs_no_search(monkeypatch):
    """Words between single blanks cost a split and a look-up, and a word met first one call of the model."""

    class Refused:
        def __getattr__(self, name):
            raise AssertionError(name)

    encoder = common.WordEncoder(BYTES, True)
    text = "Unseen words stand between single blanks\nand line ends\nhere"
    for name in ("_BLANKS_TOGETHER", "_OTHER_BLANKS"):
        monkeypatch.setattr(common, name, Refused())
    assert encoder.encode([text])[0] == ids_of(BYTES, text, 0)[:-1].tobytes()
    encoder.encode([text])
    monkeypatch.setattr(common, "_WORD_AND_SIGNS", Refused())
    assert encoder.encode(["Unseen others stand"])[0] == ids_of(BYTES, "Unseen others stand", 0)[:-1].tobytes()


def test_blanks_together_equals_its_search():
    draw = random.Random(6)
    blanks = [c for c in map(chr, range(0x110000)) if c.isspace()]
    for _ in range(20000):
        text = "".join(draw.choice(["a", "é", "漢", " ", "\n", draw.choice(blanks)]) for _ in range(draw.randint(0, 6)))
        assert common._blanks_together(text) == (common._BLANKS_TOGETHER.search(text) is not None), repr(text)


def test_difference_balances():
    draw = random.Random(1)
    sizes = [draw.randint(1, 512) for _ in range(900)]
    dealt = packing.difference(sizes, 64)
    assert sorted(i for window in dealt for i in window) == list(range(900))
    sums = [sum(sizes[i] for i in window) for window in dealt]
    assert max(sums) - min(sums) <= 8


@pytest.mark.parametrize("sizes", [[1], [2047], [300] * 7, [512] * 9, [1, 512, 3, 511] * 40, [700, 1348]])
def test_block_keeps_every_token(sizes):
    pieces = [(doc, 0, n) for doc, n in enumerate(sizes)]
    windows = packing.pack_block(pieces)
    found = defaultdict(list)
    for window in windows:
        length = sum(p[2] for p in window)
        assert length <= packing.CAPACITY
        for doc, start, n in window:
            found[doc] += range(start, start + n)
    assert {doc: sorted(places) for doc, places in found.items()} == {doc: list(range(n)) for doc, n in enumerate(sizes)}
    padding = sum(packing.CAPACITY - n for n in (sum(p[2] for p in w) for w in windows) if n & (n - 1))
    assert padding <= packing.STEP


def test_pack(spark):
    data = rows()
    pieces = packing.pack(frame(spark, data), WORDS).collect()
    whole = defaultdict(list)
    for i, text, *_ in data:
        whole[i].append(ids_of(WORDS, text, packing.END_ID).tobytes())
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["tokens"]) == 4 * p["length"] > 0
        of_doc[p["doc_id"]].append(p)
        of_sequence[p["sequence_id"]].append(p)
    for i, texts in whole.items():
        assert sum(p["length"] for p in of_doc[i]) == sum(len(t) // 4 for t in texts)
        for p in of_doc[i]:
            assert any(len(t) // 4 == p["doc_tokens"] and t[4 * p["start"] :].startswith(bytes(p["tokens"])) for t in texts)
    for found in of_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.CAPACITY
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORDS).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(frame(spark), WORDS, capacity=1000)


@pytest.mark.parametrize("high", [1, 2, 300, 50257, 2**32])
@pytest.mark.parametrize("count", [0, 1, 255, 256, 257, 5000])
def test_blocks_round_trip(high, count):
    draw = np.random.default_rng(count)
    ids = draw.integers(0, high, count, dtype=np.uint64).astype(np.uint32)
    ids[draw.random(count) < 0.03] = high - 1
    payload, starts = token_files.encode_blocks(ids)
    assert (token_files.decode_blocks(payload, starts, count) == ids).all()
    if count > 600:
        assert (token_files.decode_blocks(payload, starts, count, slice(1, 2)) == ids[256:512]).all()


def test_blocks_are_smaller_than_plain_ids():
    ids = np.random.default_rng(1).zipf(1.3, 50_000).clip(max=50_000).astype(np.uint32)
    assert len(token_files.encode_blocks(ids)[0]) < 0.6 * 4 * len(ids)


def test_files_round_trip(spark, tmp_path):
    data = rows()
    token_files.write_token_files(frame(spark, data), str(tmp_path / "files"), BYTES)
    found = token_files.read_token_files(spark, str(tmp_path / "files")).collect()
    expected = defaultdict(list)
    for i, text, *_ in data:
        expected[i].append(ids_of(BYTES, text, token_files.END_ID).tobytes())
    got = defaultdict(list)
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += len(r["tokens"]) // 4
        got[r["doc_id"]].append(bytes(r["tokens"]))
    assert {i: sorted(t) for i, t in got.items()} == {i: sorted(t) for i, t in expected.items()}
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_files_of_an_empty_table(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), str(tmp_path / "files"), BYTES)
    assert token_files.read_token_files(spark, str(tmp_path / "files")).count() == 0


def test_crc_of_query(spark):
    from pyspark.sql import functions as F

    ids = ids_of(BYTES, "some text", 2).tobytes()
    row = spark.createDataFrame([(bytearray(ids),)], "tokens binary").select(F.crc32("tokens")).collect()[0]
    assert row[0] == zlib.crc32(ids)
