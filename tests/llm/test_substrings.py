"""Repeated passages against a plain count of all windows, and the registered query against SQL."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from corpus_data import frame, prose, rows
from pyspark.sql import functions as F

from allocora.llm import queries, substrings

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    for blank in BLANKS[1:]:
        text = (text or "").replace(blank, " ")
    return [w for w in text.split(" ") if w]


def brute(data, window):
    split = [words_of(r[1]) for r in data]
    counts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for row, words in zip(data, split, strict=True):
        gone = {i + k for i in range(len(words) - window + 1) if counts[tuple(words[i : i + window])] > 1 for k in range(window)}
        out.append((row[0], len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


def passages(seed=5):
    """Passages that several documents share at different places, once of 34 words and once of 35, and one document that repeats itself."""
    draw = random.Random(seed)
    shared, short, exact = (prose(draw, n) for n in (60, 34, 35))
    data = list(rows())
    data += [(3000 + i, f"{prose(draw, i)} {shared}\n{prose(draw, 20)}", "en", "s", 0) for i in range(6)]
    data += [(3100 + i, f"{prose(draw, 5)} {short} {prose(draw, 5)}", "en", "s", 0) for i in range(2)]
    data += [(3200 + i, f"{prose(draw, 5)}\t{exact}\x0b{prose(draw, 5)}", "en", "s", 0) for i in range(2)]
    data += [(3300, f"{exact[:20]} " + "la " * 50 + "end", "en", "s", 0), (3301, "x " * 34 + "x", "en", "s", 0), (3302, "x " * 35 + "y", "en", "s", 0)]
    return data


@pytest.mark.parametrize(("partitions", "width", "window"), [(1, 3, 35), (6, 17, 35), (3, 8, 5), (2, 8, 1)])
def test_against_all_windows(spark, partitions, width, window):
    data = passages()
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    found = substrings.without_repeats(frame(spark, data, partitions), window=window).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted((tuple(r) for r in found), key=repr) == brute(data, window)


def test_small_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(substrings, "TEXT_BYTES", 50)
    data = passages()
    packed = substrings._blocks(frame(spark, data), "doc_id", "text")
    assert packed.agg(F.sum("words")).first()[0] == sum(len(words_of(r[1])) for r in data)
    monkeypatch.setattr(substrings, "SLICE_WINDOWS", 100)
    found = substrings.without_repeats(frame(spark, data)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(data, 35)


def test_no_words(spark):
    data = [(1, None, None, None, None), (2, "", None, None, 0), (None, " \n ", None, None, 3)]
    assert substrings.without_repeats(frame(spark, [])).collect() == []
    found = substrings.without_repeats(frame(spark, data)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == [(1, 0, 0, ""), (2, 0, 0, ""), (None, 0, 0, "")]


def test_the_sketch_never_counts_too_little():
    draw = random.Random(1)
    vocabulary = sorted({prose(draw, 1).encode() for _ in range(300)})
    blocks = []
    for seed in range(4):
        rng = np.random.default_rng(seed % 2)
        numbers = rng.integers(0, len(vocabulary), 5000).astype("<i4")
        numbers[1000:1100] = np.arange(100)
        row = {
            "lengths": np.array([2000, 0, 3000], "<i8").tobytes(),
            "numbers": substrings._squeezed(numbers),
            "vocabulary": substrings.pa.compress(b" ".join(vocabulary), "zstd", asbytes=True),
        }
        blocks.append(substrings.Block(row, 35))
    slices, cells = 7, 1 << 12
    asked = {}
    for number, block in enumerate(blocks):
        for at, body, twice in block.sketch(slices, cells):
            asked.setdefault(at, []).append({"block": number, "body": body, "twice": twice})
    answers = {n: {} for n in range(len(blocks))}
    for at, parts in asked.items():
        for part, body in zip(parts, substrings._merged_sketch(cells)(parts), strict=True):
            answers[part["block"]][at] = body
    counts = Counter(pair for b in blocks for pair in zip(b.hashes[0].tolist(), b.hashes[1].tolist(), strict=True))
    for number, block in enumerate(blocks):
        flagged = block.estimated(answers[number], slices, cells)
        truly = np.array([counts[p] > 1 for p in zip(block.hashes[0].tolist(), block.hashes[1].tolist(), strict=True)])
        assert flagged[truly].all()


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    found = queries.QUERIES["op12_substrings"](spark, folder).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet'")
    expected = con.sql(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({queries.ORACLES['op12_substrings']})").fetchall()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == sorted(expected)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in found:
        if r["n_removed"] == 0:
            assert r["kept_sha256"] == hashlib.sha256(" ".join(words_of(texts[r["doc_id"]])).encode()).hexdigest()
