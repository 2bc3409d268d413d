"""Fingerprints and components against brute force."""

import re

import numpy as np
import pytest
import xxhash
from corpus_data import SCHEMA, frame, rows
from pyspark.sql import functions as F

from allocora.llm import simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fingerprints, max_bits):
    near = np.bitwise_count(fingerprints[:, None] ^ fingerprints[None, :]) <= max_bits
    label = np.arange(len(fingerprints))
    while True:
        new = np.where(near, label[None, :], len(label)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_fingerprint_is_spark_hash_majority(spark):
    for _, text, *_ in rows():
        assert simhash.fingerprint(text) == fingerprint(text)
    spark_hash = spark.sql("SELECT xxhash64('a b c d')").collect()[0][0]
    assert spark_hash % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize(("max_bits", "tile"), [(1, 8192), (4, 8192), (4, 5), (9, 8192)])
def test_links_connect_what_is_near(spark, monkeypatch, max_bits, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    draw = np.random.default_rng(max_bits)
    found = set(draw.integers(0, 2**63, 60).tolist())
    for base in list(found):
        for _ in range(int(draw.integers(0, 25))):
            near = base
            for bit in draw.integers(0, 64, int(draw.integers(1, max_bits + 2))):
                near ^= 1 << int(bit)
            found.add(near)
    values = np.array(sorted(found), np.uint64)
    signed = values.view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.links(nodes, max_bits)
    for a, b in links.collect():
        assert ((a ^ b) % 2**64).bit_count() <= max_bits
    root = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    expected = {}
    for value, label in zip(signed, classes(values, max_bits), strict=True):
        expected.setdefault(label, set()).add(value)
    got = {}
    for value in signed:
        got.setdefault(root.get(value, value), set()).add(value)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))
    assert all(min(members) == key for key, members in got.items())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 100), (201, 200)], "a long, b long")
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert root == {i: 0 for i in range(1, 51)} | {201: 200}


def test_near_duplicates_and_one_of_each(spark):
    data = rows()
    docs = frame(spark, data)
    prints = np.array([fingerprint(t) for _, t, *_ in data], np.uint64)
    label = classes(prints, simhash.MAX_BITS)
    least = {}
    for (i, *_), k in zip(data, label, strict=True):
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    expected = sorted((i if i is not None else -1, int(p), least[k] if least[k] is not None else -1) for (i, *_), p, k in zip(data, prints, label, strict=True))
    found = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((r[0] if r[0] is not None else -1, r[1] % 2**64, r[2] if r[2] is not None else -1) for r in found) == expected
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(label.tolist()))
    members = {}
    for (i, *_), k in zip(data, label, strict=True):
        members.setdefault(k, []).append(i)
    first = sorted(min((-1 if i is None else i) for i in m) for m in members.values())
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == first


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_per_component(empty).count() == 0


def test_hex_form(spark):
    row = spark.createDataFrame([(-1,), (5,)], "f long").select(F.lpad(F.lower(F.hex("f")), 16, "0")).collect()
    assert [r[0] for r in row] == ["f" * 16, "0" * 15 + "5"]


def test_of_equal_rows_always_the_same_stays(spark):
    data = [(1, "one two three four five", lang, source, 23) for lang, source in (("en", "b"), ("de", "a"), ("en", "a"), (None, "c"))]
    for order in (data, data[::-1], data[2:] + data[:2]):
        kept = simhash.one_per_component(spark.createDataFrame(order, SCHEMA).repartition(3)).collect()
        assert [(r["lang"], r["source"]) for r in kept] == [(None, "c")]
