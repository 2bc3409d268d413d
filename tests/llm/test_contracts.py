"""Rows of the registered queries against the definitions of their columns, on a table of odd and plain texts."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from allocora.llm import queries, toxicity

SMALL = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\t", "a", "é" * 50, "x" * 30_000, "word " * 9_000,
    "mail bob@example.com, 10.0.0.255 or 10.0.0.256, 4111 1111 1111 1111, 4111111111111112, +49 (170) 555-1234.",
    "bob@example.com" * 3, "1.2.3.4.5.6.7.8", "+1234 +1 (2) 3-4.5 6789012", "naïve 😀 bob@a-b.co.uk 😀 1.1.1.1",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("contracts"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    types = docs.schema
    first = docs.agg({"doc_id": "max"}).first()[0] + 1
    odd = [tuple(first + 7 * i if f.name == "doc_id" else t if f.name == "text" else None for f in types) for i, t in enumerate(ODD)]
    docs.unionByName(spark.createDataFrame(odd, types)).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def texts(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def ids_of(texts, vocabulary, end):
    encoder = Tokenizer.from_file(queries.tokenizer(vocabulary))
    return {i: np.array([*encoder.encode(t, add_special_tokens=False).ids, end], "<u4") for i, t in texts.items()}


def test_packing(spark, folder, texts):
    ids = ids_of(texts, "word_bpe_49k.json", 1)
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in queries.QUERIES["op1_packing"](spark, folder).collect():
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] > 0 and zlib.crc32(piece.tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        documents[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert documents.keys() == ids.keys()
    for parts, end in [(p, len(ids[i])) for i, p in documents.items()] + [(p, None) for p in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == end if end is not None else at <= 2048


def test_token_files(spark, folder, texts):
    ids = ids_of(texts, "byte_bpe_50k.json", 2)
    expected, at = {}, 0
    for i in sorted(ids):
        expected[i] = (at, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        at += len(ids[i])
    found = queries.QUERIES["op3_token_files"](spark, folder).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found} == expected and len(found) == len(expected)


def luhn(digits):
    doubled = [int(d) * (1 + at % 2) for at, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def digits_of(text):
    return re.sub("[^0-9]", "", text)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(digits_of(t)) <= 19 and luhn(digits_of(t))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits_of(t)) <= 15),
}


def test_personal_data(spark, folder, texts):
    found = {r["doc_id"]: r for r in queries.QUERIES["op4_pii"](spark, folder).collect()}
    assert found.keys() == texts.keys()
    kinds = list(BASE)
    for i, text in texts.items():
        spans = [(m.start(), kinds.index(k), m.end()) for k, (pattern, fits) in BASE.items() for m in re.finditer(pattern, text) if fits(m[0])]
        shown = [f"{kinds[k]}:{start}:{end}" for start, k, end in sorted(spans)]
        assert [found[i][f"n_{k}"] for k in kinds] == [sum(s[1] == at for s in spans) for at in range(4)]
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        every = found[i]["spans"].split(",") if found[i]["spans"] else []
        assert set(shown) <= set(every) and len(every) == len(shown) + found[i]["n_disguised"]


def test_toxicity(spark, folder, texts):
    found = {r["doc_id"]: r for r in queries.QUERIES["op2_toxicity"](spark, folder).collect()}
    assert found.keys() == texts.keys()
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    assert toxicity.THRESHOLD == 0.7
