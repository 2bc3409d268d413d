"""The prefix trie against plain dictionaries of prefixes, and the registered query against SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allocora.llm import prefix_trie, queries

SCHEMA = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
)
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def table(spark, data, partitions=3):
    made = spark.createDataFrame(data, SCHEMA).repartition(partitions)
    return made.withColumns({c: F.lit("mine") for c in ("conv", "pos", "k", "n", "depth", "path", "part", "bytes")})


def brute(data):
    given = defaultdict(list)
    for conv, turn, role, text in data:
        if conv is not None:
            given[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    given = {c: [t[1:] for t in sorted(rows)] for c, rows in given.items()}
    rebuilt = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(given.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, found in members.items():
        spared = (len(found) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += spared
            leaves[node[:d]] += node not in children
    out = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in found if len(rebuilt[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((found[0], len(node), parent, len(found), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, count=120, longest=12, vocabulary=3):
    draw = random.Random(seed)
    data = []
    for c in draw.sample(range(3 * count), count):
        for turn in range(draw.randint(1, longest)):
            data.append((c, turn, draw.choice(("user", "assistant", None)), draw.choice(("", "hé", "hello", None, "x" * 50)[:vocabulary])))
    copy = [(turn, "user", f"copy {turn}") for turn in range(20)]
    data += [(5000 + 5 * i, *t) for i in range(40) for t in copy]
    data += [(6000 + 5 * i, *t) for i in range(10) for t in copy[: 12 + i % 3]]
    data += [(7000, None, "user", "first"), (7000, 0, "user", "second"), (None, 0, "user", "of none"), (7001, 0, "user", "few")]
    data += [(8000, i, "user", f"long {i}") for i in range(300)] + [(8005, i, "user", f"long {i}") for i in range(300)]
    data += [(8010, i, "user", f"long {i}") for i in range(200)] + [(7999, i, "user", f"long {i}") for i in range(64)]
    draw.shuffle(data)
    return data


def shown(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)


@pytest.mark.parametrize(("seed", "width", "batch", "chunk"), [(1, 8, 10_000, 64), (2, 5, 7, 4), (3, 13, 3, 8), (4, 3, 50, 1)])
def test_against_prefixes(spark, monkeypatch, seed, width, batch, chunk):
    data = conversations(seed)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    monkeypatch.setattr(prefix_trie, "GROUP", 3)
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = shown(prefix_trie.prefix_trie(table(spark, data, 1 + seed), chunk))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == brute(data)


def test_repeated_rows_and_few_rows(spark):
    assert shown(prefix_trie.prefix_trie(table(spark, []))) == []
    assert shown(prefix_trie.prefix_trie(table(spark, [(None, 1, "user", "x")]))) == []
    for data in ([(1, 0, "user", "gone")], [(10, 0, "user", "a"), (10, 0, "user", "a"), (10, 0, None, None)]):
        assert shown(prefix_trie.prefix_trie(table(spark, data))) == brute(data)
    # The remainder of a negative id has its sign: -7 belongs to the family of -5.
    negative = shown(prefix_trie.prefix_trie(table(spark, [(-5, 0, "u", "x"), (-7, 0, "u", "y")])))
    h = zlib.crc32(b"-7") % 9
    assert [r[1] for r in negative] == [0, 1, 1] if h == 0 else [0, 1]


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    found = shown(queries.QUERIES["op11_prefix_trie"](spark, folder))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{folder}/conversations.parquet'")
    expected = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLES['op11_prefix_trie']})").fetchall()
    assert found == sorted(expected, key=repr)
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert found == brute([tuple(r) for r in rows])
