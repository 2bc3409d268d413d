"""SimHash near-duplicates: fingerprints, links found by a pigeonring filter, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allocora.runtime import small_table, stage

BITS = 64
SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: A key's fingerprints are compared in tiles of at most twice this many.
TILE = 8192
#: Keys hold the ring's place above these bits.
KEY_BITS = 56
#: Runs up to this long are compared by shifting, longer ones by a search from member to member.
SHORT_RUN = 24


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is 1 if more than half of the shingles' hashes have it.

    Words of the text, A-Z lower-cased, in shingles of ``shingle`` (fewer words: all
    of them as one), each hashed by XXH64 with seed 42. No words: 0.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return sum(1 << bit for bit in np.flatnonzero(2 * counts > len(hashes)).tolist())


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fingerprint`` (its 64 bits as a signed long)."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = np.array([fingerprint(t, shingle) for t in part.column(0).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found.view(np.int64))], names=schema.names)

    return docs.select(text_col, *(F.col(c).alias(f"__{c}") for c in keep)).mapInArrow(run, schema)


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the ``max_bits`` + 1 segments round the ring, three at least."""
    count = max(max_bits, 2) + 1
    edges = [round(i * BITS / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _keys(fingerprints: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys under which fingerprints that start a chain alike meet, with their fingerprints.

    With ``max_bits`` + 1 segments a ring of differences that sum to at most
    ``max_bits`` has a place from which each chain of l segments differs in at most
    l - 1 bits: none in the first segment, at most one in the first two. A key is
    the first segment's value and the second's. Of two second segments one bit
    apart, one has even parity; it is entered under all values one bit away too.
    """
    segments = _segments(max_bits)
    for ring in range(len(segments)):
        (a, a_width), (b, b_width) = segments[ring], segments[(ring + 1) % len(segments)]
        first = (fingerprints >> np.uint64(a)) & np.uint64((1 << a_width) - 1)
        second = (fingerprints >> np.uint64(b)) & np.uint64((1 << b_width) - 1)
        base = (np.uint64(ring) << np.uint64(KEY_BITS)) | (first << np.uint64(b_width))
        yield base | second, fingerprints
        even = np.bitwise_count(second) % 2 == 0
        for bit in range(b_width):
            yield base[even] | (second[even] ^ np.uint64(1 << bit)), fingerprints[even]


def _linked(a: np.ndarray, b: np.ndarray, ring: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether pairs link: the chain of three segments first, the full distance for those that keep to its budget."""
    segments = _segments(max_bits)
    masks = np.zeros(len(segments), np.uint64)
    for at in range(len(segments)):
        for first, width in {segments[(at + k) % len(segments)] for k in range(3)}:
            masks[at] |= np.uint64(((1 << width) - 1) << first)
    differing = a ^ b
    out = np.bitwise_count(differing & masks[ring]) <= 2
    out[out] = np.bitwise_count(differing[out]) <= max_bits
    return out


def _spanning(found: np.ndarray, max_bits: int, left: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among a key's fingerprints, one per fingerprint at most.

    With ``left``, only links between the first ``left`` and the others count.
    """
    waiting = np.ones(len(found), bool)
    for start in range(len(found)):
        if not waiting[start]:
            continue
        waiting[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(waiting)
            if left is not None:
                rest = rest[rest >= left] if at < left else rest[rest < left]
            near = rest[np.bitwise_count(found[rest] ^ found[at]) <= max_bits]
            if len(near):
                waiting[near] = False
                queue += near.tolist()
                yield np.full(len(near), found[at]), found[near]


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most ``max_bits`` apart, enough to connect all that link.

    ``fingerprints`` has one column of distinct longs. Each gets a few keys by the
    pigeonring filter, so the work grows with their number. A key's fingerprints
    are compared in one task and give at most one link each, never all pairs; a key
    with more than ``TILE`` of them is cut into tiles that are dealt to tasks of
    their own, so that none is too large and no pair is left out.
    """
    if not 1 <= max_bits < BITS // 2:
        raise ValueError("max_bits must lie between 1 and 31")
    column = fingerprints.columns[0]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for keys, found in _keys(values, max_bits):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(found.view(np.int64))], names=["key", "fp"])

    rows = stage(fingerprints.filter(F.col(column).isNotNull()).select(column).mapInArrow(keyed, "key long, fp long"), "simhash_keys")
    crowded = small_table(rows.groupBy("key").count().filter(F.col("count") > TILE).withColumn("cuts", F.ceil(F.col("count") / TILE).cast("int")).select("key", "cuts"))
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    tiled = (
        rows.join(crowded, "key", "left")
        .withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("second"), "fp")
    )
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            key, low, high, second, fp = columns
            change = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            lengths = np.diff(np.append(starts, len(key)))
            run = np.repeat(np.arange(len(starts)), lengths)
            short = lengths <= SHORT_RUN
            for shift in range(1, min(SHORT_RUN, int(lengths.max()))):
                a = np.flatnonzero((run[:-shift] == run[shift:]) & short[run[:-shift]])
                a = a[(low[a] == high[a]) | (second[a] != second[a + shift])]
                a = a[_linked(fp[a], fp[a + shift], key[a] >> KEY_BITS, max_bits)]
                if len(a):
                    yield fp[a], fp[a + shift]
            for at in np.flatnonzero(~short):
                part = slice(starts[at], starts[at] + lengths[at])
                left = None if low[starts[at]] == high[starts[at]] else int((~second[part]).sum())
                yield from _spanning(fp[part], max_bits, left)

        def merged(columns: list[np.ndarray]) -> pa.RecordBatch | None:
            """Links of whole runs; those that add nothing to the links before them are left out."""
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            out: tuple[list[int], list[int]] = [], []
            for a, b in runs(columns):
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    p, q = root(x), root(y)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        out[0].append(x)
                        out[1].append(y)
            if not out[0]:
                return None
            sides = [pa.array(np.array(side, np.uint64).view(np.int64)) for side in out]
            return pa.RecordBatch.from_arrays(sides, names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            columns[4] = columns[4].view(np.uint64)
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
            key, low, high = columns[:3]
            if not len(key):
                continue
            last = (key == key[-1]) & (low == low[-1]) & (high == high[-1])
            cut = len(key) - int(last.sum())
            if cut and (found := merged([c[:cut] for c in columns])) is not None:
                yield found
            held = [c[cut:] for c in columns]
        if held is not None and (found := merged(held)) is not None:
            yield found

    dealt = tiled.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "second")
    return dealt.mapInArrow(compared, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes of ``edges`` (a, b) other than the root.

    Large-star and small-star rounds, each an aggregation and a join on the node, so
    that a node with very many links is combined before the shuffle and split by
    the join. Each round is written to the shared folder.
    """
    current = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        current = stage(small.distinct(), "links")
        found = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if tuple(found) == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(found)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, text_hash, fingerprint (long) and component_id of every row.

    Fingerprints are reduced to distinct ones before anything is compared, so a
    group of exact copies costs one fingerprint however large it is.
    ``component_id`` is the smallest doc_id that can be reached over links of at
    most ``max_bits`` bits (null only if all of them are null). Null, empty and
    blank texts have the fingerprint 0 and link like any other. Repeated rows share
    a component. Other columns are ignored; an empty table gives no rows.
    """
    rows = with_fingerprint(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), shingle=shingle, keep=("doc_id", "text_hash"))
    rows = stage(rows, "fingerprints")
    least = stage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    roots = components(links(least.select("fingerprint"), max_bits))
    rooted = least.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(named, "root").drop("least"), "fingerprint")


def one_per_component(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the smallest doc_id (null first).

    Ties between different texts go to the smaller text hash; of rows with equal id
    and text the first in the order of all columns stays. Columns stay as they are.
    """
    found = near_duplicates(docs, shingle, max_bits)
    chosen = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.count("*").alias("rows"))
    copies = found.groupBy("doc_id", "text_hash").count()
    kept = stage(
        chosen.select(F.col("row.doc_id").alias("__doc"), F.col("row.text_hash").alias("__hash"), "root")
        .join(copies, F.col("__doc").eqNullSafe(F.col("doc_id")) & (F.col("__hash") == F.col("text_hash")))
        .select("__doc", "__hash", F.col("count").alias("__rows")),
        "kept",
    )

    def rows(keys: DataFrame) -> DataFrame:
        return docs.join(keys, docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__hash")))

    repeated = rows(small_table(kept.filter("__rows > 1"))).groupBy("__doc", "__hash").agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return rows(kept.filter("__rows = 1")).select(*docs.columns).unionByName(repeated.select("__row.*"))
