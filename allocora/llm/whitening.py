"""Whitening of embeddings: exact covariances from bit-sliced planes, components, whitened values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allocora.llm.common import written
from allocora.runtime import collect_bounded

#: Entries become floor(SCALE * entry).
SCALE = 256
COMPONENTS = 4
#: Rows whose planes are held at once; counts of that many rows times 2^48 stay within 63 bits.
BLOCK = 16_384
NARROW_BITS = 24
#: Dimensions whose square the driver's eigen-decomposition may hold.
MAX_DIMENSION = 4_096
#: Eigenvalues below this share of the largest, times the dimension, are rounding and count as zero.
ZERO = 2.0**-50
_LONG = 2**63


def _whole(entries: np.ndarray) -> np.ndarray:
    """floor(SCALE * entry) as 64-bit integers; what lies beyond them goes to their ends, as Spark's cast does."""
    scaled = np.floor(entries.astype(np.float64) * SCALE)
    inside = np.clip(scaled, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
    return np.where(scaled >= 2.0**63, np.int64(_LONG - 1), inside)


def encoded(vectors: pa.Array) -> list[bytes | None]:
    """Each vector as one byte for its width, then its integers in that many bytes each, as few as they fit; None if it takes no part.

    Equal integer vectors have equal bytes.
    """
    out: list[bytes | None] = [None] * len(vectors)
    offsets = vectors.offsets.to_numpy()
    values = vectors.values
    entries = values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(entries)
    if values.null_count:
        bad |= values.is_null().to_numpy(zero_copy_only=False)
    whole = np.zeros(len(entries), np.int64)
    whole[~bad] = _whole(entries[~bad])
    spoilt = np.concatenate([[0], np.cumsum(bad)])
    given = vectors.is_valid().to_numpy(zero_copy_only=False)
    for row in np.flatnonzero(given & (spoilt[offsets[1:]] == spoilt[offsets[:-1]])).tolist():
        part = whole[offsets[row] : offsets[row + 1]]
        low, high = (int(part.min()), int(part.max())) if len(part) else (0, 0)
        width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
        out[row] = bytes([width]) + part.astype(f"<i{width}").tobytes()
    return out


def decoded(codes: list[bytes], dimension: int) -> np.ndarray:
    """Integer vectors of equal length as rows."""
    out = np.empty((len(codes), dimension), np.int64)
    widths = np.fromiter((c[0] for c in codes), np.int8, len(codes))
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        joined = b"".join([codes[r][1:] for r in rows.tolist()])
        out[rows] = np.frombuffer(joined, f"<i{width}").reshape(len(rows), dimension)
    return out


def cross_products(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums per dimension and sums of products per pair of dimensions, as exact Python integers.

    Each dimension is shifted to start at 0. Bit b of all rows makes a plane, packed
    into 64-bit words; two planes' common bits, counted and weighted by their places,
    add up to the products of the shifted values. Only the upper triangle is counted.
    """
    count, dimension = rows.shape
    low = rows.min(axis=0)
    shifted = rows.view(np.uint64) - low.view(np.uint64)
    bits = int(shifted.max()).bit_length() if dimension else 0
    padded = -(-count // 64) * 64
    planes = np.zeros((bits, dimension, padded // 64), np.uint64)
    for bit in range(bits):
        plane = np.zeros((dimension, padded), np.uint8)
        plane[:, :count] = ((shifted >> np.uint64(bit)) & np.uint64(1)).T
        planes[bit] = np.packbits(plane, axis=1).view(np.uint64)
    kind = np.int64 if bits <= NARROW_BITS else object
    weights = np.array([1 << bit for bit in range(bits)], kind)
    ones = np.bitwise_count(planes).sum(axis=2, dtype=np.int64)
    sums = (ones * weights[:, None]).sum(axis=0).astype(object) if bits else np.zeros(dimension, object)
    products = np.zeros((dimension, dimension), kind)
    for i in range(dimension):
        for bit in np.flatnonzero(ones[:, i]).tolist():
            common = np.bitwise_count(planes[:, i:] & planes[bit, i]).sum(axis=2, dtype=np.int64)
            products[i, i:] += (common * weights[:, None]).sum(axis=0) * weights[bit]
    products = products.astype(object)
    products = products + np.triu(products, 1).T
    shift = low.astype(object)
    outer = np.outer(shift, sums)
    return sums + count * shift, products + outer + outer.T + count * np.outer(shift, shift)


@dataclass(frozen=True)
class Whitener:
    """Of ``count`` distinct integer vectors: their sums, the covariance's largest eigenvalues and unit eigenvectors."""

    count: int
    sums: tuple[int, ...]
    values: tuple[float, ...]
    vectors: tuple[tuple[float, ...], ...]
    explained: tuple[float, ...]

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """n x - S, as integers of whatever size it needs."""
        sums = np.array(self.sums, object)
        top = max([abs(int(rows.min())), abs(int(rows.max()))]) if rows.size else 0
        if top * self.count + max(map(abs, self.sums), default=0) < 2**62:
            return rows * np.int64(self.count) - sums.astype(np.int64)
        return rows.astype(object) * self.count - sums

    def deviation(self, rows: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2; None where a long cannot hold it."""
        centred = self.centred(rows)
        if centred.dtype != object and rows.size and float(np.abs(centred).max()) ** 2 * centred.shape[1] < 2.0**62:
            return (centred * centred).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in centred]
        return [v if v < _LONG else None for v in exact]

    def whitened(self, rows: np.ndarray) -> list[np.ndarray | None]:
        """Per component the rows' values; None for a component without variance."""
        away = self.centred(rows).astype(np.float64) / self.count
        return [away @ np.array(v) / np.sqrt(e) if e > 0 else None for e, v in zip(self.values, self.vectors, strict=True)]


def whitener(count: int, sums: np.ndarray, products: np.ndarray, components: int) -> Whitener:
    """From exact sums: the covariance is centred in integers, then divided and decomposed."""
    dimension = len(sums)
    covariance = np.empty((dimension, dimension))
    for i in range(dimension):
        for j in range(i, dimension):
            covariance[i, j] = covariance[j, i] = (count * int(products[i, j]) - int(sums[i]) * int(sums[j])) / count**2
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(covariance))
    floor = ZERO * dimension * max(float(values.max(initial=0.0)), 0.0)
    kept = [float(values[k]) if values[k] > floor else 0.0 for k in order]
    signs = [1.0 if vectors[np.argmax(np.abs(vectors[:, k])), k] >= 0 else -1.0 for k in order]
    return Whitener(
        count,
        tuple(int(s) for s in sums),
        tuple(kept),
        tuple(tuple((vectors[:, k] * s).tolist()) for k, s in zip(order, signs, strict=True)),
        tuple(e / trace if trace > 0 else 0.0 for e in kept),
    )


def integer_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and coded integer vector of each row that takes part, written to the shared folder."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vectors = part.column(1)
                plain = pa.concat_arrays([vectors.cast(pa.list_(pa.float64()))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoded(plain), pa.binary())], names=["id", "x"])

    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, schema)
    return written(rows.filter("x is not null"), "integer_vectors")


def fitted(distinct: DataFrame, dimension: int, components: int = COMPONENTS) -> Whitener | None:
    """Over coded vectors of one length: partial sums per task, added per pair of dimensions; None without rows.

    The driver meets one row per pair of dimensions, whatever the number of vectors.
    """
    if dimension > MAX_DIMENSION:
        raise ValueError(f"vectors of more than {MAX_DIMENSION} entries")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, np.zeros(dimension, object), np.zeros((dimension, dimension), object)
        for batch in batches:
            codes = batch.column(0).to_pylist()
            for at in range(0, len(codes), BLOCK):
                rows = decoded(codes[at : at + BLOCK], dimension)
                s, p = cross_products(rows)
                count, sums, products = count + len(rows), sums + s, products + p
        if count:
            # Pair (-1, -1) holds the count, (-1, j) a sum; values are high * 2^64 + low.
            yield _cells([-1] * (dimension + 1), range(-1, dimension), [count, *sums])
            for i in range(dimension):
                yield _cells([i] * (dimension - i), range(i, dimension), products[i, i:].tolist())

    added = (
        distinct.select("x")
        .mapInArrow(partial, "i int, j int, high decimal(38,0), low decimal(38,0)")
        .groupBy("i", "j")
        .agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    )
    found = {(r["i"], r["j"]): (int(r["high"]) << 64) + int(r["low"]) for r in collect_bounded(added, (dimension + 2) ** 2, "pairs of dimensions")}
    if not found:
        return None
    sums = np.array([found[-1, j] for j in range(dimension)], object)
    products = np.zeros((dimension, dimension), object)
    for i in range(dimension):
        for j in range(i, dimension):
            products[i, j] = found[i, j]
    return whitener(found[-1, -1], sums, products, components)


def _cells(i: list[int], j: range, values: list[int]) -> pa.RecordBatch:
    from decimal import Decimal

    halves = [divmod(int(v), 1 << 64) for v in values]
    columns = [pa.array(i, pa.int32()), pa.array(list(j), pa.int32())]
    columns += [pa.array([Decimal(h[k]) for h in halves], pa.decimal128(38, 0)) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, names=["i", "j", "high", "low"])


def identity_error(distinct: DataFrame, model: Whitener, dimension: int) -> float:
    """Largest absolute entry of the whitened fit vectors' covariance minus the identity, measured over all of them."""
    used = [k for k, e in enumerate(model.values) if e > 0]
    if not used:
        return 0.0
    names = [f"w{k}" for k in used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_pylist()
            for at in range(0, len(codes), 4096):
                found = model.whitened(decoded(codes[at : at + 4096], dimension))
                yield pa.RecordBatch.from_arrays([pa.array(found[k]) for k in used], names=names)

    pairs = [(a, b) for a in range(len(used)) for b in range(a, len(used))]
    rows = distinct.select("x").mapInArrow(run, ", ".join(f"{n} double" for n in names))
    found = rows.agg(*[F.covar_pop(names[a], names[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries become floor(256 entry) as longs. The covariance is that of the distinct
    integer vectors, each once however often it occurs. Its cross-products are exact
    integers at every size.

    Rows whose vector is null, or holds null or non-finite entries, are dropped. All
    others must have one length to have a covariance: those of another length than the
    most frequent one (the longer of tied ones) are dropped too, empty vectors always.
    Repeated rows each have their rows of output; a null id stays null. A component
    without variance (fewer distinct vectors than dimensions) has null as whitened
    value, explains 0 and does not count in the identity's error. ``deviation`` is
    null where a long cannot hold it. Other columns are ignored; without valid rows
    there is no output.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, kind),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    rows = integer_vectors(df, id_col, vector_col)
    length = ((F.octet_length("x") - 1) / F.conv(F.hex(F.substring("x", 1, 1)), 16, 10).cast("int")).cast("int")
    frequent = rows.groupBy(length.alias("length")).count().filter("length > 0").orderBy(F.desc("count"), F.desc("length")).first()
    if frequent is None:
        return spark.createDataFrame([], schema)
    dimension = frequent["length"]
    rows = rows.filter(length == dimension)
    distinct = written(rows.select("x").distinct(), "distinct_vectors")
    model = fitted(distinct, dimension, components)
    error = identity_error(distinct, model, dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vectors = decoded(part.column(1).to_pylist(), dimension)
                deviation = pa.array(model.deviation(vectors), pa.int64())
                for k, values in enumerate(model.whitened(vectors)):
                    same = [
                        pa.array(np.full(len(vectors), k + 1, np.int32)),
                        pa.array(np.full(len(vectors), model.count, np.int64)),
                        deviation,
                        pa.nulls(len(vectors), pa.float64()) if values is None else pa.array(values),
                        pa.array(np.full(len(vectors), model.explained[k])),
                        pa.array(np.full(len(vectors), error)),
                    ]
                    yield pa.RecordBatch.from_arrays([part.column(0), *same], names=schema.names)

    return rows.select("id", "x").mapInArrow(run, schema)
