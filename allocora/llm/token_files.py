"""Token files: ids of whole documents in patched frame-of-reference blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allocora.llm.common import word_encoder
from allocora.runtime import small_table

END_ID = 2
BLOCK = 256
#: The packed width holds this share of a block's values, in percent; the others are exceptions.
PERCENTILE = 90
#: A segment, one row of a file, ends with the document that brings it to this many ids.
SEGMENT_IDS = 1 << 18

# A block: minimum (4 bytes), width and number of exceptions (1 each), the packed
# values, then the exceptions' positions (1 byte each) and whole values (4 each).
_HEAD = 6


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 256 values below 2**width as rows of 32 * width bytes."""
    lanes = np.ascontiguousarray(values.astype(np.uint64).reshape(-1, 64).T)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for at in range(64):
        word, shift = divmod(at * width, 64)
        words[word] |= lanes[at] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[at] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(values), 32 * width)


def _unpacked(found: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(found).view("<u8").reshape(-1, width).T)
    lanes = np.empty((64, words.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for at in range(64):
        word, shift = divmod(at * width, 64)
        lanes[at] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            lanes[at] |= words[word + 1] << np.uint64(64 - shift)
        lanes[at] &= mask
    return np.ascontiguousarray(lanes.T).reshape(-1, BLOCK).astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of 256 ids as bytes, and where each block starts. The last block is filled up with its last id."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    count = -(-len(ids) // BLOCK)
    values = np.concatenate([ids, np.full(count * BLOCK - len(ids), ids[-1], ids.dtype)]).astype(np.uint32).reshape(count, BLOCK)
    least = values.min(axis=1)
    over = values - least[:, None]
    at = BLOCK * PERCENTILE // 100 - 1
    chosen = np.partition(over, at, axis=1)[:, at]
    width = np.frexp(chosen.astype(np.float64))[1].astype(np.int64)
    outside = over.astype(np.uint64) >> width[:, None].astype(np.uint64) > 0
    exceptions = outside.sum(axis=1)
    sizes = _HEAD + 32 * width + 5 * exceptions
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(count, 4)
    out[starts + 4], out[starts + 5] = width, exceptions
    over[outside] = 0
    for bits in np.unique(width):
        if bits:
            rows = np.flatnonzero(width == bits)
            out[starts[rows, None] + _HEAD + np.arange(32 * bits)] = _packed(over[rows], int(bits))
    row, position = np.nonzero(outside)
    nth = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
    lists = starts + _HEAD + 32 * width
    out[lists[row] + nth] = position
    wide = (lists + exceptions)[row] + 4 * nth
    out[wide[:, None] + np.arange(4)] = values[row, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts


def decode_blocks(payload: bytes, starts: np.ndarray, count: int, blocks: slice = slice(None)) -> np.ndarray:
    """The ids of the chosen blocks; of all ``count`` ids by default."""
    found, starts = np.frombuffer(payload, np.uint8), np.asarray(starts, np.int64)[blocks]
    if not len(starts):
        return np.zeros(0, np.uint32)
    least = found[starts[:, None] + np.arange(4)].view("<u4").reshape(-1).astype(np.uint32)
    width, exceptions = found[starts + 4].astype(np.int64), found[starts + 5].astype(np.int64)
    out = np.zeros((len(starts), BLOCK), np.uint32)
    for bits in np.unique(width):
        if bits:
            rows = np.flatnonzero(width == bits)
            out[rows] = _unpacked(found[starts[rows, None] + _HEAD + np.arange(32 * bits)], int(bits))
    out += least[:, None]
    row = np.repeat(np.arange(len(starts)), exceptions)
    nth = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
    lists = starts + _HEAD + 32 * width
    position = found[lists[row] + nth]
    wide = (lists + exceptions)[row] + 4 * nth
    out[row, position] = found[wide[:, None] + np.arange(4)].view("<u4").reshape(-1)
    return out.reshape(-1)[: count if blocks == slice(None) else None]


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the ids of all documents, in ascending order of the id column, below ``path``.

    A file holds a range of ids (null first; equal ids in order of a hash of the
    text, which also spreads an id that many rows carry over several files). Its
    rows are segments: the documents' ids and lengths, the encoded blocks
    and the index of block starts. The container is Parquet, so that any store
    Spark writes to will do and a lost task is written again. A null or empty text
    has the end id alone; repeated rows are written each; an empty table gives a
    folder without segments. Other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.LongType()),
            T.StructField("start_in_part", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("documents", T.ArrayType(id_type)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("blocks", T.BinaryType()),
            T.StructField("block_starts", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path, True)
        end = np.array([end_id], "<u4").tobytes()
        part, done = TaskContext.get().partitionId(), 0
        ids: list[object] = []
        tokens: list[bytes] = []
        arrow_id: pa.DataType | None = None

        def segment() -> pa.RecordBatch:
            nonlocal done
            found = np.frombuffer(b"".join(tokens), "<u4")
            blocks, starts = encode_blocks(found)
            types = [pa.int64()] * 3 + [pa.list_(arrow_id), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
            row = [part, done, len(found), list(ids), [len(t) // 4 for t in tokens], blocks, starts.tolist()]
            done += len(found)
            ids.clear()
            tokens.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=schema.names)

        size = 0
        for batch in batches:
            arrow_id = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for doc_id, found in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist()), strict=True):
                    ids.append(doc_id)
                    tokens.append(found + end)
                    size += len(tokens[-1]) // 4
                    if size >= SEGMENT_IDS:
                        yield segment()
                        size = 0
        if ids:
            yield segment()

    order = (F.col(id_col), F.xxhash64(text_col))
    (
        docs.select(id_col, text_col)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(run, schema)
        .write.parquet(path)
    )


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, ``start`` among all ids, ``tokens`` (little-endian unsigned 32-bit).

    Where a file starts is the sum of the files before it: one row per file, which
    is broadcast if it is proven small.
    """
    segments = spark.read.parquet(path)
    id_type = segments.schema["documents"].dataType.elementType
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")
    bases = small_table(totals.select("part", before.alias("base")))
    schema = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("start", T.LongType()),
            T.StructField("tokens", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                found = decode_blocks(row["blocks"], row["block_starts"], row["n_ids"]).astype("<u4").tobytes()
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                arrow_id = batch.schema.field(0).type.value_type
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["documents"], arrow_id),
                        pa.array(starts + row["start_in_part"] + row["base"], pa.int64()),
                        pa.array([found[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    names=schema.names,
                )

    joined = segments.join(bases, "part").select(
        "documents", "lengths", "blocks", "block_starts", "n_ids", "start_in_part", "base"
    )
    return joined.mapInArrow(run, schema)
