"""Pack documents into windows: Karmarkar-Karp multiway differencing over cut documents."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from allocora.llm.common import word_encoder

CAPACITY = 2048
END_ID = 1
#: A document's last part, below the capacity, is cut into pieces of at most this many tokens.
PIECE = 512
#: Windows that one differencing run balances; bounds a task's memory to a few MB.
BLOCK_WINDOWS = 128
#: An excess over whole windows goes to shorter ones in steps of this many tokens.
STEP = 64
#: Sequence ids hold the task above these bits and a number of its own below.
ID_BITS = 40


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Deal ``sizes`` to ``windows`` with nearly equal sums; the positions in each window.

    Every size starts as a partial partition of its own: one window holds it, the
    others are empty. The two partitions with the widest spread are merged again
    and again, the fullest window of one with the emptiest of the other, so that
    their imbalances cancel out. Equal spreads merge in order of position.
    """
    sums: dict[int, np.ndarray] = {}
    heap = []
    for at, size in enumerate(sizes):
        sums[at] = np.zeros(windows, np.int64)
        sums[at][0] = size
        heap.append((-size, at))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        merged = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-merged, kind="stable")
        at = len(sizes) + len(merges)
        sums[at] = merged[order]
        merges.append((a, b, order))
        heapq.heappush(heap, (int(merged[order[-1]] - merged[order[0]]), at))
    # Down the merges again: which window each slot of a partial partition ended in.
    place = {heap[0][1]: np.arange(windows)} if heap else {}
    dealt: list[list[int]] = [[] for _ in range(windows)]
    for at in range(len(sizes) + len(merges) - 1, -1, -1):
        where = place.pop(at)
        if at < len(sizes):
            dealt[where[0]].append(at)
            continue
        a, b, order = merges[at - len(sizes)]
        place[a], place[b] = np.empty(windows, np.int64), np.empty(windows, np.int64)
        place[a][order] = where
        place[b][windows - 1 - order] = where
    return dealt


Piece = tuple[int, int, int]  # document's number in the block, start, length


def split_off(pieces: list[Piece], tokens: int) -> tuple[list[Piece], list[Piece]]:
    """The last ``tokens`` tokens of ``pieces``, cutting one piece if need be, and the rest."""
    rest, taken = list(pieces), []
    while tokens > 0:
        doc, start, length = rest.pop()
        if length > tokens:
            rest.append((doc, start, length - tokens))
            start, length = start + length - tokens, tokens
        taken.append((doc, start, length))
        tokens -= length
    return rest, taken


def pack_block(pieces: list[Piece], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Windows over ``pieces``, each token in exactly one of them.

    What is over whole windows goes to short windows whose lengths are powers of
    two, which need no padding. The rest is balanced over full windows by
    differencing. Where one passes the capacity all the same, its excess is cut off
    and goes to windows with room; if there is no room left, the number of windows
    rises by one.
    """
    total = sum(p[2] for p in pieces)
    short = min(total, -(-(total % capacity) // STEP) * STEP)
    full, tail = split_off(pieces, short)
    out: list[list[Piece]] = []
    if full:
        dealt = difference([p[2] for p in full], -(-(total - short) // capacity))
        out = [[full[i] for i in window] for window in dealt]
    excess: list[Piece] = []
    for at, window in enumerate(out):
        over = sum(p[2] for p in window) - capacity
        if over > 0:
            out[at], cut = split_off(window, over)
            excess += cut
    for window in out:
        room = min(capacity - sum(p[2] for p in window), sum(p[2] for p in excess))
        if room > 0:
            excess, cut = split_off(excess, room)
            window += cut
    if excess:
        out.append(excess)
    length = capacity
    while short:
        while length > short:
            length //= 2
        tail, window = split_off(tail, length)
        out.append(window)
        short -= length
    return [_joined(sorted(window)) for window in out if window]


def _joined(window: list[Piece]) -> list[Piece]:
    """Pieces that follow one another in a document, as one."""
    out: list[Piece] = []
    for doc, start, length in window:
        if out and out[-1][0] == doc and out[-1][1] + out[-1][2] == start:
            out[-1] = (doc, out[-1][1], out[-1][2] + length)
        else:
            out.append((doc, start, length))
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents with their place in a sequence of at most ``capacity`` tokens.

    One row per piece: the id column, ``start`` and ``length`` in the document,
    ``tokens`` (little-endian unsigned 32-bit ids), ``doc_tokens``, ``sequence_id``
    and ``offset`` in the sequence. Sequences shorter than ``capacity`` are padded
    by the reader, except where the length is a power of two.

    Nothing is shuffled: each task packs the documents it reads, a block of about
    ``BLOCK_WINDOWS`` windows at a time, so that hot sources, copies and very long
    texts cost what their tokens cost. Full windows are cut off a long document
    first. A null or empty text has the end id alone; repeated rows and null ids
    are packed like any other rows; other columns are ignored. An empty table
    gives no rows.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    id_field = docs.schema[id_col]
    schema = T.StructType(
        [
            T.StructField(id_col, id_field.dataType),
            *(T.StructField(n, T.LongType()) for n in ("start", "length")),
            T.StructField("tokens", T.BinaryType()),
            *(T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path, False)
        end = np.array([end_id], "<u4").tobytes()
        next_id = TaskContext.get().partitionId() << ID_BITS
        ids: list[object] = []
        tokens: list[bytes] = []
        id_type: pa.DataType | None = None

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal next_id
            columns: list[list] = [[] for _ in schema.names]
            for window in windows:
                offset = 0
                for doc, start, length in window:
                    found = tokens[doc]
                    values = (ids[doc], start, length, found[4 * start : 4 * (start + length)], len(found) // 4, next_id, offset)
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                    offset += length
                next_id += 1
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        pieces: list[Piece] = []
        waiting = 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                whole: list[list[Piece]] = []
                for doc_id, found in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids.append(doc_id)
                    tokens.append(found + end)
                    doc, count = len(ids) - 1, len(found) // 4 + 1
                    tail = count - count % capacity
                    whole += [[(doc, start, capacity)] for start in range(0, tail, capacity)]
                    pieces += [(doc, start, min(PIECE, count - start)) for start in range(tail, count, PIECE)]
                    waiting += count - tail
                if whole:
                    yield rows(whole)
                if waiting >= BLOCK_WINDOWS * capacity:
                    yield rows(pack_block(pieces, capacity))
                    ids, tokens, pieces, waiting = [], [], [], 0
        if pieces:
            yield rows(pack_block(pieces, capacity))

    return docs.select(id_col, text_col).mapInArrow(run, schema)
