"""Nearest neighbours by inner product: a block matrix join over int8 tiles."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from allocora.runtime import shuffle_width, small_table, stage

#: Vectors in a block. A tile holds two blocks' products, 16 MB.
BLOCK = 2048
#: Full blocks dealt to a packing task.
TASK_BLOCKS = 4
#: Bytes of candidate blocks in a cell of the grid; a task holds one cell at a time.
CELL_BYTES = 64 << 20

_PARTS = ("ids", "vectors", "quantised", "scale", "norm", "error")
_BLOCKS = "block long, dim int, query boolean, col long, " + ", ".join(f"{p} binary" for p in _PARTS)
_FOUND = "query_block long, query_row int, query_id long, score double, vec_id long"


def cell_blocks(dim: int, item: int, cell_bytes: int = CELL_BYTES) -> int:
    """Candidate blocks in a cell, whatever the number of vectors."""
    return max(1, cell_bytes // (BLOCK * (dim * (item + 1) + 32)))


def column(task: int, number: int, blocks: int, most_tasks: int) -> int:
    """Column of a task's ``number``-th candidate block, so that none gets more than ``blocks``.

    ``most_tasks`` tasks at most share a column, which keeps small tables parallel;
    a task with more blocks than its share opens a column for the rest.
    """
    share = min(blocks, TASK_BLOCKS + 2)
    tasks = max(1, min(most_tasks, blocks // share))
    return (task // tasks) << 32 | (number // share)


def _packing(item: int, most_tasks: int, cell_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors of a task by dimension, packed into matrices and quantised to int8."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, bool], list[tuple[int, np.ndarray]]] = {}
        task = TaskContext.get().partitionId()
        block = itertools.count(task << 32)
        numbers: dict[int, int] = {}

        def packed(dim: int, query: bool, rows: list[tuple[int, np.ndarray]]) -> dict:
            vectors = np.stack([v for _, v in rows])
            scale = np.abs(vectors).max(axis=1) / 127.0
            quantised = np.rint(vectors / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(vectors - quantised * scale[:, None], axis=1)
            col = None
            if not query:
                number = numbers[dim] = numbers.get(dim, -1) + 1
                col = column(task, number, cell_blocks(dim, item, cell_bytes), most_tasks)
            return {
                "block": next(block),
                "dim": dim,
                "query": query,
                "col": col,
                "ids": np.array([i for i, _ in rows], np.int64).tobytes(),
                "vectors": vectors.astype(f"f{item}").tobytes(),
                "quantised": quantised.tobytes(),
                "scale": scale.tobytes(),
                "norm": np.linalg.norm(vectors, axis=1).tobytes(),
                "error": error.tobytes(),
            }

        schema = pa.schema(
            [("block", pa.int64()), ("dim", pa.int32()), ("query", pa.bool_()), ("col", pa.int64())]
            + [(p, pa.binary()) for p in _PARTS]
        )
        for batch in batches:
            out = []
            for i, vector, query in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if i is None or not vector or None in vector:
                    continue
                found = np.array(vector, np.float64)
                if not np.isfinite(found).all() or not found.any():
                    continue
                for kind in (False, True) if query else (False,):
                    rows = waiting.setdefault((len(found), kind), [])
                    rows.append((i, found))
                    if len(rows) == BLOCK:
                        out.append(packed(len(found), kind, rows))
                        rows.clear()
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        out = [packed(*key, rows) for key, rows in waiting.items() if rows]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return blocks


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, in double precision, components added in order."""
    out = np.zeros(len(a))
    for at in range(a.shape[1]):
        out += a[:, at] * b[:, at]
    return out


def tile(q: dict, c: dict, k: int) -> Iterator[tuple[int, float, int]]:
    """(query's row, score, vec_id) of each query's ``k`` nearest in one block, ties to the smaller id.

    The int8 product differs from the true one by at most |q| |e_c| + |e_q| (|c| + |e_c|).
    Only pairs whose upper bound reaches the k-th largest lower bound are computed
    on the original vectors.
    """
    dim = q["dim"]
    at = lambda row, name, kind: np.frombuffer(row[name], kind)
    qx, cx = (at(r, "quantised", np.int8).reshape(-1, dim).astype(np.float32 if dim <= 1000 else np.float64) for r in (q, c))
    ids, own = at(c, "ids", np.int64), at(q, "ids", np.int64)
    qv, cv = (
        at(r, "vectors", f"f{len(r['vectors']) // (n * dim)}").reshape(n, dim).astype(np.float64)
        for r, n in ((q, len(own)), (c, len(ids)))
    )
    scale, norm, error = (at(c, n, np.float64) for n in ("scale", "norm", "error"))
    q_scale, q_norm, q_error = (at(q, n, np.float64) for n in ("scale", "norm", "error"))
    for first in range(0, len(qx), 256):
        rows = slice(first, first + 256)
        about = (qx[rows] @ cx.T).astype(np.float64) * q_scale[rows, None] * scale
        bound = q_norm[rows, None] * error + q_error[rows, None] * (norm + error)
        bound += 1e-9 * q_norm[rows, None] * norm
        same = own[rows, None] == ids
        lower = np.where(same, -np.inf, about - bound)
        least = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(lower), -np.inf)
        row, col = np.nonzero((about + bound >= least[:, None]) & ~same)
        for cut in range(0, len(row), 200_000):
            # a query's pairs stay together only by chance here; heaps join the parts
            r, s = row[cut : cut + 200_000], col[cut : cut + 200_000]
            score = exact_scores(qv[rows][r], cv[s])
            order = np.lexsort((ids[s], -score, r))
            r, s, score = r[order], s[order], score[order]
            start = np.searchsorted(r, r, side="left")
            best = np.arange(len(r)) - start < k
            yield from zip((r[best] + first).tolist(), score[best].tolist(), ids[s[best]].tolist(), strict=True)


def _push(heaps: dict, key: tuple, score: float, vec_id: int, k: int) -> None:
    """Keep the ``k`` best of a query; the heap's root is its worst: least score, then largest id."""
    heap = heaps.setdefault(key, [])
    if len(heap) < k:
        heapq.heappush(heap, (score, -vec_id))
    elif (score, -vec_id) > heap[0]:
        heapq.heapreplace(heap, (score, -vec_id))


def _rows(heaps: dict) -> Iterator[pa.RecordBatch]:
    found = [(*key, score, -neg) for key, heap in heaps.items() for score, neg in sorted(heap, reverse=True)]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64())
    names = [f.split()[0] for f in _FOUND.split(", ")]
    for at in range(0, len(found), 10_000):
        columns = zip(*found[at : at + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """Each query's ``k`` nearest rows by inner product: query_id, rank (from 1), vec_id, score.

    Vectors are packed into blocks and written once as a table. Query blocks and
    candidate blocks meet on a grid: a column has at most ``cell_bytes`` of candidate
    blocks (or one block) and every query block goes to every column, so that a pair of blocks meets
    once, whatever the vectors are. The grid has several rows, to each of which all
    candidates go, only while the columns are too few to keep the tasks busy. A task
    holds the candidates of one cell and streams the query blocks past them. A tile's int8 products and their error
    bounds leave few pairs to compute on the original vectors; heaps of ``k``
    merge a query block's tiles, then a query's cells. The result is exact.

    A vector that is null, empty, zero or has null or non-finite components takes
    no part, nor does a null id. Only vectors of the same length are compared. Rows
    with the query's own id are not its candidates; apart from that, repeated rows
    are rows of their own, on both sides. Ties go to the smaller id. With fewer
    candidates than ``k`` all are returned; an empty table gives no rows.
    """
    width = shuffle_width(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long"), vector_col, F.coalesce(is_query, F.lit(False)))
    item = 4 if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else 8
    tasks = max(1, vectors.count() // (TASK_BLOCKS * BLOCK))
    dealt = rows.repartition(tasks)  # else many tasks' last blocks would be small
    blocks = stage(dealt.mapInArrow(_packing(item, max(1, tasks // width), cell_bytes), _BLOCKS), "blocks")
    columns = blocks.filter("NOT query").select("dim", "col").distinct()
    n_columns = max(1, columns.count())
    tall = max(1, min(blocks.filter("query").count(), -(-2 * width // n_columns)))
    candidates = blocks.filter("NOT query").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(tall - 1))))
    queries = (
        blocks.filter("query")
        .drop("col")
        .withColumn("y", F.pmod(F.hash("block"), F.lit(tall)))
        .join(small_table(columns), "dim")
    )
    cells = (
        candidates.unionByName(queries)
        .repartition(n_columns * tall, "dim", "col", "y")
        .sortWithinPartitions("dim", "col", "y", "query", "block")
        .select("dim", "col", "y", "query", "block", *_PARTS)
    )

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                if (row["dim"], row["col"], row["y"]) != cell:
                    cell, held = (row["dim"], row["col"], row["y"]), []
                if not row["query"]:
                    held.append(row)
                    continue
                heaps: dict = {}
                own = np.frombuffer(row["ids"], np.int64)
                for candidates in held:
                    for at_row, score, vec_id in tile(row, candidates, k):
                        _push(heaps, (row["block"], at_row, int(own[at_row])), score, vec_id, k)
                yield from _rows(heaps)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict = {}
        for batch in batches:
            for block, row, query, score, vec_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _push(heaps, (block, row, query), score, vec_id, k)
        last, rank = None, 0
        for found in _rows(heaps):
            ranks = []
            keys = list(zip(*(found.column(c).to_pylist() for c in range(3)), strict=True))
            for key in keys:
                rank = rank + 1 if key == last else 1
                last = key
                ranks.append(rank)
            yield pa.RecordBatch.from_arrays(
                [found.column(2), pa.array(ranks, pa.int32()), found.column(4), found.column(3)],
                names=["query_id", "rank", "vec_id", "score"],
            )

    found = cells.mapInArrow(tiles, _FOUND)
    return found.repartition("query_block", "query_row").mapInArrow(
        merge, "query_id long, rank int, vec_id long, score double"
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
