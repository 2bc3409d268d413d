"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allocora.llm.common import written

#: A paragraph ends with its line, or at a space after one of these characters: where it ends depends on the text
#: alone, so an edit changes few paragraphs. Longer paragraphs are cut at this many characters.
_ENDS = re.compile(r"\n|(?<=[aeo.!?]) ")
LONGEST = 400
#: Cells of the sketch that is shown as a fingerprint, of the first try at a difference, and by how much each retry grows.
SHOWN_CELLS, FIRST_CELLS, GROWTH = 9, 48, 4
HASHES = 3
#: Documents compared side by side.
BATCH = 128


def paragraphs(text: str | None) -> list[str]:
    """Paragraphs of a text, in order; blank ones are none."""
    out = [p for p in _ENDS.split(text or "") if p and not p.isspace()]
    if any(len(p) > LONGEST for p in out):
        out = [p[at : at + LONGEST] for p in out for at in range(0, len(p), LONGEST)]
    return out


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all texts' paragraphs, and how many each text has; a paragraph that occurs again has another digest."""
    found, counts = [], []
    for text in texts:
        parts = paragraphs(text)
        found += [xxhash.xxh64_intdigest(p) for p in parts]
        counts.append(len(parts))
    digest, count = np.array(found, np.uint64), np.array(counts, np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((digest, owner))
    again = (digest[order][1:] == digest[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    first = np.concatenate([[0], np.where(again, 0, np.arange(1, len(order)))]) if len(order) else np.zeros(0, np.int64)
    nth = np.zeros(len(digest), np.uint64)
    nth[order] = np.arange(len(order)) - np.maximum.accumulate(first)
    repeated = nth > 0
    digest[repeated] = _mixed(digest[repeated] + nth[repeated], 99)
    return digest, count


def _cells(digest: np.ndarray, rows: np.ndarray, cells: int, retry: int) -> np.ndarray:
    """Places of digests in their rows' sketches, one in each third."""
    third = cells // HASHES
    return np.stack([rows * cells + j * third + (_mixed(digest, 10 * retry + j + 1) % np.uint64(third)).astype(np.int64) for j in range(HASHES)])


class Sketches:
    """Sketches of equal size: in each cell a count, a sum of digests and a sum of their check values."""

    def __init__(self, rows: int, cells: int, retry: int):
        self.cells, self.retry = cells, retry
        self.count = np.zeros(rows * cells, np.int64)
        self.digest, self.check = np.zeros(rows * cells, np.uint64), np.zeros(rows * cells, np.uint64)

    def add(self, digest: np.ndarray, places: np.ndarray, sign: np.ndarray | None = None) -> None:
        """Put digests into their places, or out of them where ``sign`` is -1."""
        check = _mixed(digest, 77)
        count = np.ones(len(digest), np.int64) if sign is None else sign
        if sign is not None:
            digest, check = digest * sign.astype(np.uint64), check * sign.astype(np.uint64)
        for place in places:
            np.add.at(self.count, place, count)
            np.add.at(self.digest, place, digest)
            np.add.at(self.check, place, check)

    def fill(self, digest: np.ndarray, rows: np.ndarray) -> None:
        self.add(digest, _cells(digest, rows, self.cells, self.retry))

    def minus(self, mine: np.ndarray, others: np.ndarray) -> Sketches:
        """Differences of chosen rows, one sketch for each pair."""
        out = Sketches(0, self.cells, self.retry)
        for name in ("count", "digest", "check"):
            table = getattr(self, name).reshape(-1, self.cells)
            setattr(out, name, (table[mine] - table[others]).ravel())
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether all came out, digests on the left only, on the right only) of each row; empties what it can.

        A cell that holds one digest shows it; taking it out of its other cells lets them show theirs.
        """
        rows = len(self.count) // self.cells
        left, right = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        touched = np.flatnonzero(np.abs(self.count) == 1)
        showing = np.zeros(len(self.count), bool)
        while len(touched):
            sign = self.count[touched]
            single = np.abs(sign) == 1
            touched, sign = touched[single], sign[single]
            digest = self.digest[touched] * sign.astype(np.uint64)
            pure = _mixed(digest, 77) == self.check[touched] * sign.astype(np.uint64)
            touched, sign, digest = touched[pure], sign[pure], digest[pure]
            if not len(touched):
                break
            row = touched // self.cells
            places = _cells(digest, row, self.cells, self.retry)
            # A digest that shows in several of its cells is taken from the first of them.
            showing[touched] = True
            once = places[showing[places].argmax(axis=0), np.arange(len(touched))] == touched
            showing[touched] = False
            row, sign, digest, places = row[once], sign[once], digest[once], places[:, once]
            np.add.at(left, row[sign > 0], 1)
            np.add.at(right, row[sign < 0], 1)
            self.add(digest, places, -sign)
            showing[places] = True
            touched = np.flatnonzero(showing)
            showing[touched] = False
        whole = ~((self.count != 0) | (self.digest != 0)).reshape(rows, self.cells).any(axis=1)
        return whole, left, right

    def shown(self) -> list[str]:
        count = self.count.astype("<u2").reshape(-1, self.cells)
        digest, check = (x.astype(k).reshape(-1, self.cells) for x, k in ((self.digest, "<u8"), (self.check, "<u4")))
        return [base64.b64encode(a.tobytes() + b.tobytes() + c.tobytes()).decode() for a, b, c in zip(count, digest, check, strict=True)]


Digests = tuple[np.ndarray, np.ndarray]


def fingerprints(texts: list[str | None], found: Digests | None = None) -> list[str]:
    """A short sketch of each text's paragraphs and a hash of the text, as a string; equal for equal texts."""
    digest, count = found or digests(texts)
    sketch = Sketches(len(texts), SHOWN_CELLS, 0)
    sketch.fill(digest, np.repeat(np.arange(len(texts)), count))
    return [f"{s}.{xxhash.xxh64_hexdigest(t or '')}" for s, t in zip(sketch.shown(), texts, strict=True)]


def likeness(found: Digests, mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Share of common paragraphs (twice the common ones by both numbers) of pairs of texts, given by position.

    Pairs' sketches are subtracted and peeled. Where something stays, the pair is
    tried again with larger sketches and other places, until all differing digests
    have come out. Two texts without paragraphs are alike.
    """
    digest, count = found
    firsts = np.cumsum(count) - count
    out = np.ones(len(mine))
    open_pairs = np.flatnonzero(count[mine] + count[others] > 0)
    cells, retry = FIRST_CELLS, 1
    while len(open_pairs):
        used, place = np.unique(np.concatenate([mine[open_pairs], others[open_pairs]]), return_inverse=True)
        size = count[used]
        at = np.repeat(firsts[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        sketch = Sketches(len(used), cells, retry)
        sketch.fill(digest[at], np.repeat(np.arange(len(used)), size))
        half = len(open_pairs)
        whole, left, _ = sketch.minus(place[:half], place[half:]).peel()
        done = open_pairs[whole]
        common = count[mine[done]] - left[whole]
        out[done] = 2 * common / (count[mine[done]] + count[others[done]])
        open_pairs = open_pairs[~whole]
        largest = int((count[mine[open_pairs]] + count[others[open_pairs]]).max()) if len(open_pairs) else 0
        cells, retry = min(cells * GROWTH, HASHES * max(largest, FIRST_CELLS)), retry + 1
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much, or all, of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _compared(ids: list, texts: list[str], arrow_id: pa.DataType) -> dict[str, pa.Array]:
    """Results for all of ``texts`` but the last, each with the next one."""
    first, following = texts[:-1], texts[1:]
    edits = [edited(a, b) for a, b in zip(first, following, strict=True)]
    together = [*texts, *edits]
    n = len(first)
    found = digests(together)
    shown = fingerprints(together, found)
    at = np.arange(n)
    near = likeness(found, np.concatenate([at, at]), np.concatenate([n + 1 + at, at + 1]))
    return {
        "doc_id": pa.array(ids[:n], arrow_id),
        "n_chars": pa.array([len(t) for t in first], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edits], pa.string()),
        "fingerprint": pa.array(shown[:n], pa.string()),
        "edited_fingerprint": pa.array(shown[n + 1 :], pa.string()),
        "near_edited": pa.array(near[:n], pa.float64()),
        "near_next": pa.array(near[n:], pa.float64()),
    }


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edit with the next document's beginning, and their likeness.

    The next document is the one with the next doc_id (equal ids in the order of a
    hash of the text, null first), after the last the first. Rows are dealt by
    ranges of that order, so an id that many rows carry is spread too. What meets
    across two ranges, one row of each, is compared after that.
    Null texts count as empty; repeated rows follow one another; other columns are
    ignored. A single document is its own next. An empty table gives no rows.
    """
    result = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_chars", T.LongType()),
            *(T.StructField(n, T.StringType()) for n in _RESULT[1:4]),
            *(T.StructField(n, T.DoubleType()) for n in _RESULT[4:]),
        ]
    )
    schema = T.StructType([*result, T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()), T.StructField("text", T.StringType())])
    names = schema.names

    def batch(columns: dict[str, pa.Array], part: int, edge: str | None, texts: list[str | None]) -> pa.RecordBatch:
        n = len(columns["doc_id"])
        kinds = {f.name: pa.string() if f.dataType == T.StringType() else pa.float64() for f in result.fields[2:]} | {"n_chars": pa.int64()}
        filled = [columns[c] if c in columns else pa.nulls(n, kinds[c]) for c in names[:-3]]
        return pa.RecordBatch.from_arrays([*filled, pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array(texts, pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: tuple[list, list[str]] | None = None
        arrow_id: pa.DataType | None = None
        for found in batches:
            arrow_id = found.schema.field(0).type
            for at in range(0, found.num_rows, BATCH):
                piece = found.slice(at, BATCH)
                ids, texts = piece.column(0).to_pylist(), [t or "" for t in piece.column(1).to_pylist()]
                if last is None:
                    yield batch({"doc_id": pa.array(ids[:1], arrow_id)}, part, "head", texts[:1])
                else:
                    ids, texts = last[0] + ids, last[1] + texts
                if len(texts) > 1:
                    yield batch(_compared(ids, texts, arrow_id), part, None, [None] * (len(texts) - 1))
                last = ids[-1:], texts[-1:]
        if last is not None:
            yield batch({"doc_id": pa.array(last[0], arrow_id)}, part, "tail", last[1])

    order = (F.col("doc_id"), F.xxhash64("text"))
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    table = written(ranged.mapInArrow(run, schema), "fingerprints")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            for doc_id, text, following in zip(*(c.to_pylist() for c in found.columns), strict=True):
                columns = _compared([doc_id], [text, following], found.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([columns[c] for c in result.names], names=result.names)

    heads = table.filter("edge = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    every = Window.orderBy("next_part")
    parts = heads.select(
        F.col("next_part").alias("part"),
        F.coalesce(F.lead("next_part").over(every), F.min("next_part").over(Window.partitionBy())).alias("next_part"),
    )
    tails = table.filter("edge = 'tail'").select("part", "doc_id", "text").join(parts, "part").join(heads, "next_part")
    across = tails.select("doc_id", "text", "following").mapInArrow(over, result)
    return table.filter("edge IS NULL").select(*result.names).unionByName(across)
