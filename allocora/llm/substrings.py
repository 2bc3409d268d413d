"""Repeated passages: windows of words that start at more than one place, found through a count-min sketch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from allocora.runtime import shuffle_width, stage

WINDOW = 35
#: Words of a block, after which a task starts the next, and bytes of text cut into words at once.
BLOCK_WORDS = 2_000_000
TEXT_BYTES = 1 << 20
#: The sketch has two rows. Each has at least this many cells per window, so how often it errs does not depend on the size.
CELLS_PER_WINDOW = 4
#: Windows a slice of the sketch should answer for at most.
SLICE_WINDOWS = 8_000_000

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_ANSWERS = "block long, slice int, body binary"


class _Numbers(dict):
    """Numbers of words in the order they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _word_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of a text, some at a time, cut at the six ASCII blanks."""
    at = 0
    while text is not None and at < len(text):
        end = min(at + TEXT_BYTES, len(text))
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents as numbers of words, in blocks with a word list each; a document lies in one block."""
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
            T.StructField("lengths", T.BinaryType()),
            T.StructField("numbers", T.BinaryType()),
            T.StructField("vocabulary", T.BinaryType()),
            T.StructField("words", T.LongType()),
        ]
    )
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, lengths, parts, known, held = [], [], [], _Numbers(), 0

        def packed(like: pa.RecordBatch) -> pa.RecordBatch:
            columns = [
                pa.array([block], pa.int64()),
                pa.array([ids], pa.list_(like.schema.field(0).type)),
                pa.array([np.array(lengths, "<i8").tobytes()], pa.binary()),
                pa.array([_squeezed(np.concatenate([np.empty(0, np.int32), *parts]))], pa.binary()),
                pa.array([pa.compress(b" ".join(known), "zstd", asbytes=True)], pa.binary()),
                pa.array([held], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        batch = None
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                length = 0
                for words in _word_lists(text):
                    parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                    length += len(words)
                ids.append(key)
                lengths.append(length)
                held += length
                if held >= BLOCK_WORDS or len(ids) >= BLOCK_WORDS:
                    yield packed(batch)
                    block += 1
                    ids, lengths, parts, known, held = [], [], [], _Numbers(), 0
        if ids:
            yield packed(batch)

    rows = docs.select(F.col(id_col).cast(id_type).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return stage(rows.mapInArrow(run, schema), "word_blocks", bucket_by="block", partitioned=True)


def _squeezed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as their length and four planes of bytes, of which the upper ones are nearly free."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _numbers(body: bytes) -> np.ndarray:
    size = int.from_bytes(body[:8], "little")
    planes = np.frombuffer(pa.decompress(body[8:], size, "zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _vocabulary(body: bytes, size: int) -> list[bytes]:
    # The joined words are as long as the codec says; its frames carry that length.
    import zstandard

    joined = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return joined.split(b" ") if size else []


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out) if count else out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number depends on all of them."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(numbers: np.ndarray, vocabulary: list[bytes], lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, and two independent 64-bit hashes of each window.

    A window's hash is the polynomial of its words' hashes, had from two running
    sums; windows never reach over the end of their document.
    """
    count = len(numbers)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(count)
    at = np.flatnonzero(left >= window)
    of_words = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in vocabulary]), "<u8").reshape(-1, 2)
    found = []
    for k, base in enumerate(_MULTIPLIERS):
        sums = np.zeros(count + 1, np.uint64)
        np.cumsum(of_words[numbers, k] * _powers(base, count), out=sums[1:])
        back = _powers(pow(base, -1, 1 << 64), count)
        found.append(_mixed((sums[at + window] - sums[at]) * back[at]))
    return at, found[0], found[1]


def _cell_keys(hashes: np.ndarray, slices: int, cells: int) -> np.ndarray:
    """Slice in the upper half, cell within it in the lower."""
    slice_ = ((hashes >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
    return (slice_ << np.uint64(32)) | (hashes & np.uint64(cells - 1))


def _cuts(keys: np.ndarray, slices: int) -> np.ndarray:
    """Where each slice's sorted keys start, and the end."""
    return np.searchsorted(keys, np.arange(slices + 1, dtype=np.uint64) << np.uint64(32))


def _steps(cells: np.ndarray) -> bytes:
    """Sorted numbers as their steps."""
    return _squeezed(np.diff(cells, prepend=np.uint32(0)))


def _from_steps(body: bytes) -> np.ndarray:
    return np.cumsum(_numbers(body), dtype=np.int64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(body: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(body, np.uint8), count=count).astype(bool)


class Block:
    """The words of some documents and the hashes of their windows."""

    def __init__(self, row: dict, window: int):
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.numbers = _numbers(row["numbers"])
        self.vocabulary = _vocabulary(row["vocabulary"], len(self.numbers))
        self.at, *self.hashes = window_hashes(self.numbers, self.vocabulary, self.lengths, window)

    def sketch(self, slices: int, cells: int) -> Iterator[tuple[int, bytes, bytes]]:
        """Per row and slice of the sketch: the cells the windows fall into, and which of them hold two or more."""
        for row, hashes in enumerate(self.hashes):
            keys, counts = np.unique(_cell_keys(hashes, slices, cells), return_counts=True)
            cut = _cuts(keys, slices)
            for s in np.flatnonzero(np.diff(cut)).tolist():
                part = slice(cut[s], cut[s + 1])
                yield row * slices + s, _steps((keys[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), _bits(counts[part] > 1)

    def estimated(self, answers: dict[int, bytes], slices: int, cells: int) -> np.ndarray:
        """Windows that both rows of the merged sketch count more than once."""
        flagged = np.ones(len(self.at), bool)
        for row, hashes in enumerate(self.hashes):
            keys, places = np.unique(_cell_keys(hashes, slices, cells), return_inverse=True)
            cut = _cuts(keys, slices)
            parts = [_flags(answers[row * slices + s], cut[s + 1] - cut[s]) for s in np.flatnonzero(np.diff(cut)).tolist()]
            if parts:
                flagged &= np.concatenate(parts)[places]
        return flagged

    def distinct(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen windows: the distinct pairs of hashes in order, how often each occurs, and each window's place there."""
        first, second = (h[chosen] for h in self.hashes)
        order = np.lexsort((second, first))
        pairs = np.column_stack([first[order], second[order]])
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
        places = np.empty(len(pairs), np.int64)
        places[order] = np.cumsum(new) - 1
        return pairs[new], np.bincount(places, minlength=int(new.sum())), places

    def covered(self, repeated: np.ndarray, window: int) -> np.ndarray:
        """Words that a repeated window covers."""
        edges = np.zeros(len(self.numbers) + 1, np.int64)
        starts = self.at[repeated]
        edges[starts] += 1
        edges[starts + window] -= 1
        return np.cumsum(edges[:-1]) > 0


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one; of a batch only one is turned into Python's values at a time."""
    return (batch.slice(at, 1).to_pylist()[0] for batch in batches for at in range(batch.num_rows))


def _merged_sketch(cells: int) -> Callable[[list[dict]], Iterator[bytes]]:
    """Adds the partial sketches of a slice and answers each: which of its cells hold two or more windows."""

    def answers(rows: list[dict]) -> Iterator[bytes]:
        counts = np.zeros(cells, np.uint8)
        found = [_from_steps(row["body"]) for row in rows]
        for row, at in zip(rows, found, strict=True):
            # Counts stop at two, all that is asked for.
            counts[at] = np.minimum(counts[at] + 1 + _flags(row["twice"], len(at)), 2)
        for at in found:
            yield _bits(counts[at] > 1)

    return answers


def _grouped(rows: list[dict]) -> Iterator[bytes]:
    """Groups the windows of a slice exactly and answers each block: which of its windows start at two places or more."""
    pairs = [np.frombuffer(row["body"], "<u8").reshape(-1, 2) for row in rows]
    every = np.concatenate(pairs)
    twice = np.concatenate([_flags(row["twice"], len(p)) for row, p in zip(rows, pairs, strict=True)])
    order = np.lexsort((every[:, 1], every[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (every[order[1:]] != every[order[:-1]]).any(axis=1)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    repeated = (np.bincount(group) > 1) | (np.bincount(group, weights=twice) > 0)
    start = 0
    for part in pairs:
        yield _bits(repeated[group[start : start + len(part)]])
        start += len(part)


def _answered(asked: DataFrame, slices: int, answers: Callable[[list[dict]], Iterator[bytes]]) -> DataFrame:
    """What blocks ask of a slice, answered in the task of that slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, group in groupby(_each(batches), lambda row: row["slice"]):
            rows = list(group)
            columns = [[row["block"] for row in rows], [at] * len(rows), list(answers(rows))]
            kinds = [pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "slice", "body"])

    dealt = asked.repartitionById(max(min(slices, 4 * shuffle_width(asked.sparkSession)), 1), F.col("slice"))
    return dealt.sortWithinPartitions("slice", "block").mapInArrow(run, _ANSWERS)


def _with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Each block with its answers, of which it has one per slice at most; the blocks stay where their buckets are."""
    own = answers.groupBy("block").agg(F.collect_list(F.struct("slice", "body")).alias("answers"))
    return blocks.join(own, "block", "left")


def _rows(rows: list[tuple[int, int, bytes, bytes | None]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["block", "slice", "body", "twice"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: id, n_words, n_removed, and the kept words joined by single spaces (``kept``).

    A word is removed if a window of ``window`` words that covers it starts at
    another place too, in the same document or another. All windows are judged on
    the input.

    Tasks hash the windows of their blocks of documents and sketch them: for each
    slice of the sketch, which cells they fall into and which cells more than once.
    The task of a slice merges all sketches and answers each block, so no sketch is
    ever whole in one place and its cells grow with the windows. Windows that both
    rows of the sketch count more than once are candidates, repeated ones always
    among them. Those are grouped exactly by 128 bits, each once per block however
    often it occurs there, again by slices.

    Null and empty texts have no words and keep an empty text. Repeated rows repeat
    each other's windows. A null id stays. Other columns are ignored; an empty table
    gives no rows. A document is held in one task with some ten bytes for each byte
    of its text.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    id_type = docs.schema[id_col].dataType
    blocks = _blocks(docs, id_col, text_col)
    windows = blocks.agg(F.sum("words")).first()[0] or 0
    slices = max(shuffle_width(docs.sparkSession), -(-windows // SLICE_WINDOWS))
    cells = 1 << max(6, (CELLS_PER_WINDOW * windows // slices).bit_length())

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _rows([(row["block"], *part) for part in Block(row, window).sketch(slices, cells)])

    asked = blocks.drop("ids").mapInArrow(sketched, "block long, slice int, body binary, twice binary")
    estimates = _answered(asked, 2 * slices, _merged_sketch(cells))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            block = Block(row, window)
            chosen = block.estimated({a["slice"]: a["body"] for a in row["answers"] or []}, slices, cells)
            pairs, counts, _ = block.distinct(chosen)
            cut = _cuts(_cell_keys(pairs[:, 0], slices, 1), slices)
            # Behind the slices come the candidates' places, which only pass through to come back with the answers.
            out = [(row["block"], slices + row["block"] % slices, _bits(chosen), None)]
            for s in np.flatnonzero(np.diff(cut)).tolist():
                part = slice(cut[s], cut[s + 1])
                out.append((row["block"], s, pairs[part].astype("<u8").tobytes(), _bits(counts[part] > 1)))
            yield _rows(out)

    def grouped(rows: list[dict]) -> Iterator[bytes]:
        return _grouped(rows) if rows[0]["slice"] < slices else (row["body"] for row in rows)

    found = _with_answers(blocks.drop("ids"), estimates).mapInArrow(candidates, "block long, slice int, body binary, twice binary")
    exact = _answered(found, 2 * slices, grouped)
    schema = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _each(batches):
            block = Block(own, window)
            *answers, chosen = sorted(own["answers"], key=lambda a: a["slice"])
            candidate = _flags(chosen["body"], len(block.at))
            pairs, _, places = block.distinct(candidate)
            cut = _cuts(_cell_keys(pairs[:, 0], slices, 1), slices)
            flags = [_flags(a["body"], cut[a["slice"] + 1] - cut[a["slice"]]) for a in answers]
            repeated = np.flatnonzero(candidate)[np.concatenate([np.empty(0, bool), *flags])[places]]
            keep = ~block.covered(repeated, window)
            ends = np.concatenate([[0], np.cumsum(block.lengths)])
            kept_before = np.concatenate([[0], np.cumsum(keep)])
            for first in range(0, len(own["ids"]), 512):
                last = min(first + 512, len(own["ids"]))
                texts = []
                for a, b in zip(ends[first:last].tolist(), ends[first + 1 : last + 1].tolist(), strict=True):
                    numbers = block.numbers[a:b]
                    texts.append(b" ".join(map(block.vocabulary.__getitem__, numbers[keep[a:b]].tolist())))
                lengths = block.lengths[first:last]
                kept = kept_before[ends[first + 1 : last + 1]] - kept_before[ends[first:last]]
                columns = [pa.array(lengths), pa.array(lengths - kept), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(own["ids"][first:last], to_arrow_type(id_type)), *columns], names=schema.names)

    return _with_answers(blocks, exact).mapInArrow(cleaned, schema)


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), starts AS (
    SELECT row_no, unnest(range(1, len(words) - 33)) AS place FROM texts WHERE len(words) >= 35
), windows AS (
    SELECT s.row_no, s.place, array_to_string(t.words[s.place : s.place + 34], ' ') AS window_text
    FROM starts s JOIN texts t USING (row_no)
), repeated AS (
    SELECT window_text FROM windows GROUP BY window_text HAVING count(*) > 1
), removed AS (
    SELECT DISTINCT row_no, place + step AS place
    FROM windows JOIN repeated USING (window_text), range(35) AS steps(step)
), placed AS (
    SELECT row_no, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM texts
), kept AS (
    SELECT row_no, count(*) AS n_kept, string_agg(word, ' ' ORDER BY place) AS kept
    FROM placed ANTI JOIN removed USING (row_no, place) GROUP BY row_no
)
SELECT doc_id,
       CAST(len(words) AS BIGINT) AS n_words,
       CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (row_no)
"""
