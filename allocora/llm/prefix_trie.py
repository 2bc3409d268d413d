"""Prefix trie of conversations: padded matrices of turn ids, sorted, masked and reduced per depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allocora.llm.common import written
from allocora.runtime import shuffle_width, small_table

#: Turns of a conversation in one row of a matrix; longer conversations go on in further rows.
CHUNK = 64
#: Running sums over a conversation's chunks are taken in groups of this many, then over the groups.
GROUP = 4_096
#: Conversation ids joined into one piece of text before they are hashed.
PIECE = 20_000
#: Turns of a family's first conversation that its others may start with, and the families' size.
HEADS = 8
FAMILY = 5

_KEY = ("e1", "e2", "depth")


def placed_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 0), t1, t2 (128 bits of role and text), bytes of each turn, written to the shared folder.

    Turns are numbered by range partitions of (conversation, turn), so that one very
    long conversation is numbered by several tasks.
    """
    said, spoken = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        said.alias("role"),
        F.xxhash64(said, spoken).alias("t1"),
        F.xxhash64(F.lit(1), spoken, said).alias("t2"),
        F.octet_length(spoken).cast("long").alias("bytes"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("t1"), F.col("t2")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
            local = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
            if conv[0] == last:
                local[: starts[1] if len(starts) > 1 else len(conv)] += held
            last, held = conv[-1], int(local[-1]) + 1
            own = [pa.array(np.full(len(conv), part, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own, *batch.columns[1:]], names=["conv", "part", "local", "t1", "t2", "bytes"])

    ranged = rows.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    numbered = written(
        ranged.select("conv", "t1", "t2", "bytes").mapInArrow(number, "conv long, part int, local long, t1 long, t2 long, bytes long"), "turns"
    )
    counts = numbered.groupBy("conv", "part").count()
    spread = counts.groupBy("conv").agg(F.count("*").alias("parts")).filter("parts > 1")
    # Two conversations at most reach over the end of a partition.
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(spread, "conv").select("conv", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    return numbered.join(small_table(offsets), ["conv", "part"], "left").select(
        "conv", (F.col("local") + F.coalesce("offset", F.lit(0))).alias("pos"), "t1", "t2", "bytes"
    )


def with_family_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of their family's first conversation, then their own after h.

    The family of c starts at c - c % 5 (the remainder has c's sign), and h is the
    crc32 of c's decimal digits modulo 9. Gives the turns (conv, pos, t1, t2, bytes,
    n) and all conversations (conv, n), turnless ones too.
    """
    own = turns.groupBy("conv").agg(F.count("*").alias("own"))
    family = own.select("conv", "own", (F.crc32(F.col("conv").cast("string")) % (HEADS + 1)).alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    first = own.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    sizes = family.join(first, "base", "left").withColumn("s", F.least("h", F.coalesce("base_own", F.lit(0))))
    sizes = written(sizes.select("conv", "base", "h", "s", (F.col("s") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "conversations")
    heads = turns.filter((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv", "base")
    shared = sizes.select("conv", "base", "s", "n").join(heads, "base").filter("pos < s")
    rest = turns.join(sizes.select("conv", "h", "s", "n"), "conv").filter("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("s"))
    columns = ["conv", "pos", "t1", "t2", "bytes", "n"]
    return shared.select(*columns).unionByName(rest.select(*columns)), sizes.select("conv", "n")


def _chunks(turns: DataFrame, chunk: int) -> DataFrame:
    """A row per conversation and ``chunk`` turns: their ids and bytes, and what the turns before them come to.

    The ids are salted with their place, so that the exclusive or of a prefix's ids
    is the name of its node: 128 bits that can be added up from parts in any order.
    """
    salted = turns.select(
        "conv",
        "n",
        F.floor(F.col("pos") / chunk).cast("long").alias("k"),
        F.struct("pos", F.xxhash64("pos", "t1", "t2").alias("u1"), F.xxhash64("t2", "pos", "t1").alias("u2"), "bytes").alias("turn"),
    )
    rows = salted.groupBy("conv", "k").agg(
        F.first("n").alias("n"),
        F.sort_array(F.collect_list("turn")).alias("path"),
        F.bit_xor("turn.u1").alias("x1"),
        F.bit_xor("turn.u2").alias("x2"),
        F.sum("turn.bytes").alias("bytes"),
    )
    rows = written(rows, "chunks").withColumn("group", F.floor(F.col("k") / GROUP))
    sums = {"x1": F.bit_xor, "x2": F.bit_xor, "bytes": F.sum}
    several = rows.filter(F.col("n") > chunk)
    totals = several.groupBy("conv", "group").agg(*[f(c).alias(c) for c, f in sums.items()])

    def before(frame: DataFrame, by: list[str], order: str, prefix: str) -> DataFrame:
        earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return frame.select("conv", "group", *[c for c in ("k",) if c in frame.columns], *[F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"{prefix}_{c}") for c, f in sums.items()])

    inner = before(several.select("conv", "group", "k", *sums), ["conv", "group"], "k", "in")
    running = inner.join(before(totals, ["conv"], "group", "off"), ["conv", "group"])
    running = running.select(
        "conv",
        "k",
        F.col("in_x1").bitwiseXOR(F.col("off_x1")).alias("p1"),
        F.col("in_x2").bitwiseXOR(F.col("off_x2")).alias("p2"),
        (F.col("in_bytes") + F.col("off_bytes")).alias("before"),
    )
    alone = rows.filter(F.col("n") <= chunk).withColumns({c: F.lit(0).cast("long") for c in ("p1", "p2", "before")})
    whole = alone.unionByName(several.join(running, ["conv", "k"]))
    return whole.select(
        "conv",
        "k",
        "n",
        "p1",
        "p2",
        "before",
        "path",
        F.col("p1").bitwiseXOR(F.col("x1")).alias("e1"),
        F.col("p2").bitwiseXOR(F.col("x2")).alias("e2"),
        (F.col("k") * chunk + F.size("path")).alias("depth"),
        (F.col("before") + F.col("bytes")).alias("through"),
    )


class Matrix:
    """Rows of one task's range as a padded matrix, sorted; ``starts[:, j + 1]`` marks where a new node of depth j + 1 begins."""

    def __init__(self, batch: pa.RecordBatch, chunk: int):
        def column(name: str) -> np.ndarray:
            return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

        paths = batch.column(batch.schema.get_field_index("path"))
        offsets = paths.offsets.to_numpy()
        turns = paths.values
        u1, u2, sizes = (turns.field(turns.type.get_field_index(c)).to_numpy()[offsets[0] : offsets[-1]] for c in ("u1", "u2", "bytes"))
        lengths = np.diff(offsets)
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], lengths)
        by_turn = np.lexsort((u2, u1))
        new = np.ones(len(by_turn), np.int64)
        new[1:] = (u1[by_turn[1:]] != u1[by_turn[:-1]]) | (u2[by_turn[1:]] != u2[by_turn[:-1]])
        number = np.empty(len(by_turn), np.int64)
        number[by_turn] = np.cumsum(new)

        def padded(values: np.ndarray) -> np.ndarray:
            out = np.zeros((len(lengths), int(lengths.max())), np.int64)
            out[row, place] = values
            return out

        ids = padded(number)
        k, p1, p2 = column("k"), column("p1"), column("p2")
        order = np.lexsort((*ids.T[::-1], p2, p1, k))
        self.order, self.ids, self.lengths = order, ids[order], lengths[order]
        self.k, p1, p2 = k[order], p1[order], p2[order]
        self.column = lambda name: column(name)[order]
        self.base = self.k * chunk
        self.before = self.column("before")
        self.sizes = padded(sizes)[order]
        self.names = [p[:, None] ^ np.bitwise_xor.accumulate(padded(u)[order], axis=1) for p, u in ((p1, u1), (p2, u2))]
        self.parents = [np.column_stack([p, name[:, :-1]]) for p, name in zip((p1, p2), self.names, strict=True)]
        change = np.ones((len(order), ids.shape[1] + 1), bool)
        change[1:, 0] = (self.k[1:] != self.k[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
        change[1:, 1:] = self.ids[1:] != self.ids[:-1]
        self.starts = np.logical_or.accumulate(change, axis=1)

    def depths(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per column with nodes: all places where its runs start, and which of the runs are nodes, not padding."""
        for j in range(self.ids.shape[1]):
            at = np.flatnonzero(self.starts[:, j + 1])
            yield j, at, np.flatnonzero(self.ids[at, j] != 0)

    def open_runs(self, at: np.ndarray) -> np.ndarray:
        """Runs that may go on in a neighbouring range: the first and the last."""
        return np.isin(np.arange(len(at)), (0, len(at) - 1))


def _introduced(shared: DataFrame, chunk: int) -> DataFrame:
    """Per conversation that is the smallest of some node: the depth up to which others come before it, the bytes so far, and whether its end is a leaf.

    From that depth on it is the smallest member of all nodes on its path. Nodes on
    the first and last path of a range may reach into others; only there are the
    smallest members of the ranges put together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = Matrix(batch, chunk)
            conv, more = m.column("conv"), m.column("more")
            rows = np.arange(len(conv))
            behind = np.zeros(len(conv), np.int64)
            found = []
            for j, at, nodes in m.depths():
                run_of = np.cumsum(m.starts[:, j + 1]) - 1
                least = np.minimum.reduceat(conv, at)
                behind += (least[run_of] < conv) & (m.ids[:, j] != 0)
                deeper = np.maximum.reduceat(m.lengths, at) > j + 1
                deeper |= np.logical_or.reduceat(more & (m.lengths == j + 1), at)
                opened = nodes[m.open_runs(at)[nodes]]
                where = at[opened]
                through = m.before[where] + m.sizes[where, : j + 1].sum(axis=1)
                found.append((np.full(len(where), 1), least[opened], m.k[where], m.base[where] + j + 1, through, *(n[where, j] for n in m.names), deeper[opened]))
            extended = np.zeros(len(conv), bool)
            extended[:-1] = ~m.starts[rows[1:], m.lengths[:-1]]
            sums = np.concatenate([np.zeros((len(conv), 1), np.int64), np.cumsum(m.sizes, axis=1)], axis=1)
            zero = np.zeros(len(conv), np.int64)
            leaf = ~extended & ~more
            leaf[-1] = False
            found.append((zero, conv, m.k, m.base + behind, m.before + sums[rows, behind], zero, zero, leaf))
            end = m.lengths[-1:]
            found.append((np.array([2]), conv[-1:], m.k[-1:], m.base[-1:] + end, zero[:1], *(n[-1:, end[0] - 1] for n in m.names), np.array([False])))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            arrays = [pa.array(c.astype(np.int64)) for c in columns[:-1]] + [pa.array(columns[-1].astype(bool))]
            yield pa.RecordBatch.from_arrays(arrays, names=["kind", "conv", "k", "depth", "through", "e1", "e2", "flag"])

    order = ["k", "p1", "p2", "path"]
    ranged = shared.repartitionByRange(shuffle_width(shared.sparkSession), *order).sortWithinPartitions(*order)
    rows = ranged.select(*order, "before", "conv", "more")
    found = written(rows.mapInArrow(run, "kind long, conv long, k long, depth long, through long, e1 long, e2 long, flag boolean"), "introduced")
    opened = found.filter("kind = 1")
    nodes = opened.groupBy(*_KEY).agg(F.min("conv").alias("least"), F.max("flag").alias("deeper"))
    raised = opened.join(nodes, list(_KEY)).filter("least < conv").select("conv", "k", "depth", "through", F.lit(False).alias("flag"))
    last = found.filter("kind = 2").join(nodes, list(_KEY)).select("conv", (~F.col("deeper")).alias("last_leaf"))
    own = found.filter("kind = 0").select("conv", "k", "depth", "through", "flag").unionByName(raised)
    per_chunk = own.groupBy("conv", "k").agg(F.max(F.struct("depth", "through")).alias("at"), F.max("flag").alias("leaf"))
    per_conv = per_chunk.groupBy("conv").agg(F.min("at").alias("at"), F.max("leaf").alias("leaf"))
    ends = last.groupBy("conv").agg(F.max("last_leaf").alias("last_leaf"))
    leaf = F.col("leaf") | F.coalesce("last_leaf", F.lit(False))
    return per_conv.join(ends, "conv", "left").select("conv", F.col("at.depth").alias("t"), F.col("at.through").alias("t_bytes"), leaf.alias("leaf"))


def _nodes(shared: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Nodes that one range holds whole, and those that may reach over ranges, put together from a part per range."""
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    names = ["open", "e1", "e2", "depth", "conv", "pe1", "pe2", "parent", *sums, "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = Matrix(batch, chunk)
            conv, count, t = m.column("conv"), m.column("members"), m.column("t")
            later_saved, later_children, leaves, ends = (m.column(c) for c in ("saved", "children", "leaves", "ends"))
            depth = m.base[:, None] + np.arange(1, m.ids.shape[1] + 1)
            spared = m.sizes * (count[:, None] - (depth > t[:, None]))
            saved = np.cumsum(spared[:, ::-1], axis=1)[:, ::-1] + later_saved[:, None]
            end = m.base + m.lengths
            above, above_open = None, None
            for j, at, nodes in m.depths():
                d = m.base + j + 1
                children = ((t <= d) & (d < end)) + np.where(d == end, later_children, 0)
                least = np.minimum.reduceat(conv, at)
                totals = [np.add.reduceat(v, at)[nodes] for v in (count, children, leaves, saved[:, j])]
                opened = m.open_runs(at)
                where = at[nodes]
                if j:
                    over = (np.cumsum(m.starts[:, j]) - 1)[where]
                    parent, known = above[over], ~above_open[over]
                else:
                    parent, known = np.zeros(len(where), np.int64), np.zeros(len(where), bool)
                above, above_open = least, opened
                hashed = np.where(m.lengths[where] == j + 1, ends[where], None)
                columns = [
                    pa.array(opened[nodes]),
                    *(pa.array(n[where, j]) for n in m.names),
                    pa.array(d[where]),
                    pa.array(least[nodes]),
                    *(pa.array(p[where, j]) for p in m.parents),
                    pa.array(parent, mask=~known),
                    *(pa.array(v.astype(np.int64)) for v in totals),
                    pa.array(hashed.tolist(), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    order = ["k", "p1", "p2", "path"]
    ranged = shared.repartitionByRange(shuffle_width(shared.sparkSession), *order).sortWithinPartitions(*order)
    rows = ranged.select(*order, "before", "conv", "members", "t", "saved", "children", "leaves", "ends")
    kinds = ["boolean", *["long"] * 11, "string"]
    found = written(rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))), "nodes")
    joined = found.filter("open").groupBy(*_KEY).agg(
        F.min("conv").alias("conv"),
        F.first("pe1").alias("pe1"),
        F.first("pe2").alias("pe2"),
        *[F.sum(c).alias(c) for c in sums],
        F.max("ends").alias("ends"),
    )
    return found.filter("NOT open").drop("open"), written(joined.withColumn("parent", F.lit(None).cast("long")), "open_nodes")


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Tuples as batches of about a thousand rows, fewer where their texts are long."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1_000 + sum(len(v) for v in row if isinstance(v, str))
        if size > 2_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def end_hashes(ends: DataFrame) -> DataFrame:
    """Per key (e1, e2, depth) the SHA-256 of its conversations' decimal ids, ascending, joined by commas.

    A key's ids may lie in several range partitions. What a partition holds whole is
    hashed there; of the first and last key, and of long lists, pieces of text go to
    one task, which hashes them one after the other and keeps none: SHA-256 has to
    read a list in order.
    """

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        return (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    def out(key: tuple, ids: list[int], whole: bool) -> tuple:
        text = ",".join(map(str, ids))
        return (*key, ids[0], None, hashlib.sha256(text.encode()).hexdigest()) if whole else (*key, ids[0], text, None)

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        waiting: tuple | None = None
        for key, group in groupby(rows, lambda row: row[:3]):
            if waiting is not None:
                yield out(*waiting)
            ids, whole = [], waiting is not None
            for row in group:
                ids.append(row[3])
                if len(ids) > PIECE:
                    yield out(key, ids[:-1], False)
                    ids, whole = ids[-1:], False
            waiting = (key, ids, whole)
        if waiting is not None:
            yield out(*waiting[:2], False)

    def hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, group in groupby(rows, lambda row: row[:3]):
            digest = hashlib.sha256()
            for number, row in enumerate(group):
                digest.update(("," * (number > 0) + row[4]).encode())
            yield *key, digest.hexdigest()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(pieces(tuples(batches)), names, [pa.int64()] * 4 + [pa.string()] * 2)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(hashed(tuples(batches)), [*_KEY, "ends"], [pa.int64()] * 3 + [pa.string()])

    names = [*_KEY, "conv", "text", "ends"]
    width = shuffle_width(ends.sparkSession)
    ranged = ends.select(*_KEY, "conv").repartitionByRange(width, *_KEY, "conv").sortWithinPartitions(*_KEY, "conv")
    found = written(ranged.mapInArrow(cut, "e1 long, e2 long, depth long, conv long, text string, ends string"), "ends")
    split = found.filter("ends is null").select(*_KEY, "conv", "text").repartition(width, *_KEY).sortWithinPartitions(*_KEY, "conv")
    return found.filter("ends is not null").select(*_KEY, "ends").unionByName(split.mapInArrow(joined, "e1 long, e2 long, depth long, ends string"))


def trie(turns: DataFrame, conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The nodes of the prefix trie over conversations given as turns (conv, pos, t1, t2, bytes, n) and all their numbers of turns (conv, n).

    A node's members are the conversations that start with its turns. Chunks that
    several conversations share, prefix included, are one row with counts before
    anything is sorted, so copies cost one row. Every figure of a node is a sum over
    its rows: a conversation counts as a child's and a leaf's only where it is the
    smallest member, and spares the bytes of those nodes on its path where it is not.
    """
    chunks = written(_chunks(turns, chunk), "placed_chunks")
    key = list(_KEY)
    shared = chunks.groupBy(*key).agg(
        F.min("conv").alias("conv"), F.max(F.col("n") > F.col("depth")).alias("more"), *[F.first(c).alias(c) for c in ("k", "p1", "p2", "before", "path")]
    )
    introduced = _introduced(written(shared, "shared_chunks"), chunk)
    totals = chunks.groupBy("conv").agg(F.max("through").alias("bytes"))
    figures = conversations.join(totals, "conv", "left").join(introduced, "conv", "left")
    figures = written(
        figures.select(
            "conv",
            "n",
            F.coalesce("t", "n").alias("t"),
            F.coalesce("t_bytes", "bytes", F.lit(0)).alias("t_bytes"),
            F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf"),
        ),
        "figures",
    )
    turnless = conversations.filter("n = 0").select(*[F.lit(0).cast("long").alias(c) for c in key], "conv")
    digests = written(end_hashes(chunks.filter("depth = n").select(*key, "conv").unionByName(turnless)), "end_hashes")
    child = (F.col("t") <= F.col("depth")) & (F.col("depth") < F.col("n"))
    weighted = (
        chunks.join(figures.drop("n"), "conv")
        .groupBy(*key)
        .agg(
            F.min(F.struct("conv", "t")).alias("least"),
            F.count("*").alias("members"),
            F.sum(F.greatest(F.col("t_bytes") - F.col("through"), F.lit(0))).alias("saved"),
            F.sum(child.cast("long")).alias("children"),
            F.sum("leaf").alias("leaves"),
            *[F.first(c).alias(c) for c in ("k", "p1", "p2", "before", "path")],
        )
        .join(digests, key, "left")
        .select(*key, "k", "p1", "p2", "before", "path", F.col("least.conv").alias("conv"), F.col("least.t").alias("t"), "members", "saved", "children", "leaves", "ends")
    )
    weighted = written(weighted, "weighted_chunks")
    whole, opened = _nodes(weighted, chunk)
    # Parents beyond a range or a chunk, by name: open nodes and the ends of full chunks that go on.
    full = weighted.filter((F.col("depth") == (F.col("k") + 1) * chunk) & (F.col("children") > 0))
    named = full.select(*key, "conv").unionByName(opened.select(*key, "conv")).groupBy(*key).agg(F.min("conv").alias("parent"))
    parents = named.select(F.col("e1").alias("pe1"), F.col("e2").alias("pe2"), (F.col("depth") + 1).alias("depth"), "parent")
    first = figures.agg(
        F.min("conv").alias("conv"),
        F.count("*").alias("n_convs"),
        F.sum(((F.col("t") == 0) & (F.col("n") > 0)).cast("long")).alias("n_children"),
        F.greatest(F.sum("leaf"), F.lit(1).cast("long")).alias("n_leaves"),
        F.sum("t_bytes").alias("saved_tokens"),
    )
    at_root = digests.filter("depth = 0").first()
    root = first.filter("n_convs > 0").withColumns({"depth": F.lit(0).cast("long"), "ends": F.lit(at_root and at_root["ends"]).cast("string")})
    least = conversations.agg(F.min("conv")).first()[0]
    known = whole.filter("parent is not null")
    beyond = whole.filter("parent is null AND depth > 1").unionByName(opened.filter("depth > 1")).drop("parent")
    tops = whole.filter("depth = 1").unionByName(opened.filter("depth = 1")).withColumn("parent", F.lit(least).cast("long"))
    found = known
    for part in (beyond.join(small_table(parents), ["pe1", "pe2", "depth"]), tops, root.withColumn("parent", F.lit(None).cast("long"))):
        found = found.unionByName(part, allowMissingColumns=True)
    return found.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def prefix_trie(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text) after its conversations are rebuilt.

    A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. Members that end at no other
    node are turnless conversations at the root.

    Turns are ordered by ``turn``, null first; ties by role, then by a hash of the
    text, so repeated rows stay next to each other and each counts as a turn. Null
    roles and texts are empty ones. Rows without a conv_id belong to no conversation
    and are left out. Other columns are ignored. An empty table has no root and gives
    no rows. Turns are told apart by 128 bits. No task ever holds a whole group: long
    conversations are cut into chunks, copies are counted before they are sorted, and
    common prefixes are spread over ranges.
    """
    turns, conversations = with_family_heads(placed_turns(df))
    return trie(turns, conversations, chunk)


#: The same rows in DuckDB's SQL, for tables whose (conv_id, turn) do not repeat.
ORACLE = """
WITH RECURSIVE given AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), digits AS (
    SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS id_text FROM given
), crc AS (
    SELECT conv_id, id_text, 0 AS done, CAST(4294967295 AS BIGINT) AS state FROM digits
    UNION ALL
    SELECT conv_id, id_text, done + 1, list_reduce(
        [xor(state, ord(id_text[done + 1])), 1, 2, 3, 4, 5, 6, 7, 8],
        lambda acc, step: xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384 ELSE 0 END))
    FROM crc WHERE done < length(id_text)
), heads AS (
    SELECT conv_id, xor(state, 4294967295) % 9 AS h FROM crc WHERE done = length(id_text)
), rebuilt AS (
    SELECT heads.conv_id, 0 AS own, g.pos, g.role, g.text
    FROM heads JOIN given g ON g.conv_id = heads.conv_id - heads.conv_id % 5 AND g.pos < h
    UNION ALL
    SELECT heads.conv_id, 1, g.pos, g.role, g.text FROM heads JOIN given g USING (conv_id) WHERE g.pos >= h
), turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth,
           md5(length(role) || ':' || role || text) AS turn_name, CAST(strlen(text) AS BIGINT) AS bytes
    FROM rebuilt
), paths AS (
    SELECT conv_id, depth, bytes, md5(string_agg(turn_name, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node
    FROM turns
    UNION ALL
    SELECT conv_id, 0, 0, 'root' FROM heads
), steps AS (
    SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
           depth = max(depth) OVER (PARTITION BY conv_id) AS is_end
    FROM paths
), nodes AS (
    SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
           any_value(bytes) AS bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '') AS ends
    FROM steps GROUP BY node
), pairs AS (
    SELECT DISTINCT a.node AS above, b.node AS below
    FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), children AS (
    SELECT parent, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), below AS (
    SELECT above, CAST(count(*) FILTER (c.parent IS NULL) AS BIGINT) AS n_leaves,
           CAST(sum((n.n_convs - 1) * n.bytes) AS BIGINT) AS saved_tokens
    FROM pairs JOIN nodes n ON n.node = below LEFT JOIN children c ON c.parent = below GROUP BY above
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children, b.n_leaves, b.saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b ON b.above = n.node LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.parent = n.node
"""
